"""Queries that read files: the texts are made from the points and read back by the library."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery.functions import features as X
from orrery.operators import aggregate as A
from orrery.operators import transform as R
from orrery.operators import windows as W
from orrery.plans.registry import pred, pts, query, r6
from orrery.session import checkpoint_dir, table
from orrery.sources import datasets, pockets, reports, sinks, structures, tables
from orrery.streaming import folder

_NAMES = ("CA", "N", "O", "CB", "SG", "OD1", "ND2")
_CODES = ("ALA", "HIS", "ASP", "ATP", "HOH")

#: The same rows as ``_atoms``.
_ATM = f"""atm AS (SELECT 's' || grp AS item, id, CAST(id AS INT) AS serial, list_extract({list(_NAMES)!r}, CAST(id % 7 + 1 AS INT)) AS name, list_extract({list(_CODES)!r}, CAST(id % 5 + 1 AS INT)) AS res_name,
  CASE WHEN id % 2 = 0 THEN 'A' ELSE 'B' END AS chain_id, CAST(id % 1000 AS INT) AS seq_num, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(score * 10, 2) AS bfactor, id % 5 >= 3 AS is_het, grp FROM pts)"""
_ATOM_COLUMNS = "item, serial, name, res_name, chain_id, seq_num, x, y, z, bfactor, substr(name, 1, 1) AS element, is_het"


def _atoms(spark, d):
    i = F.col("id")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (i % 7 + 1).cast("int"))
    return pts(spark, d).select(
        F.concat(F.lit("s"), "grp").alias("item"), "grp", "id", F.lit(0).alias("model"), i.cast("int").alias("serial"), name.alias("name"), F.lit(None).cast("string").alias("altloc"),
        F.element_at(F.array(*map(F.lit, _CODES)), (i % 5 + 1).cast("int")).alias("res_name"), F.when(i % 2 == 0, "A").otherwise("B").alias("chain_id"), (i % 1000).cast("int").alias("seq_num"),
        F.lit(None).cast("string").alias("ins_code"), "x", "y", "z", F.lit(1.0).cast("float").alias("occupancy"), (F.col("score") * 10).cast("float").alias("bfactor"),
        F.substring(name, 1, 1).alias("element"), (i % 5 >= 3).alias("is_het"),
    )


def _lines(spark, d):
    return sinks.pdb_lines(_atoms(spark, d)).select("item", F.lit(0).alias("model"), F.col("serial").cast("long").alias("line_no"), "value")


def _shown(atoms):
    return atoms.select("item", "serial", "name", "res_name", "chain_id", "seq_num", *(r6(c, 3).alias(c) for c in "xyz"), r6(F.col("bfactor").cast("double"), 2).alias("bfactor"), "element", "is_het")


def _whole(lines, head: str = ""):
    """One text per item, as path and content."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda s: s["value"]), "\n")
    return lines.groupBy("item").agg(F.concat(F.lit(head), text, F.lit("\n#\n")).alias("text"))


def _file(spark, df, kind: str = "text", **options) -> str:
    """The rows as a file of the shared folder."""
    path = f"{checkpoint_dir(spark)}/file-{uuid.uuid4().hex}"
    getattr(df.coalesce(1).write.options(**options), kind)(path)
    return path


@query("s1_read_dataset", "SELECT 'dir/' || replace(c_name, '#', '-') AS protein, replace(c_name, '#', '-') AS item, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'A' ELSE 'A|B' END AS chains, 'fpocket' AS method FROM customer")
def s1_read(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 3
    rows = c.select(F.col("c_custkey").alias("n"), F.concat(F.lit("dir/"), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit("  "), F.when(k == 0, "*").when(k == 1, "A").otherwise("A,B"), F.lit("  # a comment")).alias("value"))
    head = spark.createDataFrame([(-3, "# dataset"), (-2, "PARAM.METHOD=fpocket"), (-1, "HEADER: protein chains"), (0, "")], "n long, value string")
    got = datasets.read_dataset(spark, _file(spark, head.unionByName(rows).orderBy("n").select("value")))
    return got.items.select("protein", "item", F.array_join("chains", "|").alias("chains"), F.lit(got.params["METHOD"]).alias("method"))


@query("s3_single_file", "SELECT url AS protein, regexp_extract(url, '([^/]*)$', 1) AS item FROM pages")
def s3(spark, d):
    return datasets.of_paths(table(spark, d, "pages").select(F.col("url").alias("protein"))).select("protein", "item")


@query("s4_read_joined", "SELECT replace(c_name, '#', '-') AS item, NULL::VARCHAR AS chain FROM customer UNION ALL SELECT replace(s_name, '#', '-'), 'C' FROM supplier")
def s4_read(spark, d):
    one = _file(spark, table(spark, d, "customer").select(F.replace("c_name", F.lit("#"), F.lit("-")).alias("value")))
    head = spark.createDataFrame([("HEADER: protein chains",)], "value string").coalesce(1)
    two = _file(spark, head.unionByName(table(spark, d, "supplier").select(F.concat(F.replace("s_name", F.lit("#"), F.lit("-")), F.lit(" C")).alias("value"))))
    return datasets.joined(spark, f"{one}+{two}").items.select("item", F.col("chains")[0].alias("chain"))


@query("s5_pdb_atoms", f"WITH {_ATM} SELECT {_ATOM_COLUMNS} FROM atm", "pts")
def s5(spark, d):
    return _shown(structures.pdb_atoms(_lines(spark, d).select("item", "model", "value")))


@query("s6_cif_atoms", f"WITH {_ATM} SELECT {_ATOM_COLUMNS.replace('item', 'item || chr(46) || chr(99) || chr(105) || chr(102) AS item')} FROM atm", "pts")
def s6(spark, d):
    head, lines = reports.cif_lines(_atoms(spark, d))
    text = _whole(lines.withColumnRenamed("serial", "line_no"), head)
    return _shown(structures.parsed(text.select(F.concat("item", F.lit(".cif")).alias("path"), F.encode("text", "UTF-8").alias("content"))))


@query("s7_compressed_files", f"WITH {_ATM} SELECT {_ATOM_COLUMNS} FROM atm", "pts")
def s7(spark, d):
    def compressed(batches):
        import gzip
        import lzma

        import zstandard

        how = [(".pdb", bytes), (".pdb.gz", gzip.compress), (".pdb.zst", zstandard.ZstdCompressor().compress), (".pdb.lzma", lambda b: lzma.compress(b, format=lzma.FORMAT_ALONE))]
        for pdf in batches:
            kinds = [how[int(i[1:]) % 4] for i in pdf["item"]]
            pdf["path"] = [f"dir/{i}{suffix}" for i, (suffix, _) in zip(pdf["item"], kinds, strict=True)]
            pdf["content"] = [pack(t.encode()) for t, (_, pack) in zip(pdf["text"], kinds, strict=True)]
            yield pdf[["path", "content"]]

    files = _whole(_lines(spark, d)).mapInPandas(compressed, "path string, content binary")
    return _shown(structures.parsed(files)).withColumn("item", F.substring_index("item", ".", 1))


@query("s8_first_model", "SELECT grp AS item, id FROM pts QUALIFY id % 4 = min(id % 4) OVER (PARTITION BY grp)", "pts")
def s8(spark, d):
    rows = pts(spark, d).select(F.col("grp").alias("item"), "id", (F.col("id") % 4).cast("int").alias("model"))
    return structures.first_model(rows).select("item", "id")


@query("s9_chain_reduction", f"WITH {_ATM} SELECT item, serial FROM atm WHERE grp % 3 = 0 OR (grp % 3 = 1 AND chain_id = 'B')", "pts")
def s9(spark, d):
    a = _atoms(spark, d)
    chains = F.when(F.col("grp") % 3 == 0, F.array(F.lit("*"))).when(F.col("grp") % 3 == 1, F.array(F.lit("B"), F.lit("Z")))
    return structures.reduced_to_chains(a, a.select("item", "grp").distinct().where("grp % 3 < 2").select("item", chains.alias("chains"))).select("item", "serial")


_PLACES = "round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z"


def _placed(df, *more):
    return df.select("item", "name", F.col("rank").cast("long").alias("rank"), *(r6(c, 4).alias(c) for c in "xyz"), *more)


@query("s10_fpocket", "SELECT 'all' AS item, 'pocket' || (grp + 1) AS name, grp + 1 AS rank, round(avg(round(x, 3)), 4) AS x, round(avg(round(y, 3)), 4) AS y, round(avg(round(z, 3)), 4) AS z, count(*) AS vertices FROM pts GROUP BY grp", "pts")
def s10(spark, d):
    v = pts(spark, d).select(F.lit("all").alias("item"), F.format_string("HETATM%5d  POL STP C%4d    %8.3f%8.3f%8.3f  0.00  0.00          Ve", F.col("id"), F.col("grp") + 1, "x", "y", "z").alias("value"))
    return _placed(pockets.loader("fpocket")(v), "vertices")


@query("s11_header_stats", "SELECT 's' || grp AS item, 'pocket score' AS label, round(score, 4) AS value FROM (SELECT grp, max(score) AS score FROM pts GROUP BY grp) UNION ALL SELECT 's' || grp, 'number of alpha spheres', count(*) FROM pts GROUP BY grp", "pts")
def s11(spark, d):
    g = pts(spark, d).groupBy("grp").agg(F.max("score").alias("s"), F.count("*").alias("n"))
    item = F.concat(F.lit("s"), "grp").alias("item")
    one = g.select(item, F.format_string("HEADER 0  - Pocket Score                      : %.4f", "s").alias("value"))
    two = g.select(item, F.format_string("HEADER 6  - Number of alpha spheres           : %d", "n").alias("value"))
    return pockets.header_stats(one.unionByName(two).unionByName(g.select(item, F.lit("HEADER Information").alias("value"))))


@query(
    "s12_concavity",
    """WITH g AS (SELECT grp % 2 AS item, grp, round(arg_min(score * 10, id), 2) AS score, round(avg(round(x, 3)), 4) AS x, round(avg(round(y, 3)), 4) AS y, round(avg(round(z, 3)), 4) AS z, 8 * count(*) AS volume FROM pts GROUP BY 1, 2)
SELECT 's' || item AS item, 'pocket' || row_number() OVER w AS name, row_number() OVER w AS rank, x, y, z, volume FROM g WINDOW w AS (PARTITION BY item ORDER BY score DESC, grp)""",
    "pts",
)
def s12(spark, d):
    p = pts(spark, d).withColumn("item", F.concat(F.lit("s"), F.col("grp") % 2))
    value = F.format_string("HETATM%5d  CA  GRD A%4d    %8.3f%8.3f%8.3f  1.00%6.2f           C", F.col("id"), F.col("grp"), "x", "y", "z", F.col("score") * 10)
    return _placed(pockets.loader("concavity")(p.select("item", value.alias("value"))), "volume")


_FILE_RANK = "SELECT 's' || grp AS item, 'pocket' || row_number() OVER w AS name, row_number() OVER w AS rank, {} FROM pts WINDOW w AS (PARTITION BY grp ORDER BY id)"


def _in_files(spark, d, value):
    return pts(spark, d).select(F.concat(F.lit("s"), "grp").alias("item"), F.col("id").alias("line_no"), value.alias("value"))


@query("s13_sitehound", _FILE_RANK.format("round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(score, 2) AS score, CAST(id % 90 AS DOUBLE) AS volume"), "pts")
def s13(spark, d):
    value = F.format_string("%d %.2f %d %.3f %.3f %.3f", F.col("id"), -F.col("score"), F.col("id") % 90, "x", "y", "z")
    return _placed(pockets.loader("sitehound")(_in_files(spark, d, value)), r6("score", 2).alias("score"), "volume")


@query("s14_lise", _FILE_RANK.format("round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(score, 2) AS score"), "pts")
def s14(spark, d):
    value = F.format_string("HETATM%5d  H   GRD A%4d    %8.3f%8.3f%8.3f  1.00  0.00    %.2f", F.col("id"), F.col("id") % 1000, "x", "y", "z", "score")
    return _placed(pockets.loader("lise")(_in_files(spark, d, value)), r6("score", 2).alias("score"))


def _centers(mark: str):
    return F.format_string(f"HETATM%5d  {mark}%4d    %8.3f%8.3f%8.3f%6.2f  0.00", F.col("id"), F.col("id") % 1000, "x", "y", "z", "score")


@query("s15_deepsite", _FILE_RANK.format("round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(score, 2) AS score"), "pts")
def s15(spark, d):
    value = F.format_string("HETATM%5d XXX  HOH X%4d    %8.3f%8.3f%8.3f%6.2f  0.00", F.col("id"), F.col("id") % 1000, "x", "y", "z", "score")
    return _placed(pockets.loader("deepsite")(_in_files(spark, d, value)), r6("score", 2).alias("score"))


@query("s16_metapocket", _FILE_RANK.format("round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(score, 2) AS score"), "pts")
def s16(spark, d):
    value = F.format_string("ATOM  %5d  MPT PKT M%4d    %8.3f%8.3f%8.3f%6.2f  0.00", F.col("id"), F.col("id") % 1000, "x", "y", "z", "score")
    return _placed(pockets.loader("metapocket2")(_in_files(spark, d, value)), r6("score", 2).alias("score"))


@query("s17_own_predictions", "SELECT 'pocket' || id AS name, id + 1 AS rank, round(score, 2) AS score, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM pts", "pts")
def s17(spark, d):
    from pyspark.sql.functions import array, lit

    none = array().cast("array<int>")
    rows = pts(spark, d).select(
        lit("a").alias("item"), F.concat(F.lit("pocket"), "id").alias("name"), (F.col("id") + 1).alias("rank"), "score", lit(0.5).alias("probability"), lit(3).alias("sas_points"),
        none.alias("surf_atom_ids"), array().cast("array<string>").alias("residue_ids"), *(F.col(c).alias(f"center_{c}") for c in "xyz"), *"xyz",
    )
    x = pockets.own_predictions(spark, _file(spark, sinks.predictions(rows).drop("item"), "csv", header=True))
    return x.select("name", F.col("rank").cast("long").alias("rank"), r6("score", 2).alias("score"), *(r6(c, 4).alias(c) for c in "xyz"))


@query(
    "s18_puresnet",
    """SELECT 's' || grp % 2 AS item, 'pocket' || row_number() OVER (PARTITION BY grp % 2 ORDER BY grp) AS name, row_number() OVER (PARTITION BY grp % 2 ORDER BY grp) AS rank, round(avg(round(x, 3)), 4) AS x, round(avg(round(y, 3)), 4) AS y, round(avg(round(z, 3)), 4) AS z, CAST(count(*) AS DOUBLE) AS score
FROM pts GROUP BY grp""",
    "pts",
)
def s18(spark, d):
    value = F.format_string("ATOM  %5d  CA  PKT A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", F.col("id"), F.col("id") % 1000, "x", "y", "z")
    rows = pts(spark, d).select(F.format_string("out/s%d/%02d_pkt.pdb", F.col("grp") % 2, "grp").alias("item"), value.alias("value"))
    return _placed(pockets.loader("puresnet")(rows.unionByName(rows.limit(5).withColumn("item", F.lit("out/s0/without_clus_pkt.pdb")))), "score")


@query("s20_conservation", "SELECT 's' || grp AS item, CAST(id AS INT) AS pos, greatest(round(score - 0.5, 2), 0) AS score, chr(CAST(65 + id % 20 AS INT)) AS letter FROM pts WHERE id % 13 <> 0", "pts")
def s20(spark, d):
    letter = F.when(F.col("id") % 13 == 0, "-").otherwise(F.char(65 + F.col("id") % 20))
    lines = _in_files(spark, d, F.concat_ws("\t", "id", F.format_string("%.2f", F.col("score") - 0.5), letter))
    return tables.conservation(lines.unionByName(lines.limit(1).withColumn("value", F.lit("# index score letter")))).withColumn("score", r6("score", 2))


@query(
    "s21_conservation_files",
    "SELECT c_custkey AS item, CASE WHEN c_custkey % 3 = 0 THEN 'd/p' || c_custkey || '_A.hom.gz' WHEN c_custkey % 3 = 1 THEN 'd/p' || c_custkey || 'A.hom' END AS path FROM customer",
)
def s21(spark, d):
    c = table(spark, d, "customer")
    base = F.concat(F.lit("p"), "c_custkey")
    chains = c.select(F.col("c_custkey").alias("item"), base.alias("base"), F.lit("A").alias("chain_id"))
    k = F.col("c_custkey") % 3
    files = c.where(k == 0).select(F.concat(F.lit("d/"), base, F.lit("_A.hom.gz")).alias("path"))
    files = files.unionByName(c.where(k < 2).select(F.concat(F.lit("d/"), base, F.lit("A.hom")).alias("path"))).unionByName(c.where(k == 2).select(F.concat(F.lit("d/"), base, F.lit("A.txt")).alias("path")))
    return tables.conservation_files(chains, files).select("item", "path")


@query("s22_csv_features", f"WITH {_ATM} SELECT serial, CASE WHEN serial % 4 = 0 THEN -1.0 ELSE round(serial / 8.0, 3) END AS v FROM atm", "pts")
def s22(spark, d):
    a = _atoms(spark, d)
    path = _file(spark, a.where("serial % 4 <> 0").select(F.col("serial").alias("pdb serial"), r6(F.col("serial") / 8.0, 3).alias("v"), F.lit("x").alias("#note")), "csv", header=True)
    kind, t = tables.csv_features(spark, path)
    return X.csv_feature("csv", kind, ("v",)).compute(rows=a, table=t, missing=-1.0).select(F.col("id").cast("int").alias("serial"), "v")


@query("s23_property_table", "SELECT p_brand || p_partkey AS key, p_retailprice AS price, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS size FROM part")
def s23_file(spark, d):
    p = table(spark, d, "part")
    size = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("n/a")
    rows = p.select(F.concat("p_brand", "p_partkey").alias("atomName"), F.col("p_retailprice").alias("price"), size.alias("size"))
    return tables.property_table(spark, _file(spark, rows, "csv", header=True))


@query(
    "s24_index_records",
    f"""SELECT 'I' || s_suppkey AS id, s_name AS description, substr('{tables.INDEX_ORDER}', CAST(k AS INT) + 1, 1) AS letter, CASE WHEN (s_suppkey + k) % 7 = 0 THEN NULL ELSE (s_suppkey + k) / 4.0 END AS value
FROM supplier, range(20) r(k)""",
)
def s24(spark, d):
    s = table(spark, d, "supplier")
    number = lambda k: F.when((F.col("s_suppkey") + k) % 7 == 0, "NA").otherwise(F.format_string("%.2f", (F.col("s_suppkey") + k) / 4.0))
    rows = [F.concat_ws(" ", *(number(k) for k in ks)) for ks in (range(10), range(10, 20))]
    text = F.concat(F.lit("H I"), "s_suppkey", F.lit("\nD "), "s_name", F.lit("\nI    A/L     R/K\n  "), rows[0], F.lit("\n  "), rows[1])
    return tables.aa_index(spark, _file(spark, s.select(text.alias("value")), lineSep="\n//\n")).select("id", "description", "letter", "value")


@query(
    "s25_cube",
    """WITH n AS (SELECT count(*) // 20 AS nz FROM pts), v AS (SELECT row_number() OVER (ORDER BY id) - 1 AS p, round(score, 2) AS value FROM pts)
SELECT p // (5 * nz) AS ix, p // nz % 5 AS iy, p % nz AS iz, 1.5::DOUBLE + p // (5 * nz) * 0.5::DOUBLE AS x, -2.0::DOUBLE + p // nz % 5 * 0.5::DOUBLE AS y, p % nz * 0.5::DOUBLE AS z, value FROM v, n WHERE p < 20 * nz""",
    "pts",
)
def s25(spark, d):
    # the points' scores as a grid of four by five by as many as there are
    p = pts(spark, d)
    nz = p.count() // 20
    head = ["title", "comment", "0 1.5 -2.0 0.0", "4 0.5 0 0", "5 0 0.5 0", f"{nz} 0 0 0.5", "0"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "score"))), lambda s: F.format_string("%.2f", s["score"])), " ")
    path = _file(spark, p.agg(F.concat(F.lit("\n".join(head) + "\n"), text).alias("value")))
    # the folder's one text file
    x = tables.cube(spark, path)
    return x.select(*(F.col(f"i{c}").cast("long").alias(f"i{c}") for c in "xyz"), *"xyz", r6(F.col("value").cast("double"), 2).alias("value"))


@query("s27_residue_scores", "SELECT 's' || grp AS item, 'A' AS chain_id, CAST(id AS INT) AS seq_num, CASE WHEN id % 5 = 0 THEN 0.0 ELSE round(score, 2) END AS score, id % 5 <> 0 AND round(score, 2) >= 0.5 AS label FROM pts", "pts")
def s27(spark, d):
    score = F.when(F.col("id") % 5 == 0, "").otherwise(F.format_string("%.2f", "score"))
    lines = _in_files(spark, d, F.concat_ws(" ", F.lit("A"), "id", F.lit("GLY"), score))
    heads = lines.select("item").distinct().select("item", F.lit(-1).cast("long").alias("line_no"), F.lit("chain number residue score").alias("value"))
    return tables.residue_scores(lines.unionByName(heads)).withColumn("score", r6("score", 2))


@query("s28_positive_residues", f"WITH {_ATM} SELECT item, serial, serial % 10 IN (3, 4) AND grp <> 1 AS label FROM atm", "pts")
def s28(spark, d):
    a = _atoms(spark, d).select("item", "grp", "serial", "chain_id", F.col("serial").alias("seq_num"), "ins_code")
    key = F.concat("chain_id", F.lit("_"), F.col("seq_num").cast("string"))
    keys = a.where("serial % 10 IN (3, 4) AND grp <> 1").groupBy("item").agg(F.collect_list(key).alias("positive_residues"))
    return tables.positive_residues(a, keys).select("item", "serial", "label")


@query("s29_ter_groups", f"WITH {_ATM} SELECT item, sum(CAST(serial % 9 = 0 AS INT)) OVER (PARTITION BY item ORDER BY serial) AS ligand, serial FROM atm", "pts")
def s29(spark, d):
    a = _atoms(spark, d)
    lines = a.select("item", (F.col("serial").cast("long") * 2 + 1).alias("line_no"), F.format_string("HETATM%5d  C   LIG A   1", "serial").alias("value"))
    ends = a.where("serial % 9 = 0").select("item", (F.col("serial").cast("long") * 2).alias("line_no"), F.lit("TER").alias("value"))
    return tables.ter_groups(lines.unionByName(ends)).select("item", "ligand", "serial")


@query("s31_transformer_text", "SELECT id, round((score - 0.25) / 0.5, 6) AS zscore FROM pts", "pts")
def s31(spark, d):
    name, p = R.from_json(R.to_json("ZscoreTpTransformer", {"mean": 0.25, "stdev": 0.5}))
    return R.zscore(pts(spark, d), "score", p["mean"], p["stdev"]).select("id", r6("zscore").alias("zscore"))


@query("y29_error_isolation", "SELECT 's' || grp || '.pdb.gz' AS path FROM pts WHERE grp % 2 = 1 GROUP BY grp", "pts")
def y29(spark, d):
    def damaged(batches):
        import gzip

        for pdf in batches:
            pdf["path"] = pdf["item"] + ".pdb.gz"
            pdf["content"] = [b"\x1f\x8bno gzip" if int(i[1:]) % 2 else gzip.compress(t.encode()) for i, t in zip(pdf["item"], pdf["text"], strict=True)]
            yield pdf[["path", "content"]]

    return structures.errors(_whole(_lines(spark, d)).mapInPandas(damaged, "path string, content binary")).select("path")


_EL = "substr(name, 1, 1)"
_DON = " OR ".join(f"(res_name = '{r}' AND name IN ({', '.join(repr(a) for a in n.split())}))" for r, n in X.DONORS.items())
_ACC = " OR ".join(f"(res_name = '{r}' AND name IN ({', '.join(repr(a) for a in n.split())}))" for r, n in X.ACCEPTORS.items())


@query(
    "f1_chem",
    f"WITH {_ATM} SELECT id, CASE res_name WHEN 'HIS' THEN 0.5 WHEN 'ASP' THEN 2.0 ELSE 0.0 END::DOUBLE AS hydrophobic, 1.0::DOUBLE AS atomDensity, ({_EL} = 'C')::DOUBLE AS atomC, ({_EL} = 'O')::DOUBLE AS atomO, ({_EL} = 'N')::DOUBLE AS atomN, ({_DON})::DOUBLE AS hDonorAtoms, ({_ACC})::DOUBLE AS hAcceptorAtoms FROM atm",
    "pts",
)
def f1(spark, d):
    t = spark.createDataFrame([("HIS", 0.5, *[1.0] * 17), ("ASP", 2.0, *[1.0] * 17)], "key string, " + ", ".join(f"{c} double" for c in X.CHEM_RESIDUE))
    return X.feature("chem").compute(atoms=_atoms(spark, d), table=t).select("id", "hydrophobic", *X.CHEM_ATOM)


@query("f2_volsite", f"WITH {_ATM} SELECT id, (res_name = 'HIS' AND name = 'ND2')::DOUBLE AS vsAromatic, (res_name = 'ASP' AND name = 'OD1')::DOUBLE AS vsAnion, 0.0::DOUBLE AS vsCation FROM atm", "pts")
def f2(spark, d):
    t = spark.createDataFrame([("HIS.ND2", 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), ("ASP.OD1", 0.0, 0.0, 1.0, 0.0, 1.0, 0.0)], "key string, " + ", ".join(f"{c} double" for c in X.VOLSITE))
    return X.feature("volsite").compute(atoms=_atoms(spark, d), table=t).select("id", "vsAromatic", "vsAnion", "vsCation")


@query("f3_bfactor", f"WITH {_ATM} SELECT id, bfactor FROM atm", "pts")
def f3(spark, d):
    return X.feature("bfactor").compute(atoms=_atoms(spark, d)).select("id", r6("bfactor", 2).alias("bfactor"))


@query("f6_index_feature", f"WITH {_ATM} SELECT id, CASE res_name WHEN 'ALA' THEN 1.5 WHEN 'HIS' THEN -0.25 ELSE 0.0 END::DOUBLE AS charge FROM atm", "pts")
def f6(spark, d):
    t = spark.createDataFrame([("ALA", 1.5), ("HIS", -0.25)], "key string, charge double")
    return X.index_feature("aa.charge", ("charge",)).compute(rows=_atoms(spark, d), table=t)


_PD = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


@query(
    "f13_pair_histogram",
    f"""WITH q AS (SELECT * FROM pts WHERE lig), near AS (SELECT q.id, a.id AS atom, a.x, a.y, a.z FROM q JOIN pts a ON (a.x-q.x)*(a.x-q.x)+(a.y-q.y)*(a.y-q.y)+(a.z-q.z)*(a.z-q.z) <= 25),
pair AS (SELECT a.id, {_PD} AS dist FROM near a JOIN near b ON a.id = b.id AND a.atom <= b.atom),
bin AS (SELECT id, CASE WHEN dist <= 0 THEN 0 WHEN dist >= 10 THEN 4 ELSE floor(dist / 2) END AS b FROM pair)
SELECT q.id, {", ".join(f"count(*) FILTER (b = {i})::DOUBLE AS b{i}" for i in range(5))} FROM q LEFT JOIN bin USING (id) GROUP BY q.id""",
    "pts",
)
def f13(spark, d):
    p = pts(spark, d)
    return X.feature("pair_hist").compute(points=p.where("lig"), exposed=p, radius=5.0, smooth=False)


@query("p14_feature_filter", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' OR (p_brand LIKE 'Brand#2%' AND p_brand <> 'Brand#21') OR (p_brand LIKE 'Brand#5%' AND p_brand NOT IN ('Brand#51', 'Brand#53'))")
def p14(spark, d):
    kept = X.is_filtered(F.col("p_brand"), ["Brand#1*", "-Brand#1*", "Brand#13", "Brand#2*", "-Brand#21", "Brand#5*", "-Brand#51", "-Brand#53"])
    return table(spark, d, "part").where(kept).select("p_partkey")


@query(
    "k4_pocket_rows",
    "SELECT 's' || grp AS file, CAST(count(*) FILTER (lig) OVER (PARTITION BY grp) AS VARCHAR) AS ligands, CAST(count(*) FILTER (NOT lig) OVER (PARTITION BY grp) AS VARCHAR) AS pockets, 'p' || id AS pocket, printf('%.4f', score) AS old_score, CAST(id AS VARCHAR) AS rank FROM pts QUALIFY NOT lig",
    "pts",
)
def k4(spark, d):
    p = pts(spark, d).withColumn("item", F.concat(F.lit("s"), "grp"))
    pk = p.where("not lig").select(
        "item", F.concat(F.lit("p"), "id").alias("name"), F.lit(None).cast("string").alias("ligand"), F.col("id").alias("rank"), "score", F.col("id").alias("new_rank"), F.col("score").alias("old_score"),
        F.lit(0.0).alias("zscore"), F.lit(0.0).alias("probability"), F.lit(1).alias("sas_points"), "score", F.lit(2).alias("volume"), F.lit(3).alias("surf_atoms"),
    )
    pk = pk.toDF(*["item", "name", "ligand", "rank", "score", "new_rank", "old_score", "zscore", "probability", "sas_points", "raw_score", "volume", "surf_atoms"])
    got = reports.pocket_rows(pk, p.where("lig"))
    return got.select("file", F.col("#ligands").alias("ligands"), F.col("#pockets").alias("pockets"), "pocket", F.col("oldScore").alias("old_score"), "rank")


@query(
    "k5_run_table",
    "SELECT CAST(grp AS VARCHAR) AS feature, printf('%.4f', avg(v)) AS mean, printf('%.4f', stddev_samp(v)) AS stddev, printf('%.4f', max(v) FILTER (run = 2)) AS run_2 FROM (SELECT grp, id % 3 AS run, max(score) AS v FROM pts GROUP BY 1, 2) GROUP BY grp",
    "pts",
)
def k5(spark, d):
    v = pts(spark, d).groupBy(F.col("grp").cast("string").alias("name"), (F.col("id") % 3).alias("run")).agg(F.max("score").alias("value"))
    t = reports.run_table(v, [0, 1, 2])
    return t.select(F.col("FEATURE").alias("feature"), F.col("MEAN").alias("mean"), F.col("STDDEV").alias("stddev"), "run_2")


@query("k9_arff_lines", "SELECT printf('%.3f', x) || ',' || printf('%.3f', y) || ',' || CAST(lig AS INT) AS value FROM pts", "pts")
def k9(spark, d):
    p = pts(spark, d).select(F.format_string("%.3f", "x").alias("x"), F.format_string("%.3f", "y").alias("y"), "lig")
    return reports.arff_lines(p, ["x", "y"], "lig")[1]


@query("k10_scored_points", "SELECT id, 'HETATM' || printf('%5d', id) || ' H   STP C' || printf('%4d', grp) || '    ' || printf('%8.3f%8.3f%8.3f', x, y, z) || '  0.50' || printf('%6.3f', score) || '           H' AS value FROM pts", "pts")
def k10(spark, d):
    p = pts(spark, d).select(F.lit("a").alias("item"), "id", F.col("grp").alias("pocket"), "x", "y", "z", "score")
    return sinks.scored_points(p).select("id", "value")


@query("k14_pocket_dump", "SELECT 's' || grp AS item, CAST(id AS INT) AS rank, score, 'p' || id AS name, x, y, z FROM pts", "pts")
def k14(spark, d):
    p = pts(spark, d).select(F.concat(F.lit("s"), "grp").alias("item"), F.col("id").cast("int").alias("rank"), "score", F.concat(F.lit("p"), "id").alias("name"), "x", "y", "z")
    return reports.pocket_dump(p)


_RGB = "printf('%02x', CAST(floor((v - v * 0.6 * greatest(0, least(({0} + h * 6) % 6, 4 - ({0} + h * 6) % 6, 1))) * 255 + 0.5) AS INT))"


@query(
    "x8_spectrum",
    f"SELECT id, '#' || {' || '.join(_RGB.format(n) for n in (5, 3, 1))} AS colour FROM (SELECT id, (0.6::DOUBLE + 0.6::DOUBLE * i / n) % 1 AS h, CASE WHEN i % 2 = 0 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS v FROM (SELECT id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM pts WINDOW w AS (PARTITION BY grp ORDER BY id)))",
    "pts",
)
def x8(spark, d):
    ranked = W.ordered(pts(spark, d), ["grp"], ["id"])
    size = ranked.groupBy("grp").agg(F.count("*").alias("size"))
    return ranked.join(size, "grp").select("id", reports.spectrum_colour(F.col("n") - 1, F.col("size")).alias("colour"))


@query("k6_histogram_lines", "SELECT r.range / 10.0::DOUBLE AS \"from\", count(s) AS n FROM range(10) r LEFT JOIN pred ON r.range = CASE WHEN s <= 0 THEN 0 WHEN s >= 1 THEN 9 ELSE least(floor(s / 0.1::DOUBLE), 9) END GROUP BY 1", "pred")
def k6(spark, d):
    h = A.histogram(pred(spark, d), "s", 0.0, 1.0, 10)
    return reports.histogram_lines(h, 0.0, 1.0, 10)


@query("x10_dates", "SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month, CAST(year(o_orderdate) AS INT) AS y, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days, CAST(CAST(o_orderdate + INTERVAL 36 HOUR AS DATE) AS VARCHAR) AS later FROM orders")
def x10(spark, d):
    o = F.col("o_orderdate")
    later = F.to_date(o + F.make_interval(hours=F.lit(36)))
    return table(spark, d, "orders").select("o_orderkey", F.trunc(o, "month").cast("string").alias("month"), F.year(o).alias("y"), F.datediff(o, F.lit("1995-01-01").cast("date")).alias("days"), later.cast("string").alias("later"))


@query("y28_event_rates", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def y28(spark, d):
    x = folder.event_rates(table(spark, d, "events"))
    return x.select(F.unix_timestamp("window.start").alias("hour"), "event_type", "n", r6("mean").alias("mean"))


@query(
    "y28_sessions",
    """WITH t AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM t)
SELECT user_id, epoch_us(min(ts)) AS begin, epoch_us(max(ts)) + 1800000000 AS "end", count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, k""",
)
def y28_sessions(spark, d):
    x = folder.sessions(table(spark, d, "events"))
    return x.select("user_id", F.unix_micros("begin").alias("begin"), F.unix_micros("end").alias("end"), "n", r6("total", 4).alias("total"))
