"""Readers of other tools' pocket predictions, as rows (item, name, rank, score, x, y, z).

Every reader takes text lines (item, value, line_no) so that a file per item, or many,
are read in one scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions.strings import words
from orrery.operators.spatial import radius_join
from orrery.sources.structures import aligned, pdb_atoms


def read_lines(spark: SparkSession, path: str, parts: int = 1) -> DataFrame:
    """(item, line_no, value) of text files; the item is the file's name, or the last ``parts`` of its path."""
    item = F.substring_index(F.col("_metadata.file_path"), "/", -parts)
    return spark.read.text(path).select(item.alias("item"), F.monotonically_increasing_id().alias("line_no"), "value")


def _numbered(df: DataFrame, order: list) -> DataFrame:
    w = Window.partitionBy("item").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("name", F.concat(F.lit("pocket"), F.col("rank")))


_OUT = ["item", "name", "rank", "score", "x", "y", "z"]


def sitehound(lines: DataFrame, limit: int = 0) -> DataFrame:
    """Columns rank, energy, volume, x, y, z; the score is the negated energy."""
    w = lines.withColumn("w", words(F.col("value"))).where(F.size("w") >= 6)
    num = lambda i: F.col("w")[i].try_cast("double")
    rows = w.select("item", "line_no", (-num(1)).alias("score"), num(2).alias("volume"), num(3).alias("x"), num(4).alias("y"), num(5).alias("z")).where("x is not null and score is not null")
    out = _numbered(rows, ["line_no"])
    return (out.where(F.col("rank") <= limit) if limit else out).select(*_OUT, "volume")


def lise(lines: DataFrame) -> DataFrame:
    """HETATM lines whose last word is the score."""
    v = aligned(F.col("value"))
    num = lambda s, n: F.trim(F.substring(v, s, n)).try_cast("double")
    rows = lines.where(F.col("value").startswith("HETATM")).select("item", "line_no", F.element_at(words(F.col("value")), -1).try_cast("double").alias("score"), num(31, 8).alias("x"), num(39, 8).alias("y"), num(47, 8).alias("z"))
    return _numbered(rows, ["line_no"]).select(*_OUT)


def deepsite(lines: DataFrame) -> DataFrame:
    """Lines with `HOH X` and `XXX`: centers with the score as occupancy, ranked in file order, returned by score."""
    v = aligned(F.col("value"))
    num = lambda s, n: F.trim(F.substring(v, s, n)).try_cast("double")
    rows = lines.where(v.contains("HOH X") & v.contains("XXX")).select("item", "line_no", num(55, 6).alias("score"), num(31, 8).alias("x"), num(39, 8).alias("y"), num(47, 8).alias("z"))
    return _numbered(rows, ["line_no"]).select(*_OUT).orderBy("item", F.desc("score"), "rank")


def metapocket(lines: DataFrame) -> DataFrame:
    """Lines with `MPT`: centers with the score as occupancy."""
    v = aligned(F.col("value"))
    num = lambda s, n: F.trim(F.substring(v, s, n)).try_cast("double")
    rows = lines.where(v.contains("MPT")).select("item", "line_no", num(55, 6).alias("score"), num(31, 8).alias("x"), num(39, 8).alias("y"), num(47, 8).alias("z"))
    return _numbered(rows, ["line_no"]).select(*_OUT)


def concavity(lines: DataFrame) -> DataFrame:
    """Hetero groups are pockets: score of the first atom's temperature factor, volume 8 per point, by descending score."""
    a = pdb_atoms(lines.where(F.col("value").startswith("HETATM")).withColumn("model", F.lit(0)).select("item", "model", "value"))
    g = a.groupBy("item", "chain_id", "seq_num", "res_name").agg(F.min_by("bfactor", "serial").cast("double").alias("score"), *(F.avg(c).alias(c) for c in "xyz"), (8 * F.count("*")).alias("volume"))
    return _numbered(g, [F.desc("score"), "chain_id", "seq_num"]).select(*_OUT, "volume")


def fpocket_vertices(atoms: DataFrame) -> DataFrame:
    """(item, rank, x, y, z): the vertices of pockets among the atoms of a result file, PDB or mmCIF; the
    residue number of an `STP` hetero atom is its pocket's."""
    return atoms.where(F.col("is_het") & (F.col("res_name") == "STP")).select("item", F.col("seq_num").alias("rank"), "x", "y", "z")


def fpocket_pockets(vertices: DataFrame) -> DataFrame:
    """One row per pocket, at the mean of its vertices. Numbers must run from 1 without gaps within an item."""
    g = vertices.groupBy("item", "rank").agg(*(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("vertices"))
    n = F.count("*").over(Window.partitionBy("item"))
    top = F.max("rank").over(Window.partitionBy("item"))
    ok = F.assert_true(n == top, F.lit("pocket numbers have gaps"))
    return g.withColumn("_n", ok.isNull()).where("_n").select("item", F.concat(F.lit("pocket"), F.col("rank")).alias("name"), "rank", F.lit(None).cast("double").alias("score"), "x", "y", "z", "vertices")


def fpocket(lines: DataFrame) -> DataFrame:
    """The pockets of result files given as lines. Letters among their serial numbers do no harm."""
    stp = lines.withColumn("value", aligned(F.col("value"))).where(F.col("value").startswith("HETATM") & (F.substring("value", 18, 3) == "STP"))
    return fpocket_pockets(fpocket_vertices(pdb_atoms(stp.withColumn("model", F.lit(0)).select("item", "model", "value"))))


#: A pocket's file below the folder of its structure.
_POCKET_FILE = r"([^/]*)_out/pockets/pocket(\d+)_atm\.(?:pdb|cif)(?:\.gz)?$"


def _stem(item: Column) -> Column:
    """The structure's name of a path to it or to its result."""
    return F.regexp_extract(item, r"([^/]*?)(?:_out)?(?:\.(?:pdb|ent|cif|bcif)(?:\.(?:gz|zst|zstd|lzma|xz))?)?$", 1)


def fpocket_atoms(atoms: DataFrame, pocket_atoms: DataFrame) -> DataFrame:
    """(item, rank, serial): the structure's own atoms that the files of its pockets name, by serial.

    Both have item, serial and is_het, as the structure readers give them. Items of pocket_atoms are paths
    `<structure>_out/pockets/pocket<number>_atm.<pdb or cif>`. Numbers begin at 1, or in older
    results at 0; unknown serials are skipped.
    """
    number = F.regexp_extract("item", _POCKET_FILE, 2).try_cast("int")
    mine = pocket_atoms.where(~F.col("is_het")).select(F.regexp_extract("item", _POCKET_FILE, 1).alias("_of"), number.alias("_n"), "serial").where("_n is not null")
    first = mine.groupBy("_of").agg(F.min("_n").alias("_first"))
    ranked = mine.join(first, "_of").select("_of", F.when(F.col("_first") == 0, F.col("_n") + 1).otherwise(F.col("_n")).alias("rank"), "serial")
    have = atoms.where(~F.col("is_het")).select("item", _stem(F.col("item")).alias("_of"), "serial")
    return have.join(ranked, ["_of", "serial"]).select("item", "rank", "serial").distinct()


def with_structure(pockets: DataFrame, atoms: DataFrame) -> DataFrame:
    """Pockets whose item is a result file, with the item of the structure that the result is of."""
    of = atoms.select(F.col("item").alias("_item")).distinct().withColumn("_of", _stem(F.col("_item")))
    return pockets.withColumn("_of", _stem(F.col("item"))).join(of, "_of").withColumn("item", F.col("_item")).drop("_of", "_item")


def fpocket_points(surface: DataFrame, atoms: DataFrame, vertices: DataFrame, of_atoms: float, of_vertices: float) -> DataFrame:
    """(item, rank, id): a pocket's surface points: those near one of its atoms, and those near a vertex.

    surface: item, id, x, y, z. atoms and vertices: item, rank, x, y, z. of_atoms, of_vertices: how near.
    """
    near = lambda to, r: radius_join(surface.select("item", "id", "x", "y", "z"), to.select("item", "rank", "x", "y", "z"), r, "item").select("item", F.col("rank_r").alias("rank"), "id")
    return near(atoms, of_atoms).unionByName(near(vertices, of_vertices)).distinct()


def growing_surface(grid: DataFrame, exposed: DataFrame, first: int = 4, last: int = 9) -> DataFrame:
    """(item, rank, id): the exposed atoms around a pocket's grid points, within the least whole radius
    from ``first`` to ``last`` that reaches any.

    One join at the largest radius: the nearest atom's distance tells the radius.
    """
    near = radius_join(exposed.select("item", "id", "x", "y", "z"), grid.select("item", "rank", "x", "y", "z"), last, "item")
    best = near.groupBy("item", F.col("rank_r").alias("rank"), "id").agg(F.min("d2").alias("d2"))
    radius = best.groupBy("item", "rank").agg(F.greatest(F.ceil(F.sqrt(F.min("d2"))), F.lit(first)).alias("_r"))
    return best.join(radius, ["item", "rank"]).where(F.col("d2") <= F.col("_r") * F.col("_r")).select("item", "rank", "id")


def header_stats(lines: DataFrame) -> DataFrame:
    """(item, label, value) of `HEADER n - label : value` lines; fields are known by their label, as numbers differ by version."""
    pattern = r"^HEADER\s*\d+\s*-\s*(.*?)\s*:\s*([-.\d]+)"
    return lines.where(F.col("value").rlike(pattern)).select("item", F.lower(F.regexp_extract("value", pattern, 1)).alias("label"), F.regexp_extract("value", pattern, 2).try_cast("double").alias("number")).withColumnRenamed("number", "value")


def puresnet(lines: DataFrame) -> DataFrame:
    """A pocket per `*pkt.pdb` file but `without_clus_pkt.pdb`, in order of the file name. Items are paths;
    files of one folder are the prediction named by that folder (without one: `prediction`)."""
    file, folder = F.regexp_extract("item", "([^/]*)$", 1), F.regexp_extract("item", "([^/]+)/[^/]*$", 1)
    mine = lines.where(F.col("item").endswith("pkt.pdb") & (file != "without_clus_pkt.pdb"))
    a = pdb_atoms(mine.withColumn("model", F.lit(0)).select("item", "model", "value"))
    at = F.when(folder == "", "prediction").otherwise(folder).alias("of")
    g = a.groupBy(at, file.alias("file")).agg(*(F.avg(c).alias(c) for c in "xyz"), F.count("*").cast("double").alias("score")).withColumnRenamed("of", "item")
    return _numbered(g, ["file"]).select(*_OUT, "file")


def own_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The predictions file, by column name."""
    t = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    item = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    num = lambda c: F.trim(F.col(c)).try_cast("double")
    return t.select(item.alias("item"), F.trim("name").alias("name"), F.trim("rank").try_cast("int").alias("rank"), num("score").alias("score"), *(num(f"center_{c}").alias(c) for c in "xyz"))


#: Readers by the name of their method.
LOADERS: dict[str, Callable] = {
    "fpocket": fpocket, "concavity": concavity, "sitehound": sitehound, "lise": lise, "deepsite": deepsite, "metapocket2": metapocket, "puresnet": puresnet, "own": own_predictions,
}


def loader(method: str) -> Callable:
    if method not in LOADERS:
        raise ValueError(f"unknown prediction method: {method}")
    return LOADERS[method]
