"""Auxiliary inputs: conservation, property tables, residue labels, potential grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions.strings import words
from orrery.sources.structures import aligned, serial_number

#: The order of amino acids in an index record.
INDEX_ORDER = "ARNDCQEGHILKMFPSTWYV"


def conservation(lines: DataFrame, letter_first: bool = False) -> DataFrame:
    """(item, pos, score, letter) of tab-separated lines; negative scores count as 0, gaps are dropped.

    Columns are index, score, letter, or with ``letter_first`` index, letter, score.
    """
    p = F.split("value", "\t")
    score, letter = (p[2], p[1]) if letter_first else (p[1], p[2])
    rows = lines.where(~F.col("value").startswith("#")).select("item", p[0].try_cast("int").alias("pos"), F.greatest(score.try_cast("double"), F.lit(0.0)).alias("score"), F.trim(letter).alias("letter"))
    return rows.where("pos is not null and letter <> '-'")


def conservation_files(chains: DataFrame, files: DataFrame, extension: str = ".hom") -> DataFrame:
    """chains (item, base, chain_id) with the path of their score file: `base_chain.` goes before `basechain.`; null without."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    f = files.select("path", F.regexp_replace(name, r"\.(gz|zst)$", "").alias("n")).where(F.col("n").endswith(extension)).select("path", F.substring_index("n", ".", 1).alias("stem"))
    f = f.groupBy("stem").agg(F.min("path").alias("path"))
    first = chains.withColumn("stem", F.concat("base", F.lit("_"), "chain_id")).join(f, "stem", "left").withColumnRenamed("path", "p1").drop("stem")
    second = first.withColumn("stem", F.concat("base", "chain_id")).join(f, "stem", "left").withColumnRenamed("path", "p2").drop("stem")
    return second.withColumn("path", F.coalesce("p1", "p2")).drop("p1", "p2")


def aligned_scores(chains: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores for chain positions by longest common subsequence: (item, chain_id, pos, score).

    chains: item, chain_id, seq; scores: item, chain_id, seq, values (one per letter). How
    ties are broken is told by ``alignment.pairs``; positions without a partner have score 0.
    """
    import pandas as pd

    from orrery.functions.alignment import pairs

    def run(batches):
        for pdf in batches:
            rows = []
            for item, chain, a, b, v in zip(pdf["item"], pdf["chain_id"], pdf["seq"], pdf["other"], pdf["values"], strict=True):
                rows += [(item, chain, k + 1, float(v[t]) if t >= 0 else 0.0) for k, t in enumerate(pairs(a, b))]
            yield pd.DataFrame(rows, columns=["item", "chain_id", "pos", "score"])

    both = chains.join(scores.select("item", "chain_id", F.col("seq").alias("other"), "values"), ["item", "chain_id"])
    return both.mapInPandas(run, "item string, chain_id string, pos int, score double")


def property_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A CSV table with `#` comments: key and double columns; what can't be read as a number is null."""
    t = spark.read.option("header", True).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    key = key or t.columns[0]
    return t.select(F.col(f"`{key}`").alias("key"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in t.columns if c != key))


def transposed(table: DataFrame) -> DataFrame:
    """key -> (property, key, value) in long form."""
    cols = [c for c in table.columns if c != "key"]
    return table.unpivot("key", cols, "property", "value")


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """All keys of two property tables; values of the right one go first."""
    l_, r_ = transposed(left), transposed(right)
    both = l_.withColumnRenamed("value", "a").join(r_.withColumnRenamed("value", "b"), ["key", "property"], "full")
    return both.select("key", "property", F.coalesce("b", "a").alias("value"))


def csv_features(spark: SparkSession, path: str, missing: float | None = 0.0) -> tuple[str, DataFrame]:
    """("atom" or "residue", table) by the header: `pdb serial`, or `chain, ins. code, seq. code`.

    Columns that begin with `#` are ignored. ``missing`` replaces absent values; with
    None an absent value is an error when the table is joined by ``with_csv_features``.
    """
    t = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names = {c.strip().lower(): c for c in t.columns if not c.startswith("#")}
    if "pdb serial" in names:
        keys = [F.col(f"`{names['pdb serial']}`").try_cast("int").alias("serial")]
        used, kind = {"pdb serial"}, "atom"
    elif {"chain", "ins. code", "seq. code"} <= set(names):
        ins = F.trim(F.col(f"`{names['ins. code']}`"))
        keys = [F.trim(F.col(f"`{names['chain']}`")).alias("chain_id"), F.when(ins != "", ins).alias("ins_code"), F.col(f"`{names['seq. code']}`").try_cast("int").alias("seq_num")]
        used, kind = {"chain", "ins. code", "seq. code"}, "residue"
    else:
        raise ValueError(f"{path} has the key columns of neither atoms nor residues")
    values = [F.col(f"`{c}`").try_cast("double").alias(n) for n, c in names.items() if n not in used]
    if len({n for n in names}) != len([c for c in t.columns if not c.startswith("#")]):
        raise ValueError(f"{path} names a column twice")
    return kind, t.select(*keys, *values)


def with_csv_features(rows: DataFrame, kind: str, table: DataFrame, missing: float | None = 0.0) -> DataFrame:
    """Rows with the table's values; keys compare null-safely."""
    keys = ["serial"] if kind == "atom" else ["chain_id", "ins_code", "seq_num"]
    values = [c for c in table.columns if c not in keys]
    t = table.select(*(F.col(c).alias(f"_{c}") for c in keys), *values)
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = rows.join(t, cond, "left").drop(*(f"_{c}" for c in keys))
    fill = (lambda c: F.coalesce(F.col(c), F.lit(missing))) if missing is not None else (lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"no value of {c}")).cast("double")))
    return out.withColumns({c: fill(c) for c in values})


def aa_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, letter, value) of index records: H id, D description, I two lines of ten numbers; NA is null."""
    r = spark.read.option("lineSep", "//\n").text(path).where("trim(value) <> ''")
    body = F.regexp_extract("value", r"(?s)(?:^|\n)I [^\n]*\n(.*?)(?=\n[A-Z] |$)", 1)
    rows = r.select(F.regexp_extract("value", r"(?:^|\n)H (\S+)", 1).alias("id"), F.trim(F.regexp_extract("value", r"(?:^|\n)D ([^\n]*)", 1)).alias("description"), F.posexplode(words(body)).alias("k", "v"))
    return rows.where("k < 20").select("id", "description", F.substring(F.lit(INDEX_ORDER), F.col("k") + 1, F.lit(1)).alias("letter"), F.col("v").try_cast("double").alias("value"))


def cube(spark: SparkSession, path: str) -> DataFrame:
    """(ix, iy, iz, x, y, z, value) of a potential grid: seven header lines, then values with z running fastest.

    The header's third line has the origin, the next three the size and step per axis;
    fewer values than nx * ny * nz are an error.
    """
    # only the header comes to the driver
    lines = spark.read.text(path, wholetext=True).select(F.slice(F.split("value", "\n", 8), 1, 7)).first()[0]
    origin = [float(v) for v in lines[2].split()[1:4]]
    size = [int(lines[3 + i].split()[0]) for i in range(3)]
    step = [float(lines[3 + i].split()[1 + i]) for i in range(3)]
    n = size[0] * size[1] * size[2]
    text = spark.read.text(path, wholetext=True)
    flat = text.select(F.posexplode(words(F.regexp_replace("value", r"^(?:[^\n]*\n){7}", ""))).alias("p", "v"))
    if flat.count() < n:
        raise ValueError(f"{path} has fewer than {n} values")
    i = {"x": F.floor(F.col("p") / (size[1] * size[2])), "y": F.floor(F.col("p") / size[2]) % size[1], "z": F.col("p") % size[2]}
    out = flat.where(F.col("p") < n).select(*(v.cast("int").alias(f"i{c}") for c, v in i.items()), F.col("v").cast("float").alias("value"))
    return out.withColumns({c: F.lit(origin[k]) + F.col(f"i{c}") * F.lit(step[k]) for k, c in enumerate("xyz")})


def sprint_labels(lines: DataFrame) -> DataFrame:
    """(code, chain letters by position, label) of triples `>code`, sequence, 0/1 string; lengths must agree."""
    w = Window.partitionBy("item").orderBy("line_no")
    n = lines.where(F.trim("value") != "").withColumn("k", F.row_number().over(w) - 1)
    g = n.groupBy("item", F.floor(F.col("k") / 3).alias("t")).agg(*(F.max(F.when(F.col("k") % 3 == i, F.trim("value"))).alias(c) for i, c in enumerate(("code", "seq", "labels"))))
    ok = F.assert_true(F.length("seq") == F.length("labels"), F.lit("sequence and labels differ in length"))
    g = g.where(ok.isNull()).select(F.regexp_replace("code", "^>", "").alias("code"), "seq", "labels")
    x = g.select("code", "labels", F.posexplode(F.split("seq", "")).alias("i", "letter")).where("letter <> ''")
    return x.select("code", (F.col("i") + 1).alias("pos"), "letter", F.substring("labels", F.col("i") + 1, F.lit(1)).cast("int").alias("label"))


def residue_scores(lines: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(item, chain_id, seq_num, score, label) of lines after a header; the score is the fourth word, a missing one is 0."""
    w = Window.partitionBy("item").orderBy("line_no")
    rows = lines.withColumn("_n", F.row_number().over(w)).where("_n > 1").withColumn("p", words(F.col("value"))).where(F.size("p") >= 2)
    score = F.coalesce(F.get("p", F.lit(3)).try_cast("double"), F.lit(0.0))
    return rows.select("item", F.col("p")[0].alias("chain_id"), F.col("p")[1].try_cast("int").alias("seq_num"), score.alias("score"), (score >= threshold).alias("label"))


def ter_groups(lines: DataFrame) -> DataFrame:
    """HETATM lines numbered by the TER lines before them: atoms up to a TER are one ligand."""
    w = Window.partitionBy("item").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    ter = F.col("value").startswith("TER").cast("int")
    x = lines.withColumn("ligand", F.coalesce(F.sum(ter).over(w), F.lit(0)))
    return x.where(F.col("value").startswith("HETATM")).select("item", "ligand", serial_number(F.substring(aligned(F.col("value")), 7, 5)).alias("serial"))


def positive_residues(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """label: whether an item's list of residue keys holds the residue. keys: item, positive_residues (array)."""
    key = F.concat("chain_id", F.lit("_"), F.col("seq_num").cast("string"), F.coalesce("ins_code", F.lit("")))
    x = rows.join(keys, "item", "left")
    return x.withColumn("label", F.coalesce(F.array_contains("positive_residues", key), F.lit(False))).drop("positive_residues")
