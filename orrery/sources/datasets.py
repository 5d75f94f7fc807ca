"""Dataset files: rows of structures with a declared header, parameters and comments."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.strings import split_outside_brackets, words

#: The columns a header may name.
COLUMNS = ("protein", "chains", "prediction", "ligands", "ligand_codes", "conservation_files_pattern", "apo_protein", "apo_chains", "positive_residues")


@dataclass(frozen=True)
class Dataset:
    """items: one row per structure in file order (columns of the header, and item); params: PARAM.* values."""

    name: str
    items: DataFrame
    header: list[str]
    params: dict[str, str] = field(default_factory=dict)


def read_dataset(spark: SparkSession, path: str) -> Dataset:
    """Parse a dataset file. `#` begins a comment; an empty dataset or an unknown column is an error.

    The control lines are few and decide the schema, so they are read on the driver.
    """
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    lines = lines.select("line_no", F.trim(F.regexp_replace("value", "#.*", "")).alias("line")).where("line <> ''")
    control = lines.where(F.col("line").rlike(r"^(PARAM\.|HEADER:)")).orderBy("line_no").collect()
    params, header = {}, ["protein"]
    for r in control:
        if r["line"].startswith("HEADER:"):
            header = r["line"].removeprefix("HEADER:").split()
        else:
            k, _, v = r["line"].removeprefix("PARAM.").partition("=")
            params[k.strip()] = v.strip()
    if unknown := [c for c in header if c not in COLUMNS]:
        raise ValueError(f"unknown columns in {path}: {unknown}")
    rows = lines.where(~F.col("line").rlike(r"^(PARAM\.|HEADER:)")).withColumn("w", words(F.col("line")))
    items = rows.select("line_no", *(F.element_at("w", i + 1).alias(c) if i == 0 else F.get("w", F.lit(i)).alias(c) for i, c in enumerate(header)))
    main = "protein" if "protein" in header else header[0]
    items = items.withColumn("item", F.regexp_extract(main, r"([^/]*)$", 1))
    for c in ("chains", "apo_chains"):
        if c in header:
            items = items.withColumn(c, F.when(F.col(c) != "*", F.split(c, ",")))
    if "ligands" in header:
        items = items.withColumn("ligands", split_outside_brackets(F.col("ligands")))
    if "conservation_files_pattern" in header:
        bad = items.where(~F.col("conservation_files_pattern").contains("%chainID%")).limit(1).collect()
        if bad:
            raise ValueError("a conservation pattern must contain %chainID%")
    if items.isEmpty():
        raise ValueError(f"the dataset {path} is empty")
    return Dataset(posixpath.basename(path), items, header, params)


def single(spark: SparkSession, path: str) -> Dataset:
    """A dataset of one structure file."""
    return Dataset(posixpath.basename(path), of_paths(spark.createDataFrame([(0, path)], "line_no long, protein string")), ["protein"])


def of_paths(paths: DataFrame) -> DataFrame:
    """Items of structure files by their paths (protein): an item is named by the last part of its path."""
    return paths.withColumn("item", F.substring_index("protein", "/", -1))


def joined(spark: SparkSession, paths: str) -> Dataset:
    """`a.ds+b.ds`: the items of all, with the header and parameters of the first."""
    all_ = [read_dataset(spark, p) for p in paths.split("+")]
    items = all_[0].items
    for d in all_[1:]:
        items = items.unionByName(d.items, allowMissingColumns=True)
    return Dataset("+".join(d.name for d in all_), items, all_[0].header, all_[0].params)
