"""Tables and texts that an evaluation leaves behind.

Tables keep a row per structure, ligand or pocket and are written by Spark; texts are made
of a handful of numbers and come as strings.
"""

from __future__ import annotations

import colorsys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the evaluation tables, in order.
PROTEINS = (
    "name", "#atoms", "#proteinAtoms", "#chains", "chainNames", "#ligands", "#pockets", "ligandNames", "#ignoredLigands", "ignoredLigNames", "#smallLigands",
    "smallLigNames", "#distantLigands", "distantLigNames",
)
LIGANDS = ("file", "#ligands", "ligand", "chain", "ligCode", "#atoms", "dca4rank", "closestPocketDist", "proteinDist", "centerToProteinDist", "sasDist", "#contactProteinAtoms", "atomIds")
POCKETS = ("file", "#ligands", "#pockets", "pocket", "ligand", "rank", "score", "newRank", "oldScore", "zScoreTP", "probaTP", "samplePoints", "rawNewScore", "pocketVolume", "surfaceAtoms")
_NUMBERS = frozenset("closestPocketDist proteinDist centerToProteinDist sasDist oldScore zScoreTP probaTP rawNewScore".split())


def _number(c: Column, digits: int = 4) -> Column:
    """A number as text, an empty one for null."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c.cast("double"))).otherwise("")


def _laid_out(df: DataFrame, columns: tuple[str, ...], given: dict[str, Column]) -> DataFrame:
    def cell(name: str) -> Column:
        c = given.get(name, F.col(f"`{name}`"))
        return (_number(c) if name in _NUMBERS else c.cast("string")).alias(name)

    return df.select(*map(cell, columns))


def _joined(names: str) -> Column:
    return F.array_join(F.array_sort(names), " ")


def protein_rows(proteins: DataFrame, ligands: DataFrame, pockets: DataFrame) -> DataFrame:
    """A row per structure. proteins: item, n_atoms, n_protein_atoms, chains (array). ligands: item,
    name, kind (relevant, ignored, small or distant). pockets: item."""
    kinds = ("relevant", "ignored", "small", "distant")
    n = ligands.groupBy("item").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds), *(F.collect_list(F.when(F.col("kind") == k, F.col("name"))).alias(f"of_{k}") for k in kinds))
    x = proteins.join(n, "item", "left").join(pockets.groupBy("item").agg(F.count("*").alias("n_pockets")), "item", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    named = lambda k: F.coalesce(_joined(f"of_{k}"), F.lit(""))
    given = {"name": F.col("item"), "#atoms": F.col("n_atoms"), "#proteinAtoms": F.col("n_protein_atoms"), "#chains": F.size("chains"), "chainNames": _joined("chains"), "#ligands": count("n_relevant"), "#pockets": count("n_pockets"), "ligandNames": named("relevant")}
    for kind, title in (("ignored", "#ignoredLigands ignoredLigNames"), ("small", "#smallLigands smallLigNames"), ("distant", "#distantLigands distantLigNames")):
        a, b = title.split()
        given |= {a: count(f"n_{kind}"), b: named(kind)}
    return _laid_out(x, PROTEINS, given)


def ligand_rows(ligands: DataFrame) -> DataFrame:
    """A row per ligand. ligands: item, name, chain_id, code, n_atoms, dca4rank, pocket_dist, protein_dist,
    center_dist, sas_dist, contacts, atom_ids (array)."""
    n = ligands.groupBy("item").agg(F.count("*").alias("_n"))
    given = {
        "file": F.col("item"), "#ligands": F.col("_n"), "ligand": F.col("name"), "chain": F.col("chain_id"), "ligCode": F.col("code"), "#atoms": F.col("n_atoms"), "closestPocketDist": F.col("pocket_dist"),
        "proteinDist": F.col("protein_dist"), "centerToProteinDist": F.col("center_dist"), "sasDist": F.col("sas_dist"), "#contactProteinAtoms": F.col("contacts"),
        "atomIds": F.array_join(F.transform(F.array_sort("atom_ids"), lambda x: x.cast("string")), " "),
    }
    return _laid_out(ligands.join(n, "item"), LIGANDS, given)


def rank_rows(ranks: DataFrame, criteria: list[str]) -> DataFrame:
    """A row per ligand with its rank under each criterion. ranks: item, name, criterion, rank (-1: none)."""
    n = ranks.groupBy("item").agg(F.countDistinct("name").alias("#ligands"))
    wide = ranks.groupBy("item", "name").pivot("criterion", criteria).agg(F.max("rank"))
    return wide.join(n, "item").select(F.col("item").alias("file"), "#ligands", F.col("name").alias("ligand"), *(F.coalesce(F.col(f"`{c}`"), F.lit(-1)).alias(c) for c in criteria))


def pocket_rows(pockets: DataFrame, ligands: DataFrame) -> DataFrame:
    """A row per pocket. pockets: item, name, ligand, rank, score, new_rank, old_score, zscore, probability,
    sas_points, raw_score, volume, surf_atoms. ligands: item."""
    n_l, n_p = ligands.groupBy("item").agg(F.count("*").alias("_l")), pockets.groupBy("item").agg(F.count("*").alias("_p"))
    given = {
        "file": F.col("item"), "#ligands": F.coalesce("_l", F.lit(0)), "#pockets": F.col("_p"), "pocket": F.col("name"), "ligand": F.coalesce("ligand", F.lit("")), "newRank": F.col("new_rank"), "oldScore": F.col("old_score"),
        "zScoreTP": F.col("zscore"), "probaTP": F.col("probability"), "samplePoints": F.col("sas_points"), "rawNewScore": F.col("raw_score"), "pocketVolume": F.col("volume"), "surfaceAtoms": F.col("surf_atoms"),
    }
    return _laid_out(pockets.join(n_l, "item", "left").join(n_p, "item"), POCKETS, given)


def success_table(rates: DataFrame, criteria: list[str], tolerances: list[int]) -> DataFrame:
    """A row per criterion with the rate in per cent at each tolerance. rates: criterion, tolerance, rate."""
    wide = rates.groupBy("criterion").pivot("tolerance", tolerances).agg(F.max("rate"))
    order = F.array_position(F.array(*map(F.lit, criteria)), F.col("criterion"))
    return wide.orderBy(order).select(F.col("criterion").alias("tolerances:"), *(_number(F.col(f"`{t}`") * 100, 1).alias(f"[{t}]") for t in tolerances))


def run_table(stats: DataFrame, runs: list[int]) -> DataFrame:
    """Mean, deviation and relative deviation of each number over several runs, and its value in each.
    stats: name, run, value."""
    by_run = [F.max(F.when(F.col("run") == r, F.col("value"))).alias(f"run_{r}") for r in runs]
    x = stats.groupBy("name").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), *by_run)
    relative = F.try_divide(F.col("s"), F.abs("m")) * 100
    return x.select(F.col("name").alias("FEATURE"), _number(F.col("m")).alias("MEAN"), _number(F.col("s")).alias("STDDEV"), _number(relative, 1).alias("REL_STDDEV[%]"), *(_number(F.col(f"run_{r}")).alias(f"run_{r}") for r in runs))


#: The numbers of the metrics part of a classifier text, in order.
_TEXT_METRICS = ("acc", "p", "r", "npv", "spc", "tpx", "auprc", "auc", "f1", "mcc")


def classifier_text(name: str, m: dict) -> str:
    """Counts, confusion matrix and metrics of a classifier; m has tp, fp, tn, fn and those of ``classifier_metrics``, auc and auprc."""
    tp, fp, tn, fn = (int(m[k]) for k in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    number = lambda v: "" if v is None else f"{v:.4f}"
    percent = lambda v: "" if v is None else f"{100 * v:.1f}%"
    share = lambda v: percent(v / n if n else None)
    lines = [
        f"Classifier: {name}", "", f"N:, {n}", f"Positives:, {tp + fn}", f"Negatives:, {tn + fp}", f"Ratio p/n:, {number((tp + fn) / (tn + fp) if tn + fp else None)}", "", "CONFUSION MATRIX", "",
        "Absolute:", "       , pred[0],  pred[1]", f"obs[0] , {tn},  {fp}, {percent(m['spc'])}", f"obs[1] , {fn},  {tp}, {percent(m['r'])}", f"       , {percent(m['npv'])},  {percent(m['p'])}", "",
        "Relative:", f"       , {share(tn)}, {share(fp)}", f"       , {share(fn)}, {share(tp)}", "", "METRICS", "",
    ]
    lines += [f"{k.upper()}:, {number(m.get(k))}" for k in _TEXT_METRICS]
    return "\n".join(lines) + "\n"


def histogram_lines(h: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Lower end and count of each bin, empty ones too. h: bin, n."""
    every = h.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(h, "bin", "left").select((F.lit(low) + F.col("bin") * ((high - low) / bins)).alias("from"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("from")


def curve_lines(curve: DataFrame, x: str, y: str) -> DataFrame:
    """The points of a curve in order."""
    return curve.select(_number(F.col(x), 6).alias("x"), _number(F.col(y), 6).alias("y")).orderBy("x", "y")


def pocket_dump(pockets: DataFrame) -> DataFrame:
    """rank, score, name and centroid of an item's pockets, for a file with tabs. pockets: item, rank, score, name, x, y, z."""
    return pockets.select("item", "rank", "score", "name", "x", "y", "z").orderBy("item", "rank")


def arff_lines(vectors: DataFrame, columns: list[str], label: str, relation: str = "vectors") -> tuple[str, DataFrame]:
    """The header of an ARFF file and its data lines: numbers, and a class of 0 or 1."""
    head = [f"@relation {relation}", "", *(f"@attribute '{c}' numeric" for c in columns), "@attribute @@class@@ {0,1}", "", "@data"]
    line = F.concat_ws(",", *(F.col(f"`{c}`").cast("string") for c in columns), F.col(label).cast("int").cast("string"))
    return "\n".join(head) + "\n", vectors.select(line.alias("value"))


def write_arff(vectors: DataFrame, path: str, columns: list[str], label: str, relation: str = "vectors", compressed: bool = True) -> None:
    """A folder of text parts, the first of which begins with the header; concatenated they are one file."""
    head, lines = arff_lines(vectors, columns, label, relation)
    first = vectors.sparkSession.createDataFrame([(head.rstrip("\n"),)], "value string").coalesce(1)
    first.union(lines).write.mode("overwrite").option("compression", "gzip" if compressed else "none").text(path)


#: Columns of a coordinate table, with the column of ours that each shows.
CIF_COLUMNS = {
    "group_PDB": "group", "id": "serial", "type_symbol": "element", "label_atom_id": "name", "label_alt_id": "altloc", "label_comp_id": "res_name", "label_asym_id": "chain_id", "label_entity_id": "entity",
    "label_seq_id": "seq_num", "pdbx_PDB_ins_code": "ins_code", "Cartn_x": "x", "Cartn_y": "y", "Cartn_z": "z", "occupancy": "occupancy", "B_iso_or_equiv": "bfactor", "pdbx_formal_charge": "charge",
    "auth_seq_id": "seq_num", "auth_comp_id": "res_name", "auth_asym_id": "chain_id", "auth_atom_id": "name", "pdbx_PDB_model_num": "model",
}


def cif_lines(atoms: DataFrame) -> tuple[str, DataFrame]:
    """The head of a coordinate loop and (item, serial, value) lines of its rows."""
    head = "\n".join(["data_structure", "#", "loop_", *(f"_atom_site.{c}" for c in CIF_COLUMNS)]) + "\n"
    group = F.when(F.col("is_het"), "HETATM").otherwise("ATOM")
    shown = {"group": group, "entity": F.lit("1"), "model": F.col("model") if "model" in atoms.columns else F.lit(1), "charge": F.lit("?"), "altloc": F.col("altloc"), "ins_code": F.col("ins_code")}
    shown |= {c: F.format_string("%.3f", F.col(c)) for c in "xyz"} | {c: F.format_string("%.2f", F.col(c).cast("double")) for c in ("occupancy", "bfactor")}

    def cell(name: str) -> Column:
        said = F.trim(shown.get(name, F.col(name) if name not in shown else None).cast("string"))
        missing = "?" if name in ("ins_code", "charge") else "."
        # primes are part of atom names
        return F.when(said.isNull() | (said == ""), missing).when(said.contains("'"), F.concat(F.lit('"'), said, F.lit('"'))).otherwise(said)

    return head, atoms.select("item", "serial", F.concat_ws(" ", *(cell(c) for c in CIF_COLUMNS.values())).alias("value"))


def write_structures(atoms: DataFrame, path: str, form: str = "pdb", compressed: bool = False) -> None:
    """A folder per item with its structure as one text of the given form, pdb or cif."""
    from orrery.sources.sinks import pdb_lines

    if form not in ("pdb", "cif"):
        raise ValueError(f"unknown form of structures: {form}")
    head, lines = ("", pdb_lines(atoms)) if form == "pdb" else cif_lines(atoms)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("serial", "value"))), lambda s: s["value"]), "\n")
    whole = lines.groupBy("item").agg(F.concat(F.lit(head), ordered, F.lit("\nEND" if form == "pdb" else "\n#")).alias("value"))
    whole.write.mode("overwrite").partitionBy("item").option("compression", "gzip" if compressed else "none").text(path)


def spectrum_colour(i: Column, n: Column, saturation: float = 0.6, low: float = 0.6, high: float = 1.2) -> Column:
    """The colour number i of n, as ``spectrum`` has them."""
    h, v = (F.lit(low) + F.lit(high - low) * i / n) % 1.0, F.when(i % 2 == 0, 0.9).otherwise(0.7)

    def part(k: int) -> Column:
        at = (F.lit(float(k)) + h * 6) % 6
        x = v - v * saturation * F.greatest(F.lit(0.0), F.least(at, 4 - at, F.lit(1.0)))
        return F.lower(F.lpad(F.hex(F.floor(x * 255 + 0.5).cast("long")), 2, "0"))

    return F.concat(F.lit("#"), *map(part, (5, 3, 1)))


def spectrum(n: int, saturation: float = 0.6, low: float = 0.6, high: float = 1.2) -> list[str]:
    """n colours as `#rrggbb`: hues evenly from low to high, light and dark in turn."""
    out = []
    for i in range(n):
        r, g, b = colorsys.hsv_to_rgb((low + (high - low) * i / n) % 1.0, saturation, 0.7 if i % 2 else 0.9)
        out.append("#" + "".join(f"{int(v * 255 + 0.5):02x}" for v in (r, g, b)))
    return out
