"""Writers: predictions, residues, sequences, structures, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.sources.structures import serial_field


def sequences(df: DataFrame, by: list[str], order: list[str], letter: str) -> DataFrame:
    """One string of letters per chain, in order."""
    pair = F.struct(*order, F.col(letter).alias("_c"))
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda s: s["_c"]), "").alias("seq"))


def fasta(seqs: DataFrame, name: Column, masked: bool = False) -> DataFrame:
    """Lines `>name` and the sequence; masked turns what isn't a standard letter into X."""
    seq = F.regexp_replace("seq", "[^ACDEFGHIKLMNPQRSTVWY]", "X") if masked else F.col("seq")
    return seqs.select(F.concat(F.lit(">"), name, F.lit("\n"), seq).alias("value"))


def predictions(pockets: DataFrame) -> DataFrame:
    """Rows of the predictions file; surface atom ids in numeric order, residue ids in order of their text."""
    numeric = F.array_join(F.transform(F.array_sort("surf_atom_ids"), lambda x: x.cast("string")), " ")
    text = F.array_join(F.array_sort(F.transform("residue_ids", lambda x: x.cast("string"))), " ")
    number = lambda c, n: F.format_string(f"%.{n}f", F.col(c))
    return pockets.select(
        "item", "name", "rank", number("score", 2).alias("score"), number("probability", 3).alias("probability"), "sas_points", F.size("surf_atom_ids").alias("surf_atoms"),
        *(number(c, 4).alias(f"center_{c}") for c in "xyz"), text.alias("residue_ids"), numeric.alias("surf_atom_ids"),
    )


def residues(labels: DataFrame) -> DataFrame:
    """Rows of the residues file."""
    number = lambda c, n: F.format_string(f"%.{n}f", F.col(c)).alias(c)
    return labels.select("item", "chain", "residue_label", "residue_name", number("score", 4), number("zscore", 4), number("probability", 4), F.coalesce("pocket", F.lit(0)).alias("pocket"))


def write_csv(df: DataFrame, path: str, by: str | None = "item", sep: str = ",") -> None:
    """CSV files with a header, a folder per item."""
    writer = df.write.mode("overwrite").option("header", True).option("sep", sep)
    (writer.partitionBy(by) if by else writer).csv(path)


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """ATOM and HETATM lines of fixed width, in order of item and serial, one row per atom."""
    record = F.when(F.col("is_het"), "HETATM").otherwise("ATOM")
    name = F.when(F.length("name") < 4, F.concat(F.lit(" "), F.rpad("name", 3, " "))).otherwise(F.col("name"))
    line = F.format_string(
        "%-6s%5s %4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", record, serial_field(F.col("serial")), name, F.coalesce("altloc", F.lit(" ")), "res_name", "chain_id", "seq_num",
        F.coalesce("ins_code", F.lit(" ")), "x", "y", "z", F.col("occupancy").cast("double"), F.col("bfactor").cast("double"), F.coalesce("element", F.lit(" ")),
    )
    return atoms.select("item", "serial", line.alias("value"))


def scored_points(points: DataFrame) -> DataFrame:
    """Points as HETATM lines with their score as temperature factor."""
    line = F.format_string("HETATM%5d H   STP C%4d    %8.3f%8.3f%8.3f  0.50%6.3f           H", F.col("id"), F.col("pocket"), "x", "y", "z", "score")
    return points.select("item", "id", line.alias("value"))


def pymol_script(structure: str, pockets: list[dict]) -> str:
    """A script that loads a structure and colours the atoms of each pocket; pockets have name, rank, surf_atom_ids."""
    lines = [f"load {structure}, protein", "hide everything", "show cartoon, protein", "color grey70, protein"]
    for p in sorted(pockets, key=lambda p: p["rank"]):
        ids = "+".join(str(i) for i in sorted(p["surf_atom_ids"]))
        hue = (p["rank"] * 0.618) % 1
        lines += [f"select {p['name']}, id {ids}", f"set_color c_{p['name']}, [{hue:.3f}, {1 - hue:.3f}, {(hue * 2) % 1:.3f}]", f"color c_{p['name']}, {p['name']}", f"show surface, {p['name']}"]
    return "\n".join([*lines, "deselect", "zoom protein"]) + "\n"


def chimerax_script(structure: str, pockets: list[dict]) -> str:
    """The same for the other viewer: a command per pocket."""
    lines = [f"open {structure}", "hide atoms", "show cartoons"]
    for p in sorted(pockets, key=lambda p: p["rank"]):
        lines += [f"name {p['name']} " + ",".join(f"@@serial_number={i}" for i in sorted(p["surf_atom_ids"])), f"color {p['name']} {'#%06x' % ((p['rank'] * 2654435761) & 0xFFFFFF)}", f"surface {p['name']}"]
    return "\n".join(lines) + "\n"
