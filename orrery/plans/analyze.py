"""Reports on structures: residues, chains, binding residues, propensities, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.features import one_letter
from orrery.operators import spatial as S
from orrery.operators import windows as W
from orrery.sources.sinks import sequences

KEYS = ["item", "chain_id", "seq_num", "ins_code", "res_name"]


def chains(residues: DataFrame) -> DataFrame:
    """(item, chain_id, n_residues) of residue rows."""
    return residues.groupBy("item", "chain_id").agg(F.count("*").alias("n_residues"))


def binding_residues(atoms: DataFrame, ligand_atoms: DataFrame, cutoff: float = 4.0) -> DataFrame:
    """Residues with an atom within the cutoff of a ligand atom of their item."""
    near = S.radius_join(atoms.select(*KEYS, *S.XYZ), ligand_atoms.select("item", *S.XYZ), cutoff, "item")
    return near.select(*KEYS).distinct()


def labelled_residues(residues: DataFrame, binding: DataFrame) -> DataFrame:
    """All residues with binding true or false; keys compare null-safely."""
    b = binding.select(*(F.col(c).alias(f"_{c}") for c in KEYS), F.lit(True).alias("_b"))
    on = F.lit(True)
    for c in KEYS:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return residues.join(b, on, "left").select(*residues.columns, F.coalesce("_b", F.lit(False)).alias("binding"))


def propensities(labelled: DataFrame) -> DataFrame:
    """Binding propensity of each amino acid."""
    return W.propensities(labelled.withColumn("aa", one_letter(F.col("res_name"))), "aa", F.col("binding"))


def pair_propensities(labelled: DataFrame, triplets: bool = False) -> DataFrame:
    """Binding propensity of each pair, or each triplet, of neighbours in the chain."""
    x = labelled.withColumn("aa", one_letter(F.col("res_name")))
    by, order = ["item", "chain_id"], ["pos_in_chain"]
    y = W.triplets(x, by, order, "aa") if triplets else W.duplets(x, by, order, "aa")
    return W.propensities(y, "triplet" if triplets else "duplet", F.col("binding"))


def chain_sequences(residues: DataFrame) -> DataFrame:
    """(item, chain_id, seq) in one-letter code."""
    return sequences(residues.withColumn("aa", one_letter(F.col("res_name"))), ["item", "chain_id"], ["pos_in_chain"], "aa")


def described(columns: list[str], params) -> str:
    """A text with the feature columns and the parameters."""
    from dataclasses import asdict

    return "\n".join(["features:", *(f"  {c}" for c in columns), "parameters:", *(f"  {k} = {v}" for k, v in asdict(params).items())]) + "\n"
