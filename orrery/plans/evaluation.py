"""Evaluation of ranked pockets against ligands, item by item.

Every criterion looks at the same facts of a ligand and a pocket of its item: the least distance of
an atom to the pocket's center, the distance of the centers, and the surface points both
have. They are made once, by radius joins within items and one equi-join on points, for the
pairs that are near enough for any criterion; one grouping then ranks every ligand by all
criteria at once. Each step is a join or an aggregate keyed by item, ligand or pocket.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.evaluate import top_averages
from orrery.operators.spatial import XYZ, knn, radius_join
from orrery.session import cut


@dataclass(frozen=True)
class Criterion:
    """kind: dca (any atom to pocket center), dcc (center to center), dso (shared over all surface
    points), dswo (shared points over the ligand's, and over the pocket's)."""

    name: str
    kind: str
    limit: float
    of_pocket: float = 0.2

    def met(self) -> Column:
        both = F.col("both")
        return {
            "dca": F.col("dca2") <= self.limit * self.limit,
            "dcc": F.col("dcc2") <= self.limit * self.limit,
            "dso": both / (F.col("nl") + F.col("np") - both) >= self.limit,
            "dswo": (both / F.col("nl") >= self.limit) & (both / F.col("np") >= self.of_pocket),
        }[self.kind]


def default_criteria() -> list[Criterion]:
    """The 39 criteria: distances in whole units, overlaps in tenths."""
    dca = [Criterion(f"DCA_{c}", "dca", c) for c in range(2, 13)]
    dcc = [Criterion(f"DCC_{c}", "dcc", c) for c in range(4, 15)]
    dso = [Criterion(f"DSO_0.{t}", "dso", t / 10) for t in range(7, 0, -1)]
    return dca + dcc + dso + [Criterion(f"DSWO_{t / 10}", "dswo", t / 10) for t in range(10, 0, -1)]


@dataclass(frozen=True)
class Predictions:
    """Predictions and ligands of many items. Ids of ligands, pockets, atoms and points are unique over all items.

    proteins: item, prot_atoms, exposed_atoms, ignored, small, distant (ligands of these kinds).
    ligands: item, ligand, center_dist (relevant ones). ligand_atoms: item, ligand, id, x, y, z.
    pockets: item, pocket, rank (from 1), score, new_rank, volume, x, y, z (center).
    surface: item, id, x, y, z, score, predicted. pocket_points: item, pocket, id (surface points of a pocket).
    atoms: item, id, residue, conservation (null without scores), x, y, z. pocket_atoms: item, pocket, id.
    """

    proteins: DataFrame
    ligands: DataFrame
    ligand_atoms: DataFrame
    pockets: DataFrame
    surface: DataFrame
    pocket_points: DataFrame
    atoms: DataFrame
    pocket_atoms: DataFrame


#: How near a surface point is to a ligand that covers it, and an atom that is in contact with it.
COVER, CONTACT = 2.5, 4.0


def covered_points(p: Predictions, cover: float = COVER) -> DataFrame:
    """(item, ligand, id, score, predicted): the surface points within ``cover`` of each ligand."""
    near = radius_join(p.surface.select("item", "id", "score", "predicted", *XYZ), p.ligand_atoms.select("item", "ligand", *XYZ), cover, "item")
    return near.select("item", F.col("ligand_r").alias("ligand"), "id", "score", "predicted").distinct()


def pair_facts(p: Predictions, criteria: Sequence[Criterion], covered: DataFrame) -> DataFrame:
    """(item, ligand, pocket, rank, dca2, dcc2, both, nl, np) of the pairs that some criterion can accept; squared distances."""
    reach = lambda kind: max((c.limit for c in criteria if c.kind == kind), default=0)
    centers = p.pockets.select("item", "pocket", *XYZ)
    pair = lambda df, **cols: df.select("item", "ligand", "pocket", *(cols.get(c, F.lit(None).cast("double")).alias(c) for c in ("dca2", "dcc2", "both")))
    joined = lambda left, r: radius_join(left, centers, r, "item").withColumn("pocket", F.col("pocket_r"))
    parts = []
    if reach("dca"):
        parts.append(pair(joined(p.ligand_atoms.select("item", "ligand", *XYZ), reach("dca")), dca2=F.col("d2")))
    if reach("dcc"):
        middle = p.ligand_atoms.groupBy("item", "ligand").agg(*(F.avg(c).alias(c) for c in XYZ))
        parts.append(pair(joined(middle, reach("dcc")), dcc2=F.col("d2")))
    shared = covered.join(p.pocket_points, ["item", "id"]).groupBy("item", "ligand", "pocket").agg(F.count("*").cast("double").alias("n"))
    parts.append(pair(shared, both=F.col("n")))
    facts = reduce(DataFrame.unionByName, parts).groupBy("item", "ligand", "pocket").agg(F.min("dca2").alias("dca2"), F.min("dcc2").alias("dcc2"), F.max("both").alias("both"))
    nl = covered.groupBy("item", "ligand").agg(F.count("*").alias("nl"))
    np = p.pocket_points.groupBy("item", "pocket").agg(F.count("*").alias("np"))
    return facts.join(nl, ["item", "ligand"], "left").join(np, ["item", "pocket"], "left").join(p.pockets.select("item", "pocket", "rank"), ["item", "pocket"])


def identification_ranks(p: Predictions, criteria: Sequence[Criterion], facts: DataFrame) -> DataFrame:
    """(item, ligand, ranks): for each criterion the rank of the first pocket that meets it, or -1."""
    first = facts.groupBy("item", "ligand").agg(F.array(*(F.min(F.when(c.met(), F.col("rank"))).cast("int") for c in criteria)).alias("ranks"))
    none = F.array(*[F.lit(-1)] * len(criteria))
    found = F.coalesce(F.transform("ranks", lambda r: F.coalesce(r, F.lit(-1))), none)
    return p.ligands.select("item", "ligand").join(first, ["item", "ligand"], "left").select("item", "ligand", found.alias("ranks"))


def ligand_rows(p: Predictions, criteria: Sequence[Criterion], facts: DataFrame, covered: DataFrame) -> DataFrame:
    """Per ligand: n (ligands of its item), ranks, atoms, center_dist, closest (distance of the nearest
    pocket's center, null without pockets), and mean, max, top3, top_half of its points' scores."""
    n = p.ligands.groupBy("item").agg(F.count("*").alias("n"))
    atoms = p.ligand_atoms.groupBy("item", "ligand").agg(F.count("*").alias("atoms"))
    # a pocket may be any distance away
    nearest = knn(p.ligand_atoms.select("id", *XYZ, "item"), p.pockets.select(F.col("pocket").alias("id"), *XYZ, "item"), 1, 12.0, item="item")
    closest = nearest.join(p.ligand_atoms.select("id", "ligand"), "id").groupBy("ligand").agg(F.sqrt(F.min("d2")).alias("closest"))
    tops = top_averages(covered.select("ligand", "id", "score"), "ligand", "score", "id")
    rows = identification_ranks(p, criteria, facts).join(p.ligands.select("ligand", "center_dist"), "ligand").join(n, "item")
    return rows.join(atoms, ["item", "ligand"], "left").join(closest, "ligand", "left").join(tops, "ligand", "left")


def pocket_rows(p: Predictions, facts: DataFrame, standard: Criterion, exponent: float = 1.0) -> DataFrame:
    """Per pocket: is_true (some ligand identifies it by the standard criterion), surf_atoms, points,
    conservation (mean over the residues of its atoms, 0 without scores), and its ranks by
    conservation and by that to a power times score."""
    true = facts.where(standard.met()).groupBy("item", "pocket").agg(F.lit(True).alias("is_true"))
    surf = p.pocket_atoms.groupBy("item", "pocket").agg(F.count("*").alias("surf_atoms"))
    points = p.pocket_points.groupBy("item", "pocket").agg(F.count("*").alias("points"))
    of = p.pocket_atoms.join(p.atoms.select("item", "id", "residue", "conservation"), ["item", "id"])
    mean = of.dropDuplicates(["item", "pocket", "residue"]).groupBy("item", "pocket").agg(F.avg("conservation").alias("conservation"))
    on = ["item", "pocket"]
    rows = p.pockets.join(true, on, "left").join(surf, on, "left").join(points, on, "left").join(mean, on, "left")
    rows = rows.select(
        *p.pockets.columns, F.coalesce("is_true", F.lit(False)).alias("is_true"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("surf_atoms", "points", "conservation"))
    )
    # of ties the later pocket goes first
    place = lambda value: F.row_number().over(Window.partitionBy("item").orderBy(value.desc(), F.desc("rank")))
    combined = F.pow(F.col("conservation"), F.lit(exponent)) * F.col("score")
    return rows.withColumns({"conservation_rank": place(F.col("conservation")), "combined_rank": place(combined)})


def protein_rows(p: Predictions, ranked: DataFrame, standard_at: int, covered: DataFrame, contact: float = CONTACT) -> DataFrame:
    """Per item: counts; coverage and overlap of the ligands' surface by the first n and n + 2 pockets
    (cov_0, dso_0, cov_2, dso_2) and of the identified ligands' by their pockets (cov_s, dso_s);
    conservation of all residues and of those with and without an atom in contact with a ligand."""
    n = p.ligands.groupBy("item").agg(F.count("*").alias("n"))
    mark = lambda df, **cols: df.select("item", "id", *(cols.get(c, F.lit(None)).cast("int").alias(c) for c in ("lig", "place", "hit", "taken")))
    hits = ranked.where(F.get("ranks", F.lit(standard_at)) > 0).select("item", "ligand", F.get("ranks", F.lit(standard_at)).alias("rank"))
    taken = hits.select("item", "rank").distinct().join(p.pockets.select("item", "rank", "pocket"), ["item", "rank"])
    marks = [
        mark(covered, lig=F.lit(1)),
        mark(p.pocket_points.join(p.pockets.select("item", "pocket", "rank"), ["item", "pocket"]), place=F.col("rank")),
        mark(covered.join(hits, ["item", "ligand"]), hit=F.lit(1)),
        mark(p.pocket_points.join(taken, ["item", "pocket"]), taken=F.lit(1)),
    ]
    by_point = reduce(DataFrame.unionByName, marks).groupBy("item", "id").agg(F.max("lig").alias("lig"), F.min("place").alias("place"), F.max("hit").alias("hit"), F.max("taken").alias("taken"))
    by_point = by_point.join(n, "item", "left")
    shares = {}
    for name, a, b in (("0", F.col("lig") == 1, F.col("place") <= F.col("n")), ("2", F.col("lig") == 1, F.col("place") <= F.col("n") + 2), ("s", F.col("hit") == 1, F.col("taken") == 1)):
        a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
        both = F.count_if(a & b).cast("double")
        shares |= {f"cov_{name}": F.try_divide(both, F.count_if(a).cast("double")), f"dso_{name}": F.try_divide(both, F.count_if(a | b).cast("double"))}
    covers = by_point.groupBy("item").agg(*(c.alias(k) for k, c in shares.items()))
    near = radius_join(p.atoms.select("item", "id", *XYZ), p.ligand_atoms.select("item", *XYZ), contact, "item").select("item", "id").distinct().withColumn("binding", F.lit(True))
    of = p.atoms.select("item", "id", "residue", "conservation").join(near, ["item", "id"], "left")
    residues = of.groupBy("item", "residue").agg(F.max("conservation").alias("c"), F.count_if(F.col("binding")).alias("b"), F.count_if(F.col("binding").isNull()).alias("o"))
    mean = lambda where: F.coalesce(F.avg(F.when(where, F.col("c"))), F.lit(0.0))
    scores = residues.groupBy("item").agg(mean(F.lit(True)).alias("cons"), mean(F.col("b") > 0).alias("cons_b"), mean(F.col("o") > 0).alias("cons_o"))
    sas = p.surface.groupBy("item").agg(F.count("*").alias("sas_points"))
    rows = p.proteins.join(n, "item", "left").join(sas, "item", "left").join(covers, "item", "left").join(scores, "item", "left")
    return rows.fillna(0, ["n", "sas_points", "cons", "cons_b", "cons_o"])


def evaluation(p: Predictions, criteria: Sequence[Criterion] | None = None, standard: str = "DCA_4", exponent: float = 1.0) -> DataFrame:
    """(name, value): all figures of an evaluation, from counts to success rates and the two objectives.
    Rates of criteria that are not asked for have no row.

    An average over no rows is null; rows without a value count 0 in averages over all of them.
    """
    criteria = list(criteria or default_criteria())
    names = [c.name for c in criteria]
    at = names.index(standard)
    # read several times below
    covered = cut(covered_points(p))
    facts = cut(pair_facts(p, criteria, covered))
    ligands = cut(ligand_rows(p, criteria, facts, covered))
    pockets = pocket_rows(p, facts, criteria[at], exponent)
    proteins = protein_rows(p, ligands.select("item", "ligand", "ranks"), at, covered)
    lig_points = covered.groupBy("item", "id").agg(F.max("score").alias("pt_score"), F.max(F.col("predicted").cast("int")).alias("pt_predicted"))
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [
            proteins.withColumn("kind", F.lit("protein")),
            ligands.select(F.lit("ligand").alias("kind"), F.col("n").alias("l_n"), "ranks", "atoms", "center_dist", "closest", "mean", "max", "top3", "top_half"),
            pockets.select(F.lit("pocket").alias("kind"), "volume", "surf_atoms", "points", "conservation", "new_rank", "conservation_rank", "combined_rank", "is_true"),
            lig_points.select(F.lit("point").alias("kind"), "pt_score", "pt_predicted"),
        ],
    )
    is_ = lambda kind: F.col("kind") == kind
    count = lambda c: F.count_if(c).cast("double")
    total = lambda c, where: F.coalesce(F.sum(F.when(where, c)), F.lit(0)).cast("double")
    mean = lambda c, where: F.try_divide(total(c, where), count(where))
    protein, ligand, pocket, point = is_("protein"), is_("ligand"), is_("pocket"), is_("point")
    true, false, with_ligands = pocket & F.col("is_true"), pocket & ~F.col("is_true"), protein & (F.col("n") > 0)
    n = {"p": count(protein), "l": count(ligand)}

    def hit(name: str, tolerance: int) -> Column:
        rank = F.get("ranks", F.lit(names.index(name)))
        return ligand & (rank > 0) & (rank <= F.col("l_n") + tolerance)

    rate = lambda name, t: F.coalesce(F.try_divide(count(hit(name, t)), n["l"]), F.lit(0.0))
    by_item = lambda name, t: F.coalesce(F.try_divide(total(1.0 / F.col("l_n"), hit(name, t)), n["p"]), F.lit(0.0))
    stats = {
        "PROTEINS": n["p"], "POCKETS": count(pocket), "LIGANDS": n["l"],
        **{f"LIGANDS_{k.upper()}": total(F.col(k), protein) for k in ("ignored", "small", "distant")},
        "AVG_LIGAND_ATOMS": mean(F.col("atoms"), ligand),
        "AVG_PROT_ATOMS": mean(F.col("prot_atoms"), protein), "AVG_PROT_EXPOSED_ATOMS": mean(F.col("exposed_atoms"), protein), "AVG_PROT_SAS_POINTS": mean(F.col("sas_points"), protein),
        "AVG_PROT_CONSERVATION": mean(F.col("cons"), protein), "AVG_PROT_BINDING_CONSERVATION": mean(F.col("cons_b"), protein), "AVG_PROT_NON_BINDING_CONSERVATION": mean(F.col("cons_o"), protein),
        "AVG_LIG_CENTER_TO_PROT_DIST": mean(F.col("center_dist"), ligand), "AVG_LIG_CLOSTES_POCKET_DIST": mean(F.col("closest"), ligand),
        "LIGAND_COVERAGE": mean(F.col("pt_predicted"), point),
        **{f"AVG_DSO_{k}": mean(F.col(f"dso_{c}"), with_ligands) for k, c in (("TOPN0", "0"), ("TOPN2", "2"), ("SUCC", "s"))},
        **{f"AVG_LIGCOV_{k}": mean(F.col(f"cov_{c}"), with_ligands) for k, c in (("TOPN0", "0"), ("TOPN2", "2"), ("SUCC", "s"))},
        "AVG_LIG_POINT_SCORE": mean(F.col("pt_score"), point),
        **{f"AVG_LIG_{k}_POINT_SCORE": mean(F.col(c), ligand) for k, c in (("AVG", "mean"), ("MAX", "max"), ("AVG_MAX3", "top3"), ("AVG_MAXHALF", "top_half"))},
        "AVG_POCKETS": F.try_divide(count(pocket), n["p"]),
        **{f"AVG_POCKET_{k}{s}": mean(F.col(c), w) for k, c in (("SURF_ATOMS", "surf_atoms"), ("SAS_POINTS", "points"), ("VOLUME", "volume")) for s, w in (("", pocket), ("_TRUE_POCKETS", true))},
        "AVG_POCKET_CONSERVATION": mean(F.col("conservation"), pocket),
        **{f"AVG_{s}_POCKET_{k}": mean(F.col(c), w) for k, c in (("CONSERVATION", "conservation"), ("PRANK_RANK", "new_rank"), ("CONSERVATION_RANK", "conservation_rank"), ("COMBINED_RANK", "combined_rank")) for s, w in (("TRUE", true), ("FALSE", false))},
        **{f"{standard}_{t}": rate(standard, t) for t in (0, 1, 2, 4, 10, 99)},
        **{f"{standard}_{t}_NOMINAL": count(hit(standard, t)) for t in (0, 1, 2, 4, 10)},
        **{f"{standard}_{t}_PC": by_item(standard, t) for t in (0, 2)},
        **{f"{k}_{t}": rate(c, t) for k, c in (("DCC_5", "DCC_5"), ("DCC_10", "DCC_10"), ("DCC_12", "DCC_12"), ("DSOR_01", "DSO_0.1"), ("DSWO_05", "DSWO_0.5")) for t in (0, 2) if c in names},
        **{f"DCC_10_{t}_PC": by_item("DCC_10", t) for t in (0, 2) if "DCC_10" in names},
    }
    one = rows.agg(*(c.alias(k) for k, c in stats.items()))
    rates = [F.col(f"{standard}_{t}") for t in (0, 2, 4)]
    succ = F.coalesce("AVG_LIGCOV_SUCC", F.lit(0.0)), F.coalesce("AVG_DSO_SUCC", F.lit(0.0))
    one = one.withColumns({
        "OPT1": 100 * rates[0] + 100 * rates[1] + 50 * rates[2] + 10 * succ[0] + 5 * succ[1],
        "OPT2": 100 * F.col(f"{standard}_0_PC") + 50 * F.col(f"{standard}_2_PC") + 5 * succ[0] + 3 * succ[1],
    })
    pairs = ", ".join(f"'{k}', `{k}`" for k in one.columns)
    return one.select(F.expr(f"stack({len(one.columns)}, {pairs}) AS (name, value)"))
