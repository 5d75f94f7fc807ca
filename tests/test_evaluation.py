"""Evaluation of several items against a plain loop over ligands, pockets and criteria."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import evaluate as E
from orrery.operators.spatial import min_distance
from orrery.plans import evaluation as V


def made(seed):
    r = random.Random(seed)
    at = lambda: tuple(round(r.uniform(0, 14), 2) for _ in "xyz")
    ids = iter(range(10_000))
    x = {k: [] for k in ("proteins", "ligands", "ligand_atoms", "pockets", "surface", "pocket_points", "atoms", "pocket_atoms")}
    for item in ("a", "b", "c"):
        x["proteins"].append((item, r.randint(50, 99), r.randint(10, 40), r.randint(0, 2), 0, 1))
        for n in range({"a": 2, "b": 3, "c": 0}[item]):
            x["ligands"].append((item, next(ids), float(n)))
            where = at()
            x["ligand_atoms"] += [(item, x["ligands"][-1][1], next(ids), *(w + r.uniform(-1.5, 1.5) for w in where)) for _ in range(6)]
        points = [(item, next(ids), *at(), r.random(), r.random() < 0.5) for _ in range(80)]
        x["surface"] += points
        x["atoms"] += [(item, next(ids), n // 4, None if item == "b" else (n // 4) % 8 / 8, *at()) for n in range(60)]
        for n in range(5):
            x["pockets"].append((item, next(ids), n + 1, float(10 - n), n + 1, 8.0 * n, *at()))
            here = x["pockets"][-1]
            x["pocket_points"] += [(item, here[1], p[1]) for p in points if math.dist(p[2:5], here[6:]) < 5]
            x["pocket_atoms"] += [(item, here[1], a[1]) for a in x["atoms"] if a[0] == item and math.dist(a[4:], here[6:]) < 5]
    return x


KINDS = {
    "proteins": "item string, prot_atoms int, exposed_atoms int, ignored int, small int, distant int", "ligands": "item string, ligand long, center_dist double",
    "ligand_atoms": "item string, ligand long, id long, x double, y double, z double", "pockets": "item string, pocket long, rank int, score double, new_rank int, volume double, x double, y double, z double",
    "surface": "item string, id long, x double, y double, z double, score double, predicted boolean", "pocket_points": "item string, pocket long, id long",
    "atoms": "item string, id long, residue int, conservation double, x double, y double, z double", "pocket_atoms": "item string, pocket long, id long",
}


def plain_ranks(x):
    out = {}
    for item, lig, _ in x["ligands"]:
        atoms = [a[3:] for a in x["ligand_atoms"] if a[1] == lig]
        mid = [sum(c) / len(atoms) for c in zip(*atoms, strict=True)]
        mine = {p[1] for p in x["surface"] if p[0] == item and min(math.dist(p[2:5], a) for a in atoms) <= V.COVER}
        ranks = []
        for c in V.default_criteria():
            rank = -1
            for p in sorted((p for p in x["pockets"] if p[0] == item), key=lambda p: p[2]):
                theirs = {q[2] for q in x["pocket_points"] if q[1] == p[1]}
                both = len(mine & theirs)
                met = {
                    "dca": min(math.dist(p[6:], a) for a in atoms) <= c.limit, "dcc": math.dist(p[6:], mid) <= c.limit, "dso": both > 0 and both / len(mine | theirs) >= c.limit,
                    "dswo": both > 0 and both / len(mine) >= c.limit and both / len(theirs) >= 0.2,
                }[c.kind]
                if met:
                    rank = p[2]
                    break
            ranks.append(rank)
        out[item, lig] = ranks
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_and_figures(spark, seed):
    x = made(seed)
    p = V.Predictions(**{k: spark.createDataFrame(x[k], KINDS[k]) for k in KINDS})
    criteria = V.default_criteria()
    assert len(criteria) == 39
    want = plain_ranks(x)
    got = V.identification_ranks(p, criteria, V.pair_facts(p, criteria, V.covered_points(p)))
    assert {(r.item, r.ligand): r.ranks for r in got.collect()} == want
    assert any(r > 0 for v in want.values() for r in v) and any(r < 0 for v in want.values() for r in v)
    stats = {r.name: r.value for r in V.evaluation(p).collect()}
    assert len(stats) == 70 and (stats["PROTEINS"], stats["LIGANDS"], stats["POCKETS"], stats["LIGANDS_DISTANT"]) == (3.0, 5.0, 15.0, 3.0)
    n = {"a": 2, "b": 3}
    ok = lambda k, t: [(i, 0 < v[k] <= n[i] + t) for (i, _), v in want.items()]
    names = [c.name for c in criteria]
    for name, c, t in (("DCA_4_0", "DCA_4", 0), ("DCA_4_99", "DCA_4", 99), ("DCC_10_2", "DCC_10", 2), ("DSOR_01_0", "DSO_0.1", 0), ("DSWO_05_2", "DSWO_0.5", 2)):
        assert stats[name] == pytest.approx(sum(h for _, h in ok(names.index(c), t)) / 5)
    assert stats["DCA_4_2_PC"] == pytest.approx(sum(h / n[i] for i, h in ok(names.index("DCA_4"), 2)) / 3)
    near = [min(math.dist(a[3:], q[6:]) for a in x["ligand_atoms"] if a[1] == lig for q in x["pockets"] if q[0] == item) for item, lig in want]
    assert stats["AVG_LIG_CLOSTES_POCKET_DIST"] == pytest.approx(sum(near) / 5)
    true = {q[1] for q in x["pockets"] for a in x["ligand_atoms"] if a[0] == q[0] and math.dist(a[3:], q[6:]) <= 4}
    assert stats["AVG_POCKET_VOLUME_TRUE_POCKETS"] == (pytest.approx(sum(q[5] for q in x["pockets"] if q[1] in true) / len(true)) if true else None)
    first = {i: {q[2] for q in x["pocket_points"] for k in x["pockets"] if k[1] == q[1] and k[0] == i and k[2] <= n[i]} for i in n}
    lig = {i: {s[1] for s in x["surface"] for a in x["ligand_atoms"] if s[0] == a[0] == i and math.dist(s[2:5], a[3:]) <= 2.5} for i in n}
    assert stats["AVG_LIGCOV_TOPN0"] == pytest.approx(sum(len(first[i] & lig[i]) / len(lig[i]) for i in n if lig[i]) / 2)


def test_without_pockets_or_ligands(spark):
    x = made(3) | {"pockets": [], "pocket_points": [], "pocket_atoms": []}
    stats = {r.name: r.value for r in V.evaluation(V.Predictions(**{k: spark.createDataFrame(x[k], KINDS[k]) for k in KINDS})).collect()}
    assert (stats["DCA_4_0"], stats["AVG_POCKETS"], stats["AVG_POCKET_VOLUME"], stats["OPT1"]) == (0.0, 0.0, None, 0.0)
    x = made(3) | {"ligands": [], "ligand_atoms": []}
    stats = {r.name: r.value for r in V.evaluation(V.Predictions(**{k: spark.createDataFrame(x[k], KINDS[k]) for k in KINDS})).collect()}
    assert (stats["LIGANDS"], stats["DCA_4_0"], stats["AVG_LIGAND_ATOMS"], stats["AVG_POCKETS"]) == (0.0, 0.0, None, 5.0)


def test_criteria_stay_within_items(spark):
    kind = "item string, id long, grp int, x double, y double, z double"
    a = spark.createDataFrame([("p", 1, 1, 0.0, 0.0, 0.0), ("q", 2, 2, 0.0, 0.0, 0.0)], kind)
    b = spark.createDataFrame([("p", 8, 8, 1.0, 0.0, 0.0), ("r", 9, 9, 0.0, 0.0, 0.0)], kind)
    assert {r.id: r.identified for r in E.within(a, b, 2.0).collect()} == {1: True, 2: False}
    cutoffs = spark.range(1, 3).select(F.col("id").alias("cutoff"))
    assert {r.cutoff: r.n_identified for r in E.distance_criterion(a, b, cutoffs, 3.0).collect()} == {1: 1, 2: 1}
    assert [tuple(r) for r in min_distance(a, b, 2.0).collect()] == [(1, 8, 1.0)]
