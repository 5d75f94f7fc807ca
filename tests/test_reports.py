"""Registered features, evaluation reports and writers on small inputs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import features as X
from orrery.operators import aggregate as A
from orrery.operators import spatial as S
from orrery.operators import transform as X2
from orrery.operators.components import components
from orrery.sources import reports as R

ATOMS = [
    (1, "N", "N", "HIS", 0.0, 0.0, 0.0), (2, "ND1", "N", "HIS", 1.0, 0.0, 0.0), (3, "OD1", "O", "ASP", 0.0, 1.0, 0.0), (4, "CA", None, "XXX", 0.0, 0.0, 9.0), (5, "SE", "SE", "MSE", 0.0, 2.0, 0.0),
]


@pytest.fixture(scope="module")
def atoms(spark):
    return spark.createDataFrame(ATOMS, "id long, name string, element string, res_name string, x double, y double, z double")


def test_chemical_feature(spark, atoms):
    table = spark.createDataFrame([("HIS", *map(float, range(18))), ("ASP", *[2.0] * 18)], "key string, " + ", ".join(f"{c} double" for c in X.CHEM_RESIDUE))
    f = X.feature("chem")
    got = {r.id: r for r in f.compute(atoms=atoms, table=table).collect()}
    assert len(f.columns) == 24 and set(got[1].asDict()) == {"id", *f.columns}
    assert (got[1].hydrophilic, got[1].atomN, got[1].hDonorAtoms) == (1.0, 1.0, 0.0)
    assert (got[2].hDonorAtoms, got[2].hAcceptorAtoms, got[2].atomN) == (1.0, 1.0, 1.0)
    assert (got[3].hDonorAtoms, got[3].hAcceptorAtoms, got[3].atomO, got[3].polar) == (0.0, 1.0, 1.0, 2.0)
    assert (got[4].atomC, got[4].polar, got[4].atomDensity) == (1.0, 0.0, 1.0)
    assert (got[5].atomC, got[5].atomO, got[5].atomN) == (0.0, 0.0, 0.0)


def test_lookups_by_atom_and_residue(spark, atoms):
    by_atom = spark.createDataFrame([("HIS.ND1", 1.0, 0.0, 0.0, 0.0, 1.0, 1.0)], "key string, " + ", ".join(f"{c} double" for c in X.VOLSITE))
    got = {r.id: r for r in X.feature("volsite").compute(atoms=atoms, table=by_atom).collect()}
    assert got[2].vsAromatic == got[2].vsDonor == 1.0 and got[2].vsCation == 0.0 and sum(got[1][1:]) == 0.0
    by_code = spark.createDataFrame([("MET", -2.0, 0.0, 0.0, 0.0, 3.0)], "key string, " + ", ".join(f"{c} double" for c in X.RESIDUE_TABLE))
    got = {r.id: r for r in X.feature("residue_table").compute(residues=atoms, table=by_code, power=2.0).collect()}
    assert got[5].aa5fact1 == -4.0 and got[5].aa5fact5 == 9.0 and got[1].aa5fact1 == 0.0
    index = X.index_feature("aa.test", ("aa5fact1",))
    assert {r.id: r.aa5fact1 for r in index.compute(rows=atoms, table=by_code).collect()}[5] == -2.0
    scores = spark.createDataFrame([(7, 0.25)], "residue int, score double")
    rows = spark.createDataFrame([(1, 7), (2, 8)], "id long, residue int")
    assert {r.id: r.conservation for r in X.feature("conservation").compute(atoms=rows, scores=scores).collect()} == {1: 0.25, 2: 0.0}


def test_csv_feature(spark):
    rows = spark.createDataFrame([(1, 11), (2, 12)], "id long, serial int")
    table = spark.createDataFrame([(11, 0.5)], "serial int, v double")
    f = X.csv_feature("csv", "atom", ("v",))
    assert {r.id: r.v for r in f.compute(rows=rows, table=table).collect()} == {1: 0.5, 2: 0.0}


def test_pair_histogram(spark, atoms):
    point = spark.createDataFrame([(100, 0.0, 0.0, 0.0), (101, 50.0, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r.id: list(r[1:]) for r in X.feature("pair_hist").compute(points=point, exposed=atoms, radius=2.5, smooth=False).collect()}
    # distances among atoms 1, 2, 3, 5: four times 0, and 1, 1, 2, 1.41, 2.24, 1
    assert got[100] == [4.0, 4.0, 2.0, 0.0, 0.0] and sum(got[101]) == 0.0
    smooth = {r.id: list(r[1:]) for r in X.feature("pair_hist").compute(points=point, exposed=atoms, radius=2.5, smooth=True).collect()}
    assert abs(sum(smooth[100]) - 10) < 1e-9
    shares = {r.id: list(r[1:]) for r in X.feature("pair_hist").compute(points=point, exposed=atoms, radius=2.5, normalised=True).collect()}
    assert shares[100] == [0.4, 0.4, 0.2, 0.0, 0.0] and sum(shares[101]) == 0.0


@pytest.mark.parametrize("bins, smooth, values", [
    (2, False, {-1: [1, 0], 0: [1, 0], 1: [0, 1], 2: [0, 1], 0.5: [0, 1], 0.25: [1, 0], 0.75: [0, 1]}),
    (3, False, {-1: [1, 0, 0], 0: [1, 0, 0], 1: [0, 0, 1], 2: [0, 0, 1], 0.5: [0, 1, 0], 0.25: [1, 0, 0], 0.75: [0, 0, 1]}),
    (2, True, {-1: [1, 0], 0: [1, 0], 1: [0, 1], 2: [0, 1], 0.5: [0.5, 0.5], 0.25: [0.75, 0.25], 0.75: [0.25, 0.75]}),
    (3, True, {-1: [1, 0, 0], 0: [1, 0, 0], 1: [0, 0, 1], 2: [0, 0, 1], 0.5: [0, 1, 0], 0.25: [0.5, 0.5, 0], 0.75: [0, 0.5, 0.5]}),
])
def test_histogram_shares(spark, bins, smooth, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {v: [0.0] * bins for v in values}
    for r in A.shares(df, ["v"], "v", 0.0, 1.0, bins, smooth).collect():
        got[r.v][r.bin] += r.share
    assert got == values


def test_pairs_beyond_the_range_are_counted(spark):
    rows = [(n, "ab"[n % 2], float(n * n), 0.0, 0.0) for n in range(12)]
    points = spark.createDataFrame(rows, "id long, g string, x double, y double, z double")
    for smooth in (False, True):
        got = {(r.g, r.bin): r.n for r in A.pair_distances(points, "g", 0.0, 9.0, 4, smooth=smooth).collect()}
        want = {}
        for g in "ab":
            xs = [x for _, h, x, _, _ in rows if h == g]
            for i, a in enumerate(xs):
                for b in xs[i:]:
                    dist = min(abs(a - b), 9.0)
                    pos = dist / 3 if smooth else min(dist / 2.25, 3)
                    lo = min(int(pos), 2 if smooth else 3)
                    for k, w in ((lo, 1 - (pos - lo)), (lo + 1, pos - lo)) if smooth else ((lo, 1.0),):
                        if w:
                            want[g, k] = want.get((g, k), 0) + w
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {r.g: r.s for r in A.pair_distances(points, "g", 0.0, 9.0, 4, normalised=True).groupBy("g").agg(F.round(F.sum("n"), 9).alias("s")).collect()} == {"a": 1.0, "b": 1.0}


def test_probability_between_the_edges_of_bins(spark):
    fit = spark.createDataFrame([(0, 2, 6), (1, 4, 4), (2, 8, 0)], "bin long, tp long, fp long")
    scores = [-3.0, -0.5, 0.0, 0.5, 1.0, 1.25, 2.0, 2.9, 3.0, 50.0]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = {r.s: r.probability for r in X2.probability(df, "s", fit, 0.0, 3.0, 3).collect()}

    def value(h, x):
        k = min(max(int(x), 0), 2)
        return h[k] if k == 2 else h[k] + (h[k + 1] - h[k]) * (x - k)

    for s in scores:
        t, f = value([2, 4, 8], s), value([6, 4, 0], s)
        assert abs(got[s] - max(t / (t + f), 0.0)) < 1e-12, s


def test_chain_features(spark):
    rows = [(k, 0, k, t, c) for k, (t, c) in enumerate(zip("HHHEEC", "ACDACD", strict=True))]
    chain = spark.createDataFrame(rows, "id long, chain int, n int, ss string, letter string")
    by = dict(by=["chain"], order=["n"])
    ss = {r.id: r for r in X.feature("ss").compute(residues=chain, **by).collect()}
    assert (ss[1].length, ss[1].pos, ss[1].type_H, ss[3].type_E, ss[5].length) == (3.0, 2.0, 1.0, 1.0, 1.0)
    assert {r.id: (r.H, r.E, r.C) for r in X.feature("sss").compute(residues=chain).collect()}[4] == (0.0, 1.0, 0.0)
    pairs = spark.createDataFrame([("AC", 0.5), ("CD", 0.2), ("_A", 0.1)], "key string, propensity double")
    got = {r.id: round(r.duplets, 6) for r in X.feature("duplets").compute(residues=chain, table=pairs, **by).collect()}
    assert got[1] == 0.1 and got[0] == round(0.5 * (0.1 if "A" > "_" else 0.5), 6)
    three = spark.createDataFrame([("ACD", 0.7)], "key string, propensity double")
    got = {r.id: r.triplets for r in X.feature("triplets").compute(residues=chain, table=three, **by).collect()}
    assert got[1] == got[4] == 0.7 and got[2] == 0.0


def test_every_feature_has_a_name_and_columns():
    assert {"chem", "volsite", "atom_table", "residue_table", "ss", "sss", "conservation", "pair_hist", "asa", "duplets", "triplets", "stmotif"} <= set(X.names())
    assert X.header(["chem", "bfactor"])[-1] == "bfactor.bfactor"


def test_evaluation_tables(spark):
    proteins = spark.createDataFrame([("p", 10, 8, ["B", "A"]), ("q", 3, 3, ["A"])], "item string, n_atoms int, n_protein_atoms int, chains array<string>")
    ligands = spark.createDataFrame([("p", "ATP", "relevant"), ("p", "HOH", "ignored"), ("p", "GOL", "small")], "item string, name string, kind string")
    pockets = spark.createDataFrame([("p",), ("p",)], "item string")
    got = {r.name: r for r in R.protein_rows(proteins, ligands, pockets).collect()}
    assert got["p"].asDict() == dict(zip(R.PROTEINS, ("p", "10", "8", "2", "A B", "1", "2", "ATP", "1", "HOH", "1", "GOL", "0", ""), strict=True))
    assert got["q"]["#pockets"] == "0"
    lig = spark.createDataFrame([("p", "ATP", "A", "ATP", 31, 1, 1.5, 2.0, 3.0, 0.25, 9, [20, 3])], "item string, name string, chain_id string, code string, n_atoms int, dca4rank int, pocket_dist double, protein_dist double, center_dist double, sas_dist double, contacts int, atom_ids array<int>")
    assert tuple(R.ligand_rows(lig).first()) == ("p", "1", "ATP", "A", "ATP", "31", "1", "1.5000", "2.0000", "3.0000", "0.2500", "9", "3 20")
    pk = spark.createDataFrame([("p", "pocket1", None, 1, 2.5, 2, 9.0, 0.5, 0.25, 30, 2.5, 100, 12)], "item string, name string, ligand string, rank int, score double, new_rank int, old_score double, zscore double, probability double, sas_points int, raw_score double, volume int, surf_atoms int")
    assert tuple(R.pocket_rows(pk, lig).first()) == ("p", "1", "1", "pocket1", "", "1", "2.5", "2", "9.0000", "0.5000", "0.2500", "30", "2.5000", "100", "12")
    ranks = spark.createDataFrame([("p", "ATP", "DCA(4)", 1), ("p", "ATP", "DCC(5)", -1), ("p", "GTP", "DCA(4)", 2)], "item string, name string, criterion string, rank int")
    got = {r.ligand: tuple(r) for r in R.rank_rows(ranks, ["DCA(4)", "DCC(5)"]).collect()}
    assert got == {"ATP": ("p", 2, "ATP", 1, -1), "GTP": ("p", 2, "GTP", 2, -1)}
    rates = spark.createDataFrame([("DCC(5)", 0, 0.125), ("DCA(4)", 0, 0.5), ("DCA(4)", 2, 1.0)], "criterion string, tolerance int, rate double")
    assert [tuple(r) for r in R.success_table(rates, ["DCA(4)", "DCC(5)"], [0, 2]).collect()] == [("DCA(4)", "50.0", "100.0"), ("DCC(5)", "12.5", "")]
    runs = spark.createDataFrame([("AUC", 1, 0.5), ("AUC", 2, 0.7)], "name string, run int, value double")
    assert tuple(R.run_table(runs, [1, 2]).first()) == ("AUC", "0.6000", "0.1414", "23.6", "0.5000", "0.7000")


def test_classifier_text_and_lines(spark):
    m = dict(tp=3, fp=1, tn=5, fn=1, spc=5 / 6, r=0.75, npv=5 / 6, p=0.75, acc=0.8, tpx=0.6, f1=0.75, mcc=None, auc=0.9, auprc=0.8)
    text = R.classifier_text("forest", m)
    assert "N:, 10\n" in text and "obs[1] , 1,  3, 75.0%" in text and "ACC:, 0.8000\n" in text and "MCC:, \n" in text and "50.0%, 10.0%" in text
    h = spark.createDataFrame([(1, 4)], "bin long, n long")
    assert [tuple(r) for r in R.histogram_lines(h, 0.0, 1.0, 2).collect()] == [(0.0, 0), (0.5, 4)]
    curve = spark.createDataFrame([(1.0, 1.0), (0.0, 0.5)], "fpr double, tpr double")
    assert [tuple(r) for r in R.curve_lines(curve, "fpr", "tpr").collect()] == [("0.000000", "0.500000"), ("1.000000", "1.000000")]


def test_arff_and_structures(spark, tmp_path):
    v = spark.createDataFrame([(0.5, -1.0, True), (1.5, 2.0, False)], "`a.b` double, c double, y boolean")
    R.write_arff(v, str(tmp_path / "v"), ["a.b", "c"], "y")
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert {"@relation vectors", "@attribute 'a.b' numeric", "@attribute @@class@@ {0,1}", "@data", "0.5,-1.0,1", "1.5,2.0,0"} <= set(lines)
    rows = [("s", 2, "O5'", None, "ATP", "A", 5, None, 1.0, 2.0, 3.0, 1.0, 20.0, "O", True), ("s", 1, "CA", None, "GLY", "A", 4, "B", 0.5, 0.0, 0.0, 1.0, 10.0, "C", False)]
    atoms = spark.createDataFrame(rows, "item string, serial int, name string, altloc string, res_name string, chain_id string, seq_num int, ins_code string, x double, y double, z double, occupancy double, bfactor double, element string, is_het boolean")
    for form, compressed in (("cif", True), ("pdb", False)):
        R.write_structures(atoms, str(tmp_path / form), form, compressed)
        text = spark.read.text(str(tmp_path / form), wholetext=True).first().value
        lines = text.split("\n")
        assert [x.split()[1] for x in lines if x.startswith(("ATOM", "HETATM"))] == ["1", "2"]
    cif = spark.read.text(str(tmp_path / "cif"), wholetext=True).first().value.split("\n")
    assert "ATOM 1 C CA . GLY A 1 4 B 0.500 0.000 0.000 1.00 10.00 ? 4 GLY A CA 1" in cif
    assert """HETATM 2 O "O5'" . ATP A 1 5 ? 1.000 2.000 3.000 1.00 20.00 ? 5 ATP A "O5'" 1""" in cif
    dump = spark.createDataFrame([("s", 2, 0.5, "b", 0.0, 0.0, 1.0), ("s", 1, 1.5, "a", 1.0, 0.0, 0.0)], "item string, rank int, score double, name string, x double, y double, z double")
    assert [r.name for r in R.pocket_dump(dump).collect()] == ["a", "b"]
    assert len(set(R.spectrum(6))) == 6 and all(len(c) == 7 for c in R.spectrum(1))


# spatial joins where points crowd or lie far away ----------------------------------------


def cloud(spark, seed):
    r = random.Random(seed)
    rows = [(i, 0.01 * r.random(), 0.01 * r.random(), 0.0) for i in range(150)] + [(200 + i, 5 * r.random(), 5 * r.random(), 5 * r.random()) for i in range(60)] + [(300, 1e6, 0.0, 0.0), (301, -4e5, 3.0, 0.0), (302, 0.0, 0.0, 0.0), (303, 0.0, 0.0, 0.0)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(3)


def test_dense_cubes_are_dealt_in_slices(spark):
    rows, p = cloud(spark, 1)
    close = {(a[0], b[0]) for a in rows for b in rows if sum((u - v) ** 2 for u, v in zip(a[1:], b[1:], strict=True)) <= 1.0}
    for most in (4096, 20):
        got = [(r.id, r.id_r) for r in S.radius_join(p, p, 1.0, rows=most).collect()]
        assert len(got) == len(set(got)) and set(got) == close
        got = [(r.id, r.id_r) for r in S.close_pairs(p, 1.0, rows=most).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in close if a < b}


@pytest.mark.parametrize("k, r", [(1, 0.001), (5, 0.5), (200, 0.5), (400, 2.0)])
@pytest.mark.parametrize("different", [False, True])
def test_nearest_among_outliers(spark, k, r, different):
    rows, p = cloud(spark, 2)
    queries = [x for x in rows if x[0] >= 190 or x[0] < 3]
    q = p.where("id >= 190 or id < 3")
    got = {}
    for x in S.knn(q, p, k, r, different).collect():
        got.setdefault(x.id, []).append((x["rank"], x.id_r))
    for a in queries:
        d = sorted((sum((u - v) * (u - v) for u, v in zip(a[1:], b[1:], strict=True)), b[0]) for b in rows if not different or a[0] != b[0])
        assert [i for _, i in sorted(got[a[0]])] == [i for _, i in d[:k]]


def test_few_targets_and_none(spark):
    _, p = cloud(spark, 3)
    assert S.knn(p, p.where("id = 300"), 3, 1.0).count() == p.count()
    assert S.knn(p, p.where("id < 0"), 3, 1.0).count() == 0
    assert S.knn(p.where("id < 0"), p, 3, 1.0).count() == 0


@pytest.mark.parametrize("most", [1000, 30, 0])
def test_components_by_item_and_in_rounds(spark, most):
    r = random.Random(5)
    edges = [(g, 1000 * g + r.randrange(120), 1000 * g + r.randrange(120)) for g in range(3) for _ in range(25 + 30 * g)]
    nodes = [(1000 * g + k,) for g in range(3) for k in range(120)]
    label = {n: n for (n,) in nodes}
    for _ in nodes:
        for _, a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(nodes, "id long"), spark.createDataFrame(edges, "g int, a long, b long"), item="g", most=most).collect()
    assert {x.id: x.component for x in got} == label
    alone = components(spark.createDataFrame(nodes, "id long"), spark.createDataFrame([], "a long, b long"))
    assert alone.where("id <> component").count() == 0


def test_sampled_points_have_their_own_boxes(spark):
    from orrery.operators import sampling as M

    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0, "a"), (2, 100.0, 0.0, 0.0, "b")], "id long, x double, y double, z double, g string")
    none = p.where("id < 0")
    for s in ("grid", "random"):
        got = M.sampled_points(s, p, none, by="g").collect()
        assert {x.g for x in got} == {"a", "b"} and all(abs(x.x - (100 if x.g == "b" else 0)) <= 4 for x in got)
    assert M.sampled_points("atoms", p, none).columns == ["id", "x", "y", "z"]
    assert M.sampled_points("grid", p.where("id = 1"), none.withColumn("k", F.lit(1))).count() > 20
    with pytest.raises(ValueError):
        M.sampled_points("surface", p, none)


def test_nearest_within_items(spark):
    rows = [(i, "a" if i % 2 else "b", float(i), 0.0, 0.0) for i in range(20)]
    p = spark.createDataFrame(rows, "id long, item string, x double, y double, z double")
    got = {}
    for r in S.knn(p, p, 3, 1.5, different=True, item="item").collect():
        got.setdefault(r.id, []).append((r["rank"], r.id_r))
    for i, item, *_ in rows:
        want = sorted((abs(i - j), j) for j, other, *_ in rows if other == item and j != i)[:3]
        assert [x for _, x in sorted(got[i])] == [j for _, j in want]


def test_from_files_to_pockets(spark, tmp_path):
    """Two walls of atoms with a ligand between; a second file without one; a damaged third."""
    from orrery.plans import run
    from orrery.params import Params
    from orrery.sources import sinks

    def lines(item, ligand):
        at = [(x * 3.0, y * 3.0, z) for x in range(4) for y in range(4) for z in (0.0, 9.0)] + [(x * 3.0 + 40, 0.0, 0.0) for x in range(6)]
        rows = [(item, n, "CA" if n % 2 else "OD1", None, "ALA" if n % 2 else "ASP", "A", n, None, *p, 1.0, 10.0, "C" if n % 2 else "O", False) for n, p in enumerate(at, 1)]
        rows += [(item, 100 + n, "C1", None, "LIG", "A", 900, None, 3.0 + n, 4.5, 4.5, 1.0, 10.0, "C", True) for n in range(6)] * ligand
        return rows

    schema = "item string, serial int, name string, altloc string, res_name string, chain_id string, seq_num int, ins_code string, x double, y double, z double, occupancy double, bfactor double, element string, is_het boolean"
    for item, ligand in (("one.pdb", True), ("two.pdb", False)):
        text = [r.value for r in sinks.pdb_lines(spark.createDataFrame(lines(item, ligand), schema)).orderBy("serial").collect()]
        (tmp_path / item).write_text("\n".join(text) + "\nEND\n")
    (tmp_path / "bad.pdb.gz").write_bytes(b"nothing")
    enabled = ["protrusion", "bfactor", "exposed"]
    p = Params(pred_point_threshold=0.5)
    model = run.train(spark, str(tmp_path / "one.pdb"), enabled, p, trees=10, depth=4)
    got = run.predict(spark, str(tmp_path), model, enabled).orderBy("item", "rank").collect()
    assert {r.item for r in got} == {"one.pdb", "two.pdb"}
    for item in ("one.pdb", "two.pdb"):
        first = next(r for r in got if r.item == item and r["rank"] == 1)
        assert abs(first.x - 4.5) < 4 and abs(first.y - 4.5) < 4 and abs(first.z - 4.5) < 5
        assert first.sas_points > 3 and first.surf_atom_ids and all(s <= 38 for s in first.surf_atom_ids) and first.residue_ids
    assert sinks.predictions(run.predict(spark, str(tmp_path / "two.pdb"), model, enabled)).first().name.startswith("pocket")

    # residues and probabilities
    from orrery.operators.transform import probability_fit

    bins = probability_fit(spark.createDataFrame([(True, 9.0), (False, 1.0), (True, 5.0), (False, 3.0)], "obs boolean, s double"), "obs", "s", 0.0, 10.0, 5)
    whole = run.predict_all(spark, str(tmp_path / "two.pdb"), model, enabled, fits=run.Transforms(pockets=(bins, 0.0, 10.0, 5), residues=(bins, 0.0, 10.0, 5), residue_z=(1.0, 2.0)))
    residues = {r.residue_label: r for r in whole.residues.collect()}
    assert set(residues) == {str(n) for n in range(1, 39)} and all(r.zscore == (r.score - 1) / 2 and 0 <= r.probability <= 1 for r in residues.values())
    pockets = whole.pockets.collect()
    named = {r[2:]: min(k["rank"] for k in pockets if r in k.residue_ids) for k in pockets for r in k.residue_ids}
    assert {n: r.pocket for n, r in residues.items()} == {n: named.get(n, 0) for n in residues}
    points = whole.points.collect()
    inside = [q for q in points if q.score_after_pockets != q.score]
    assert inside and all(abs(q.score_after_pockets - q.score**2) < 1e-12 for q in inside)
    atoms = {a.seq_num: (a.x, a.y, a.z) for a in run.atoms_of(spark, str(tmp_path / "two.pdb")).collect()}
    reach = p.sas_cutoff + p.residue_score_extra_dist
    for n in (1, 17, 38):
        want = sum(q.score_after_pockets**2 for q in points if sum((a - b) ** 2 for a, b in zip(atoms[n], (q.x, q.y, q.z), strict=True)) <= reach * reach)
        assert abs(residues[str(n)].score - want) < 1e-9
    assert sinks.residues(whole.residues).count() == 38


def test_rescoring_another_methods_pockets(spark, tmp_path):
    """Results that put a pocket far from the site first; the model turns them round."""
    from orrery.params import Params
    from orrery.plans import run
    from orrery.sources import sinks

    kind = "item string, serial int, name string, altloc string, res_name string, chain_id string, seq_num int, ins_code string, x double, y double, z double, occupancy double, bfactor double, element string, is_het boolean"
    at = [(x * 3.0, y * 3.0, z) for x in range(4) for y in range(4) for z in (0.0, 9.0)] + [(x * 3.0 + 40, 0.0, 0.0) for x in range(6)]
    atom = lambda n, p, het=False: ("i", n, "C1" if het else "CA", None, "LIG" if het else "ALA", "A", 900 if het else n, None, *p, 1.0, 10.0, "C", het)
    rows = [atom(n, p) for n, p in enumerate(at, 1)]

    def write(path, rows):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(r.value for r in sinks.pdb_lines(spark.createDataFrame(rows, kind)).orderBy("serial").collect()))

    write(tmp_path / "in/one.pdb", rows + [atom(100 + n, (3.0 + n, 4.5, 4.5), True) for n in range(6)])
    write(tmp_path / "in/two.pdb", rows)
    for item in ("one", "two"):
        out = tmp_path / f"found/{item}_out"
        stp = lambda n, rank, x, y: f"HETATM{n:5d} APOL STP C{rank:4d}    {x:8.3f}{y:8.3f}{4.5:8.3f}  0.00  0.00          Ve"
        write(out / "pockets/pocket1_atm.pdb", rows[33:37])
        write(out / "pockets/pocket2_atm.pdb", [rows[n] for n in (10, 11, 12, 13, 18, 19, 20, 21)])
        (out / f"{item}_out.pdb").write_text("\n".join([stp(1, 1, 45.0, 3.0), stp(2, 2, 4.0, 4.0), stp(3, 2, 5.0, 5.0)]))
    enabled = ["protrusion", "bfactor"]
    model = run.train(spark, str(tmp_path / "in/one.pdb"), enabled, Params().rescoring(), trees=10, depth=4)
    got = {(r.item, r.name): r for r in run.rescore_fpocket(spark, str(tmp_path / "in"), str(tmp_path / "found"), model, enabled).collect()}
    assert got.keys() == {(f"{i}.pdb", f"pocket{n}") for i in ("one", "two") for n in (1, 2)}
    for item in ("one.pdb", "two.pdb"):
        far, site = got[item, "pocket1"], got[item, "pocket2"]
        assert (far.old_rank, far["rank"], far.change, far.bar) == (1, 2, -1, "-") and (site.old_rank, site["rank"], site.change, site.bar) == (2, 1, 1, "+")
        assert site.score > far.score and 0 <= far.raw_score < site.raw_score <= 1 and site.sas_points > 3


def test_features_at_points_and_atoms(spark):
    """Every adapter against a loop over all atoms."""
    from orrery.params import Params
    from orrery.plans import run

    r = random.Random(12)
    codes = ["HIS", "ASP", "GLY", "MSE", "LYS"]
    rows = []
    for item in ("a", "b"):
        for n in range(40):
            rows.append((item, n + 1, "CA" if n % 2 else "ND1", codes[n // 4 % 5], "A", n // 4, None, *(round(r.uniform(0, 14), 2) for _ in "xyz"), float(n % 7), "N" if n % 2 == 0 else "C", False))
    kind = "item string, serial int, name string, res_name string, chain_id string, seq_num int, ins_code string, x double, y double, z double, bfactor double, element string, is_het boolean"
    atoms = run.protein(run.numbered(spark.createDataFrame(rows, kind).repartition(4)))
    pts = run.numbered(spark.createDataFrame([(i, *(r.uniform(0, 14) for _ in "xyz")) for i in "ab" for _ in range(12)], "item string, x double, y double, z double"))
    p = Params()
    table = spark.createDataFrame([(c, *[float(k)] * 18) for k, c in enumerate(codes, 1)], "key string, " + ", ".join(f"{c} double" for c in X.CHEM_RESIDUE))
    ss = spark.createDataFrame([(x.residue, "HEG"[x.seq_num % 3]) for x in atoms.select("residue", "seq_num").distinct().collect()], "residue string, ss string")
    scores = spark.createDataFrame([(x.residue, x.seq_num / 8) for x in atoms.select("residue", "seq_num").distinct().collect()], "residue string, score double")
    enabled = ["protrusion", "protrusion_atomic", "bfactor", "bfactor_sas", "rtype_sas", "rtype_atomic", "chem", "sss_sas", "conserv_atomic", "ss_cloud", "asa", "stmotif", "contactres_sas"]
    out = run.vectors(atoms, pts, enabled, p, {"chem": table, "ss": ss, "conserv": scores})
    assert out.columns[5:] == run.columns(enabled)
    got = {x.id: x for x in out.collect()}
    at = [x for x in atoms.collect()]
    dist = lambda u, v: ((u.x - v.x) ** 2 + (u.y - v.y) ** 2 + (u.z - v.z) ** 2) ** 0.5
    points = pts.collect()
    assert len(got) == len(points)
    exposed = [a for a in at if any(q.item == a.item and dist(a, q) <= p.sas_cutoff for q in points)]
    code = lambda a: {"MSE": "MET"}.get(a.res_name, a.res_name)
    w = run.weights()[p.weight_function]
    value = {round(d, 9): v for d, v in ((x.d, x.w) for x in spark.createDataFrame([(round(dist(q, a), 9),) for q in points for a in exposed if a.item == q.item], "d double").distinct().withColumn("w", w(F.col("d"))).collect())}
    for q in points:
        mine = got[q.id]
        near = [a for a in exposed if a.item == q.item and dist(a, q) <= p.neighbourhood_radius]
        total = lambda f: sum(value[round(dist(q, a), 9)] * f(a) for a in near)  # noqa: B023, E731
        assert mine.bfactor_bfactor == pytest.approx(total(lambda a: a.bfactor)) and mine.rtype_atomic_HIS == pytest.approx(total(lambda a: code(a) == "HIS"))
        assert mine.conserv_atomic_conserv == pytest.approx(total(lambda a: a.seq_num / 8))
        assert mine.protrusion_atomic_protrusion == pytest.approx(total(lambda a: sum(b.item == a.item and dist(a, b) <= 10 for b in at)))
        assert mine.protrusion_protrusion == sum(a.item == q.item and dist(a, q) <= 10 for a in at)
        assert mine.chem_atoms == len(near) and mine.chem_polar == pytest.approx(total(lambda a: codes.index(a.res_name) + 1))
        one = min((a for a in at if a.item == q.item), key=lambda a: (dist(a, q), a.id))
        assert mine[f"rtype_sas_{code(one)}"] == 1.0 and mine.sss_sas_H == float("HEG"[one.seq_num % 3] in "HG")
        if exposed and any(a.item == q.item for a in exposed):
            assert mine.bfactor_sas_bfactor == min((a for a in exposed if a.item == q.item), key=lambda a: (dist(a, q), a.id)).bfactor
    for bad in ("rtype", "xyz_sas", "bfactor_atomic", "nothing", "nothing_sas"):
        with pytest.raises(ValueError):
            run.vectors(atoms, pts, [bad], p)
    with pytest.raises(ValueError):
        run.vectors(atoms, pts, ["ss_cloud"], p)


def test_points_of_decoys(spark):
    """True pockets give positives only; of the false ones the first give negatives, and positives too."""
    from orrery.params import Params
    from orrery.plans import run

    p = Params(positive_point_ligand_distance=2.0, neutral_points_margin=3.0, train_pockets=1)
    xyz = "x double, y double, z double"
    points = spark.createDataFrame([("i", n, float(n), 0.0, 0.0) for n in range(12)] + [("j", 50, 0.0, 0.0, 0.0)], f"item string, id long, {xyz}")
    pockets = spark.createDataFrame([("i", 1, 1, 9.0, 0.0, 0.0), ("i", 2, 2, 1.0, 0.0, 0.0), ("i", 3, 3, 11.0, 0.0, 0.0), ("j", 4, 1, 0.0, 0.0, 0.0)], f"item string, pocket long, rank int, {xyz}")
    members = spark.createDataFrame([("i", 1, n) for n in (1, 7, 8, 9)] + [("i", 2, n) for n in (0, 1, 2, 3, 8)] + [("i", 3, 11), ("j", 4, 50)], "item string, pocket long, id long")
    ligand = spark.createDataFrame([("i", 0.0, 0.0, 0.0)], f"item string, {xyz}")
    got = {(r.pocket, r.id, r.near) for r in run.pocket_labelled(points, members, pockets, ligand, p).collect()}
    assert got == {(1, 1, 1), (1, 7, 0), (1, 8, 0), (1, 9, 0), (2, 0, 1), (2, 1, 1), (2, 2, 1), (4, 50, 0)}


def test_structures_looked_at_without_their_ligands(spark):
    from orrery.plans import run

    atoms = spark.createDataFrame([("h", 1), ("x", 2), ("p", 3)], "item string, id long")
    ligands = spark.createDataFrame([("h", 7), ("x", 8)], "item string, serial int")
    own, moved = run.paired(atoms, ligands, spark.createDataFrame([("h", "p")], "item string, apo string"))
    assert {r.item for r in own.collect()} == {"x", "p"} and {(r.item, r.serial) for r in moved.collect()} == {("p", 7), ("x", 8)}


def test_ablation_runs(spark):
    from orrery.plans import run

    r = random.Random(1)
    rows = [(n, r.random(), r.random(), n % 2) for n in range(200)]
    data = spark.createDataFrame([(n, a + y, b, y) for n, a, b, y in rows], "id long, protrusion_protrusion double, bfactor_bfactor double, y int")
    got = run.ablations(data, ["protrusion", "bfactor"], "each", "y", k=2, trees=5, depth=3).collect()
    assert [x.features for x in got] == ["protrusion", "bfactor"] and got[0].auprc > got[1].auprc


# binary mmCIF ----------------------------------------------------------------------------


def packed(v):
    """A MessagePack document."""
    import struct

    if v is None or isinstance(v, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[v]
    if isinstance(v, int):
        return struct.pack("B", v) if 0 <= v < 128 else b"\xd3" + struct.pack(">q", v)
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        raw = v.encode()
        return (bytes([0xA0 + len(raw)]) if len(raw) < 32 else b"\xda" + struct.pack(">H", len(raw))) + raw
    if isinstance(v, bytes):
        return b"\xc6" + struct.pack(">I", len(v)) + v
    if isinstance(v, list):
        return (bytes([0x90 + len(v)]) if len(v) < 16 else b"\xdc" + struct.pack(">H", len(v))) + b"".join(map(packed, v))
    return b"\xde" + struct.pack(">H", len(v)) + b"".join(packed(k) + packed(x) for k, x in v.items())


def integers(values, kind=3):
    import numpy as np

    from orrery.sources import bcif

    return {"data": np.array(values, bcif.TYPES[kind]).tobytes(), "encoding": [{"kind": "ByteArray", "type": kind}]}


def texts(values):
    words = sorted(set(values))
    ends = [0]
    for w in words:
        ends.append(ends[-1] + len(w))
    at = integers([words.index(v) for v in values])
    places = integers(ends)
    one = {"kind": "StringArray", "dataEncoding": at["encoding"], "stringData": "".join(words), "offsetEncoding": places["encoding"], "offsets": places["data"]}
    return {"data": at["data"], "encoding": [one]}


def test_binary_structures(spark, tmp_path):
    import gzip

    from orrery.sources import structures

    n = 40
    x, serial = [1.5 * k - 7.125 for k in range(n)], list(range(100, 100 + n))
    small = []
    for v in (round(a * 1000) for a in x):
        while abs(v) >= 127 and v not in (127, -128):
            small.append(127 if v > 0 else -128)
            v -= small[-1]
        small += [v] if v not in (127, -128) else [v, 0]
    packing = {"kind": "IntegerPacking", "byteCount": 1, "isUnsigned": False, "srcSize": n}
    columns = {
        "id": {"data": integers([100] + [1] * (n - 1))["data"], "encoding": [{"kind": "Delta", "origin": 0, "srcType": 3}, *integers([])["encoding"]]},
        "Cartn_x": {"data": integers(small, 1)["data"], "encoding": [{"kind": "FixedPoint", "factor": 1000, "srcType": 33}, packing, *integers([], 1)["encoding"]]},
        "Cartn_y": {"data": integers(range(n), 4)["data"], "encoding": [{"kind": "IntervalQuantization", "min": 0.0, "max": 39.0, "numSteps": 40, "srcType": 33}, *integers([], 4)["encoding"]]},
        "Cartn_z": integers([2.5] * n, 33), "pdbx_PDB_model_num": {"data": integers([1, n])["data"], "encoding": [{"kind": "RunLength", "srcType": 3, "srcSize": n}, *integers([])["encoding"]]},
        "auth_atom_id": texts(["CA" if k % 2 else "N" for k in range(n)]), "auth_comp_id": texts(["GLY"] * n), "auth_asym_id": texts(["A"] * n), "auth_seq_id": integers(range(n)),
        "type_symbol": texts(["C" if k % 2 else "N" for k in range(n)]), "group_PDB": texts(["HETATM" if k > 30 else "ATOM" for k in range(n)]), "label_alt_id": texts(["B"] * n),
    }
    masks = {"label_alt_id": integers([0 if k == 5 else 1 for k in range(n)], 4)}
    table = {"name": "_atom_site", "rowCount": n, "columns": [{"name": k, "data": v, "mask": masks.get(k)} for k, v in columns.items()]}
    doc = packed({"encoder": "test", "version": "0.3", "dataBlocks": [{"header": "X", "categories": [{"name": "_entry", "rowCount": 0, "columns": []}, table]}]})
    (tmp_path / "a.bcif").write_bytes(doc)
    (tmp_path / "b.bcif.gz").write_bytes(gzip.compress(doc))
    (tmp_path / "c.bcif").write_bytes(doc[:300])
    got = structures.read_structures(spark, str(tmp_path)).orderBy("item", "serial").collect()
    assert [r.item for r in got] == ["a.bcif"] * n + ["b.bcif.gz"] * n
    for k, r in enumerate(got[:n]):
        assert (r.serial, r.model, r.z, r.res_name, r.seq_num, r.is_het, r.altloc) == (serial[k], 0, 2.5, "GLY", k, k > 30, "B" if k == 5 else None)
        assert abs(r.x - x[k]) < 1e-9 and abs(r.y - k) < 1e-9 and r.name == ("CA" if k % 2 else "N") and r.element == r.name[0]
    assert [r.path.rsplit("/", 1)[1] for r in structures.read_errors(spark, str(tmp_path)).collect()] == ["c.bcif"]
