"""Reports and areas on a small structure."""

import math

import pytest

from orrery.functions import features as X
from orrery.operators import sampling as M
from orrery.params import Params
from orrery.plans import analyze
from orrery.sources import structures
from tests.test_sources import PDB


@pytest.fixture(scope="module")
def atoms(spark, tmp_path_factory):
    f = tmp_path_factory.mktemp("pdb") / "a.pdb"
    f.write_text(PDB)
    return structures.read_structures(spark, str(f))


def test_reports(atoms):
    res = structures.residues(atoms)
    assert {(r.chain_id, r.n_residues) for r in analyze.chains(res).collect()} == {("A", 2), ("B", 1)}
    assert {(r.chain_id, r.seq) for r in analyze.chain_sequences(res).collect()} == {("A", "AM"), ("B", "G")}
    near = analyze.binding_residues(atoms.where("not is_het"), structures.hetero(atoms), 2.0)
    assert [(r.chain_id, r.seq_num, r.ins_code) for r in near.collect()] == [("A", 2, None), ("B", 1, "A")] or {r.res_name for r in near.collect()} == {"MSE", "GLY"}
    lab = analyze.labelled_residues(res, near)
    assert {(r.res_name, r.binding) for r in lab.collect()} == {("ALA", False), ("MSE", True), ("GLY", True)}
    assert {(r.aa, r.pos, r.neg) for r in analyze.propensities(lab).collect()} == {("A", 0, 1), ("M", 1, 0), ("G", 1, 0)}
    assert {r.duplet for r in analyze.pair_propensities(lab).collect()} == {"A_", "AM", "M_", "G_"} or analyze.pair_propensities(lab).count() == 4
    assert analyze.pair_propensities(lab, triplets=True).count() == 3


def test_area_of_a_single_atom(spark):
    one = spark.createDataFrame([("i", 0, 1, "C", None, "ALA", "A", 1, None, 0.0, 0.0, 0.0, 1.0, 1.0, "C", False)], structures.SCHEMA)
    s = structures.surface_points(one)
    assert s.count() == 42
    assert math.isclose(X.atom_areas(one).first().asa, 4 * math.pi * 3.3**2, rel_tol=1e-9)


def test_sampling_strategies(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    far = spark.createDataFrame([(2, 50.0, 0.0, 0.0)], "id long, x double, y double, z double")
    for s in ("grid", "random"):
        got = M.sampled_points(s, p, far).collect()
        assert got and all(r.x**2 + r.y**2 + r.z**2 <= 16 + 1e-9 for r in got)
    with pytest.raises(ValueError):
        M.sampled_points("nothing", p, far)


def test_balancing(spark):
    df = spark.range(1000).selectExpr("id", "id % 10 = 0 AS pos")
    n = M.balanced(df, "id", "pos", 0.5).selectExpr("sum(int(pos)) AS p", "sum(int(not pos)) AS n").first()
    assert n.n == 900 and abs(n.p - 450) < 60
    n = M.balanced(df, "id", "pos", 0.5, supersample=False).selectExpr("sum(int(pos)) AS p", "sum(int(not pos)) AS n").first()
    assert n.p == 100 and abs(n.n - 200) < 50
    assert M.balanced(df, "id", "pos", 1 / 9).count() == 1000


def test_description():
    assert "  folds = 5" in analyze.described(["chem.a"], Params())
