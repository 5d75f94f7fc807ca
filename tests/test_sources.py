"""Readers and writers on small hand-written files."""

import gzip

import pytest
from pyspark.sql import functions as F

from orrery.sources import datasets, pockets, sinks, structures, tables

PDB = """\
HEADER    TEST
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00 10.00           N
ATOM      2  CA  ALA A   1      11.639   6.071  -5.147  1.00 11.50           C
ATOM      3  HA  ALA A   1      12.000   6.500  -5.000  1.00 11.50           H
ATOM      4  N   MSE A   2      13.104   6.134  -6.504  1.00 10.00           N
ATOM      5  CA  GLY B   1A     15.104   6.134  -6.504  1.00 10.00           C
TER       6      GLY B   1A
HETATM    7  C1  LIG B 201      14.000   7.000  -6.000  1.00 20.00           C
HETATM    8  C2  LIG B 201      14.500   7.500  -6.000  1.00 20.00           C
HETATM    9  O   HOH B 301       1.000   1.000   1.000  1.00 20.00           O
END
"""
CIF = """\
data_TEST
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.auth_atom_id
_atom_site.label_alt_id
_atom_site.auth_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.B_iso_or_equiv
_atom_site.pdbx_PDB_model_num
ATOM 1 N N . ALA A 1 ? 11.104 6.134 -6.504 1.00 10.00 1
ATOM 2 C CA . ALA A 1 ? 11.639 6.071 -5.147 1.00 11.50 1
ATOM 3 H HA . ALA A 1 ? 12.000 6.500 -5.000 1.00 11.50 1
ATOM 4 N N . MSE A 2 ? 13.104 6.134 -6.504 1.00 10.00 1
ATOM 5 C CA . GLY B 1 A 15.104 6.134 -6.504 1.00 10.00 1
HETATM 7 C C1 . LIG B 201 ? 14.000 7.000 -6.000 1.00 20.00 1
HETATM 8 C "C2" . LIG B 201 ? 14.500 7.500 -6.000 1.00 20.00 1
HETATM 9 O O . HOH B 301 ? 1.000 1.000 1.000 1.00 20.00 1
#
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("structures")
    (d / "a.pdb").write_text(PDB)
    (d / "b.pdb.gz").write_bytes(gzip.compress(PDB.encode()))
    (d / "c.cif").write_text(CIF)
    (d / "bad.pdb.gz").write_bytes(b"not gzip")
    return d


def test_formats_agree(spark, files):
    atoms = structures.read_structures(spark, str(files)).drop("altloc").collect()
    by = {i: sorted((r.serial, r.name, r.res_name, r.chain_id, r.seq_num, r.ins_code, r.x, r.y, r.z, r.bfactor, r.element, r.is_het) for r in atoms if r.item == i) for i in ("a.pdb", "b.pdb.gz", "c.cif")}
    assert by["a.pdb"] == by["b.pdb.gz"] == by["c.cif"] and len(by["a.pdb"]) == 8
    assert by["a.pdb"][4][5] == "A"


def test_bad_file_is_reported(spark, files):
    assert [r.path.rsplit("/", 1)[1] for r in structures.read_errors(spark, str(files)).collect()] == ["bad.pdb.gz"]


def test_atom_filters(spark, files):
    atoms = structures.read_structures(spark, str(files / "a.pdb"))
    assert structures.heavy(atoms).count() == 7
    assert {r.name for r in structures.hetero(atoms).collect()} == {"C1", "C2"}
    assert [(r.res_name, r.category) for r in structures.ligands(atoms).collect()] == [("LIG", "small")]
    assert [(r.chain_id, r.res_name, r.pos_in_chain) for r in structures.residues(atoms).orderBy("chain_id", "pos_in_chain").collect()] == [("A", "ALA", 1), ("A", "MSE", 2), ("B", "GLY", 1)]
    items = spark.createDataFrame([("a.pdb", ["B"])], "item string, chains array<string>")
    assert structures.reduced_to_chains(atoms, items).count() == 4
    assert structures.first_model(atoms).count() == 8


def test_surface_points(spark, files):
    atoms = structures.read_structures(spark, str(files / "a.pdb")).where("not is_het")
    p = structures.surface_points(atoms).collect()
    a = [(r.serial, r.x, r.y, r.z, {"C": 1.7, "N": 1.55}[r.element] + 1.6) for r in structures.heavy(atoms).collect()]
    assert p
    for q in p:
        for serial, x, y, z, radius in a:
            d = ((q.x - x) ** 2 + (q.y - y) ** 2 + (q.z - z) ** 2) ** 0.5
            assert abs(d - radius) < 1e-6 if serial == q.serial else d > radius - 1e-6


def test_dataset_file(spark, tmp_path):
    f = tmp_path / "x.ds"
    f.write_text("# comment\nPARAM.PREDICTION_METHOD=fpocket\nHEADER: protein chains ligands\n\na/1.pdb A,B GTP[group_id:B_1173],ATP # x\nb/2.pdb * MG[contact_res_ids:A_1,A_2]\n")
    d = datasets.read_dataset(spark, str(f))
    rows = d.items.orderBy("line_no").collect()
    assert d.params == {"PREDICTION_METHOD": "fpocket"} and d.header == ["protein", "chains", "ligands"]
    assert rows[0].chains == ["A", "B"] and rows[1].chains is None
    assert rows[0].ligands == ["GTP[group_id:B_1173]", "ATP"] and rows[1].ligands == ["MG[contact_res_ids:A_1,A_2]"]
    assert datasets.joined(spark, f"{f}+{f}").items.count() == 4
    (tmp_path / "empty.ds").write_text("# nothing\n")
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, str(tmp_path / "empty.ds"))


def lines(spark, item, text):
    return spark.createDataFrame([(item, n, v) for n, v in enumerate(text.splitlines())], "item string, line_no long, value string")


def test_pocket_readers(spark):
    s = pockets.sitehound(lines(spark, "i", "1 -50.5 100 1.0 2.0 3.0\n2 -10 20 4 5 6\n"), limit=1).collect()
    assert [(r.name, r.score, r.x) for r in s] == [("pocket1", 50.5, 1.0)]
    stp = "\n".join(f"HETATM{n:5d}  POL STP C{p:4d}    {x:8.3f}{0:8.3f}{0:8.3f}  0.00  0.00          Ve" for n, p, x in ((1, 1, 1.0), (2, 1, 3.0), (3, 2, 9.0)))
    f = pockets.fpocket(lines(spark, "i", stp)).orderBy("rank").collect()
    assert [(r.rank, r.x, r.vertices) for r in f] == [(1, 2.0, 2), (2, 9.0, 1)]
    h = pockets.header_stats(lines(spark, "i", "HEADER 0  - Pocket Score                      : 0.6703\nHEADER 1  - Drug Score : -0.5"))
    assert {r.label: r.value for r in h.collect()} == {"pocket score": 0.6703, "drug score": -0.5}
    lise = "HETATM    1  C   LIG A   1       1.000   2.000   3.000  1.00  0.00           C 7.5"
    assert pockets.lise(lines(spark, "i", lise)).first().score == 7.5
    with pytest.raises(ValueError):
        pockets.loader("nothing")


def _atom_line(kind, serial, name, res, seq, x):
    return f"{kind:<6}{serial:5d} {name:<4} {res:>3} C{seq:4d}    {x:8.3f}{0:8.3f}{0:8.3f}  0.00  0.00          C"


def _cif(rows):
    head = "data_x\nloop_\n" + "".join(f"_atom_site.{c}\n" for c in ("group_PDB", "id", "type_symbol", "auth_atom_id", "auth_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z"))
    return head + "".join(f"{k} {s} C {n} {r} C {q} {x} 0 0\n" for k, s, n, r, q, x in rows) + "#\n"


def test_fpocket_folders(spark, tmp_path):
    """Two results, one of an old version in PDB and one in mmCIF, with the same serial numbers."""
    a, b = tmp_path / "a_out", tmp_path / "b_out"
    for f in (a, b):
        (f / "pockets").mkdir(parents=True)
    own = [("ATOM", n, "CA", "ALA", n, float(10 * n)) for n in range(1, 6)]
    stp = lambda *at: [("HETATM", 90 + k, "APOL", "STP", p, x) for k, (p, x) in enumerate(at)]
    pdb = lambda rows: "\n".join(_atom_line(*r) for r in rows)
    (a / "a_out.pdb").write_text(pdb(own + stp((1, 1.0), (1, 3.0), (2, 9.0))).replace("HETATM   91", "HETATM1975f"))
    (a / "pockets/pocket0_atm.pdb").write_text(pdb(own[:2]))
    (a / "pockets/pocket1_atm.pdb").write_text(pdb([own[2], ("ATOM", 77, "CB", "ALA", 9, 0.0)]))
    (b / "b_out.cif").write_text(_cif(own + stp((1, 20.0))))
    (b / "pockets/pocket1_atm.cif").write_text(_cif(own[3:]))
    atoms = structures.read_structures(spark, str(tmp_path / "*_out/*_out.*"))
    found = {(r.item, r.rank, r.x, r.vertices) for r in pockets.fpocket_pockets(pockets.fpocket_vertices(atoms)).collect()}
    assert found == {("a_out.pdb", 1, 2.0, 2), ("a_out.pdb", 2, 9.0, 1), ("b_out.cif", 1, 20.0, 1)}
    of = pockets.fpocket_atoms(atoms, structures.read_structures(spark, str(tmp_path / "*_out/pockets/*"), parts=3))
    assert {tuple(r) for r in of.collect()} == {("a_out.pdb", 1, 1), ("a_out.pdb", 1, 2), ("a_out.pdb", 2, 3), ("b_out.cif", 1, 4), ("b_out.cif", 1, 5)}
    surface = spark.createDataFrame([("a_out.pdb", n, float(x), 0.0, 0.0) for n, x in enumerate((1.5, 12.0, 31.0, 60.0))] + [("b_out.cif", 9, 12.0, 0.0, 0.0)], "item string, id long, x double, y double, z double")
    points = pockets.fpocket_points(surface, of.join(atoms, ["item", "serial"]), pockets.fpocket_vertices(atoms), 2.5, 1.0)
    assert {tuple(r) for r in points.collect()} == {("a_out.pdb", 1, 0), ("a_out.pdb", 1, 1), ("a_out.pdb", 2, 2)}


def test_surface_grows_until_it_is_met(spark):
    kind = "item string, rank int, x double, y double, z double"
    grid = spark.createDataFrame([("i", 1, 0.0, 0.0, 0.0), ("i", 2, 100.0, 0.0, 0.0), ("i", 3, 300.0, 0.0, 0.0), ("j", 1, 0.0, 0.0, 0.0)], kind)
    exposed = spark.createDataFrame([("i", 1, 4.0, 0.0, 0.0), ("i", 2, 4.5, 0.0, 0.0), ("i", 3, 106.3, 0.0, 0.0), ("i", 4, 107.0, 0.0, 0.0), ("i", 5, 107.1, 0.0, 0.0), ("i", 6, 309.5, 0.0, 0.0)], "item string, id long, x double, y double, z double")
    assert {tuple(r) for r in pockets.growing_surface(grid, exposed).collect()} == {("i", 1, 1), ("i", 2, 3), ("i", 2, 4)}


def test_puresnet_keeps_proteins_apart(spark):
    line = _atom_line("ATOM", 1, "CA", "ALA", 1, 5.0)
    rows = [("out/p/00_pkt.pdb", line), ("out/p/01_pkt.pdb", line), ("out/q/00_pkt.pdb", line), ("out/q/without_clus_pkt.pdb", line), ("02_pkt.pdb", line)]
    got = pockets.puresnet(spark.createDataFrame(rows, "item string, value string")).collect()
    assert {(r.item, r.rank, r.file) for r in got} == {("p", 1, "00_pkt.pdb"), ("p", 2, "01_pkt.pdb"), ("q", 1, "00_pkt.pdb"), ("prediction", 1, "02_pkt.pdb")}


def test_tables(spark, tmp_path):
    c = tables.conservation(lines(spark, "i", "# h\n0\t0.5\tA\n1\t-1000\tC\n2\t0.1\t-"))
    assert [(r.pos, r.score, r.letter) for r in c.orderBy("pos").collect()] == [(0, 0.5, "A"), (1, 0.0, "C")]
    (tmp_path / "p.csv").write_text("# c\nkey, a, b\nALA.CA, 1.5, x\nGLY.N, -2, 3\n")
    t = tables.property_table(spark, str(tmp_path / "p.csv"))
    assert {r.key: (r.a, r.b) for r in t.collect()} == {"ALA.CA": (1.5, None), "GLY.N": (-2.0, 3.0)}
    (tmp_path / "i.txt").write_text("H X1\nD first\nI    A/L\n" + " ".join(f"{v}.0" for v in range(10)) + "\n" + " ".join(["NA"] + [f"{v}.5" for v in range(9)]) + "\n//\n")
    a = {r.letter: r.value for r in tables.aa_index(spark, str(tmp_path / "i.txt")).collect()}
    assert a["A"] == 0.0 and a["R"] == 1.0 and a["L"] is None and a["V"] == 8.5 and len(a) == 20
    (tmp_path / "g.cube").write_text("t\nt\n1 0.0 0.0 0.0\n2 0.5 0 0\n2 0 0.5 0\n2 0 0 0.5\n1 0 0 0 0\n0 1 2 3\n4 5 6 7\n")
    g = {(r.ix, r.iy, r.iz): r.value for r in tables.cube(spark, str(tmp_path / "g.cube")).collect()}
    assert g[1, 0, 1] == 5.0 and g[0, 1, 1] == 3.0 and len(g) == 8
    s = tables.sprint_labels(lines(spark, "i", ">1abcA\nMKV\n011\n")).orderBy("pos").collect()
    assert [(r.letter, r.label) for r in s] == [("M", 0), ("K", 1), ("V", 1)]
    ter = tables.ter_groups(lines(spark, "i", "HETATM    7  C\nTER\nHETATM    8  C\n"))
    assert [(r.serial, r.ligand) for r in ter.orderBy("serial").collect()] == [(7, 0), (8, 1)]


def test_alignment(spark):
    chains = spark.createDataFrame([("i", "A", "ACDE"), ("i", "B", "AC")], "item string, chain_id string, seq string")
    scores = spark.createDataFrame([("i", "A", "ADE", [1.0, 2.0, 3.0]), ("i", "B", "AC", [5.0, 6.0])], "item string, chain_id string, seq string, values array<double>")
    got = {(r.chain_id, r.pos): r.score for r in tables.aligned_scores(chains, scores).collect()}
    assert got == {("A", 1): 1.0, ("A", 2): 0.0, ("A", 3): 2.0, ("A", 4): 3.0, ("B", 1): 5.0, ("B", 2): 6.0}


def test_alignment_against_the_whole_table():
    import random

    from orrery.functions.alignment import pairs

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
        to, i, j = [-1] * len(a), len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                to[i] = j
            elif t[i][j - 1] > t[i - 1][j]:
                j -= 1
            else:
                i -= 1
        return to

    r = random.Random(4)
    for _ in range(400):
        a, b = ("".join(r.choice("ACDE") for _ in range(r.randrange(30))) for _ in "ab")
        assert pairs(a, b) == (list(range(len(a))) if a == b else plain(a, b))
    long = "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(20_000))
    other = "".join(c for c in long if r.random() < 0.9)
    found = [(i, j) for i, j in enumerate(pairs(long, other)) if j >= 0]
    assert len(found) == len(other) and all(long[i] == other[j] for i, j in found)


def test_csv_features(spark, tmp_path):
    (tmp_path / "r.csv").write_text('"chain","ins. code","seq. code","#note","v"\n"A","","1","x","0.5"\n')
    kind, t = tables.csv_features(spark, str(tmp_path / "r.csv"))
    rows = spark.createDataFrame([("A", None, 1), ("A", "B", 1)], "chain_id string, ins_code string, seq_num int")
    got = {r.ins_code: r.v for r in tables.with_csv_features(rows, kind, t).collect()}
    assert kind == "residue" and got == {None: 0.5, "B": 0.0}


def test_writers(spark, files):
    atoms = structures.read_structures(spark, str(files / "a.pdb"))
    out = [r.value for r in sinks.pdb_lines(atoms).orderBy("serial").collect()]
    want = [v for v in PDB.splitlines() if v[:6] in ("ATOM  ", "HETATM")]
    assert [v.rstrip() for v in out] == [v.rstrip() for v in want]
    seqs = spark.createDataFrame([("x", "AB?C")], "name string, seq string")
    assert sinks.fasta(seqs, F.col("name"), masked=True).first().value == ">x\nAXXC"
    p = spark.createDataFrame([("i", "pocket1", 1, 3.14159, 0.5, 10, [10, 9], ["A_10", "A_9"], 1.0, 2.0, 3.0)], "item string, name string, rank int, score double, probability double, sas_points int, surf_atom_ids array<int>, residue_ids array<string>, x double, y double, z double")
    r = sinks.predictions(p).first()
    assert (r.score, r.probability, r.surf_atom_ids, r.residue_ids, r.center_x) == ("3.14", "0.500", "9 10", "A_10 A_9", "1.0000")
    assert "select pocket1, id 9+10" in sinks.pymol_script("a.pdb", [{"name": "pocket1", "rank": 1, "surf_atom_ids": [10, 9]}])
