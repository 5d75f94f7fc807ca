"""The data source for structure files, as a batch and as a stream."""

import gzip
import time

import pytest
from pyspark.sql import functions as F

from orrery.sources import datasource, structures


def line(kind, serial, chain, x, model_het="ALA"):
    return f"{kind:<6}{serial:5d}  CA  {model_het} {chain}{serial:4d}    {x:8.3f}{0:8.3f}{0:8.3f}  1.00 10.00           C"


CIF = "data_x\nloop_\n" + "".join(f"_atom_site.{c}\n" for c in ("group_PDB", "id", "type_symbol", "auth_atom_id", "auth_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z")) + "ATOM 1 C CA ALA A 1 1 2 3\nHETATM 2 O O HOH B 2 4 5 6\n#\n"


@pytest.fixture
def folder(tmp_path):
    two = ["MODEL        1", line("ATOM", 1, "A", 1), line("ATOM", 2, "B", 2), line("HETATM", 3, "A", 3), "ENDMDL", "MODEL        2", line("ATOM", 1, "A", 9), "ENDMDL"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdb").write_text("\n".join(two))
    (tmp_path / "in/sub").mkdir()
    (tmp_path / "in/sub/b.ent.gz").write_bytes(gzip.compress(line("ATOM", 5, "A", 5).encode()))
    (tmp_path / "in/c.cif").write_text(CIF)
    (tmp_path / "in/bad.pdb.gz").write_bytes(b"nothing")
    (tmp_path / "in/notes.txt").write_text(line("ATOM", 1, "A", 1))
    return tmp_path / "in"


def test_rows_are_those_of_the_reader(spark, folder):
    datasource.register(spark)
    got = spark.read.format("structures").load(str(folder))
    want = structures.read_structures(spark, str(folder / "*.*")).where("item <> 'notes.txt'").unionByName(structures.read_structures(spark, str(folder / "sub/*")))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert got.schema == want.schema and rows(got) == rows(want) and got.count() == 7


def test_filters_reach_the_reader(spark, folder):
    datasource.register(spark)
    df = spark.read.format("structures").load(str(folder))
    one = df.where("chain_id = 'A' and model = 0 and not is_het")
    assert {(r.item, r.serial) for r in one.collect()} == {("a.pdb", 1), ("b.ent.gz", 5), ("c.cif", 1)}
    assert {(r.item, r.serial) for r in df.where("is_het = true and chain_id in ('A', 'B')").collect()} == {("a.pdb", 3), ("c.cif", 2)}
    # the reader's rows, counted below any filter of Spark's
    for condition, rows in (("chain_id = 'B'", 2), ("model = 1", 1), ("item = 'b.ent.gz'", 1), ("item in ('c.cif', 'a.pdb') and chain_id = 'A'", 4), ("x > 4.5 and chain_id = 'A'", 2)):
        plan = df.where(condition)
        assert plan.count() == rows
        assert ("Filter" in plan._jdf.queryExecution().optimizedPlan().toString()) == ("x >" in condition)


def test_partitions(folder):
    r = datasource.StructureReader(str(folder), 1)
    assert len(r.partitions()) == 4
    r = datasource.StructureReader(f"file://{folder}", 1 << 20)
    assert [len(p.paths) for p in r.partitions()] == [4]
    assert [r for p in datasource.StructureReader(str(folder / "none"), 5).partitions() for r in p.paths] == []
    one = datasource.StructureReader(str(folder / "a.pdb"), 5)
    assert sum(1 for p in one.partitions() for _ in one.read(p)) == 4


def test_stream_reads_each_file_once(spark, folder, tmp_path):
    datasource.register(spark)
    stream = spark.readStream.format("structures").load(str(folder))
    run = lambda: stream.select("item", "serial", "model").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert run().awaitTermination(120)
    out = lambda: spark.read.parquet(str(tmp_path / "out"))
    assert out().count() == 7
    time.sleep(0.02)
    (folder / "d.pdb").write_text("\n".join(line("ATOM", n, "A", n) for n in range(1, 4)))
    assert run().awaitTermination(120)
    assert out().count() == 10 and out().groupBy("item").count().where(F.col("item") == "d.pdb").first()["count"] == 3
    assert run().awaitTermination(120)
    assert out().count() == 10


def test_a_path_is_asked_for(spark):
    datasource.register(spark)
    with pytest.raises(Exception, match="path"):
        spark.read.format("structures").load().count()
