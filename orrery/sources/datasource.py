"""Structure files as a data source: ``spark.read.format("structures").load(path)``, and as a stream.

Files are listed once and packed into partitions of about ``partitionBytes``; a task opens, unpacks and
parses its files one after the other. Filters on item, chain_id, model and is_het that compare with values reach the
reader: files are skipped by their name, and lines before they are made into rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from orrery.sources import bcif, structures

NAME = "structures"
#: Columns whose filters the reader applies itself.
PUSHED = ("item", "chain_id", "model", "is_het")
#: The conf under which Spark hands filters to data sources in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_SUFFIXES = (".pdb", ".ent", ".cif", ".bcif")


@dataclass
class Files(InputPartition):
    paths: list[str]
    size: int = 0


@dataclass
class Wanted:
    """The values that pushed filters leave for each column, and the columns that may not be null."""

    values: dict[str, set] = field(default_factory=dict)
    solid: set[str] = field(default_factory=set)

    def push(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                these = set(f.value) if isinstance(f, In) else {f.value}
                name = f.attribute[0]
                self.values[name] = self.values[name] & these if name in self.values else these
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.solid.add(f.attribute[0])
            else:
                yield f

    def has(self, name: str, value) -> bool:
        return (name not in self.values or value in self.values[name]) and (value is not None or name not in self.solid)


def _system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _found(path: str) -> list[tuple[int, str, int]]:
    """(time, path, size) of the structure files at a path: a file, or a folder with all below it."""
    from pyarrow import fs

    system, at = _system(path)
    info = system.get_file_info(at)
    infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    kept = [i for i in infos if i.type == fs.FileType.File and any(s in i.base_name for s in _SUFFIXES) and not i.base_name.startswith((".", "_"))]
    return sorted((i.mtime_ns or 0, i.path, i.size or 0) for i in kept)


def _packed(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    out: list[Files] = []
    for _, path, size in files:
        if not out or out[-1].size + size > most:
            out.append(Files([]))
        out[-1].paths.append(path)
        out[-1].size += size
    return out


def _pdb_values(item: str, model: int, line: str) -> tuple:
    kinds = {"int": int, "double": float, "float": float}
    kind = lambda name: structures.serial_of if name == "serial" else kinds[structures._KINDS[name]]
    out: dict = {}
    for name, (start, width) in structures.PDB_FIELDS.items():
        text = line[start - 1 : start - 1 + width].strip()
        try:
            out[name] = (kind(name)(text) if name in structures._KINDS else text) if text else None
        except ValueError:
            out[name] = None
    out["element"] = (out["element"] or next((c for c in out["name"] or "" if c.isalpha()), "")).upper()
    return item, model, *(out[n] for n in structures.PDB_FIELDS), line.startswith("HETATM")


def _atoms(system, path: str, want: Wanted) -> Iterator[tuple]:
    """Rows of a file; one that can't be read gives none."""
    name = path.rsplit("/", 1)[-1]
    try:
        with system.open_input_stream(path, compression=None) as f:
            raw = structures.decompressed(name, f.read())
        if ".bcif" in name:
            rows = (structures._atom(name, v) for v in bcif.rows(raw))
        elif ".cif" in name:
            rows = structures._cif_rows(raw.decode("utf-8", "replace"), name)
        else:
            lines = structures._pdb_rows(raw.decode("utf-8", "replace"), name)
            # what is not wanted is told by single columns of the line
            rows = (_pdb_values(*x) for x in lines if want.has("model", x[1]) and want.has("chain_id", x[2][21:22].strip() or None) and want.has("is_het", x[2].startswith("HETATM")))
        for r in rows:
            if want.has("model", r[1]) and want.has("chain_id", r[6]) and want.has("is_het", r[-1]):
                yield r
    except (ValueError, KeyError, OSError, EOFError):
        return


class StructureReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.want = path, most, Wanted()

    def pushFilters(self, filters):
        return self.want.push(filters)

    def partitions(self) -> list[Files]:
        files = _found(self.path)
        return _packed([f for f in files if self.want.has("item", f[1].rsplit("/", 1)[-1])], self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for path in partition.paths:
            yield from _atoms(system, path, self.want)


class StructureStreamReader(DataSourceStreamReader):
    """New files by their time and name. An offset is the last file taken, so a file that appears with an older
    time than one already taken is not seen: files are to be moved into place when complete."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _found(self.path)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        files = _found(self.path)
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return _packed([f for f in files if low < f[:2] <= high], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for path in partition.paths:
            yield from _atoms(system, path, Wanted())


class StructureSource(DataSource):
    """Options: path; partitionBytes, by default 16 MB."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return structures.SCHEMA

    def _options(self) -> tuple[str, int]:
        if "path" not in self.options:
            raise ValueError("the path of the structure files is missing")
        return self.options["path"], int(self.options.get("partitionBytes", 16 << 20))

    def reader(self, schema: StructType) -> StructureReader:
        return StructureReader(*self._options())

    def streamReader(self, schema: StructType) -> StructureStreamReader:
        return StructureStreamReader(*self._options())


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to it."""
    spark.dataSource.register(StructureSource)
    spark.conf.set(PUSHDOWN, "true")
