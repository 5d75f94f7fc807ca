"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder of Parquet shards and numbered manifests. Arrivals are appended as
small shards, one version each. Compaction takes shards of a similar size (a tier spans a factor of
``fan_in``), bundles whole shards up to the target size and writes each bundle as one
shard, without a shuffle: Spark's own file packing assigns the shards to tasks. Higher
tiers follow until no tier has ``fan_in`` shards. A shard of more than twice the target, such as
one of a single large row group, is divided. A version becomes visible by renaming
its manifest into place, which fails if another writer has taken the number; shards of
older versions stay until ``vacuum``, so readers and failed jobs see no half-written
state.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sharding:
    """target_bytes: size aimed at. fan_in: shards of a tier that are merged at once at least.
    least_bytes: size of the lowest tier's shards. arrival_bytes: what a task scans of an appended table."""

    target_bytes: int = 128 << 20
    fan_in: int = 4
    least_bytes: int = 64 << 10
    arrival_bytes: int = 4 << 20
    compression: str = "zstd"


@dataclass(frozen=True)
class Shard:
    """whole: it has been divided as far as its rows allow."""

    path: str
    bytes: int
    tier: int
    whole: bool = False


class CommitConflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """A store at a path of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, p: Sharding | None = None):
        self.spark, self.root, self.p = spark, root.rstrip("/"), p or Sharding()
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def tier(self, size: int) -> int:
        """Tiers count up from least_bytes by factors of fan_in, each to the nearest one."""
        return max(0, round(math.log(max(size, 1) / self.p.least_bytes, self.p.fan_in)))

    def versions(self) -> list[int]:
        found = self._fs.listStatus(self._path(f"{self.root}/manifests"))
        names = [s.getPath().getName() for s in found]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """The shards of a version, by default of the last; version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return 0, []
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Shard(**s) for s in json.loads(text)["shards"]]

    def _commit(self, base: int, shards: list[Shard]) -> int:
        body = json.dumps({"version": base + 1, "shards": [asdict(s) for s in shards]})
        temp = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        final = self._path(f"{self.root}/manifests/v{base + 1:08d}.json")
        out = self._fs.create(temp, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = jvm.java.lang.reflect.Array.newInstance(kind, 1)
        options[0] = kind.getEnumConstants()[0]  # NONE: never over an existing file
        try:
            context.rename(temp, final, options)
        except Exception as e:
            self._fs.delete(temp, False)
            if self._fs.exists(final):
                raise CommitConflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    def _write(self, df: DataFrame) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", self.p.compression).parquet(folder)
        return self._shards(folder)

    def _shards(self, folder: str) -> list[Shard]:
        found = [s for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")]
        return [Shard(s.getPath().toString(), s.getLen(), self.tier(s.getLen())) for s in found]

    def _drop(self, shards: list[Shard]) -> None:
        """Delete shards that no manifest names."""
        for s in shards:
            self._fs.delete(self._path(s.path), False)

    def _with_packing(self, bytes_per_task: int, run):
        """Run with whole files packed into tasks of the given size."""
        want = {"spark.sql.files.maxPartitionBytes": str(bytes_per_task), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        before = {k: self.spark.conf.get(k, None) for k in want}
        for k, v in want.items():
            self.spark.conf.set(k, v)
        try:
            return run()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def append(self, df: DataFrame) -> int:
        """Add the rows as new small shards, one of each task, and commit.

        Scanned files arrive in pieces of about arrival_bytes. An empty table adds no
        rows; columns may hold nulls and any values, and repeated rows are kept.
        """
        return self.add(self._with_packing(self.p.arrival_bytes, lambda: self._write(df)))

    def add(self, shards: list[Shard]) -> int:
        """Commit a version with these shards besides the last one's."""
        while True:
            base, now = self.manifest()
            try:
                return self._commit(base, now + shards)
            except CommitConflict:
                continue

    def dealt(self, df: DataFrame, arrivals: int) -> list[list[Shard]]:
        """The rows written as the shards of so many arrivals, which are not committed yet.

        One scan without a shuffle: each task deals its rows in turn, whatever they hold, and
        writes a shard for each arrival. Of an empty table the first arrival has a shard without rows.
        """
        free = "_arrival" + "_" * max(map(len, df.columns))
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows = df.withColumn(free, F.monotonically_increasing_id() % arrivals)
        self._with_packing(self.p.arrival_bytes * arrivals, lambda: rows.write.option("compression", self.p.compression).partitionBy(free).parquet(folder))
        kept = [f"{folder}/{free}={n}" for n in range(arrivals)]
        found = [self._shards(k) for k in kept if self._fs.exists(self._path(k))]
        return found or [self._write(df)]

    def compact(self) -> int:
        """Merge tiers from the smallest up until none has fan_in shards below the target; commit each merge."""
        while True:
            base, now = self.manifest()
            if large := [s for s in now if s.bytes > 2 * self.p.target_bytes and not s.whole]:
                self._divide(base, now, large)
                continue
            tiers: dict[int, list[Shard]] = {}
            for s in now:
                if s.bytes < self.p.target_bytes // 2:
                    tiers.setdefault(s.tier, []).append(s)
            ready = [t for t, s in sorted(tiers.items()) if len(s) >= self.p.fan_in]
            if not ready:
                return base
            merged = tiers[ready[0]]
            total = sum(s.bytes for s in merged)
            bundles = max(1, round(total / self.p.target_bytes))
            # a little room, so that whole shards fill the bundles without a remainder
            room = min(self.p.target_bytes, -(-total // bundles)) + max(s.bytes for s in merged)
            made = self._with_packing(room, lambda m=merged: self._write(self.spark.read.parquet(*[s.path for s in m])))
            old = {s.path for s in merged}
            if len(made) >= len(merged):
                # the session packs smaller than asked: nothing to gain
                self._drop(made)
                return base
            try:
                self._commit(base, [s for s in now if s.path not in old] + made)
            except CommitConflict:
                self._drop(made)

    def _divide(self, base: int, now: list[Shard], large: list[Shard]) -> None:
        """Write shards that are too large as several of about the target size, dealing their rows out."""
        pieces = sum(-(-s.bytes // self.p.target_bytes) for s in large)
        made = self._write(self.spark.read.parquet(*[s.path for s in large]).repartition(pieces))
        # what is too large still has rows that are
        made = [replace(s, whole=s.bytes > 2 * self.p.target_bytes) for s in made]
        old = {s.path for s in large}
        try:
            self._commit(base, [s for s in now if s.path not in old] + made)
        except CommitConflict:
            self._drop(made)

    def read(self, version: int | None = None, shard_col: str = "_shard") -> DataFrame:
        """The rows of a version, and as ``shard_col`` the file name of each row's shard. A
        table that has a column of that name is an error."""
        version, shards = self.manifest(version)
        if not shards:
            raise ValueError(f"version {version} has no shards")
        rows = self.spark.read.parquet(*[s.path for s in shards])
        if shard_col in rows.columns:
            raise ValueError(f"the table has a column {shard_col}")
        return rows.select("*", rows.metadataColumn("_metadata")["file_name"].alias(shard_col))

    def vacuum(self) -> int:
        """Delete shards that no manifest but the last names, and the older manifests; returns how many shards went."""
        version, now = self.manifest()
        live = {s.path for s in now}
        gone = 0
        files = self._fs.listFiles(self._path(f"{self.root}/data"), True)
        while files.hasNext():
            path = files.next().getPath()
            if path.getName().endswith(".parquet") and path.toString() not in live:
                self._fs.delete(path, False)
                gone += 1
        for v in self.versions():
            if v != version:
                self._fs.delete(self._path(f"{self.root}/manifests/v{v:08d}.json"), False)
        return gone


def compacted(df: DataFrame, root: str, p: Sharding | None = None, id_col: str = "doc_id", arrivals: int = 22) -> DataFrame:
    """Let a table arrive at a new store in parts, compacting it after each, and tell where each row is.

    One row per input row, read back from the last version: doc_id, shard (its number in
    the manifest), shard_bytes, tier, version. Null ids and repeated rows are kept.
    """
    store = ShardStore(df.sparkSession, root, p)
    version = 0
    for shards in store.dealt(df, arrivals):
        store.add(shards)
        version = store.compact()
    _, shards = store.manifest(version)
    named = [(s.path.rsplit("/", 1)[1], n, s.bytes, s.tier) for n, s in enumerate(shards)]
    listed = df.sparkSession.createDataFrame(named, "_shard string, shard int, shard_bytes long, tier int")
    free = "_shard" + "_" * max(map(len, df.columns))
    rows = store.read(version, free).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(free).alias("_shard"))
    return rows.join(listed, "_shard").select("doc_id", "shard", "shard_bytes", "tier", F.lit(version).alias("version"))
