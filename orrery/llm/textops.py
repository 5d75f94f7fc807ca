"""Shared building blocks: Arrow text access, vectorised word hashing, checkpoints.

All helpers work on whole texts. A null text counts as the empty text unless an
operator says otherwise.
"""

from __future__ import annotations

import atexit
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import checkpoint_dir as ensure_checkpoint_dir

#: Bytes of text that one vectorised step handles; numpy temporaries are a few dozen times that.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything that is neither an ASCII letter or digit nor part of a longer UTF-8 sequence.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * _M1
        h = (h ^ (h >> U64(27))) * _M2
        return h ^ (h >> U64(31))


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=U64)
    with np.errstate(over="ignore"):
        out[1:] = U64(base)
        np.multiply.accumulate(out, out=out)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, at least one row each and at most ``rows``."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n, i + (rows or n))
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end byte of each word of rows, ASCII-lower-cased unless not to fold.

    Words are the maximal runs without a byte of ``between``. ``offsets`` start at 0.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, z
    solid = ~between[data]
    first = np.empty(n, dtype=bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(solid & first)
    if len(starts) == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, z
    last = np.empty(n, dtype=bool)
    last[-1] = True
    last[:-1] = first[1:] | ~solid[1:]
    ends = np.flatnonzero(solid & last) + 1
    lens = ends - starts
    at = np.concatenate(([0], np.cumsum(lens)[:-1]))
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
    with np.errstate(over="ignore"):
        value = ((LOWER[data[solid]] if fold else data[solid]).astype(U64) + U64(1)) * powers(int(lens.max()))[place]
        h = mix(np.add.reduceat(value, at) + lens.astype(U64) * _M2)
    return h, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def shingles(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``size`` words; a shorter row is one run of all its words."""
    n = len(h)
    parts, rows = [], []
    with np.errstate(over="ignore"):
        if n >= size:
            m = n - size + 1
            whole = row[:m] == row[size - 1 :]
            s = h[:m]
            for k in range(1, size):
                s = mix(s * _P + h[k : m + k])
            parts.append(s[whole])
            rows.append(row[:m][whole])
        if n:
            begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            count = np.diff(np.concatenate((begin, [n])))
            for b, c in zip(begin[count < size], count[count < size], strict=True):
                s = h[b]
                for k in range(1, c):
                    s = mix(np.array([s * _P + h[b + k]]))[0]
                parts.append(np.array([s ^ U64(c)], dtype=U64))
                rows.append(row[b : b + 1])
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    s, r = np.concatenate(parts), np.concatenate(rows)
    if len(parts) > 1:
        order = np.argsort(r, kind="stable")
        s, r = s[order], r[order]
    return s, r


def i64(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed values that Spark stores."""
    return np.ascontiguousarray(values, dtype=U64).view(np.int64)


def lists(values: np.ndarray, counts, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    off = np.concatenate(([0], np.cumsum(np.asarray(counts, dtype=np.int64)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


def column(df: DataFrame, name: str, kind: str) -> F.Column:
    """Column ``name`` cast to ``kind``."""
    return F.col(f"`{name}`").cast(kind)


#: Rows of an Arrow batch while intermediate results are made. Texts can be long, and a
#: batch is held twice, by the JVM and by its Python worker.
BATCH_ROWS = 2000


@contextmanager
def small_batches(spark: SparkSession):
    """At most BATCH_ROWS rows in the Arrow batches of the jobs that run inside; the session's own setting stands again after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, cutting the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def trim() -> None:
    """Give freed memory back: workers live on between tasks, and the memory that the C library
    keeps for them counts against the executor's limit beside the JVM's."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lean(run):
    """A function over batches that leaves no freed memory behind in its worker."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


#: File system and path of the folders that are still there and go at the end.
_TABLES: dict[str, tuple] = {}


def _at_exit() -> None:
    for fs, path in _TABLES.values():
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001
            return  # the session has ended before, and its folder is left to its owner


atexit.register(_at_exit)


def stored(df: DataFrame) -> DataFrame:
    """Written as a Parquet table in the shared checkpoint folder and read again.

    Columnar and compressed, unlike ``saved``, and its size is known to the planner. Results
    are read from such tables when they are used, so those that no step has discarded go
    when the driver ends.
    """
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    until_exit(spark, path)
    out._stored_at = path
    return out


def until_exit(spark: SparkSession, path: str) -> str:
    """The path of a folder that goes when the driver ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _TABLES[path] = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
    return path


def is_stored(df: DataFrame) -> bool:
    """Whether ``stored`` has made the table and it is still there."""
    return getattr(df, "_stored_at", None) in _TABLES


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps whose frames are gone.

    It keeps them as long as the driver's JVM holds their plans. They are several times the
    tables, so that garbage is collected here and not when the driver's heap happens to fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more, and what their steps shuffled."""
    for df in tables:
        fs, path = _TABLES.pop(df._stored_at)
        fs.delete(path, True)
    release(tables[0].sparkSession)


def tasks(spark: SparkSession) -> int:
    """The number of shuffle partitions in force."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_group(batches, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Regroup batches that are sorted by the integer columns ``keys`` so that no group is cut."""
    rest = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch])
        cuts = boundaries(table, keys)
        if cuts[-1] > 0:
            yield one(table.slice(0, int(cuts[-1])))
        rest = one(table.slice(int(cuts[-1])))
    if rest is not None:
        yield rest


def boundaries(table, keys: list[str]) -> np.ndarray:
    """First rows of the groups of a table or batch sorted by ``keys``."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def one(table: pa.Table) -> pa.RecordBatch:
    """A table as a single batch."""
    found = table.combine_chunks().to_batches()
    return found[0] if found else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in table.schema], schema=table.schema)
