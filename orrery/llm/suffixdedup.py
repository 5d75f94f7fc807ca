"""Removal of repeated passages by distributed prefix doubling over sampled suffixes.

Sorting the suffixes at every byte would move many times the corpus. Suffixes are
sampled instead, by content: the anchor of a window of ``length`` bytes is its leftmost
least-hashed ``gram`` among the first ``reach`` ones, so equal windows have equal
anchors at the same places. Two per cent or so of the positions are anchors, and a text
is the sequence of its blocks, from an anchor to the gram of the next.

1. Spark sorts the anchors by the hash of their block over all partitions and ranks them;
   an anchor whose neighbours in that order differ is unique and drops out.
2. Prefix doubling: the pair (rank of anchor i, rank of anchor i + 2**k) is sorted and
   ranked again and so tells runs of 2**(k+1) blocks apart, until an anchor is unique or its
   runs reach past every window of the anchor.
3. A window is decided by the rank of the longest run of 2**k blocks inside it, and by
   64-bit hashes of its rests: the bytes before the run's anchor and those behind its end.
   The rests of windows whose runs have the same rank meet in one task. A group too large
   for one task is dealt in pieces, and what is single within its piece is compared
   across pieces by hash.
Exact copies of a text are recognised by digest first and enter steps 2 and 3 once.
Blocks and rests are told apart by 64-bit hashes, so that bytes never travel in step 1 and 2.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textops as T

#: Levels of doubling that a row has room for; runs of 2**7 blocks pass 255 bytes.
LEVELS = 8


@dataclass(frozen=True)
class Repeats:
    """length: bytes of a repeat; 2 * reach + gram - 1 of them at least, so that a window holds
    a block. reach: up to 255. piece_rows: anchors of one group that a task compares at once.
    bloom_bits: size of the filter of candidate texts."""

    length: int = 400
    gram: int = 16
    reach: int = 192
    piece_rows: int = 8192
    bloom_bits: int = 1 << 25

    def __post_init__(self):
        if self.length < 2 * self.reach + self.gram - 1 or self.reach > 255 or self.sure > 255:
            raise ValueError("a window of that length has room for no block, or for too many")

    @property
    def sure(self) -> int:
        """How far behind a window's start the last start lies whose anchor the window determines."""
        return self.length - self.reach - self.gram + 1


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Spans:
    """Hashes of the runs of bytes in some data, equal for equal runs."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * T.powers(len(data), _BASE)[: len(data)], out=self.total[1:])
        self.back = T.powers(len(data) + 1, _INVERSE)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return T.mix((self.total[end] - self.total[begin]) * self.back[begin])

    def all(self, size: int) -> np.ndarray:
        n = max(len(self.total) - size, 0)
        with np.errstate(over="ignore"):
            return T.mix((self.total[size : size + n] - self.total[:n]) * self.back[:n])

def owners(grams: np.ndarray, reach: int) -> np.ndarray:
    """Place of the leftmost least of each ``reach`` successive grams (by their upper 32 bits)."""
    n = len(grams) - reach + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(key) // reach) * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[reach - 1 : reach - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


_ANCHORS = "doc long, th long, i int, pos int, end int, s1 int, steps long, top byte, block long"
#: The level of a run of so many blocks.
_LEVEL = np.array([max(n, 1).bit_length() - 1 for n in range(256)], np.uint8)


def _anchors(p: Repeats):
    """The anchors of each text but the last: place, end of the block, first window, how many
    windows have a level up to 0, 1, .. (a byte each), and the highest level asked of its runs."""

    @T.lean
    def run(batches):
        for batch in batches:
            data, off = T.utf8(batch.column(2))
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # of a size whose arrays stay in the processor's cache
            for i, j in T.pieces(off, T.CHUNK_BYTES // 4):
                o = off[i : j + 1] - off[i]
                spans = Spans(data[off[i] : off[j]])
                own = owners(spans.all(p.gram), p.reach)
                if len(own) == 0:
                    continue
                row = np.repeat(np.arange(j - i), np.diff(o))[: len(own)]
                # the text's last anchors have no window of their own, but runs end in them
                s = np.flatnonzero((np.arange(len(own)) + p.reach + p.gram - 1 <= o[row + 1]) & (o[row + 1] - o[row] >= p.length))
                if len(s) == 0:
                    continue
                a, r = own[s], row[s]
                new = np.ones(len(s), bool)
                new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
                first, number = np.flatnonzero(new), np.cumsum(new) - 1
                window = np.flatnonzero(s + p.length <= o[r + 1])
                level = _LEVEL[number[window + p.sure] - number[window]]
                each = np.bincount(number[window] * LEVELS + level, minlength=len(first) * LEVELS).reshape(-1, LEVELS)
                steps = (each.cumsum(axis=1).astype(np.uint64) << (np.arange(LEVELS, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)
                # a run of 2**k blocks is made of shorter ones that begin at its first 2**k anchors
                most = np.where(each > 0, np.arange(LEVELS), 0).max(axis=1)
                top = np.zeros(len(first), np.int8)
                for k in range(1, int(most.max(initial=0)) + 1):
                    seen = np.concatenate((np.zeros(1 << k, np.int64), np.cumsum(most >= k)))
                    top[seen[1 << k :] > seen[: len(first)]] = k
                begin, r = a[first], r[first]
                at = np.flatnonzero(r[1:] == r[:-1])
                end = begin[at + 1] + p.gram
                index = np.arange(len(first)) - np.searchsorted(r, r)
                i32 = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[i + r[at]]), pa.array(th[i + r[at]]), i32(index[at]), i32(begin[at] - o[r[at]]), i32(end - o[r[at]]), i32(s[first[at]] - o[r[at]]), pa.array(T.i64(steps[at])), pa.array(top[at]), pa.array(T.i64(spans.of(begin[at], end)))],
                    ["doc", "th", "i", "pos", "end", "s1", "steps", "top", "block"],
                )

    return run


def _neighbours(by: tuple[str, ...], most: int):
    """Of rows sorted by ``by``, those whose values another row has too. part is the partition's
    number, place that of the values in it. Equal rows are numbered into pieces of ``most``;
    many tells that there may be others in another piece. The values at both ends of a
    partition may go on in the next one: they count as many, and stay if they are single."""

    @T.lean
    def run(batches):
        part = TaskContext.get().partitionId()

        def placed(rows, keep, place, turn, many):
            piece = np.where(many, (np.int64(part) << 32) + turn // most + 1, 0)
            new = [np.full(rows.num_rows, part, np.int32), place, piece, many]
            rows = pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, new)], [*rows.schema.names, "part", "place", "piece", "many"])
            return rows.filter(pa.array(keep))

        # the rows of the last values that wait for their number, and how many went before them
        rest, done, place = None, 0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = T.one(pa.Table.from_batches([batch] if rest is None else [rest, batch]))
            new = np.zeros(rows.num_rows, bool)
            for k in by:
                v = rows.column(k).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            number = np.cumsum(new)
            start = np.concatenate(([0], np.flatnonzero(new)))
            size = np.diff(np.append(start, rows.num_rows))
            size[0] += done
            turn = np.arange(rows.num_rows) - start[number] + np.where(number == 0, done, 0)
            border = (place + number) == 0
            many = border | (size[number] > most)
            keep = border | (size[number] > 1)
            n = rows.num_rows - 1 if size[-1] > most else int(start[-1])
            yield placed(rows.slice(0, n), keep[:n], (place + number)[:n], turn[:n], many[:n])
            done, place, rest = int(turn[n]), place + int(number[-1]), rows.slice(n)
        if rest is not None:
            n = rest.num_rows
            yield placed(rest, np.ones(n, bool), np.full(n, place), done + np.arange(n), np.ones(n, bool))

    return run


#: Rows of a partition aimed at when ranks are few.
_PART_ROWS = 100_000


def ranked(x: DataFrame, by: tuple[str, ...], most: int, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that share their values of ``by`` with another, with the rank r of the values among
    all, and piece and many as told above; and the stored table below.

    Rows are sorted over all partitions, equal ones by doc and i besides, so values that a
    third of the rows have spread over partitions. The driver learns the ends of each
    partition, nothing else. rows: their number, if few.
    """
    spark = x.sparkSession
    n = T.tasks(spark) if rows is None else min(T.tasks(spark), -(-rows // _PART_ROWS))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in x.schema.fields)
    ordered = x.repartitionByRange(n, *by, "doc", "i").sortWithinPartitions(*by)
    placed = T.stored(ordered.mapInArrow(_neighbours(by, most), schema + "part int, place long, piece long, many boolean"))
    value = F.struct(*by)
    ends = placed.groupBy("part").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.max("place").alias("most")).orderBy("part").collect()
    base, bases, before = 0, [], None
    for e in ends:
        base += before is not None and tuple(e.low) != before
        bases.append((e.part, base))
        base, before = base + e.most, tuple(e.high)
    # a row for each partition
    begin = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    return placed.join(begin, "part").withColumn("r", F.col("base") + F.col("place")).drop("part", "place", "base", *by), placed


_PAIRS = "doc long, th long, i int, pos int, end int, s1 int, steps long, top byte, r_a long, r_b long"


def _ahead(step: int):
    """Each anchor that has one ``step`` ahead, with both ranks and the end of the second run.
    Rows come sorted by text and anchor."""

    @T.lean
    def run(batches):
        rest = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = T.one(pa.Table.from_batches([batch] if rest is None else [rest, batch]))
            # what lies farther ahead than the rows that follow has not come yet
            n = max(rows.num_rows - step, 0)
            yield met(rows, n)
            rest = rows.slice(n)
        if rest is not None:
            yield met(rest, rest.num_rows)

    def met(rows, n):
        doc, th, i = (rows.column(c).to_numpy() for c in ("doc", "th", "i"))
        new = np.ones(len(i), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
        place = (np.cumsum(new) << 32) + i
        at = np.minimum(np.searchsorted(place, place[:n] + step), len(i) - 1)
        found = np.flatnonzero(place[at] == place[:n] + step)
        one, two = rows.take(pa.array(found)), rows.take(pa.array(at[found]))
        cols = [one.column(c) for c in ("doc", "th", "i", "pos")] + [two.column("end")] + [one.column(c) for c in ("s1", "steps", "top", "r")] + [two.column("r")]
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _PAIRS.split(", ")])

    return run


def _paired(x: DataFrame, step: int, rows: int) -> DataFrame:
    """Each anchor with its rank and that of the anchor ``step`` ahead, where its run then ends."""
    rows = x.select("doc", "th", "i", "pos", "end", "s1", "steps", "top", "r").repartition(min(T.tasks(x.sparkSession), -(-rows // _PART_ROWS)), "doc", "th")
    return rows.sortWithinPartitions("doc", "th", "i").mapInArrow(_ahead(step), _PAIRS)


def _at_level(x: DataFrame, k: int) -> DataFrame:
    """The windows, from a to b, that the run of 2**k blocks decides."""
    upto = lambda n: F.shiftrightunsigned("steps", 8 * n).bitwiseAND(255).cast("int") if n >= 0 else F.lit(0)
    at = x.select("doc", "th", "pos", "end", (F.col("s1") + upto(k - 1)).alias("a"), (F.col("s1") + upto(k) - 1).alias("b"), (F.col("r") * LEVELS + k).alias("key"), "piece", "many")
    return at.where("b >= a")


def doubled(anchors: DataFrame, copies: DataFrame, p: Repeats) -> tuple[DataFrame, list[DataFrame]]:
    """doc, th, pos, end, a, b, key, piece, many of the windows whose runs are not unique, equal
    runs having equal keys; and the stored tables below. Runs double until none is asked for."""
    x, placed = ranked(anchors, ("block",), p.piece_rows)
    # of the copies of a text one goes on
    x = T.stored(x.join(copies, "th", "left").where("rep is null or rep = doc"))
    T.discard(placed)
    tables = [x]
    # and repeated rows of it are one
    x = x.where("rep is null").unionByName(x.where("rep = doc").dropDuplicates(["doc", "th", "i"])).drop("rep")
    windows, k = _at_level(x, 0), 0
    while rows := (longer := x.where(F.col("top") > k)).count():
        # stored, as Spark goes over the rows twice to sort them by ranges
        pairs = T.stored(_paired(longer, 1 << k, rows))
        x, placed = ranked(pairs, ("r_a", "r_b"), p.piece_rows, rows)
        T.discard(pairs)
        tables.append(placed)
        k += 1
        windows = windows.unionByName(_at_level(x, k))
    return windows, tables


def _contexts(p: Repeats):
    """The rests of the windows of each run that is left, from texts with their runs."""

    @T.lean
    def run(batches):
        for batch in batches:
            data, off = T.utf8(batch.column("text"))
            lists = batch.column("runs")
            at, each = lists.flatten(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), each)
            pos, end, a, b = (at.field(f).to_numpy() for f in ("pos", "end", "a", "b"))
            cuts = [off[row] + x for x in (a, pos, end, b + p.length)]
            doc, th = batch.column("doc").to_numpy()[row], batch.column("th").to_numpy()[row]
            for x, y in T.pieces(np.concatenate(([0], np.cumsum(cuts[1] - cuts[0] + cuts[3] - cuts[2]))), 4 * T.CHUNK_BYTES):
                raw = [data[q:r].tobytes() + data[s:t].tobytes() for q, r, s, t in zip(*(c[x:y] for c in cuts), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[x:y]), pa.array(th[x:y]), *(at.field(f).slice(x, y - x) for f in ("key", "piece", "many")), pa.array(a[x:y]), pa.array((b - a + 1)[x:y]), pa.array((pos - a)[x:y]), pa.array(raw, pa.binary())],
                    ["doc", "th", "key", "piece", "many", "a", "windows", "back", "raw"],
                )

    return run


def _compare(p: Repeats):
    """Runs of window starts with an equal window in the group, and for groups in pieces what is single so far."""

    @T.lean
    def run(batches):
        for group in T.by_group(batches, ["key", "piece"]):
            cuts = np.append(T.boundaries(group, ["key", "piece"]), group.num_rows)
            lens = np.diff(np.frombuffer(group.column("raw").buffers()[1], np.int32)[group.column("raw").offset :][: group.num_rows + 1])
            at, ends = 0, np.cumsum(lens)
            chunk = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if chunk and ends[e - 1] - at > T.CHUNK_BYTES:
                    yield from _compared(group.slice(chunk[0], s - chunk[0]), p)
                    chunk, at = [], ends[s - 1]
                chunk = chunk or [s]
            yield from _compared(group.slice(chunk[0], group.num_rows - chunk[0]), p)

    return run


def _compared(rows: pa.RecordBatch, p: Repeats):
    raw = rows.column("raw")
    off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    spans = Spans(np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]])
    off = off - off[0]
    count = rows.column("windows").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(raw)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    key = rows.column("key").to_numpy().view(np.uint64)
    back = rows.column("back").to_numpy().astype(np.int64)
    middle = (off[:-1] + back)[row]
    with np.errstate(over="ignore"):
        ahead = T.mix(key[row] * np.uint64(_BASE) + (back[row] - place).astype(np.uint64))
        v = T.mix(T.mix(ahead + spans.of(off[row] + place, middle)) + spans.of(middle, off[row + 1] - (count[row] - 1 - place)))
    # within a piece only windows of that piece meet
    part = rows.column("piece").to_numpy()[row].view(np.uint64)
    with np.errstate(over="ignore"):
        local = v + part * np.uint64(0xD1B54A32D192ED03)
    order = np.argsort(local)
    new = np.ones(len(order), bool)
    new[1:] = local[order[1:]] != local[order[:-1]]
    single = np.append(new[1:], True) & new
    twice = np.ones(len(order), bool)
    twice[order[single]] = False
    first = order[new]
    doc, th, s1 = (rows.column(c).to_numpy() for c in ("doc", "th", "a"))
    hit = np.flatnonzero(twice)
    new = np.ones(len(hit), bool)
    new[1:] = (row[hit][1:] != row[hit][:-1]) | (place[hit][1:] != place[hit][:-1] + 1)
    a = hit[new]
    b = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1] if len(hit) else hit
    zero = np.zeros(len(a), np.int64)
    yield _runs(doc[row[a]], th[row[a]], s1[row[a]] + place[a], s1[row[b]] + place[b], zero, zero.astype(np.int8))
    hot = np.flatnonzero(rows.column("many").to_numpy(zero_copy_only=False)[row[first]])
    if len(hot):
        f = first[hot]
        start = s1[row[f]] + place[f]
        yield _runs(doc[row[f]], th[row[f]], start, start, T.i64(v[f]), np.where(twice[f], 2, 1).astype(np.int8))


_RUNS = "doc long, th long, a int, b int, v long, kind byte"


def _runs(doc, th, a, b, v, kind):
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(v), pa.array(kind)], ["doc", "th", "a", "b", "v", "kind"])


_DONE = "doc long, th long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _removed(p: Repeats, texts: bool):
    @T.lean
    def run(batches):
        for batch in batches:
            data, off = T.utf8(batch.column("text"))
            out: list[list] = [[] for _ in range(5)]
            for n, runs in enumerate(batch.column("runs")):
                raw = data[off[n] : off[n + 1]]
                a, b = runs.values.field("a").to_numpy(), runs.values.field("b").to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order]) + p.length
                new = np.ones(len(a), bool)
                new[1:] = a[1:] > b[:-1]
                begin, end = a[new], b[np.append(np.flatnonzero(new)[1:], len(a)) - 1]
                kept = np.ones(len(raw), bool)
                for x, y in zip(begin, end, strict=True):
                    kept[x:y] = False
                rest = raw[kept].tobytes()
                values = (int((~kept).sum()), len(begin), hashlib.sha256(rest).hexdigest(), [{"start": int(x), "end": int(y)} for x, y in zip(begin, end, strict=True)], rest)
                for c, v in zip(out, values, strict=True):
                    c.append(v)
            cols = [batch.column("doc"), batch.column("th"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            names = ["doc", "th", "n_removed", "n_spans", "kept_sha256", "spans"]
            if texts:
                cols.append(pa.array([x.decode("utf-8", "replace") for x in out[4]], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _bloom(keys: DataFrame, bits: int):
    """A filter of fixed size over (doc, th): texts outside are surely no candidates. With many
    more candidates than bits it is full, and all texts go on to the join."""
    bit = F.pmod(F.xxhash64("doc", "th"), F.lit(bits))
    words = keys.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("m"))
    # bits / 64 rows at most
    found = words.toPandas()
    table = np.zeros(bits // 64, np.uint64)
    table[found["w"].to_numpy(np.int64)] = found["m"].to_numpy(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def remove_repeats(docs: DataFrame, p: Repeats | None = None, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with
    ``texts`` the remaining text (bytes of a cut character become U+FFFD).

    Every byte covered by a string of ``length`` bytes that also starts elsewhere, in the
    same text or another, is removed; all are judged on the input. Null texts count as
    empty. Repeated rows are copies of each other. doc_id may be null or repeated. Other
    columns are ignored; an empty table gives an empty result.
    """
    p = p or Repeats()
    spark = docs.sparkSession
    n = T.tasks(spark)
    text = F.coalesce(T.column(docs, text_col, "string"), F.lit(""))
    src = docs.select(T.column(docs, id_col, "long").alias("doc_id"), text.alias("text"))
    src = src.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("doc"), F.xxhash64("text").alias("th"), "text")
    meta = T.stored(src.select("doc_id", "doc", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    copies = T.stored(meta.where(F.col("n_bytes") >= p.length).groupBy("th", "n_bytes", "sha").agg(F.count("*").alias("n"), F.min("doc").alias("rep")).where("n > 1"))

    anchors = T.stored(src.select("doc", "th", "text").mapInArrow(_anchors(p), _ANCHORS))
    windows, tables = doubled(anchors, copies.select("th", "rep"), p)
    lists = T.stored(windows.groupBy("doc", "th").agg(F.collect_list(F.struct("pos", "end", "a", "b", "key", "piece", "many")).alias("runs")))
    T.discard(anchors, *tables)
    filter_ = _bloom(lists.select("doc", "th"), p.bloom_bits)
    bit = F.pmod(F.xxhash64("doc", "th"), F.lit(p.bloom_bits)).alias("bit")

    @T.lean
    def maybe(batches):
        for batch in batches:
            b = batch.column("bit").to_numpy()
            yield batch.filter(pa.array((filter_.value[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1)).select(["doc", "th", "text"])

    some = src.select("doc", "th", "text", bit).mapInArrow(maybe, "doc long, th long, text string")
    candidates = T.stored(some.join(lists, ["doc", "th"]))
    contexts = candidates.mapInArrow(_contexts(p), "doc long, th long, key long, piece long, many boolean, a int, windows int, back int, raw binary")
    dealt = contexts.repartition(n, "key", "piece").sortWithinPartitions("key", "piece")
    runs = T.stored(dealt.mapInArrow(_compare(p), _RUNS))
    across = runs.where("kind > 0")
    met = across.groupBy("v").agg(F.count("*").alias("_n")).where("_n > 1")
    late = across.where("kind = 1").join(met, "v").select("doc", "th", "a", "b")
    per_text = runs.where("kind = 0").select("doc", "th", "a", "b").union(late).groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    done = candidates.select("doc", "th", "text").dropDuplicates(["doc", "th"]).join(per_text, ["doc", "th"]).mapInArrow(_removed(p, texts), _DONE + ", kept string" * texts)
    done = T.stored(done)
    T.discard(lists, candidates, runs)

    out = meta.join(copies.select("th", "n_bytes", "sha", "n"), ["th", "n_bytes", "sha"], "left").join(done, ["doc", "th"], "left")
    whole = F.col("n").isNotNull()
    out = out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(whole, "").otherwise(F.col("kept")).alias("kept"), "doc", "th"] if texts else []),
    )
    if texts:
        # texts without a removal come from the source
        plain = src.select("doc", "th", F.col("text").alias("own")).dropDuplicates(["doc", "th"])
        out = out.join(plain, ["doc", "th"], "left").withColumn("kept", F.coalesce("kept", "own")).drop("own", "doc", "th")
    return out
