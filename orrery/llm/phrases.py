"""Removal of recurring passages of words, located by sharded Aho-Corasick automata.

A window is ``words`` consecutive words. It is known by its anchor, the leftmost least-hashed run of
``gram`` words in it, so equal windows have equal anchors at the same place, and one run in
some fifteen is an anchor.

1. A scan cuts texts into words and keeps, for each anchor, its hash and the windows it has.
   Anchors are counted over all documents; those that occur once have no recurring window and
   drop out. Exact copies of a text, word for word, are recognised by digest first and go on once.
2. The words around each anchor that is left, as far as its windows reach, go to the shard of the
   anchor. There all places of a window meet, wherever they are in the corpus.
3. A shard confirms its recurring passages: the longest runs of windows that have an equal
   elsewhere. It compiles the distinct ones, each word a symbol, into automata of some hundred
   anchors each, streams all texts of the shard through these, and hands on what is covered by an occurrence.
4. A text's covered words go, and the rest is joined.

An automaton holds the passages of its shard's anchors and nothing else, so its size doesn't grow
with the corpus, and a text meets only automata that can hold one of its windows. An anchor with
very many places is dealt in pieces: each is a shard of its own, and windows that are single in
their piece are met across pieces by hash. No place is dropped.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textops as T
from orrery.llm.suffixdedup import Spans, owners


@dataclass(frozen=True)
class Phrases:
    """words: of a window. gram: words of an anchor. piece_rows: places of an anchor that a shard
    takes at once. automaton_rows: places that share an automaton, about."""

    words: int = 35
    gram: int = 6
    piece_rows: int = 8192
    automaton_rows: int = 128

    def __post_init__(self):
        if not 1 <= self.gram <= self.words or self.words > 127:
            raise ValueError("an anchor fits into a window of at most 127 words")

    @property
    def reach(self) -> int:
        return self.words - self.gram + 1


def _edges(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words of rows and the bytes behind them."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid, first, last = ~T.SPACE[data], np.ones(n, bool), np.ones(n, bool)
    first[1:] = ~solid[:-1]
    first[off[:-1][off[:-1] < n]] = True
    last[:-1] = first[1:] | ~solid[1:]
    return np.flatnonzero(solid & first), np.flatnonzero(solid & last) + 1


def _plain(data: np.ndarray, off: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each row with one space between, and the rows' offsets."""
    row, starts, ends = row[kept], starts[kept], ends[kept]
    take = np.zeros(len(data) + 1, np.int8)
    take[starts] = 1
    take[ends] -= 1
    take = np.cumsum(take[:-1], dtype=np.int8).astype(bool)
    # the byte before a word that follows another in its row separates them
    gap = starts[1:][row[1:] == row[:-1]] - 1
    take[gap] = True
    out = data.copy()
    out[gap] = 0x20
    return out[take], np.concatenate(([0], np.cumsum(take)))[off]


_SCAN = "doc_id long, doc long, th long, n_words long, sha string, grams array<long>, s1 array<int>, windows array<byte>"


def _scan(p: Phrases):
    """Number of words, digest of the words, and the anchors of each text: hash, first window, windows."""

    @T.lean
    def run(batches):
        for batch in batches:
            data, off = T.utf8(batch.column("text"))
            for i, j in T.pieces(off, T.CHUNK_BYTES // 2):
                o, raw = off[i : j + 1] - off[i], data[off[i] : off[j]]
                h, row, starts, ends = T.words(raw, o, fold=False)
                n = np.bincount(row, minlength=j - i)
                text, cut = _plain(raw, o, row, starts, ends, np.ones(len(row), bool))
                text = text.tobytes()
                sha = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                grams = Spans(h).all(p.gram)
                own = owners(grams, p.reach)
                last = np.cumsum(n)[row[: len(own)]]
                s = np.flatnonzero(np.arange(len(own)) + p.words <= last)
                a, r = own[s], row[s]
                new = np.ones(len(s), bool)
                new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
                first = np.flatnonzero(new)
                each = np.bincount(r[first], minlength=j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(i, j - i) for c in ("doc_id", "doc", "th")),
                        pa.array(n),
                        pa.array(sha, pa.string()),
                        T.lists(T.i64(grams[a[first]]), each, pa.int64()),
                        T.lists((s[first] - (np.cumsum(n) - n)[r[first]]).astype(np.int32), each, pa.int32()),
                        T.lists(np.diff(np.append(first, len(s))).astype(np.int8), each, pa.int8()),
                    ],
                    ["doc_id", "doc", "th", "n_words", "sha", "grams", "s1", "windows"],
                )

    return run


_PLACES = "doc long, th long, gram long, piece int, s1 int, windows int, raw binary"


def _around(p: Phrases):
    """The words that the windows of each anchor left span, from texts with their anchors."""

    @T.lean
    def run(batches):
        for batch in batches:
            data, off = T.utf8(batch.column("text"))
            for i, j in T.pieces(off):
                lists = batch.column("places").slice(i, j - i)
                at, each = lists.flatten(), np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(j - i), each)
                o, raw = off[i : j + 1] - off[i], data[off[i] : off[j]]
                starts, ends = _edges(raw, o)
                s1, windows = at.field("s1").to_numpy().astype(np.int64), at.field("windows").to_numpy().astype(np.int64)
                begin = np.searchsorted(starts, o)[row] + s1
                a, b = starts[begin], ends[begin + windows + p.words - 2]
                doc, th = (batch.column(c).slice(i, j - i).to_numpy()[row] for c in ("doc", "th"))
                for x, y in T.pieces(np.concatenate(([0], np.cumsum(b - a))), 2 * T.CHUNK_BYTES):
                    text = [raw[s:e].tobytes() for s, e in zip(a[x:y], b[x:y], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[x:y]), pa.array(th[x:y]), *(at.field(c).slice(x, y - x) for c in ("gram", "piece", "s1")), pa.array(windows[x:y].astype(np.int32)), pa.array(text, pa.binary())],
                        ["doc", "th", "gram", "piece", "s1", "windows", "raw"],
                    )

    return run


_FOUND = "doc long, th long, a int, b int, v long, kind byte"


def occurrences(symbols: np.ndarray, shard: np.ndarray, passages: list[tuple[int, int]]) -> np.ndarray:
    """Which symbols the passages, given by where they begin and end, cover wherever they occur. Symbol 0
    parts texts and is in no passage; only places with the same number in ``shard`` meet."""
    import ahocorasick

    # code points without the surrogates, which no string may hold
    text = np.where(symbols < 0xD800, symbols, symbols + 0x800).astype("<u4").tobytes().decode("utf-32-le")
    cover = np.zeros(len(symbols) + 1, np.int64)
    cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
    k = 0
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        automaton = ahocorasick.Automaton()
        while k < len(passages) and passages[k][0] < e:
            a, b = passages[k]
            automaton.add_word(text[a:b], b - a)
            k += 1
        if len(automaton):
            automaton.make_automaton()
            found = np.array(list(automaton.iter(text, s, e)), np.int64)
            np.add.at(cover, found[:, 0] - found[:, 1] + 1, 1)
            np.add.at(cover, found[:, 0] + 1, -1)
    return np.cumsum(cover[:-1]) > 0


def _located(rows: pa.RecordBatch, p: Phrases):
    """Words covered by occurrences of recurring passages; of anchors in pieces, windows to be met elsewhere (kind 1: single, 2: not)."""
    data, off = T.utf8(rows.column("raw"))
    h, row, _, _ = T.words(data, off, fold=False)
    n = np.bincount(row, minlength=rows.num_rows)
    begin = np.cumsum(n) - n
    # every window of these texts
    at = np.flatnonzero(np.arange(len(h)) - begin[row] + p.words <= n[row])
    v = Spans(h).all(p.words)[at]
    order = np.argsort(v, kind="stable")
    new = np.ones(len(v), bool)
    new[1:] = v[order[1:]] != v[order[:-1]]
    twice = np.ones(len(v), bool)
    twice[order[new & np.append(new[1:], True)]] = False
    hit = at[twice]
    # confirmed passages: runs of recurring windows within a text
    start = np.ones(len(hit), bool)
    start[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
    a = hit[start]
    b = hit[np.append(np.flatnonzero(start)[1:], len(hit)) - 1] + p.words if len(hit) else hit
    # each word a symbol, each text ended by 0
    symbols = np.zeros(len(h) + len(n), np.int64)
    moved = np.arange(len(h)) + row
    symbols[moved] = np.unique(h, return_inverse=True)[1] + 1
    ends = np.cumsum(n + 1)
    # whole anchors, until there are enough places
    cuts = T.boundaries(rows, ["gram"])
    group = np.zeros(rows.num_rows, np.int64)
    last = 0
    for c in cuts.tolist():
        if c - last >= p.automaton_rows:
            group[c], last = 1, c
    shard = np.repeat(np.cumsum(group), n + 1)
    covered = occurrences(symbols, shard, list(zip((a + row[a]).tolist(), (b + row[b - 1]).tolist(), strict=True)))
    edge = np.flatnonzero(np.diff(covered, prepend=False, append=False))
    x, y = edge[::2], edge[1::2]
    text = np.searchsorted(ends, x, "right")
    doc, th, s1 = (rows.column(c).to_numpy() for c in ("doc", "th", "s1"))
    base = s1 - (ends - n - 1)
    zero = np.zeros(len(x), np.int64)
    yield _batch(doc[text], th[text], base[text] + x, base[text] + y, zero, zero)
    first = order[new]
    far = first[rows.column("piece").to_numpy()[row[at[first]]] > 0]
    if len(far):
        w, r = at[far], row[at[far]]
        yield _batch(doc[r], th[r], s1[r] + w - begin[r], s1[r] + w - begin[r] + p.words, T.i64(v[far]), np.where(twice[far], 2, 1))


def _batch(doc, th, a, b, v, kind) -> pa.RecordBatch:
    cols = [pa.array(doc), pa.array(th), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(v), pa.array(kind.astype(np.int8))]
    return pa.RecordBatch.from_arrays(cols, ["doc", "th", "a", "b", "v", "kind"])


def _locate(p: Phrases):
    @T.lean
    def run(batches):
        for group in T.by_group(batches, ["gram", "piece"]):
            size = np.cumsum(pc.binary_length(group.column("raw")).to_numpy())
            cuts = np.append(T.boundaries(group, ["gram", "piece"]), group.num_rows)
            first, before = 0, 0
            for c in cuts[1:].tolist():
                if size[c - 1] - before > T.CHUNK_BYTES // 2 or c == group.num_rows:
                    yield from _located(group.slice(first, c - first), p)
                    first, before = c, size[c - 1]

    return run


_DONE = "doc long, th long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _removed(texts: bool):
    @T.lean
    def run(batches):
        for batch in batches:
            data, off = T.utf8(batch.column("text"))
            for i, j in T.pieces(off):
                o, raw = off[i : j + 1] - off[i], data[off[i] : off[j]]
                starts, ends = _edges(raw, o)
                first = np.searchsorted(starts, o)
                row = np.repeat(np.arange(j - i), np.diff(first))
                lists = batch.column("runs").slice(i, j - i)
                at, each = lists.flatten(), np.diff(lists.offsets.to_numpy())
                base = first[np.repeat(np.arange(j - i), each)]
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, base + at.field("a").to_numpy(), 1)
                np.add.at(cover, base + at.field("b").to_numpy(), -1)
                gone = np.cumsum(cover[:-1]) > 0
                text, cut = _plain(raw, o, row, starts, ends, ~gone)
                text = text.tobytes()
                kept = [text[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                # runs of removed words; one does not go on in the next row
                new = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
                opened = np.flatnonzero(gone & (new | ~np.concatenate(([False], gone[:-1]))[: len(gone)]))
                closed = np.flatnonzero(gone & np.concatenate(((new | ~gone)[1:], [True]))) + 1 if len(gone) else opened
                spans = pa.StructArray.from_arrays([pa.array((x - first[row[opened]]).astype(np.int32)) for x in (opened, closed)], ["start", "end"])
                count = np.bincount(row[opened], minlength=j - i)
                cols = [
                    *(batch.column(c).slice(i, j - i) for c in ("doc", "th")),
                    pa.array(np.bincount(row[gone], minlength=j - i)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), spans),
                ]
                names = ["doc", "th", "n_removed", "kept_sha256", "spans"]
                if texts:
                    cols.append(pa.array([x.decode() for x in kept], pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_passages(docs: DataFrame, p: Phrases | None = None, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 of the remaining words joined by
    one space, spans of removed words (from, up to but without; counted from 0), and with ``texts`` those words.

    Every word covered by a window of ``words`` words whose sequence also starts elsewhere, in the same
    text or another, is removed; all are judged on the input. Words are runs without ASCII white space
    and taken as they are. A null text has none; rows that repeat a text are copies of each other, and
    a doc_id may be null or repeated. Other columns are ignored; an empty table gives an empty result.
    """
    p = p or Phrases()
    n = T.tasks(docs.sparkSession)
    text = F.coalesce(T.column(docs, text_col, "string"), F.lit(""))
    src = docs.select(T.column(docs, id_col, "long").alias("doc_id"), text.alias("text"))
    src = src.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("doc"), F.xxhash64("text").alias("th"), "text")
    scan = T.stored(src.mapInArrow(_scan(p), _SCAN))
    unit = F.struct("doc", "th")
    copies = scan.where(F.col("n_words") >= p.words).groupBy("sha").agg(F.count("*").alias("n"), F.min(unit).alias("rep"))
    copies = T.stored(copies.where("n > 1").select("sha", "n", F.col("rep.doc").alias("rep_doc"), F.col("rep.th").alias("rep_th")))

    # of the copies of a text one goes on
    some = scan.where(F.col("n_words") >= p.words).join(copies, "sha", "left")
    kept = ["doc", "th", "grams", "s1", "windows"]
    once = some.where("n is null").select(*kept).unionByName(some.where("doc = rep_doc and th = rep_th").select(*kept).dropDuplicates(["doc", "th"]))
    anchors = T.stored(once.select("doc", "th", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("s1"), F.col("windows")))).toDF("doc", "th", "gram", "s1", "windows"))
    many = T.stored(anchors.groupBy("gram").agg(F.count("*").alias("places")).where("places > 1"))
    piece = F.when(F.col("places") > p.piece_rows, 1 + F.pmod(F.xxhash64("doc", "th", "s1"), F.ceil(F.col("places") / p.piece_rows))).otherwise(0).cast("int")
    left = anchors.join(many, "gram").select("doc", "th", F.struct("gram", piece.alias("piece"), "s1", F.col("windows").cast("int").alias("windows")).alias("place"))
    lists = left.groupBy("doc", "th").agg(F.collect_list("place").alias("places"))
    candidates = T.stored(src.select("doc", "th", "text").join(lists, ["doc", "th"]))
    T.discard(anchors, many)

    places = candidates.mapInArrow(_around(p), _PLACES)
    dealt = places.repartition(n, "gram", "piece").sortWithinPartitions("gram", "piece")
    found = T.stored(dealt.mapInArrow(_locate(p), _FOUND))
    across = found.where("kind > 0")
    met = across.groupBy("v").agg(F.count("*").alias("_n")).where("_n > 1")
    late = across.where("kind = 1").join(met, "v").select("doc", "th", "a", "b")
    per_text = found.where("kind = 0").select("doc", "th", "a", "b").unionByName(late).groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    # repeated rows of a text have the same result
    done = candidates.select("doc", "th", "text").dropDuplicates(["doc", "th"]).join(per_text, ["doc", "th"])
    done = T.stored(done.mapInArrow(_removed(texts), _DONE + ", kept string" * texts))
    T.discard(candidates, found)

    whole = F.col("n").isNotNull()
    all_words = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    out = scan.select("doc_id", "doc", "th", "n_words", "sha").join(copies.select("sha", "n"), "sha", "left").join(done, ["doc", "th"], "left")
    out = out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, all_words).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
        *([F.when(whole, "").otherwise(F.col("kept")).alias("kept"), "doc", "th"] if texts else []),
    )
    if texts:
        # texts without a removal come from the source
        plain = F.array_join(F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), ""), " ")
        own = src.select("doc", "th", plain.alias("own")).dropDuplicates(["doc", "th"])
        out = out.join(own, ["doc", "th"], "left").withColumn("kept", F.coalesce("kept", "own")).drop("own", "doc", "th")
    return out
