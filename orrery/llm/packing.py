"""Sum-of-squares bin packing of tokenised documents into fixed-length sequences.

Documents are tokenised in one scan, which keeps a few numbers per piece. Pieces are
dealt evenly to groups of bounded size by a hash of their place in the scan, and not by
what they hold, so a hot source or a crowd of equal rows spreads like anything else. Each group packs its pieces, longest
first: with N(g) open sequences of residual gap g, a piece goes where the sum of
N(g)**2 becomes smallest, over all gaps it fits and a new sequence. Sequences that a
group leaves with a gap are opened again and their pieces packed together over all
groups in a second round, whose input is a small share of the first.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textops as T


@dataclass(frozen=True)
class Packing:
    """tokenizer: file of the vocabulary; end_id closes each document.

    group_rows bounds the pieces that one task packs, below 2**20. cache_words bounds the words whose
    ids a worker remembers, chunk_bytes the text it handles at once.
    """

    tokenizer: str
    length: int = 4096
    end_id: int = 1
    group_rows: int = 20_000
    cache_words: int = 1_500_000
    chunk_bytes: int = 1 << 20


class WordTokenizer:
    """Ids of whole texts from a word-level cache over a tokenizer that drops white space.

    Such a tokenizer never joins characters across white space, so a text's ids are the
    ids of its white-space separated words in order. The cache holds the 64-bit hash, the
    place and the number of ids of each word in arrays; a chunk's words are hashed and
    looked up together. An unknown word is put together from its letters and a final mark
    where possible, and what is left is encoded in long lines, a word between marks.
    """

    MARK = "\x01"

    def __init__(self, path: str, cache_words: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = cache_words
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        folds = self.tokenizer.encode("Az", add_special_tokens=False).ids == self.tokenizer.encode("az", add_special_tokens=False).ids
        self.lines = len(self.mark) == 1 and folds
        #: words may be known by their ASCII lower case
        self.folds = folds
        self.letters, self.dot = self._for_letters(path)
        self.reset()

    def _for_letters(self, path: str):
        """The same merges without the steps that leave a word of small Latin letters as it is."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        dot = self.tokenizer.encode(".", add_special_tokens=False).ids
        if not self.lines or spec["model"].get("type") != "BPE" or not spec["model"].get("end_of_word_suffix") or len(dot) != 1:
            return None, None
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec |= {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}}
        return Tokenizer.from_str(json.dumps(spec)), dot[0]

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, "<u4")
        self.used = 0

    def _between(self, tokenizer, parts: list[str], mark: str, mark_id: int) -> dict[str, np.ndarray]:
        found: dict[str, np.ndarray] = {}
        lines = [f" {mark} ".join(parts[i : i + 500]) for i in range(0, len(parts), 500)]
        for k, e in enumerate(tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = np.append(np.flatnonzero(ids == mark_id), len(ids)).tolist()
            at = 0
            for x, c in zip(parts[500 * k : 500 * k + 500], cuts, strict=True):
                found[x] = ids[at:c]
                at = c + 1
        return found

    def encoded(self, parts: list[str]) -> dict[str, np.ndarray]:
        """The ids of each of some distinct words."""
        small = [x for x in parts if x.isalpha() and x.islower() and (x.isascii() or max(x) <= "\xff")] if self.letters else []
        found = self._between(self.letters, small, ".", self.dot) if small else {}
        others = [x for x in parts if x not in found]
        joined = [x for x in others if self.MARK not in x] if self.lines else []
        found |= self._between(self.tokenizer, joined, self.MARK, self.mark[0])
        for x in others:
            if x not in found:
                found[x] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4")
        return found

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Add words under their hashes, which are sorted and not yet known."""
        stems, ends, mark = [], [], {}
        if self.lines:
            mark = self.encoded([".", ","])
            for w in words:
                end = w[-1]
                if (end == "." or end == ",") and w[:-1].lower().isalpha():
                    stems.append(w[:-1])
                    ends.append(end)
                else:
                    stems.append(w)
                    ends.append("")
        else:
            stems, ends = words, [""] * len(words)
        ids = self.encoded(list(dict.fromkeys(stems)))
        nothing = np.zeros(0, "<u4")
        parts = [x for stem, end in zip(stems, ends, strict=True) for x in (ids[stem], mark[end] if end else nothing)]
        count = np.fromiter(map(len, parts), np.int64, len(parts)).reshape(-1, 2).sum(axis=1)
        new = np.concatenate(parts) if parts else nothing
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), "<u4")))
        self.flat[self.used : self.used + len(new)] = new
        place = self.used + np.cumsum(count) - count
        self.used += len(new)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place, self.count = np.insert(self.keys, at, keys), np.insert(self.place, at, place), np.insert(self.count, at, count)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of some UTF-8 bytes, and the number of ids of each row."""
        n = len(off) - 1
        h, row, start, end = T.words(data, off, fold=self.folds)
        if len(h) == 0:
            return np.zeros(0, "<u4"), np.zeros(n, np.int64)
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        for again in (False, True):
            at = np.minimum(np.searchsorted(self.keys, u), max(len(self.keys) - 1, 0))
            fresh = self.keys[at] != u if len(self.keys) else np.ones(len(u), bool)
            if again or not fresh.any():
                break
            if len(self.keys) + int(fresh.sum()) > self.most and len(self.keys):
                self.reset()
                fresh = np.ones(len(u), bool)
            raw = data.tobytes()
            f = first[fresh]
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[f].tolist(), end[f].tolist(), strict=True)]
            if self.folds:
                words = [w.lower() if w.isascii() else w for w in words]
            self.learn(u[fresh], words)
        place, count = self.place[at][inverse], self.count[at][inverse]
        ids = self.flat[np.repeat(place - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        return ids, np.bincount(row, count, n).astype(np.int64)

    def special(self, text: str) -> np.ndarray:
        """Ids of a text that may hold special tokens, whose case matters."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


_WORKER: dict[tuple[str, int], WordTokenizer] = {}


def worker_tokenizer(path: str, cache_words: int) -> WordTokenizer:
    """The tokenizer of this worker process, which tasks that follow each other share."""
    if (path, cache_words) not in _WORKER:
        _WORKER[path, cache_words] = WordTokenizer(path, cache_words)
    return _WORKER[path, cache_words]


def text_ids(tok: WordTokenizer, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The ids of each row."""
    ids, count = tok(data, off)
    out = np.split(ids, np.cumsum(count)[:-1]) if len(count) else []
    # `<|` may begin a special token
    hit = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else []
    for r in np.unique(np.searchsorted(off, hit, "right") - 1) if len(hit) else ():
        out[r] = tok.special(data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace"))
    return out


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def _tokenise(p: Packing):
    @T.lean
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of = worker_tokenizer(p.tokenizer, p.cache_words)
        end = np.array([p.end_id], "<u4")
        # the result is stored at once, so a place stays the same from here on
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, off = T.utf8(batch.column(1))
            docs = batch.column(0).cast(pa.int64()).to_pylist()
            for i, j in T.pieces(off, p.chunk_bytes):
                out = [[] for _ in range(5)]
                for d, ids in zip(docs[i:j], text_ids(ids_of, data[off[i] : off[j]], off[i : j + 1] - off[i]), strict=True):
                    ids = np.concatenate((ids, end))
                    for k, s in enumerate(range(0, len(ids), p.length)):
                        part = ids[s : s + p.length]
                        for c, v in zip(out, (d, k, s, len(part), zlib.crc32(part)), strict=True):
                            c.append(v)
                deal = T.i64(T.mix(np.arange(place, place + len(out[0]), dtype=np.uint64)))
                place += len(out[0])
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, kinds, strict=True)), pa.array(deal)], ["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item and the fill of each bin, packing in the given order.

    Moving an open bin from gap g to g - s changes the sum of squares by
    2 N(g-s) - 2 N(g) + 2, filling one to the brim by 1 - 2 N(g), and opening one by
    2 N(C-s) + 1 (nothing, if the item fills it). Ties go to the smaller resulting gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offset, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for n, s in enumerate(lengths.tolist()):
        left = capacity - s
        best, gap = (2 * int(count[left]) + 1 if left else 0), -1
        live = np.flatnonzero(count[s:]) + s
        if len(live):
            after = live - s
            cost = 2 * count[after] - 2 * count[live] + 2
            if after[0] == 0:
                cost[0] = 1 - 2 * count[s]
            k = int(np.argmin(cost))
            if cost[k] <= best:
                gap = int(live[k])
        if gap < 0:
            b, gap = len(fill), capacity
            fill.append(0)
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[n], offset[n] = b, fill[b]
        fill[b] += s
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offset, np.array(fill, np.int64)


_PACKED = _PIECES + ", bin long, offset long, fill long, grp long"


def _pack(p: Packing):
    @T.lean
    def run(batches):
        for batch in T.by_group(batches, ["grp"]):
            length = batch.column("length").to_numpy()
            deal = batch.column("deal").to_numpy()
            cuts = np.append(T.boundaries(batch, ["grp"]), batch.num_rows)
            b, o, f = (np.empty(batch.num_rows, np.int64) for _ in range(3))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                order = s + np.lexsort((batch.column("piece").to_numpy()[s:e], deal[s:e], -length[s:e]))
                bins, offset, fill = sum_of_squares(length[order], p.length)
                b[order], o[order], f[order] = bins, offset, fill[bins]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "deal")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(b), pa.array(o), pa.array(f), batch.column("grp")], ["doc_id", "piece", "start", "length", "ids_crc32", "deal", "bin", "offset", "fill", "grp"])

    return run


def _round(rows: DataFrame, p: Packing) -> DataFrame:
    groups = max(1, -(-rows.count() // p.group_rows))
    dealt = rows.withColumn("grp", F.pmod(F.col("deal"), F.lit(groups)).cast("long"))
    dealt = dealt.repartition(min(groups, 4 * T.tasks(rows.sparkSession)), "grp").sortWithinPartitions("grp")
    return T.saved(dealt.mapInArrow(_pack(p), _PACKED))


def pack(docs: DataFrame, p: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and then end_id, so a null or empty text is one piece of
    one id. Only documents longer than a sequence are cut. Repeated rows are packed as
    often as they occur; doc_id may be null. Offsets within a sequence run from 0 without
    gaps. Other columns are ignored; an empty table gives an empty result.
    """
    src = docs.select(T.column(docs, id_col, "long").alias("doc_id"), T.column(docs, text_col, "string").alias("text"))
    pieces = T.saved(src.mapInArrow(_tokenise(p), _PIECES))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == p.length).select(*keep, (F.lit(1 << 52) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = _round(pieces.where(F.col("length") < p.length), p)
    second = _round(first.where(F.col("fill") < p.length).select(*pieces.columns), p)
    place = [(F.col("grp") * F.lit(1 << 20) + F.col("bin")), F.col("offset")]
    done = first.where(F.col("fill") == p.length).select(*keep, place[0].alias("sequence_id"), place[1])
    rest = second.select(*keep, (F.lit(1 << 51) + place[0]).alias("sequence_id"), place[1])
    return full.unionByName(done).unionByName(rest)
