"""Packing against the tokenizer itself, and its invariants."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")


def test_ids_and_places(odd_docs, odd_rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(FILE)
    got = packing.pack(odd_docs, packing.Packing(FILE, length=64, group_rows=50)).collect()
    want = Counter()
    for d, t in odd_rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 64)):
            want[d, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 64
    total = sum(r.length for r in got)
    assert len(seqs) <= 1.02 * -(-total // 64) + 2


def test_empty_table(no_docs):
    assert packing.pack(no_docs, packing.Packing(FILE)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=120))
def test_sum_of_squares_is_chosen_greedily(lengths):
    """Each item goes where a plain recount of the sum of squares is smallest."""
    bins, offsets, fill = packing.sum_of_squares(np.array(lengths, np.int64), 32)
    gaps: list[int] = []

    def total(g):
        return sum(v * v for v in Counter(x for x in g if 0 < x < 32).values())

    for s, b in zip(lengths, bins, strict=True):
        options = [total([*gaps, 32 - s])] + [total([*gaps[:k], g - s, *gaps[k + 1 :]]) for k, g in enumerate(gaps) if g >= s]
        if b == len(gaps):
            gaps.append(32 - s)
        else:
            gaps[b] -= s
        assert gaps[b] >= 0 and total(gaps) == min(options)
    assert [32 - g for g in gaps] == fill.tolist()


@pytest.mark.parametrize("text", ["a\x1cb c", "x\xa0y　z", "e ́x", "<|endoftext|> hi. <|ENDOFTEXT|>", "don't 12 345 ,,.. É, ÀÉ.", "ΣΑΣ, ΑΣ. Σ", "it's'S", "\x01 a\x01b \x01", "İ. K, ſ.", "word.,! (x)", "ﬁne ﬁ."])
def test_words_give_the_tokenizer_s_ids(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids
    w = packing.WordTokenizer(FILE, 1000)
    raw = np.frombuffer(f"{text}{text.upper()}".encode(), np.uint8)
    off = np.array([0, len(text.encode()), len(raw)])
    for _ in range(2):
        assert packing.text_ids(w, raw, off)[0].tolist() == want


def test_equal_rows_spread_over_groups(spark):
    """Rows equal in everything, and rows without an id, are dealt like any others."""
    docs = spark.createDataFrame([(None, "same few words")] * 400 + [(7, "same few words")] * 400, "doc_id long, text string").repartition(3)
    got = packing.pack(docs, packing.Packing(FILE, length=1024, group_rows=50)).collect()
    assert Counter(r.doc_id for r in got) == {None: 400, 7: 400}
    groups = Counter(r.sequence_id >> 20 for r in packing._round(packing.T.saved(docs.mapInArrow(packing._tokenise(packing.Packing(FILE, length=1024)), packing._PIECES)), packing.Packing(FILE, length=1024, group_rows=50)).selectExpr("grp * 1048576 + bin AS sequence_id").collect())
    assert len(groups) == 16 and max(groups.values()) < 90
