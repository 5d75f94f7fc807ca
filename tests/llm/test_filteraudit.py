"""The filter audit against filters run one after the other."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from orrery.llm import filteraudit
from tests.llm.conftest import prose

FILTERS = "ABCDE"
WEIGHTS = {"good": "quality = 1", "toxic": "toxic = 1"}


def failures(rows):
    """part, good, toxic and the letters of the filters failed, for each row of (doc_id, text, lang)."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, lang in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = (
            ("A" if len(w) < 100 else "")
            + ("B" if 100 * len(set(w)) < 80 * len(w) else "")
            + ("C" if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else "")
            + ("D" if set(t) & set("#$%&*|") else "")
            + ("E" if d is not None and d > least[t] else "")
        )
        yield d, lang or "", fails


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out, shapley = {}, Counter()
    found = list(failures(rows))
    for part in {p for _, p, _ in found}:
        docs = [(d, f) for d, p, f in found if p == part]
        for order in map("".join, permutations(FILTERS)):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                failing = sum(x in f for _, f in docs)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(f == x for _, f in docs), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                shapley[part, x] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    flags = filteraudit.with_labels(filteraudit.text_failures(docs), labels, WEIGHTS)
    return filteraudit.audit(filteraudit.joint_failures(flags, FILTERS, weights=list(WEIGHTS)), FILTERS, weights=list(WEIGHTS))


def same(docs, rows, labels_frame, labels):
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.lost_good, r.lost_toxic, r.shapley) for r in audited(docs, labels_frame).collect()}
    assert got == brute(rows, labels)


LABELS = "doc_id long, quality int, toxic int, part string, A int"


def test_mixed_documents(spark):
    rows = []
    for n in range(160):
        t = prose(n % 90, 40 + 7 * (n % 23))
        t = t.upper() if n % 7 == 0 else t
        t = t + " # 50%" if n % 5 == 0 else t
        t = " ".join([t[:90]] * 12) if n % 11 == 0 else t
        rows.append((n, t, [None, "en", "de", ""][n % 4]))
    labels = [(n, n % 3 % 2, n % 2 if n % 4 else None) for n in range(0, 200, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    same(docs, rows, spark.createDataFrame([(*x, "p", 1) for x in labels], LABELS), labels)


def test_odd_texts(spark, odd_docs, odd_rows):
    """Nulls, repeated ids and rows, empty and very long texts, clashing columns, labels that repeat or lack an id."""
    labels = [(1, 1, None), (1, 0, 1), (2, None, None), (None, 1, 1), (8, 1, 1), (77, 1, 1)]
    rows = [(d, t, "en" if n % 2 else None) for n, (d, t) in enumerate(odd_rows)]
    extra = odd_docs.withColumns({c: F.lit("x") for c in ("A", "E", "part", "digest", "first", "words")})
    same(extra, rows, spark.createDataFrame([(*x, None, 7) for x in labels], LABELS), labels)


def test_no_rows(spark, no_docs):
    none = spark.createDataFrame([], LABELS)
    assert audited(no_docs, none).count() == 0
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    same(docs, [(1, "a b", "en")], none, [])


def test_any_flags(spark):
    """Two filters over flags made elsewhere."""
    flags = spark.createDataFrame([("p", 1, 0), ("p", 1, 1), ("p", 0, 0), ("q", 0, 1)], "part string, X int, Y int")
    got = {tuple(r) for r in filteraudit.audit(filteraudit.joint_failures(flags, "XY"), "XY").collect()}
    assert got == {
        ("p", "XY", 1, 1, 2, 0, 1, 3), ("p", "XY", 2, 1, 0, 1, 0, 1), ("p", "YX", 1, 2, 1, 0, 0, 1), ("p", "YX", 2, 1, 1, 1, 1, 3),
        ("q", "XY", 1, 1, 0, 0, 0, 0), ("q", "XY", 2, 0, 1, 0, 1, 2), ("q", "YX", 1, 0, 1, 0, 1, 2), ("q", "YX", 2, 0, 0, 0, 0, 0),
    }
    with pytest.raises(ValueError):
        filteraudit.audit(filteraudit.joint_failures(flags, "XY"), ["X", "YY"])
