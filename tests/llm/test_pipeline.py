"""Every stage of the pipeline against a brute-force version, each on what the stage before it kept."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from orrery.llm import decontam, langid
from tests.llm.conftest import prose
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_text_operators import SPEECH, base_spans, plain_bundle

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(17)
    words = {x: t.split() for x, t in SPEECH.items()}
    speech = lambda x, n: " ".join(r.choice(words[x]) + r.choice(["", "", "er", "is", "on"]) for _ in range(n))
    items = [(n, prose(9100 + n, 24)) for n in range(3)]
    rows = []
    for n in range(36):
        x = list(SPEECH)[n % 3]
        text = speech(x, 40 + 3 * (n % 11))
        if n % 9 == 4:
            w = items[n % 3][1].split()
            text += " " + " ".join(w if n % 2 else ["odd" if k % 8 == 3 else v for k, v in enumerate(w)])
        if n % 7 == 1:
            text += f" write to a{n}@mail.example.org or +1 202 555 0{100 + n} from 10.0.0.{n} paid 4111 1111 1111 1111"
        rows.append((n, text, x if n % 5 else None))
    # copies, near copies in a chain, and texts that just differ too much
    for n in (0, 6, 12):
        w = rows[n][1].split()
        rows += [(100 + n, rows[n][1], "en"), (200 + n, " ".join(w[:-2]), "en"), (300 + n, " ".join(w[:-4]), None), (400 + n, " ".join(w[: len(w) // 2]), "en")]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 345 !!", None), (903, "ქართული ენა არის ძველი და ლამაზი, მთებსა და ზღვას შორის მდებარე ქვეყნის ენა უძველესი დამწერლობით", None), (904, "hm", None), (905, speech("fr", 4000), "fr")]
    r.shuffle(rows)
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(d, t, x, "s", None if d % 2 else len(t or "")) for d, t, x in rows], KIND).repartition(4)
    # columns that a stage might use itself
    from pyspark.sql import functions as F

    docs.withColumns({c: F.lit(1) for c in ("score", "rep", "kept", "masked", "letters", "th")}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def plain_languages(rows):
    p = langid.LangId()
    bundle = {d: plain_bundle(t or "", p) for d, t, *_ in rows if len(t or "") < 3000}
    long = [d for d, t, *_ in rows if len(t or "") >= 3000]
    for d in long:  # letter by letter takes too long; the same sum over counted trigrams
        found, _ = langid.bundles([next(t for e, t, *_ in rows if e == d)], langid.Vectors(p))
        bundle[d] = found[0]
    protos = {x: sum(bundle[d] for d, _, y, *_ in rows if y == x) for x in {y for _, _, y, *_ in rows if y}}
    out = {}
    for d, t, x, *_ in rows:
        letters = sum(c.isalpha() for c in t or "")
        norm = np.linalg.norm(bundle[d])
        if not letters or not norm:
            continue
        cosine = {y: bundle[d] @ v / norm / np.linalg.norm(v) for y, v in protos.items()}
        best = max(sorted(cosine), key=cosine.get)
        if letters < corpus_pipeline.MIN_LETTERS or cosine[best] >= corpus_pipeline.MIN_SCORE:
            out[d] = x or best
    return out


def plain_leaks(rows, items):
    p = decontam.Decontamination()
    said = lambda t: [x for x in re.split(r"[^\w]+", (t or "").lower()) if x]
    code: dict = {}
    number = lambda t: np.array([code.setdefault(x, len(code) + 1) for x in said(t)], np.uint64)
    best = {d: max(decontam.smith_waterman(number(i), number(t), p)[0] / (p.match * len(said(i))) for _, i in items) if said(t) else 0 for d, t, *_ in rows}
    return {d for d, v in best.items() if v >= p.similarity}


def test_each_stage_against_brute_force(spark, corpus):
    path, items = corpus
    stages = dict(corpus_pipeline.STAGES)
    take = lambda df: [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = take(docs)

    now = stages["language_id"](spark, docs, path)
    want = plain_languages(rows)
    assert sorted(take(now)) == sorted((d, t, want[d], s, n) for d, t, _, s, n in rows if d in want)
    assert {900, 901, 902, 903}.isdisjoint(want) and 904 in want

    before, now = now, stages["near_dedup"](spark, now, path)
    rows = take(before)
    of, _ = near_brute([(d, t) for d, t, *_ in rows], 5, 80)
    assert sorted(take(now)) == sorted(x for x in rows if of[x[0]] == x[0]) and len({*of.values()}) < len(of) - 5

    before, now = now, stages["decontaminate"](spark, now, path)
    rows = take(before)
    leaks = plain_leaks(rows, items)
    assert sorted(take(now)) == sorted(x for x in rows if x[0] not in leaks) and len(leaks) >= 3

    before, now = now, stages["pii"](spark, now, path)
    want = []
    for d, t, x, s, _ in take(before):
        out, end = "", 0
        for a, kind, b in base_spans(t):
            if a >= end:
                out, end = out + t[end:a] + f"<{kind.upper()}>", b
        out += t[end:]
        want.append((d, out, x, s, len(out)))
    assert sorted(take(now)) == sorted(want) and sum("<EMAIL>" in x[1] for x in want) >= 3

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for d, t, *_ in take(now):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            pieces[d, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())] += 1
    packed = stages["pack"](spark, now, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1]) and sum(n for _, n in parts) <= 4096
    assert len(places) <= -(-sum(r.length for r in packed) // 4096) + 1

    whole = corpus_pipeline.run(spark, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == pieces
