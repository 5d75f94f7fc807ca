"""Language ID, PII, decontamination, URL filter, HTML extraction, sharding and the pipeline."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from orrery.llm import decontam, htmlextract, langid, pii, sharding, urlfilter
from tests.llm.conftest import prose


# language identification -------------------------------------------------------------

SPEECH = {
    "en": "the weather was fine and they walked through the old town with their friends before the evening came ",
    "de": "das wetter war schön und sie gingen durch die alte stadt mit ihren freunden bevor der abend kam ",
    "fr": "le temps était beau et ils marchaient dans la vieille ville avec leurs amis avant que le soir arrive ",
}


def test_language_of_held_out_texts(spark):
    rows = []
    for lang, text in SPEECH.items():
        words = text.split()
        for k in range(30):
            rows.append((len(rows), " ".join(words[(k * 7 + i * 3) % len(words)] for i in range(12)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs.where("doc_id % 3 <> 0"))
    got = langid.predict(docs.where("doc_id % 3 = 0"), model, keep=["doc_id"]).collect()
    want = {r[0]: r[2] for r in rows}
    assert len(got) == 30 and sum(r.lang_pred == want[r.doc_id] for r in got) >= 29
    assert all(0 <= r.score <= 1 for r in got)


SCRIPTS = {
    "el": "ο καιρός ήταν καλός και περπάτησαν μέσα από την παλιά πόλη με τους φίλους τους πριν έρθει το βράδυ",
    "ru": "погода была хорошая и они гуляли по старому городу со своими друзьями пока не наступил вечер",
    "bg": "времето беше хубаво и те вървяха през стария град с приятелите си преди да дойде вечерта",
    "ar": "كان الطقس جميلا وساروا عبر المدينة القديمة مع أصدقائهم قبل أن يأتي المساء",
    "zh": "天气很好他们在傍晚到来之前和朋友们一起走过老城看到了河边的花园和许多船",
    "ja": "天気が良かったので彼らは夕方になる前に友達と古い町を歩いて川のそばの庭を見ました",
} | SPEECH


def plain_bundle(text, p):
    """Letter by letter and trigram by trigram."""
    import numpy as np

    def vector(symbol):
        return langid.letter_vectors(np.array([symbol]), p)[0].astype(float)

    sym = [0]
    for c in text:
        s = ord(c.lower()[0]) if c.isalpha() else 0
        if s or sym[-1]:
            sym.append(s)
    sym += [0] if sym[-1] else []
    out = np.zeros(p.dims)
    for a, b, c in zip(sym, sym[1:], sym[2:], strict=False):
        out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


def test_cosines_of_all_scripts(spark, monkeypatch):
    """Predictions and scores equal those of bundles made vector by vector, for nine languages in six scripts."""
    import numpy as np

    p = langid.LangId(dims=256)
    rows = []
    for lang, text in SCRIPTS.items():
        for k in range(6):
            at = k * len(text) // 9
            rows.append((len(rows), text[at : at + len(text) // 2] + "! 12 " * (k % 3), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs.where("doc_id % 3 <> 1"), p)
    plain = {n: plain_bundle(t, p) for n, t, _ in rows}
    protos = {x: sum(plain[n] for n, _, y in rows if y == x and n % 3 != 1) for x in SCRIPTS}
    assert model.langs == sorted(SCRIPTS) and all(np.array_equal(model.protos[n], protos[x]) for n, x in enumerate(model.langs))
    got = langid.predict(docs, model, keep=["doc_id", "lang"]).collect()
    for r in got:
        cosine = {x: plain[r.doc_id] @ v / np.linalg.norm(plain[r.doc_id]) / np.linalg.norm(v) for x, v in protos.items()}
        assert r.lang_pred == max(cosine, key=cosine.get) == r.lang and np.isclose(r.score, cosine[r.lang_pred])
    # letters that a worker has no room to remember, and trigrams in many blocks, change nothing
    monkeypatch.setattr(langid, "KNOWN", 8)
    monkeypatch.setattr(langid, "BLOCK", 7)
    found, _ = langid.bundles([t for _, t, _ in rows], langid.Vectors(p))
    assert all(np.array_equal(found[n], plain[n]) for n in plain)
    # a script that no prototype knows stays at the noise of independent vectors
    strange = langid.predict(spark.createDataFrame([("ქართული ენა არის ძველი და ლამაზი",)], "text string"), model).first()
    assert strange.score < 5 / p.dims**0.5


def test_language_edge_cases(odd_docs, odd_rows, no_docs):
    model = langid.fit(odd_docs)
    got = langid.predict(odd_docs, model, keep=["doc_id", "a b"]).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r.doc_id in (2, 3, 4, 10):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    empty = langid.fit(no_docs)
    assert empty.langs == []
    assert {r.lang_pred for r in langid.predict(odd_docs, empty).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0


# personal data -----------------------------------------------------------------------

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TEXTS = [
    "a.b@c.de, x@y, @z.w, p@q@r.st, m@n.op@t.uv", "1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713, +44 20 7946 0958 12345678",
    "é 4111111111111111é+49 30 123456", "card 4111111111111111 4111111111111111", "", "no data", "IBAN DE89 3704 0044 0532 0130 00 ok, DE89370400440532013001", "@@@ a@b.c..d a@-.-", "user@host.example.com" * 3,
]


def base_spans(text):
    out = []
    for n, (kind, rx) in enumerate(BASE.items()):
        for m in rx.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), n, kind, m.end()))
    return [(s, k, e) for s, _, k, e in sorted(out)]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    got = [(s, k, e) for s, k, e, _ in pii.find(text, pii.Pii()) if k in pii.BASE]
    assert got == base_spans(text)


def test_iban_checksum_context_and_masks():
    p = pii.Pii()
    text = "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not DE89370400440532013001"
    found = [(text[s:e], v) for s, k, e, v in pii.find(text, p) if k == "iban"]
    assert [t for t, _ in found] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    with_word = pii.find("credit card 4111111111111111", p)[0][3]
    assert with_word > pii.find("foo bar 4111111111111111", p)[0][3] > pii.find("phone 4111111111111111", p)[0][3]
    t = "mail a@b.cd or 1.2.3.4"
    assert pii.mask(t, pii.find(t, p)) == "mail <EMAIL> or <IP>"


CODE = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
IBAN = "DE89370400440532013000"


@pytest.mark.parametrize(
    "text, kept, score",
    [
        (f"to {IBAN} now", True, 0.7), (f"the bank has {IBAN} now", True, 0.9), (f"phone {IBAN} now", True, 0.5), (f"phone {IBAN} server", False, None),
        (f"phone, konto {IBAN} server", True, 0.9), (f"banks {IBAN} accounts", True, 0.7), (f"phone {'x' * 40} {IBAN} {'x' * 40} server", True, 0.7),
        (f"commit {CODE} is in", False, None), (f'token = "{CODE}" is in', True, 0.6), (f"{CODE} is the api key", True, 0.6), (f"phone secret {CODE} call", True, 0.6), (f"phone {CODE}", False, None),
        (f"key {'a' * 40}", False, None), (f"key {IBAN}", True, 0.5),
    ],
)
def test_context_keeps_and_drops(text, kept, score):
    """The same IBAN, or code, stays or goes by the words beside it."""
    found = [(k, v) for _, k, _, v in pii.find(text, pii.Pii())]
    assert found == ([("iban" if IBAN in text else "secret", score)] if kept else [])


def test_pii_digest_and_spans(spark):
    rows = [(n, t) for n, t in enumerate([*TEXTS, f"phone {IBAN} server 1.2.3.4", f"key {CODE} a@b.cd " * 3000, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {n: pii.find(t or "", pii.Pii()) for n, t in rows}
    for r in pii.digest(docs).collect():
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, k, e, _ in want[r.doc_id])
        assert r.scores == ",".join(f"{v:.2f}" for *_, v in want[r.doc_id])
        base = base_spans(rows[r.doc_id][1] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in pii.BASE]
    for r in pii.detect(docs, masked=True).collect():
        assert [(x.start, x.kind, x.end, x.score) for x in r.spans] == want[r.doc_id]
        assert r.masked == (None if rows[r.doc_id][1] is None else pii.mask(rows[r.doc_id][1], want[r.doc_id]))


def test_pii_edge_cases(odd_docs, odd_rows, no_docs):
    got = pii.digest(odd_docs).collect()
    assert len(got) == len(odd_rows)
    none = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in got} == {none} and {r.spans for r in got} == {""}
    assert len(pii.detect(odd_docs, masked=True, keep=("a b",)).collect()) == len(odd_rows)
    assert pii.detect(no_docs).count() == 0


# benchmark decontamination -----------------------------------------------------------


def test_smith_waterman_against_a_plain_table():
    import random

    import numpy as np

    r, p = random.Random(1), decontam.Decontamination()
    for _ in range(60):
        a = [r.randrange(6) for _ in range(r.randrange(1, 12))]
        b = [r.randrange(6) for _ in range(r.randrange(1, 25))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = max(0, t[i - 1][j - 1] + (p.match if a[i - 1] == b[j - 1] else p.mismatch), t[i - 1][j] + p.gap, t[i][j - 1] + p.gap)
        score, begin, end = decontam.smith_waterman(np.array(a, np.uint64), np.array(b, np.uint64), p)
        assert score == max(map(max, t))
        # the part it names holds an alignment of that score
        if score:
            again, x, y = decontam.smith_waterman(np.array(a, np.uint64), np.array(b[begin:end], np.uint64), p)
            assert again == score and (x, y) == (0, end - begin)


def test_planted_passages(spark):
    items = [(n, prose(7000 + n, 30)) for n in range(8)] + [(90, None), (91, ""), (92, "two words")]
    rows = [(d, prose(d, 200)) for d in range(60)]
    want = set()
    for n in range(8):
        w = items[n][1].split()
        edited = [x if i % 7 else "changed" for i, x in enumerate(w)]
        shorter = w[:12] + w[14:]
        for k, passage in enumerate((w, edited, shorter, [x.upper() + "," for x in w])):
            d = 100 + 10 * n + k
            rows.append((d, f"{prose(d, 80)} {' '.join(passage)} {prose(d + 5000, 50)}"))
            want.add((d, n))
    rows += [(1000, None), (1001, ""), (None, items[0][1])] + [(2000 + k, f"{prose(9000 + k, 20)} {items[1][1]}") for k in range(50)]
    want |= {(None, 0)} | {(2000 + k, 1) for k in range(50)}
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for p in (decontam.Decontamination(), decontam.Decontamination(slice_chars=300)):
        assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, p).collect()} == want
        clean = decontam.without_contaminated(docs, bench, p).collect()
        assert len(clean) == len(rows) - len(want) and {r.doc_id for r in clean} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontam.contaminated(docs, bench.where("item_id < 0")).count() == 0
    assert decontam.contaminated(docs.where("doc_id < 0"), bench).count() == 0


def test_alignments_against_all_pairs(spark):
    """Documents and items found, and their similarities, are those of aligning every text with every item."""
    import random

    import numpy as np

    r, p = random.Random(12), decontam.Decontamination()
    items = [(n, prose(7100 + n, 12 + 6 * n)) for n in range(6)]
    rows = []
    for d in range(70):
        parts = [prose(d, r.randrange(5, 60))]
        for _ in range(r.randrange(3)):
            w = r.choice(items)[1].split()
            a = r.randrange(len(w) // 2) if r.random() < 0.4 else 0
            w = [x if r.random() > 0.08 else "other" for x in w[a:] if r.random() > 0.06]
            parts += [" ".join(w), prose(1000 + d, r.randrange(3, 30))]
        rows.append((d, " ".join(parts)))
    rows += [(500, rows[3][1]), (501, ""), (502, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontam.contaminated(docs, bench, p).collect()}

    def said(text):
        return [x for x in re.split(r"[^a-z0-9]+", (text or "").lower()) if x]

    code: dict = {}
    for d, text in rows:
        b = np.array([code.setdefault(x, len(code) + 1) for x in said(text)], np.uint64)
        for i, item in items:
            a = np.array([code.setdefault(x, len(code) + 1) for x in said(item)], np.uint64)
            best = decontam.smith_waterman(a, b, p)[0] / (p.match * len(a)) if len(b) else 0.0
            # an alignment that close to the threshold may rest on fewer seeds than it takes
            if best >= p.similarity + 0.1:
                assert abs(got.pop((d, i)) - best) < 1e-9
            elif best < p.similarity:
                assert (d, i) not in got
            else:
                got.pop((d, i), None)
    assert not got


def test_byte_range_of_a_passage(spark):
    item = prose(1, 20)
    docs = spark.createDataFrame([(1, "É über " + prose(2, 50) + " " + item)], "doc_id long, text string")
    r = decontam.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).first()
    assert docs.first().text.encode()[r.doc_start : r.doc_end].decode() == item.rstrip(".")


def test_items_without_an_id(spark):
    """Each is an item of its own, found and removed like one with an id."""
    one, two, three = prose(801, 25), prose(802, 25), prose(803, 25)
    bench = spark.createDataFrame([(None, one), (None, two), (None, one), (7, three), (None, None)], "item_id long, text string")
    rows = [(1, prose(810, 80) + " " + one + " " + two), (2, prose(811, 80) + " " + three), (3, prose(812, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.item_id, r.item_words) for r in decontam.contaminated(docs, bench).collect()]
    assert sorted(got, key=repr) == sorted([(1, None, 25), (1, None, 25), (2, 7, 25)], key=repr)
    assert [r.doc_id for r in decontam.without_contaminated(docs, bench).collect()] == [3]


def test_items_of_few_words(spark):
    """An item shorter than a seed is found where all of it stands, unless it is as common as no seed may be."""
    rows = [(d, prose(d, 60)) for d in range(40)]
    rows += [(100, prose(200, 30) + " Xylograph, quokka! " + prose(201, 20)), (101, "quokka xylograph"), (102, prose(202, 9) + " zymurgy"), (103, "xylograph alone"), (104, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, "xylograph quokka"), (2, "zymurgy"), (3, "the"), (4, "river"), (5, "!!"), (6, prose(300, 20))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.item_words) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(100, 1): (1.0, 2), (102, 2): (1.0, 1)}
    assert {r.doc_id for r in decontam.without_contaminated(docs, bench).collect()} == {d for d, _ in rows} - {100, 102}


def test_passage_at_the_end_of_a_very_long_text(spark):
    item = prose(400, 25)
    rows = [(1, prose(401, 150_000) + " " + item), (2, prose(402, 150_000)), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    r = decontam.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.similarity) for x in r] == [(1, 1.0)] and r[0].doc_start > 1_000_000


# URL filter --------------------------------------------------------------------------

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"))


def test_rules_and_edge_cases(spark):
    rows = [
        (1, "http://WWW.Example.com/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"), (2, "https://a.example.com/en/x", "a.example.com", "/en/x", "example.com/en/", "block"),
        (3, "https://example.com/de", "example.com", "/de", "com/", "allow"), (4, "http://example.com", "example.com", "", None, None), (5, "ftp://x.net/es/", "x.net", "/es/", "net/es/", "block"),
        (6, "http://notcom/", "notcom", "/", None, None), (7, None, "", "", None, "allow"), (8, "no scheme", "", "", None, "allow"), (9, "", "", "", None, "allow"),
        (None, "http://b.com/?a://c", "b.com", "/", "com/", "allow"), (10, "x://a#b/c?d", "a", "", None, None), (10, "x://a#b/c?d", "a", "", None, None),
    ]
    pages = spark.createDataFrame([(i, u, "h", "s", 3) for i, u, *_ in rows], "page_id long, url string, host string, shape string, w int").repartition(2)
    got = urlfilter.judge(pages, urlfilter.UrlFilter(RULES)).collect()
    assert len(got) == len(rows)
    by = {(r.page_id): r for r in got}
    for i, _, host, path, rule, verdict in rows:
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule)
        assert by[i].verdict == verdict or (verdict is None and by[i].verdict in ("allow", "block"))
    assert urlfilter.judge(pages.where("page_id < 0"), urlfilter.UrlFilter(RULES)).count() == 0


def test_ratio_against_a_plain_model(spark):
    """Scores equal those of interpolated Witten-Bell models computed step by step."""
    import math
    from collections import Counter, defaultdict

    urls = [f"http://{'good' if k % 2 else 'spam-casino'}{k % 9}.{'com' if k % 2 else 'net'}/{'es' if k % 4 == 0 else 'x'}/{k}" for k in range(120)] + ["http://good.org/a", "http://spam-casino.org/a"]
    p = urlfilter.UrlFilter(RULES, order=4)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in urlfilter.judge(pages, p).collect()}
    shape = lambda u: re.sub("[1-9]", "0", u.split("://")[1])
    counts = {"allow": Counter(), "block": Counter()}
    labelled = defaultdict(Counter)
    for i, u in enumerate(urls):
        if got[i].rule:
            labelled[shape(u)][got[i].verdict] += 1
    for s, c in labelled.items():
        if int(hashlib.md5(s.encode()).hexdigest()[:2], 16) % p.folds:
            padded = "^" * 3 + s + "$"
            for v, n in c.items():
                for k in range(3, len(padded)):
                    for m in range(1, 5):
                        counts[v][padded[k - m + 1 : k + 1]] += n

    def prob(v, gram):
        q = 1 / p.alphabet
        for m in range(1, len(gram) + 1):
            g = gram[-m:]
            same = [x for x in counts[v] if len(x) == m and x[:-1] == g[:-1]]
            h, t = sum(counts[v][x] for x in same), len(same)
            q = (counts[v][g] + t * q) / (h + t) if h + t else q
        return q

    for i in (0, 1, 5, 120, 121):
        padded = "^" * 3 + shape(urls[i]) + "$"
        grams = [padded[k - 3 : k + 1] for k in range(3, len(padded))]
        want = sum(math.log(prob("allow", g) / prob("block", g)) for g in grams) / len(grams)
        assert math.isclose(got[i].score, want, rel_tol=1e-9)
    for i in (120, 121):
        assert got[i].rule is None and got[i].verdict == ("allow" if got[i].score >= got[i].threshold else "block")
    assert got[120].score > got[121].score


# HTML extraction ---------------------------------------------------------------------


def page(main, nav="<a href=/a>Home</a><a href=/b>News</a>", extra=""):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p><b>';</script></head><body><header><h1>Site</h1></header><nav>{nav}</nav>{main}{extra}<footer>&copy; us</footer></body></html>"


PARSED = {
    "<article><h1>T &amp; x</h1><p>a&nbsp;b\n  c<p>d <b>e</b>f</p></article>": "T & x\n\na b c\n\nd ef",
    "<main><p>one<br>two</p><form><p>f</p></form><aside>s</aside><div class='comments'><p>cc</p></div></main>": "one two",
    "<article><ul><li>x<li>y</ul>tail<!-- p --></article>": "x\n\ny\n\ntail",
    "<article><p>1 < 2 &lt;b&gt; &#65;&#x42;</p></article>": "1 < 2 <b> AB",
    "<article><header><h1>Head</h1></header><p>p</p><footer>by</footer></article>": "Head\n\np",
    "<div class='content with-sidebar'><article class='post'><p>in</p></article><article class='comment'><p>c</p></article></div>": "in",
    "<article><p>open <b>bold": "open bold",
    "<article><div class='ad'>buy<div>now</div></div><p>kept</p><div id=cookieNotice>c</div></article>": "kept",
}


@pytest.mark.parametrize("main", list(PARSED))
def test_single_pages(spark, main):
    html = page(main) if not main.endswith("bold") else "<html><body>" + main
    pages = spark.createDataFrame([(1, "http://h.x/1", html, "h", "s")], "page_id long, url string, html string, host string, slot string")
    r = htmlextract.extract(pages).first()
    assert r.text == PARSED[main] and r.n_chars == len(PARSED[main])


def test_template_of_a_host_without_article(spark):
    """Slots and fixed texts come from the host's pages alone; class names tell nothing here."""
    rows, want = [], {}
    for k in range(12):
        body = [prose(k * 10 + j, 25) for j in range(3)]
        html = f"<html><body><div class=q1><p>Welcome to our pages</p></div><div class=q2><p>Fixed first line</p>{''.join(f'<p>{b}</p>' for b in body)}</div><div class=q3><p>All rights kept</p></div></body></html>"
        rows.append((k, f"http://plain.host/{k}", html))
        want[k] = "\n\n".join(body)
    # copies of one article on a host stay whole
    art = page(f"<article><p>{prose(5, 40)}</p></article>")
    rows += [(100 + k, f"http://copies.host/{k}", art) for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in htmlextract.extract(pages).collect()}
    for k in range(12):
        assert got[k] == want[k]
    assert all(got[100 + k] == prose(5, 40) for k in range(6))


def test_template_inside_articles(spark):
    """Text that a host repeats in its articles is fixed text; copies of an article are none."""
    rows, want = [], {}
    for k in range(10):
        # pages 6 to 9 are copies of one article
        body = [prose(500 + min(k, 6) * 10 + j, 25) for j in range(3)]
        rest = "<div class=x1><p>All opinions are those of their authors</p><p>Tell your friends of it</p></div>"
        html = f"<html><body><p>Top line</p><article><h1>{body[0]}</h1><div class=x0><p>{body[1]}</p><p>{body[2]}</p></div>{rest}</article><div class=x3><article><p>Elsewhere {k}</p></article></div></body></html>"
        rows.append((k, f"http://inside.host/{k}", html))
        want[k] = "\n\n".join(body)
    # one article alone, and two pages that share a notice, tell of no template
    rows += [(50, "http://alone.host/1", page("<article><p>One</p><p>Notice</p></article>"))]
    rows += [(60 + k, f"http://two.host/{k}", page(f"<article><p>Text {k}</p><p>Notice</p></article>")) for k in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in htmlextract.extract(pages).collect()}
    assert {k: got[k] for k in want} == want
    assert got[50] == "One\n\nNotice" and got[61] == "Text 1\n\nNotice"


def test_misleading_class_names(spark):
    """Where words would put a host's articles away the template decides; its comments still go."""
    rows, want = [], {}
    for k in range(8):
        body = [prose(900 + k * 10 + j, 40) for j in range(3)]
        html = f"<html><body><div class=related-list><p>See also {k}</p></div><div class=social-comment-body>{''.join(f'<p>{b}</p>' for b in body)}<div class=comments><p>Nice {k}</p></div></div><div class=q9><p>Kept rights</p></div></body></html>"
        rows.append((k, f"http://mislead.host/{k}", html))
        want[k] = "\n\n".join(body)
    # on a host of two pages there is no telling
    rows += [(50 + k, f"http://few.host/{k}", f"<html><body><div class=comments><p>{prose(k, 40)}</p></div><div><p>Main {k}</p></div></body></html>") for k in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in htmlextract.extract(pages).collect()}
    assert {k: got[k] for k in want} == want
    assert got[50] == "Main 0" and got[51] == "Main 1"


def test_classes_against_whole_vectors(spark):
    """Slots and fixed texts are those of classes found by comparing occurrence vectors as a whole."""
    import random
    from collections import defaultdict

    r = random.Random(4)
    p = htmlextract.Extraction()
    rows = []
    for h in range(5):
        parts = [f"<div class=k{h}{j}><p>Line {h} {j}</p>" + "{}</div>" for j in range(4)]
        for k in range(r.choice((1, 2, 5, 9))):
            some = [x.format(f"<p>{prose(1000 * h + 10 * k + j, 12 if j == 1 else 2)}</p>") for j, x in enumerate(parts) if r.random() < 0.8]
            inside = f"<article><p>{prose(r.randrange(3), 9)}</p><p>Shared {h}</p></article>" * (r.random() < 0.5)
            rows.append((h, f"http://h{h}.x/{k}", "<html><body>" + "".join(some) + inside + "</body></html>"))
    pages = spark.createDataFrame([(f"h{h}", t) for h, _, t in rows], "host string, html string").repartition(3)
    got = {x.host: (x.slot, set(x.fixed)) for x in htmlextract.templates(pages, p).collect()}
    for h in range(5):
        parsed = [htmlextract.parse(t) for i, _, t in rows if i == h]
        tokens = defaultdict(dict)  # (kind, token) -> place -> occurrences
        chars, paths = defaultdict(int), {}
        articles = {}
        for n, (blocks, counts) in enumerate(parsed):
            for path, c in counts.items():
                tokens[1, htmlextract._hash(*path)][n] = c
                paths[htmlextract._hash(*path)] = path
            for b in blocks:
                for k in range(1, len(b.path) + 1):
                    chars[htmlextract._hash(*b.path[:k])] += len(b.text)
                if not b.article:
                    token = htmlextract._hash(*b.path, "", b.text)
                    tokens[2, token][n] = tokens[2, token].get(n, 0) + 1
            if any(b.article for b in blocks):
                articles[tuple(b.text for b in blocks if b.article)] = blocks, counts
        inner = defaultdict(dict)
        for n, (blocks, counts) in enumerate(articles.values()):
            for path, c in counts.items():
                if htmlextract._article_at(path):
                    inner[4, htmlextract._hash(*path)][n] = c
            for b in blocks:
                if b.article:
                    token = htmlextract._hash(*b.path, "", b.text)
                    inner[5, token][n] = inner[5, token].get(n, 0) + 1
        slots, fixed = [], set()
        whole = sum(len(b.text) for blocks, _ in parsed for b in blocks)
        for found, size in ((tokens, len(parsed)), (inner, len(articles))):
            classes = defaultdict(list)
            for (kind, token), vector in found.items():
                if len(vector) >= p.share * size and (kind != 5 or len(vector) >= p.least):
                    classes[tuple(sorted(vector.items()))].append((kind, token))
            for vector, members in classes.items():
                if len(members) >= 2 or size == 1:
                    once = all(c == 1 for _, c in vector)
                    slots += [(len(paths[t]), chars[t], t) for kind, t in members if kind == 1 and once and chars[t] >= p.inside * whole]
                    fixed |= {t for kind, t in members if kind == 5 or (kind == 2 and size >= p.least)}
        assert got[f"h{h}"] == (max(slots)[2] if slots else None, fixed)


def test_html_edge_cases(spark):
    rows = [(1, None, None), (2, "http://a/", ""), (None, "nothing", "<p>x"), (3, "http://a/", "plain & simple"), (3, "http://a/", "plain & simple"), (4, "http://b/", "<" * 2000), (5, "http://b/", "<a href='" * 500), (6, "http://c/", "<article>" + "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, fixed string, token int").repartition(2)
    got = htmlextract.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[None] == "x" and by[3] == "plain & simple" and by[6] == "deep"
    assert htmlextract.extract(pages.where("page_id < 0")).count() == 0


def test_very_long_pages(spark):
    """Many pages of a million characters in one batch, and one whose article is that long."""
    filler = "<script>" + "x = 1;" * 170_000 + "</script>"
    rows = [(n, "http://long/", f"<html><body><nav>menu</nav>{filler}<article><p>text {n}</p></article></body></html>") for n in range(12)]
    rows.append((99, "http://long/", "<article><p>" + prose(1, 150_000) + "</p></article>"))
    got = {r.page_id: (r.text, r.n_chars) for r in htmlextract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {n: (f"text {n}", len(f"text {n}")) for n in range(12)} | {99: (prose(1, 150_000), len(prose(1, 150_000)))}


# sharding ----------------------------------------------------------------------------


def test_store_round_trip(spark, odd_docs, tmp_path):
    p = sharding.Sharding(target_bytes=1 << 20, fan_in=2, arrival_bytes=4096)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), p)
    for _ in range(5):
        store.append(odd_docs)
    before, shards = store.manifest()
    after = store.compact()
    assert before == 5 and after > before and len(store.manifest()[1]) < len(shards)
    count = lambda df: sorted(map(repr, df.select("doc_id", "text", "a b").collect()))
    want = count(odd_docs) * 5
    assert count(store.read()) == sorted(want) and count(store.read(5)) == sorted(want)
    assert store.compact() == after
    store.vacuum()
    assert store.versions() == [after] and count(store.read()) == sorted(want)


def test_two_writers_cannot_commit_a_version(spark, odd_docs, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    store.append(odd_docs)
    with pytest.raises(sharding.CommitConflict):
        store._commit(0, [])
    assert store.versions() == [1] and store.manifest()[1]


def test_compacted_rows(odd_docs, odd_rows, no_docs, tmp_path):
    got = sharding.compacted(odd_docs, str(tmp_path / "a")).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (d for d, _ in odd_rows)))
    assert sharding.compacted(no_docs, str(tmp_path / "b")).count() == 0


def test_arrivals_climb_the_tiers(spark, tmp_path):
    """Each arrival is a version of its own; runs of similar sizes merge, and those merge again."""
    docs = spark.createDataFrame([(n, prose(n, 40), n % 3) for n in range(800)] + [(5, None, None)] * 30, "doc_id long, text string, _arrival int").repartition(2)
    p = sharding.Sharding(target_bytes=1 << 20, least_bytes=4 << 10)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), p)
    arrivals = store.dealt(docs, 22)
    assert len(arrivals) == 22 and all(len(a) == 2 for a in arrivals) and store.versions() == []
    seen = set()
    for shards in arrivals:
        store.add(shards)
        store.compact()
        seen.update(s.tier for s in store.manifest()[1])
    version, shards = store.manifest()
    assert version > 22 + 4 and len(seen) >= 3 and len({s.tier for s in shards}) > 1 and len(shards) < 11
    rows = lambda df: sorted(map(repr, df.select("doc_id", "text", "_arrival").collect()))
    assert rows(store.read()) == rows(docs)
    # an older version holds what had arrived by then
    assert 0 < store.read(1).count() < docs.count() and len(store.versions()) == version
    store.vacuum()
    assert rows(store.read()) == rows(docs) and store.versions() == [version]


def test_large_row_groups_are_divided(spark, tmp_path):
    """A table of one file with one row group, and a single row that is larger than a shard may be."""
    import random

    r = random.Random(1)
    noise = lambda n: "".join(chr(r.randrange(33, 1000)) for _ in range(n))
    rows = [(n, noise(2000)) for n in range(200)] + [(1000, noise(150_000))]
    path = str(tmp_path / "one")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    p = sharding.Sharding(target_bytes=64 << 10)
    got = sharding.compacted(spark.read.parquet(path), str(tmp_path / "s"), p, arrivals=1).collect()
    assert sorted(x.doc_id for x in got) == sorted(d for d, _ in rows)
    sizes = {x.shard: x.shard_bytes for x in got}
    alone = next(x.shard for x in got if x.doc_id == 1000)
    assert len(sizes) > 5 and all(b <= 2 * p.target_bytes for s, b in sizes.items() if s != alone)


def test_clashing_columns_and_lost_files(spark, tmp_path):
    """A table may have columns of the names that a store uses; merges that gain nothing leave no files."""
    docs = spark.createDataFrame([(n, f"t{n}", "mine", 7, 8) for n in range(40)], "doc_id long, text string, _shard string, shard int, tier int").repartition(4)
    got = sharding.compacted(docs, str(tmp_path / "a"), sharding.Sharding(arrival_bytes=1, fan_in=2)).collect()
    assert sorted(r.doc_id for r in got) == list(range(40))
    store = sharding.ShardStore(spark, str(tmp_path / "b"))
    store.append(docs)
    with pytest.raises(ValueError):
        store.read()
    assert {r._shard for r in store.read(shard_col="file").collect()} == {"mine"}
    store._write = lambda df, write=store._write: write(df.repartition(9))
    version = store.compact()
    files = {f for f in (tmp_path / "b" / "data").rglob("*.parquet")}
    assert version == 1 and len(files) == len(store.manifest()[1])


# pipeline ----------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    item = prose(77, 25)
    base = prose(1, 150)
    rows = [(1, base), (2, base), (3, base + " end"), (4, prose(2, 100) + " a@b.cd"), (5, prose(3, 60) + " " + item), (6, None), (7, "123 !!"), (8, prose(4, 80)), (8, prose(4, 80)), (None, prose(6, 50))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = docs, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if n < 4:
            assert now.columns == corpus_pipeline.COLUMNS
            kept.append(sorted((r.doc_id for r in now.collect()), key=lambda x: (x is None, x)))
    assert kept == [[1, 2, 3, 4, 5, 8, 8, None], [1, 4, 5, 8, None], [1, 4, 8, None], [1, 4, 8, None]]
    masked = corpus_pipeline.mask_personal_data(spark, docs, str(tmp_path)).where("doc_id = 4").first()
    assert masked.text == prose(2, 100) + " <EMAIL>" and masked.n_chars == len(masked.text)
    out = corpus_pipeline.run(spark, str(tmp_path)).agg(F.countDistinct("doc_id").alias("n"), F.count("*").alias("rows")).first()
    assert (out.n, out.rows) == (3, 4)


def test_texts_in_an_unknown_script_go(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(n, SPEECH[x] * (1 + n % 3), x) for n, x in enumerate([*SPEECH] * 4)] + [(100, SCRIPTS["zh"] * 3, None), (101, SCRIPTS["ru"], None), (102, "да", None), (103, "12 34", "en"), (104, None, "en"), (105, SPEECH["de"], None)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert set(got) == {*range(12), 102, 105} and got[105] == "de"


def test_one_row_of_a_repeated_id(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, prose(21, 40)), (1, prose(20, 40)), (1, prose(22, 40)), (2, prose(23, 40)), (3, prose(20, 40)), (None, prose(24, 40)), (None, prose(25, 40))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 4):
        got = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(parts), "").collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", min(t for d, t in rows if d == 1)), ("2", rows[3][1]), ("None", rows[5][1]), ("None", rows[6][1])])


def test_pipeline_on_an_empty_table(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
