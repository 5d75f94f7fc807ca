"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its section-level elements, named by the path that
leads to them, and its blocks of text. Over all pages of a host, tokens with the same
occurrence vector (how often each page has them) form an equivalence class. Classes of
two tokens or more that occur on most of the host's pages are its template; those that
occur once on a page nest, and the deepest one whose inside holds most of the host's
text is the slot of the main text. Text tokens of the template are fixed text.

Vectors are never gathered: a token's class is told by the number of pages and of
occurrences and by the exclusive or of a hash of each page with its count, so a host
with a third of all pages is aggregated like any other.

Inside article and main elements copies of an article say nothing of a template, so the
vectors there count a host's different articles and not its pages: text that a valid
class has on most of them is fixed text, however it is marked up.

A page's text is what stands in its host's slot without fixed text, and without menus,
headers, footers, sidebars, notices, adverts, forms and reader comments, which elements
and the words of their class, id and role tell. Where words would put away ``inside`` of a
host's text or more they mislead: then the slot is that of all text, and they count inside
it only. A slot around an article gives the article alone; a slot within one gives all of
it, as up to ``1 - inside`` of a host's text, such as titles, lies beside the slot. A page
without the slot gives its article or main elements, or else its body. An article of
nothing but fixed text is kept.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textops as T
from orrery.llm.urlfilter import parts as url_parts

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|title)\b[^>]*+(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:"[^"]*"|'[^']*'|[^>"']++)*+)>|<[!?][^>]*+>""",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Elements without an end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a path names.
_SECTION = frozenset("html body main article section div nav header footer aside form ul ol table td".split())
#: Elements whose inside is no main text.
_APART = frozenset("head nav footer aside form menu button dialog".split())
#: Words in a class, id or role whose element is no main text.
_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs pagination pager"
    " sidebar aside complementary header masthead footer contentinfo cookie cookies consent gdpr notice alert popup modal dialog overlay newsletter subscribe subscription"
    " signup login search share sharing social comment comments commentlist discussion disqus reply replies respond related recommended widget".split()
)


#: Of these, the ones that tell of an article element that it is not the page's article.
_WORDS_OF_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())
#: Words that begin the name of a layout variant, such as with-sidebar.
_VARIANTS = frozenset("has with no without is not".split())


@dataclass(frozen=True)
class Extraction:
    """share: of a host's pages that a template token is on; least: pages, or articles, for fixed text;
    inside: share of the host's text that the slot must hold."""

    share: float = 0.5
    least: int = 3
    inside: float = 0.8


def _told(name: str, attrs: str) -> bool:
    """Whether the words of an element's class, id or role say that it is no main text."""
    if name in ("html", "body", "main") or not attrs:
        return False
    telling = _WORDS_OF_ARTICLES if name == "article" else _WORDS
    for m in _ATTR.finditer(attrs):
        for value in (m.group(2) or m.group(3) or m.group(4) or "").split():
            # camelCase and separators divide words
            words = _NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())
            if words and words[0] not in _VARIANTS and telling.intersection(words):
                return True
    return False


@dataclass(frozen=True)
class Block:
    """A block of text: the path to it, whether it is in an article or main element, and how
    deep the innermost element is whose words put it away: twice the length of the path to
    that element, and one more if the path doesn't name it; 0 without one."""

    path: tuple[str, ...]
    article: bool
    text: str
    told: int = 0


def _label(name: str, attrs: str) -> str:
    if attrs:
        for m in _ATTR.finditer(attrs):
            if m.group(1).lower() == "class":
                return f"{name}.{' '.join((m.group(2) or m.group(3) or m.group(4) or '').split())}"
    return name


def parse(page: str) -> tuple[list[Block], Counter]:
    """Blocks of a page and the counts of its paths."""
    blocks, paths = [], Counter()
    stack: list[tuple[str, bool, bool, int, bool]] = []  # name, apart, in article, told, in path
    path: list[str] = []
    text: list[str] = []
    apart = article = False
    told = 0
    where: tuple[str, ...] = ()

    def flush():
        if text:
            said = " ".join(html_lib.unescape("".join(text)).split())
            if said:
                blocks.append(Block(where, article, said, told))
            text.clear()

    def pop_to(k: int):
        nonlocal apart, article, told, where
        for *_, named in stack[k:]:
            if named:
                path.pop()
        del stack[k:]
        apart, article, told = stack[-1][1:4] if stack else (False, False, 0)
        where = tuple(path)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not apart:
            text.append(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if m.group(2):
            if name in _BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
            continue
        if name in _BLOCK:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or (name == "li" and stack[k][0] == "li"):
                    pop_to(k)
                    break
                if stack[k][0] in _SECTION:
                    break
            if name == "body":
                # a head without an end stops here
                for k, s in enumerate(stack):
                    if s[0] == "head":
                        pop_to(k)
                        break
        if name == "br":
            if not apart:
                text.append(" ")
            continue
        if name in _VOID or m.group(4).endswith("/"):
            continue
        attrs = m.group(4).strip()
        named = name in _SECTION and not apart
        if named:
            path.append(_label(name, attrs))
            where = tuple(path)
            paths[where] += 1
        apart = apart or name in _APART or (name == "header" and not article)
        article = article or name in ("article", "main")
        if not apart and _told(name, attrs):
            # within a block words are always believed
            apart = name not in _BLOCK
            told = told if apart else 2 * len(path) + (not named)
        stack.append((name, apart, article, told, named))
    if at < len(page) and not apart:
        text.append(page[at:])
    flush()
    return blocks, paths


def _hash(*said: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(said).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: Of the names in a path, those of article and main elements.
_ARTICLE = re.compile(r"(?:article|main)(?:\.|\Z)")
#: Kinds: 0 the host's pages, 1 elements, 2 texts; 3, 4 and 5 the same of its articles, each told by the hash of its text.
_TOKENS = "host string, token long, kind byte, depth int, body long, n long, total long, sig long, chars long, every long"


def _article_at(path: tuple[str, ...]) -> int:
    """The length of the path to its outermost article or main element, 0 without one."""
    return next((k for k, label in enumerate(path, 1) if _ARTICLE.match(label)), 0)


def _by_bytes(batch: pa.RecordBatch, html: int):
    """The rows of a batch as tuples, of which no more are held at once than their pages' bytes allow."""
    for i, j in T.pieces(T.utf8(batch.column(html))[1]):
        yield from zip(*(c.to_pylist() for c in batch.slice(i, j - i).columns), strict=True)


@T.lean
def _tokens(batches):
    """Per host, token and article: pages, occurrences, vector hash and characters inside, combined within a batch."""
    for batch in batches:
        rows: dict[tuple[str, int, int, int], list[int]] = {}
        known: dict[tuple[str, ...], int] = {}
        for host, page in _by_bytes(batch, 1):
            blocks, paths = parse(page or "")
            mark = _hash(page or "")
            inside, everything = Counter(), Counter()
            texts: Counter = Counter()
            within: Counter = Counter()
            for x in blocks:
                for k in range(1, len(x.path) + 1):
                    everything[x.path[:k]] += len(x.text)
                    inside[x.path[:k]] += len(x.text) * (not x.told)
                (within if x.article else texts)[(x.path, x.text)] += 1
            found = [(0, 0, 0, 0, 1, sum(len(x.text) for x in blocks if not x.told), sum(len(x.text) for x in blocks))]
            body = _hash(*(x.text for x in blocks if x.article and not x.told)) if within else 0
            if within:
                found.append((0, 3, 0, body, 1, 0, 0))
            for path, n in paths.items():
                if path not in known:
                    known[path] = _hash(*path)
                found.append((known[path], 1, len(path), 0, n, inside[path], everything[path]))
                if within and _article_at(path):
                    found.append((known[path], 4, len(path), body, n, 0, 0))
            for kind, of, said_in in ((2, 0, texts), (5, body, within)):
                found += [(_hash(*path, "", said), kind, len(path), of, n, 0, 0) for (path, said), n in said_in.items()]
            for token, kind, depth, of, n, chars, every in found:
                got = rows.setdefault((host, token, kind, of), [depth, 0, 0, 0, 0, 0])
                got[1] += 1
                got[2] += n
                got[3] ^= int(T.mix(np.uint64(mark & 0xFFFFFFFFFFFFFFFF) + np.uint64(n)).view(np.int64)) if kind in (1, 2) else 0
                got[4] += chars
                got[5] += every
        cols = list(zip(*((h, t, k, v[0], b, *v[1:]) for (h, t, k, b), v in rows.items()), strict=True)) or [[]] * 10
        kinds = (pa.string(), pa.int64(), pa.int8(), pa.int32(), *[pa.int64()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in _TOKENS.split(", ")])


def templates(pages: DataFrame, p: Extraction) -> DataFrame:
    """(host, slot, fixed, trusted): the path hash of the main slot, the hashes of fixed texts,
    and whether words put text away.

    fixed has at most 1/share times the blocks of a page.
    """
    partial = pages.select("host", "html").mapInArrow(_tokens, _TOKENS)
    keys, sums = ["host", "token", "kind", "depth"], [F.bit_xor("sig").alias("sig"), *(F.sum(c).alias(c) for c in ("n", "total", "chars", "every"))]
    one = partial.groupBy(*keys, "body").agg(*sums)
    # an article counts once, on however many pages it is
    inner, times = F.col("kind") >= 3, F.ceil(F.col("total") / F.col("n"))
    one = one.select(*keys, F.when(inner, 1).otherwise(F.col("n")).alias("n"), F.when(inner, times).otherwise(F.col("total")).alias("total"), F.when(inner, F.xxhash64("body", times)).otherwise(F.col("sig")).alias("sig"), "chars", "every")
    # most texts of articles are on too few to be fixed, and no class of theirs is used
    token = T.stored(one.groupBy(*keys).agg(*sums).where((F.col("kind") != 5) | (F.col("n") >= p.least)).withColumn("inner", inner))
    trusted = (F.col("n") < p.least) | (F.col("every") == 0) | (F.col("chars") > F.col("every") * F.lit(1 - p.inside))
    host = token.where("kind in (0, 3)").select("host", "inner", F.col("n").alias("pages"), trusted.alias("trusted"), F.when(trusted, F.col("chars")).otherwise(F.col("every")).alias("whole"))
    often = token.where("kind not in (0, 3)").join(host, ["host", "inner"]).where(F.col("n") >= p.share * F.col("pages"))
    often = often.withColumn("chars", F.when(F.col("trusted"), F.col("chars")).otherwise(F.col("every")))
    classes = often.groupBy("host", "inner", "n", "total", "sig").agg(F.collect_list(F.struct("kind", "depth", "token", "chars")).alias("x"), *(F.first(c).alias(c) for c in ("pages", "whole", "trusted")))
    valid = classes.where((F.size("x") >= 2) | (F.col("pages") == 1)).withColumn("y", F.explode("x")).select("host", "n", "total", "pages", "whole", "trusted", "y.*")
    holds = (F.col("kind") == 1) & (F.col("n") == F.col("total")) & (F.col("chars") >= p.inside * F.col("whole"))
    fixed = ((F.col("kind") == 2) & (F.col("pages") >= p.least)) | (F.col("kind") == 5)
    slot = F.max(F.when(holds, F.struct("depth", "chars", "token")))["token"]
    return valid.groupBy("host").agg(slot.alias("slot"), F.collect_list(F.when(fixed, F.col("token"))).alias("fixed"), F.bool_and("trusted").alias("trusted"))


def main_text(page: str, slot: int | None, fixed: frozenset[int], known: dict, trusted: bool = True) -> str:
    """The blocks of a page's main slot, joined by an empty line."""

    def code(path):
        if path not in known:
            known[path] = _hash(*path)
        return known[path]

    blocks, _ = parse(page)
    at = {b.path: next((k for k in range(1, len(b.path) + 1) if code(b.path[:k]) == slot), 0) for b in blocks} if slot is not None else {}
    # words count anywhere, or where they mislead below the slot alone
    blocks = [b for b in blocks if not b.told or (not trusted and at.get(b.path, 0) and b.told <= 2 * at[b.path])]
    bounds = {b.path[: _article_at(b.path[: at[b.path]]) or at[b.path]] for b in blocks if at.get(b.path)}
    found = [b for b in blocks if any(b.path[:k] in bounds for k in range(1, len(b.path) + 1))] if bounds else []
    found = found or [b for b in blocks if b.article] or blocks
    if any(b.article for b in found):
        found = [b for b in found if b.article]
    left = [b for b in found if not fixed or _hash(*b.path, "", b.text) not in fixed]
    if not left:
        left = [b for b in found if b.article]
    return "\n\n".join(b.text for b in left)


def extract(pages: DataFrame, p: Extraction | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null or empty html gives an empty text. Pages whose URL has no host form one group.
    Repeated rows count as pages of their host and each get a row; null ids are kept.
    Broken markup is read as far as it goes. Other columns are ignored; an empty table
    gives an empty result.
    """
    p = p or Extraction()
    url = T.column(pages, url_col, "string")
    src = pages.select(T.column(pages, id_col, "long").alias("page_id"), url.alias("url"), url_parts(url)[0].alias("host"), T.column(pages, html_col, "string").alias("html"))
    known = T.stored(templates(src, p))

    @T.lean
    def run(batches):
        seen: dict = {}
        for batch in batches:
            if len(seen) > 100_000:
                seen.clear()
            off = T.utf8(batch.column("html"))[1]
            for i, j in T.pieces(off):
                part = batch.slice(i, j - i)
                given = (part.column(c).to_pylist() for c in ("html", "slot", "fixed", "trusted"))
                texts = [main_text(h or "", s, frozenset(x or ()), seen, t is not False) for h, s, x, t in zip(*given, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return src.join(known, "host", "left").select("page_id", "url", "html", "slot", "fixed", "trusted").mapInArrow(run, "page_id long, url string, text string, n_chars long")
