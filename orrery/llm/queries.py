"""The operators applied to the driver's tables, and SQL where it can express them.

Results whose texts pass through Python are stored here, in Arrow batches of modest size,
rather than left to the batch size of whoever reads them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from orrery.llm import ann, decontam, filteraudit, htmlextract, langid, neardup, packing, phrases, pii, prefixtrie, sharding, suffixdedup, textops, urlfilter
from orrery.session import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.Packing(tokenizer_file("word_bpe_49k.json"), length=4096, end_id=1))


def op2_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), ann.Ann(top=20), every=20)


URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op3_url_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.UrlFilter(URL_RULES))
    return judged.withColumn("score", F.round("score", 6))


def op4_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.NearDup(size=2, percent=80))


def op5_prefix_doubling_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), suffixdedup.Repeats(length=400))


def op6_rare_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textops.stored(decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a store would stay; this one is only shown
    root = textops.until_exit(spark, f"{textops.ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    return sharding.compacted(table(spark, sf_dir, "documents"), root)


def op8_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(docs.where(~held_out))
    predicted = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return textops.stored(predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textops.stored(pii.digest(table(spark, sf_dir, "documents")))


def op10_template_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textops.stored(htmlextract.extract(table(spark, sf_dir, "pages")))


def op11_repeated_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_passages(table(spark, sf_dir, "documents"), phrases.Phrases(words=35)).drop("spans")


def op12_filter_inclusion_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters, weights = "ABCDE", {"good": "quality = 1", "toxic": "toxic = 1"}
    flags = filteraudit.with_labels(filteraudit.text_failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"), weights)
    found = filteraudit.audit(filteraudit.joint_failures(flags, filters, weights=list(weights)), filters, weights=list(weights))
    return found.withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


def op13_prefix_doubling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_sum_of_squares_packing": op1_sum_of_squares_packing,
    "op2_balanced_posting_lists": op2_balanced_posting_lists,
    "op3_url_markov_ratio": op3_url_markov_ratio,
    "op4_minhash_odd_sketch": op4_minhash_odd_sketch,
    "op5_prefix_doubling_repeats": op5_prefix_doubling_repeats,
    "op6_rare_seed_alignment": op6_rare_seed_alignment,
    "op7_size_tiered_compaction": op7_size_tiered_compaction,
    "op8_hyperdimensional_langid": op8_hyperdimensional_langid,
    "op9_pii_spans": op9_pii_spans,
    "op10_template_deduction": op10_template_deduction,
    "op11_repeated_phrase_automata": op11_repeated_phrase_automata,
    "op12_filter_inclusion_exclusion": op12_filter_inclusion_exclusion,
    "op13_prefix_doubling_trie": op13_prefix_doubling_trie,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _url_sql() -> str:
    """The URL filter step by step: counts per window, one join for each order of the models."""
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(v, h + p, f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')") for v, h, p in rules]
    rule, given = (" ".join(f"WHEN {c} THEN '{x}'" for x, c in z) for z in ([(r, c) for _, r, c in fits], [(v, c) for v, _, c in fits]))
    hexa = "strpos('0123456789abcdef', substr(md5(shape), {}, 1)) - 1"
    step = "CASE WHEN f.h{0} + f.t{0} > 0 THEN (f.{0} + f.t{0} * {1}) / (f.h{0} + f.t{0}) ELSE {1} END"
    levels, last = [], "cnt"
    for m in range(1, 6):
        base = [f"{last}.p{x}" if m > 1 else "(1.0::DOUBLE / 64)" for x in "ar"]
        levels.append(f"l{m} AS (SELECT {last}.w, {step.format('a', base[0])} AS pa, {step.format('r', base[1])} AS pr FROM {last} JOIN f ON f.g = right({last}.w, {m}))")
        last = f"l{m}"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {rule} END AS rule, CASE {given} END AS given, translate(host || translate(path, '{_UPPER}', '{_LOWER}'), '123456789', '000000000') AS shape FROM p),
sh AS (SELECT shape, count(*) FILTER (given = 'allow') AS acc, count(*) FILTER (given = 'block') AS rej, (16 * ({hexa.format(1)}) + {hexa.format(2)}) % 5 AS fold FROM r GROUP BY shape),
win AS (SELECT shape, acc, rej, fold, substr('^^^^' || shape || '$', i, 5) AS w FROM (SELECT *, unnest(range(1, length(shape) + 2)) AS i FROM sh)),
cnt AS (SELECT w, CAST(sum(CASE WHEN fold <> 0 THEN acc ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN fold <> 0 THEN rej ELSE 0 END) AS DOUBLE) AS r FROM win GROUP BY w),
grams AS (SELECT right(w, m) AS g, sum(a) AS a, sum(r) AS r FROM (SELECT *, unnest(range(1, 6)) AS m FROM cnt) GROUP BY 1),
ctx AS (SELECT left(g, length(g) - 1) AS h, sum(a) AS ha, sum(r) AS hr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM grams GROUP BY 1),
f AS (SELECT g, a, r, ha, hr, ta, tr FROM grams JOIN ctx ON h = left(g, length(g) - 1)),
{", ".join(levels)},
sc AS (SELECT shape, fold, any_value(acc) AS acc, any_value(rej) AS rej, CASE WHEN length(shape) > 0 THEN avg(ln(pa) - ln(pr)) ELSE 0 END AS score FROM win JOIN l5 USING (w) GROUP BY shape, fold),
bins AS (SELECT CAST(floor(greatest(-20, least(20, score)) * 100) AS BIGINT) AS b, CAST(sum(acc) AS DOUBLE) AS a, CAST(sum(rej) AS DOUBLE) AS r FROM sc WHERE fold = 0 GROUP BY 1),
tot AS (SELECT sum(a) AS ta, sum(r) AS tr FROM bins),
cuts AS (SELECT b, (ta - coalesce(sum(a) OVER w, 0)) / ta + coalesce(sum(r) OVER w, 0) / tr AS gain FROM bins, tot WHERE ta > 0 AND tr > 0 WINDOW w AS (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
th AS (SELECT coalesce((SELECT b / 100.0::DOUBLE FROM cuts ORDER BY gain DESC, abs(b), b DESC LIMIT 1), 0) AS threshold)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score, threshold
FROM r JOIN sc USING (shape), th"""


ORACLE = {
    "op3_url_markov_ratio": _url_sql(),
    "op4_minhash_odd_sketch": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) <= 1 THEN w
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh
  FROM d),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS r FROM documents
  UNION
  SELECT b.y, reach.r FROM reach JOIN both_ways b ON b.x = reach.x),
c AS (SELECT x AS doc_id, min(r) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c USING (doc_id)
""",
    "op5_prefix_doubling_repeats": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT *, octet_length(b) AS n FROM d),
w AS (SELECT rid, i, md5(array_slice(b, i, i + 399)) AS h FROM (SELECT rid, b, unnest(range(1, n - 398)) AS i FROM n WHERE n >= 400)),
dup AS (SELECT rid, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
turns AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM dup),
grouped AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS g FROM turns),
spans AS (SELECT rid, min(i) AS s, max(i) + 399 AS e FROM grouped GROUP BY rid, g),
gaps AS (SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) + 1 AS a, s - 1 AS z FROM spans UNION ALL SELECT rid, max(e) + 1, 9223372036854775807 FROM spans GROUP BY rid),
kept AS (SELECT rid, sha256(unhex(coalesce(string_agg(hex(array_slice(n.b, a, least(z, n.n))), '' ORDER BY a) FILTER (a <= least(z, n.n)), ''))) AS sha FROM gaps JOIN n USING (rid) GROUP BY rid),
total AS (SELECT rid, CAST(sum(e - s + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(sha, sha256(b)) AS kept_sha256
FROM n LEFT JOIN total USING (rid) LEFT JOIN kept USING (rid)
""",
    "op11_repeated_phrase_automata": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT *, len(w) AS n FROM d),
win AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, n - 33)) AS i FROM n WHERE n >= 35)),
dup AS (SELECT rid, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
turns AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 35 THEN 0 ELSE 1 END AS new FROM dup),
grouped AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS g FROM turns),
spans AS (SELECT rid, min(i) AS s, max(i) + 34 AS e FROM grouped GROUP BY rid, g),
gaps AS (SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) + 1 AS a, s - 1 AS z FROM spans UNION ALL SELECT rid, max(e) + 1, 9223372036854775807 FROM spans GROUP BY rid),
kept AS (SELECT rid, sha256(coalesce(string_agg(array_to_string(w[a:least(z, n.n)], ' '), ' ' ORDER BY a) FILTER (a <= least(z, n.n)), '')) AS sha FROM gaps JOIN n USING (rid) GROUP BY rid),
total AS (SELECT rid, CAST(sum(e - s + 1) AS BIGINT) AS n_removed FROM spans GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(sha, sha256(array_to_string(w, ' '))) AS kept_sha256
FROM n LEFT JOIN total USING (rid) LEFT JOIN kept USING (rid)
""",
    # every order is run filter by filter
    "op12_filter_inclusion_exclusion": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
first AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN d.doc_id > m THEN 'E' ELSE '' END) AS fails
  FROM d JOIN first USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE strpos(filter_order, x) = 0),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, i, 1) AS f, substr(filter_order, 1, i - 1) AS before FROM (SELECT filter_order, unnest(range(1, 6)) AS i FROM o WHERE length(filter_order) = 5)),
r AS (
  SELECT part, filter_order, step, f,
         translate(fails, before, '') = fails AS here,
         strpos(fails, f) > 0 AS failing, fails = f AS only_this, n, good, toxic
  FROM g, s),
a AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (here AND NOT failing), 0) AS kept,
         coalesce(sum(n) FILTER (here AND failing), 0) AS removed,
         coalesce(sum(n) FILTER (NOT here AND failing), 0) AS redundant,
         coalesce(sum(n) FILTER (only_this), 0) AS unique_fails,
         coalesce(sum(good) FILTER (here AND failing), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (here AND failing), 0) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM a
""",
    # prefixes by a chained digest, a recursion over the depth
    "op13_prefix_doubling_trie": r"""
WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) AS tbl FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i))),
o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, max(i) AS n FROM o GROUP BY c),
ids AS (
  SELECT c, c - c % 100 AS b, n,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
             lambda a, x: xor(a >> 8, tbl[(xor(a & 255, x) + 1)])), 4294967295::BIGINT) % 6 AS h
  FROM own, crc_table),
k AS (SELECT ids.c, ids.b, ids.h, least(ids.h, coalesce(own.n, 0)) AS taken, ids.n FROM ids LEFT JOIN own ON own.c = ids.b),
r AS (
  SELECT k.c, o.i AS p, o.role, o.t FROM k JOIN o ON o.c = k.b WHERE o.i <= k.h
  UNION ALL
  SELECT k.c, o.i - k.h + k.taken, o.role, o.t FROM k JOIN o ON o.c = k.c WHERE o.i > k.h),
len AS (SELECT c, taken + greatest(n - h, 0) AS m FROM k),
pre AS (
  SELECT c, 0::BIGINT AS d, '' AS node, 0::BIGINT AS chars, '' AS up FROM k
  UNION ALL
  SELECT pre.c, d + 1, md5(node || length(role) || ':' || role || t), length(t), node FROM pre JOIN r ON r.c = pre.c AND r.p = d + 1),
nodes AS (SELECT d, node, min(up) AS up, min(chars) AS chars, min(pre.c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(pre.c::VARCHAR, ',' ORDER BY pre.c) FILTER (d = m), '')) AS ends_sha256
          FROM pre JOIN len USING (c) GROUP BY d, node),
kids AS (SELECT d - 1 AS d, up AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, node)),
subtree AS (
  SELECT pre.d, pre.node, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved
  FROM full_nodes x JOIN pre ON pre.c = x.conv_id AND pre.d <= x.d GROUP BY ALL)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, a.ends_sha256
FROM full_nodes a JOIN subtree s USING (d, node) LEFT JOIN full_nodes p ON p.d = a.d - 1 AND p.node = a.up
""",
}
