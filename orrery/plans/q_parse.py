"""Queries over strings, lookups, grids, and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import features as X
from orrery.functions import strings as Z
from orrery.operators import aggregate as A
from orrery.operators import evaluate as E
from orrery.plans import learn
from orrery.plans.registry import CHAIN_ORDER, chain, pts, query, r6
from orrery.session import table
from orrery.sources import sinks, structures, tables

_URL = "url"


@query("x1_part_before_between", "SELECT page_id, split_part(url, '://', 1) AS scheme, regexp_extract(url, '(?s)/(.*)/', 1) AS inner_part FROM pages")
def x1(spark, d):
    return table(spark, d, "pages").select("page_id", Z.part_before(F.col("url"), "://").alias("scheme"), Z.part_between(F.col("url"), "/", "/").alias("inner_part"))


@query("x1_words", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM documents")
def x1w(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(Z.words(F.col("text"))).cast("long").alias("n_words"))


@query("x1_sorted_letters", "SELECT p_partkey, list_aggregate(list_sort(string_split(p_brand, '')), 'string_agg', '') AS letters, regexp_extract(substr(p_brand, 7), '^[0-9]*') AS digits FROM part")
def x1s(spark, d):
    return table(spark, d, "part").select("p_partkey", Z.sorted_letters(F.col("p_brand")).alias("letters"), Z.digits_prefix(F.expr("substr(p_brand, 7)")).alias("digits"))


@query("x1_prefix_suffix", "SELECT p_partkey, regexp_replace(p_brand, '^Brand', '') AS no_prefix, regexp_replace(p_brand, '1$', '') AS no_suffix FROM part")
def x1p(spark, d):
    return table(spark, d, "part").select("p_partkey", Z.remove_prefix(F.col("p_brand"), "Brand").alias("no_prefix"), Z.remove_suffix(F.col("p_brand"), "1").alias("no_suffix"))


@query(
    "x2_file_names",
    """WITH f AS (SELECT page_id, regexp_replace(split_part(url, '?', 1), '#.*', '') AS u FROM pages), s AS (SELECT page_id, regexp_extract(u, '([^/]*)$', 1) AS s FROM f)
SELECT page_id, s AS short_name, regexp_replace(s, '\\.[^.]*$', '') AS base_name, regexp_extract(s, '\\.([^.]*)$', 1) AS extension FROM s""",
)
def x2(spark, d):
    u = F.regexp_replace(F.substring_index("url", "?", 1), "#.*", "")
    return table(spark, d, "pages").select("page_id", Z.short_name(u).alias("short_name"), Z.base_name(u).alias("base_name"), Z.real_extension(u).alias("extension"))


@query("x3_residue_id", "SELECT id, chr(CAST(65 + id % 4 AS INT)) AS chain, CASE WHEN id % 3 = 0 THEN 'T' END AS aa, CAST(id AS INT) AS seq_num, CASE WHEN id % 5 = 0 THEN 'B' END AS ins_code FROM pts", "pts")
def x3(spark, d):
    i = F.col("id")
    text = F.concat(F.chr(65 + i % 4), F.lit("_"), F.when(i % 3 == 0, "T").otherwise(""), i.cast("string"), F.when(i % 5 == 0, "B").otherwise(""))
    return pts(spark, d).select("id", Z.residue_id(text).alias("r")).select("id", "r.chain", "r.aa", "r.seq_num", "r.ins_code")


@query("x4_math", "SELECT id, round(2 / (exp(-score) + 1) - 1, 6) AS sigmoid01, round(2 * atan(score) / pi(), 6) AS squash, round(exp(-(score * score) / 8), 6) AS gauss, CAST(ceil(id / 7) AS BIGINT) AS ceil_div FROM pts", "pts")
def x4(spark, d):
    from orrery.functions.weights import gauss
    from orrery.operators.transform import sigmoid01, squash

    s = F.col("score")
    return pts(spark, d).select("id", r6(sigmoid01(s)).alias("sigmoid01"), r6(squash(s)).alias("squash"), r6(gauss(s)).alias("gauss"), F.ceil(F.col("id") / 7).cast("long").alias("ceil_div"))


@query("x5_formats", "SELECT id, printf('%.2f', score) AS score_text, printf('%.3f', score) AS probability_text FROM pts", "pts")
def x5(spark, d):
    return pts(spark, d).select("id", Z.score_text(F.col("score")).alias("score_text"), Z.probability_text(F.col("score")).alias("probability_text"))


@query("x6_lists", "SELECT vec_id, list_slice(embedding, 1, 3)[1] AS first, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 2)), 5) AS total FROM embeddings")
def x6(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", Z.list_head(e, 3)[0].alias("first"), r6(Z.list_total(e, 2.0), 5).alias("total"))


@query("x7_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def x7(spark, d):
    return table(spark, d, "events").select("event_id", Z.json_value(F.col("props"), "$.k").alias("k"))


@query("p9_ligand_definition", "SELECT p_partkey, split_part(p_brand, '#', 1) AS name, p_size AS atom_id FROM part WHERE p_size > 25")
def p9(spark, d):
    text = F.concat(F.substring_index("p_brand", "#", 1), F.lit("[atom_id:"), F.col("p_size").cast("string"), F.lit("]"))
    return table(spark, d, "part").withColumn("l", Z.ligand_definition(text)).where("l.atom_id > 25").select("p_partkey", "l.name", "l.atom_id")


@query("p10_relevant", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')")
def p10(spark, d):
    ignored = spark.createDataFrame([("5-LOW",), ("4-NOT SPECIFIED",)], "o_orderpriority string")
    return structures.not_ignored(table(spark, d, "orders"), ignored, "o_orderpriority").select("o_orderkey")


@query("p11_categories", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_orderkey % 7 > 4 THEN 'distant' WHEN o_custkey % 10 > 5 THEN 'off_center' ELSE 'relevant' END AS category FROM orders")
def p11(spark, d):
    c = structures.ligand_category(F.col("o_totalprice") < 50000, F.col("o_orderkey") % 7 > 4, F.col("o_custkey") % 10 > 5)
    return table(spark, d, "orders").select("o_orderkey", c.alias("category"))


@query("p12_split", "SELECT o_orderstatus = 'F' AS side, count(*) AS n FROM orders GROUP BY 1")
def p12(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_orderstatus") == "F").alias("side")).agg(F.count("*").alias("n"))


@query("p13_residue_codes", "SELECT id, CASE id % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'N' WHEN 2 THEN 'A' ELSE '?' END AS letter FROM pts", "pts")
def p13(spark, d):
    code = F.element_at(F.array(*map(F.lit, ("MSE", "MEN", "ALA", "XYZ"))), (F.col("id") % 4 + 1).cast("int"))
    return pts(spark, d).select("id", X.one_letter(code).alias("letter"))


@query("p7_normalised_score", "SELECT id, round(greatest(score / nullif(score + 0.3, 0), 0), 6) AS p FROM pts", "pts")
def p7(spark, d):
    return pts(spark, d).select("id", r6(A.normalised_score(F.col("score"), F.lit(0.3))).alias("p"))


@query("j10_equi_join", "SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey")
def j10(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").select("o_orderkey", "c_name")


@query("j11_property_default", "SELECT l_partkey, count(*) AS n, round(sum(coalesce(p_retailprice, 0)), 2) AS total FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 10) ON p_partkey = l_partkey GROUP BY 1")
def j11(spark, d):
    props = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("price"))
    x = X.table_values(table(spark, d, "lineitem").select("l_partkey"), "l_partkey", props, ["price"])
    return x.groupBy("l_partkey").agg(F.count("*").alias("n"), r6(F.sum("price"), 2).alias("total"))


@query(
    "j12_table_merge",
    "SELECT coalesce(a.p_partkey, b.p_partkey) AS k, coalesce(b.p_size, a.p_size) AS v FROM (SELECT * FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey, p_size + 100 AS p_size FROM part WHERE p_partkey % 2 = 0) b ON a.p_partkey = b.p_partkey",
)
def j12(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("v"))
    b = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), (F.col("p_size") + 100).alias("v"))
    return tables.merged(a, b).select(F.col("key").alias("k"), F.col("value").alias("v"))


@query(
    "j17_labelings",
    "SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS both_pos, count(*) FILTER (quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (quality = 0 AND toxic = 1) AS only_b, count(*) FILTER (quality = 0 AND toxic = 0) AS neither FROM labels",
)
def j17(spark, d):
    n = table(spark, d, "labels")
    return E.label_agreement(n.select("doc_id", "quality"), n.select("doc_id", "toxic"), ["doc_id"], "quality", "toxic")


@query("j19_parameter_grid", "SELECT DISTINCT a.l_returnflag AS a, b.range * 2 AS b, c.o_orderpriority AS c FROM (SELECT DISTINCT l_returnflag FROM lineitem) a, range(4) b, (SELECT DISTINCT o_orderpriority FROM orders) c")
def j19(spark, d):
    # a handful of values each
    of = lambda t, c: sorted(r[0] for r in table(spark, d, t).select(c).distinct().collect())
    return learn.grid(spark, {"a": of("lineitem", "l_returnflag"), "b": "[0:6:2]", "c": of("orders", "o_orderpriority")})


_ROWS = """s AS (
  SELECT user_id, list(letter ORDER BY ts, event_id) FILTER (event_id % 7 <> 0) AS a, list(CASE WHEN event_id % 11 = 0 THEN 'x' ELSE letter END ORDER BY ts, event_id) FILTER (event_id % 5 <> 0) AS b,
    list(value ORDER BY ts, event_id) FILTER (event_id % 5 <> 0) AS v FROM chain GROUP BY user_id),
r AS (
  SELECT user_id, 0::BIGINT AS i, list_transform(range(len(b) + 1), lambda x: 0::BIGINT) AS t FROM s
  UNION ALL
  SELECT r.user_id, i + 1, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(b) + 1), lambda x: [x])),
    lambda acc, x: list_append(acc, CASE WHEN a[i + 1] = b[x[1]] THEN t[x[1]] + 1 ELSE greatest(t[x[1] + 1], acc[len(acc)]) END)) FROM r JOIN s USING (user_id) WHERE i < len(a)),
back AS (
  SELECT user_id, len(a)::BIGINT AS i, len(b)::BIGINT AS j, a, b FROM s
  UNION ALL
  SELECT k.user_id, CASE WHEN k.a[k.i] = k.b[k.j] OR h.t[k.j] <= u.t[k.j + 1] THEN k.i - 1 ELSE k.i END, CASE WHEN k.a[k.i] = k.b[k.j] OR h.t[k.j] > u.t[k.j + 1] THEN k.j - 1 ELSE k.j END, k.a, k.b
  FROM back k JOIN r h ON h.user_id = k.user_id AND h.i = k.i JOIN r u ON u.user_id = k.user_id AND u.i = k.i - 1 WHERE k.i > 0 AND k.j > 0)"""


@query(
    "j18_alignment",
    f"""WITH {_ROWS}, m AS (SELECT user_id, i, j FROM back WHERE i > 0 AND j > 0 AND a[i] = b[j]), p AS (SELECT user_id, v, unnest(range(1, len(a) + 1)) AS pos FROM s)
SELECT p.user_id, pos, coalesce(v[j], 0) AS score FROM p LEFT JOIN m ON m.user_id = p.user_id AND m.i = pos""",
    "chain",
)
def j18(spark, d):
    c = chain(spark, d)
    ordered = lambda where, value: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct(*CHAIN_ORDER, value.alias("_v"))))), lambda x: x["_v"])
    ours, theirs = F.col("event_id") % 7 != 0, F.col("event_id") % 5 != 0
    letter = F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.col("letter"))
    both = c.groupBy("user_id").agg(ordered(ours, F.col("letter")).alias("a"), ordered(theirs, letter).alias("b"), ordered(theirs, F.col("value")).alias("values"))
    named = both.select(F.col("user_id").cast("string").alias("item"), F.lit("A").alias("chain_id"), "a", "b", "values")
    found = tables.aligned_scores(named.select("item", "chain_id", F.array_join("a", "").alias("seq")), named.select("item", "chain_id", F.array_join("b", "").alias("seq"), "values"))
    return found.select(F.col("item").cast("long").alias("user_id"), F.col("pos").cast("long").alias("pos"), "score")


@query("s1_dataset_rows", "SELECT doc_id, CAST(list_sum(list_transform(string_split(text, chr(10)), lambda line: len(list_filter(regexp_split_to_array(trim(regexp_replace(line, '#.*', '')), '\\s+'), lambda w: w <> '')))) AS BIGINT) AS n FROM documents")
def s1(spark, d):
    each = F.transform(F.split("text", "\n"), lambda line: F.size(Z.words(F.trim(F.regexp_replace(line, "#.*", "")))))
    return table(spark, d, "documents").select("doc_id", F.aggregate(each, F.lit(0), lambda a, b: a + b).cast("long").alias("n"))


@query("s4_joined_datasets", "SELECT c_custkey AS k, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s4(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(b, allowMissingColumns=True)


@query("s23_try_cast", "SELECT page_id, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS DOUBLE) AS v FROM pages")
def s23(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).try_cast("double").alias("v"))


@query("s26_label_strings", "SELECT grp, CAST(pos AS BIGINT) AS pos, CAST(substr(s, CAST(pos AS INT), 1) AS BIGINT) AS label FROM (SELECT grp, string_agg(CASE WHEN lig THEN '1' ELSE '0' END, '' ORDER BY id) AS s, count(*) AS n FROM pts GROUP BY grp), LATERAL (SELECT unnest(range(1, n + 1)) AS pos)", "pts")
def s26(spark, d):
    labels = sinks.sequences(pts(spark, d).withColumn("c", F.when(F.col("lig"), "1").otherwise("0")), ["grp"], ["id"], "c")
    three = F.array(F.concat(F.lit(">"), "grp"), F.repeat(F.lit("G"), F.length("seq")), F.col("seq"))
    lines = labels.select(F.concat(F.lit("labels"), "grp").alias("item"), "grp", F.posexplode(three).alias("k", "value")).withColumn("line_no", F.col("grp") * 3 + F.col("k"))
    x = tables.sprint_labels(lines)
    return x.select(F.col("code").cast("long").alias("grp"), F.col("pos").cast("long").alias("pos"), F.col("label").cast("long").alias("label"))


@query("k1_residue_lists", "SELECT grp, string_agg(DISTINCT CAST(id AS VARCHAR), ' ' ORDER BY CAST(id AS VARCHAR)) AS residue_ids, count(*) AS n FROM pts WHERE NOT lig GROUP BY grp", "pts")
def k1(spark, d):
    return pts(spark, d).where("not lig").groupBy("grp").agg(Z.id_list(F.col("id")).alias("residue_ids"), F.count("*").alias("n"))


@query("k7_sequences", "SELECT user_id, string_agg(letter, '' ORDER BY ts, event_id) AS seq FROM chain GROUP BY 1", "chain")
def k7(spark, d):
    from orrery.plans.registry import chain

    return sinks.sequences(chain(spark, d), ["user_id"], ["ts", "event_id"], "letter").select("user_id", "seq")


@query("y13_random_forest")
def y13(spark, d):
    return learn.demo_forest(pts(spark, d))


@query("y15_importances")
def y15(spark, d):
    return learn.demo_importances(pts(spark, d))


@query("y16_cross_validation")
def y16(spark, d):
    return learn.demo_cross_validation(pts(spark, d))


@query("y16_seed_loop")
def y16_seeds(spark, d):
    return learn.demo_seed_loop(pts(spark, d))


@query("y13_boosted")
def y13_boosted(spark, d):
    return learn.demo_boosted(pts(spark, d))


@query("y13_stacked")
def y13_stacked(spark, d):
    return learn.demo_stacked(pts(spark, d))


@query("y17_value_ranges", "SELECT s_suppkey, 0.5::DOUBLE * (s_suppkey % 3) + v * 0.25::DOUBLE AS v FROM (SELECT s_suppkey, unnest(range(s_suppkey % 13 * 4 - s_suppkey % 3 * 2 + 1)) AS v FROM supplier WHERE s_suppkey % 13 * 4 >= s_suppkey % 3 * 2)")
def y17(spark, d):
    k = F.col("s_suppkey")
    spec = F.format_string("[%.1f:%d:0.25]", 0.5 * (k % 3), k % 13)
    return table(spark, d, "supplier").select("s_suppkey", F.explode(learn.range_values(spec)).alias("v"))
