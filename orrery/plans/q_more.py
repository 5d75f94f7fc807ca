"""Further queries: filters on names, neighbourhoods, lookups with defaults, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import features as X
from orrery.operators import sampling as M
from orrery.operators import spatial as S
from orrery.operators import windows as W
from orrery.plans.registry import chain, pts, query, r6
from orrery.session import table
from orrery.sources import sinks, structures

_D2 = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
_NAMES = ("CA", "HA", "N", "1H", "O", "CB", "H")


def _named(spark, d):
    i = F.col("id")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (i % 7 + 1).cast("int"))
    res = F.when(i % 5 == 0, "HOH").when(i % 5 == 1, "ATP").otherwise("ALA")
    return pts(spark, d).select("id", "grp", name.alias("name"), F.when(i % 11 == 0, "H").otherwise("C").alias("element"), res.alias("res_name"), (i % 5 < 2).alias("is_het"))


_NM = f"nm AS (SELECT id, grp, list_extract({list(_NAMES)!r}, CAST(id % 7 + 1 AS INT)) AS name, CASE WHEN id % 11 = 0 THEN 'H' ELSE 'C' END AS element, CASE WHEN id % 5 = 0 THEN 'HOH' WHEN id % 5 = 1 THEN 'ATP' ELSE 'ALA' END AS res_name, id % 5 < 2 AS is_het FROM pts)"


@query("p1_heavy_atoms", f"WITH {_NM} SELECT id FROM nm WHERE NOT (element = 'H' OR starts_with(name, 'H') OR substr(name, 2, 1) = 'H')", "pts")
def p1(spark, d):
    return structures.heavy(_named(spark, d)).select("id")


@query("p2_hetero_no_water", f"WITH {_NM} SELECT id, res_name FROM nm WHERE is_het AND res_name <> 'HOH'", "pts")
def p2(spark, d):
    return structures.hetero(_named(spark, d)).select("id", "res_name")


_CODES = ("ALA", "UNK", "XYZ", "GLY", "MSE", "LIG", "SER")


@query(
    "p3_amino_acids",
    f"""WITH r AS (SELECT id, grp, list_extract({list(_CODES)!r}, CAST(id % 7 + 1 AS INT)) AS n, id % 3 = 0 AS h FROM pts),
k AS (SELECT *, n IN ('ALA', 'GLY', 'MSE', 'SER') AS known, lag(n) OVER w AS p, lead(n) OVER w AS q FROM r WINDOW w AS (PARTITION BY grp ORDER BY id))
SELECT id, known OR starts_with(n, 'UNK') OR coalesce(h AND (p IS NULL OR p IN ('ALA', 'GLY', 'MSE', 'SER')) AND q IS NOT NULL AND q IN ('ALA', 'GLY', 'MSE', 'SER'), false) AS amino_acid FROM k""",
    "pts",
)
def p3(spark, d):
    i = F.col("id")
    r = pts(spark, d).select("id", "grp", F.element_at(F.array(*map(F.lit, _CODES)), (i % 7 + 1).cast("int")).alias("res_name"), (i % 3 == 0).alias("has_amino_atoms"))
    return X.is_amino_acid(r, ["grp"], ["id"]).select("id", "amino_acid")


@query("p16_no_nan", "SELECT count(*) AS n, count(*) FILTER (isnan(score)) AS n_nan FROM pts", "pts")
def p16(spark, d):
    return pts(spark, d).agg(F.count("*").alias("n"), F.count_if(F.isnan("score")).alias("n_nan"))


@query("y3_deep_layer", f"SELECT a.id FROM pts a WHERE NOT a.lig AND EXISTS (SELECT 1 FROM pts b WHERE NOT b.lig AND b.score >= 0.9 AND {_D2} <= 100)", "pts")
def y3(spark, d):
    p = pts(spark, d).where("not lig")
    return S.shell(p, p.where("score >= 0.9"), 10.0).select("id")


@query("y5_positive_ligand_types", "SELECT id FROM pts WHERE grp IN (0, 3, 5) AND lig", "pts")
def y5(spark, d):
    return pts(spark, d).where(F.col("grp").isin(0, 3, 5) & F.col("lig")).select("id")


_P, _A = "(SELECT * FROM pts WHERE lig)", "(SELECT *, id % 40 AS residue, score * 10 AS asa FROM pts WHERE NOT lig)"


@query("f17_area_near", f"SELECT a.id, round(coalesce(sum(b.asa), 0), 5) AS asa FROM {_P} a LEFT JOIN {_A} b ON {_D2} <= 36 GROUP BY a.id", "pts")
def f17(spark, d):
    p = pts(spark, d)
    a = p.where("not lig").withColumn("residue", F.col("id") % 40).withColumn("asa", F.col("score") * 10)
    return X.area_near(p.where("lig"), a, 6.0).select("id", r6("asa", 5).alias("asa"))


@query(
    "f18_residue_area_near",
    f"""WITH whole AS (SELECT residue, sum(asa) AS t FROM {_A} GROUP BY 1), near AS (SELECT DISTINCT a.id, b.residue FROM {_P} a JOIN {_A} b ON {_D2} <= 36)
SELECT a.id, round(coalesce(sum(t), 0), 5) AS asa FROM {_P} a LEFT JOIN near USING (id) LEFT JOIN whole USING (residue) GROUP BY a.id""",
    "pts",
)
def f18(spark, d):
    p = pts(spark, d)
    a = p.where("not lig").withColumn("residue", F.col("id") % 40).withColumn("asa", F.col("score") * 10)
    return X.area_near(p.where("lig"), a, 6.0, per_residue=True).select("id", r6("asa", 5).alias("asa"))


@query("f21_conservation_default", "SELECT o_orderkey, coalesce(c_acctbal, 0) AS score FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def f21(spark, d):
    props = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("score"))
    return X.table_values(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", props, ["score"]).select("o_orderkey", "score")


@query(
    "f22_conservation_cloud",
    f"WITH one AS (SELECT a.id, b.residue, max(round(b.score * 100)) AS s FROM {_P} a JOIN {_A} b ON {_D2} <= 64 GROUP BY 1, 2), g AS (SELECT id, avg(s) AS mean FROM one GROUP BY 1) SELECT a.id, round(coalesce(mean, 0), 6) AS mean FROM {_P} a LEFT JOIN g USING (id)",
    "pts",
)
def f22(spark, d):
    p = pts(spark, d)
    # whole hundredths, so that the order of summation doesn't matter
    a = p.where("not lig").withColumn("residue", F.col("id") % 40).withColumn("score", F.round(F.col("score") * 100))
    return X.feature("conserv_cloud").compute(points=p.where("lig"), exposed=a, radius=8.0).select("id", r6("mean").alias("mean"))


@query(
    "f29_triplet_lookup",
    """WITH nb AS (SELECT event_id, letter AS a, coalesce(lag(letter) OVER w, '_') AS p, coalesce(lead(letter) OVER w, '_') AS n FROM chain WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN p <= n THEN p || a || n ELSE n || a || p END AS triplet, CASE WHEN a = 'p' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS propensity FROM nb""",
    "chain",
)
def f29(spark, d):
    x = W.triplets(chain(spark, d), ["user_id"], ["ts", "event_id"], "letter").select("event_id", "triplet")
    props = x.select(F.col("triplet").alias("key")).distinct().where("substr(key, 2, 1) = 'p'").withColumn("propensity", F.lit(0.5))
    return X.table_values(x, "triplet", props, ["propensity"])


@query("k2_residue_rows", "SELECT CAST(id AS VARCHAR) AS residue_label, printf('%.4f', score) AS score, printf('%.4f', score * 2) AS zscore, CASE WHEN lig THEN grp ELSE 0 END AS pocket FROM pts", "pts")
def k2(spark, d):
    p = pts(spark, d).select(F.lit("a").alias("item"), F.lit("A").alias("chain"), F.col("id").cast("string").alias("residue_label"), F.lit("GLY").alias("residue_name"), "score", (F.col("score") * 2).alias("zscore"), F.lit(0.0).alias("probability"), F.when(F.col("lig"), F.col("grp")).alias("pocket"))
    return sinks.residues(p).select("residue_label", "score", "zscore", "pocket")


@query("k15_residue_cases", "SELECT count(*) AS n, CASE WHEN lig AND score >= 0.5 THEN 'TP' WHEN lig THEN 'FN' WHEN score >= 0.5 THEN 'FP' ELSE 'TN' END AS kind FROM pts GROUP BY 2", "pts")
def k15(spark, d):
    hit = F.col("score") >= 0.5
    kind = F.when(F.col("lig") & hit, "TP").when(F.col("lig"), "FN").when(hit, "FP").otherwise("TN")
    return pts(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("w12_sorted_importances", "SELECT id % 3 AS model, grp, round(sum(score), 5) AS importance, row_number() OVER (PARTITION BY id % 3 ORDER BY round(sum(score), 5) DESC, grp) AS place FROM pts GROUP BY id % 3, grp", "pts")
def w12(spark, d):
    g = pts(spark, d).groupBy((F.col("id") % 3).alias("model"), "grp").agg(r6(F.sum("score"), 5).alias("importance"))
    return W.ranked(g, ["model"], "importance", "grp", "place").withColumn("place", F.col("place").cast("long"))


def _box(margin: int) -> str:
    return "box AS (SELECT grp, " + ", ".join(f"min({c}) - {margin} AS lo_{c}, (max({c}) + {margin}) - (min({c}) - {margin}) AS w_{c}" for c in "xyz") + " FROM pts WHERE lig GROUP BY grp)"


_UNIT = "CAST(('0x' || substr(md5(grp || ':' || i || ':42:{0}'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
_RANDOM = f"""SELECT grp, i AS id, {", ".join(f"lo_{c} + ({_UNIT.format(c)}) * w_{c} AS {c}" for c in "xyz")}
  FROM (SELECT *, unnest(range(greatest(1, CAST(floor(w_x * w_y * w_z / 8.0::DOUBLE) AS BIGINT)))) AS i FROM box)"""
_STEPS = "SELECT * FROM box"
for _c in "zyx":
    _STEPS = f"SELECT *, unnest(range(CAST(floor(w_{_c} / 2) AS BIGINT) + 1)) AS i{_c} FROM ({_STEPS})"
_GRID = f"""SELECT grp, (ix * 1048576 + iy) * 1048576 + iz AS id, {", ".join(f"lo_{c} + (w_{c} - 2 * round_even(w_{c} / 2, 0)) + i{c} * 2 AS {c}" for c in "xyz")} FROM ({_STEPS})"""


def _around(points: str, most: float, least: float) -> str:
    same = "a.grp = b.grp AND"
    return f"SELECT grp, id, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM ({points}) a WHERE EXISTS (SELECT 1 FROM pts b WHERE b.lig AND {same} {_D2} <= {most * most}) AND NOT EXISTS (SELECT 1 FROM pts b WHERE NOT b.lig AND {same} {_D2} < {least * least})"


def _sampled(spark, d, strategy: str, most: float, least: float):
    p = pts(spark, d)
    out = M.sampled_points(strategy, p.where("lig"), p.where("not lig"), p.where("not lig"), most, least, by="grp")
    return out.select("grp", "id", *(r6(c, 5).alias(c) for c in S.XYZ))


@query("m6_random_points", f"WITH {_box(5)} {_around(_RANDOM, 5, 1)}", "pts")
def m6(spark, d):
    return _sampled(spark, d, "random", 5.0, 1.0)


_ATOMS = "SELECT grp, id, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM pts a WHERE "


@query(
    "m8_sampling_strategies",
    f"""WITH {_box(4)} SELECT 'surface' AS strategy, * FROM ({_ATOMS} NOT lig AND EXISTS (SELECT 1 FROM pts b WHERE b.lig AND a.grp = b.grp AND {_D2} <= 16))
UNION ALL SELECT 'atoms', * FROM ({_ATOMS} lig) UNION ALL SELECT 'grid', * FROM ({_around(_GRID, 4, 2.5)}) UNION ALL SELECT 'random', * FROM ({_around(_RANDOM, 4, 2.5)})""",
    "pts",
)
def m8(spark, d):
    parts = [_sampled(spark, d, s, 4.0, 2.5).withColumn("strategy", F.lit(s)) for s in ("surface", "atoms", "grid", "random")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("y20_chain_report", "SELECT user_id, count(*) AS n_residues, string_agg(letter, '' ORDER BY ts, event_id) AS seq FROM chain GROUP BY 1", "chain")
def y20(spark, d):
    from orrery.sources.sinks import sequences

    c = chain(spark, d)
    return c.groupBy("user_id").agg(F.count("*").alias("n_residues")).join(sequences(c, ["user_id"], ["ts", "event_id"], "letter"), "user_id")


@query("y21_index_pivot", "SELECT l_returnflag AS key, " + ", ".join(f"round(sum(CASE WHEN l_linenumber = {k} THEN l_quantity ELSE 0 END), 3) AS n{k}" for k in range(1, 8)) + " FROM lineitem GROUP BY 1")
def y21(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("key")).pivot("l_linenumber", list(range(1, 8))).agg(F.sum("l_quantity"))
    return p.select("key", *(r6(F.coalesce(F.col(str(k)), F.lit(0.0)), 3).alias(f"n{k}") for k in range(1, 8)))
