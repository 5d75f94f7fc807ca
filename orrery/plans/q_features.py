"""Queries that compute features of points and residues."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import features as X
from orrery.operators import spatial as S
from orrery.operators import windows as W
from orrery.plans.registry import CHAIN_ORDER, chain, pts, query, r6
from orrery.session import table

_D2 = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
_P = "(SELECT * FROM pts WHERE lig)"
_A = "(SELECT * FROM pts WHERE NOT lig)"


def _sides(spark, d):
    p = pts(spark, d)
    return p.where("lig"), p.where("not lig")


@query("f4_signed_power", "SELECT s_suppkey, round(sign(s_acctbal) * pow(abs(s_acctbal), 0.5), 6) AS v, round(s_acctbal * s_acctbal, 2) AS sq FROM supplier")
def f4(spark, d):
    b = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", r6(F.signum(b) * F.pow(F.abs(b), F.lit(0.5))).alias("v"), r6(X.signed_power(b, 2.0, False), 2).alias("sq"))


@query("f5_table_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_retailprice, 0) AS price FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 20) ON p_partkey = l_partkey")
def f5(spark, d):
    props = table(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("price"))
    return X.table_values(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", props, ["price"])


@query("f7_one_hot", "SELECT l_shipmode_proxy AS k, " + ", ".join(f"sum(CAST(l_returnflag = '{v}' AS DOUBLE)) AS v_{v}" for v in "ANR") + " FROM (SELECT l_returnflag, l_linestatus AS l_shipmode_proxy FROM lineitem) GROUP BY 1")
def f7(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("k"), *X.one_hot(F.col("l_returnflag"), ["A", "N", "R"], "v_"))
    return x.groupBy("k").agg(*(F.sum(f"v_{v}").alias(f"v_{v}") for v in "ANR"))


@query("f8_exposed", f"SELECT a.id, CASE WHEN EXISTS (SELECT 1 FROM pts b WHERE b.lig AND {_D2} <= 16.81) THEN 1.0 ELSE 0.0 END::DOUBLE AS exposed FROM {_A} a", "pts")
def f8(spark, d):
    p, a = _sides(spark, d)
    return X.feature("exposed").compute(atoms=a, exposed=S.shell(a, p, 4.1))


@query("f9_exposed_distance", f"SELECT a.id, round(sqrt(min({_D2})), 6) AS exposed_dist FROM {_P} a CROSS JOIN {_A} b GROUP BY a.id", "pts")
def f9(spark, d):
    p, a = _sides(spark, d)
    return X.feature("exposed_dist").compute(points=p, exposed=a).select("id", r6("exposed_dist").alias("exposed_dist"))


@query("f10_protrusion", f"SELECT a.id, count(b.id) AS protrusion FROM {_P} a LEFT JOIN {_A} b ON {_D2} <= 100 GROUP BY a.id", "pts")
def f10(spark, d):
    p, a = _sides(spark, d)
    return X.feature("protrusion").compute(points=p, atoms=a)


@query("f11_surface_protrusion", f"SELECT a.id, count(b.id) AS surface_protrusion FROM {_P} a LEFT JOIN (SELECT * FROM pts WHERE NOT lig AND score >= 0.3) b ON {_D2} <= 100 GROUP BY a.id", "pts")
def f11(spark, d):
    p, a = _sides(spark, d)
    return X.feature("surface_protrusion").compute(points=p, exposed=a.where("score >= 0.3"))


_C = [f"sum(CAST({_D2} <= {r}*{r} AS DOUBLE))" for r in ("4.0", "5.5", "7.0", "8.5", "10.0")]


@query(
    "f12_protrusion_histogram",
    "SELECT id, c0 AS b0, " + ", ".join(f"c{i} - c{i - 1} AS b{i}" for i in range(1, 5)) + f" FROM (SELECT a.id, {', '.join(f'coalesce({c}, 0) AS c{i}' for i, c in enumerate(_C))} FROM {_P} a LEFT JOIN {_A} b ON {_D2} <= 100 GROUP BY a.id)",
    "pts",
)
def f12(spark, d):
    p, a = _sides(spark, d)
    return X.feature("protr_hist").compute(points=p, atoms=a)


@query("f15_center_distance", f"WITH c AS (SELECT a.id, a.x, a.y, a.z, avg(b.x) AS bx, avg(b.y) AS by_, avg(b.z) AS bz FROM {_P} a LEFT JOIN {_A} b ON {_D2} <= 121 GROUP BY 1, 2, 3, 4) SELECT id, round(coalesce(sqrt((x-bx)*(x-bx)+(y-by_)*(y-by_)+(z-bz)*(z-bz)), 0), 6) AS pmass FROM c", "pts")
def f15(spark, d):
    p, a = _sides(spark, d)
    return X.feature("pmass").compute(points=p, atoms=a).select("id", r6("pmass").alias("pmass"))


@query("f16_xyz", "SELECT id, x, y, z FROM pts", "pts")
def f16(spark, d):
    return X.feature("xyz").compute(points=pts(spark, d))


def _pyramid_sql() -> str:
    knn = f"""nn AS (SELECT a.id, a.x AS x_, a.y AS y_, a.z AS z_, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) - 1 AS k FROM {_P} a CROSS JOIN {_A} b),
w AS (SELECT id, x_, y_, z_, {', '.join(f'max(CASE WHEN k = {k} THEN {c} END) AS {c}{k}' for k in range(9) for c in 'xyz')} FROM nn WHERE k < 9 GROUP BY 1, 2, 3, 4)"""
    dist = lambda a, b: "sqrt(" + "+".join(f"({c}{a}-{c}{b})*({c}{a}-{c}{b})" for c in "xyz") + ")"
    parts, pairs = [], sorted({tuple(sorted(map(str, q))) for t in X.PYRAMIDS for q in [("_", t[0]), ("_", t[1]), ("_", t[2]), (t[0], t[1]), (t[0], t[2]), (t[1], t[2])]})
    dd = "dd AS (SELECT *, " + ", ".join(f"{dist(a, b)} AS d{a}{b}".replace("d_", "d_").replace("d", "d", 1) for a, b in pairs) + " FROM w)"
    name = lambda a, b: "d" + "".join(sorted((str(a), str(b))))
    area = lambda u, v, t: f"sqrt(greatest((({u}+{v}+{t})/2)*(({u}+{v}+{t})/2-{u})*(({u}+{v}+{t})/2-{v})*(({u}+{v}+{t})/2-{t}), 0))*0.5"
    for n, (i, j, k) in enumerate(X.PYRAMIDS, 1):
        center = "+".join(f"pow({c}_-({c}_+{c}{i}+{c}{j}+{c}{k})/4, 2)" for c in "xyz")
        ab, ac, ad, bc, bd, cd = name("_", i), name("_", j), name("_", k), name(i, j), name(i, k), name(j, k)
        parts += [f"round(sqrt({center}), 5) AS p{n}_dist", f"round({area(ab, ac, bc)}+{area(ab, ad, bd)}+{area(bc, bd, cd)}+{area(ac, ad, cd)}, 4) AS p{n}_surface"]
    return f"WITH {knn}, {dd} SELECT id, {', '.join(parts)} FROM dd"


@query("f14_pyramids", _pyramid_sql(), "pts")
def f14(spark, d):
    p, a = _sides(spark, d)
    x = X.feature("pyramid").compute(points=p, exposed=a)
    return x.select("id", *(r6(c, 5 if c.endswith("dist") else 4).alias(c) for c in x.columns if c != "id"))


@query("f19_contact_residue", f"SELECT id, " + ", ".join(f"CAST(g = {k} AS DOUBLE) AS g_{k}" for k in range(10)) + f" FROM (SELECT a.id, arg_min(b.grp, {_D2}) AS g FROM {_P} a CROSS JOIN {_A} b GROUP BY a.id)", "pts")
def f19(spark, d):
    p, a = _sides(spark, d)
    near = S.nearest(p, a, 6.0).join(a.select(F.col("id").alias("id_r"), "grp"), "id_r")
    return near.select("id", *X.one_hot(F.col("grp"), list(range(10)), "g_"))


@query(
    "f20_contacts",
    f"""WITH c AS (SELECT a.grp, a.score >= 0.5 AS head, b.grp AS other, b.id FROM pts a JOIN pts b ON a.grp <> b.grp AND {_D2} <= 3.3*3.3)
SELECT g.grp AS id, count(DISTINCT other) AS residues, count(DISTINCT c.id) AS atoms, count(DISTINCT CASE WHEN head THEN other END) AS head, count(DISTINCT CASE WHEN NOT head THEN other END) AS side
FROM (SELECT DISTINCT grp FROM pts) g LEFT JOIN c USING (grp) GROUP BY 1""",
    "pts",
)
def f20(spark, d):
    a = pts(spark, d).select("id", F.col("grp").alias("residue"), (F.col("score") >= 0.5).alias("head"), *S.XYZ)
    return X.feature("contactres").compute(atoms=a)


@query(
    "f23_conservation_cloud",
    f"""WITH one AS (SELECT a.id, b.id % 40 AS res, max(b.score) AS s FROM {_P} a JOIN {_A} b ON {_D2} <= 64 GROUP BY 1, 2), g AS (SELECT id, avg(s * s) AS mean, sum(s * s) AS sum, sqrt(count(*)) * sum(s * s) AS vpa FROM one GROUP BY 1)
SELECT a.id, round(coalesce(mean, 0), 6) AS mean, round(coalesce(sum, 0), 6) AS sum, round(coalesce(vpa, 0), 6) AS vpa FROM {_P} a LEFT JOIN g USING (id)""",
    "pts",
)
def f23(spark, d):
    p, a = _sides(spark, d)
    x = X.feature("conserv_cloud2").compute(points=p, exposed=a.withColumn("residue", F.col("id") % 40), radius=8.0, power=2.0)
    return x.select("id", *(r6(c).alias(c) for c in ("mean", "sum", "vpa")))


_OV = "(PARTITION BY user_id ORDER BY ts, event_id)"
_SEC = f"""turns AS (SELECT *, CASE WHEN lag(t) OVER {_OV} = t THEN 0 ELSE 1 END AS turn FROM chain), secs AS (SELECT *, sum(turn) OVER {_OV} AS section FROM turns),
pos AS (SELECT user_id, event_id, t, section, row_number() OVER (PARTITION BY user_id, section ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id, section) AS length FROM secs)"""


@query("f24_section_features", f"WITH {_SEC} SELECT user_id, event_id, length, pos, round(pos / length, 6) AS rel_pos, least(pos, abs(length - pos) + 1) AS abs_side, round(0.5 - abs(pos / length - 0.5), 6) AS rel_side FROM pos", "chain")
def f24(spark, d):
    x = X.section_features(W.islands(chain(spark, d), ["user_id"], CHAIN_ORDER, "t"))
    return x.select("user_id", "event_id", "length", "pos", r6("rel_pos").alias("rel_pos"), "abs_side", r6("rel_side").alias("rel_side"))


_SIMPLE = "CASE WHEN letter IN ('p', 'c') THEN 'H' WHEN letter = 'v' THEN 'E' ELSE 'C' END"


@query("f25_simple_types", f"SELECT event_id, CAST(s = 'H' AS DOUBLE) AS ss_H, CAST(s = 'E' AS DOUBLE) AS ss_E, CAST(s = 'C' AS DOUBLE) AS ss_C FROM (SELECT event_id, {_SIMPLE} AS s FROM chain)", "chain")
def f25(spark, d):
    s = F.when(F.col("letter").isin("p", "c"), "H").when(F.col("letter") == "v", "E").otherwise("C")
    return chain(spark, d).select("event_id", *X.one_hot(s, ["H", "E", "C"], "ss_"))


@query(
    "f26_section_motif",
    f"""WITH s AS (SELECT user_id, ts, event_id, {_SIMPLE} AS t FROM chain), turns AS (SELECT *, CASE WHEN lag(t) OVER {_OV} = t THEN 0 ELSE 1 END AS turn FROM s), secs AS (SELECT *, sum(turn) OVER {_OV} AS section FROM turns),
one AS (SELECT user_id, section, min(t) AS t FROM secs GROUP BY 1, 2), nb AS (SELECT user_id, section, t, coalesce(lag(t) OVER w, '') AS p, coalesce(lead(t) OVER w, '') AS n FROM one WINDOW w AS (PARTITION BY user_id ORDER BY section))
SELECT secs.event_id, least(p, n) || nb.t || greatest(p, n) AS motif FROM secs JOIN nb ON nb.user_id = secs.user_id AND nb.section = secs.section""",
    "chain",
)
def f26(spark, d):
    s = F.when(F.col("letter").isin("p", "c"), "H").when(F.col("letter") == "v", "E").otherwise("C")
    x = W.islands(chain(spark, d).withColumn("t", s), ["user_id"], CHAIN_ORDER, "t")
    around = W.sections(x, ["user_id"], "t").select("user_id", "section", "prev_type", "next_type")
    p, n = F.coalesce("prev_type", F.lit("")), F.coalesce("next_type", F.lit(""))
    return x.join(around, ["user_id", "section"]).select("event_id", F.concat(F.least(p, n), F.col("t"), F.greatest(p, n)).alias("motif"))


@query("f27_type_cloud", f"SELECT a.id, " + ", ".join(f"round(avg(CAST(b.grp % 3 = {k} AS INT)), 6) AS t{k}" for k in range(3)) + f" FROM {_P} a JOIN {_A} b ON {_D2} <= 64 GROUP BY a.id", "pts")
def f27(spark, d):
    p, a = _sides(spark, d)
    near = S.radius_join(p.select("id", *S.XYZ), a.select("grp", *S.XYZ), 8.0)
    return near.groupBy("id").agg(*(r6(F.avg((F.col("grp_r") % 3 == k).cast("double"))).alias(f"t{k}") for k in range(3)))


@query("f28_duplet_product", "SELECT id, round(CASE WHEN u = 0 THEN v * v WHEN v = 0 THEN u * u ELSE u * v END, 6) AS product FROM (SELECT id, CAST(id * 31 % 7 AS DOUBLE) / 10 AS u, CAST(id * 17 % 5 AS DOUBLE) / 10 AS v FROM pts)", "pts")
def f28(spark, d):
    x = pts(spark, d).select("id", ((F.col("id") * 31 % 7).cast("double") / 10).alias("u"), ((F.col("id") * 17 % 5).cast("double") / 10).alias("v"))
    return x.select("id", r6(X.propensity_product(F.col("u"), F.col("v"))).alias("product"))


_L = "CASE b.grp WHEN 0 THEN 'C' WHEN 1 THEN 'C' WHEN 2 THEN 'H' WHEN 3 THEN 'H' WHEN 4 THEN 'D' ELSE 'G' END"


@query(
    "f31_structural_motif",
    f"""WITH each AS (SELECT a.id, b.id AS res, min({_L}) AS letter, min({_D2}) AS d2 FROM {_P} a JOIN {_A} b ON {_D2} <= 100 GROUP BY 1, 2),
top AS (SELECT id, letter FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, res) AS k FROM each) WHERE k <= 4)
SELECT a.id, coalesce(sum(CAST(letter = 'C' AS INT)) >= 1 AND sum(CAST(letter = 'H' AS INT)) >= 1, false) AS ch, coalesce(sum(CAST(letter = 'C' AS INT)) >= 2, false) AS cc FROM {_P} a LEFT JOIN top USING (id) GROUP BY a.id""",
    "pts",
)
def f31(spark, d):
    p, a = _sides(spark, d)
    g = F.col("grp")
    letter = F.when(g.isin(0, 1), "C").when(g.isin(2, 3), "H").when(g == 4, "D").otherwise("G")
    x = X.nearest_letters(p, a.select(F.col("id").alias("residue"), letter.alias("letter"), *S.XYZ), 4, 10.0)
    return x.select("id", X.has_motif(F.col("letters"), "CH").alias("ch"), X.has_motif(F.col("letters"), "C2").alias("cc"))


@query(
    "f32_feature_plan",
    f"""WITH ex AS (SELECT DISTINCT b.* FROM {_A} b JOIN {_P} a ON a.grp % 2 = b.grp % 2 AND {_D2} <= 16.81),
agg AS (SELECT a.id, sum((1 - sqrt({_D2}) / 6) * b.score * 10) AS bfactor, sum((1 - sqrt({_D2}) / 6) * (b.id % 5 = 0)::INT) AS his FROM {_P} a JOIN ex b ON a.grp % 2 = b.grp % 2 AND {_D2} <= 36 GROUP BY a.id),
one AS (SELECT id, arg_min(atom, dist) AS atom FROM (SELECT a.id, b.id AS atom, [{_D2}, b.id] AS dist FROM {_P} a JOIN {_A} b ON a.grp % 2 = b.grp % 2) GROUP BY id)
SELECT a.id, round(coalesce(bfactor, 0), 5) AS bfactor, round(coalesce(his, 0), 5) AS his, (atom % 5 = 1)::DOUBLE AS near_asp, (SELECT count(*) FROM {_A} b WHERE a.grp % 2 = b.grp % 2 AND {_D2} <= 100)::DOUBLE AS protrusion
FROM {_P} a LEFT JOIN agg USING (id) LEFT JOIN one USING (id)""",
    "pts",
)
def f32_plan(spark, d):
    from orrery.params import Params
    from orrery.plans import run

    p = pts(spark, d).withColumn("item", (F.col("grp") % 2).cast("string"))
    code = F.element_at(F.array(*map(F.lit, ("HIS", "ASP", "GLY", "LYS", "MET"))), (F.col("id") % 5 + 1).cast("int"))
    atoms = p.where("not lig").select(
        "item", "id", F.col("id").cast("int").alias("serial"), F.lit("CA").alias("name"), code.alias("res_name"), F.lit("A").alias("chain_id"), F.col("id").cast("int").alias("seq_num"), F.lit(None).cast("string").alias("ins_code"),
        *S.XYZ, (F.col("score") * 10).alias("bfactor"), F.lit("C").alias("element"), F.lit(False).alias("is_het"),
    )
    out = run.vectors(run.protein(atoms), p.where("lig").select("item", "id", *S.XYZ), ["bfactor", "rtype_atomic", "rtype_sas", "protrusion"], Params())
    return out.select("id", r6("bfactor_bfactor", 5).alias("bfactor"), r6("rtype_atomic_HIS", 5).alias("his"), F.col("rtype_sas_ASP").alias("near_asp"), F.col("protrusion_protrusion").alias("protrusion"))


@query("f32_nearest_atom_wrapper", f"SELECT id, s AS v FROM (SELECT a.id, arg_min(b.score, {_D2}) AS s FROM {_P} a CROSS JOIN {_A} b GROUP BY a.id)", "pts")
def f32(spark, d):
    p, a = _sides(spark, d)
    values = a.select("id", F.col("score").alias("bfactor"))
    return X.as_sas("bfactor", p, a, values).select("id", F.col("`bfactor.bfactor`").alias("v"))
