"""Queries over points: radius, neighbour and set joins, clustering, pockets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions.weights import weights
from orrery.operators import aggregate as A
from orrery.operators import sampling as M
from orrery.operators import spatial as S
from orrery.operators import windows as W
from orrery.operators.components import close_components, components, large_enough
from orrery.plans.predict import predict_pockets
from orrery.plans.registry import pts, query, r6

_D2 = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


@query("j1_radius_join", f"SELECT a.id, b.id AS id_r, round({_D2}, 6) AS d2 FROM pts a JOIN pts b ON a.id < b.id AND {_D2} <= 9", "pts")
def j1(spark, d):
    p = pts(spark, d)
    return S.close_pairs(p, 3.0).select("id", "id_r", r6("d2").alias("d2"))


@query("j1_sphere", "SELECT id, grp FROM pts WHERE x*x + y*y + z*z <= 64", "pts")
def j1_sphere(spark, d):
    return S.sphere(pts(spark, d), (0.0, 0.0, 0.0), 8.0).select("id", "grp")


@query("j2_shell", f"SELECT a.id FROM pts a WHERE NOT a.lig AND EXISTS (SELECT 1 FROM pts b WHERE b.lig AND {_D2} <= 9)", "pts")
def j2(spark, d):
    p = pts(spark, d)
    return S.shell(p.where("not lig"), p.where("lig"), 3.0).select("id")


@query("j3_within_distance", f"SELECT a.id, EXISTS (SELECT 1 FROM pts b WHERE b.lig AND {_D2} <= 16) AS near FROM pts a", "pts")
def j3(spark, d):
    p = pts(spark, d)
    near = S.shell(p, p.where("lig"), 4.0).select("id", F.lit(True).alias("near"))
    return p.select("id").join(near, "id", "left").select("id", F.coalesce("near", F.lit(False)).alias("near"))


@query("j4_distant_at_least", f"SELECT a.id FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE b.lig AND {_D2} < 9)", "pts")
def j4(spark, d):
    p = pts(spark, d)
    return S.distant(p, p.where("lig"), 3.0).select("id")


_KNN = f"""SELECT id, id_r, round(d2, 6) AS d2, rank FROM (
  SELECT a.id, b.id AS id_r, {_D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS rank
  FROM pts a JOIN pts b ON %s) WHERE rank <= %d"""


@query("j5_nearest", "SELECT id, id_r, d2 FROM (" + _KNN % ("NOT a.lig AND b.lig", 1) + ")", "pts")
def j5(spark, d):
    p = pts(spark, d)
    return S.nearest(p.where("not lig"), p.where("lig"), 6.0).select("id", "id_r", r6("d2").alias("d2"))


@query("j6_knn", _KNN % ("b.lig", 4), "pts")
def j6(spark, d):
    p = pts(spark, d)
    return S.knn(p, p.where("lig"), 4, 8.0).select("id", "id_r", r6("d2").alias("d2"), F.col("rank").cast("long").alias("rank"))


@query("j7_nearest_different", "SELECT id, id_r, d2 FROM (" + _KNN % ("a.id <> b.id", 1) + ")", "pts")
def j7(spark, d):
    p = pts(spark, d)
    return S.nearest(p, p, 3.0, different=True).select("id", "id_r", r6("d2").alias("d2"))


@query("j8_radius_count", f"SELECT a.id, count(*) AS n FROM pts a JOIN pts b ON {_D2} <= 36 GROUP BY a.id", "pts")
def j8(spark, d):
    p = pts(spark, d)
    return S.radius_join(p, p.select("id", *S.XYZ), 6.0).groupBy("id").agg(F.count("*").alias("n"))


@query("j9_set_min_distance", f"SELECT a.grp AS grp_a, b.grp AS grp_b, round(min({_D2}), 6) AS min_d2 FROM pts a JOIN pts b ON a.grp < b.grp AND {_D2} <= 36 GROUP BY 1, 2", "pts")
def j9(spark, d):
    p = pts(spark, d)
    return S.min_distance(p, p, 6.0).where("grp_a < grp_b").select("grp_a", "grp_b", r6("min_d2").alias("min_d2"))


@query("j13_nearest_residue", "SELECT n.id, p.grp AS nearest_grp FROM (" + _KNN % ("NOT a.lig AND b.lig", 1) + ") n JOIN pts p ON p.id = n.id_r", "pts")
def j13(spark, d):
    p = pts(spark, d)
    near = S.nearest(p.where("not lig"), p.where("lig"), 6.0)
    return near.join(p.select(F.col("id").alias("id_r"), F.col("grp").alias("nearest_grp")), "id_r").select("id", "nearest_grp")


@query(
    "j14_nearest_residues",
    f"""SELECT id, grp, round(d2, 6) AS d2, rank FROM (SELECT id, grp, d2, row_number() OVER (PARTITION BY id ORDER BY d2, grp) AS rank FROM (
  SELECT a.id, b.grp, min({_D2}) AS d2 FROM pts a JOIN pts b ON a.lig AND NOT b.lig AND {_D2} <= 144 GROUP BY a.id, b.grp)) WHERE rank <= 3""",
    "pts",
)
def j14(spark, d):
    p = pts(spark, d)
    each = S.radius_join(p.where("lig").select("id", *S.XYZ), p.where("not lig").select("grp", *S.XYZ), 12.0).groupBy("id", F.col("grp_r").alias("grp")).agg(F.min("d2").alias("d2"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "grp"))
    return each.withColumn("rank", rank.cast("long")).where("rank <= 3").select("id", "grp", r6("d2").alias("d2"), "rank")


_POCKETS = """pockets AS (SELECT grp % 3 AS item, grp, avg(x) AS x, avg(y) AS y, avg(z) AS z, row_number() OVER (PARTITION BY grp % 3 ORDER BY round(sum(score), 6) DESC, grp) AS rank
  FROM pts WHERE NOT lig GROUP BY grp)"""


def _items(p):
    """Three structures; a pocket for each group of points."""
    p = p.withColumn("item", F.col("grp") % 3)
    each = p.where("not lig").groupBy("item", "grp").agg(*(F.avg(c).alias(c) for c in S.XYZ), r6(F.sum("score")).alias("score"))
    return p.where("lig"), W.ranked(each, ["item"], "score", "grp")


@query("j15_identification", f"WITH {_POCKETS} SELECT a.id, coalesce(min(b.rank), -1) AS rank FROM pts a LEFT JOIN pockets b ON a.grp % 3 = b.item AND {_D2} <= 64 WHERE a.lig GROUP BY a.id", "pts")
def j15(spark, d):
    lig, k = _items(pts(spark, d))
    hit = S.radius_join(lig.select("item", "id", *S.XYZ), k.select("item", "rank", *S.XYZ), 8.0, "item").groupBy("id").agg(F.min("rank_r").alias("rank"))
    return lig.select("id").join(hit, "id", "left").select("id", F.coalesce("rank", F.lit(-1)).cast("long").alias("rank"))


@query(
    "j16_closest_pocket",
    f"""WITH {_POCKETS} SELECT id, grp FROM (SELECT a.id, b.grp, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.grp) AS n
  FROM pts a CROSS JOIN pockets b WHERE a.lig) WHERE n = 1""",
    "pts",
)
def j16(spark, d):
    lig, k = _items(pts(spark, d))
    return S.nearest(lig, k.select(F.col("grp").alias("id"), *S.XYZ), 8.0).select("id", F.col("id_r").alias("grp"))


@query(
    "j20_peptide_binding",
    f"""WITH contact AS (SELECT a.grp, a.id, a.score >= 0.5 AS labelled FROM pts a WHERE NOT a.lig AND EXISTS (SELECT 1 FROM pts b WHERE b.lig AND {_D2} <= 12.25))
SELECT grp, count(*) AS n_contact, round(avg(CASE WHEN labelled THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN labelled THEN 1.0 ELSE 0.0 END) >= 0.5 AS binding FROM contact GROUP BY grp""",
    "pts",
)
def j20(spark, d):
    p = pts(spark, d)
    contact = S.shell(p.where("not lig"), p.where("lig"), 3.5)
    share = F.avg((F.col("score") >= 0.5).cast("double"))
    return contact.groupBy("grp").agg(F.count("*").alias("n_contact"), r6(share).alias("share"), (share >= 0.5).alias("binding"))


@query("p4_box_filter", "SELECT id FROM pts WHERE x BETWEEN -5 AND 5 AND y BETWEEN -5 AND 5 AND z BETWEEN -5 AND 5", "pts")
def p4(spark, d):
    return S.in_box(pts(spark, d), (-5.0,) * 3, (5.0,) * 3).select("id")


@query(
    "p5_bounds",
    "SELECT grp, " + ", ".join(f"round(min({c}) - 2, 6) AS min_{c}, round(max({c}) + 2, 6) AS max_{c}" for c in "xyz") + " FROM pts GROUP BY grp",
    "pts",
)
def p5(spark, d):
    b = S.bounds(pts(spark, d), 2.0, "grp")
    return b.select("grp", *(r6(c).alias(c) for c in b.columns if c != "grp"))


@query("p6_point_threshold", "SELECT id, score FROM pts WHERE score >= 0.35", "pts")
def p6(spark, d):
    return pts(spark, d).where("score >= 0.35").select("id", "score")


@query("p8_score_transform", "SELECT id, round(pow(greatest(score - 0.2, 0), 2), 6) AS s FROM pts", "pts")
def p8(spark, d):
    return pts(spark, d).select("id", r6(A.transformed_score(F.col("score"), 2.0, 0.2)).alias("s"))


@query(
    "p17_rotations",
    """WITH rot AS (SELECT * FROM (VALUES (0, 1, 0, 0, 0, 1, 0, 0, 0, 1), (1, 0, -1, 0, 1, 0, 0, 0, 0, 1), (2, 0, 0, 1, 0, 1, 0, -1, 0, 0)) t(rot, m11, m12, m13, m21, m22, m23, m31, m32, m33))
SELECT id, CAST(rot AS BIGINT) AS rot, round(m11*x + m12*y + m13*z, 6) AS x, round(m21*x + m22*y + m23*z, 6) AS y, round(m31*x + m32*y + m33*z, 6) AS z FROM pts, rot""",
    "pts",
)
def p17(spark, d):
    turns = [(0, 1, 0, 0, 0, 1, 0, 0, 0, 1), (1, 0, -1, 0, 1, 0, 0, 0, 0, 1), (2, 0, 0, 1, 0, 1, 0, -1, 0, 0)]
    names = ", ".join(f"m{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3))
    r = spark.createDataFrame([(t[0], *map(float, t[1:])) for t in turns], f"rot long, {names}")
    out = S.rotated(pts(spark, d).select("id", *S.XYZ), r)
    return out.select("id", "rot", *(r6(c).alias(c) for c in S.XYZ))


_U = ", ".join(f"('0x' || substr(h, {1 + 10 * n}, 10))::BIGINT / 1099511627776 AS u{n}" for n in range(3))


@query(
    "p17_random_rotations",
    f"""WITH k AS (SELECT *, md5('7:' || grp || ':' || rot) AS h FROM pts, (SELECT unnest(range(4)) AS rot)), u AS (SELECT *, {_U} FROM k),
q AS (SELECT id, rot, x AS px, y AS py, z AS pz, sqrt(1 - u0) * sin(2 * pi() * u1) AS x, sqrt(1 - u0) * cos(2 * pi() * u1) AS y, sqrt(u0) * sin(2 * pi() * u2) AS z, sqrt(u0) * cos(2 * pi() * u2) AS w FROM u)
SELECT id, rot, round(CASE WHEN rot = 0 THEN px ELSE (1 - 2 * (y*y + z*z)) * px + 2 * (x*y - z*w) * py + 2 * (x*z + y*w) * pz END, 6) AS x,
  round(CASE WHEN rot = 0 THEN py ELSE 2 * (x*y + z*w) * px + (1 - 2 * (x*x + z*z)) * py + 2 * (y*z - x*w) * pz END, 6) AS y,
  round(CASE WHEN rot = 0 THEN pz ELSE 2 * (x*z - y*w) * px + 2 * (y*z + x*w) * py + (1 - 2 * (x*x + y*y)) * pz END, 6) AS z FROM q""",
    "pts",
)
def p17_random(spark, d):
    out = S.randomly_rotated(pts(spark, d).select("id", "grp", *S.XYZ), "grp", 3, seed=7)
    return out.select("id", F.col("rot").cast("long").alias("rot"), *(r6(c).alias(c) for c in S.XYZ))


@query(
    "p18_lattice",
    f"""WITH box AS (SELECT {", ".join(f"min({c}) AS lo_{c}, max({c}) - min({c}) AS w_{c}" for c in "xyz")} FROM pts),
i AS (SELECT *, unnest(range(CAST(floor(w_x / 1.5) AS BIGINT) + 1)) AS ix FROM box), j AS (SELECT *, unnest(range(CAST(floor(w_y / 1.5) AS BIGINT) + 1)) AS iy FROM i), k AS (SELECT *, unnest(range(CAST(floor(w_z / 1.5) AS BIGINT) + 1)) AS iz FROM j)
SELECT ix, iy, iz, {", ".join(f"round(lo_{c} + (w_{c} - 1.5 * round_even(w_{c} / 1.5, 0)) + i{c} * 1.5, 6) AS {c}" for c in "xyz")} FROM k""",
    "pts",
)
def p18(spark, d):
    box = S.bounds(pts(spark, d)).first()
    out = S.lattice(spark, tuple(box[f"min_{c}"] for c in S.XYZ), tuple(box[f"max_{c}"] for c in S.XYZ), 1.5)
    return out.select("ix", "iy", "iz", *(r6(c).alias(c) for c in S.XYZ))


_W = {
    "ONE": "1.0", "NEW": "CASE WHEN d <= 3 THEN 1.0 ELSE 9.0/(d*d) END", "OLD": "CASE WHEN d <= 3 THEN 1.0 ELSE pow(3.0/d, 2) END", "GAUSS": "exp(-(d*d)/8.0)",
    "INV": "1.0 - d/6.0", "INVPOW": "pow(1.0 - d/6.0, 2)", "INV2": "(6.0 - d)/5.0", "INVPOW2": "pow((6.0 - greatest(d, 1.0))/5.0, 2)",
}


def _weighted(name: str):
    sql = f"""SELECT id, round(sum(({_W[name]}) * v), 5) AS v, count(*) AS n_atoms FROM (
  SELECT a.id, sqrt({_D2}) AS d, b.score AS v FROM pts a JOIN pts b ON a.lig AND NOT b.lig AND {_D2} <= 36) GROUP BY id"""

    @query(f"a1_weighted_{name.lower()}", sql, "pts")
    def run(spark, d):
        p = pts(spark, d)
        out = A.weighted_features(p.where("lig"), p.where("not lig").withColumn("v", F.col("score")), ["v"], 6.0, weights()[name])
        return out.select("id", r6("v", 5).alias("v"), "n_atoms")

    return run


for _name in _W:
    _weighted(_name)


@query(
    "a1_weighted_average",
    f"""SELECT id, round(sum((1.0 - d/6.0) * v) / pow(count(*), 0.5), 5) AS v, count(*) AS n_atoms FROM (
  SELECT a.id, sqrt({_D2}) AS d, b.score AS v FROM pts a JOIN pts b ON a.lig AND NOT b.lig AND {_D2} <= 36) GROUP BY id""",
    "pts",
)
def a1_avg(spark, d):
    p = pts(spark, d)
    out = A.weighted_features(p.where("lig"), p.where("not lig").withColumn("v", F.col("score")), ["v"], 6.0, weights()["INV"], avg_pow=0.5)
    return out.select("id", r6("v", 5).alias("v"), "n_atoms")


@query("a2_centroid", "SELECT grp, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM pts GROUP BY grp", "pts")
def a2(spark, d):
    return S.centroid(pts(spark, d), "grp").select("grp", *(r6(c).alias(c) for c in S.XYZ))


@query("a2_center_of_mass", "SELECT grp, " + ", ".join(f"round(sum((score + 1) * {c}) / sum(score + 1), 6) AS {c}" for c in "xyz") + " FROM pts GROUP BY grp", "pts")
def a2_mass(spark, d):
    return S.centroid(pts(spark, d).withColumn("m", F.col("score") + 1), "grp", "m").select("grp", *(r6(c).alias(c) for c in S.XYZ))


_CC = f"""WITH hot AS (SELECT * FROM pts WHERE score >= 0.35),
links AS (SELECT a.id AS u, b.id AS v FROM hot a JOIN hot b ON a.id <> b.id AND {_D2} <= 9),
reach AS (SELECT id AS u, id AS r FROM hot UNION SELECT l.v, reach.r FROM reach JOIN links l ON l.u = reach.u),
comp AS (SELECT u AS id, min(r) AS component FROM reach GROUP BY u)"""


@query("c1_single_linkage", _CC + " SELECT id, component FROM comp", "pts")
def c1(spark, d):
    hot = pts(spark, d).where("score >= 0.35")
    return close_components(hot, 3.0)


@query("c3_min_size", _CC + " SELECT component, count(*) AS n FROM comp GROUP BY component HAVING count(*) >= 3", "pts")
def c3(spark, d):
    return large_enough(c1(spark, d), 3)


@query(
    "c2_group_clustering",
    f"""WITH g AS (SELECT DISTINCT grp FROM pts), links AS (SELECT DISTINCT a.grp AS u, b.grp AS v FROM pts a JOIN pts b ON a.grp <> b.grp AND {_D2} <= 0.25),
reach AS (SELECT grp AS u, grp AS r FROM g UNION SELECT l.v, reach.r FROM reach JOIN links l ON l.u = reach.u)
SELECT u AS grp, min(r) AS component FROM reach GROUP BY u""",
    "pts",
)
def c2(spark, d):
    p = pts(spark, d)
    edges = S.min_distance(p, p, 0.5).where("grp_a < grp_b")
    return components(p.select("grp"), edges, "grp", "grp_a", "grp_b")


@query(
    "y9_predict_pockets",
    _CC.replace("a.id <> b.id AND", "a.id <> b.id AND a.grp = b.grp AND")
    + f""", big AS (SELECT component FROM comp GROUP BY component HAVING count(*) >= 3),
core AS (SELECT h.*, c.component FROM hot h JOIN comp c ON c.id = h.id JOIN big USING (component)),
member AS (SELECT DISTINCT b.component, a.id FROM pts a JOIN core b ON a.grp = b.grp AND {_D2} <= 12.25),
scored AS (SELECT p.grp AS item, m.component, round(sum(pow(greatest(p.score, 0), 2)), 5) AS score, count(*) AS n_points, round(avg(p.x), 5) AS x, round(avg(p.y), 5) AS y, round(avg(p.z), 5) AS z
  FROM member m JOIN pts p USING (id) GROUP BY p.grp, m.component)
SELECT item, 'pocket' || row_number() OVER w AS name, row_number() OVER w AS rank, component, score, n_points, x, y, z FROM scored WINDOW w AS (PARTITION BY item ORDER BY score DESC, component)""",
    "pts",
)
def y9(spark, d):
    out = predict_pockets(pts(spark, d).withColumn("item", F.col("grp")))
    return out.select("item", "name", F.col("rank").cast("long").alias("rank"), "component", "score", "n_points", "x", "y", "z")


@query("y1_exposed_atoms", f"SELECT a.id FROM pts a WHERE NOT a.lig AND EXISTS (SELECT 1 FROM pts b WHERE b.lig AND {_D2} <= 4.1*4.1)", "pts")
def y1(spark, d):
    p = pts(spark, d)
    return S.shell(p.where("not lig"), p.where("lig"), 4.1).select("id")


@query(
    "y4_point_labels",
    f"""SELECT id, CASE WHEN d2 <= 2.6*2.6 THEN 1 WHEN d2 > 8.1*8.1 THEN 0 END AS label FROM (SELECT a.id, min({_D2}) AS d2 FROM pts a JOIN pts b ON NOT a.lig AND b.lig GROUP BY a.id)
WHERE d2 <= 2.6*2.6 OR d2 > 8.1*8.1""",
    "pts",
)
def y4(spark, d):
    p = pts(spark, d)
    inner, outer = 2.6, 8.1
    near = S.radius_join(p.where("not lig").select("id", *S.XYZ), p.where("lig").select("id", *S.XYZ), outer).groupBy("id").agg(F.min("d2").alias("d2"))
    out = p.where("not lig").select("id").join(near, "id", "left")
    return out.select("id", F.when(F.col("d2") <= inner * inner, 1).when(F.col("d2").isNull() | (F.col("d2") > outer * outer), 0).alias("label")).where("label is not null")


@query(
    "y4_pocket_mode",
    f"""WITH i AS (SELECT *, grp % 2 AS item FROM pts), mem AS (SELECT item, grp AS pocket, id, x, y, z FROM i WHERE NOT lig AND score >= 0.25),
pk AS (SELECT grp % 2 AS item, grp AS pocket, row_number() OVER (PARTITION BY grp % 2 ORDER BY round(sum(score), 6) DESC, grp) AS rank, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts WHERE NOT lig GROUP BY grp),
tr AS (SELECT a.item, a.pocket, a.rank, min({_D2}) <= 0.64 AS is_true FROM pk a JOIN i b ON b.lig AND a.item = b.item GROUP BY ALL),
us AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item, is_true ORDER BY rank) AS n FROM tr) WHERE is_true OR n <= 2),
d AS (SELECT a.id, min({_D2}) AS d2 FROM i a JOIN i b ON b.lig AND NOT a.lig AND a.item = b.item GROUP BY a.id)
SELECT pocket, id, CASE WHEN d2 <= 1 THEN 1 ELSE 0 END AS near FROM mem JOIN us USING (item, pocket) JOIN d USING (id) WHERE d2 <= 1 OR (NOT is_true AND d2 > 6.25)""",
    "pts",
)
def y4_pockets(spark, d):
    from orrery.operators.windows import ranked
    from orrery.params import Params
    from orrery.plans import run

    p = pts(spark, d).withColumn("item", F.col("grp") % 2)
    points = p.where("not lig")
    found = points.groupBy("item", F.col("grp").alias("pocket")).agg(F.round(F.sum("score"), 6).alias("total"), *(F.avg(c).alias(c) for c in S.XYZ))
    members = points.where("score >= 0.25").select("item", F.col("grp").alias("pocket"), "id")
    kind = Params(positive_point_ligand_distance=1.0, neutral_points_margin=1.5, train_pockets=2)
    return run.pocket_labelled(points.select("item", "id", *S.XYZ), members, ranked(found, ["item"], "total", "pocket"), p.where("lig"), kind, cutoff=0.8).select("pocket", "id", "near")


@query("y7_residue_label_by_ligand", f"SELECT DISTINCT a.grp, true AS binding FROM pts a JOIN pts b ON NOT a.lig AND b.lig AND {_D2} <= 1", "pts")
def y7(spark, d):
    p = pts(spark, d)
    return S.shell(p.where("not lig"), p.where("lig"), 1.0).select("grp", F.lit(True).alias("binding")).distinct()


@query("y8_point_label_by_residue", "SELECT n.id, p.score >= 0.5 AS label FROM (" + _KNN % ("a.lig AND NOT b.lig", 1) + ") n JOIN pts p ON p.id = n.id_r", "pts")
def y8(spark, d):
    p = pts(spark, d)
    near = S.nearest(p.where("lig"), p.where("not lig"), 4.0)
    return near.join(p.select(F.col("id").alias("id_r"), (F.col("score") >= 0.5).alias("label")), "id_r").select("id", "label")


for _n, _sql, _f in (
    ("u1_union_distinct", "SELECT id FROM pts WHERE grp < 4 UNION SELECT id FROM pts WHERE lig", lambda a, b: a.union(b).distinct()),
    ("u2_intersection", "SELECT id FROM pts WHERE grp < 4 AND lig", lambda a, b: a.join(b, "id", "left_semi")),
    ("u3_except", "SELECT id FROM pts WHERE grp < 4 AND NOT lig", lambda a, b: a.join(b, "id", "left_anti")),
    ("u4_union_all", "SELECT id FROM pts WHERE grp < 4 UNION ALL SELECT id FROM pts WHERE lig", lambda a, b: a.union(b)),
):
    query(_n, _sql, "pts")(lambda spark, d, f=_f: f(pts(spark, d).where("grp < 4").select("id"), pts(spark, d).where("lig").select("id")))


@query("u5_distinct_groups", "SELECT DISTINCT grp, lig FROM pts", "pts")
def u5(spark, d):
    return pts(spark, d).select("grp", "lig").dropDuplicates()


@query(
    "u6_consolidate",
    """WITH o AS (SELECT grp, id, x, y, z, row_number() OVER (PARTITION BY grp ORDER BY id) AS n FROM pts),
s AS (SELECT DISTINCT grp, 0::BIGINT AS n, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[] AS kept FROM pts UNION ALL
  SELECT s.grp, o.n, CASE WHEN len(list_filter(kept, lambda k: (k.x-o.x)*(k.x-o.x)+(k.y-o.y)*(k.y-o.y)+(k.z-o.z)*(k.z-o.z) <= 16)) = 0
    THEN list_append(kept, {'id': o.id, 'x': o.x, 'y': o.y, 'z': o.z}) ELSE kept END FROM s JOIN o ON o.grp = s.grp AND o.n = s.n + 1),
last AS (SELECT grp, max(n) AS n FROM s GROUP BY grp)
SELECT grp, unnest(list_transform(kept, lambda k: k.id)) AS id FROM s JOIN last USING (grp, n)""",
    "pts",
)
def u6(spark, d):
    return S.thinned(pts(spark, d).select("grp", "id", *S.XYZ), "grp", 4.0).select("grp", "id")


# an icosahedron, and its triangles cut into four level by level
_SPHERES = """c AS (SELECT (1 + sqrt(5)) / 2 AS g), ab AS (SELECT a, b FROM c, (VALUES (-1.0::DOUBLE), (1.0::DOUBLE)) p(a), (SELECT unnest([-g, g]) AS b FROM c)),
v AS (SELECT row_number() OVER () AS i, x, y, z FROM (SELECT 0::DOUBLE AS x, a AS y, b AS z FROM ab UNION ALL SELECT a, b, 0 FROM ab UNION ALL SELECT b, 0, a FROM ab)),
e AS (SELECT a.i, b.i AS j FROM v a JOIN v b ON a.i < b.i AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 4.41),
u AS (SELECT i, [x / n, y / n, z / n] AS p FROM (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM v)),
tri AS (
  SELECT 1 AS level, a.p AS a, b.p AS b, c.p AS c FROM e e1 JOIN e e2 ON e2.i = e1.j JOIN e e3 ON e3.i = e1.i AND e3.j = e2.j JOIN u a ON a.i = e1.i JOIN u b ON b.i = e1.j JOIN u c ON c.i = e2.j
  UNION ALL
  SELECT level + 1, t[1], t[2], t[3] FROM (
    SELECT level, unnest([[a, ab, ac], [b, ab, bc], [c, bc, ac], [ab, bc, ac]]) AS t FROM (
      SELECT level, a, b, c, list_transform(sab, lambda q: q / sqrt(list_dot_product(sab, sab))) AS ab, list_transform(sbc, lambda q: q / sqrt(list_dot_product(sbc, sbc))) AS bc, list_transform(sac, lambda q: q / sqrt(list_dot_product(sac, sac))) AS ac FROM (
        SELECT level, a, b, c, [a[1] + b[1], a[2] + b[2], a[3] + b[3]] AS sab, [b[1] + c[1], b[2] + c[2], b[3] + c[3]] AS sbc, [a[1] + c[1], a[2] + c[2], a[3] + c[3]] AS sac FROM tri WHERE level < 3)))),
sph AS (SELECT level, any_value(p) AS p, count(*) AS w, sum(count(*)) OVER (PARTITION BY level) AS total FROM (SELECT level, unnest([a, b, c]) AS p FROM tri) GROUP BY level, round(p[1], 9) + 0.0, round(p[2], 9) + 0.0, round(p[3], 9) + 0.0)"""


@query(
    "y2_tessellated_surface",
    f"""WITH {_SPHERES},
atm AS (SELECT grp AS item, id AS serial, x * 4 AS x, y * 4 AS y, z * 4 AS z, CASE id % 3 WHEN 0 THEN 1.7 WHEN 1 THEN 1.55 ELSE 1.52 END + 1.6 AS r FROM pts),
pt AS (SELECT level, item, serial, x + r * p[1] AS x, y + r * p[2] AS y, z + r * p[3] AS z, w * 4 * pi() * r * r / total AS area FROM atm, sph),
op AS (SELECT * FROM pt a WHERE NOT EXISTS (SELECT 1 FROM atm b WHERE b.item = a.item AND b.serial <> a.serial AND {_D2} < b.r * b.r - 1e-9))
SELECT CAST(level AS BIGINT) AS level, item, serial, count(*) AS n, round(sum(area), 5) AS asa FROM op GROUP BY level, item, serial""",
    "pts",
)
def y2(spark, d):
    from functools import reduce

    from orrery.operators import surface

    element = F.element_at(F.array(*map(F.lit, "CNO")), (F.col("id") % 3 + 1).cast("int"))
    atoms = pts(spark, d).select(F.col("grp").alias("item"), F.col("id").alias("serial"), element.alias("element"), *((F.col(c) * 4).alias(c) for c in S.XYZ))
    levels = (surface.exposed_points(atoms, 1.6, n).withColumn("level", F.lit(n).cast("long")) for n in (1, 2, 3))
    return reduce(lambda a, b: a.unionByName(b), levels).groupBy("level", "item", "serial").agg(F.count("*").alias("n"), r6(F.sum("area"), 5).alias("asa"))


@query(
    "m7_grid_around",
    f"""WITH box AS (SELECT grp, {", ".join(f"min({c}) - 4 AS lo_{c}, (max({c}) + 4) - (min({c}) - 4) AS w_{c}" for c in "xyz")} FROM pts WHERE lig GROUP BY grp),
grid AS (SELECT grp, {", ".join(f"lo_{c} + (w_{c} - 2 * round_even(w_{c} / 2, 0)) + i{c} * 2 AS {c}" for c in "xyz")}
  FROM (SELECT *, unnest(range(CAST(floor(w_z / 2) AS BIGINT) + 1)) AS iz FROM (SELECT *, unnest(range(CAST(floor(w_y / 2) AS BIGINT) + 1)) AS iy FROM (SELECT *, unnest(range(CAST(floor(w_x / 2) AS BIGINT) + 1)) AS ix FROM box))))
SELECT grp, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM grid a WHERE EXISTS (SELECT 1 FROM pts b WHERE b.lig AND a.grp = b.grp AND {_D2} <= 16) AND NOT EXISTS (SELECT 1 FROM pts b WHERE NOT b.lig AND a.grp = b.grp AND {_D2} < 2.25)""",
    "pts",
)
def m7(spark, d):
    p = pts(spark, d)
    out = M.sampled_points("grid", p.where("lig"), p.where("not lig"), most=4.0, least=1.5, by="grp")
    return out.select("grp", *(r6(c, 5).alias(c) for c in S.XYZ))
