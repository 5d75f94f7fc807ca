"""Queries over the evaluation of all items at once: ranks by every criterion, and all its figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans import evaluation as V
from orrery.plans.registry import pts, query, r6

XYZ = ("x", "y", "z")
_D2 = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"

# points of five items; each tenth is an atom of a ligand, of which those of the last item and of high groups don't count
_SQL = f"""i AS (SELECT *, id // 10 % 5 AS item, (id // 10 % 5) * 100 + grp AS of FROM pts),
la AS (SELECT item, of AS ligand, id, x, y, z FROM i WHERE lig AND item < 4 AND grp < 6),
lg AS (SELECT item, ligand, round(min(id) / 8, 6) AS center_dist, count(*) AS atoms, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM la GROUP BY ALL),
pp AS (SELECT item, of AS pocket, id FROM i WHERE NOT lig AND score >= 0.25),
pa AS (SELECT item, of AS pocket, id FROM i WHERE NOT lig AND score < 0.75),
pk AS (SELECT item, of AS pocket, row_number() OVER (PARTITION BY item ORDER BY round(sum(score), 6) DESC, of) AS rank, round(sum(score), 6) AS score, count(*) * 8 AS volume, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM i WHERE NOT lig GROUP BY item, of),
cov AS (SELECT DISTINCT a.item, b.ligand, a.id, a.score, a.score >= 0.5 AS predicted FROM i a JOIN la b ON a.item = b.item AND NOT a.lig AND {_D2} <= 6.25),
near AS (SELECT a.item, a.ligand, b.pocket, min({_D2}) AS dca2 FROM la a JOIN pk b ON a.item = b.item GROUP BY ALL),
mid AS (SELECT a.item, a.ligand, b.pocket, {_D2} AS dcc2 FROM lg a JOIN pk b ON a.item = b.item),
sh AS (SELECT item, ligand, pocket, count(*) AS shared FROM cov JOIN pp USING (item, id) GROUP BY ALL),
f AS (
  SELECT item, ligand, pocket, rank, dca2, dcc2, coalesce(shared, 0) AS shared, (SELECT count(*) FROM cov c WHERE c.ligand = near.ligand) AS nl, (SELECT count(*) FROM pp c WHERE c.pocket = near.pocket) AS np
  FROM near JOIN mid USING (item, ligand, pocket) JOIN pk USING (item, pocket) LEFT JOIN sh USING (item, ligand, pocket)),
cr AS (
  SELECT range - 1 AS k, 'dca' AS kind, range + 1 AS lim FROM range(1, 12) UNION ALL SELECT range + 10, 'dcc', range + 3 FROM range(1, 12) UNION ALL
  SELECT range + 21, 'dso', (8 - range) / 10 FROM range(1, 8) UNION ALL SELECT range + 28, 'dswo', (11 - range) / 10 FROM range(1, 11)),
ok AS (
  SELECT k, item, ligand, min(rank) AS rank FROM f, cr
  WHERE CASE kind WHEN 'dca' THEN dca2 <= lim * lim WHEN 'dcc' THEN dcc2 <= lim * lim WHEN 'dso' THEN shared > 0 AND shared / (nl + np - shared) >= lim
        ELSE shared > 0 AND shared / nl >= lim AND shared / np >= 0.2 END GROUP BY ALL),
rk AS (SELECT lg.item, lg.ligand, list(coalesce(ok.rank, -1) ORDER BY cr.k) AS ranks FROM lg CROSS JOIN cr LEFT JOIN ok ON ok.k = cr.k AND ok.ligand = lg.ligand GROUP BY ALL)"""


def predictions(spark: SparkSession, d: str) -> V.Predictions:
    p = pts(spark, d).withColumn("item", F.floor(F.col("id") / 10) % 5).withColumn("of", F.col("item") * 100 + F.col("grp"))
    atoms = p.where("not lig")
    pocket = F.col("of").alias("pocket")
    named = atoms.groupBy("item", pocket).agg(F.round(F.sum("score"), 6).alias("score"), (F.count("*") * 8).alias("volume"), *(F.avg(c).alias(c) for c in XYZ))
    from orrery.operators.windows import ranked

    pockets = ranked(named, ["item"], "score", "pocket").withColumn("new_rank", F.col("rank"))
    relevant = (F.col("item") < 4) & (F.col("grp") < 6)
    ligand_atoms = p.where(F.col("lig") & relevant).select("item", F.col("of").alias("ligand"), "id", *XYZ)
    ligands = ligand_atoms.groupBy("item", "ligand").agg(F.round(F.min("id") / 8, 6).alias("center_dist"))
    kind = F.when((F.col("item") == 4) | F.col("grp").isin(6, 7), "ignored").when(F.col("grp") == 8, "small").otherwise("distant")
    others = p.where(F.col("lig") & ~relevant).groupBy("item").agg(*(F.countDistinct(F.when(kind == k, F.col("of"))).alias(k) for k in ("ignored", "small", "distant")))
    proteins = atoms.groupBy("item").agg(F.count("*").alias("prot_atoms"), F.count_if(F.col("score") >= 0.2).alias("exposed_atoms")).join(others, "item", "left").fillna(0)
    residue = F.col("id") % 40
    score = F.when(F.col("item") != 2, (F.col("item") * 5 + residue * 7) % 11 / 8)
    return V.Predictions(
        proteins, ligands, ligand_atoms, pockets,
        surface=atoms.select("item", "id", *XYZ, "score", (F.col("score") >= 0.5).alias("predicted")),
        pocket_points=atoms.where("score >= 0.25").select("item", pocket, "id"),
        atoms=atoms.select("item", "id", residue.alias("residue"), score.alias("conservation"), *XYZ),
        pocket_atoms=atoms.where("score < 0.75").select("item", pocket, "id"),
    )


@query("j15_identified_by_criterion", f"WITH {_SQL} SELECT item, ligand, unnest(range(39)) AS criterion, unnest(ranks) AS rank FROM rk", "pts")
def j15_all(spark, d) -> DataFrame:
    p, criteria = predictions(spark, d), V.default_criteria()
    ranks = V.identification_ranks(p, criteria, V.pair_facts(p, criteria, V.covered_points(p)))
    long = ranks.select("item", "ligand", F.posexplode("ranks").alias("criterion", "rank"))
    return long.select("item", "ligand", *(F.col(c).cast("long").alias(c) for c in ("criterion", "rank")))


def _share(a: str, b: str) -> tuple[str, str]:
    both = f"count(*) FILTER ({a} AND {b})"
    return f"{both} / nullif(count(*) FILTER ({a}), 0)", f"{both} / nullif(count(*) FILTER ({a} OR {b}), 0)"


def _stats_sql() -> str:
    shares = ", ".join(f"{x} AS {k}_{n}" for n, a, b in (("0", "lig", "place <= n"), ("2", "lig", "place <= n + 2"), ("s", "hit", "taken")) for k, x in zip(("cov", "dso"), _share(a, b), strict=True))
    hit = lambda k, t: f"(ranks[{k + 1}] > 0 AND ranks[{k + 1}] <= n + {t})"
    rate = lambda k, t: f"(SELECT count(*) FILTER {hit(k, t)} / count(*) FROM l)"
    by_item = lambda k, t: f"(SELECT sum(CASE WHEN {hit(k, t)} THEN 1 / n ELSE 0 END) / (SELECT count(*) FROM p) FROM l)"
    of = lambda c, t, w="true": f"(SELECT coalesce(sum({c}), 0) / nullif(count(*), 0) FROM {t} WHERE {w})"
    total = lambda c: f"(SELECT sum({c}) FROM p)"
    true, false = "is_true", "NOT is_true"
    s = {
        "PROTEINS": "(SELECT count(*) FROM p)", "POCKETS": "(SELECT count(*) FROM k)", "LIGANDS": "(SELECT count(*) FROM l)",
        "LIGANDS_IGNORED": total("ignored"), "LIGANDS_SMALL": total("small"), "LIGANDS_DISTANT": total("distant"),
        "AVG_LIGAND_ATOMS": of("atoms", "l"), "AVG_PROT_ATOMS": of("prot_atoms", "p"), "AVG_PROT_EXPOSED_ATOMS": of("exposed_atoms", "p"), "AVG_PROT_SAS_POINTS": of("prot_atoms", "p"),
        "AVG_PROT_CONSERVATION": of("cons", "p"), "AVG_PROT_BINDING_CONSERVATION": of("cons_b", "p"), "AVG_PROT_NON_BINDING_CONSERVATION": of("cons_o", "p"),
        "AVG_LIG_CENTER_TO_PROT_DIST": of("center_dist", "l"), "AVG_LIG_CLOSTES_POCKET_DIST": of("closest", "l"),
        "LIGAND_COVERAGE": of("CASE WHEN predicted THEN 1 ELSE 0 END", "pt"), "AVG_LIG_POINT_SCORE": of("score", "pt"),
        **{f"AVG_{a}_{b}": of(f"{c}_{e}", "p", "n > 0") for a, c in (("DSO", "dso"), ("LIGCOV", "cov")) for b, e in (("TOPN0", "0"), ("TOPN2", "2"), ("SUCC", "s"))},
        **{f"AVG_LIG_{a}_POINT_SCORE": of(c, "l") for a, c in (("AVG", "mean"), ("MAX", "max"), ("AVG_MAX3", "top3"), ("AVG_MAXHALF", "top_half"))},
        "AVG_POCKETS": "(SELECT count(*) FROM k) / (SELECT count(*) FROM p)",
        **{f"AVG_POCKET_{a}{b}": of(c, "k", w) for a, c in (("SURF_ATOMS", "surf_atoms"), ("SAS_POINTS", "points"), ("VOLUME", "volume")) for b, w in (("", "true"), ("_TRUE_POCKETS", true))},
        "AVG_POCKET_CONSERVATION": of("conservation", "k"),
        **{f"AVG_{b}_POCKET_{a}": of(c, "k", w) for a, c in (("CONSERVATION", "conservation"), ("PRANK_RANK", "rank"), ("CONSERVATION_RANK", "conservation_rank"), ("COMBINED_RANK", "combined_rank")) for b, w in (("TRUE", true), ("FALSE", false))},
        **{f"DCA_4_{t}": rate(2, t) for t in (0, 1, 2, 4, 10, 99)}, **{f"DCA_4_{t}_NOMINAL": f"(SELECT count(*) FILTER {hit(2, t)} FROM l)" for t in (0, 1, 2, 4, 10)},
        **{f"DCA_4_{t}_PC": by_item(2, t) for t in (0, 2)}, **{f"DCC_{c}_{t}": rate(c + 7, t) for c in (5, 10, 12) for t in (0, 2)}, **{f"DCC_10_{t}_PC": by_item(17, t) for t in (0, 2)},
        **{f"{a}_{t}": rate(k, t) for a, k in (("DSOR_01", 28), ("DSWO_05", 34)) for t in (0, 2)},
    }
    s["OPT1"] = f"100 * {s['DCA_4_0']} + 100 * {s['DCA_4_2']} + 50 * {s['DCA_4_4']} + 10 * {s['AVG_LIGCOV_SUCC']} + 5 * {s['AVG_DSO_SUCC']}"
    s["OPT2"] = f"100 * {s['DCA_4_0_PC']} + 50 * {s['DCA_4_2_PC']} + 5 * {s['AVG_LIGCOV_SUCC']} + 3 * {s['AVG_DSO_SUCC']}"
    rows = " UNION ALL ".join(f"SELECT '{k}' AS name, {v} AS value" for k, v in s.items())
    return f"""WITH {_SQL},
n AS (SELECT item, count(*) AS n FROM lg GROUP BY item),
top AS (SELECT ligand, avg(score) AS mean, max(score) AS max, avg(CASE WHEN k <= 3 THEN score END) AS top3, avg(CASE WHEN k <= ceil(c / 2.0) THEN score END) AS top_half
  FROM (SELECT ligand, score, row_number() OVER (PARTITION BY ligand ORDER BY score DESC, id) AS k, count(*) OVER (PARTITION BY ligand) AS c FROM cov) GROUP BY 1),
l AS (SELECT lg.*, n, ranks, (SELECT sqrt(min(dca2)) FROM near WHERE near.ligand = lg.ligand) AS closest, mean, max, top3, top_half FROM lg JOIN n USING (item) JOIN rk USING (ligand) LEFT JOIN top USING (ligand)),
atm AS (SELECT item, id, id % 40 AS residue, CASE WHEN item <> 2 THEN (item * 5 + id % 40 * 7) % 11 / 8 END AS c, x, y, z FROM i WHERE NOT lig),
kc AS (SELECT pocket, avg(c) AS conservation FROM (SELECT DISTINCT pocket, residue, c FROM pa JOIN atm USING (item, id)) GROUP BY 1),
k0 AS (SELECT pk.*, EXISTS (SELECT 1 FROM near WHERE near.pocket = pk.pocket AND dca2 <= 16) AS is_true, (SELECT count(*) FROM pa WHERE pa.pocket = pk.pocket) AS surf_atoms, (SELECT count(*) FROM pp WHERE pp.pocket = pk.pocket) AS points,
  coalesce(conservation, 0) AS conservation FROM pk LEFT JOIN kc USING (pocket)),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY conservation DESC, rank DESC) AS conservation_rank, row_number() OVER (PARTITION BY item ORDER BY conservation * score DESC, rank DESC) AS combined_rank FROM k0),
pt AS (SELECT item, id, max(score) AS score, bool_or(predicted) AS predicted FROM cov GROUP BY ALL),
hits AS (SELECT item, ligand, ranks[3] AS rank FROM rk WHERE ranks[3] > 0),
marks AS (
  SELECT i.item, i.id, coalesce(n, 0) AS n, EXISTS (SELECT 1 FROM cov WHERE cov.id = i.id) AS lig, coalesce((SELECT min(rank) FROM pp JOIN pk USING (pocket) WHERE pp.id = i.id), 999999) AS place,
    EXISTS (SELECT 1 FROM cov JOIN hits USING (ligand) WHERE cov.id = i.id) AS hit, EXISTS (SELECT 1 FROM pp JOIN pk USING (pocket) JOIN hits ON hits.item = pk.item AND hits.rank = pk.rank WHERE pp.id = i.id) AS taken
  FROM i LEFT JOIN n USING (item) WHERE NOT i.lig),
sh2 AS (SELECT item, {shares} FROM marks GROUP BY item),
touch AS (SELECT a.item, a.id, a.residue, a.c, EXISTS (SELECT 1 FROM la b WHERE b.item = a.item AND {_D2} <= 16) AS b FROM atm a),
cs AS (SELECT item, coalesce(avg(c), 0) AS cons, coalesce(avg(c) FILTER (b), 0) AS cons_b, coalesce(avg(c) FILTER (o), 0) AS cons_o FROM (SELECT item, residue, max(c) AS c, bool_or(b) AS b, bool_or(NOT b) AS o FROM touch GROUP BY ALL) GROUP BY 1),
p AS (
  SELECT item, count(*) FILTER (NOT lig) AS prot_atoms, count(*) FILTER (NOT lig AND score >= 0.2) AS exposed_atoms, coalesce(any_value(n), 0) AS n,
    count(DISTINCT of) FILTER (lig AND (item = 4 OR grp IN (6, 7))) AS ignored, count(DISTINCT of) FILTER (lig AND item < 4 AND grp = 8) AS small, count(DISTINCT of) FILTER (lig AND item < 4 AND grp = 9) AS distant,
    any_value(sh2) AS s, any_value(cs) AS c FROM i LEFT JOIN n USING (item) LEFT JOIN sh2 USING (item) LEFT JOIN cs USING (item) GROUP BY item),
res AS ({rows})
SELECT name, round(value, 6) AS value FROM res""".replace("any_value(sh2) AS s, any_value(cs) AS c", ", ".join(f"any_value({c}) AS {c}" for c in ("cov_0", "cov_2", "cov_s", "dso_0", "dso_2", "dso_s", "cons", "cons_b", "cons_o")))


@query("a21_evaluation_all", _stats_sql(), "pts")
def a21_all(spark, d) -> DataFrame:
    return V.evaluation(predictions(spark, d)).select("name", r6("value").alias("value"))
