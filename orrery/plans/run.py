"""From structure files to ranked pockets: atoms, surface points, features, model, clusters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.api import Predictor
from orrery.functions import features as X
from orrery.functions.weights import weights
from orrery.operators import spatial as S
from orrery.operators.aggregate import pocket_scores, weighted_features
from orrery.operators.evaluate import rescored, with_decoys
from orrery.operators.transform import probability
from orrery.operators.windows import ranked
from orrery.params import Params
from orrery.plans import learn
from orrery.plans.predict import pocket_members
from orrery.session import cut
from orrery.sources import pockets as pocket_files
from orrery.sources import structures


def column_name(feature: str, column: str) -> str:
    """The name of a feature's column in a vector."""
    return f"{feature}_{column}"


def columns(enabled: list[str]) -> list[str]:
    """The columns of the enabled features, in order."""
    return [column_name(*c.split(".", 1)) for c in X.header(enabled)]


def atoms_of(spark: SparkSession, path: str) -> DataFrame:
    """Heavy atoms of the first model of each file, with an id that is unique over all files."""
    return numbered(structures.first_model(structures.heavy(structures.read_structures(spark, path))))


def numbered(rows: DataFrame, name: str = "id") -> DataFrame:
    """Rows with a number of their own, written down so that it stays."""
    return cut(rows.withColumn(name, F.monotonically_increasing_id()))


def protein(atoms: DataFrame) -> DataFrame:
    """Atoms of residues, with a residue key that is unique over all items."""
    key = F.concat_ws("_", "item", "chain_id", F.col("seq_num").cast("string"), F.coalesce("ins_code", F.lit("")))
    return atoms.where(~F.col("is_het") | F.col("res_name").isin(*X.CORRECTED)).withColumn("residue", key)


def surface(atoms: DataFrame, p: Params) -> DataFrame:
    """(item, id, x, y, z) of the points on the surface of proteins."""
    return numbered(structures.surface_points(atoms, p.solvent_radius).select("item", *S.XYZ))


def residues_of(atoms: DataFrame) -> DataFrame:
    """(id, residue, item, chain_id, seq_num, ins_code, res_name, letter, place) of the residues of protein
    atoms; id is the residue key, place that in the chain."""
    one = atoms.groupBy("residue").agg(*(F.min(c).alias(c) for c in ("item", "chain_id", "seq_num", "ins_code", "res_name")), F.min("serial").alias("_s"))
    place = F.row_number().over(Window.partitionBy("item", "chain_id").orderBy("_s", "residue"))
    return one.select(F.col("residue").alias("id"), "residue", "item", "chain_id", "seq_num", "ins_code", "res_name", X.one_letter(F.col("res_name")).alias("letter"), place.alias("place"))


class FeaturePlan:
    """The frames that the enabled features are computed on, each made once and only if one of them needs it.

    Features of atoms, adapted ones included, become columns of one frame of exposed atoms and reach the
    points by one weighted join. Features at the nearest residue or atom share one search.
    """

    def __init__(self, atoms: DataFrame, points: DataFrame, enabled: list[str], p: Params, tables: dict[str, DataFrame] | None = None):
        self.atoms, self.points, self.p, self.tables = atoms, points.select("item", "id", *S.XYZ), p, tables or {}
        self.asked = [(n, *X.resolved(n)) for n in enabled]
        X.header(enabled)
        self.exposed = cut(S.shell(atoms, points, p.sas_cutoff, "item"))

    def _needs(self, what: str) -> bool:
        return any(what in f.needs for _, f, _ in self.asked)

    @cached_property
    def residues(self) -> DataFrame:
        rows = residues_of(self.atoms)
        return cut(self._with_ss(rows) if self._needs("ss") else rows)

    @cached_property
    def areas(self) -> DataFrame:
        return cut(X.atom_areas(self.atoms, self.p.solvent_radius))

    def _with_ss(self, rows: DataFrame) -> DataFrame:
        if "ss" not in self.tables:
            raise ValueError("a feature needs the table ss: residue, ss")
        return rows.join(self.tables["ss"].select("residue", "ss"), "residue", "left").withColumn("ss", F.coalesce("ss", F.lit("C")))

    def _on_atoms(self, f: X.Feature, rows: DataFrame) -> DataFrame:
        if "asa" in f.needs:
            rows = rows.join(self.areas, ["item", "serial"])
        if "ss" in f.needs:
            rows = self._with_ss(rows)
        if "head" in f.needs:
            rows = rows.withColumn("head", F.col("name").isin(*X.BACKBONE))
        if "score" in f.needs:
            known = self.tables[f.name].select("residue", "score")
            rows = rows.join(known, "residue", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        return rows

    def values(self, f: X.Feature, points: DataFrame) -> DataFrame:
        """A feature's own values: (id, its columns), of points, exposed atoms or residues."""
        atoms, exposed = (self._on_atoms(f, a) for a in (self.atoms, self.exposed))
        given = {"points": points, "atoms": exposed if f.kind == "atom" else atoms, "exposed": exposed, "by": ["item", "chain_id"], "order": ["place"]}
        if "letters" in f.needs:
            given["residues"] = atoms.select("item", "residue", X.one_letter(F.col("res_name")).alias("letter"), *S.XYZ)
        elif f.kind == "residue":
            given["residues"] = self.residues
        given["rows"] = given["residues"] if f.kind == "residue" else given["atoms"]
        if f.name in self.tables:
            given |= {"table": self.tables[f.name], "scores": self.tables[f.name]}
        return f.compute(**given)

    def _named(self, name: str, f: X.Feature, values: DataFrame, key: str = "id") -> DataFrame:
        return values.select(F.col("id").alias(key), *(F.col(c).cast("double").alias(column_name(name, c)) for c in f.columns))

    def atom_columns(self) -> DataFrame | None:
        """The exposed atoms with the columns of all features asked for at atoms."""
        wide, any_ = self.exposed.select("item", "id", "residue", *S.XYZ), False
        for name, f, kind in self.asked:
            if kind == "atom":
                at = self.values(f, self.exposed.select("item", "id", *S.XYZ))
                wide = wide.join(self._named(name, f, at, "residue" if f.kind == "residue" else "id"), "residue" if f.kind == "residue" else "id", "left")
                any_ = True
        return wide.drop("residue").na.fill(0.0) if any_ else None

    def nearest_columns(self) -> DataFrame | None:
        """The points with the columns of all features asked for at their nearest residue or exposed atom."""
        wide = None
        for base, targets, key in (("residue", self.atoms, "residue"), ("atom", self.exposed, "id")):
            asked = [(n, f) for n, f, kind in self.asked if kind == "sas" and f.kind == base]
            if not asked:
                continue
            near = S.nearest(self.points, targets.select("item", "id", *S.XYZ), self.p.neighbourhood_radius, item="item")
            near = near.select("id", F.col("id_r").alias("_near"))
            if key == "residue":
                near = near.join(targets.select(F.col("id").alias("_near"), "residue"), "_near").select("id", F.col("residue").alias("_near"))
            near = cut(near)
            for name, f in asked:
                near = near.join(self._named(name, f, self.values(f, self.points), "_near"), "_near", "left")
            wide = near.drop("_near") if wide is None else wide.join(near.drop("_near"), "id")
        return wide

    def vectors(self) -> DataFrame:
        parts = []
        if (wide := self.atom_columns()) is not None:
            cols = [c for c in wide.columns if c not in ("item", "id", *S.XYZ)]
            around = weighted_features(self.points, wide, cols, self.p.neighbourhood_radius, weights()[self.p.weight_function])
            if "chem" in (n for n, _, _ in self.asked):
                # not a property of an atom, but how many there are
                around = around.withColumn(column_name("chem", "atoms"), F.col("n_atoms").cast("double"))
            parts.append(around.drop("n_atoms"))
        if (near := self.nearest_columns()) is not None:
            parts.append(near)
        parts += [self._named(n, f, self.values(f, self.points)) for n, f, kind in self.asked if kind == f.kind == "sas"]
        joined = reduce(lambda a, b: a.join(b, "id", "left"), parts, self.points)
        names = columns([n for n, _, _ in self.asked])
        return joined.select("item", "id", *S.XYZ, *names).na.fill(0.0, names)


def vectors(atoms: DataFrame, points: DataFrame, enabled: list[str], p: Params, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(item, id, x, y, z) of points with the columns of the enabled features; what a feature
    has no value for is 0.

    Features of atoms reach a point as their weighted sum over the exposed atoms around it; `<name>_sas` is the
    value of the nearest residue or atom, `<name>_atomic` a feature of residues or points at the atoms.
    tables: a frame for each feature that looks its values up, and `ss` (residue, ss) where one needs it.
    """
    return FeaturePlan(atoms, points, enabled, p, tables).vectors()


def labelled(points: DataFrame, ligand_atoms: DataFrame, p: Params) -> DataFrame:
    """Points with near: 1 up to the distance of positive points from a ligand, 0 beyond the
    neutral margin; those between are left out."""
    outer = p.positive_point_ligand_distance + p.neutral_points_margin
    d = S.near(points, ligand_atoms, [], outer).groupBy("id").agg(F.min("d2").alias("_d2"))
    near = F.when(F.col("_d2") <= p.positive_point_ligand_distance**2, 1).when(F.col("_d2").isNull(), 0)
    return points.join(d, "id", "left").withColumn("near", near).where("near is not null").drop("_d2")


def pocket_labelled(points: DataFrame, members: DataFrame, pockets: DataFrame, ligand_atoms: DataFrame, p: Params, cutoff: float = 4.0) -> DataFrame:
    """Points of pockets that another method has found, with near: 1 or 0, for training on the method's decoys.

    A pocket is true if an atom of a ligand lies within ``cutoff`` of its center; all true ones and the first
    train_pockets false ones (0: all) are used. Positive are points up to the distance of positives; negative
    those beyond the neutral margin, but only of false pockets. A point counts once for each pocket it is of.

    points: item, id, x, y, z and more. members: item, pocket, id. pockets: item, pocket, rank, x, y, z.
    """
    atoms = ligand_atoms.select("item", *S.XYZ)
    true = S.radius_join(pockets.select("item", "pocket", *S.XYZ), atoms, cutoff, "item").select("item", "pocket").distinct().withColumn("_true", F.lit(True))
    known = pockets.select("item", "pocket", "rank").join(true, ["item", "pocket"], "left").withColumn("_true", F.coalesce("_true", F.lit(False)))
    used = with_decoys(known.withColumn("_s", -F.col("rank")), ["item"], "_true", "_s", "pocket", p.train_pockets) if p.train_pockets else known
    outer = p.positive_point_ligand_distance + p.neutral_points_margin
    d = S.radius_join(points.select("item", "id", *S.XYZ), atoms, outer, "item").groupBy("item", "id").agg(F.min("d2").alias("_d2"))
    rows = members.join(used.select("item", "pocket", "_true"), ["item", "pocket"]).join(points, ["item", "id"]).join(d, ["item", "id"], "left")
    near = F.when(F.col("_d2") <= p.positive_point_ligand_distance**2, 1).when(~F.col("_true") & F.col("_d2").isNull(), 0)
    return rows.withColumn("near", near).where("near is not null").drop("_d2", "_true")


def paired(atoms: DataFrame, ligand_atoms: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The atoms without structures that have a pair (item, apo), and the ligand atoms in the apo structures'
    place: these are looked at without their ligands, and labelled by those of the structure they belong to."""
    at = pairs.select("item", F.col("apo").alias("_apo"))
    moved = ligand_atoms.join(at, "item", "left").withColumn("item", F.coalesce("_apo", "item")).drop("_apo")
    return atoms.join(pairs.select("item"), "item", "left_anti"), moved


def train(spark: SparkSession, path: str, enabled: list[str], p: Params | None = None, tables: dict[str, DataFrame] | None = None, pairs: DataFrame | None = None, **kind) -> Predictor:
    """A model of the structures at a path, whose ligands tell which points are positive. pairs: see ``paired``."""
    p = p or Params()
    atoms = atoms_of(spark, path)
    own = protein(atoms)
    ligands = structures.hetero(atoms).join(structures.ligands(atoms, p.min_ligand_atoms).where("category = 'relevant'").select("item", "chain_id", "seq_num", "res_name"), ["item", "chain_id", "seq_num", "res_name"], "left_semi")
    if pairs is not None:
        own, ligands = paired(own, ligands, pairs)
    points = surface(own, p)
    data = labelled(vectors(own, points, enabled, p, tables), ligands, p)
    return Predictor.train(cut(data), columns(enabled), "near", p, **kind)


@dataclass(frozen=True)
class Transforms:
    """Frames of one fit each: pockets (probability_fit's bins with the range of scores they span), and the same and
    mean and deviation of the scores of binding residues."""

    pockets: tuple[DataFrame, float, float, int] | None = None
    residues: tuple[DataFrame, float, float, int] | None = None
    residue_z: tuple[float, float] | None = None


@dataclass(frozen=True)
class Run:
    """What a prediction leaves: pockets, rows for ``sinks.predictions``; residues, rows for ``sinks.residues``;
    points with their score and that after pockets were scored."""

    pockets: DataFrame
    residues: DataFrame
    points: DataFrame


def _label(chain_first: bool = False):
    number = F.concat(F.col("seq_num").cast("string"), F.coalesce("ins_code", F.lit("")))
    return F.concat("chain_id", F.lit("_"), number) if chain_first else number


def residue_scores(own: DataFrame, points: DataFrame, p: Params) -> DataFrame:
    """(residue, score): over the points within reach of any of the residue's atoms, the sum of their
    transformed scores, of the best score_point_limit if that is set; without points 0."""
    near = S.radius_join(own.select("item", "residue", *S.XYZ), points.select("item", "id", *S.XYZ, "score"), p.sas_cutoff + p.residue_score_extra_dist, "item")
    one = near.groupBy("residue", "id_r").agg(F.max("score_r").alias("s"))
    if p.score_point_limit:
        best = F.row_number().over(Window.partitionBy("residue").orderBy(F.desc("s"), "id_r"))
        one = one.withColumn("_n", best).where(F.col("_n") <= p.score_point_limit)
    got = one.groupBy("residue").agg(F.sum(F.pow(F.greatest("s", F.lit(0.0)), F.lit(p.point_score_pow))).alias("score"))
    return own.select("residue").distinct().join(got, "residue", "left").select("residue", F.coalesce("score", F.lit(0.0)).alias("score"))


def _with_probability(df: DataFrame, fit: tuple[DataFrame, float, float, int] | None) -> DataFrame:
    return df.withColumn("probability", F.lit(None).cast("double")) if fit is None else probability(df, "score", *fit)


def predict_all(spark: SparkSession, path: str, model: Predictor, enabled: list[str], tables: dict[str, DataFrame] | None = None, fits: Transforms | None = None) -> Run:
    """Pockets, residues and points of all structures at a path.

    A file that can't be read has no row; ``structures.read_errors`` names it. The score of points in pockets is
    transformed when pockets are scored, and residues add up transforms of what the points have then.
    """
    p, fits = model.params, fits or Transforms()
    own = cut(protein(atoms_of(spark, path)))
    scored = cut(model.score(vectors(own, surface(own, p), enabled, p, tables)).select("item", "id", *S.XYZ, "score"))
    pockets = cut(model.pockets(scored))
    members = cut(pocket_members(scored, p).join(scored.select("id", *S.XYZ), "id"))
    close = S.radius_join(own.select("item", "serial", "residue", "chain_id", "seq_num", "ins_code", *S.XYZ), members.select("item", "component", *S.XYZ), p.pred_protein_surface_cutoff, "item")
    close = cut(close.select("item", F.col("component_r").alias("component"), "serial", "residue", _label(True).alias("label")).distinct())
    of = close.groupBy("item", "component").agg(F.collect_set("serial").alias("surf_atom_ids"), F.collect_set("label").alias("residue_ids"))
    none = F.array()
    out = _with_probability(pockets, fits.pockets).join(of, ["item", "component"], "left").select(
        "item", "name", "rank", "score", "probability", F.col("n_points").alias("sas_points"), *S.XYZ,
        F.coalesce("surf_atom_ids", none.cast("array<int>")).alias("surf_atom_ids"), F.coalesce("residue_ids", none.cast("array<string>")).alias("residue_ids"),
    )
    inside = members.select("id").distinct().withColumn("_in", F.lit(True))
    after = scored.join(inside, "id", "left").withColumn("score_after_pockets", F.when(F.col("_in"), F.pow(F.greatest("score", F.lit(0.0)), F.lit(p.point_score_pow))).otherwise(F.col("score"))).drop("_in")
    scores = residue_scores(own, after.select("item", "id", *S.XYZ, F.col("score_after_pockets").alias("score")), p)
    best = close.join(pockets.select("item", "component", "rank"), ["item", "component"]).groupBy("residue").agg(F.min("rank").alias("pocket"))
    rows = residues_of(own).join(scores, "residue").join(best, "residue", "left")
    mean, sd = fits.residue_z or (None, None)
    z = F.lit(None).cast("double") if mean is None else (F.col("score") - mean) / sd
    rows = _with_probability(rows.withColumn("zscore", z), fits.residues)
    residues = rows.select("item", F.col("chain_id").alias("chain"), _label().alias("residue_label"), F.col("res_name").alias("residue_name"), "score", "zscore", "probability", F.coalesce("pocket", F.lit(0)).alias("pocket"), "place")
    return Run(out, residues, after)


def predict(spark: SparkSession, path: str, model: Predictor, enabled: list[str], tables: dict[str, DataFrame] | None = None, fits: Transforms | None = None) -> DataFrame:
    """Rows for ``sinks.predictions``: the ranked pockets of all structures at a path, with
    their points, the atoms of the surface near them and the residues of these."""
    return predict_all(spark, path, model, enabled, tables, fits).pockets


def rescored_pockets(scored: DataFrame, members: DataFrame, pockets: DataFrame, p: Params) -> DataFrame:
    """Pockets with a new score, the sum of their points' transformed scores, and in its order: item, name, score,
    raw_score (mean of the points' scores), sas_points, old_rank, rank, change and bar. Without points the score is 0.

    scored: item, id, score. members: item, rank, id. pockets: item, name, rank.
    """
    on = ["item", "rank"]
    sums = pocket_scores(members.join(scored.select("item", "id", "score"), ["item", "id"]), on, power=p.point_score_pow)
    new = pockets.select("item", "name", "rank").join(sums, on, "left").select("item", "name", F.col("rank").alias("old_rank"), F.coalesce("pocket_score", F.lit(0.0)).alias("score"), F.col("mean_score").alias("raw_score"), F.coalesce("n", F.lit(0)).alias("sas_points"))
    return rescored(ranked(new, ["item"], "score", "old_rank"))


def rescore(spark: SparkSession, path: str, model: Predictor, enabled: list[str], pockets: DataFrame, pocket_atoms: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The pockets that another method has found in the structures at a path, in the order of a model.

    pockets: item, name, rank. pocket_atoms: item, rank, serial, the atoms that line a pocket. Its points are those of the
    surface within reach of these; only points of some pocket are looked at.
    """
    p = model.params
    own = cut(protein(atoms_of(spark, path)))
    points = surface(own, p)
    lining = pocket_atoms.join(own.select("item", "serial", *S.XYZ), ["item", "serial"])
    near = S.radius_join(points.select("item", "id", *S.XYZ), lining.select("item", "rank", *S.XYZ), p.sas_cutoff, "item")
    members = cut(near.select("item", F.col("rank_r").alias("rank"), "id").distinct())
    used = cut(points.join(members.select("id").distinct(), "id", "left_semi"))
    return rescored_pockets(model.score(vectors(own, used, enabled, p, tables)), members, pockets, p)


def rescore_fpocket(spark: SparkSession, path: str, results: str, model: Predictor, enabled: list[str], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """``rescore`` of results in folders `<structure>_out` below ``results``."""
    atoms = atoms_of(spark, path)
    vertices = pocket_files.fpocket_vertices(structures.read_structures(spark, f"{results}/*_out/*_out.*"))
    found = pocket_files.with_structure(pocket_files.fpocket_pockets(vertices), atoms)
    lining = pocket_files.fpocket_atoms(atoms, structures.read_structures(spark, f"{results}/*_out/pockets/*", parts=3))
    return rescore(spark, path, model, enabled, found, lining, tables)


def ablations(data: DataFrame, enabled: list[str], mode: str, label: str, id_col: str = "id", k: int = 5, seed: int = 42, **kind) -> DataFrame:
    """features, auc and auprc (means over k folds) of each set of features by ``learn.feature_subsets``, best first.

    data: the vectors of all enabled features. Sets without a feature are left out.
    """
    spark = data.sparkSession
    data = cut(data)
    found = []
    for names in learn.feature_subsets(enabled, mode):
        if names:
            m = learn.cross_validated(data, columns(names), label, id_col, k, seed, **kind).agg(F.avg("auc").alias("auc"), F.avg("auprc").alias("auprc")).first()
            found.append((" ".join(names), m.auc, m.auprc))
    return spark.createDataFrame(found, "features string, auc double, auprc double").orderBy(F.desc("auprc"), "features")
