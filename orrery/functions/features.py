"""Feature calculators and their registry.

A calculator belongs to a kind (atom, residue, sas), names its columns and turns frames
into a frame keyed by ``id``. Atom features reach points through the distance-weighted
aggregation; sas features are computed at the point. New ones are registered the same
way; a name that is taken is an error.

Frames with a column ``item`` hold several structures, and neighbours are looked for within
each; ids and residues are unique over all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators import spatial as S

#: The twenty amino acids, three-letter to one-letter.
AMINO_ACIDS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLU": "E", "GLN": "Q", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
#: The atoms of the backbone.
BACKBONE = ("N", "CA", "C", "O")
#: Modified residues read as standard ones.
CORRECTED = {"MSE": "MET", "MEN": "ASN"}


@dataclass(frozen=True)
class Feature:
    """needs: what the frames it is given must hold besides: `asa` and `score` (of the residue) on atoms,
    `head` (whether an atom is of the backbone), `ss` on atoms and residues, `letters` (atoms with their residue's letter in place of residues)."""

    name: str
    kind: str
    columns: tuple[str, ...]
    compute: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()


#: What a feature of one kind is turned into by a suffix to its name: residue and atom features at points by
#: the nearest residue or atom, residue and point features at atoms by the owning residue and the atom's own place.
ADAPTERS = {("residue", "_sas"): "sas", ("atom", "_sas"): "sas", ("residue", "_atomic"): "atom", ("sas", "_atomic"): "atom"}


_REGISTRY: dict[str, Feature] = {}


def register(feature: Feature) -> Feature:
    if feature.kind not in ("atom", "residue", "sas"):
        raise ValueError(f"unknown kind of feature: {feature.kind}")
    if feature.name in _REGISTRY:
        raise ValueError(f"feature {feature.name} is registered already")
    _REGISTRY[feature.name] = feature
    return feature


def feature(name: str) -> Feature:
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


def resolved(name: str) -> tuple[Feature, str]:
    """The feature of a name and the kind in which it is asked for, its own or that of the name's suffix."""
    if name in _REGISTRY:
        return _REGISTRY[name], _REGISTRY[name].kind
    for suffix in ("_sas", "_atomic"):
        f = _REGISTRY.get(name.removesuffix(suffix))
        if name.endswith(suffix) and f is not None:
            if (f.kind, suffix) not in ADAPTERS:
                raise ValueError(f"{f.name} is no feature that {suffix} turns into another")
            return f, ADAPTERS[f.kind, suffix]
    raise ValueError(f"unknown feature: {name}")


def header(enabled: list[str]) -> list[str]:
    """Columns `feature.sub` of the enabled features in order; residue features can't be enabled directly."""
    out = []
    for n in enabled:
        f, kind = resolved(n)
        if kind == "residue":
            raise ValueError(f"residue feature {n} needs a wrapper")
        out += [f"{n}.{c}" for c in f.columns]
    return out


def filtered(columns: list[str], filters: list[str]) -> list[str]:
    """Columns chosen by `*`, `name`, `prefix*` and their negation with `-`; later filters win.

    A list that begins with a negation begins from all columns.
    """
    if not filters:
        return list(columns)
    on = dict.fromkeys(columns, filters[0].startswith("-"))
    for f in filters:
        enable, f = not f.startswith("-"), f.removeprefix("-")
        for c in columns:
            if c == f or (f.endswith("*") and c.startswith(f[:-1])):
                on[c] = enable
    return [c for c in columns if on[c]]


def is_filtered(name: Column, filters: list[str]) -> Column:
    """Whether a column of names is chosen, as ``filtered`` tells."""
    on = F.lit(not filters or filters[0].startswith("-"))
    for f in filters:
        enable, f = not f.startswith("-"), f.removeprefix("-")
        on = F.when(name.startswith(f[:-1]) if f.endswith("*") else name == f, F.lit(enable)).otherwise(on)
    return on


def corrected_code(code: Column) -> Column:
    pairs = [F.lit(v) for kv in CORRECTED.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), code)


def one_letter(code: Column) -> Column:
    """One-letter code, `?` for what isn't a standard amino acid."""
    pairs = [F.lit(v) for kv in AMINO_ACIDS.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), corrected_code(code)), F.lit("?"))


def one_hot(value: Column, values: list, prefix: str) -> list[Column]:
    """A column of 0.0 and 1.0 per value; an unknown or null value gives zeros."""
    return [F.coalesce((value == v).cast("double"), F.lit(0.0)).alias(f"{prefix}{v}") for v in values]


def signed_power(value: Column, power: float, keep_sign: bool = True) -> Column:
    return F.signum(value) * F.abs(F.pow(value, F.lit(power))) if keep_sign else F.pow(value, F.lit(power))


def table_values(atoms: DataFrame, key: str, props: DataFrame, columns: list[str], power: float = 1.0, keep_sign: bool = True) -> DataFrame:
    """Look columns of a property table up by key; missing ones are 0.

    The table is joined as it is: the planner broadcasts it if its size allows.
    """
    x = atoms.join(props.select(F.col("key").alias(key), *columns), key, "left")
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return x.withColumns({c: signed_power(value(c), power, keep_sign) if power != 1.0 else value(c) for c in columns})


def neighbour_count(points: DataFrame, atoms: DataFrame, r: float, name: str) -> DataFrame:
    """Atoms within r of each point, 0 included."""
    n = S.near(points, atoms, [], r).groupBy("id").agg(F.count("*").alias(name))
    return points.select("id").join(n, "id", "left").na.fill(0, [name])


def protrusion_histogram(points: DataFrame, atoms: DataFrame, bins: int, r: float, least: float = 4.0, cumulative: bool = False, relative: bool = False) -> DataFrame:
    """Counts within radii from ``least`` to r, one join at r; differences between them unless cumulative.

    With ``relative`` all but the last bin are divided by the last one (by 1 if it is 0).
    """
    step = (r - least) / (bins - 1) if bins > 1 else 0.0
    radii = [r - step * (bins - 1 - i) for i in range(bins)]
    near = S.near(points, atoms, [], r)
    n = near.groupBy("id").agg(*(F.count_if(F.col("d2") <= q * q).cast("double").alias(f"c{i}") for i, q in enumerate(radii)))
    x = points.select("id").join(n, "id", "left").na.fill(0.0)
    value = [F.col(f"c{i}") if cumulative or i == 0 else F.col(f"c{i}") - F.col(f"c{i - 1}") for i in range(bins)]
    if relative:
        top = F.when(value[-1] == 0, 1.0).otherwise(value[-1])
        value = [v / top for v in value[:-1]] + value[-1:]
    return x.select("id", *(v.alias(f"b{i}") for i, v in enumerate(value)))


def center_distance(points: DataFrame, atoms: DataFrame, r: float) -> DataFrame:
    """Distance of each point to the centroid of the atoms within r (0 without any)."""
    c = S.near(points, atoms, [], r).groupBy("id").agg(*(F.avg(f"{a}_r").alias(f"{a}_r") for a in S.XYZ))
    x = points.select("id", *S.XYZ).join(c, "id", "left")
    return x.select("id", F.coalesce(F.sqrt(S.d2()), F.lit(0.0)).alias("pmass"))


#: Which of the nine nearest atoms form the four pyramids over a point.
PYRAMIDS = ((0, 1, 2), (3, 4, 5), (0, 2, 4), (6, 7, 8))


def pyramids(points: DataFrame, atoms: DataFrame, r: float) -> DataFrame:
    """For four pyramids over the nearest atoms: distance to the centroid and surface.

    The surface is half of what Heron's formula gives, as the definition has it.
    """
    near = S.knn(points, atoms, 9, r, item=S.shared_item(points, atoms))
    near = near.join(atoms.select(F.col("id").alias("id_r"), *S.XYZ), "id_r")
    at = near.groupBy("id").agg(*(F.max(F.when(F.col("rank") == k + 1, F.col(c))).alias(f"{c}{k}") for k in range(9) for c in S.XYZ))
    x = points.select("id", *S.XYZ).join(at, "id")
    dist = lambda a, b: F.sqrt(sum((F.col(f"{c}{a}") - F.col(f"{c}{b}")) * (F.col(f"{c}{a}") - F.col(f"{c}{b}")) for c in S.XYZ))

    def area(u: Column, v: Column, w: Column) -> Column:
        s = (u + v + w) / 2
        return F.sqrt(F.greatest(s * (s - u) * (s - v) * (s - w), F.lit(0.0))) * 0.5

    out = []
    for n, (i, j, k) in enumerate(PYRAMIDS, 1):
        center = [(F.col(c) + F.col(f"{c}{i}") + F.col(f"{c}{j}") + F.col(f"{c}{k}")) / 4 for c in S.XYZ]
        to = F.sqrt(sum((F.col(c) - m) * (F.col(c) - m) for c, m in zip(S.XYZ, center, strict=True)))
        ab, ac, ad, bc, bd, cd = dist("", i), dist("", j), dist("", k), dist(i, j), dist(i, k), dist(j, k)
        out += [to.alias(f"p{n}_dist"), (area(ab, ac, bc) + area(ab, ad, bd) + area(bc, bd, cd) + area(ac, ad, cd)).alias(f"p{n}_surface")]
    return x.select("id", *out)


def residue_cloud(points: DataFrame, atoms: DataFrame, r: float, score: str = "score", power: float = 1.0) -> DataFrame:
    """Over the distinct residues with an atom within r: mean, sum and sqrt(n) * sum of score ** power; none gives 0."""
    near = S.near(points, atoms, ["residue", score], r)
    one = near.groupBy("id", F.col("residue_r").alias("residue")).agg(F.max(f"{score}_r").alias("s"))
    v = F.pow("s", F.lit(power))
    got = one.groupBy("id").agg(F.avg(v).alias("mean"), F.sum(v).alias("sum"), (F.sqrt(F.count("*").cast("double")) * F.sum(v)).alias("vpa"))
    return points.select("id").join(got, "id", "left").na.fill(0.0)


def contacts(atoms: DataFrame, r: float = 3.3) -> DataFrame:
    """Per residue: other residues and atoms in contact, and residues in contact with its head and side atoms.

    atoms: id, residue, head (boolean), x, y, z.
    """
    item = S.shared_item(atoms)
    a = atoms.select("id", "residue", "head", *S.XYZ, *([item] if item else []))
    near = S.radius_join(a, a, r, item).where("residue <> residue_r")
    got = near.groupBy("residue").agg(
        F.countDistinct("residue_r").alias("residues"), F.countDistinct("id_r").alias("atoms"), F.countDistinct(F.when(F.col("head"), F.col("residue_r"))).alias("head"),
        F.countDistinct(F.when(~F.col("head"), F.col("residue_r"))).alias("side"),
    )
    return atoms.select("residue").distinct().join(got, "residue", "left").na.fill(0)


def motif_letters(motif: str) -> str:
    """`C2H2` -> `CCHH`."""
    import re

    return "".join(c * int(n or 1) for c, n in re.findall(r"([A-Z?])(\d*)", motif))


def has_motif(letters: Column, motif: str) -> Column:
    """Whether an array of letters holds the motif's letters, each as often."""
    need = motif_letters(motif)

    def held(w: str) -> Column:
        return F.size(F.filter(letters, lambda c: c == w))

    tests = [held(w) >= need.count(w) for w in sorted(set(need))]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def nearest_letters(points: DataFrame, residues: DataFrame, n: int, r: float) -> DataFrame:
    """Letters of the n residues nearest to each point (by their nearest atom, within r), in order."""
    top = S.nearest_within(points, residues, n, r, "residue", ("letter",), item=S.shared_item(points, residues))[0].select("id", F.col("rank").alias("k"), F.col("letter_r").alias("letter"))
    got = top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "letter"))), lambda s: s["letter"]).alias("letters"))
    return points.select("id").join(got, "id", "left").withColumn("letters", F.coalesce("letters", F.array().cast("array<string>")))


def propensity_product(first: Column, second: Column) -> Column:
    """Product of two propensities; one that is 0 is replaced by the other."""
    return F.when(first == 0, second * second).when(second == 0, first * first).otherwise(first * second)


def section_features(islands: DataFrame) -> DataFrame:
    """length, position, relative position and both from the nearer side of the section, of rows from ``islands``."""
    side = F.least(F.col("pos"), F.abs(F.col("length") - F.col("pos")) + 1)
    return islands.withColumns({"abs_side": side, "rel_side": 0.5 - F.abs(F.col("rel_pos") - 0.5)})


for _f in (
    Feature("xyz", "sas", S.XYZ, lambda points, **_: points.select("id", *S.XYZ)),
    Feature("bfactor", "atom", ("bfactor",), lambda atoms, **_: atoms.select("id", F.col("bfactor").cast("double").alias("bfactor"))),
    Feature("rtype", "residue", tuple(sorted(AMINO_ACIDS)), lambda residues, **_: residues.select("id", *one_hot(corrected_code(F.col("res_name")), sorted(AMINO_ACIDS), ""))),
    Feature("ares", "atom", tuple(sorted(AMINO_ACIDS)), lambda atoms, **_: atoms.select("id", *one_hot(corrected_code(F.col("res_name")), sorted(AMINO_ACIDS), ""))),
    Feature("exposed", "atom", ("exposed",), lambda atoms, exposed, **_: atoms.select("id").join(exposed.select("id", F.lit(1.0).alias("exposed")), "id", "left").na.fill(0.0)),
    Feature("exposed_dist", "sas", ("exposed_dist",), lambda points, exposed, **_: S.nearest(points, exposed, 6.0, item=S.shared_item(points, exposed)).select("id", F.sqrt("d2").alias("exposed_dist"))),
    Feature("protrusion", "sas", ("protrusion",), lambda points, atoms, radius=10.0, **_: neighbour_count(points, atoms, radius, "protrusion")),
    Feature("surface_protrusion", "sas", ("surface_protrusion",), lambda points, exposed, radius=10.0, **_: neighbour_count(points, exposed, radius, "surface_protrusion")),
    Feature("protr_hist", "sas", tuple(f"b{i}" for i in range(5)), lambda points, atoms, radius=10.0, **_: protrusion_histogram(points, atoms, 5, radius)),
    Feature("pmass", "sas", ("pmass",), lambda points, atoms, radius=11.0, **_: center_distance(points, atoms, radius)),
    Feature("pyramid", "sas", tuple(f"p{n}_{k}" for n in range(1, 5) for k in ("dist", "surface")), lambda points, exposed, **_: pyramids(points, exposed, 6.0)),
    Feature("conserv_cloud", "sas", ("mean",), lambda points, exposed, radius=10.0, **_: residue_cloud(points, exposed, radius).select("id", "mean"), ("score",)),
    Feature("conserv_cloud2", "sas", ("mean", "sum", "vpa"), lambda points, exposed, radius=10.0, power=1.0, **_: residue_cloud(points, exposed, radius, power=power), ("score",)),
    Feature("contactres", "residue", ("residues", "atoms", "head", "side"), lambda atoms, **_: contacts(atoms).withColumnRenamed("residue", "id"), ("head",)),
):
    register(_f)


def as_sas(name: str, points: DataFrame, atoms: DataFrame, values: DataFrame, r: float = 6.0) -> DataFrame:
    """An atom feature at points: the values of the nearest atom, as columns `name.column`."""
    f = _REGISTRY[name]
    near = S.nearest(points, atoms, r, item=S.shared_item(points, atoms)).select("id", F.col("id_r"))
    v = values.select(F.col("id").alias("id_r"), *(F.col(c).alias(f"{name}.{c}") for c in f.columns))
    return near.join(v, "id_r").drop("id_r")


def is_amino_acid(residues: DataFrame, by: list[str], order: list[str], name: str = "res_name", has_atoms: str = "has_amino_atoms") -> DataFrame:
    """amino_acid: by type, by a name beginning with UNK, or by its atoms and its neighbours.

    In the last case the residue before it may be missing, the one after it may not.
    """
    known = lambda c: corrected_code(c).isin(*AMINO_ACIDS)
    w = Window.partitionBy(*by).orderBy(*order)
    prev, nxt = F.lag(name).over(w), F.lead(name).over(w)
    by_place = F.col(has_atoms) & (prev.isNull() | known(prev)) & nxt.isNotNull() & known(nxt)
    return residues.withColumn("amino_acid", F.coalesce(known(F.col(name)) | F.col(name).startswith("UNK") | by_place, F.lit(False)))


def atom_areas(atoms: DataFrame, probe: float = 1.6, level: int = 3) -> DataFrame:
    """Solvent accessible area per heavy atom (item, serial, asa): that of its sphere's open points."""
    from orrery.operators import surface
    from orrery.sources.structures import heavy

    own = heavy(atoms)
    return surface.areas(own, surface.exposed_points(own, probe, level))


def area_near(points: DataFrame, atoms: DataFrame, r: float = 6.0, per_residue: bool = False) -> DataFrame:
    """Sum of asa over the atoms within r of each point, or over all atoms of the residues that have one there."""
    near = S.near(points, atoms, ["residue", "asa"], r)
    if per_residue:
        whole = atoms.groupBy(F.col("residue").alias("residue_r")).agg(F.sum("asa").alias("_a"))
        near = near.select("id", "residue_r").distinct().join(whole, "residue_r").withColumnRenamed("_a", "asa_r")
    got = near.groupBy("id").agg(F.sum("asa_r").alias("asa"))
    return points.select("id").join(got, "id", "left").na.fill(0.0)


#: The residue columns of the chemical feature, looked up in a property table.
CHEM_RESIDUE = (
    "hydrophobic", "hydrophilic", "hydrophatyIndex", "aliphatic", "aromatic", "sulfur", "hydroxyl", "basic", "acidic", "amide", "posCharge", "negCharge",
    "hBondDonor", "hBondAcceptor", "hBondDonorAcceptor", "polar", "ionizable", "atoms",
)
#: Its columns of single atoms.
CHEM_ATOM = ("atomDensity", "atomC", "atomO", "atomN", "hDonorAtoms", "hAcceptorAtoms")
#: Side chain atoms that give a hydrogen bond, and those that take one.
DONORS = {"ARG": "NE NH1 NH2", "ASN": "ND2", "GLN": "NE2", "HIS": "ND1 NE2", "LYS": "NZ", "SER": "OG", "THR": "OG1", "TRP": "NE1", "TYR": "OH"}
ACCEPTORS = {"ASN": "OD1", "ASP": "OD1 OD2", "GLN": "OE1", "GLU": "OE1 OE2", "HIS": "ND1 NE2", "SER": "OG", "THR": "OG1", "TYR": "OH"}
#: Columns of the pharmacophore table, and those used of the atom and residue tables.
VOLSITE = ("vsAromatic", "vsCation", "vsAnion", "vsHydrophobic", "vsAcceptor", "vsDonor")
ATOM_TABLE = ("apRawValids", "apRawInvalids", "atomicHydrophobicity")
RESIDUE_TABLE = ("aa5fact1", "aa5fact2", "aa5fact3", "aa5fact4", "aa5fact5")
#: Structural motifs looked for by default.
MOTIFS = ("C2H2", "C4", "C3H1", "E1H2", "C2H1", "H3", "D1H2", "C3", "D1H1", "E1H1", "C1H3", "C2", "H2")
#: Secondary structure types, and the simple type of each.
SS_TYPES = {"G": "H", "H": "H", "I": "H", "E": "E", "B": "E", "T": "C", "S": "C", "C": "C"}
SECTION = ("length", "pos", "rel_pos", "abs_side", "rel_side")


def chem(atoms: DataFrame, table: DataFrame) -> DataFrame:
    """Residue constants by three-letter code (table: key and CHEM_RESIDUE), element flags and bonds of the atom."""
    x = table_values(atoms.select("id", "res_name", "name", "element"), "res_name", table, list(CHEM_RESIDUE))
    first = F.when(F.col("element").isin("C", "O", "N"), F.col("element")).otherwise(F.substring("name", 1, 1))
    of = lambda named: F.concat_ws(".", "res_name", "name").isin([f"{r}.{a}" for r, names in named.items() for a in names.split()])
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return x.select(
        "id", *CHEM_RESIDUE, F.lit(1.0).alias("atomDensity"), *(flag(first == e).alias(f"atom{e}") for e in "CON"),
        flag(of(DONORS)).alias("hDonorAtoms"), flag(of(ACCEPTORS)).alias("hAcceptorAtoms"),
    )


def by_atom_name(atoms: DataFrame, table: DataFrame, columns: tuple[str, ...], power: float = 1.0, keep_sign: bool = True) -> DataFrame:
    """Columns of a table keyed by `RES.ATOM`."""
    x = atoms.select("id", F.concat_ws(".", "res_name", "name").alias("_key"))
    return table_values(x, "_key", table, list(columns), power, keep_sign).select("id", *columns)


def by_residue(rows: DataFrame, table: DataFrame, columns: tuple[str, ...], power: float = 1.0, keep_sign: bool = True) -> DataFrame:
    """Columns of a table keyed by the corrected three-letter code."""
    x = rows.select("id", corrected_code(F.col("res_name")).alias("_key"))
    return table_values(x, "_key", table, list(columns), power, keep_sign).select("id", *columns)


def residue_value(rows: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    """The score of each row's residue, 0 without one. scores: residue, score."""
    return rows.select("id", "residue").join(scores.select("residue", F.col("score").alias(name)), "residue", "left").select("id", F.coalesce(name, F.lit(0.0)).alias(name))


#: Points whose surroundings one task goes through.
PAIR_POINTS = 32


def pair_histogram(points: DataFrame, atoms: DataFrame, r: float, bins: int = 5, smooth: bool = False, normalised: bool = False) -> DataFrame:
    """Per point: histogram of the distances, 0 to 2 r, between the atoms within r of it, each pair once
    and each atom with itself; normalised: as shares of all pairs."""
    from orrery.functions.pairs import histogram_near

    item = S.shared_item(points, atoms)
    by = [item] if item else []
    own, probe, on = S.neighbourhoods(points.select("id", *S.XYZ, *by), atoms.select(*S.XYZ, *by), r, item, PAIR_POINTS)
    own, probe = (df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on))) for df in (own, probe))
    kind = points.schema["id"].dataType.simpleString()

    def counted(mine, around):
        return histogram_near(mine, around, float(r), bins, smooth, normalised)

    # few bytes are much work here, so tasks are not merged by size
    tasks = 16 * points.sparkSession.sparkContext.defaultParallelism
    own, probe = own.select(*on, "id", *S.XYZ).repartition(tasks, *on), probe.select(*on, *(f"{c}_r" for c in S.XYZ)).repartition(tasks, *on)
    got = own.groupBy(*on).cogroup(probe.groupBy(*on)).applyInPandas(counted, f"id {kind}, " + ", ".join(f"b{i} double" for i in range(bins)))
    return points.select("id").join(got, "id", "left").na.fill(0.0)


def ss_features(residues: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Place in the section of equal secondary structure, and the type as flags. residues: id, ss."""
    from orrery.operators.windows import islands

    x = section_features(islands(residues, by, order, "ss"))
    return x.select("id", *(F.col(c).cast("double").alias(c) for c in SECTION), *one_hot(F.col("ss"), list(SS_TYPES), "type_"))


def simple_ss(ss: Column) -> Column:
    """H, E or C of a secondary structure type."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in SS_TYPES.items() for v in kv]), ss), F.lit("C"))


def ss_cloud(points: DataFrame, atoms: DataFrame, r: float) -> DataFrame:
    """Shares of the simple types among the atoms within r. atoms: ss."""
    near = S.near(points, atoms, ["ss"], r)
    got = near.groupBy("id").agg(*(F.avg((simple_ss(F.col("ss_r")) == t).cast("double")).alias(t) for t in "HEC"))
    return points.select("id").join(got, "id", "left").na.fill(0.0)


def pair_propensity(residues: DataFrame, table: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Product of the propensities of a residue's two pairs. table: key, propensity."""
    from orrery.operators.windows import duplets

    x = table_values(duplets(residues, by, order, "letter").select("id", "duplet"), "duplet", table, ["propensity"])
    two = x.groupBy("id").agg(F.min("propensity").alias("a"), F.max("propensity").alias("b"))
    return two.select("id", propensity_product(F.col("a"), F.col("b")).alias("duplets"))


def triplet_propensity(residues: DataFrame, table: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The propensity of a residue with both neighbours. table: key, propensity."""
    from orrery.operators.windows import triplets

    x = triplets(residues, by, order, "letter").select("id", "triplet")
    return table_values(x, "triplet", table, ["propensity"]).select("id", F.col("propensity").alias("triplets"))


def motif_flags(points: DataFrame, residues: DataFrame, n: int = 8, r: float = 4.0, motifs: tuple[str, ...] = MOTIFS) -> DataFrame:
    """Whether the letters of the residues near a point hold each motif."""
    x = nearest_letters(points, residues, n, r)
    return x.select("id", *(has_motif(F.col("letters"), m).cast("double").alias(m) for m in motifs))


def nearest_code(points: DataFrame, atoms: DataFrame) -> DataFrame:
    """The type of the residue nearest to each point, as flags."""
    near = S.nearest(points, atoms, 6.0, item=S.shared_item(points, atoms)).join(atoms.select(F.col("id").alias("id_r"), "res_name"), "id_r")
    return near.select("id", *one_hot(corrected_code(F.col("res_name")), sorted(AMINO_ACIDS), ""))


def index_feature(name: str, columns: tuple[str, ...], kind: str = "atom") -> Feature:
    """A feature of an amino acid index table with the given columns."""
    return Feature(name, kind, columns, lambda rows, table, power=1.0, **_: by_residue(rows, table, columns, power))


def csv_feature(name: str, kind: str, columns: tuple[str, ...]) -> Feature:
    """A feature of a file read by ``sources.tables.csv_features``."""
    from orrery.sources.tables import with_csv_features

    return Feature(name, kind, columns, lambda rows, table, missing=0.0, **_: with_csv_features(rows, kind, table, missing).select("id", *columns))


for _f in (
    Feature("chem", "atom", CHEM_RESIDUE + CHEM_ATOM, lambda atoms, table, **_: chem(atoms, table)),
    Feature("volsite", "atom", VOLSITE, lambda atoms, table, **_: by_atom_name(atoms, table, VOLSITE)),
    Feature("atom_table", "atom", ATOM_TABLE, lambda atoms, table, power=1.0, keep_sign=True, **_: by_atom_name(atoms, table, ATOM_TABLE, power, keep_sign)),
    Feature("residue_table", "residue", RESIDUE_TABLE, lambda residues, table, power=1.0, keep_sign=True, **_: by_residue(residues, table, RESIDUE_TABLE, power, keep_sign)),
    Feature("conservation", "atom", ("conservation",), lambda atoms, scores, **_: residue_value(atoms, scores, "conservation")),
    Feature("conserv", "residue", ("conserv",), lambda residues, scores, **_: residue_value(residues, scores, "conserv")),
    Feature("conservationcloud", "sas", ("mean",), lambda points, atoms, radius=10.0, **_: residue_cloud(points, atoms, radius).select("id", "mean"), ("score",)),
    Feature("pair_hist", "sas", tuple(f"b{i}" for i in range(5)), lambda points, exposed, radius=6.0, smooth=False, normalised=False, **_: pair_histogram(points, exposed, radius, 5, smooth, normalised)),
    Feature("asa", "sas", ("asa",), lambda points, atoms, radius=6.0, **_: area_near(points, atoms, radius), ("asa",)),
    Feature("asa2", "sas", ("asa",), lambda points, exposed, radius=6.0, **_: area_near(points, exposed, radius), ("asa",)),
    Feature("asares", "sas", ("asa",), lambda points, atoms, radius=6.0, **_: area_near(points, atoms, radius, per_residue=True), ("asa",)),
    Feature("cres1", "sas", tuple(sorted(AMINO_ACIDS)), lambda points, atoms, **_: nearest_code(points, atoms)),
    Feature("ss", "residue", (*SECTION, *(f"type_{t}" for t in SS_TYPES)), lambda residues, by, order, **_: ss_features(residues, by, order), ("ss",)),
    Feature("sss", "residue", ("H", "E", "C"), lambda residues, **_: residues.select("id", *one_hot(simple_ss(F.col("ss")), ["H", "E", "C"], "")), ("ss",)),
    Feature("ss_cloud", "sas", ("H", "E", "C"), lambda points, atoms, radius=10.0, **_: ss_cloud(points, atoms, radius), ("ss",)),
    Feature("duplets", "residue", ("duplets",), lambda residues, table, by, order, **_: pair_propensity(residues, table, by, order)),
    Feature("triplets", "residue", ("triplets",), lambda residues, table, by, order, **_: triplet_propensity(residues, table, by, order)),
    Feature("stmotif", "sas", MOTIFS, lambda points, residues, n=8, radius=4.0, **_: motif_flags(points, residues, n, radius), ("letters",)),
):
    register(_f)
