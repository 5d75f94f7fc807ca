"""Structure files as rows of atoms: fixed-width PDB, mmCIF and binary mmCIF, plain or compressed.

Files are read as text lines by Spark where a line is an atom (PDB), and whole where the
order of columns is declared in the file (mmCIF).
"""

from __future__ import annotations

import gzip
import lzma
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources import bcif

SCHEMA = (
    "item string, model int, serial int, name string, altloc string, res_name string, chain_id string, seq_num int, ins_code string,"
    " x double, y double, z double, occupancy float, bfactor float, element string, is_het boolean"
)
#: Residue names of water.
WATER = ("HOH", "WAT", "DOD", "H2O")
#: First column (from 1) and width of the fields of an atom line.
PDB_FIELDS = {
    "serial": (7, 5), "name": (13, 4), "altloc": (17, 1), "res_name": (18, 3), "chain_id": (22, 1), "seq_num": (23, 4), "ins_code": (27, 1),
    "x": (31, 8), "y": (39, 8), "z": (47, 8), "occupancy": (55, 6), "bfactor": (61, 6), "element": (77, 2),
}
_KINDS = {"serial": "int", "seq_num": "int", "x": "double", "y": "double", "z": "double", "occupancy": "float", "bfactor": "float"}


#: Hybrid-36: serial numbers from 100,000 on have a first letter, upper and then lower case, and digits to base 36.
_FIRST, _UPPER = 10 * 36**4, 26 * 36**4


def serial_field(serial: Column) -> Column:
    """A serial number as the five columns of its field hold it: decimal up to 99,999, then hybrid-36."""
    high = serial.cast("long") - 100_000
    upper = F.conv((high + _FIRST).cast("string"), 10, 36)
    lower = F.lower(F.conv((high - _UPPER + _FIRST).cast("string"), 10, 36))
    return F.when(high < 0, F.lpad(serial.cast("string"), 5, " ")).when(high < _UPPER, upper).otherwise(lower)


def serial_number(field: Column) -> Column:
    """The number in a serial field; null if there is none."""
    text = F.trim(field)
    base36 = F.conv(text, 36, 10).cast("long") - _FIRST + 100_000
    upper, lower = text.rlike("^[A-Z][0-9A-Z]{4}$"), text.rlike("^[a-z][0-9a-z]{4}$")
    return F.when(upper, base36).when(lower, base36 + _UPPER).otherwise(text.try_cast("long")).try_cast("int")


def aligned(line: Column) -> Column:
    """The line with its columns in place. Writers that print a serial number of more than five digits push
    what follows to the right: column 12 is blank in a sound line."""
    digits = F.regexp_extract(line, "^(?:ATOM  |HETATM)([0-9]{6,9})(?![0-9])", 1)
    return F.when(digits == "", line).otherwise(F.concat(F.substring(line, 1, 6), serial_field(digits.try_cast("long")), F.substr(line, F.length(digits) + 7)))


def aligned_line(line: str) -> str:
    """``aligned`` of one line."""
    m = re.match(r"(ATOM  |HETATM)([0-9]{6,9})(?![0-9])", line)
    if m is None:
        return line
    if (n := int(m[2]) - 100_000) < 0:
        return m[1] + f"{int(m[2]):5d}" + line[m.end() :]
    n, digits = (n, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") if n < _UPPER else (n - _UPPER, "0123456789abcdefghijklmnopqrstuvwxyz")
    n += _FIRST
    return m[1] + "".join(digits[n // 36**k % 36] for k in (4, 3, 2, 1, 0)) + line[m.end() :]


def serial_of(text: str) -> int:
    """``serial_number`` of one field."""
    if re.fullmatch("[A-Z][0-9A-Z]{4}|[a-z][0-9a-z]{4}", text):
        return int(text, 36) - _FIRST + 100_000 + (_UPPER if text[0].islower() else 0)
    return int(text)


def decompressed(name: str, raw: bytes) -> bytes:
    """By suffix: gz, zst, zstd, lzma or xz; others as they are."""
    if name.endswith(".gz"):
        return gzip.decompress(raw)
    if name.endswith((".zst", ".zstd")):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if name.endswith((".lzma", ".xz")):
        return lzma.decompress(raw)
    return raw


def pdb_atoms(lines: DataFrame) -> DataFrame:
    """Atoms of fixed-width lines (item, model, value); all eight columns of a coordinate count."""
    lines = lines.where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM")).withColumn("value", aligned(F.col("value")))
    cols = []
    for n, (start, width) in PDB_FIELDS.items():
        text = F.trim(F.substring("value", start, width))
        field = serial_number(text) if n == "serial" else text.try_cast(_KINDS[n]) if n in _KINDS else F.when(text != "", text)
        cols.append(field.alias(n))
    out = lines.select("item", "model", *cols, (F.substring("value", 1, 6) == "HETATM").alias("is_het"))
    # old files leave the element out: it is the first letter of the name then
    return out.withColumn("element", F.upper(F.coalesce("element", F.regexp_extract("name", "([A-Za-z])", 1))))


def _pdb_rows(text: str, item: str):
    model = 0
    for line in text.splitlines():
        if line.startswith("MODEL"):
            model = int(line[10:14].strip() or 1) - 1
        elif line.startswith(("ATOM  ", "HETATM")):
            yield item, model, aligned_line(line)


def _atom(item: str, v: dict) -> tuple:
    """Values of SCHEMA from the columns of a coordinate table."""
    get = lambda *keys: next((v[k] for k in keys if v.get(k) not in (None, "", ".", "?")), None)
    number = lambda x, kind: None if x is None else kind(x)
    return (
        item, int(get("pdbx_PDB_model_num") or 1) - 1, number(get("id"), int), get("auth_atom_id", "label_atom_id"), get("label_alt_id"), get("auth_comp_id", "label_comp_id"),
        get("auth_asym_id", "label_asym_id"), number(get("auth_seq_id", "label_seq_id"), int), get("pdbx_PDB_ins_code"), float(v["Cartn_x"]), float(v["Cartn_y"]), float(v["Cartn_z"]),
        number(get("occupancy"), float), number(get("B_iso_or_equiv"), float), (get("type_symbol") or "").upper() or None, v.get("group_PDB") == "HETATM",
    )


def _cif_rows(text: str, item: str):
    """Atoms of the _atom_site loop, as values of SCHEMA."""
    lines = iter(text.splitlines())
    names: list[str] = []
    for line in lines:
        s = line.strip()
        if s == "loop_":
            names = []
        elif s.startswith("_atom_site."):
            names.append(s.split(".", 1)[1].split()[0])
        elif names and s and not s.startswith(("#", "_")):
            yield _atom(item, dict(zip(names, _cif_values(s), strict=False)))
        elif names and s.startswith("#"):
            return


def _cif_values(line: str) -> list[str]:
    """Values of a loop row; a quote closes only before white space."""
    out, i, n = [], 0, len(line)
    while i < n:
        if line[i].isspace():
            i += 1
        elif line[i] in "'\"":
            q, j = line[i], i + 1
            while j < n and not (line[j] == q and (j + 1 == n or line[j + 1].isspace())):
                j += 1
            out.append(line[i + 1 : j])
            i = j + 1
        else:
            j = i
            while j < n and not line[j].isspace():
                j += 1
            out.append(line[i:j])
            i = j
    return out


def read_structures(spark: SparkSession, path: str, parts: int = 1) -> DataFrame:
    """Atoms of all structure files at a path or glob; .cif by its declared columns, .bcif by its arrays, anything else as PDB.

    A file is one item, named by the last ``parts`` of its path, and is parsed in one task. A file
    that can't be read gives no atoms; see ``read_errors``.
    """
    return parsed(spark.read.format("binaryFile").load(path), parts)


def parsed(files: DataFrame, parts: int = 1) -> DataFrame:
    """Atoms of files given as path and content."""
    import pandas as pd

    files = files.select("path", "content")

    def parse(batches):
        for pdf in batches:
            cif, pdb = [], []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                name = "/".join(p.split("/")[-parts:])
                try:
                    raw = decompressed(name, raw)
                    if ".bcif" in name:
                        cif += [_atom(name, v) for v in bcif.rows(raw)]
                        continue
                    text = raw.decode("utf-8", "replace")
                    if ".cif" in name:
                        cif += list(_cif_rows(text, name))
                    else:
                        pdb += list(_pdb_rows(text, name))
                except (ValueError, KeyError, OSError, EOFError):
                    continue
            columns = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pd.DataFrame([(*r, None) for r in cif] + [(i, m, *[None] * 14, v) for i, m, v in pdb], columns=[*columns, "value"])

    raw = files.mapInPandas(parse, SCHEMA + ", value string")
    return raw.where("value is null").drop("value").unionByName(pdb_atoms(raw.where("value is not null").select("item", "model", "value")).select(*raw.columns[:-1]))


def first_model(atoms: DataFrame) -> DataFrame:
    """The first model of each item."""
    least = atoms.groupBy("item").agg(F.min("model").alias("_m"))
    return atoms.join(least, "item").where(F.col("model") == F.col("_m")).drop("_m")


def reduced_to_chains(atoms: DataFrame, items: DataFrame) -> DataFrame:
    """Atoms of the chains that items (item, chains) name; null or `*` keeps all of an item's."""
    want = items.select("item", "chains")
    some = want.where(F.col("chains").isNotNull() & ~F.array_contains("chains", "*")).select("item", F.explode("chains").alias("chain_id"))
    whole = want.where(F.col("chains").isNull() | F.array_contains("chains", "*")).select("item")
    return atoms.join(some, ["item", "chain_id"], "left_semi").unionByName(atoms.join(whole, "item", "left_semi").select(*atoms.columns))


def heavy(atoms: DataFrame) -> DataFrame:
    """Atoms that are no hydrogen by element, first or second letter of the name."""
    h = (F.coalesce("element", F.lit("")) == "H") | F.col("name").startswith("H") | (F.substring("name", 2, 1) == "H")
    return atoms.where(~h)


def hetero(atoms: DataFrame) -> DataFrame:
    """HETATM rows but for water."""
    return atoms.where(F.col("is_het") & ~F.col("res_name").isin(*WATER))


def ligands(atoms: DataFrame, min_atoms: int = 5) -> DataFrame:
    """(item, chain_id, seq_num, ins_code, res_name, n_atoms, category): groups of hetero atoms; too few are small."""
    g = hetero(heavy(atoms)).groupBy("item", "chain_id", "seq_num", "ins_code", "res_name").agg(F.count("*").alias("n_atoms"))
    return g.withColumn("category", F.when(F.col("n_atoms") < min_atoms, "small").otherwise("relevant"))


def not_ignored(ligands: DataFrame, ignored: DataFrame, name: str = "res_name") -> DataFrame:
    """Ligands whose name is not in a list of names to ignore."""
    return ligands.join(ignored.select(name), name, "left_anti")


def ligand_category(small, distant, off_center):
    """The first that holds of small, distant and off_center, or else relevant."""
    return F.when(small, "small").when(distant, "distant").when(off_center, "off_center").otherwise("relevant")


def residues(atoms: DataFrame) -> DataFrame:
    """(item, chain_id, seq_num, ins_code, res_name, pos_in_chain) of residues in chain order."""
    from pyspark.sql.window import Window

    one = atoms.where(~F.col("is_het") | F.col("res_name").isin("MSE", "MEN")).groupBy("item", "chain_id", "seq_num", "ins_code", "res_name").agg(F.min("serial").alias("_s"))
    return one.withColumn("pos_in_chain", F.row_number().over(Window.partitionBy("item", "chain_id").orderBy("_s"))).drop("_s")


def surface_points(atoms: DataFrame, probe: float = 1.6, level: int = 2, apart: float = 0.05) -> DataFrame:
    """Solvent accessible points: (item, id, serial, x, y, z, area) of the heavy atoms' tessellated spheres;
    of points closer than ``apart`` the first stays."""
    from orrery.operators import surface
    from orrery.operators.spatial import thinned

    p = surface.exposed_points(heavy(atoms), probe, level)
    ids = F.col("serial").cast("long") * len(surface.sphere(level)) + F.col("n")
    return thinned(p.select("item", ids.alias("id"), "serial", "x", "y", "z", "area"), "item", apart)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the files that can't be read, so one bad item doesn't stop a run."""
    return errors(spark.read.format("binaryFile").load(path))


def errors(files: DataFrame) -> DataFrame:
    """The same of files given as path and content."""
    import pandas as pd

    def test(batches):
        for pdf in batches:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                name = p.rsplit("/", 1)[-1]
                try:
                    raw = decompressed(name, raw)
                    text = "" if ".bcif" in name else raw.decode("utf-8", "replace")
                    rows = bcif.rows(raw) if ".bcif" in name else _cif_rows(text, name) if ".cif" in name else _pdb_rows(text, name)
                    if next(iter(rows), None) is None:
                        out.append((p, "no atoms"))
                except (ValueError, KeyError, OSError, EOFError) as e:
                    out.append((p, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "error"])

    return files.select("path", "content").mapInPandas(test, "path string, error string")
