"""String, file-name and formatting functions as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def part_before(c: Column, mark: str) -> Column:
    """What stands before the first mark; all of it without one."""
    return F.substring_index(c, mark, 1)


def part_between(c: Column, left: str, right: str) -> Column:
    """Between the first left and the last right mark; empty without both."""
    return F.regexp_extract(c, f"(?s){re.escape(left)}(.*){re.escape(right)}", 1)


def words(c: Column) -> Column:
    """Parts between white space, none of them empty."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def split_outside_brackets(c: Column) -> Column:
    """Split at commas that are not inside square brackets."""
    return F.transform(F.split(c, r",(?![^\[\]]*\])"), lambda x: F.trim(x))


def remove_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def remove_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.left(c, F.length(c) - len(suffix))).otherwise(c)


def digits_prefix(c: Column) -> Column:
    return F.regexp_extract(c, r"^([0-9]*)", 1)


def sorted_letters(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, ""), lambda x: x != "")), "")


def short_name(path: Column) -> Column:
    """File name without its folders."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def base_name(path: Column) -> Column:
    """File name without folders, compression suffix and extension."""
    plain = F.regexp_replace(short_name(path), r"\.(gz|zst|zstd|lzma)$", "")
    return F.regexp_replace(plain, r"\.[^.]*$", "")


def real_extension(path: Column) -> Column:
    """Extension below a compression suffix; empty without one."""
    return F.regexp_extract(F.regexp_replace(short_name(path), r"\.(gz|zst|zstd|lzma)$", ""), r"\.([^.]*)$", 1)


def is_compressed(path: Column) -> Column:
    return F.coalesce(path.rlike(r"\.(gz|zst|zstd|lzma)$"), F.lit(False))


def residue_id(c: Column) -> Column:
    """`A_T123B` -> (chain, aa, seq_num, ins_code); aa and ins_code null where absent; null for anything else."""
    pattern = r"^\s*([^_]+)_([^0-9_])?([0-9]+)([^_]?)[^_]*\s*$"
    part = lambda k: F.regexp_extract(c, pattern, k)
    none = lambda x: F.when(x != "", x)
    value = F.struct(part(1).alias("chain"), none(part(2)).alias("aa"), part(3).try_cast("int").alias("seq_num"), none(F.trim(part(4))).alias("ins_code"))
    return F.when(c.rlike(pattern), value)


def ligand_definition(c: Column) -> Column:
    """`NAME[spec:value]` -> (name, group_id, atom_id, contact_res_ids); a bare value is a group id."""
    spec = F.trim(F.when(c.contains("["), part_between(c, "[", "]")))
    kind, value = F.trim(part_before(spec, ":")), F.trim(F.substring_index(spec, ":", -1))
    typed = spec.contains(":")
    return F.struct(
        F.trim(part_before(c, "[")).alias("name"),
        F.when(typed & (kind == "group_id"), value).when(~typed, spec).alias("group_id"),
        F.when(typed & (kind == "atom_id"), value.try_cast("int")).alias("atom_id"),
        F.when(typed & (kind == "contact_res_ids"), F.transform(F.split(value, ","), lambda x: F.trim(x))).alias("contact_res_ids"),
    )


def score_text(c: Column) -> Column:
    return F.format_string("%.2f", c)


def probability_text(c: Column) -> Column:
    return F.format_string("%.3f", c)


def coordinate_text(c: Column) -> Column:
    return F.format_string("%.4f", c)


def percent_text(c: Column) -> Column:
    return F.format_string("%.1f %%", c * 100)


def list_head(c: Column, n: int) -> Column:
    """The first n values of a list."""
    return F.slice(c, 1, n)


def list_total(c: Column, factor: float = 1.0) -> Column:
    """The sum of a list's values, each times a factor, in their order."""
    return F.aggregate(F.transform(c, lambda v: v.cast("double") * factor), F.lit(0.0), lambda a, b: a + b)


def json_value(c: Column, path: str) -> Column:
    """A value in a JSON text, as text."""
    return F.get_json_object(c, path)


def id_list(ids: Column) -> Column:
    """An aggregate: the distinct ids of a group in order of their text, separated by spaces."""
    return F.array_join(F.array_sort(F.collect_set(ids.cast("string"))), " ")
