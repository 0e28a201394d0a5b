"""Node ids and qualified names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "⋅"


def node_id(kind: Column, qualified: Column) -> Column:
    """``kind:qualified`` with slashes and dots as centred dots."""
    return F.concat(kind, F.lit(":"), F.translate(qualified, "/.", SEPARATOR * 2))


def is_resolved(target: Column) -> Column:
    """A target is an id exactly if it has a colon."""
    return target.contains(":")


def split_id(id_: Column) -> tuple[Column, Column]:
    """Table and key of an id, at the first colon."""
    at = F.instr(id_, ":")
    return F.when(at > 0, F.substring_index(id_, ":", 1)), F.when(at > 0, id_.substr(at + 1, F.length(id_))).otherwise(id_)


def package_of(qualified: Column) -> Column:
    """The part before the first dot, if that is not at the start; else null."""
    return F.when(F.instr(qualified, ".") > 1, F.substring_index(qualified, ".", 1))


def last_segment(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)


def suffix_of(qualified: Column) -> Column:
    """The last segment with its dot; a name without dots gets one in front."""
    return F.concat(F.lit("."), last_segment(qualified))


def dotted_prefixes(qualified: Column) -> Column:
    """All proper prefixes of a qualified name that end before a dot, shortest first."""
    parts = F.split(qualified, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def looks_like_test(path: Column, name: Column) -> Column:
    """A test by its file (``_test.``) or its name (Test..., Benchmark...)."""
    return F.coalesce(path.contains("_test."), F.lit(False)) | F.coalesce(name.startswith("Test") | name.startswith("Benchmark"), F.lit(False))


def capitalised(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))).otherwise(text)


def trim_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"'`]+|[\"'`]+$", "")
