"""Paths, languages, ignore patterns and git notations, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {"go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}
FILE_NAMES = {"go.mod": "gomod"}
PRUNED = (".git", ".svn", ".hg", "node_modules", "vendor", ".tox", "__pycache__", ".mypy_cache", "dist", "build")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    name = base_name(path)
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1))


def _chosen(key: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def language_of(path: Column) -> Column:
    """Language by exact file name, then by lower-cased extension; null if unknown."""
    return F.coalesce(_chosen(base_name(path), FILE_NAMES), _chosen(F.lower(extension(path)), EXTENSIONS))


def language_in_history(path: Column) -> Column:
    """Language of a path in the commit history: by case-sensitive extension only; empty if unknown."""
    return F.coalesce(_chosen(extension(path), EXTENSIONS), F.lit(""))


def is_pruned(path: Column) -> Column:
    """Inside a folder that is never walked."""
    return F.exists(F.split(path, "/"), lambda part: part.isin(*PRUNED))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell pattern; ``*`` and ``?`` stop at slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def ignore_patterns(text: str) -> list[str]:
    """Patterns of an ignore file: no comments, blanks or negations, no trailing slash."""
    lines = (x.strip() for x in text.splitlines())
    return [x.rstrip("/") for x in lines if x and not x.startswith(("#", "!"))]


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Matches a pattern by its whole path, its base name, or lies in a folder of that name."""
    out = F.lit(False)
    for p in patterns:
        r = glob_regex(p)
        out = out | path.rlike(r) | base_name(path).rlike(r) | path.startswith(p.lstrip("/") + "/")
    return out


def renamed_to(path: Column) -> Column:
    """New path of the notations ``{old => new}/f`` and ``old => new``."""
    inner = F.regexp_replace(path, r"\{[^}]* => ([^}]*)\}", "$1")
    return F.regexp_replace(F.when(inner.contains(" => "), F.substring_index(inner, " => ", -1)).otherwise(inner), "//", "/")


def status_of_letter(letter: Column) -> Column:
    """Change kind of a name-status letter."""
    first = F.substring(letter, 1, 1)
    return F.when(first.isin("R", "C"), "renamed").when(first == "A", "added").when(first == "D", "deleted").otherwise("modified")


def status_of_counts(additions: Column, deletions: Column) -> Column:
    """Change kind guessed from line counts: only additions means added."""
    return F.when((additions > 0) & (deletions == 0), "added").otherwise("modified")


HUNK = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def hunks(patch: Column) -> Column:
    """New-side line ranges of a patch: array of (start, end); hunks without new lines give none."""
    starts = F.regexp_extract_all(patch, F.lit(HUNK), F.lit(1))
    counts = F.regexp_extract_all(patch, F.lit(HUNK), F.lit(2))
    both = F.transform(F.arrays_zip(starts.alias("s"), counts.alias("n")), lambda h: F.struct(
        h["s"].cast("int").alias("start"), F.when(h["n"] == "", F.lit(1)).otherwise(h["n"].try_cast("int")).alias("n")
    ))
    return F.transform(F.filter(both, lambda h: h["n"] > 0), lambda h: F.struct(h["start"], (h["start"] + h["n"] - 1).alias("end")))


def remote_url(raw: Column) -> Column:
    """Canonical form of a remote: https, without .git."""
    raw = F.trim(raw)
    ssh = F.regexp_replace(raw, r"^git@([^:]+):(.*?)(?:\.git)?$", "https://$1/$2")
    return F.when(raw.rlike(r"^git@[^:]+:"), ssh).otherwise(F.regexp_replace(raw, r"\.git$", ""))


def remote_slug(raw: Column) -> Column:
    """``owner/repo`` of a remote; empty if it has none."""
    raw = F.trim(raw)
    ssh = F.regexp_extract(raw, r"^git@[^:]+:([^/]+/.+?)(?:\.git)?$", 1)
    path = F.regexp_extract(raw, r"^[a-zA-Z][\w+.-]*://[^/]*/+([^/?#]+/[^/?#]+)", 1)
    return F.when(raw.startswith("git@"), ssh).otherwise(F.regexp_replace(path, r"\.git$", ""))
