"""Commits and diffs: parsers of git's output as DataFrame operations, and a reader that runs git on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.storage import new_folder

LOG_FORMAT = "%H|%an|%at|%s"
PATCH_LIMIT = 10_000
PATCH_CUT = "\n... (truncated)"
WORKING = "WORKING"


def parse_log(lines: DataFrame) -> DataFrame:
    """(hash, author, ts, message) of lines (value) in ``LOG_FORMAT``; only the first three bars divide."""
    part = F.split("value", r"\|", 4)
    return lines.where(F.size(part) == 4).select(part[0].alias("hash"), part[1].alias("author"), F.timestamp_seconds(part[2].try_cast("long")).alias("ts"), part[3].alias("message"))


def parse_name_status(lines: DataFrame) -> DataFrame:
    """(path, old_path, status) of name-status lines (value)."""
    part = F.split("value", "\t")
    moved = F.substring(part[0], 1, 1).isin("R", "C")
    return lines.where(F.size(part) >= 2).select(
        F.when(moved & (F.size(part) > 2), F.try_element_at(part, F.lit(3))).otherwise(part[1]).alias("path"), F.when(moved, part[1]).alias("old_path"), paths.status_of_letter(part[0]).alias("status")
    )


def parse_numstat(lines: DataFrame) -> DataFrame:
    """(path, additions, deletions, status) of numstat lines (value); binary files count 0; the status is a guess."""
    part = F.split("value", "\t")
    added, gone = F.coalesce(part[0].try_cast("int"), F.lit(0)), F.coalesce(part[1].try_cast("int"), F.lit(0))
    return lines.where(F.size(part) >= 3).select(paths.renamed_to(part[2]).alias("path"), added.alias("additions"), gone.alias("deletions"), paths.status_of_counts(added, gone).alias("status"))


def split_patches(diffs: DataFrame) -> DataFrame:
    """(path, patch) of whole diffs (value), one row a file; patches over ``PATCH_LIMIT`` characters are cut and marked."""
    part = diffs.select(F.explode(F.split("value", r"(?m)^diff --git ")).alias("p")).where(F.trim("p") != "")
    path = F.regexp_extract("p", r"^a/.*? b/(.*?)\n", 1)
    body = F.concat(F.lit("diff --git "), F.col("p"))
    return part.select(path.alias("path"), F.when(F.length(body) > PATCH_LIMIT, F.concat(F.substring(body, 1, PATCH_LIMIT), F.lit(PATCH_CUT))).otherwise(body).alias("patch")).where("path <> ''")


def attach_patches(changes: DataFrame, patches: DataFrame) -> DataFrame:
    """Changes (path, ...) with their patch, empty where there is none."""
    one = patches.groupBy("path").agg(F.min("patch").alias("patch"))
    return changes.join(one, "path", "left").withColumn("patch", F.coalesce("patch", F.lit("")))


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout


def _lines(spark: SparkSession, output: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in output.splitlines() if x], "value string")


def list_commits(spark: SparkSession, repo: str, first: str | None = None, last: str = "HEAD") -> DataFrame:
    """Commits in ``first``..``last``, oldest first, with their order in ``n``."""
    span = f"{first}..{last}" if first else last
    parsed = parse_log(_lines(spark, _git(repo, "log", "--reverse", f"--format={LOG_FORMAT}", span)))
    return parsed.withColumn("n", F.row_number().over(W.orderBy("ts", "hash")))


def diff(spark: SparkSession, repo: str, first: str, last: str = WORKING) -> DataFrame:
    """Diff schema rows between two revisions, or between one and the working tree."""
    span = [first] if last == WORKING else [first, last]
    names = parse_name_status(_lines(spark, _git(repo, "diff", "--name-status", "-M", *span)))
    counts = parse_numstat(_lines(spark, _git(repo, "diff", "--numstat", "-M", *span))).drop("status")
    whole = spark.createDataFrame([(_git(repo, "diff", "-M", *span),)], "value string")
    return attach_patches(names.join(counts, "path", "left"), split_patches(whole))


def diff_commit(spark: SparkSession, repo: str, commit: str) -> DataFrame:
    """Diff rows of one commit, its status guessed from line counts."""
    counts = parse_numstat(_lines(spark, _git(repo, "show", "--numstat", "--format=", commit)))
    whole = spark.createDataFrame([(_git(repo, "show", "--format=", commit),)], "value string")
    return attach_patches(counts, split_patches(whole)).withColumn("hash", F.lit(commit))


def read_at(repo: str, commit: str, path: str) -> str:
    """A file as it was at a commit."""
    return _git(repo, "show", f"{commit}:{path}")


def commit_info(spark: SparkSession, repo: str, commit: str) -> DataFrame:
    """(hash, author, ts, message with body, files) of one commit."""
    head = _git(repo, "show", "-s", "--format=%H|%an|%at", commit).strip().split("|")
    body, files = _git(repo, "show", "-s", "--format=%B", commit).strip(), [x for x in _git(repo, "show", "--name-only", "--format=", commit).splitlines() if x]
    rows = spark.createDataFrame([(head[0], head[1], int(head[2]), body, files)], "hash string, author string, at long, message string, files array<string>")
    return rows.select("hash", "author", F.timestamp_seconds("at").alias("ts"), "message", "files")


def identity_of(repo: str) -> dict[str, str | None]:
    """Remote, branch and last commit of a working tree; empty outside of git or without git."""
    try:
        known = {"branch": _git(repo, "rev-parse", "--abbrev-ref", "HEAD").strip(), "commit": _git(repo, "rev-parse", "HEAD").strip()}
    except (subprocess.CalledProcessError, FileNotFoundError):
        return {}
    try:
        known["remote"] = _git(repo, "config", "--get", "remote.origin.url").strip() or None
    except subprocess.CalledProcessError:
        known["remote"] = None
    return known


#: versions of files that are read from git before they are written out
VERSIONS_AT_ONCE = 500


def file_versions(spark: SparkSession, repo: str, first: str | None = None, last: str = "HEAD") -> DataFrame:
    """(hash, author, message, ts, path, status, content) of every file that each commit of a range touched.

    git runs on the driver, commit by commit; what it says goes to the shared folder in runs of bounded number.
    """
    folder, held, written = new_folder(spark), [], False
    ddl = "hash string, author string, message string, at long, path string, status string, content binary"

    def flush() -> None:
        nonlocal written
        if held or not written:
            spark.createDataFrame(held, ddl).write.mode("append").parquet(folder)
            held.clear()
            written = True

    span = f"{first}..{last}" if first else last
    for line in _git(repo, "log", "--reverse", f"--format={LOG_FORMAT}", span).splitlines():
        commit, author, at, message = line.split("|", 3)
        for change in _git(repo, "show", "--name-status", "-M", "--format=", commit).splitlines():
            parts = change.split("\t")
            if len(parts) < 2:
                continue
            status = {"A": "added", "D": "deleted", "R": "renamed", "C": "added"}.get(parts[0][:1], "modified")
            content = None if status == "deleted" else subprocess.run(["git", "-C", repo, "show", f"{commit}:{parts[-1]}"], capture_output=True, check=True).stdout
            held.append((commit, author, message, int(at), parts[-1], status, content))
            if len(held) >= VERSIONS_AT_ONCE:
                flush()
    flush()
    return spark.read.schema(ddl).parquet(folder).withColumn("ts", F.timestamp_seconds("at")).drop("at")


def identity(repos: DataFrame) -> DataFrame:
    """Rows with a raw ``remote`` get remote_url and slug."""
    return repos.withColumns({"remote_url": paths.remote_url(F.col("remote")), "slug": paths.remote_slug(F.col("remote"))})
