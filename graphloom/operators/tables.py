"""Versioned tables of Parquet segments below a folder that all executors share.

A segment holds rows of one (repository, label).  A manifest names the segments of a version; it is created, never
overwritten, so of two writers that start from one version the second fails instead of undoing the first.  An append
writes new segments only; a replacement writes those of the (repository, label) pairs it touches.  Segments that none of
the last ``KEPT`` versions names are removed.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.storage import file_system

KEPT = 3
#: rows that a task writes, about: it sorts them by (repository, label)
ROWS_A_TASK = 200_000


class ConcurrentWrite(RuntimeError):
    """Another writer has made the version that this one was to make."""


class SegmentTable:
    def __init__(self, spark: SparkSession, path: str, ddl: str, by: tuple[str, str] = ("repo_slug", "label")) -> None:
        self.spark, self.path, self.ddl, self.by = spark, path.rstrip("/"), ddl, by

    # --- versions -------------------------------------------------------------------------------------------------

    def _manifests(self) -> list[str]:
        fs, at = file_system(self.spark, self.path)
        if not fs.exists(at):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(at)) if n.startswith("version-"))

    def _load(self, name: str) -> list[dict]:
        fs, at = file_system(self.spark, f"{self.path}/{name}")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _loaded(self, name: str) -> list[dict] | None:
        """The segments that a manifest names; None where it is not whole."""
        try:
            return self._load(name)
        except ValueError:
            return None

    def version(self) -> tuple[int, list[dict]]:
        """Number and segments (path, and the values of ``by``) of the newest whole version; -1 and none before the first."""
        for name in reversed(self._manifests()):
            found = self._loaded(name)
            if found is not None:
                return int(name.split("-")[1]), found
        return -1, []

    def _commit(self, base: int, segments: list[dict]) -> None:
        """A manifest is written beside and moved to its name when it is whole: a writer that dies before leaves no version."""
        fs, at = file_system(self.spark, f"{self.path}/version-{base + 1:08d}")
        _, beside = file_system(self.spark, f"{self.path}/.writing-{uuid.uuid4().hex}")
        stream = fs.create(beside, False)
        stream.write(bytearray(json.dumps(segments).encode()))
        stream.close()
        if fs.exists(at) and self._loaded(at.getName()) is None:  # left by a writer that died, and never a version
            fs.delete(at, False)
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        try:  # fails where the name is taken
            context.rename(beside, at, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(beside, False)
            raise ConcurrentWrite(f"version {base + 1} of {self.path} is there already") from e
        names = self._manifests()
        old, kept = names[:-KEPT], {s["path"] for name in names[-KEPT:] for s in self._loaded(name) or []}
        for name in old:
            for s in self._loaded(name) or []:
                if s["path"] not in kept:
                    fs.delete(file_system(self.spark, f"{self.path}/{s['path']}")[1], True)
            fs.delete(file_system(self.spark, f"{self.path}/{name}")[1], False)

    # --- reading --------------------------------------------------------------------------------------------------

    def read(self, repo: str | None = None, labels: list[str] | None = None) -> DataFrame:
        """Rows of the newest version; segments of other repositories and labels are not opened."""
        return self.rows_of([s for s in self.version()[1] if (repo is None or s["repo"] == repo) and (not labels or s["label"] in labels)])

    def rows_of(self, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.ddl)
        return schema.conform(self.spark.read.schema(self.ddl).parquet(*(f"{self.path}/{s['path']}" for s in segments)), self.ddl)

    # --- writing --------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, most: int) -> list[dict]:
        """New segments with the rows of ``df``, ``most`` at most; a large (repository, label) is spread over several files."""
        name = f"segment-{uuid.uuid4().hex}"
        names = list(dict.fromkeys(self.by))
        keys = [F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("-")).alias(f"__{c}") for c in names]
        rows = schema.conform(df, self.ddl).select("*", *keys)
        parts, by = -(-most // ROWS_A_TASK), [f"__{c}" for c in names]
        if parts > 1:  # shuffled rows are packed so well that those of a part of the usual size are too many to sort
            rows = rows.repartitionByRange(parts, *by, F.xxhash64(*(c for c, kind in rows.dtypes if "map<" not in kind)))
        else:
            rows = rows.hint("rebalance", *by)
        rows.write.partitionBy(*(f"__{c}" for c in names)).parquet(f"{self.path}/{name}")
        fs, at = file_system(self.spark, f"{self.path}/{name}")
        found = [([], name, at)]
        for _ in names:  # folders name=value, one level for each column
            found = [([*values, unquote(s.getPath().getName().split("=", 1)[1])], f"{path}/{s.getPath().getName()}", s.getPath())
                     for values, path, folder in found for s in fs.listStatus(folder) if s.isDirectory()]
        return [{"path": path, "repo": values[0], "label": values[-1]} for values, path, _ in found]

    def append(self, df: DataFrame, batch: str | None = None) -> None:
        """Rows beside those that are there; rows that came under the same name of a ``batch`` are replaced."""
        base, segments = self.version()
        kept = [s for s in segments if batch is None or s.get("batch") != batch]
        new = self._write(df, df.count())
        self._commit(base, kept + ([{**s, "batch": batch} for s in new] if batch is not None else new))

    def replace(self, df: DataFrame, pairs: list[tuple[str, str]], seen: int | None = None, new: int = 0) -> None:
        """``df`` in place of all rows of these (repository, label) pairs; ``seen`` is the version that ``df`` was made from.

        ``df`` has at most ``new`` rows more than the pairs had: their files' footers tell how many those are.
        """
        base, segments = self.version()
        if seen is not None and seen != base:
            raise ConcurrentWrite(f"{self.path} went from version {seen} to {base}")
        gone = set(pairs)
        kept, old = [s for s in segments if (s["repo"], s["label"]) not in gone], [s for s in segments if (s["repo"], s["label"]) in gone]
        most = new + (self.rows_of(old).count() if old else 0)
        self._commit(base, kept + self._write(df, most))

    def pairs_of(self, df: DataFrame) -> list[tuple[str, str]]:
        """The (repository, label) pairs of rows: as many as there are labels in a few repositories."""
        value = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("-"))
        return [tuple(r) for r in df.select(*(value(c).alias(c) for c in self.by)).distinct().collect()]

    def of_pairs(self, pairs: list[tuple[str, str]]) -> DataFrame:
        wanted = set(pairs)
        return self.rows_of([s for s in self.version()[1] if (s["repo"], s["label"]) in wanted])

    def repos(self) -> list[str]:
        return sorted({s["repo"] for s in self.version()[1]})
