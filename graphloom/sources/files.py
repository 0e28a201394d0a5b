"""Source files of a repository as a DataFrame, and the nodes of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import ids, paths, text

MAX_FILE_KB = 10_000


def walk(spark: SparkSession, root: str, languages: list[str] | None = None, exclude: list[str] | None = None, max_file_kb: int = MAX_FILE_KB) -> DataFrame:
    """(path relative to ``root``, language, size, content) of the accepted files under ``root``.

    Version control, vendored and build folders, files of unknown language, larger than ``max_file_kb``, excluded
    or ignored by the top ignore file are left out.  The size is tested by the reader before contents are read.
    """
    root = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_file_kb * 1024)
    base = root.split("://")[-1].lstrip("/")
    relative = F.regexp_replace(F.col("path"), rf"^.*?{base.replace('.', chr(92) + '.')}/", "")
    ignored = _read_text(spark, f"{root}/.gitignore")
    rows = found.select(relative.alias("path"), F.col("length").alias("size"), "content")
    return accept(rows, languages, (exclude or []), paths.ignore_patterns(ignored), max_file_kb)


def _read_text(spark: SparkSession, path: str) -> str:
    """A small file by its path, which Spark's readers pass over if its name begins with a dot; empty if there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ""
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def accept(files: DataFrame, languages: list[str] | None = None, exclude: list[str] = (), ignored: list[str] = (), max_file_kb: int = MAX_FILE_KB) -> DataFrame:
    """The filters of ``walk`` on rows (path, size, ...), with the language added; ``go`` also admits gomod."""
    path = F.col("path")
    rows = files.where(~paths.is_pruned(path) & (F.col("size") <= max_file_kb * 1024)).withColumn("language", paths.language_of(path)).where("language is not null")
    if languages:
        wanted = [*languages, *(["gomod"] if "go" in languages else [])]
        rows = rows.where(F.col("language").isin(*wanted))
    for pattern in exclude:
        r = paths.glob_regex(pattern)
        rows = rows.where(~(path.rlike(r) | paths.base_name(path).rlike(r)))
    return rows.where(~paths.is_ignored(path, list(ignored))) if ignored else rows


def file_nodes(files: DataFrame, repo_slug: str) -> DataFrame:
    """A file node for each row (path, language, content), with content hash and lines; no Python runs."""
    body = F.decode("content", "utf-8")
    return files.select(
        ids.node_id(F.lit("file"), F.col("path")).alias("node_id"), F.lit("file").alias("label"), paths.base_name(F.col("path")).alias("name"), F.col("path").alias("qualified"),
        F.col("path").alias("file_path"), F.lit(repo_slug).alias("repo_slug"), "language", F.sha2("content", 256).alias("content_hash"), F.lit(1).alias("start_line"), text.count_lines(body).alias("end_line"),
    )


def go_mod_nodes(files: DataFrame, repo_slug: str) -> DataFrame:
    """Module nodes of go.mod files (path, content): the module itself and each requirement, its version as docstring.

    Of a module that several lines name the first counts.
    """
    lines = files.where(paths.base_name(F.col("path")) == "go.mod").select("path", F.posexplode(F.split(F.decode("content", "utf-8"), "\n")).alias("pos", "line"))
    clean = F.regexp_replace(F.regexp_replace("line", "//.*$", ""), r"^\s+|\s+$", "")
    own = F.regexp_extract(clean, r"^module\s+\"?([^\s\"]+)", 1)
    single = F.regexp_extract(clean, r"^require\s+([^\s(]+)\s+(v\S+)", 1)
    block = F.regexp_extract(clean, r"^([^\s()/]+[^\s()]*)\s+(v\S+)$", 1)
    version = F.regexp_extract(clean, r"\s(v\S+)$", 1)
    name = F.when(own != "", own).when(single != "", single).when(block != "", block)
    named = lines.select("path", "pos", name.alias("module"), F.when(own == "", version).alias("version")).where("module is not null and module <> 'require' and module not like 'replace%'")
    first = named.groupBy("module").agg(F.min_by(F.struct("path", "version"), F.struct("path", "pos")).alias("f"))
    return first.select(
        ids.node_id(F.lit("module"), F.col("module")).alias("node_id"), F.lit("module").alias("label"), F.substring_index("module", "/", -1).alias("name"), F.col("module").alias("qualified"),
        F.col("f.path").alias("file_path"), F.lit(repo_slug).alias("repo_slug"), F.lit("gomod").alias("language"), F.col("f.version").alias("docstring"),
    )
