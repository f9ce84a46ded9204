"""Source trees and version history as DataFrames."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from canopyql.functions import paths


def relative_to(root: str) -> Column:
    """The column path below root."""
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    plain = F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "")
    return F.substring(plain, F.lit(len(base) + 2), F.char_length("path"))


def read_tree(spark: SparkSession, root: str, extra_skips: list[str] | None = None, listed: DataFrame | None = None) -> DataFrame:
    """(path, lang, bytes, text, valid) of the indexed files below root, by Spark's own file reader.

    Exclusions and the size limit are checked on path and length before a content is decoded. listed: a
    table (path) that restricts the files, such as ``git_files``; listed paths without a file are absent
    here (``missing_files`` tells them). Bytes that are no UTF-8 become replacement signs, and the column
    valid says so (``unreadable`` lists such files).
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    x = raw.where(F.col("length") <= paths.MAX_BYTES).select(relative_to(root).alias("path"), F.col("length").alias("bytes"), "content")
    x = x.withColumn("lang", paths.language(F.col("path"))).where(F.col("lang").isNotNull() & ~paths.skipped(F.col("path"), extra_skips))
    if listed is not None:
        x = x.join(listed.select("path").distinct(), "path", "left_semi")
    return x.select("path", "lang", "bytes", *decoded(F.col("content")))


def decoded(content: Column) -> list[Column]:
    """text and valid: bytes as UTF-8, whether or not they are."""
    as_text = content.cast("string")
    return [F.make_valid_utf8(as_text).alias("text"), F.is_valid_utf8(as_text).alias("valid")]


def unreadable(files: DataFrame) -> DataFrame:
    """(path): files that hold bytes that are no UTF-8; they are indexed all the same."""
    return files.where(~F.col("valid")).select("path")


def missing_files(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Listed paths that are not there; reported, not fatal."""
    return listed.join(files.select("path"), "path", "left_anti")


def _git(root: str, *args: str) -> str:
    run = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
    return run.stdout if run.returncode == 0 else ""


def git_files(spark: SparkSession, root: str) -> DataFrame:
    """(path): tracked files, then untracked ones that are not ignored."""
    names = _git(root, "ls-files", "-z") + _git(root, "ls-files", "-z", "--others", "--exclude-standard")
    return spark.createDataFrame([(n,) for n in names.split("\0") if n], "path string")


def churn_of(history: DataFrame, commits: int = 800) -> DataFrame:
    """(path, churn) from history (number, path), one row for each path of a commit: in how many of the last commits a path appears."""
    last = history.select("number").distinct().orderBy(F.col("number").desc()).limit(commits)
    return history.distinct().join(F.broadcast(last), "number", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("churn"))


def history(spark: SparkSession, root: str) -> DataFrame:
    """(number, path) of all commits of a working tree, the first commit being 1, read by ranges of commits; see ``GitHistory``."""
    spark.dataSource.register(GitHistory)
    return spark.read.format("git_history").option("root", root).load()


def churn(spark: SparkSession, root: str, commits: int = 800) -> DataFrame:
    """(path, churn) of a working tree's last commits."""
    spark.conf.set(FILTERS, "true")
    last = _count(root)
    return churn_of(history(spark, root).where(F.col("number") > max(0, last - commits)), commits)


def tidy(path: Column) -> Column:
    """A path with forward slashes and without a leading ./"""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


def changed_of(names: DataFrame) -> DataFrame:
    """(path): the distinct tidy paths of names (path), empty ones left out."""
    return names.select(tidy(F.col("path")).alias("path")).where("path <> ''").distinct()


def changed_files(spark: SparkSession, root: str, revision: str | None = None, files: list[str] | None = None) -> DataFrame:
    """(path): what changed since the merge base with a revision, and the named files."""
    names = list(files or [])
    if revision:
        base = _git(root, "merge-base", revision, "HEAD").strip() or revision
        names += _git(root, "diff", "--name-only", base).split("\n")
    return changed_of(spark.createDataFrame([(n,) for n in names], "path string")).orderBy("path")


def head(root: str) -> str | None:
    """The commit that a working tree stands at."""
    return _git(root, "rev-parse", "HEAD").strip() or None


def distance(root: str, commit: str) -> tuple[int, int] | None:
    """How many commits the tree is ahead of a commit, and behind it; None where git can't say."""
    counts = _git(root, "rev-list", "--left-right", "--count", f"HEAD...{commit}").split()
    return (int(counts[0]), int(counts[1])) if len(counts) == 2 else None


#: The setting by which Spark offers filters to sources written in Python.
FILTERS = "spark.sql.python.filterPushdown.enabled"


def _count(root: str) -> int:
    return int(_git(root, "rev-list", "--count", "HEAD").strip() or 0)


class GitHistory(DataSource):
    """``spark.read.format("git_history").option("root", ...)``: a row for each path that a commit touches (merges have none).

    Commits are numbered from the first on and dealt by ranges of ``partsize`` commits; each range is read by
    git on an executor, so that no list of commits or paths comes to the driver. Comparisons of number choose the ranges,
    an equal path is tested while reading; Spark tests all filters again. The tree must be where executors can reach it.
    """

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return "number long, path string"

    def reader(self, schema) -> DataSourceReader:
        return _HistoryReader(self.options)


class _Commits(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _HistoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size = options["root"], int(options.get("partsize", "500"))
        self.low, self.high, self.path = 1, None, None

    def pushFilters(self, filters):
        for f in filters:
            column, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if column == "number" and isinstance(value, int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    high = value - isinstance(f, LessThan)
                    self.high = high if self.high is None else min(self.high, high)
            elif column == "path" and isinstance(f, EqualTo) and isinstance(value, str):
                self.path = value
            yield f

    def partitions(self) -> list[InputPartition]:
        last = _count(self.root)
        high = last if self.high is None else min(last, self.high)
        return [_Commits(a, min(a + self.size - 1, high)) for a in range(self.low, high + 1, self.size)] or [_Commits(1, 0)]

    def read(self, partition):
        if partition.high < partition.low:
            return
        # git counts from the last commit on; the path is tested here, as git would count other commits with it
        last = _count(self.root)
        command = ["git", "-C", self.root, "log", "--name-only", "-z", "--pretty=format:%x01", f"--skip={last - partition.high}", f"-n{partition.high - partition.low + 1}"]
        number = partition.high + 1
        with subprocess.Popen(command, stdout=subprocess.PIPE, text=True, errors="replace") as run:
            for piece in _pieces(run.stdout):
                for name in piece.split("\n"):
                    if name.startswith("\x01"):
                        number -= 1
                        name = name[1:]
                    if name and (self.path is None or name == self.path):
                        yield number, name


def _pieces(stream, size: int = 1 << 16):
    """What NULs separate in a stream of text, a piece at a time."""
    rest = ""
    while part := stream.read(size):
        *whole, rest = (rest + part).split("\0")
        yield from whole
    yield rest


class _Part(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class GitListing(DataSource):
    """``spark.read.format("git_listing").option("root", ...)``: the listing as a data source, dealt into parts."""

    @classmethod
    def name(cls) -> str:
        return "git_listing"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        root = self.options["root"]
        names = _git(root, "ls-files", "-z") + _git(root, "ls-files", "-z", "--others", "--exclude-standard")
        listed = [n for n in names.split("\0") if n]
        size = int(self.options.get("partsize", "10000"))
        return [_Part(listed[i : i + size]) for i in range(0, len(listed), size)] or [_Part([])]

    def read(self, partition):
        for n in partition.names:
            yield (n,)
