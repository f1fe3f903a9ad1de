"""Sources: repositories, JSON lines, indexes and driver tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftmill.functions.text import glob_pattern

#: Endings of source files, the largest one that is read, and what names test files.
ENDINGS = (".py", ".java", ".js", ".ts", ".go", ".rs", ".cpp", ".c", ".hpp", ".h")
MOST_BYTES = 10 * 1024 * 1024
TEST_GLOBS = ("*/test/*", "*/tests/*", "*test_*.py", "*_test.py")


class _Folder(InputPartition):
    def __init__(self, root: str, paths: list[str]):
        super().__init__(0)
        self.root, self.paths = root, paths


class _RepoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.endings = tuple(options.get("endings", ",".join(ENDINGS)).split(","))
        self.most, self.each = int(options.get("most_bytes", MOST_BYTES)), int(options.get("files_a_task", 512))

    def partitions(self) -> list[InputPartition]:
        found = []
        for folder, inner, names in os.walk(self.root):
            inner[:] = sorted(d for d in inner if ".git" not in d and not os.path.islink(os.path.join(folder, d)))
            found += [p for p in (os.path.join(folder, n) for n in sorted(names)) if p.lower().endswith(self.endings) and not os.path.islink(p)]
        return [_Folder(self.root, found[k : k + self.each]) for k in range(0, len(found), self.each)] or [_Folder(self.root, [])]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for path in partition.paths:
            size = text = error = None
            try:
                size = os.path.getsize(path)
                if size > self.most:
                    continue
                with open(path, "rb") as f:
                    text = f.read().decode("utf-8", "ignore")
            except OSError as unread:
                error = f"{type(unread).__name__}: {unread.strerror}"
            inner = os.path.relpath(path, partition.root)
            repo, _, rest = inner.partition(os.sep)
            yield (repo if rest else "", rest or inner, text, size, error)


class RepoSource(DataSource):
    """Source files below a folder of repositories: ``repo, path, text, bytes, error``. Unlike Spark's file
    sources it lists names that begin with ``_``, such as ``__init__.py``. A file that cannot be read is a row
    without text, with the reason as ``error``. Options: path, endings, most_bytes, files_a_task. The folder
    must be mounted on all executors."""

    @classmethod
    def name(cls) -> str:
        return "siftmill_repos"

    def schema(self) -> str:
        return "repo string, path string, text string, bytes long, error string"

    def reader(self, schema) -> DataSourceReader:
        return _RepoReader(self.options)


def repositories(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(RepoSource)
    return spark.read.format("siftmill_repos").options(path=folder, **options).load()


def without_tests(files: DataFrame, globs: tuple[str, ...] = TEST_GLOBS) -> DataFrame:
    at = F.concat(F.lit("/"), "path")
    for glob in globs:
        files = files.filter(~at.rlike(glob_pattern(glob)))
    return files


def with_metadata(files: DataFrame) -> DataFrame:
    """file_name, file_type and category of files by their paths."""
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.regexp_extract(name, r"\.([^.]+)$", 1)
    kind = F.when(ending == "py", "text/x-python").when(ending == "java", "text/x-java").when(ending.isin("c", "h"), "text/x-c").when(ending == "js", "text/javascript").otherwise("text/plain")
    test = F.lit(False)
    for glob in TEST_GLOBS:
        test = test | F.concat(F.lit("/"), "path").rlike(glob_pattern(glob))
    return files.withColumns({"file_name": name, "file_type": kind, "category": F.when(test, "test").otherwise("implementation")})


INSTANCES = "instance_id string, repo string, base_commit string, problem_statement string, issue string, description string, prompt string, text string, patch string, edit_functions array<string>"
RESULTS = "instance_id string, found_files array<string>, found_modules array<string>, found_entities array<string>, raw_output_loc array<string>, metadata map<string,string>"
TRUTH = "instance_id string, repo string, base_commit string, problem_statement string, patch string, file_changes array<struct<file:string,changes:struct<edited_modules:array<string>,edited_entities:array<string>,added_modules:array<string>,added_entities:array<string>>>>"


def json_lines(spark: SparkSession, path: str, schema: str, first: int | None = None, order: str = "instance_id") -> DataFrame:
    """Rows of a JSON lines file by a fixed schema; the ``first`` ones by ``order`` if given."""
    found = spark.read.schema(schema).json(path)
    return found.orderBy(order).limit(first) if first else found


def instance(instances: DataFrame, instance_id: str) -> DataFrame:
    return instances.filter(F.col("instance_id") == instance_id).limit(1)


def ground_truth(truth: DataFrame, level: str) -> DataFrame:
    """``query_id, item`` at level file, module or function, from nested file changes."""
    each = truth.select(F.col("instance_id").alias("query_id"), F.explode("file_changes").alias("c"))
    if level == "file":
        return each.select("query_id", F.col("c.file").alias("item")).distinct()
    field = {"module": "edited_modules", "function": "edited_entities"}[level]
    return each.select("query_id", F.explode(F.col("c.changes")[field]).alias("item")).distinct()


def index(spark: SparkSession, folder: str, repo: str | None = None) -> DataFrame:
    """A written index; its partition of one repository if given."""
    found = spark.read.parquet(folder)
    return found.filter(F.col("repo") == repo) if repo else found


def spread(df: DataFrame, key: str, most_bytes: int = 1 << 30) -> DataFrame:
    """A small table in few files, dealt over all cores by ``key``: a file's row group is read by one
    task, and what follows until the next shuffle would run there too. Others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, key) if size <= most_bytes and len(df.inputFiles()) < cores else df
