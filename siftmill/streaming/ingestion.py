"""An index of files' blocks that follows its files: batches of new, edited and deleted files.

The index is a Parquet folder partitioned by repository and bucket (a hash of the path), so that a large
repository is many partitions. It holds a row per file (``block_no`` null) and a row per block. A batch

1. takes of each path the latest row, and leaves out those whose content is what the index has;
2. cuts the files that changed; a block whose text the file had before keeps its ``since`` and its vector,
   so only new blocks are encoded;
3. overwrites the partitions that hold changed files, and no others, by dynamic partition overwrite.

A deleted file stays as a row without content: it makes batches of an earlier version void, and a partition
that is emptied is written like any other. To run a batch again changes nothing, be it after a failure: what
it has written by then no longer differs.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.text import space_tokens
from siftmill.operators import chunking
from siftmill.operators.retrieval import embed
from siftmill.operators.scratch import kept

SCHEMA = "repo string, path string, content_id string, version long, block_no long, start long, end long, tokens long, block_id string, since long, content string, vector array<float>, repo_key string, bucket int"
PARTITIONS = ["repo_key", "bucket"]
FILE = [*PARTITIONS, "path"]
#: Up to so many partitions a batch names those it reads; beyond, it finds them by a join alone.
MOST_NAMED = 2000

log = logging.getLogger(__name__)


def read(spark: SparkSession, index: str) -> DataFrame:
    """All rows of an index; none where it was never written."""
    try:
        return spark.read.schema(SCHEMA).parquet(index)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def blocks(spark: SparkSession, index: str) -> DataFrame:
    """The blocks of the files as they are now."""
    return read(spark, index).filter("block_no IS NOT NULL")


def _keyed(batch: DataFrame, buckets: int) -> DataFrame:
    """The latest row of each path: by ``modified`` if there is such a column, then by content."""
    deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in batch.columns else F.lit(False)
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    rows = batch.select(
        F.col("repo").cast("string").alias("repo"),
        path.alias("path"),
        # Never empty, as an empty name of a folder would be read back as null.
        F.coalesce(F.concat(F.lit("repo-"), F.col("repo").cast("string")), F.lit("none")).alias("repo_key"),
        F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int").alias("bucket"),
        F.when(~deleted, F.coalesce("text", F.lit(""))).alias("text"),
        (F.col("modified") if "modified" in batch.columns else F.lit(0)).alias("_modified"),
    ).withColumn("content_id", F.sha2("text", 256))
    last = F.max_by(F.struct("repo", "text", "content_id"), F.struct("_modified", F.coalesce("content_id", F.lit("")))).alias("last")
    return rows.groupBy(*FILE).agg(last).select(*FILE, "last.*")


def _named(rows: DataFrame, partitions: DataFrame) -> DataFrame:
    """The rows of some partitions, of which alone files are listed and read where they are few."""
    few = partitions.limit(MOST_NAMED + 1).collect()
    if len(few) <= MOST_NAMED:
        rows = rows.filter(F.col("repo_key").isin([r[0] for r in few]) & F.col("bucket").isin(list({r[1] for r in few})))
    return rows.join(partitions, PARTITIONS, "left_semi")


def _cut(files: DataFrame, strategy: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Files as blocks: the chunkers keep a file's key as one id."""
    cut = strategy(files.select(F.concat_ws("\x1f", *FILE).alias("doc_id"), "text"))
    part = lambda k: F.get(F.split("doc_id", "\x1f", 3), F.lit(k))
    return cut.select(part(0).alias("repo_key"), part(1).cast("int").alias("bucket"), part(2).alias("path"), "block_no", "start", "end", "content")


def upsert(batch: DataFrame, index: str, version: int, strategy: Callable[[DataFrame], DataFrame] = chunking.fixed, buckets: int = 8, encoder=None) -> dict[str, int]:
    """Put ``batch`` (repo, path, text, and if need be deleted, modified) into ``index`` as ``version``.
    Returns how many files the batch had, how many of them changed or were deleted, and how many partitions
    were written. Versions of later batches must not fall, and ``buckets`` stays as it was for an index."""
    spark = batch.sparkSession
    files = kept(_keyed(batch, buckets))
    old = read(spark, index)
    known = _named(old.filter("block_no IS NULL"), files.select(*PARTITIONS).distinct()).select(*FILE, F.col("content_id").alias("_had"), F.col("version").alias("_at"))
    changed = files.join(known, FILE, "left").filter(~F.col("content_id").eqNullSafe(F.col("_had")) & (F.coalesce("_at", F.lit(version)) <= version)).drop("_had", "_at")
    changed = kept(changed)
    counts = changed.agg(F.count(F.lit(1)).alias("changed"), F.count_if(F.col("content_id").isNull()).alias("deleted"), F.count_distinct(*PARTITIONS).alias("partitions")).first().asDict()
    counts = {"files": files.count(), **counts}
    if counts["changed"]:
        touched = changed.select(*PARTITIONS).distinct()
        own = kept(_named(old, touched))
        rest = own.join(changed.select(*FILE), FILE, "left_anti")
        rows = rest.unionByName(_rows(changed, own, version, strategy, encoder).select(rest.columns))
        rows.repartition(*PARTITIONS).sortWithinPartitions(*FILE, "block_no").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(index)
    log.info("version %d of %s: %s", version, index, counts)
    return counts


def _rows(changed: DataFrame, own: DataFrame, version: int, strategy: Callable[[DataFrame], DataFrame], encoder) -> DataFrame:
    now = F.lit(version).cast("long")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = changed.select("repo", "content_id", now.alias("version"), null("long", "block_no"), null("long", "start"), null("long", "end"), null("long", "tokens"), null("string", "block_id"), now.alias("since"), null("string", "content"), null("array<float>", "vector"), *FILE)
    before = own.filter("block_no IS NOT NULL").groupBy(*FILE, "block_id").agg(F.min("since").alias("_since"), F.first("vector", ignorenulls=True).alias("vector"))
    cut = _cut(changed.filter("content_id IS NOT NULL"), strategy).withColumn("block_id", F.md5("content"))
    cut = cut.join(changed.select(*FILE, "repo", "content_id"), FILE).join(before, [*FILE, "block_id"], "left")
    cut = cut.withColumns({"version": now, "since": F.coalesce("_since", now), "tokens": space_tokens(F.col("content"))}).drop("_since")
    if encoder is not None:
        cut = cut.filter("vector IS NOT NULL").unionByName(embed(cut.filter("vector IS NULL").drop("vector"), "content", encoder).select(cut.columns))
    return heads.unionByName(cut.select(heads.columns))


def follow(spark: SparkSession, source: str, index: str, checkpoint: str, columns: dict[str, Column], strategy: Callable[[DataFrame], DataFrame] = chunking.fixed, buckets: int = 8, files_per_batch: int = 1000, encoder=None) -> list[dict[str, int]]:
    """Put the files of the Parquet folder ``source`` that are new since the last run into ``index``, and wait for
    it. ``columns``: repo, path, text and, if need be, deleted. What was taken is known from ``checkpoint``; a batch's number is
    its version. Returns what ``upsert`` returns for each batch."""
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows = rows.select(*[c.alias(name) for name, c in columns.items()], F.col("_metadata.file_modification_time").alias("modified"))
    done: list[dict[str, int]] = []

    def put(batch: DataFrame, number: int) -> None:
        done.append({"batch": number, **upsert(batch, index, number, strategy, buckets, encoder)})

    query = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return done
