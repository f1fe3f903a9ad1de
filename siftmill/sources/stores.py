"""A store of vectors and one of settings, as Parquet and JSON files."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.operators.ranking import top_k
from siftmill.operators.retrieval import dense
from siftmill.operators.scratch import kept

SCHEMA = "vector_id long, doc_id string, vector array<float>, category string"


@dataclass(frozen=True)
class Settings:
    model: str = "hashing"
    dimensions: int = 1536
    least_tokens: int = 100
    chunk_tokens: int = 500
    most_tokens: int = 2000
    comments: str = "include"

    def write(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Settings:
        return Settings(**json.loads(spark.read.text(path).first()["value"]))


def _numbered(new: DataFrame, last: int, parts: int) -> DataFrame:
    """``new`` with ids from ``last + 1`` on, without gaps. Rows are dealt into ``parts`` ranges of doc_id and
    numbered within each, and each range begins where those before it end, so no task sees all rows."""
    # Kept, so that the ranges are the same when they are counted and when they are numbered.
    dealt = kept(new.repartitionByRange(parts, "doc_id").withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("doc_id"))
    return dealt.join(F.broadcast(counts), "_part").withColumn("vector_id", (F.lit(last) + F.col("_before") + nth).cast("long")).drop("_part", "_n", "_before")


def _last_id(store: DataFrame) -> int:
    return store.agg(F.coalesce(F.max("vector_id"), F.lit(-1)).alias("m")).first()["m"]


def added(store: DataFrame, new: DataFrame, parts: int = 64) -> DataFrame:
    """The store with new rows (doc_id, vector, category); their ids follow the largest there is."""
    return store.unionByName(_numbered(new, _last_id(store), parts).select(store.columns))


def _batches(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, batch int").parquet(f"{path}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch int")


def _put(rows: DataFrame, path: str, name: str, batch: int) -> None:
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")


def appended(spark: SparkSession, path: str, new: DataFrame, batch: int, parts: int = 64) -> None:
    """Write ``new`` (doc_id, vector, category) as a batch of the store at ``path``. Ids follow those of all earlier
    batches, dropped ones included; those batches are not written again, and to repeat one replaces it."""
    last = _last_id(_batches(spark, path, "vectors", SCHEMA).filter(F.col("batch") < batch))
    _put(_numbered(new, last, parts).select("vector_id", "doc_id", "vector", "category"), path, "vectors", batch)


def dropped(spark: SparkSession, path: str, documents: DataFrame, batch: int) -> None:
    """Take documents out of the batches up to ``batch``: their ids are written, and readers leave them out."""
    _put(documents.select("doc_id").distinct(), path, "dropped", batch)


def held(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store with their batch, without those that were dropped."""
    gone = _batches(spark, path, "dropped", "doc_id string").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("batch").alias("_upto"))
    rows = _batches(spark, path, "vectors", SCHEMA)
    return rows.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.col("batch") <= F.col("_upto")), "left_anti")


def compacted(spark: SparkSession, path: str, into: str) -> None:
    """What a store holds as the first batch of another, with the ids that it has."""
    _put(held(spark, path).drop("batch"), into, "vectors", 0)


def deleted(store: DataFrame, documents: DataFrame) -> DataFrame:
    return store.join(documents.select("doc_id"), "doc_id", "left_anti").select(store.columns)


def nearest(store: DataFrame, queries: DataFrame, k: int = 500, category: str | None = None) -> DataFrame:
    """The ``k`` nearest rows by squared distance, ascending; the category is looked at afterwards, so
    that fewer may remain."""
    found = dense(queries, store.select(F.col("vector_id").alias("item"), "vector"), k, "l2")
    best = top_k(found, ["query_id"], k, ascending=True).join(store.select(F.col("vector_id").alias("item"), "doc_id", "category"), "item")
    return best.filter(F.col("category") == category) if category else best
