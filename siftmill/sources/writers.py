"""Sinks: JSON lines, CSV and indexes partitioned by repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_FIELDS = {
    "block_id": "long", "repo": "string", "strategy": "string", "file_path": "string", "start_line": "int", "end_line": "int", "block_type": "string", "content": "string",
    "span_ids": "array<string>", "qualified_name": "string", "class_name": "string", "function_name": "string", "chunk_tokens": "long", "vector": "array<float>", "created_at": "timestamp",
}


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replace_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def block_index(blocks: DataFrame, path: str) -> None:
    """Blocks with all fields of an index, those that are missing null, in partitions by repository and
    strategy. block_id counts from 0 by file and line within each."""
    have = set(blocks.columns)
    if "block_id" not in have:
        order = Window.partitionBy("repo", "strategy").orderBy("file_path", "start_line", "end_line")
        blocks = blocks.withColumn("block_id", F.row_number().over(order) - 1)
    full = blocks.select(*[(F.col(c) if c in blocks.columns else F.lit(None)).cast(t).alias(c) for c, t in BLOCK_FIELDS.items()])
    full.write.mode("overwrite").partitionBy("repo", "strategy").parquet(path)


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("repo").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("repo").parquet(f"{path}/edges")


def upserted(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``current`` with rows of ``changes`` in place of those with their key; rows of ``changes`` whose
    ``deleted`` is true only remove."""
    gone = changes.select(key).distinct()
    kept = current.join(gone, key, "left_anti")
    return kept.unionByName(changes.filter("NOT coalesce(deleted, false)").select(current.columns))
