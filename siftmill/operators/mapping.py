"""From ranked blocks to the entities and modules on their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.operators.ranges import overlap_join
from siftmill.operators.ranking import first_seen


def _ordered(found: DataFrame, k: int) -> DataFrame:
    """Distinct ids in the order of file, block and id, numbered, the first ``k`` of a query."""
    first = found.groupBy("query_id", "id").agg(F.min(F.struct("file_no", "rank", "part", "id")).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("item"))


def by_lines(blocks: DataFrame, line_map: DataFrame, k_modules: int = 10, k_entities: int = 50, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Entities and modules of ranked blocks (query_id, rank, file, start, end; lines from 0), by line
    runs (path, start, end, entity, class_name; lines from 1) of the same file and columns ``by`` (say the
    repository). Files go in the order of their first block, blocks by rank within, ids of a block by
    name. A function outside classes is its own module."""
    order = Window.partitionBy("query_id", "file")
    own = blocks.withColumn("file_no", F.min("rank").over(order)).withColumns({"start": F.col("start") + 1, "end": F.col("end") + 1})
    runs = line_map.select(F.col("path").alias("file"), F.col("start").alias("other_start"), F.col("end").alias("other_end"), "entity", "class_name", *by)
    both = overlap_join(own, runs, ["file", *by])
    at = lambda name: F.concat("file", F.lit(":"), name)
    entities = both.filter("entity IS NOT NULL").select("query_id", "file_no", "rank", F.lit(0).alias("part"), at("entity").alias("id"))
    modules = both.select("query_id", "file_no", "rank", F.lit(0).alias("part"), at(F.coalesce("class_name", "entity")).alias("id"))
    return _ordered(entities, k_entities), _ordered(modules.filter("id IS NOT NULL"), k_modules)


def by_spans(blocks: DataFrame, nodes: DataFrame, k_modules: int = 10, k_entities: int = 50) -> tuple[DataFrame, DataFrame]:
    """Entities and modules of ranked blocks (query_id, rank, file, span_ids) whose ``file:span`` is a
    node. A function counts as entity and gives its first component as module; a class is a module by
    its whole name."""
    span = blocks.select("query_id", "rank", "file", F.posexplode("span_ids").alias("part", "span"))
    span = span.withColumn("node_id", F.concat("file", F.lit(":"), "span")).withColumn("file_no", F.lit(0))
    found = span.join(nodes.select("node_id", "type"), "node_id")
    entities = found.filter("type = 'function'").select("query_id", "file_no", "rank", "part", F.col("node_id").alias("id"))
    module = F.when(F.col("type") == "class", F.col("node_id")).otherwise(F.concat("file", F.lit(":"), F.substring_index("span", ".", 1)))
    modules = found.filter("type IN ('class', 'function')").select("query_id", "file_no", "rank", "part", module.alias("id"))
    return _ordered(entities, k_entities), _ordered(modules, k_modules)


def span_ids(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blocks (block_id, file, start, end; lines from 0) with the sorted names of the functions and
    classes on their lines (nodes: node_id, type, start, end; lines from 1)."""
    own = blocks.select("block_id", "file", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"))
    inner = nodes.filter("type IN ('class', 'function')").select(F.split_part("node_id", F.lit(":"), F.lit(1)).alias("file"), F.split_part("node_id", F.lit(":"), F.lit(-1)).alias("name"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    names = overlap_join(own, inner, ["file"]).groupBy("block_id").agg(F.array_sort(F.collect_set("name")).alias("span_ids"))
    return blocks.join(names, "block_id", "left").withColumn("span_ids", F.coalesce("span_ids", F.array().cast("array<string>")))


def found_files(ranked: DataFrame, k: int) -> DataFrame:
    """Distinct files of ranked blocks in order of appearance."""
    return first_seen(ranked, ["query_id"], "file", "rank", k)
