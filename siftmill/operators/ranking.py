"""Ranked lists: top-k, score to group, first-seen order, fallbacks, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, by: list[str], k: int, score: str = "score", ties: tuple[str, ...] = ("item",), ascending: bool = False) -> DataFrame:
    """The ``k`` best rows per group with their ``rank`` from 1. A rank filter is pushed below the
    shuffle, so each task sends at most ``k`` rows a group."""
    order = [F.asc(score) if ascending else F.desc(score), *map(F.asc, ties)]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def group_scores(ranked: DataFrame, by: list[str], group: str, k: int) -> DataFrame:
    """Groups by the sum of the scores of their ranked rows; ties go to the group seen first."""
    sums = ranked.groupBy(*by, group).agg(F.sum("score").alias("score"), F.min("rank").alias("_seen"))
    return top_k(sums, by, k, ties=("_seen", group)).drop("_seen")


def first_seen(rows: DataFrame, by: list[str], item: str, position: str, k: int | None = None) -> DataFrame:
    """Distinct items per group in order of appearance, numbered from 1; the first ``k`` if given."""
    seen = rows.groupBy(*by, item).agg(F.min(position).alias("_first"))
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_first", item))).drop("_first")
    return ranked.filter(F.col("rank") <= k) if k else ranked


def first_choice(options: list[DataFrame], by: list[str]) -> DataFrame:
    """Per group the rows of the first option that has any."""
    stacked = None
    for k, option in enumerate(options):
        own = option.withColumn("_choice", F.lit(k))
        stacked = own if stacked is None else stacked.unionByName(own)
    best = F.min("_choice").over(Window.partitionBy(*by))
    return stacked.withColumn("_best", best).filter("_choice = _best").drop("_choice", "_best")


def preferring(rows: DataFrame, wanted: Column, by: list[str]) -> DataFrame:
    """Per group the rows that are ``wanted``, or all of them where none is."""
    any_wanted = F.max(wanted.cast("int")).over(Window.partitionBy(*by))
    return rows.withColumn("_any", any_wanted).filter(wanted | (F.col("_any") == 0)).drop("_any")


def majority(samples: DataFrame, by: list[str], item: str = "item", position: str = "position") -> DataFrame:
    """Items by number of occurrences over all samples; ties by first appearance."""
    votes = samples.groupBy(*by, item).agg(F.count(F.lit(1)).cast("double").alias("score"), F.min(position).alias("_first"))
    return _ranked(votes, by, item)


def reciprocal_ranks(samples: DataFrame, by: list[str], item: str = "item", rank: str = "rank", position: str = "position") -> DataFrame:
    """Items by the sum of 1 / rank over all samples; ties by first appearance."""
    votes = samples.groupBy(*by, item).agg(F.sum(1 / F.col(rank)).alias("score"), F.min(position).alias("_first"))
    return _ranked(votes, by, item)


def _ranked(votes: DataFrame, by: list[str], item: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "_first", item)
    return votes.withColumn("rank", F.row_number().over(order)).drop("_first")


def merge_results(results: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Search results (query, node_id, format) merged by node: the best format, all queries. Snippets,
    which have no node, stay apart."""
    order = F.lit(len(priority))
    for name, k in priority.items():
        order = F.when(F.col("format") == name, k).otherwise(order)
    nodes = results.filter("node_id IS NOT NULL").withColumn("_p", order)
    merged = nodes.groupBy("node_id").agg(F.min_by("format", "_p").alias("format"), F.array_sort(F.collect_set("query")).alias("queries"))
    alone = results.filter("node_id IS NULL").select("node_id", "format", F.array("query").alias("queries"))
    return merged.unionByName(alone)
