"""Operators on closed intervals: joins by overlap and containment, merging, gaps.

Joins are equi-joins on a grid cell, so they hash and split like any other; a pair that shares
several cells is kept in the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cell(at: Column, width: int) -> Column:
    return F.floor(at / width).cast("long")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = 64, names: tuple[str, str, str, str] = ("start", "end", "other_start", "other_end")) -> DataFrame:
    """Rows of both with equal ``keys`` whose intervals share a point. Names: interval columns of
    ``left``, then of ``right``. ``width``: about the length of most intervals."""
    a, z, b, y = names
    cells = lambda s, e: F.explode(F.sequence(_cell(F.col(s), width), _cell(F.col(e), width)))
    l, r = left.filter(F.col(a) <= F.col(z)).withColumn("_cell", cells(a, z)), right.filter(F.col(b) <= F.col(y)).withColumn("_cell", cells(b, y))
    both = l.join(r, [*keys, "_cell"])
    first = _cell(F.greatest(F.col(a), F.col(b)), width)
    return both.filter((F.col(a) <= F.col(y)) & (F.col(b) <= F.col(z)) & (F.col("_cell") == first)).drop("_cell")


def tightest_container(points: DataFrame, ranges: DataFrame, keys: list[str], at: str = "line", width: int = 64) -> DataFrame:
    """Each point with the shortest range that covers it (ties: the later start, then the least id);
    nulls where none does. ``ranges``: keys, start, end, range_id."""
    cells = F.explode(F.sequence(_cell(F.col("start"), width), _cell(F.col("end"), width)))
    r = ranges.filter("start <= end").withColumn("_cell", cells)
    names = points.columns
    best = F.min(F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("late"), F.col("range_id"), F.col("start"), F.col("end")))
    found = points.withColumn("_cell", _cell(F.col(at), width)).join(r, [*keys, "_cell"]).filter(F.col(at).between(F.col("start"), F.col("end")))
    found = found.groupBy(*names).agg(best.alias("b")).select(*names, "b.range_id", "b.start", "b.end")
    return points.join(found, names, "left")


def merge(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Union of intervals per key; those that touch only by adjacency stay apart. Of equal starts the longest
    covers the others, so a key's window has a row per start, and no ties."""
    ranges = ranges.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy(*keys).orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    island = ranges.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def uncovered(ranges: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps of ``whole`` (keys, first, last) that no range covers; all of it where there is none."""
    merged = merge(ranges, keys)
    order = Window.partitionBy(*keys).orderBy("start")
    joined = whole.join(merged, keys, "left")
    joined = joined.withColumns({"_from": F.coalesce(F.lag("end").over(order) + 1, F.col("first")), "_next": F.lead("start").over(order)})
    gaps = joined.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("_from").alias("start"), F.coalesce(F.col("start") - 1, F.col("last")).alias("end")),
                F.when(F.col("end").isNotNull() & F.col("_next").isNull(), F.struct((F.col("end") + 1).alias("start"), F.col("last").alias("end"))),
            )
        ).alias("g"),
    )
    return gaps.select(*keys, F.greatest("g.start", F.lit(0)).alias("start"), F.col("g.end").alias("end")).filter("start <= end")


def not_covered(ranges: DataFrame, keys: list[str], longest: int = 100) -> DataFrame:
    """Ranges that no earlier, or equal but longer, range of the key reaches past; ranges of
    ``longest`` or more lines stay and cover nothing."""
    short = F.col("end") - F.col("start") < longest
    order = Window.partitionBy(*keys, "_short").orderBy(F.col("start"), F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_short", short).withColumn("_reach", reach)
    return marked.filter(~F.col("_short") | F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_short", "_reach")


def lines_of(ranges: DataFrame, keys: list[str], shift: int = 1) -> DataFrame:
    """Distinct lines of ranges, counted from ``shift``."""
    return ranges.select(*keys, F.explode(F.sequence(F.col("start") + shift, F.col("end") + shift)).alias("line")).distinct()


def islands(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive lines."""
    order = Window.partitionBy(*keys).orderBy("line")
    marked = lines.distinct().withColumn("_run", F.col("line") - F.row_number().over(order))
    return marked.groupBy(*keys, "_run").agg(F.min("line").alias("start"), F.max("line").alias("end")).drop("_run")
