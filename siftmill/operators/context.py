"""Which code spans fit a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions.text import let


def pack_spans(spans: DataFrame, most_tokens: int, by: list[str], decay: float = 1.05, least_tokens: int = 50) -> DataFrame:
    """``spans`` (by, span_id, rank, tokens) that fit, with ``allotted`` tokens. If all fit, all get
    theirs. Else the last ranks are dropped until the rest fit by their least share, and what is left
    is divided by weights that fall with the rank."""
    group = Window.partitionBy(*by)
    order = group.orderBy("rank", "span_id")
    least = F.least("tokens", F.lit(least_tokens))
    upto = spans.withColumns({"_all": F.sum("tokens").over(group), "_least": least}).withColumn("_upto", F.sum("_least").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = upto.filter((F.col("_all") < most_tokens) | (F.col("_upto") <= most_tokens))
    weight = F.pow(F.lit(decay), -F.col("rank"))
    shared = kept.withColumns({"_weights": F.sum(weight).over(group), "_used": F.sum("_least").over(group)})
    more = F.floor((most_tokens - F.col("_used")) * weight / F.col("_weights"))
    allotted = F.when(F.col("_all") < most_tokens, F.col("tokens")).otherwise(F.least(F.col("tokens"), F.lit(least_tokens) + more))
    return shared.withColumn("allotted", allotted.cast("long")).drop("_all", "_least", "_upto", "_weights", "_used")


def expand(context: DataFrame, related: DataFrame, most_tokens: int, by: list[str]) -> DataFrame:
    """``context`` (by, span_id, tokens) and as many ``related`` spans, larger ones first, as stay
    within the budget."""
    used = context.groupBy(*by).agg(F.sum("tokens").alias("_used"))
    new = related.join(context.select(*by, "span_id"), [*by, "span_id"], "left_anti").dropDuplicates([*by, "span_id"])
    upto = F.sum("tokens").over(Window.partitionBy(*by).orderBy(F.desc("tokens"), "span_id").rowsBetween(Window.unboundedPreceding, 0))
    fits = new.withColumn("_upto", upto).join(used, by, "left").filter(F.col("_upto") + F.coalesce("_used", F.lit(0)) <= most_tokens)
    return context.select(*by, "span_id", "tokens").unionByName(fits.select(*by, "span_id", "tokens"))


def prompts(files: DataFrame, spans: DataFrame, most_tokens: int | None = None, mark: str = "... other code") -> DataFrame:
    """``file, text``: what a model is shown of each file. ``files`` (file, text), ``spans`` (file, start, end from 1, and with a budget
    rank, tokens): the spans' lines, each gap behind shown lines as one ``mark``, between the file's name and fences. With a
    budget, the first ranks that fit it are shown. A file without spans is shown whole."""
    if most_tokens is not None:
        upto = F.sum("tokens").over(Window.partitionBy("file").orderBy("rank", "start").rowsBetween(Window.unboundedPreceding, 0))
        spans = spans.withColumn("_upto", upto).filter(F.col("_upto") <= most_tokens)
    # A file's ranges are one array beside its text; lines are neither exploded nor shuffled.
    own = spans.filter("start <= end").groupBy("file").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    both = files.select("file", F.coalesce("text", F.lit("")).alias("text")).join(own, "file", "left")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("x"), F.exists("_spans", lambda s: (s["start"] <= i + 1) & (i + 1 <= s["end"])).alias("shown")))

    def told(rows: Column) -> Column:
        gap = lambda i: (i > 0) & F.get(rows["shown"], i - 1)
        kept = F.filter(F.transform(rows, lambda r, i: F.when(r["shown"], r["x"]).when(gap(i), F.lit(mark))), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n"))).otherwise("")

    code = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(let(lines, told))
    return both.select("file", F.concat("file", F.lit("\n```\n"), code, F.lit("\n```\n")).alias("text"))


def sizes(context: DataFrame, by: list[str]) -> DataFrame:
    return context.groupBy(*by).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_spans"))


def related_spans(edges: DataFrame, spans: DataFrame, initial: DataFrame) -> DataFrame:
    """``span_id, related``: spans one edge away either way, and the initial spans of the span's class
    or file (``initial``: owner, span_id; ``spans``: span_id, owner)."""
    own = spans.select("span_id", "owner")
    out = own.join(edges.select(F.col("src").alias("span_id"), F.col("dst").alias("related")), "span_id").select("span_id", "related")
    back = own.join(edges.select(F.col("dst").alias("span_id"), F.col("src").alias("related")), "span_id").select("span_id", "related")
    first = own.join(initial.select("owner", F.col("span_id").alias("related")), "owner").select("span_id", "related")
    return out.unionByName(back).unionByName(first).filter("span_id <> related").distinct()


def ordinal_ids(spans: DataFrame, by: list[str], name: str = "name", order: str = "start") -> DataFrame:
    """``span_id``: the name, with ``:2`` and so on for repeats in order."""
    nth = F.row_number().over(Window.partitionBy(*by, name).orderBy(order))
    return spans.withColumn("_nth", nth).withColumn("span_id", F.when(F.col("_nth") == 1, F.col(name)).otherwise(F.concat(name, F.lit(":"), F.col("_nth").cast("string")))).drop("_nth")


def descendants(blocks: DataFrame) -> DataFrame:
    """Pairs (ancestor, block) of blocks with paths (arrays), by the paths' prefixes."""
    up = blocks.select(F.col("path").alias("block"), F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("ancestor"))
    return up.join(blocks.select(F.col("path").alias("ancestor")), "ancestor", "left_semi").select("ancestor", "block")


def subtree_tokens(blocks: DataFrame) -> DataFrame:
    """Sum of tokens of each block and all below it."""
    return descendants(blocks).join(blocks.select(F.col("path").alias("block"), "tokens"), "block").groupBy(F.col("ancestor").alias("path")).agg(F.sum("tokens").alias("tokens"))
