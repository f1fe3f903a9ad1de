"""Trees of blocks as intervals: each block has a left and a right number, and those of all blocks below it
lie between. Ancestors and what is below a block are then ranges, sums over subtrees differences of
running sums, and nothing is exploded to the paths of its ancestors.

``blocks`` have columns ``by`` that name the tree (say the file) and ``path``, an array of names from the top; paths
are unique within a tree, and siblings stand in the order of their names, so names should sort as blocks
stand in the text. A tree's blocks are numbered in ranges of that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.operators.ranges import tightest_container
from siftmill.operators.scratch import folder

#: Lines or left numbers that a sorted window takes at once.
_CUT = 1 << 16
#: Left numbers whose lines are joined at once.
_CUT_LINES = 1 << 13


def numbered(blocks: DataFrame, by: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """``blocks`` with left, right, depth (from 0) and below (how many blocks are below); and for each of ``sums`` its
    value over the block and all below it. Null values count as 0."""
    sums = {name: F.coalesce(c, F.lit(0)) for name, c in (sums or {}).items()}
    # Names end in a byte below all others, a null stands before them, and a block's end sorts behind all that begins with its path.
    escaped = lambda p: F.replace(F.replace(p, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    inner = F.encode(F.array_join(F.transform("path", lambda p: F.coalesce(F.concat(F.lit("\x02"), escaped(p), F.lit("\x00")), F.lit("\x01"))), ""), "UTF-8")
    outer = F.concat(inner, F.lit(b"\xff"))
    ends = F.explode(F.array(F.struct(inner.alias("key"), F.lit(False).alias("over")), F.struct(outer.alias("key"), F.lit(True).alias("over")))).alias("_e")
    begins = lambda c: F.when(F.col("_e.over"), 0).otherwise(c)
    marks = blocks.withColumns({f"_v_{name}": c for name, c in sums.items()}).select("*", ends)
    marks = _running(marks, by, "_e.key", {"_at": F.lit(1).cast("long"), **{f"_s_{name}": begins(F.col(f"_v_{name}")) for name in sums}})
    # The two marks of a block side by side: the end is what follows the beginning among those of its path.
    pair = Window.partitionBy(*by, "path").orderBy("_at")
    marks = marks.withColumns({"right": F.lead("_at").over(pair), **{name: F.lead(f"_s_{name}").over(pair) - F.col(f"_s_{name}") + F.col(f"_v_{name}") for name in sums}})
    found = marks.filter("NOT _e.over").withColumnRenamed("_at", "left")
    return found.select(*blocks.columns, "left", "right", (F.size("path") - 1).alias("depth"), ((F.col("right") - F.col("left") - 1) / 2).cast("long").alias("below"), *sums)


def _running(rows: DataFrame, by: list[str], key: str, values: dict[str, Column]) -> DataFrame:
    """``rows`` with sums of ``values`` over the rows of their tree up to each in the order of ``key``. Rows are cut into
    ranges of the order, which are summed apart and then moved by the sums of those before, so no task has a whole tree."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    path = folder(spark, "marks")
    rows.withColumns({f"_w_{name}": c for name, c in values.items()}).repartitionByRange(n, *by, key).withColumn("_cut", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.parquet(path)
    upto = Window.partitionBy(*by, "_cut").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.groupBy(*by, "_cut").agg(*[F.sum(f"_w_{name}").alias(name) for name in values])
    whole = whole.select(*[F.col(c).alias(f"_o_{c}") for c in (*by, "_cut")], *[F.coalesce(F.sum(name).over(ahead), F.lit(0)).alias(f"_b_{name}") for name in values])
    same = F.lit(True)
    for c in (*by, "_cut"):
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    moved = cut.withColumns({name: F.sum(f"_w_{name}").over(upto) for name in values}).join(F.broadcast(whole), same)
    return moved.withColumns({name: F.col(name) + F.col(f"_b_{name}") for name in values}).select(*rows.columns, *values)


def beside(tree: DataFrame, by: list[str], value: str) -> DataFrame:
    """``tree`` with before and after: the sums of ``value`` over the siblings before and behind each block."""
    parent = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    order = Window.partitionBy(*by, "_parent").orderBy("left")
    whole = Window.partitionBy(*by, "_parent")
    before = F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = tree.withColumn("_parent", parent).withColumn("before", before)
    return found.withColumn("after", F.sum(value).over(whole) - F.col("before") - F.col(value)).drop("_parent")


def nearest_above(tree: DataFrame, by: list[str], wanted: Column, width: int = 64) -> DataFrame:
    """``by, left, above``: for each block the left number of the nearest block above it that is ``wanted``; null
    where none is."""
    outer = tree.filter(wanted).select(*by, (F.col("left") + 1).alias("start"), (F.col("right") - 1).alias("end"), F.col("left").alias("range_id"))
    found = tightest_container(tree.select(*by, F.col("left").alias("line")), outer, by, width=width)
    return found.select(*by, F.col("line").alias("left"), F.col("range_id").alias("above"))


def at_lines(tree: DataFrame, lines: DataFrame, by: list[str], width: int = 64) -> DataFrame:
    """``lines`` (by, line) with ``left`` of the innermost block (start, end) on that line."""
    inner = tree.select(*by, "start", "end", F.col("left").alias("range_id"))
    return tightest_container(lines.select(*by, "line").distinct(), inner, by, width=width).select(*by, "line", F.col("range_id").alias("left"))


def next_from(tree: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """``lines`` (by, line) with ``left`` of the first block that starts on that line or behind it: an as-of
    look ahead by sorted windows over cuts of ``_CUT`` lines, without a join on ranges."""
    cut = F.floor(F.col("_at") / _CUT).alias("_cut")
    points = lines.select(*by, F.col("line").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_left")).distinct()
    starts = tree.select(*by, F.col("start").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.col("left").alias("_left"))
    both = points.unionByName(starts).select("*", cut)
    # Backwards, since a frame to the end of its partition is read anew for every row.
    order = Window.partitionBy(*by, "_cut").orderBy(F.desc("_at"), F.desc("_kind"), F.desc("_left"))
    found = both.withColumn("left", F.last("_left", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_kind = 0")
    # Where a cut has no more blocks, the first block of those behind it.
    cuts = both.groupBy(*by, "_cut").agg(F.min(F.when(F.col("_kind") == 1, F.struct("_at", "_left"))).alias("_first"))
    behind = Window.partitionBy(*by).orderBy(F.desc("_cut")).rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select(*by, "_cut", F.last("_first", ignorenulls=True).over(behind)["_left"].alias("_next"))
    found = found.join(cuts, [*by, "_cut"], "left")
    return found.select(*by, F.col("_at").cast(lines.schema["line"].dataType).alias("line"), F.coalesce("left", "_next").alias("left"))


def spans(tree: DataFrame, by: list[str]) -> DataFrame:
    """For each span_id its first and last block, and the block that stands before the first: ``by, span_id,
    first, last, preceding``, all as left numbers."""
    ahead = _ahead(tree, by)
    return ahead.filter("span_id IS NOT NULL").groupBy(*by, "span_id").agg(F.min("left").alias("first"), F.max("left").alias("last"), F.min_by("_ahead", "left").alias("preceding"))


def _ahead(tree: DataFrame, by: list[str]) -> DataFrame:
    """``tree`` with ``_ahead``: the left number before each block's. Windows take ``_CUT`` numbers; the first block of one
    follows the last of those before."""
    cut = tree.withColumn("_cut", F.floor(F.col("left") / _CUT))
    cuts = cut.groupBy(*by, "_cut").agg(F.max("left").alias("_end"))
    cuts = cuts.select(*by, "_cut", F.max("_end").over(Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)).alias("_end"))
    own = F.lag("left").over(Window.partitionBy(*by, "_cut").orderBy("left"))
    return cut.withColumn("_ahead", own).join(F.broadcast(cuts), [*by, "_cut"]).withColumn("_ahead", F.coalesce("_ahead", "_end")).drop("_cut", "_end")


def span_ids_below(tree: DataFrame, by: list[str], wanted: Column, width: int = 64) -> DataFrame:
    """``by, left, span_ids``: the sorted span ids of each ``wanted`` block and all that are nearer to it than to
    another such block below it."""
    own = nearest_above(tree, by, wanted, width).join(tree.select(*by, "left", "span_id", wanted.alias("_own")), [*by, "left"])
    at = F.when(F.col("_own"), F.col("left")).otherwise(F.col("above"))
    return own.withColumn("_at", at).filter("_at IS NOT NULL").groupBy(*by, F.col("_at").alias("left")).agg(F.array_sort(F.collect_set("span_id")).alias("span_ids"))


def rendered(tree: DataFrame, by: list[str], label: Column, shown: Column | None = None, highlighted: Column | None = None, only_highlighted: bool = False) -> DataFrame:
    """``by, text``: a line per block, indented by its depth, in the order of the tree. ``shown`` leaves blocks out;
    a ``highlighted`` one gets a mark; with ``only_highlighted`` runs of others become one line of dots."""
    rows = tree.filter(shown) if shown is not None else tree
    mark = F.coalesce(highlighted, F.lit(False)) if highlighted is not None else F.lit(False)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(mark, "* ").otherwise(""), label)
    rows = rows.select(*by, "left", mark.alias("_mark"), line.alias("_line"))
    if only_highlighted:
        rows = _marked_before(rows, by).filter("_mark OR _before").withColumn("_line", F.when(F.col("_mark"), F.col("_line")).otherwise("..."))
    # The lines of a cut are joined first, so that what is gathered for a tree are its few cuts' texts, not its lines.
    joined = lambda at, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, line))), lambda r: r[line]), "\n")
    cuts = rows.withColumn("_cut", F.floor(F.col("left") / _CUT_LINES)).groupBy(*by, "_cut").agg(joined("left", "_line").alias("_text"))
    return cuts.groupBy(*by).agg(joined("_cut", "_text").alias("text"))


def _marked_before(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``_before``: whether the row before has the ``_mark``; true for a tree's first. Windows take a cut each,
    whose first row follows the last of the cut before."""
    cut = rows.withColumn("_cut", F.floor(F.col("left") / _CUT_LINES))
    ends = cut.groupBy(*by, "_cut").agg(F.max_by("_mark", "left").alias("_end"))
    ends = ends.select(*by, "_cut", F.lag("_end", 1, True).over(Window.partitionBy(*by).orderBy("_cut")).alias("_end"))
    same = F.lit(True)
    for c in (*by, "_cut"):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    ends = ends.select(*[F.col(c).alias(f"_of_{c}") for c in (*by, "_cut")], "_end")
    own = F.lag("_mark").over(Window.partitionBy(*by, "_cut").orderBy("left"))
    return cut.withColumn("_before", own).join(F.broadcast(ends), same).withColumn("_before", F.coalesce("_before", "_end")).select(*rows.columns, "_before")


def resolved(references: DataFrame, blocks: DataFrame, by: list[str], excluded: tuple[str, ...] = ()) -> DataFrame:
    """``references`` (by, path, target) with ``found``: the path of the block that each means, null if there is none.

    A target, an array of names, means a block whose path ends so. Of several, that in the nearest scope: with the
    longest common beginning with the reference's own path, then the shallower, then the first by path.
    References in or below blocks of ``excluded`` kinds are left out (``blocks``: by, path, kind). Paths meet by an
    index of their ends and beginnings, which holds one block of each, so a reference meets no more rows than its path is long.
    All joins are sorted: Spark takes explode for one row a row, and by that would send whole tables to the driver to broadcast them."""
    if excluded:
        over = blocks.filter(F.col("kind").isin(list(excluded))).select(*by, F.col("path").alias("_up"))
        own = references.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))))
        inside = own.join(over.hint("merge"), [*by, "_up"], "left_semi").select(*by, "path").distinct()
        references = references.join(inside.hint("merge"), [*by, "path"], "left_anti")
    # The best block below each beginning of a path; a reference takes that of its longest beginning which has one.
    starts = lambda name, alias: F.explode(F.transform(F.sequence(F.lit(0), F.size(name)), lambda n: F.when(n > 0, F.slice(name, F.lit(1), n)).otherwise(F.array().cast("array<string>")))).alias(alias)
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.size("path") - n + 1, n)))
    asked = references.select(*by, "path", "target").distinct()
    index = blocks.filter(F.size("path") > 0).select(*by, F.col("path").alias("_path"), ends.alias("target"))
    index = index.join(asked.select(*by, "target").distinct().hint("merge"), [*by, "target"], "left_semi")
    near = F.struct(F.size("_path").alias("depth"), "_path")
    index = index.select("*", starts("_path", "_scope")).groupBy(*by, "target", "_scope").agg(F.min(near).alias("_near"))
    scopes = asked.select("*", starts("path", "_scope"))
    best = scopes.join(index.hint("merge"), [*by, "target", "_scope"]).groupBy(*by, "path", "target").agg(F.max_by("_near", F.size("_scope")).alias("_best"))
    best = best.select(*by, "path", "target", F.col("_best._path").alias("found"))
    return references.join(best.hint("merge"), [*by, "path", "target"], "left")
