"""Evaluation of ranked predictions against ground truth.

Predictions are long rows ``query_id, rank, item`` (ranks from 1 without gaps), ground truth
``query_id, item``. A query without ground truth is left out, one without predictions scores zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("acc", "ndcg", "precision", "recall", "map")


def hits(predictions: DataFrame, truth: DataFrame, k_values: list[int]) -> DataFrame:
    """Per query: ``n_truth`` and ``hits``, the ranks up to the largest k at which a true item is."""
    most = max(k_values)
    true = truth.select("query_id", "item").distinct()
    size = true.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_truth"))
    found = predictions.filter(F.col("rank") <= most).join(true, ["query_id", "item"], "left_semi")
    ranks = found.groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("hits"))
    return size.join(ranks, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<int>")))


def _at(name: str, k: int, most: int) -> Column:
    hit = F.filter("hits", lambda r: r <= k)
    n, truth = F.size(hit).cast("double"), F.col("n_truth")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    gain = lambda r: 1 / F.log2(r + 1)
    if name == "acc":
        return (n == F.least(truth, F.lit(k))).cast("double")
    if name == "precision":
        return n / k
    if name == "recall":
        return n / F.least(truth, F.lit(most))
    if name == "ndcg":
        ideal = total(F.transform(F.sequence(F.lit(1), F.least(truth, F.lit(k)).cast("int")), lambda r: gain(r)))
        return total(F.transform(hit, lambda r: gain(r))) / ideal
    if name == "map":
        return total(F.transform(hit, lambda r, i: (i + 1) / r)) / k
    raise ValueError(name)


def evaluate(predictions: DataFrame, truth: DataFrame, k_values: list[int], metrics: tuple[str, ...] = METRICS, excluded: DataFrame | None = None) -> DataFrame:
    """A row per metric and k with the mean over queries, rounded to four places."""
    each = hits(predictions, truth, k_values)
    if excluded is not None:
        each = each.join(excluded.select("query_id"), "query_id", "left_anti")
    columns = {f"{m}@{k}": _at(m, k, max(k_values)) for m in metrics for k in k_values}
    means = each.agg(*[F.avg(c).alias(name) for name, c in columns.items()])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.round(F.coalesce(F.col(f"`{m}@{k}`"), F.lit(0.0)), 4).alias("value")) for m in metrics for k in k_values])
    return means.select(F.explode(rows).alias("r")).select("r.*")


def wide(long: DataFrame, by: list[str]) -> DataFrame:
    """One row per group with a column for each metric at k, named ``metric_k``."""
    return long.withColumn("_name", F.concat_ws("_", "metric", "k")).groupBy(*by).pivot("_name").agg(F.first("value"))


def compare(methods: dict[str, DataFrame]) -> DataFrame:
    """Evaluations of several methods, one row each."""
    return wide(reduce(DataFrame.unionByName, [df.withColumn("method", F.lit(name)) for name, df in methods.items()]), ["method"])


def truth_levels(instances: DataFrame) -> DataFrame:
    """From ``query_id, edit_functions`` (``file:Class.method``): distinct items of the levels file,
    module and function, numbered in order of appearance."""
    from siftmill.functions.text import without_init

    each = instances.select("query_id", F.posexplode("edit_functions").alias("position", "id"))
    file, name = F.split_part("id", F.lit(":"), F.lit(1)), F.split_part("id", F.lit(":"), F.lit(-1))
    items = F.array(
        F.struct(F.lit("file").alias("level"), file.alias("item")),
        F.struct(F.lit("module").alias("level"), F.concat(file, F.lit(":"), F.split_part(name, F.lit("."), F.lit(1))).alias("item")),
        F.struct(F.lit("function").alias("level"), without_init(F.col("id")).alias("item")),
    )
    long = each.select("query_id", "position", F.explode(items).alias("r")).groupBy("query_id", F.col("r.level").alias("level"), F.col("r.item").alias("item")).agg(F.min("position").alias("_first"))
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "level").orderBy("_first", "item"))).drop("_first")


def floor_percentiles(values: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """The values at positions ``int((n - 1) * share)`` of the sorted column, from counts of distinct
    values rather than a sort of all rows."""
    counts = values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("of", F.sum("n").over(Window.partitionBy()))
    wanted = F.explode(F.array(*map(F.lit, shares))).alias("share")
    at = ranked.select(column, "n", "upto", "of", wanted).withColumn("at", F.floor((F.col("of") - 1) * F.col("share")))
    return at.filter((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))).select("share", F.col(column).alias("value"))


def sampled_lengths(rows: DataFrame, key: str, length: Column, most: int, size: int | None = 10_000, parts: int = 256, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row: ``n``, ``truncated`` (how many are longer than ``most``), ``rate``, and percentiles ``p50`` and so on of a sample of ``size``
    lengths. The counts are of all rows; the sample are the rows whose hashed ``key`` is smallest, so reruns and
    other partitionings take the same. The smallest of each of ``parts`` lots are found first, then those of all.
    ``size`` None: percentiles of all rows, from counts of distinct lengths."""
    marked = rows.select(F.xxhash64(key).alias("_mark"), length.alias("_length")).filter("_length IS NOT NULL")
    counts = marked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_length") > most).alias("truncated"))
    few = marked
    if size is not None:
        lots = Window.partitionBy(F.pmod("_mark", F.lit(parts))).orderBy("_mark", "_length")
        few = marked.withColumn("_nth", F.row_number().over(lots)).filter(F.col("_nth") <= size)
        few = few.orderBy("_mark", "_length").limit(size)
    found = floor_percentiles(few, "_length", shares)
    wide = found.agg(*[F.max(F.when(F.abs(F.col("share") - s) < 1e-9, F.col("value"))).alias(f"p{round(100 * s)}") for s in shares])
    one = F.lit(1).alias("_one")
    return counts.select("*", F.try_divide("truncated", "n").alias("rate"), one).join(wide.select("*", one), "_one").drop("_one")


def run_statistics(results: DataFrame) -> DataFrame:
    """Of localisation results: how many found files, how many failed, and files on average."""
    n = F.size(F.coalesce("found_files", F.array().cast("array<string>")))
    return results.agg(F.count(F.lit(1)).alias("n"), F.count_if(n > 0).alias("found"), F.count_if(n == 0).alias("failed"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_files"))


def edited_file_counts(instances: DataFrame, most: int = 5) -> DataFrame:
    """Instances by the number of files that their patch edits, up to ``most``, and by repository."""
    from siftmill.operators.patches import changed_files

    return instances.select("instance_id", "repo", F.size(changed_files(F.col("patch"))).alias("n_files")).filter(F.col("n_files") <= most).groupBy("repo", "n_files").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("instance_id")).alias("instances"))


def fitted_tokens(function_tokens, context_tokens, most: int, most_context: int = 256):
    """Token arrays packed for an encoder: the function's first, then as many of the context as fit."""
    own = F.slice(function_tokens, 1, most)
    room = F.least(F.lit(most) - F.size(own), F.lit(most_context))
    return F.concat(own, F.slice(context_tokens, 1, F.greatest(room, F.lit(0))))
