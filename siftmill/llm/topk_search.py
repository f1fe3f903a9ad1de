"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors are quantized to integers. With M the largest norm of the data, each data vector s gets one
more component sqrt(M^2 - |s|^2) and each query q a zero; then |q - s|^2 = |q|^2 + M^2 - 2 q.s, so
the largest inner products are the nearest neighbours, and the triangle inequality holds.

1. As many data vectors as the square root of their number (``PIVOTS`` at least, ``MOST_PIVOTS`` at
   most), those with the smallest hash, are pivots; every query and data vector belongs to the cell of its nearest pivot (Lu et al., Efficient Processing of k Nearest Neighbor
   Joins using MapReduce, 2012).
2. A pass summarises the cells: the queries' number and largest distance U_i to their pivot, and the
   k + 1 smallest distances of the data to theirs. They bound the distance from any query of cell i
   to its k-th neighbour besides itself: theta_i, the (k + 1)-th smallest U_i + |p_i p_j| + |p_j s|.
3. A data vector goes to the queries of cell i only if |s p_i| - U_i <= theta_i. Cells with few
   queries share a block, those with many are dealt over blocks. A pass counts what goes to each block,
   and it is dealt over as many splits as that takes, so that a task holds about ``BLOCK`` queries and
   ``SPLIT`` vectors, whatever cell most rows are in, and no query goes to an empty split.
4. Each task solves its block and split by a matrix product of integers (exact in doubles below
   2^53, else in 64-bit integers) and returns k + 1 rows a query, which are merged.

Where vectors have no clusters, as random ones of many dimensions, distances bound little and the
work is that of all query-row pairs, in blocks.

Defined cases. Vectors that are null or hold a null or non-finite component take no part. Vectors
of unequal length: missing components count as 0. Null vec_id: never a query; as a candidate it
comes last among ties. Repeated rows: each is a query, and for it the others are candidates. Ties:
the smaller vec_id. Fewer candidates than k: all. An empty table: an empty result. Columns of the
input other than vec_id and embedding aren't used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.common import table, written

K = 5
QUERY_STEP = 50
SCALE = 256
PIVOTS, MOST_PIVOTS = 32, 4096
BLOCK, SPLIT = 512, 8192
_ROWS = 1024
_NULL_ID = np.iinfo(np.int64).max


@F.pandas_udf(T.BinaryType())
def _packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Integers as bytes: a mark of the width, then the components."""
    for vectors in parts:
        yield pd.Series([_pack(np.asarray(v, np.int64)) for v in vectors], dtype=object)


def _pack(v: np.ndarray) -> bytes:
    small = not len(v) or abs(v.min()) < 2**15 > abs(v.max())
    return b"2" + v.astype("<i2").tobytes() if small else b"8" + v.astype("<i8").tobytes()


def _matrix(packed: pd.Series, width: int) -> np.ndarray:
    """int64 rows, padded with zeros to ``width``."""
    out = np.zeros((len(packed), width), np.int64)
    values = packed.to_numpy()
    if len(values) and all(len(v) == 1 + 2 * width and v[0] == 50 for v in values):
        return np.frombuffer(b"".join([v[1:] for v in values]), "<i2").reshape(-1, width).astype(np.int64)
    for row, v in zip(out, values):
        own = np.frombuffer(v, "<i2" if v[0] == 50 else "<i8", offset=1)
        row[: len(own)] = own
    return out


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, q (packed integers), n2 (squared norm) and dim of the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    n2 = F.aggregate("w", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    found = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(int(_NULL_ID))).alias("vec_id"), F.when(fine, whole).alias("w")).filter("w IS NOT NULL")
    return found.select("vec_id", _packed("w").alias("q"), n2.alias("n2"), F.size("w").alias("dim"))


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From rows x with last component ``extra`` to the pivots, which have theirs within."""
    full = np.column_stack((x.astype(np.float64), extra))
    square = (full**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _summary(pivots: np.ndarray, top: float, step: int) -> Callable:
    def summarize(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: list[list[float]] = [[] for _ in pivots]
        count, most = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        for part in parts:
            x = _matrix(part["q"], pivots.shape[1] - 1)
            d = _distances(x, np.sqrt(np.maximum(0, top - part["n2"].to_numpy())), pivots)
            cell = d.argmin(axis=1)
            for j in np.unique(cell):
                near[j] = np.sort(np.concatenate((near[j], d[cell == j, j])))[: K + 1].tolist()
            asks = part["asks"].to_numpy()
            if asks.any():
                d = _distances(x[asks], np.zeros(asks.sum()), pivots)
                cell = d.argmin(axis=1)
                count += np.bincount(cell, minlength=len(pivots))
                np.maximum.at(most, cell, d.min(axis=1))
        yield pd.DataFrame({"cell": np.arange(len(pivots)), "n": count, "most": most, "near": near})

    return summarize


def _merged(part: pd.DataFrame) -> pd.DataFrame:
    near = np.sort(np.concatenate([np.asarray(x, float) for x in part["near"]]))[: K + 1]
    return pd.DataFrame({"cell": part["cell"].iloc[:1], "n": [part["n"].sum()], "most": [part["most"].max()], "near": [near.tolist()]})


def _reach(pivots: np.ndarray, most: np.ndarray, near: list) -> np.ndarray:
    """For each cell the (K + 1)-th smallest bound of a distance from its queries: some cells at a time, so
    that memory is that of ``_ROWS`` x pivots at most."""
    nearest = np.full((len(pivots), K + 1), np.inf)
    for j, own in enumerate(near):
        nearest[j, : len(own)] = own
    square, reach = (pivots**2).sum(axis=1), np.empty(len(pivots))
    step = max(1, _ROWS // (K + 1))
    for at in range(0, len(pivots), step):
        own = slice(at, at + step)
        between = np.sqrt(np.maximum(square[own, None] + square[None, :] - 2 * pivots[own] @ pivots.T, 0))
        bound = (between[:, :, None] + nearest[None, :, :]).reshape(len(between), -1)
        reach[own] = most[own] + np.partition(bound, K, axis=1)[:, K]
    return reach * (1 + 1e-9) + 1e-6


def _blocks(count: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """First block and number of blocks of each cell, the cells in the order of their blocks, and the number of
    all blocks. Cells follow one another from nearest to nearest, so that those that share a block are near each other."""
    first, many, left, block, held = np.zeros(len(count), int), np.ones(len(count), int), np.ones(len(count), bool), 0, 0
    now, order = 0, []
    while left.any():
        now = int(np.where(left, ((pivots - pivots[now]) ** 2).sum(axis=1), np.inf).argmin())
        left[now] = False
        # Cells without queries may share a block, but not with a cell that has several.
        if order and first[order[-1]] == block and held + count[now] > BLOCK:
            block, held = block + 1, 0
        order.append(now)
        first[now] = block
        if count[now] > BLOCK:
            many[now] = -(-count[now] // BLOCK)
            block, held = block + many[now], 0
        else:
            held += count[now]
    return first, many, np.array(order), int((first + many).max())


class _Deal:
    """Which blocks a data vector goes to, and which one a query."""

    def __init__(self, pivots: np.ndarray, top: float, most: np.ndarray, reach: np.ndarray, count: np.ndarray):
        self.pivots, self.top, self.most, self.reach = pivots, top, most, reach
        self.some = count > 0
        self.first, self.many, self.order, self.n_blocks = _blocks(count, pivots)
        # A block is a run of cells in this order, or one of several of a single cell.
        self.starts = np.searchsorted((self.first + self.many)[self.order], np.arange(self.n_blocks), "right")

    def data(self, part: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``part`` and the blocks they go to, some rows at a time."""
        for at in range(0, len(part), _ROWS):
            own = part.iloc[at : at + _ROWS]
            d = _distances(_matrix(own["q"], self.pivots.shape[1] - 1), np.sqrt(np.maximum(0, self.top - own["n2"].to_numpy())), self.pivots)
            met = ((d - self.most[None, :] <= self.reach[None, :]) & self.some[None, :])[:, self.order]
            row, block = np.nonzero(np.logical_or.reduceat(met, self.starts, axis=1))
            yield row + at, block

    def queries(self, part: pd.DataFrame, asks: np.ndarray) -> np.ndarray:
        x = _matrix(part["q"].iloc[asks], self.pivots.shape[1] - 1)
        cell = _distances(x, np.zeros(len(asks)), self.pivots).argmin(axis=1)
        return self.first[cell] + (part["salt"].to_numpy()[asks] >> 20) % self.many[cell]


def _counter(deal: _Deal) -> Callable:
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(deal.n_blocks, np.int64)
        for part in parts:
            for _, block in deal.data(part):
                found += np.bincount(block, minlength=deal.n_blocks)
        yield pd.DataFrame({"block": np.arange(deal.n_blocks), "n": found})

    return count


def _dealer(deal: _Deal, splits: np.ndarray) -> Callable:
    base = np.cumsum(splits) - splits

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            salt = part["salt"].to_numpy()
            for row, block in deal.data(part):
                yield part.iloc[row][["vec_id", "q"]].assign(task=base[block] + salt[row] % splits[block], asks=False)
            asks = np.flatnonzero(part["asks"].to_numpy())
            if len(asks):
                block = deal.queries(part, asks)
                n = splits[block]
                task = np.repeat(base[block] - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield part.iloc[np.repeat(asks, n)][["vec_id", "q"]].assign(task=task, asks=True)

    return dealt


def _solver(width: int) -> Callable:
    def solve(part: pd.DataFrame) -> pd.DataFrame:
        asks = part["asks"].to_numpy()
        data = part[~asks].sort_values(["vec_id", "q"], ignore_index=True)
        # Equal queries are solved once; how many there are is known where they are merged.
        ask = part[asks].drop_duplicates(["vec_id", "q"])
        q, s = _matrix(ask["q"], width), _matrix(data["q"], width)
        ids, same_q, same_s = data["vec_id"].to_numpy(np.int64), ask["q"].tolist(), data["q"].tolist()
        large = float(abs(q).max(initial=0)) * float(abs(s).max(initial=0)) * width >= 2**53
        q, s = (q, s) if large else (q.astype(np.float64), s.astype(np.float64))
        rows, scores = [], q @ s.T
        floor = np.partition(scores, -K - 1, axis=1)[:, -K - 1] if len(ids) > K + 1 else np.zeros(len(ask))
        for own, score, least, name in zip(ask["vec_id"].to_numpy(np.int64), scores, floor, same_q):
            if len(score) > K + 1:
                over = np.flatnonzero(score > least)
                take = np.concatenate((over, np.flatnonzero(score == least)[: K + 1 - len(over)]))
            else:
                take = np.arange(len(score))
            rows += [(own, name, ids[k], int(score[k]), bool(ids[k] == own and same_s[k] == name)) for k in take.tolist()]
        found = pd.DataFrame(rows, columns=["query_id", "q", "vec_id", "score", "own"])
        return found.astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "own": bool})

    return solve


def top_k(vectors: DataFrame, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``K`` best of each row whose vec_id ``step`` divides."""
    spark = vectors.sparkSession
    asks = (F.col("vec_id") % step == 0) & (F.col("vec_id") != int(_NULL_ID))
    held = written(quantized(vectors).withColumns({"asks": asks, "salt": F.xxhash64("vec_id", "q").bitwiseAND((1 << 62) - 1)}), "vectors")
    n, top, width = held.agg(F.count(F.lit(1)), F.max("n2"), F.max("dim")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = held.orderBy("salt", "vec_id").limit(int(min(MOST_PIVOTS, max(PIVOTS, n**0.5)))).select("q", "n2").toPandas()
    pivots = np.column_stack((_matrix(chosen["q"], width).astype(np.float64), np.sqrt(np.maximum(0, top - chosen["n2"].to_numpy()))))

    kind = "cell int, n long, most double, near array<double>"
    cells = held.mapInPandas(_summary(pivots, top, step), kind).groupBy("cell").applyInPandas(_merged, kind).toPandas().sort_values("cell")
    count, most = cells["n"].to_numpy(), cells["most"].to_numpy()
    reach = _reach(pivots, most, list(cells["near"]))
    deal = _Deal(pivots, top, most, reach, count)
    held_by = {r["block"]: r["n"] for r in held.mapInPandas(_counter(deal), "block int, n long").groupBy("block").agg(F.sum("n").alias("n")).collect()}
    splits = np.array([max(1, -(-held_by.get(b, 0) // SPLIT)) for b in range(deal.n_blocks)])
    dealt = held.mapInPandas(_dealer(deal, splits), "vec_id long, q binary, task long, asks boolean")
    found = dealt.groupBy("task").applyInPandas(_solver(width), "query_id long, q binary, vec_id long, score long, own boolean")

    query = ["query_id", "q"]
    best = [F.desc("score"), F.col("vec_id")]
    close = found.withColumn("at", F.row_number().over(Window.partitionBy(*query).orderBy(*best))).filter(F.col("at") <= K + 1)
    # A query's own row is left out once; further rows like it are candidates.
    close = close.withColumn("nth", F.row_number().over(Window.partitionBy(*query, "own").orderBy("at"))).filter("NOT (own AND nth = 1)")
    close = close.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy("at")).cast("int")).filter(F.col("rank") <= K)
    times = held.filter("asks").groupBy(F.col("vec_id").alias("query_id"), "q").agg(F.count(F.lit(1)).cast("int").alias("times"))
    close = close.join(times, query).withColumn("_", F.explode(F.sequence(F.lit(1), "times")))
    return close.select("query_id", "rank", F.when(F.col("vec_id") != int(_NULL_ID), F.col("vec_id")).alias("vec_id"), "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERY = ("op2_topk_search", op2_topk_search)
SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.rid, q.vec_id AS query_id, s.vec_id, list_sum(list_transform(range(1, least(len(q.w), len(s.w)) + 1), lambda i: q.w[i] * s.w[i]))::BIGINT AS score
  FROM v q JOIN v s ON q.rid <> s.rid WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM pairs)
WHERE rank <= {K}
"""
