"""Centroid clustering: Lloyd's rounds under Drake's adaptive bounds.

Every vector keeps its cluster, an upper bound of the distance to that centroid, its several nearest other
centroids with a lower bound of the distance to each, in order, and one more bound for all the rest
(Drake and Hamerly, Accelerated k-means with adaptive distance bounds, 2012). A round

1. moves the bounds by what each centroid moved (the rest by the largest move) and evens them out, so
   that they rise along the list;
2. finds the first bound that the upper bound is below. Centroids from there on cannot be nearest: if it is the
   first of the list, the cluster stays and nothing is computed but the own distance; else only the
   centroids before it are measured again, and put in order;
3. scans all centroids where even the bound of the rest does not certify the order, and makes the list anew.

The list starts with a quarter of the centroids and shrinks to one more than any vector needed in the round
before, an eighth at least: bounds that leave the list go into the bound of the rest.

Components are integers and squared distances exact. Bounds are distances in doubles, with a slack far
above their rounding; the order is certified only where an upper bound is strictly below, so ties are always
measured and go to the smaller number.

On Spark: the vectors with their state are a written table of the shared folder; a round is one pass that reads
it and writes the next, together with one row of sums for each cluster and task. Sums are merged by an
aggregate, centroids (``K`` vectors) are all that comes to the driver. Nothing is keyed by cluster or
vector, so copies and large clusters cannot make a task large. The table before last is deleted.

Defined cases. Vectors that are null, of another length than ``WIDTH``, or hold a null or non-finite component
take no part. Fewer vectors than centroids: each vector starts one. Null vec_id: takes part, as a first
centroid after all others. Equal vec_ids: each row takes part; first centroids then in the order of their
components. Repeated rows: each counts. Ties: the smaller cluster. Empty clusters stay where they are. Values
too large for exact 64-bit distances are computed as Python integers, and distances beyond a long are
given as the largest long. An empty table: an empty result. Columns other than vec_id and embedding aren't
used, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.common import dropped, table, written

WIDTH, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, 2
_ROWS = 4096
#: The relative and absolute slack of bounds.
_SLACK, _LEAST = 1e-9, 1e-6
_MOST = np.iinfo(np.int64).max
#: Added to components, so that packed vectors sort like their components.
_SHIFT = 1 << 15
#: Sums are added up in parts of 24 digits, so that decimals of 38 hold them.
_PART = 10**24


@dataclass(frozen=True)
class Round:
    centroids: np.ndarray  # K x width, int64 or Python integers
    moved: np.ndarray  # upper bounds of how far each moved since the last round
    keep: int  # bounds kept besides that of the rest
    last: bool = False


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the row or rows c, by broadcasting."""
    difference = x - c
    return (difference * difference).sum(axis=-1)


def _all_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of c: a matrix product where doubles are exact."""
    if x.dtype == object or c.dtype == object:
        return np.stack([_square(x, row) for row in c], axis=1)
    if 4 * x.shape[1] * int(max(abs(x).max(initial=0), abs(c).max(initial=0))) ** 2 < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T).astype(np.int64)
    return np.stack([_square(x, row) for row in c], axis=1)


def _root(square: np.ndarray) -> np.ndarray:
    if square.dtype != object:
        return np.sqrt(square.astype(np.float64))
    # Squares may be beyond a double where their roots are not.
    return np.array([math.sqrt(v) if v < 1 << 1000 else float(math.isqrt(v)) for v in square.ravel().tolist()]).reshape(square.shape)


def _up(distance: np.ndarray) -> np.ndarray:
    return distance * (1 + _SLACK) + _LEAST


def _down(distance: np.ndarray) -> np.ndarray:
    return distance * (1 - _SLACK) - _LEAST


class State:
    """Cluster, upper bound, list of other centroids and their lower bounds (one more: the rest's) of some vectors."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray):
        self.cluster, self.upper, self.near, self.lower = cluster, upper, near, lower

    @classmethod
    def scanned(cls, x: np.ndarray, c: np.ndarray, keep: int) -> State:
        """By a scan of all centroids."""
        squares = _all_squares(x, c)
        order = np.argsort(squares, axis=1, kind="stable")
        ranked = _root(np.take_along_axis(squares, order, axis=1))
        rest = ranked[:, keep + 1] if len(c) > keep + 1 else np.full(len(x), np.inf)
        return cls(order[:, 0].astype(np.int64), _up(ranked[:, 0]), order[:, 1 : keep + 1].astype(np.int64), _down(np.column_stack((ranked[:, 1 : keep + 1], rest))))

    def take(self, rows: np.ndarray) -> State:
        return State(self.cluster[rows], self.upper[rows], self.near[rows], self.lower[rows])

    def put(self, rows: np.ndarray, new: State) -> None:
        self.cluster[rows], self.upper[rows], self.near[rows], self.lower[rows] = new.cluster, new.upper, new.near, new.lower

    def shrink(self, keep: int) -> None:
        """Bounds beyond ``keep`` go into that of the rest."""
        if keep < self.near.shape[1]:
            self.near = self.near[:, :keep]
            self.lower = np.column_stack((self.lower[:, :keep], self.lower[:, keep:].min(axis=1)))

    def move(self, moved: np.ndarray) -> None:
        self.upper = _up(self.upper + moved[self.cluster])
        self.lower = _down(self.lower - np.column_stack((moved[self.near], np.full(len(self.near), moved.max(initial=0)))))
        # A bound holds for its own centroid and all behind it in the list.
        self.lower = np.minimum.accumulate(self.lower[:, ::-1], axis=1)[:, ::-1]

    def needed(self) -> np.ndarray:
        """How many centroids of the list are to be measured; one more than it has: all centroids."""
        certified = self.upper[:, None] < self.lower
        return np.where(certified.any(axis=1), certified.argmax(axis=1), self.lower.shape[1])


def assigned(x: np.ndarray, state: State, now: Round) -> tuple[State, int]:
    """The state after a round, and the largest number of bounds that a vector needed."""
    c = now.centroids
    state.shrink(now.keep)
    state.move(now.moved)
    # With the own distance measured, most bounds certify at once.
    loose = np.flatnonzero(state.needed() > 0)
    if len(loose):
        state.upper[loose] = _up(_root(_square(x[loose], c[state.cluster[loose]])))
    need, most = state.needed(), 0
    wide = np.flatnonzero(need > state.near.shape[1])
    if len(wide):
        most = state.near.shape[1]
        state.put(wide, State.scanned(x[wide], c, state.near.shape[1]))
    for n in np.unique(need[(need > 0) & (need <= state.near.shape[1])]).tolist():
        rows = np.flatnonzero(need == n)
        most = max(most, n)
        named = np.column_stack((state.cluster[rows], state.near[rows, :n]))
        squares = np.stack([_square(x[rows], c[named[:, j]]) for j in range(n + 1)], axis=1)
        # Ties go to the smaller number: order by number first, then stably by distance.
        by_name = np.argsort(named, axis=1, kind="stable")
        named, squares = np.take_along_axis(named, by_name, axis=1), np.take_along_axis(squares, by_name, axis=1)
        order = np.argsort(squares, axis=1, kind="stable")
        named, ranked = np.take_along_axis(named, order, axis=1), _root(np.take_along_axis(squares, order, axis=1))
        state.cluster[rows], state.upper[rows] = named[:, 0], _up(ranked[:, 0])
        state.near[rows, :n] = named[:, 1:]
        # What is measured is not above the bound behind it, which holds for all that follow.
        state.lower[rows, :n] = np.minimum(_down(ranked[:, 1:]), state.lower[rows, n][:, None])
    return state, most


_FIELDS = pa.schema([("vec_id", pa.int64()), ("q", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()), ("near", pa.binary()), ("lower", pa.binary()), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("need", pa.int32())])
_STATE = "vec_id long, q binary, cluster int, upper double, near binary, lower binary, distance long, n long, sums array<string>, need int"


def _bytes(rows: np.ndarray) -> list[bytes]:
    flat, width = np.ascontiguousarray(rows).tobytes(), rows.shape[1] * rows.dtype.itemsize
    return [flat[k * width : (k + 1) * width] for k in range(len(rows))]


def _whole(packed: list[bytes], width: int) -> np.ndarray:
    """Vectors of packed integers: rows of int64, or of Python integers if one is large."""
    if all(len(v) == 2 * width for v in packed):
        return np.frombuffer(b"".join(packed), ">u2").reshape(-1, width).astype(np.int64) - _SHIFT
    rows = [np.array([int(t) for t in v[2 * width + 1 :].decode().split(",")], object) if len(v) > 2 * width else np.frombuffer(v, ">u2").astype(object) - _SHIFT for v in packed]
    held = np.stack(rows)
    return held if abs(held).max() > 1 << 27 else held.astype(np.int64)


def quantized(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and q of the vectors that take part: components as 16-bit integers, or zeros and decimals with commas where they need more."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.asarray(part.column(1).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, width)
            fine = np.isfinite(x).all(axis=1)
            x = x[fine]
            with np.errstate(over="ignore"):
                whole = np.floor(x * scale)
            small = (abs(whole) < _SHIFT).all(axis=1)
            q: list = [None] * len(x)
            for k, v in zip(np.flatnonzero(small), _bytes((whole[small] + _SHIFT).astype(">u2"))):
                q[k] = v
            for k in np.flatnonzero(~small):
                # Doubles from 2^53 on are integers, whose product may be beyond a double.
                decimals = ",".join(str(int(v) * scale if abs(v) >= 2**53 else int(np.floor(v * scale))) for v in x[k].tolist())
                q[k] = bytes(2 * width) + b"," + decimals.encode()
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(fine)), pa.array(q, pa.binary())], ["vec_id", "q"])

    whole = vectors.filter(F.size("embedding") == width).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return whole.mapInArrow(pack, "vec_id long, q binary")


def first_centroids(held: DataFrame, k: int = K, seed: int = SEED, width: int = WIDTH) -> np.ndarray:
    """The vectors with the smallest hashes of seed and vec_id, in their order: ``k`` rows at most."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = held.select("q", mark.alias("mark")).orderBy(F.col("mark").asc_nulls_last(), "q").limit(k).collect()
    return _whole([bytes(r["q"]) for r in rows], width) if rows else np.zeros((0, width), np.int64)


def _sums(x: np.ndarray, cluster: np.ndarray, totals: dict[int, list]) -> None:
    for j in np.unique(cluster).tolist():
        own = x[cluster == j]
        n, total = totals.get(j, (0, 0))
        totals[j] = (n + len(own), total + own.sum(axis=0).astype(object))


def _parts(total: np.ndarray) -> list[str]:
    """The lowest parts of all components, then the next ones, as far as any has digits."""
    found, left = [], [(abs(int(v)), 1 if v >= 0 else -1) for v in total]
    while not found or any(v for v, _ in left):
        found += [str(sign * (v % _PART)) for v, sign in left]
        left = [(v // _PART, sign) for v, sign in left]
    return found


def _pass(now: Round, width: int, first: bool) -> Callable:
    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        most, blank = 0, [None]
        for part in parts:
            for at in range(0, len(part), _ROWS):
                own = part.slice(at, _ROWS)
                q = own.column("q").to_pylist()
                x = _whole(q, width)
                if first:
                    state = State.scanned(x, now.centroids, now.keep)
                else:
                    lower = np.frombuffer(b"".join(own.column("lower").to_pylist()), "<f8").reshape(len(x), -1)
                    near = np.frombuffer(b"".join(own.column("near").to_pylist()), "<u2").reshape(len(x), lower.shape[1] - 1)
                    state, needed = assigned(x, State(own.column("cluster").to_numpy().astype(np.int64), own.column("upper").to_numpy().copy(), near.astype(np.int64), lower.copy()), now)
                    most = max(most, needed)
                _sums(x, state.cluster, totals)
                distance = [min(int(d), _MOST) for d in _square(x, now.centroids[state.cluster])] if now.last else blank * len(x)
                bounds = (blank * len(x), blank * len(x)) if now.last else (_bytes(state.near.astype("<u2")), _bytes(state.lower.astype("<f8")))
                yield pa.RecordBatch.from_arrays(
                    [own.column("vec_id"), own.column("q"), pa.array(state.cluster, pa.int32()), pa.array(state.upper), *(pa.array(b, pa.binary()) for b in bounds), pa.array(distance, pa.int64()), *(pa.nulls(len(x), _FIELDS.field(c).type) for c in ("n", "sums", "need"))], schema=_FIELDS
                )
        rows = [{"cluster": j, "n": n, "sums": _parts(total), "need": most} for j, (n, total) in totals.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _FIELDS)

    return go


def _merged(state: DataFrame, before: np.ndarray) -> tuple[np.ndarray, int]:
    """The means of the clusters, rounded down, and the largest need."""
    total = state.filter("n IS NOT NULL").select("cluster", "n", "need", F.posexplode("sums").alias("at", "v"))
    total = total.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.max("need").alias("need"), F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v"))
    new, most, width, sums, count = before.astype(object), 0, before.shape[1], {}, {}
    for r in total.collect():  # clusters times components, whatever the number of vectors
        at = (r["cluster"], r["at"] % width)
        sums[at] = sums.get(at, 0) + int(r["v"]) * _PART ** (r["at"] // width)
        # A task leaves out parts that none of its sums has; the first ones are there always.
        count[at], most = max(count.get(at, 0), r["n"]), max(most, r["need"])
    for at, v in sums.items():
        new[at] = v // count[at]
    return (new if abs(new).max() > 1 << 27 else new.astype(np.int64)), most


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` (squared) of the vectors that take part, and the final centroids."""
    spark = vectors.sparkSession
    held = written(quantized(vectors, width), "vectors")
    centroids = first_centroids(held, k, seed, width)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    others = len(centroids) - 1
    keep, least = min(others, -(-k // 4)), min(others, -(-k // 8))
    moved = np.zeros(len(centroids))
    for n in range(rounds + 1):
        now = Round(centroids, moved, keep, n == rounds)
        state = written(held.mapInArrow(_pass(now, width, n == 0), _STATE), "bounds")
        dropped(held)
        held = state.filter("n IS NULL")
        if n < rounds:
            centroids, need = _merged(state, centroids)
            moved = _up(_root(_square(centroids, now.centroids)))
            keep = keep if n == 0 else max(least, min(keep, need + 1))
    return held.select("vec_id", "cluster", "distance"), centroids


def op11_drake_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    # One row a cluster: K at most, whatever the number of vectors.
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = min(sum(sums.values()), _MOST)
    rows = [(j, min(d, _MOST), whole, ",".join(str(int(v)) for v in centroids[j])) for j, d in sums.items()]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    clusters = clusters.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Lloyd's rounds without bounds, one after the other."""
    square = "list_sum(list_transform(range(1, {w} + 1), lambda i: (v.w[i] - c.w[i]) * (v.w[i] - c.w[i])))".format(w=WIDTH)
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, w) - 1)::INTEGER AS j, w FROM v QUALIFY j < {K})""",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT rid, min_by(j, (d, j)) AS j, min(d)::BIGINT AS d FROM (SELECT v.rid, c.j, {square} AS d FROM v CROSS JOIN c{n} c) GROUP BY rid)""")
        if n < ROUNDS:
            steps.append(f"""m{n} AS MATERIALIZED (
  SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS w FROM (
    SELECT j, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT a.j, unnest(v.w) AS x, generate_subscripts(v.w, 1) AS i FROM v JOIN a{n} a USING (rid)) GROUP BY j, i) GROUP BY j),
c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.w, c.w) AS w FROM c{n} c LEFT JOIN m{n} m ON c.j = m.j)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, j AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} USING (rid) JOIN c{ROUNDS} c USING (j)
"""


QUERY = ("op11_drake_kmeans", op11_drake_kmeans)
SQL = _sql()
