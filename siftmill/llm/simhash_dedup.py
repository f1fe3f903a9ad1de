"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints: words are runs of non-space bytes of the lower-cased (A-Z) text, shingles are four
words joined by a space, hashed with XXH64 (seed 42); a bit is set if over half the shingles set it.

Comparison. Distinct fingerprints, not documents, are compared. They are dealt into G groups by
hash; a task holds two groups and compares every fingerprint of one with the other's, so each is
sent G times and no group of copies makes a task large. Within a task fingerprints are sorted into
tiles of equal population counts of their four quarters. The sum over the quarters of the counts'
differences bounds the distance from below, so tile pairs for which it exceeds the radius are
skipped (about 93 % of the pairs of random fingerprints; the whole word's count alone would skip
45 %); the other pairs are compared with numpy exclusive-or and bit counts. All links are found. A
task returns a spanning forest of its links, never the pairs of a group.

The work of the comparison grows with the square of the distinct fingerprints, at about 0.15 ns a
pair; at 10^8 distinct fingerprints that is some 400 core hours.

Defined cases. Null or empty text, or one without words: fingerprint zero, linked like any other.
Fewer than four words: one shingle of them all. Repeated shingles count again. Very long texts: whole,
in memory of some ten times their size, as shingles are hashed some at a time. Repeated rows and
ties: each row gets its component. Null doc_id: the row takes part; the component's id is the
smallest non-null one, or null if there is none. An empty table: an empty result. Further columns
are kept; of columns named like a result column, the result's value stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.common import table, written
from siftmill.llm.components import connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Groups: at least LEAST_GROUPS (to spread the work), and so many that each holds GROUP_SIZE or fewer.
LEAST_GROUPS, GROUP_SIZE = 8, 1 << 20
_CHUNK = 255 * 256  # shingles hashed at once, so a long text needs little memory
_BLOCK = 1 << 22  # pairs compared at once

RESULT = ("fingerprint", "component_id")


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of UTF-8 bytes as an unsigned integer."""
    words = (text or b"").lower().split()  # bytes: A-Z alone, and the six spaces alone
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for k in range(0, n, _CHUNK):
        hashes = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[k : k + _CHUNK], stops[k : k + _CHUNK])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8))
        bits = np.concatenate((bits, np.zeros(-len(bits) % (255 * 64), np.uint8)))
        # Eight counters to a word, 255 rows at a time, so that none overflows.
        lanes = bits.view(np.uint64).reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
        counts += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _tiles(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints in the order of their tiles, and the tiles' codes in that order."""
    code = np.zeros(len(prints), np.int64)
    for shift in (48, 32, 16, 0):
        code = code * 32 + np.bitwise_count((prints >> np.uint64(shift)) & np.uint64(0xFFFF))
    order = np.argsort(code, kind="stable")
    return prints[order], code[order]


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """Differences of the first three quarters within the radius, and what is left for the fourth."""
    span = np.arange(-RADIUS, RADIUS + 1)
    a, b, c = (x.ravel() for x in np.meshgrid(span, span, span, indexing="ij"))
    left = RADIUS - abs(a) - abs(b) - abs(c)
    keep = left >= 0
    return ((a * 32 + b) * 32 + c)[keep] * 32, left[keep]


def links(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of fingerprints of ``a`` and ``b`` at ``RADIUS`` or fewer differing bits, in blocks."""
    (a, codes), (b, others) = _tiles(a), _tiles(b)
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    steps, left = _steps()
    base, last = codes[first][:, None] + steps[None, :], codes[first][:, None] % 32
    # A quarter's count is at most 16 of 32, so codes that leave its range meet no tile.
    low = np.searchsorted(others, base - np.minimum(left, last), "left")
    high = np.searchsorted(others, base + np.minimum(left, 31 - last), "right")
    for k, (i, j) in enumerate(zip(first, [*first[1:], len(a)])):
        some = np.flatnonzero(high[k] > low[k])
        if not len(some):
            continue
        near = np.concatenate([b[x:y] for x, y in zip(low[k, some].tolist(), high[k, some].tolist())])
        step = max(1, _BLOCK // len(near))
        for at in range(i, j, step):
            tile = a[at : min(at + step, j)]
            for cut in range(0, len(near), _BLOCK):
                x, y = np.nonzero(np.bitwise_count(tile[:, None] ^ near[None, cut : cut + _BLOCK]) <= RADIUS)
                if len(x):
                    yield tile[x], near[cut + y]


def forest(nodes: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges from nodes to the least node of their component under ``pairs``. nodes: sorted, distinct."""
    root = np.arange(len(nodes))
    for a, b in _gathered(pairs):
        x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
        while len(x):
            x, y = root[x], root[y]
            apart = x != y
            x, y = x[apart], y[apart]
            np.minimum.at(root, x, y)
            np.minimum.at(root, y, x)
            while not np.array_equal(root, nearer := root[root]):
                root = nearer
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in fewer, larger blocks."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= _BLOCK:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _compare(part: pd.DataFrame) -> pd.DataFrame:
    prints, group = part["fp"].to_numpy().view(np.uint64), part["g"].to_numpy()
    one = group == group.min()
    a = np.sort(prints[one])
    b = a if one.all() else np.sort(prints[~one])
    x, y = forest(np.unique(prints), links(a, b))
    return pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """From distinct ``fp`` (long): edges ``a, b`` whose components are those of all links."""
    n = prints.count()
    groups = max(LEAST_GROUPS, -(-n // GROUP_SIZE))
    g = F.pmod(F.xxhash64("fp"), F.lit(groups)).cast("int")
    dealt = prints.select("fp", g.alias("g")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.withColumn("pair", F.least("g", "k").cast("long") * groups + F.greatest("g", "k"))
    return dealt.groupBy("pair").applyInPandas(_compare, "a long, b long")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_h_fp``, written to the shared folder."""
    return written(_printed(docs), "fingerprints")


def _printed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_h_fp", _fingerprints(F.col("text").cast("binary")))


def _components(prints: DataFrame) -> DataFrame:
    """From rows of ``_h_fp, doc_id``: for each fingerprint ``fp, component_id, keeper`` (the
    fingerprint of the component that holds the row with its id)."""
    each = written(prints.groupBy(F.col("_h_fp").alias("fp")).agg(F.min("doc_id").alias("first")), "distinct-prints")
    roots = connected_components(fingerprint_links(each))
    each = each.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("best")
    by_root = each.groupBy("root").agg(best).select("root", F.col("best.first").alias("component_id"), F.col("best.fp").alias("keeper"))
    return each.join(by_root, "root").select("fp", "component_id", "keeper")


def link(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with fingerprint and component_id."""
    docs = docs.drop(*[c for c in docs.columns if c in RESULT or c.startswith("_h_")])
    return _linked(with_fingerprints(docs))


def _linked(held: DataFrame) -> DataFrame:
    parts = _components(held.select("_h_fp", "doc_id")).select(F.col("fp").alias("_h_print"), "component_id")
    found = held.join(parts, F.col("_h_fp") == F.col("_h_print"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("_h_fp"), 16, "0"))).select(*[c for c in held.columns if c != "_h_fp"], *RESULT)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest doc_id. Columns as they were."""
    printed = _printed(docs.select(F.struct(*docs.columns).alias("_d_own"), "doc_id", "text")).drop("text")
    # The written table fixes the row numbers, by which what stays is found without the texts.
    held = written(printed.withColumns({"_h_row": F.monotonically_increasing_id(), "_h_mark": F.xxhash64("_d_own")}), "fingerprints")
    parts = _components(held.select("_h_fp", "doc_id")).filter("fp = keeper").select("fp", "component_id")
    kept = held.drop("_d_own").join(parts, (F.col("_h_fp") == F.col("fp")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Repeated rows of the same id and text: any one; in the order of their values, so that reruns agree.
    order = Window.partitionBy("_h_fp", "doc_id").orderBy("_h_mark", "_h_row")
    stay = kept.withColumn("_h_no", F.row_number().over(order)).filter("_h_no = 1").select(F.col("_h_row").alias("_h_stays"))
    return held.join(stay, F.col("_h_row") == F.col("_h_stays")).select("_d_own.*")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = _printed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return _linked(written(prints, "fingerprints")).select("doc_id", *RESULT)


QUERY = ("op3_simhash_dedup", op3_simhash_dedup)
SQL = None
