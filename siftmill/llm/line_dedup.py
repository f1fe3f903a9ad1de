"""Repeated lines: two Bloom filters find suspects, exact counts decide.

1. A line's key is the line stripped of the six spaces at both ends with A-Z lower-cased; keys of
   ``LEAST_CHARS`` code points or more count. Each task puts the keys of its documents into a pair of
   Bloom filters, once seen and twice seen, each document's distinct keys once. Pairs are merged bit by bit:
   the twice-seen bits of both, and those that are once seen in both, are twice seen. The pairs are
   merged per segment of ``SEGMENT`` bits, so no task holds all pairs. A key of two documents is twice
   seen for certain; some others are by chance.
2. The twice-seen filter goes to every task. Its size follows the number of lines, ``BITS_A_LINE`` each, up
   to ``MOST_BITS`` (64 MB), which bounds what is broadcast. Beyond that the filter lets more keys through,
   which are then shuffled in vain; results stay the same. Texts are written with their suspected keys.
3. Suspected keys alone are shuffled, as 128-bit hashes, and counted by distinct doc_id. Those of
   ``LEAST_DOCS`` documents or more lose their lines in all but the largest doc_id. The counts are partial
   aggregates, so that a key of a third of all documents is one row a task; it goes back to its rows by a
   broadcast, as less than ``MOST_HOT`` keys can be so frequent, while the others are joined.
4. Documents without suspects are done where they are read; the others meet the keys they lose.

What stays is the last occurrence, as the contract asks; ``keep="first"`` keeps the smallest doc_id.

Defined cases. Null or empty text: one empty line; the text that is left is empty. A text that loses all
its lines is empty. Repeated rows and rows of one doc_id: one document for the counts, each row loses or
keeps its lines alike; rows without doc_id are one document, which never is the one that keeps. Ties: there are none, as
ids that hold a key are distinct. Very long lines and texts: whole. An empty table: an empty result.
Further columns are kept; of columns named like a result column, the result's value stays.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.common import table, written

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Of each filter. Two bits a key: at 8 bits a line about 5 % of the other keys are suspected by chance.
BITS_A_LINE, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 29
SEGMENT = 1 << 20
#: Keys with more than one part in so many of all counts meet their rows by a broadcast.
MOST_HOT = 1000
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes that continue a code point.
_LATER = bytes(range(0x80, 0xC0))

RESULT = ("n_lines", "n_dropped")


def key_of(line: bytes) -> bytes | None:
    """The key of a line in UTF-8; None if it is shorter than ``LEAST_CHARS``."""
    if len(line) < LEAST_CHARS:
        return None
    key = line.strip(SPACES).lower()  # bytes: A-Z alone
    # A code point has four bytes at most.
    short = len(key) < LEAST_CHARS or (len(key) < 4 * LEAST_CHARS and not key.isascii() and len(key.translate(None, _LATER)) < LEAST_CHARS)
    return None if short else key


def _hashes(text: bytes | None) -> set[bytes]:
    return {xxhash.xxh3_128_digest(key) for line in (text or b"").split(b"\n") if (key := key_of(line)) is not None}


def _places(hashes: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each 16-byte hash."""
    both = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2) & np.uint64(bits - 1)
    return both[:, 0].astype(np.int64), both[:, 1].astype(np.int64)


def _set(bitmap: np.ndarray, places: np.ndarray) -> None:
    if len(places):
        places = np.unique(places)
        at = places >> 3
        first = np.flatnonzero(np.diff(at, prepend=-1))
        bitmap[at[first]] |= np.bitwise_or.reduceat((1 << (places & 7)).astype(np.uint8), first)


def _has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


class Filters:
    """Bits of the keys seen once, and of those seen twice."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: list[bytes]) -> None:
        """Hashes of several documents, each document's once."""
        if not hashes:
            return
        a, b = _places(hashes, self.bits)
        _, first, back = np.unique(np.column_stack((a, b)), axis=0, return_index=True, return_inverse=True)
        again = np.bincount(back.ravel()) > 1
        a, b = a[first], b[first]
        again |= _has(self.once, a) & _has(self.once, b)
        _set(self.twice, np.concatenate((a[again], b[again])))
        _set(self.once, np.concatenate((a, b)))

    def merge(self, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice |= twice | (self.once & once)
        self.once |= once


def _counted(bits: int) -> Callable:
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(bits)
        for part in parts:
            held: list[bytes] = []
            for text in part.column(0):
                held += _hashes(text.as_py())
                if len(held) >= 1 << 16:
                    own.add(held)
                    held = []
            own.add(held)
        width = SEGMENT // 8
        for k in range(bits // SEGMENT):
            once, twice = (x[k * width : (k + 1) * width] for x in (own.once, own.twice))
            if once.any():
                yield pa.RecordBatch.from_pydict({"segment": [k], "once": [zlib.compress(once, 1)], "twice": [zlib.compress(twice, 1)]}, pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    return count


def _merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own: dict[int, Filters] = {}
    for part in parts:
        for segment, once, twice in zip(*(c.to_pylist() for c in part.columns)):
            held = own.setdefault(segment, Filters(SEGMENT))
            held.merge(*(np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice)))
    for segment, held in own.items():
        if held.twice.any():
            yield pa.RecordBatch.from_pydict({"segment": [segment], "twice": [zlib.compress(held.twice, 1)]}, pa.schema([("segment", pa.int32()), ("twice", pa.binary())]))


def filter_bits(docs: DataFrame) -> int:
    """The size of a filter by an upper bound of the number of lines that count."""
    text = F.coalesce("text", F.lit(""))
    octets = F.octet_length(text).cast("long")
    lines = octets - F.octet_length(F.replace(text, F.lit("\n"))) + 1
    most = docs.agg(F.sum(F.least(lines, F.floor(octets / LEAST_CHARS)))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (int(most) * BITS_A_LINE - 1).bit_length() if most else 0))


def twice_seen(docs: DataFrame, bits: int) -> dict[int, bytes]:
    """The segments of the twice-seen filter of ``docs`` that have bits, compressed; ``bits / 8`` bytes at most."""
    pairs = docs.select(F.col("text").cast("binary")).mapInArrow(_counted(bits), "segment int, once binary, twice binary")
    return dict(pairs.repartition("segment").mapInArrow(_merged, "segment int, twice binary").collect())


def _suspects(spark: SparkSession, segments: dict[int, bytes], bits: int) -> Callable:
    sent = spark.sparkContext.broadcast(segments)

    @F.pandas_udf("n_lines long, found array<binary>")
    def suspects(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        twice = np.zeros(bits // 8, np.uint8)
        for k, segment in sent.value.items():
            twice[k * (SEGMENT // 8) : (k + 1) * (SEGMENT // 8)] = np.frombuffer(zlib.decompress(segment), np.uint8)
        for texts in parts:
            n_lines, found = [], []
            for text in texts:
                own = list(_hashes(text))
                n_lines.append((text or b"").count(b"\n") + 1)
                if own:
                    a, b = _places(own, bits)
                    own = [own[k] for k in np.flatnonzero(_has(twice, a) & _has(twice, b))]
                found.append(own or None)
            yield pd.DataFrame({"n_lines": n_lines, "found": found})

    return suspects


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_dropped", T.LongType())]))
def _left(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, drops in parts:
        left, n = [], []
        for text, drop in zip(texts, drops):
            if drop is None:
                left.append(None)
                n.append(0)
                continue
            gone, lines = set(drop), text.split(b"\n")
            stay = [x for x in lines if (key := key_of(x)) is None or xxhash.xxh3_128_digest(key) not in gone]
            left.append(b"\n".join(stay).decode("utf-8", "replace"))
            n.append(len(lines) - len(stay))
        yield pd.DataFrame({"text": left, "n_dropped": n})


def without_repeated_lines(docs: DataFrame, keep: str = "last") -> DataFrame:
    """``docs`` (doc_id, text, ...) with the lines that stay as text, n_lines (before) and n_dropped."""
    spark, order = docs.sparkSession, F.max if keep == "last" else F.min
    docs = docs.drop(*[c for c in docs.columns if c in RESULT or c.startswith("_l_")])
    bits = filter_bits(docs)
    suspects = _suspects(spark, twice_seen(docs, bits), bits)
    held = docs.withColumns({"_l_row": F.monotonically_increasing_id(), "_l_own": suspects(F.col("text").cast("binary"))})
    # The written table fixes the row numbers; a plan read again could number them otherwise.
    held = written(held.select(*docs.columns, "_l_row", F.col("_l_own.n_lines").alias("n_lines"), F.col("_l_own.found").alias("_l_found")), "suspected-lines")

    each = held.filter("_l_found IS NOT NULL").select("_l_row", F.col("doc_id").alias("_l_id"), F.explode("_l_found").alias("_l_key"))
    repeats = each.select("_l_key", "_l_id").distinct().groupBy("_l_key").agg(F.count(F.lit(1)).alias("n"), order("_l_id").alias("_l_keeper")).filter(F.col("n") >= LEAST_DOCS)
    repeats = written(repeats, "repeated-lines")
    # Keys of over a thousandth of all counts are less than a thousand, so they can go to every task;
    # the others' rows make no task large.
    total = repeats.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * MOST_HOT > total
    marked = each.join(F.broadcast(repeats.filter(hot).drop("n")), "_l_key", "left")
    cold = marked.filter("_l_keeper IS NULL").drop("_l_keeper").join(repeats.filter(~hot).drop("n"), "_l_key")
    lost = marked.filter("_l_keeper IS NOT NULL").unionByName(cold).filter(~F.col("_l_id").eqNullSafe(F.col("_l_keeper")))
    drops = lost.groupBy("_l_row").agg(F.collect_list("_l_key").alias("_l_drops"))

    met = held.filter("_l_found IS NOT NULL").join(drops, "_l_row", "left")
    met = met.withColumn("_l_new", _left(F.when(F.col("_l_drops").isNotNull(), F.col("text").cast("binary")), "_l_drops"))
    met = met.withColumns({"text": F.coalesce("_l_new.text", "text"), "n_dropped": F.col("_l_new.n_dropped")})
    clean = held.filter("_l_found IS NULL").withColumns({"text": F.coalesce("text", F.lit("")), "n_dropped": F.lit(0).cast("long")})
    names = [*docs.columns, *RESULT]
    return clean.select(names).unionByName(met.select(names))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERY = ("op12_line_dedup", op12_line_dedup)
SQL = rf"""
WITH l AS (
  SELECT rid, doc_id, pos, line, lower_key AS key FROM (
    SELECT rid, doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
          FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))),
repeats AS (
  SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT key, doc_id FROM l WHERE length(key) >= {LEAST_CHARS}) GROUP BY key HAVING count(*) >= {LEAST_DOCS}),
judged AS (SELECT l.*, r.key IS NOT NULL AND l.doc_id IS DISTINCT FROM r.keeper AS gone FROM l LEFT JOIN repeats r ON l.key = r.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid
"""
