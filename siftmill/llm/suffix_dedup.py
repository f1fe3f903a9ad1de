"""Removal of repeated 200-byte strings by suffix sorting of a collection.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus.

1. Texts are written once to the shared folder; a file and a row in it name a text from then on, so
   texts are never shuffled. Later steps send decisions to a file's task, which reads the file.
2. Each string of ``LENGTH`` bytes (window) has an anchor: the ``CORE`` bytes in it with the smallest
   hash, the leftmost of equals. Equal windows have equal anchors. Consecutive windows with the same
   anchor form a span. Anchors that occur once hold no repeated window and are dropped.
3. Of equal spans (by 64 bits of the anchor and 128 of the span) two go on, however many there are:
   what is told of them holds for all. So a group of copies is two rows per span.
4. The spans of an anchor are documents of a collection whose Burrows-Wheeler transform and common
   prefixes are built column by column: each round inserts one more symbol of every document, from the
   last column to the first (Bauer, Cox and Rosone, Lightweight Algorithms for Constructing and
   Inverting the BWT of String Collections, 2013; Cox et al., 2016, for the prefixes). Documents are
   aligned by their anchors, and windows that are equal lie in the same column, so a round needs the
   order of the round before alone (the positional form of the transform, Durbin, 2014). Columns of
   symbols are read from a sequential file in the shared folder, and each round's order and common
   prefixes are appended to another, which is read once at the end: neighbours with a common prefix of
   ``LENGTH`` bytes are repeated windows. What is held is a few bytes per document of a batch.
5. Anchors are dealt over tasks by hash. The documents of one with over ``GROUP`` are split by the bytes
   around it: windows fall into ``_CLASSES`` classes by how many bytes they have left of the core, and
   the parts of documents with the windows of a class are dealt by the bytes that all these windows
   have in common. Where over ``GROUP`` documents share even those, their windows are dealt as bytes
   and counted by a partial aggregate. Nothing is capped.

Defined cases. Null text: empty bytes. Texts shorter than ``LENGTH``: nothing is removed. Repeated
rows: each other's copies. Null doc_id: an ordinary row. Very long texts: read in parts of 128 KiB that
overlap. An empty table: an empty result. Columns of the input other than doc_id and text aren't
used, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.common import scratch_path, table, written

LENGTH = 200
CORE = 64
#: Documents of a batch, and of an anchor that is not split.
BATCH, GROUP = 8192, 512
_PART = 1 << 17
_WIDTH = LENGTH - CORE + 1
_CLASSES = 8
_STEP = (_WIDTH - 1) // _CLASSES
_FACTOR = 0x9E3779B97F4A7C15
_SPAN = ["akey", "span", "span2"]
_ANCHOR = "akey long, span long, span2 long, file long, row long, start int, windows int, core int"
_DOCUMENT = "key long, akey long, span long, span2 long, twin int, at int, core int, bytes binary"


def _powers(base: int, n: int) -> np.ndarray:
    out, base = np.ones(n, np.uint64), np.uint64(base)
    step, power = 1, base
    while step < n:
        out[step : 2 * step] = out[: min(step, n - step)] * power
        with np.errstate(over="ignore"):
            power, step = power * power, 2 * step
    return out


_UP: list[np.ndarray] = []


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie in ``data`` (at most ``_PART`` bytes) one after another: for each span its
    anchor's hash, its first window, its number of windows, and how far its anchor is from its start."""
    empty = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return empty.astype(np.uint64), empty, empty, empty
    if not _UP:
        _UP.extend((_powers(_FACTOR, _PART + 1), _powers(pow(_FACTOR, -1, 1 << 64), _PART + 1)))
    # A polynomial hash of the CORE bytes from each position on, by differences of prefix sums.
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[0][: len(data)], out=sums[1:])
    cores = (sums[CORE:] - sums[:-CORE]) * _UP[1][: len(data) - CORE + 1]
    cores ^= cores >> np.uint64(29)
    cores *= np.uint64(0xBF58476D1CE4E5B9)
    cores ^= cores >> np.uint64(32)
    low = np.uint64(_PART - 1)
    ranked = (cores & ~low) | np.arange(len(cores), dtype=np.uint64)
    rows = np.concatenate((ranked, np.full(-len(ranked) % _WIDTH, ~np.uint64(0)))).reshape(-1, _WIDTH)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(cores) - _WIDTH + 1
    least = (np.minimum(behind[:n], ahead[_WIDTH - 1 : _WIDTH - 1 + n]) & low).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    stop = ends - LENGTH + 1
    some = stop > starts
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, stop[some], -1)
    windows = np.flatnonzero(np.cumsum(inside)[:n])
    if not len(windows):
        return empty.astype(np.uint64), empty, empty, empty
    at = least[windows]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1))))
    count = np.diff(np.append(first, len(windows)))
    return cores[at[first]], windows[first], count, at[first] - windows[first]


def _batches(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset in it, bytes) in batches of at most ``_PART`` bytes; parts of a text overlap so
    that each window is in one part."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), _PART - LENGTH + 1):
            part = text[at : at + _PART]
            if size + len(part) > _PART:
                yield held
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
    if held:
        yield held


def _keys_only(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in parts:
        for batch in _batches(frame["text"].tolist()):
            ends = np.cumsum([len(part) for _, _, part in batch])
            keys = anchors(np.frombuffer(b"".join(part for _, _, part in batch), np.uint8), np.concatenate(([0], ends[:-1])), ends)[0]
            yield pd.DataFrame({"akey": keys.view(np.int64)})


def _find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in parts:
        files, rows = frame["file"].to_numpy(), frame["row"].to_numpy()
        for batch in _batches(frame["text"].tolist()):
            raw = b"".join(part for _, _, part in batch)
            ends = np.cumsum([len(part) for _, _, part in batch])
            starts = np.concatenate(([0], ends[:-1]))
            keys, first, count, core = anchors(np.frombuffer(raw, np.uint8), starts, ends)
            own = np.searchsorted(ends, first, "right")
            text, shift = (np.array([b[i] for b in batch], np.int64) for i in (0, 1))
            digest = xxhash.xxh3_128_digest
            spans = np.frombuffer(b"".join([digest(raw[a:z]) for a, z in zip(first.tolist(), (first + count + LENGTH - 1).tolist())]), "<i8").reshape(-1, 2)
            yield pd.DataFrame(
                {
                    "akey": keys.view(np.int64),
                    "span": spans[:, 0],
                    "span2": spans[:, 1],
                    "file": files[text[own]],
                    "row": rows[text[own]],
                    "start": (first - starts[own] + shift[own]).astype(np.int32),
                    "windows": count.astype(np.int32),
                    "core": core.astype(np.int32),
                }
            )


class Columns:
    """A sequential file in a folder: arrays are appended, then read in the same order."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(path)
        self.path = f"{path}/{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.path, compression=None, buffer_size=1 << 16)

    def append(self, values: np.ndarray) -> None:
        self.stream.write(values.tobytes())

    def rewind(self) -> None:
        self.stream.close()
        self.stream = self.fs.open_input_stream(self.path, compression=None, buffer_size=1 << 16)

    def read(self, n: int, dtype) -> np.ndarray:
        return np.frombuffer(self.stream.read(n * np.dtype(dtype).itemsize), dtype)

    def __enter__(self) -> "Columns":
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()
        self.fs.delete_file(self.path)


def _least(common: np.ndarray, order: np.ndarray, again: np.ndarray) -> np.ndarray:
    """For each place of ``order`` (places of the round before) where ``again``, the least common
    prefix between its neighbour before and itself; 0 elsewhere."""
    m = len(order)
    first = np.full(m, -1, np.int64)
    at = np.flatnonzero(again)
    first[order[at]] = order[at - 1] + 1
    ends = np.flatnonzero(first >= 0)[::-1]  # descending, so that what lies between two ranges costs nothing
    out = np.zeros(m, np.uint8)
    if len(ends):
        ranges = np.column_stack((first[ends], ends + 1)).ravel()
        out[ends] = np.minimum.reduceat(np.append(common, np.uint8(0)), ranges)[::2]
    return out[order]


def transform(symbols: Columns, m: int, columns: int, out: Columns, most: int = LENGTH) -> None:
    """From the symbols of ``m`` documents, column by column from the last to the first (0: none), the
    order of the suffixes that begin in each column and each one's common prefix, up to ``most``, with
    the one before. Equal suffixes keep the order of the documents."""
    order, common = np.arange(m, dtype=np.int32), np.zeros(m, np.uint8)
    for _ in range(columns):
        column = symbols.read(m, np.uint8)[order]
        place = np.argsort(column, kind="stable")
        sorted_ = column[place]
        again = np.zeros(m, bool)
        again[1:] = (sorted_[1:] == sorted_[:-1]) & (sorted_[1:] != 0)
        common = np.where(again, np.minimum(_least(common, place, again), np.uint8(most - 1)) + np.uint8(1), np.uint8(0)).astype(np.uint8)
        order = order[place]
        out.append(order)
        out.append(common)


def repeated_windows(documents: list[bytes], cores: list[int], folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Document and start, in order, of each window that another document has in the same place. Each
    document's core begins at the given byte. No byte may be 0xFF."""
    m, left = len(documents), _WIDTH - 1
    sizes, core = np.array([len(d) for d in documents]), np.array(cores)
    width = left + CORE + left
    table = np.zeros((m, width), np.uint8)
    begins = np.arange(m) * width + left - core
    table.ravel()[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = np.frombuffer(b"".join(documents), np.uint8) + 1
    with Columns(folder) as symbols, Columns(folder) as out:
        symbols.append(np.ascontiguousarray(table.T[::-1]))
        del table
        symbols.rewind()
        transform(symbols, m, width, out)
        out.rewind()
        owners, starts = [], []
        for column in range(width - 1, -1, -1):
            order, common = out.read(m, np.int32), out.read(m, np.uint8)
            if column <= left:
                same = common >= LENGTH
                same[:-1] |= same[1:].copy()
                owners.append(order[same])
                starts.append(column - left + core[order[same]])
    owner, start = np.concatenate(owners), np.concatenate(starts)
    order = np.lexsort((start, owner))
    return owner[order], start[order]


def runs_of(owner: np.ndarray, start: np.ndarray, m: int) -> list[list[int]]:
    """For each of ``m`` documents, begin and end of each run that its windows cover."""
    first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] - start[:-1] > LENGTH)))[: len(owner)]
    last = np.concatenate((first[1:], [True]))[: len(owner)]
    flat = np.column_stack((start[first], start[last] + LENGTH)).ravel().tolist()
    bounds = (2 * np.searchsorted(owner[first], np.arange(m + 1))).tolist()
    return [flat[a:z] for a, z in zip(bounds, bounds[1:])]


def _solver(folder: str):
    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solved(held: list[tuple]) -> pd.DataFrame:
            runs = runs_of(*repeated_windows([h[-1] for h in held], [h[-2] for h in held], folder), len(held))
            found = [(*h[1:4], [h[5] + x for x in own] if h[5] else own) for h, own in zip(held, runs) if own and not h[4]]
            return pd.DataFrame(found, columns=[*_SPAN, "runs"]).astype(dict.fromkeys(_SPAN, "int64"))

        held: list[tuple] = []
        for frame in parts:
            for row in zip(*(frame[c].tolist() for c in ("key", *_SPAN, "twin", "at", "core", "bytes"))):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield solved(held)
                    held = []
                held.append(row)
        if held:
            yield solved(held)

    return solve


def _split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of frequent anchors as parts, one for each class of windows that they have, with the
    hash of what all windows of the class have in common as key."""
    for frame in parts:
        rows = []
        for akey, span, span2, twin, core, whole in zip(*(frame[c].tolist() for c in (*_SPAN, "twin", "core", "bytes"))):
            for k in range(_CLASSES):
                a, z = core - k * _STEP, core + CORE + _WIDTH - 1 - (k + 1) * _STEP
                if a >= 0 and z <= len(whole):
                    first, last = max(0, a - _STEP), min(len(whole), z + _STEP)
                    if last - first >= LENGTH:
                        key = xxhash.xxh3_64_intdigest(whole[a:z], akey & 0xFFFFFFFF ^ k) - (1 << 63)
                        rows.append((key, akey, span, span2, twin, first, core - first, whole[first:last]))
        yield pd.DataFrame(rows, columns=["key", *_SPAN, "twin", "at", "core", "bytes"]).astype(dict.fromkeys(("key", *_SPAN), "int64") | dict.fromkeys(("twin", "at", "core"), "int32"))


def _windows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each window of each part as bytes."""
    for frame in parts:
        for akey, span, span2, twin, at, whole in zip(*(frame[c].tolist() for c in (*_SPAN, "twin", "at", "bytes"))):
            n = len(whole) - LENGTH + 1
            yield pd.DataFrame({"akey": akey, "span": span, "span2": span2, "twin": twin, "start": np.arange(at, at + n, dtype=np.int32), "window": [whole[k : k + LENGTH] for k in range(n)]})


def _texts(path: str) -> Iterator[tuple[int, str | None, bytes]]:
    """Row, doc_id and bytes of each text of a written file."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    with store.open_input_file(where) as source:
        at = 0
        for batch in pq.ParquetFile(source).iter_batches(batch_size=32):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                yield at, doc_id, text
                at += 1


def _by_file(decisions: DataFrame, files: DataFrame, n_files: int) -> DataFrame:
    """Decisions, and before each file's a row with its path, in order and in a task for each file."""
    # Numbers of the marks are zeros, since nulls would turn a whole batch's integers into floats.
    rest = {f.name: F.lit(None if f.dataType.typeName() == "array" else 0).cast(f.dataType).alias(f.name) for f in decisions.schema if f.name not in ("file", "row")}
    marks = files.select("file", F.lit(-1).cast("long").alias("row"), *rest.values(), "path")
    both = decisions.withColumn("path", F.lit(None).cast("string")).select(marks.columns).unionByName(marks)
    return both.repartitionById(n_files, (F.shiftright("file", 20) % n_files).cast("int")).sortWithinPartitions("file", "row", "start")


def _grouped(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list]]:
    """Path and decisions (as tuples) of each file, from the rows of ``_by_file``."""
    now, path, held = None, None, []
    for frame in parts:
        for row in frame.itertuples(index=False):
            if row.file != now:
                if now is not None:
                    yield path, held
                now, path, held = row.file, row.path, []
            if row.row >= 0:
                held.append(row)
    if now is not None:
        yield path, held


def _extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of spans, as documents of their anchors."""
    names = ["key", *_SPAN, "twin", "at", "core", "bytes"]
    kinds = dict.fromkeys(("key", *_SPAN), "int64") | dict.fromkeys(("twin", "at", "core"), "int32")
    for path, wanted in _grouped(parts):
        if not wanted:
            continue
        at, rows = 0, []
        for row, _, text in _texts(path):
            while at < len(wanted) and wanted[at].row == row:
                w = wanted[at]
                rows.append((w.akey, w.akey, w.span, w.span2, w.twin, 0, w.core, text[int(w.start) : int(w.start) + int(w.windows) + LENGTH - 1]))
                at += 1
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=names).astype(kinds)
                rows = []
            if at == len(wanted):
                break
        if rows:
            yield pd.DataFrame(rows, columns=names).astype(kinds)


def _remove(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per text: the kept bytes and what was removed."""
    names = ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for path, decisions in _grouped(parts):
        at, rows, size = 0, [], 0
        for row, doc_id, text in _texts(path):
            runs: list[list[int]] = []
            while at < len(decisions) and decisions[at].row == row:
                d = decisions[at]
                at += 1
                first = int(d.start)
                for a, z in sorted(zip(d.runs[::2].tolist(), d.runs[1::2].tolist())):
                    a, z = first + a, first + z
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(z, runs[-1][1])
                    else:
                        runs.append([a, z])
            kept = text
            if runs:
                edges = [0, *(x for run in runs for x in run), len(text)]
                kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))
            rows.append((doc_id, kept, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            size += len(kept)
            if size > 16 << 20:
                yield pd.DataFrame(rows, columns=names)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)


def _by_key(documents: DataFrame) -> DataFrame:
    return documents.repartition("key").sortWithinPartitions("key", *_SPAN, "twin")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text (the kept bytes), n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    path = scratch_path(spark, "texts")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    docs.select(F.col("doc_id").cast("string").alias("doc_id"), text).write.option("compression", "zstd").parquet(path)
    held = spark.read.schema("doc_id string, text binary").parquet(path)
    number = lambda pattern: F.coalesce(F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long"), F.lit(0))
    file = F.shiftleft(number(r"^part-(\d+)"), 20) + number(r"-c(\d+)\.")
    files = written(held.select(file.alias("file"), F.col("_metadata.file_path").alias("path")).distinct(), "files")
    n_files = max(1, files.count())
    located = held.select("text", file.alias("file"), F.col("_metadata.row_index").alias("row"))

    # Written, so that neither side of the join is bound to an aggregate's partitions and a frequent
    # anchor's rows can be split.
    again = written(located.mapInPandas(_keys_only, "akey long").groupBy("akey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("akey"), "repeated-anchors")
    found = written(located.mapInPandas(_find, _ANCHOR).join(again, "akey"), "anchors")
    place = F.struct("file", "row", "start", "windows", "core")
    spans = found.groupBy(*_SPAN).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"), F.max(place).alias("two"))
    spans = written(spans, "spans")
    frequent = written(spans.groupBy("akey").agg(F.sum(F.least("n", F.lit(2))).alias("many")).filter(F.col("many") > GROUP).select("akey"), "frequent-anchors")
    twins = spans.select(*_SPAN, F.posexplode(F.when(F.col("n") > 1, F.array("one", "two")).otherwise(F.array("one"))).alias("twin", "place")).select(*_SPAN, "twin", "place.*")
    documents = _by_file(twins, files, n_files).mapInPandas(_extract, _DOCUMENT)
    folder = scratch_path(spark, "columns")
    result = ", ".join(f"{c} long" for c in _SPAN) + ", runs array<int>"
    if frequent.isEmpty():
        verdicts = _by_key(documents).mapInPandas(_solver(folder), result)
    else:
        documents = written(documents, "documents")
        parts = written(documents.join(frequent, "akey").mapInPandas(_split, _DOCUMENT), "parts")
        counts = written(parts.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "parts-by-key")
        split = documents.join(frequent, "akey", "left_anti").select(parts.columns).unionByName(parts.join(counts.filter(F.col("many") <= GROUP).select("key"), "key").select(parts.columns))
        windows = parts.join(counts.filter(F.col("many") > GROUP).select("key"), "key").mapInPandas(_windows, ", ".join(f"{c} long" for c in _SPAN) + ", twin int, start int, window binary")
        twice = written(windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window"), "repeated-windows")
        counted = windows.filter("twin = 0").join(twice, "window").select(*_SPAN, F.array(F.col("start"), F.col("start") + LENGTH).alias("runs"))
        solved = _by_key(split).mapInPandas(_solver(folder), result).unionByName(counted)
        verdicts = solved.groupBy(*_SPAN).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    verdicts = written(verdicts, "verdicts")
    decisions = found.join(verdicts, _SPAN).select("file", "row", "start", "runs")
    kept = _by_file(decisions, files, n_files).mapInPandas(_remove, "doc_id string, text binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return kept.withColumn("doc_id", F.col("doc_id").cast(kind))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERY = ("op1_suffix_dedup", op1_suffix_dedup)
SQL = None
