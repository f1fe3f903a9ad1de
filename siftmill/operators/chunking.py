"""Chunkers: one text becomes blocks of consecutive lines, tokens or characters.

Each takes a DataFrame with ``doc_id`` and ``text`` and returns ``doc_id, block_no, start, end,
content`` (lines from 0, both included; tokens and characters likewise). Blocks come out of arrays
within the row, so none of them shuffles, and a block's number is its place in its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import is_blank, let, lines

FIELDS = ("start", "end", "content")


def _exploded(docs: DataFrame, blocks: Column) -> DataFrame:
    kept = [c for c in docs.columns if c != "text"]
    found = docs.select(*kept, F.posexplode(blocks).alias("block_no", "b"))
    return found.select(*kept, F.col("block_no").cast("long").alias("block_no"), F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("end"), F.col("b.content").alias("content"))


def _block(start: Column, end: Column, content: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), content.alias("content"))


def _steps(n: Column, step: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _with_text(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: ~is_blank(b["content"]))


def fixed(docs: DataFrame, size: int = 15, most: int | None = None) -> DataFrame:
    """Blocks of ``size`` lines one after another; blocks of blank lines are left out. At most
    ``most`` blocks of a text if given."""

    def cut(x: Column) -> Column:
        return F.transform(_steps(F.size(x), size), lambda s: _block(s, F.least(s + size, F.size(x)) - 1, F.array_join(F.slice(x, s + 1, size), "\n")))

    blocks = _with_text(let(lines(F.col("text")), cut))
    return _exploded(docs, F.slice(blocks, 1, most) if most else blocks)


def sliding(docs: DataFrame, window: int = 20, slices: int = 2) -> DataFrame:
    """Windows around each ``window // slices``-th line, cut at the ends of the text."""
    if window <= 0:
        raise ValueError("window must be positive")
    step = max(1, window // slices) if slices > 0 else window
    half = window // 2

    def cut(x: Column) -> Column:
        def one(c: Column) -> Column:
            start, stop = F.greatest(c - half, F.lit(0)), F.least(c + (window - half), F.size(x))
            return _block(start, stop - 1, F.array_join(F.slice(x, start + 1, stop - start), "\n"))

        return F.transform(_steps(F.size(x), step), one)

    return _exploded(docs, _with_text(let(lines(F.col("text")), cut)))


def filled_fixed(docs: DataFrame, size: int = 12, most_lines: int = 5000) -> DataFrame:
    """Blocks of ``size`` non-blank lines, with their original first and last line numbers. Blocks
    begin before the ``most_lines``-th non-blank line."""

    def cut(x: Column) -> Column:
        n = F.least(F.size(x), F.lit(most_lines))
        own = lambda s: F.slice(x, s + 1, size)
        return F.transform(_steps(n, size), lambda s: _block(F.get(x, s)["i"], F.element_at(own(s), -1)["i"], F.array_join(F.transform(own(s), lambda r: r["line"]), "\n")))

    return _exploded(docs, let(_filled(lines(F.col("text"))), cut))


def _filled(all_lines: Column) -> Column:
    """Non-blank lines with their numbers."""
    return F.filter(F.transform(all_lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda r: ~is_blank(r["line"]))


def _paragraph_runs(docs: DataFrame, longest: int | None) -> Column:
    """Maximal runs of non-blank lines, cut into pieces of ``longest`` lines."""

    def cut(x: Column) -> Column:
        first = F.filter(
            F.transform(x, lambda r, k: F.struct(k.alias("k"), ((k == 0) | (F.get(x, k - 1)["i"] != r["i"] - 1)).alias("new"))),
            lambda r: r["new"],
        )

        def pieces(starts: Column) -> Column:
            def piece(r: Column, k: Column) -> Column:
                n = F.coalesce(F.get(starts, k + 1)["k"], F.size(x)) - r["k"]
                if longest is None:
                    return F.array(F.slice(x, r["k"] + 1, n))
                return F.transform(F.sequence(F.lit(0), n - 1, F.lit(longest)), lambda s: F.slice(x, r["k"] + s + 1, F.least(F.lit(longest), n - s)))

            return F.flatten(F.transform(starts, piece))

        return let(first, pieces)

    return let(_filled(lines(F.col("text"))), cut)


def _rows_block(rows: Column) -> Column:
    return _block(F.get(rows, F.lit(0))["i"], F.element_at(rows, -1)["i"], F.array_join(F.transform(rows, lambda r: r["line"]), "\n"))


def paragraphs(docs: DataFrame, longest: int | None = None) -> DataFrame:
    """Runs of non-blank lines."""
    return _exploded(docs, F.transform(_paragraph_runs(docs, longest), _rows_block))


def packed_paragraphs(docs: DataFrame, size: int = 15, most_lines: int = 5000) -> DataFrame:
    """Paragraphs, cut at ``size`` lines, joined greedily into blocks of at most ``size`` lines,
    until ``most_lines`` lines are taken. The packing is a fold, since each step needs the last."""
    none = F.array().cast("array<struct<i:int,line:string>>")
    start = F.struct(F.array().cast("array<array<struct<i:int,line:string>>>").alias("done"), none.alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, piece: Column) -> Column:
        fits = F.size(acc["now"]) + F.size(piece) <= size
        full = acc["n"] >= most_lines
        done = F.when(full | fits | (F.size(acc["now"]) == 0), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
        now = F.when(full, acc["now"]).when(fits, F.concat(acc["now"], piece)).otherwise(piece)
        return F.struct(done.alias("done"), now.alias("now"), F.when(full, acc["n"]).otherwise(acc["n"] + F.size(piece)).alias("n"))

    folded = F.aggregate(_paragraph_runs(docs, size), start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]))
    return _exploded(docs, F.transform(folded, _rows_block))


def token_windows(docs: DataFrame, size: int = 1024, overlap: int = 20) -> DataFrame:
    """Windows of ``size`` white-space tokens, each beginning ``size - overlap`` after the last; the
    last one reaches the end."""

    def cut(x: Column) -> Column:
        n, step = F.size(x), size - overlap
        count = F.when(n == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int") + 1)
        starts = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda k: k * step)
        return F.transform(starts, lambda s: _block(s, F.least(s + size, n) - 1, F.array_join(F.slice(x, s + 1, size), " ")))

    tokens = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"\s+"), lambda w: w != "")
    return _exploded(docs, let(tokens, cut))


def _merged(pieces: Column, separator: str, size: int, overlap: int, length: Callable[[Column], Column]) -> Column:
    """Greedy merge of pieces into chunks of at most ``size``, the next one beginning with as many of
    the last pieces as fit ``overlap``. Chunks are (first piece, number of pieces)."""
    gap = len(separator)

    def merge(own: Column) -> Column:
        start = F.struct(F.array().cast("array<struct<a:int,n:int>>").alias("done"), F.lit(0).alias("a"), F.lit(0).alias("n"), F.lit(0).alias("size"))
        state = lambda done, a, n, size: F.struct(done.alias("done"), a.cast("int").alias("a"), n.cast("int").alias("n"), size.cast("int").alias("size"))

        def tail(acc: Column, p: Column) -> Column:
            """How many of the last pieces stay, and their size: the longest tail within the overlap that leaves room. Sizes
            of tails only grow, so the first that does not fit ends it."""
            none = F.struct(F.lit(0).alias("k"), F.lit(0).alias("size"), F.lit(True).alias("fits"))
            last = F.reverse(F.slice(own, p["i"] - acc["n"] + 2, acc["n"] - 1))
            grown = lambda t, x: t["size"] + x + F.when(t["k"] > 0, gap).otherwise(0)
            fits = lambda t, x: t["fits"] & (grown(t, x) <= overlap) & (grown(t, x) + gap + p["p"] <= size)
            return F.aggregate(last, none, lambda t, x: F.when(fits(t, x), F.struct((t["k"] + 1).alias("k"), grown(t, x).cast("int").alias("size"), F.lit(True).alias("fits"))).otherwise(F.struct(t["k"].alias("k"), t["size"].alias("size"), F.lit(False).alias("fits"))))

        def step(acc: Column, p: Column) -> Column:
            grown = acc["size"] + p["p"] + F.when(acc["n"] > 0, gap).otherwise(0)
            done = F.array_append(acc["done"], F.struct(acc["a"].alias("a"), acc["n"].alias("n")))
            over = let(tail(acc, p), lambda t: state(done, p["i"] - t["k"], t["k"] + 1, t["size"] + F.when(t["k"] > 0, gap).otherwise(0) + p["p"]))
            return F.when((grown > size) & (acc["n"] > 0), over).otherwise(state(acc["done"], F.when(acc["n"] == 0, p["i"]).otherwise(acc["a"]), acc["n"] + 1, grown))

        indexed = F.transform(own, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
        return F.aggregate(indexed, start, step, lambda acc: F.when(acc["n"] > 0, F.array_append(acc["done"], F.struct(acc["a"].alias("a"), acc["n"].alias("n")))).otherwise(acc["done"]))

    # Lengths are found once a piece; a tail is looked for only where a chunk is full.
    return let(F.transform(pieces, length), merge)


def separated(docs: DataFrame, separator: str = "\n\n", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Pieces between separators, merged into chunks of at most ``size`` characters that share up to
    ``overlap`` with the one before; a longer piece is a chunk by itself. start, end: pieces."""

    def cut(x: Column) -> Column:
        return F.transform(_merged(x, separator, size, overlap, F.length), lambda c: _block(c["a"], c["a"] + c["n"] - 1, F.array_join(F.slice(x, c["a"] + 1, c["n"]), separator)))

    pieces = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), separator, -1), lambda p: p != "")
    return _exploded(docs, let(pieces, cut))


def sentences(docs: DataFrame, size: int = 1024, overlap: int = 200) -> DataFrame:
    """Sentences merged into chunks by their number of white-space tokens. start, end: sentences."""

    def cut(x: Column) -> Column:
        tokens = lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))
        return F.transform(_merged(x, "", size, overlap, tokens), lambda c: _block(c["a"], c["a"] + c["n"] - 1, F.array_join(F.slice(x, c["a"] + 1, c["n"]), " ")))

    return _exploded(docs, let(sentence_array(F.col("text")), cut))


def sentence_array(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def semantic(sentence_vectors: DataFrame, percentile: float = 0.95) -> DataFrame:
    """From ``doc_id, sentence_no, sentence, vector``: blocks that end where the cosine distance to the
    next sentence is over the text's percentile of such distances."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("sentence_no")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    after = F.lead("vector").over(order)
    norm = F.sqrt(dot(F.col("vector"), F.col("vector")))
    distance = 1 - F.try_divide(dot(F.col("vector"), F.col("_after")), F.col("_norm") * F.lead("_norm").over(order))
    found = sentence_vectors.withColumn("_norm", norm).withColumn("_after", after).withColumn("_d", F.when(F.col("_after").isNotNull(), distance)).drop("_after", "_norm", "vector")
    found = found.withColumn("_at", F.percentile("_d", F.lit(percentile)).over(Window.partitionBy("doc_id")))
    cut = F.lag(F.col("_d") > F.col("_at"), 1, False).over(order)
    found = found.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    found = found.withColumn("block_no", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy("doc_id", "block_no").agg(
        F.min("sentence_no").alias("start"),
        F.max("sentence_no").alias("end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sentence_no", "sentence"))), lambda r: r["sentence"]), " ").alias("content"),
    )


#: Separators of the recursive splitter, from coarse to fine.
COARSE_TO_FINE = ("\n\n", "\n", " ", "")


def split_recursively(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = COARSE_TO_FINE) -> list[str]:
    """Chunks of at most ``size`` characters cut at the coarsest separator that parts them."""
    here = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(here) + 1 :]
    pieces = list(text) if here == "" else [p for p in text.split(here) if p]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            out.append(here.join(held))

    for piece in pieces:
        if len(piece) > size and finer:
            flush()
            held = []
            out += split_recursively(piece, size, overlap, finer)
            continue
        if held and len(here.join([*held, piece])) > size:
            flush()
            while held and (len(here.join(held)) > overlap or len(here.join([*held, piece])) > size):
                held = held[1:]
        held = [*held, piece]
    flush()
    return [c for c in (x.strip() for x in out) if c]


def recursive(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """``split_recursively`` of each text, batch by batch; start, end: lines of the chunk."""
    import pandas as pd

    def run(parts):
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"]):
                at = 0
                for k, chunk in enumerate(split_recursively(text or "", size, overlap)):
                    found = (text or "").find(chunk, max(0, at - overlap - 1))
                    at = found + len(chunk) if found >= 0 else at
                    first = (text or "").count("\n", 0, max(found, 0))
                    rows.append((doc_id, k, first, first + chunk.count("\n"), chunk))
            yield pd.DataFrame(rows, columns=["doc_id", "block_no", "start", "end", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, block_no long, start long, end long, content string")


def chunk_lines(text: Column, chunk: Column) -> Column:
    """First and last line of ``chunk`` in ``text``; null where it isn't found whole."""
    at = F.position(chunk, text)
    first = F.length(F.substring(text, F.lit(1), at - 1)) - F.length(F.replace(F.substring(text, F.lit(1), at - 1), F.lit("\n"), F.lit("")))
    inner = F.length(chunk) - F.length(F.replace(chunk, F.lit("\n"), F.lit("")))
    return F.when(at > 0, F.struct(first.cast("long").alias("start"), (first + inner).cast("long").alias("end")))


def statistics(blocks: DataFrame, of: str = "doc_id") -> DataFrame:
    """Blocks and lines per text."""
    return blocks.groupBy(of).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.col("end") - F.col("start") + 1).alias("n_lines"))
