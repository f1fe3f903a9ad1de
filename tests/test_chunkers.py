"""Chunkers without SQL against plain versions, on the tables' texts and on odd ones."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill.operators import chunking, retrieval
from tests.oracle import SMALL

ODD = [(-1, None), (-2, ""), (-3, "\n\n\n"), (-4, "x" * 3000), (-5, "one. two! three? " * 90), (-6, "a\n\nb\n\n\n\nc"), (-7, "é ü\tß " * 400), (-8, "no end"), (-9, "\n".join(["line " * 30] * 20)), (-10, " lead and trail  \n x ")]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    return table.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).cache()


def merged(pieces, gap, size, overlap, length):
    """Pieces filled into chunks; the next one begins with the last pieces that fit the overlap."""
    chunks, held, total = [], [], 0
    for at, piece in enumerate(pieces):
        n = length(piece)
        if held and total + n + gap > size:
            chunks.append((held[0], held[-1]))
            while held and (total > overlap or total + n + gap > size):
                total -= length(pieces[held[0]]) + (gap if len(held) > 1 else 0)
                held = held[1:]
        total += n + (gap if held else 0)
        held = [*held, at]
    if held:
        chunks.append((held[0], held[-1]))
    return chunks


def got(blocks):
    found = {}
    for r in blocks.collect():
        found.setdefault(r["doc_id"], []).append((r["block_no"], r["start"], r["end"], r["content"]))
    return {k: sorted(v) for k, v in found.items()}


def told(docs, cut):
    found = {r["doc_id"]: [(k, *row) for k, row in enumerate(cut(r["text"] or ""))] for r in docs.collect()}
    return {k: v for k, v in found.items() if v}


@pytest.mark.parametrize(("separator", "size", "overlap"), [("\n", 1000, 200), ("\n\n", 100, 0), ("\n", 60, 59)])
def test_separated(docs, separator, size, overlap):
    def cut(text):
        pieces = [p for p in text.split(separator) if p]
        return [(a, b, separator.join(pieces[a : b + 1])) for a, b in merged(pieces, len(separator), size, overlap, len)]

    assert got(chunking.separated(docs, separator, size, overlap)) == told(docs, cut)


def sentences(text):
    return [s for s in (p.strip(" ") for p in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n+", text)) if s]


@pytest.mark.parametrize(("size", "overlap"), [(128, 20), (10, 0), (7, 6)])
def test_sentences(docs, size, overlap):
    tokens = lambda p: len([w for w in re.split(r"[ \t\n\x0b\f\r]+", p) if w])

    def cut(text):
        pieces = sentences(text)
        return [(a, b, " ".join(pieces[a : b + 1])) for a, b in merged(pieces, 0, size, overlap, tokens)]

    assert got(chunking.sentences(docs, size, overlap)) == told(docs, cut)


def test_semantic(docs):
    parts = docs.select("doc_id", F.posexplode(chunking.sentence_array(F.col("text"))).alias("sentence_no", "sentence"))
    found = got(chunking.semantic(retrieval.embed(parts, "sentence")))
    encode = retrieval.hashing_encoder()

    def cut(text):
        own = sentences(text)
        x = encode(own).astype(np.float32).astype(float) if own else np.zeros((0, 1))
        norm = np.linalg.norm(x, axis=1)
        with np.errstate(all="ignore"):
            apart = [1 - (a @ b) / (n * m) if n * m else None for a, b, n, m in zip(x, x[1:], norm, norm[1:])]
        known = [d for d in apart if d is not None]
        limit = np.percentile(known, 95) if known else np.inf
        edges = [0, *(k + 1 for k, d in enumerate(apart) if d is not None and d > limit + 1e-12), len(own)]
        return [(a, b - 1, " ".join(own[a:b])) for a, b in zip(edges, edges[1:]) if b > a]

    want = told(docs, cut)
    same = sum(found.get(k) == v for k, v in want.items())
    # A distance that equals the percentile may fall on either side by its last bit.
    assert set(found) == set(want) and same >= len(want) - 3, [k for k in want if found.get(k) != want[k]]


@pytest.mark.parametrize(("size", "overlap"), [(1000, 200), (50, 10), (20, 0)])
def test_recursive(docs, size, overlap):
    def split(text, separators=("\n\n", "\n", " ", "")):
        mark = next(s for s in separators if s in text)
        finer = separators[separators.index(mark) + 1 :]
        out, run = [], []
        close = lambda: [out.extend(mark.join(run[a : b + 1]) for a, b in merged(run, len(mark), size, overlap, len)), run.clear()]
        for piece in [p for p in text.split(mark) if p] if mark else list(text):
            if len(piece) <= size or not finer:
                run.append(piece)
            else:
                close()
                out.extend(split(piece, finer))
        close()
        return [c for c in (x.strip() for x in out) if c]

    found = {k: [row[3] for row in rows] for k, rows in got(chunking.recursive(docs, size, overlap)).items()}
    want = {k: [row[1] for row in rows] for k, rows in told(docs, lambda text: [(c,) for c in split(text)] if text else []).items()}
    digest = lambda parts: [hashlib.md5(p.encode()).hexdigest() for p in parts]
    assert {k: digest(v) for k, v in found.items()} == {k: digest(v) for k, v in want.items()}
    assert all(len(c) <= size for parts in found.values() for c in parts)


def plain_merge(sizes, size, overlap, gap):
    """(first, number) of greedy chunks, the next beginning with the longest tail within the overlap that leaves room."""
    total = lambda ks: sum(sizes[k] for k in ks) + gap * max(0, len(ks) - 1)
    out, held = [], []
    for k in range(len(sizes)):
        if held and total([*held, k]) > size:
            out.append((held[0], len(held)))
            while held and (len(held) == k - out[-1][0] or total(held) > overlap or total([*held, k]) > size):
                held = held[1:]
        held.append(k)
    return out + ([(held[0], len(held))] if held else [])


@pytest.mark.parametrize("size, overlap, separator", [(12, 4, ""), (12, 0, "\n"), (30, 29, "\n\n"), (5, 20, "")])
def test_merging_finds_a_length_once_a_piece(spark, size, overlap, separator):
    """The fold asks for each piece's length once, not again for each tail that it tries; pieces of any length, empty ones and long ones."""
    import random

    from pyspark.sql import functions as F

    from siftmill.operators import chunking

    rng, asked = random.Random(size), []
    rows = [(n, ["x" * rng.choice([0, 1, 2, 3, 5, 8, 40]) for _ in range(n)]) for n in (0, 1, 2, 7, 60, 400)]

    def length(p):
        asked.append(p)
        return F.length(p)

    frame = spark.createDataFrame(rows, "n int, pieces array<string>")
    found = frame.select("n", chunking._merged(F.col("pieces"), separator, size, overlap, length).alias("c")).collect()
    assert len(asked) == 1
    pieces = dict(rows)
    for r in found:
        assert [tuple(c) for c in r["c"]] == plain_merge([len(p) for p in pieces[r["n"]]], size, overlap, len(separator)), r["n"]


def test_the_encoder_takes_batches_of_texts(spark):
    """Vectors are the same word by word; texts of the semantic chunker are shuffled without their vectors."""
    import numpy as np
    import xxhash

    from siftmill.operators import retrieval
    from siftmill.plans import catalogue
    from tests.oracle import SMALL

    texts = ["One two  two", None, "", "three " * 50 + "one"]
    for text, got in zip(texts, retrieval.hashing_encoder(16)(texts)):
        own = np.zeros(16)
        for word in (text or "").lower().split():
            h = xxhash.xxh64_intdigest(word)
            own[h % 16] += 1 if h >> 63 else -1
        assert np.array_equal(got, own / (np.linalg.norm(own) or 1))
    plan = catalogue.QUERIES["chunk_semantic"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange hashpartitioning(doc_id") > plan.rindex("ArrowEvalPython")
