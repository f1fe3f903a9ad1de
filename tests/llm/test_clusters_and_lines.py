"""Drake's bounds against plain rounds, and repeated lines against counts, on rows of every kind."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill.llm import drake_kmeans, line_dedup
from tests.oracle import rows_of_query, rows_of_sql

KIND = "vec_id long, embedding array<double>, label int, cluster string, distance string, n string, q string"


def plain_rounds(vectors, k, rounds, seed, width):
    """Lloyd's rounds on Python integers: rows of (vec_id, cluster, distance) and the centroids."""
    kept = []
    for vec_id, v in vectors:
        if v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v):
            kept.append((vec_id, [int(c) * 256 if abs(c) >= 2**53 else int(np.floor(256 * c)) for c in v]))
    mark = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [w for _, w in sorted(kept, key=lambda row: (mark(row[0]), row[1]))[:k]]
    for n in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(w, c)), j) for j, c in enumerate(centroids)) for _, w in kept]
        if n < rounds:
            for j in range(len(centroids)):
                own = [w for (_, w), (_, at) in zip(kept, found) if at == j]
                if own:
                    centroids[j] = [sum(column) // len(own) for column in zip(*own)]
    return collections.Counter((vec_id, j, min(d, 2**63 - 1)) for (vec_id, _), (d, j) in zip(kept, found)), centroids


def clustered(spark, vectors, k, rounds=5, width=3, parts=3):
    frame = spark.createDataFrame([(i, v, 1, "own", "own", "own", "own") for i, v in vectors], KIND).repartition(parts)
    rows, centroids = drake_kmeans.clustered(frame, k, rounds, 2, width)
    return collections.Counter(map(tuple, rows.collect())), [list(map(int, c)) for c in centroids]


def odd_vectors():
    rng = np.random.default_rng(7)
    vectors = [(i, (rng.normal(size=3) * 0.3 + i % 5).tolist()) for i in range(300)]
    vectors += [(17, vectors[17][1])] * 150  # a third of all rows are one
    vectors += [(400, None), (401, [1.0, 2.0]), (402, [float("nan")] * 3), (403, [None, 1.0, 2.0]), (404, [float("inf"), 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (None, [-0.5, 0.25, 0.5]), (405, [])]
    return vectors


@pytest.mark.parametrize("k", [1, 2, 7, 40])
def test_clusters_by_plain_rounds(spark, k):
    assert clustered(spark, odd_vectors(), k) == plain_rounds(odd_vectors(), k, 5, 2, 3)


@pytest.mark.parametrize("vectors", [[(1, [0.0, 0.0, 0.0])], [(i, [1.0, 1.0, 1.0]) for i in range(9)], [(i, [i / 256.0, 0.0, 0.0]) for i in range(64)]], ids=["one", "equal", "ties"])
def test_few_equal_and_tied_vectors(spark, vectors):
    assert clustered(spark, vectors, 8) == plain_rounds(vectors, 8, 5, 2, 3)


def test_values_beyond_64_bits(spark):
    vectors = [(i, [i * 1e6, -i * 3e5, 1e300 if i == 3 else 0.0]) for i in range(20)]
    assert clustered(spark, vectors, 4) == plain_rounds(vectors, 4, 5, 2, 3)


def test_no_vectors(spark):
    assert clustered(spark, [(1, None)], 4) == (collections.Counter(), [])


def test_clusters_of_64_components_by_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) + i % 9).tolist(), i % 9) for i in range(200)] + [(5, [0.25] * 64, 0), (300, None, 0), (301, [1.0] * 63, 0), (302, [1.0] * 63 + [float("nan")], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows_of_query(drake_kmeans.op11_drake_kmeans(spark, str(tmp_path))) == rows_of_sql(drake_kmeans.SQL, str(tmp_path))


def test_bounds_spare_most_scans():
    """Vectors with clusters: after the first rounds nearly none is scanned again, and clusters are right all along."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(2000, 8)) + 12 * rng.normal(size=(20, 8))[rng.integers(0, 20, 2000)])).astype(np.int64)
    c = x[:20].copy()
    state, moved, scans = drake_kmeans.State.scanned(x, c, 5), np.zeros(20), []
    for _ in range(6):
        new = c.copy()
        for j in range(20):
            if (state.cluster == j).any():
                new[j] = np.floor_divide(x[state.cluster == j].sum(axis=0), (state.cluster == j).sum())
        moved, c = drake_kmeans._up(np.sqrt(((new - c) ** 2).sum(axis=1).astype(float))), new
        before = drake_kmeans.State.scanned
        seen = []
        drake_kmeans.State.scanned = classmethod(lambda cls, x, c, keep: seen.append(len(x)) or before(x, c, keep))
        try:
            state, _ = drake_kmeans.assigned(x, state, drake_kmeans.Round(c, moved, 5))
        finally:
            drake_kmeans.State.scanned = before
        scans.append(sum(seen))
        squares = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        assert (state.cluster == squares.argmin(axis=1)).all()
        true = np.sqrt(np.take_along_axis(squares, state.near, axis=1))
        assert (state.lower[:, :-1] <= true).all() and (state.upper >= np.sqrt(squares.min(axis=1))).all()
        rest = squares.astype(float)
        np.put_along_axis(rest, np.column_stack((state.cluster[:, None], state.near)), np.inf, axis=1)
        assert (state.lower[:, -1] <= np.sqrt(rest.min(axis=1))).all()
    assert scans[-1] < 200


# Lines


def plain_lines(docs, keep=max):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(doc_id)
    keeper = {k: keep(i for i in ids if i is not None) for k, ids in holders.items() if len(ids) >= 5}
    found = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc_id]
        found.append((doc_id, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(found, key=repr)


A = "a line of forty code points and some more"
B = "É" * 39 + "x"
ODD = [
    *((i, f"{A}\n{i} unlike\n\t {A.upper()} \r") for i in range(1, 7)),
    *((i, f"start {i}\n{B}\n{'é' * 39}") for i in range(10, 16)),
    *((i, "x" * 50) for i in range(20, 24)),
    (30, "x" * 50), (30, "x" * 50), (30, "y" * 50), (31, "y" * 50), (32, "y" * 50), (33, "y" * 50),
    (None, A), (None, "x" * 50 + "\n" + "x" * 50), (40, None), (41, ""), (42, "\n\n"), (43, " \t\n" + "word " * 40000 + "\n" + A), (44, "A" * 40 + " "), (45, A + "\n" + A),
]


@pytest.mark.parametrize("keep", ["last", "first"])
def test_lines_by_counts(spark, keep):
    names = "text kept doc line key row n_dropped n_lines segment".split()
    docs = spark.createDataFrame([(i, t, *["own"] * 8) for i, t in ODD], "doc_id long, " + ", ".join(f"{c} string" for c in names)).repartition(5)
    found = line_dedup.without_repeated_lines(docs, keep)
    assert found.columns == ["doc_id", "text", "kept", "doc", "line", "key", "row", "segment", "n_lines", "n_dropped"]
    assert {r["kept"] for r in found.collect()} == {"own"}
    assert sorted((tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == plain_lines(ODD, max if keep == "last" else min)


def test_hot_lines_by_sql(spark, tmp_path):
    """One line in every document, one in a third, some often within one document alone."""
    rows = [(k, "\n".join([f"the very same line of all documents, as long as need be{'!' * 9}", *(["a line that a third of all documents have in them"] if k % 3 == 0 else []), f"line {k % 40} of forty, in some documents each, and long enough", *[f"only document {k} has this line, though several times"] * 3])) for k in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of_query(line_dedup.op12_line_dedup(spark, str(tmp_path))) == rows_of_sql(line_dedup.SQL, str(tmp_path))


def test_repeats_are_always_suspected():
    rng = np.random.default_rng(11)
    tasks = [[rng.bytes(16) for _ in range(500)] for _ in range(4)]
    shared, within = rng.bytes(16), rng.bytes(16)
    tasks[0] += [shared, within, within]
    tasks[3] += [shared]
    own = [line_dedup.Filters(1 << 16) for _ in tasks]
    for held, hashes in zip(own, tasks):
        for at in range(0, len(hashes), 100):
            held.add(hashes[at : at + 100])
    merged = line_dedup.Filters(1 << 16)
    for held in own:
        merged.merge(held.once, held.twice)
    a, b = line_dedup._places([shared, within], 1 << 16)
    assert (line_dedup._has(merged.twice, a) & line_dedup._has(merged.twice, b)).all()
    a, b = line_dedup._places([h for hashes in tasks for h in hashes], 1 << 16)
    assert (line_dedup._has(merged.twice, a) & line_dedup._has(merged.twice, b)).mean() < 0.05


def test_a_full_filter_changes_no_row(spark, monkeypatch):
    """Far more lines than bits: all keys are suspected, and the exact counts decide alone."""
    docs = spark.createDataFrame([(i, t) for i, t in ODD], "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "_has", lambda bitmap, places: np.ones(len(places), bool))
    assert sorted((tuple(r) for r in line_dedup.without_repeated_lines(docs).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == plain_lines(ODD)


def test_filter_bits_follow_the_lines(spark):
    docs = spark.createDataFrame([(i, "\n".join(["z" * 60] * 500)) for i in range(400)], "doc_id long, text string")
    assert line_dedup.filter_bits(docs) == 1 << 21
    assert line_dedup.filter_bits(docs.limit(0)) == line_dedup.LEAST_BITS
    assert line_dedup.filter_bits(docs.withColumn("text", F.lit(None).cast("string"))) == line_dedup.LEAST_BITS
