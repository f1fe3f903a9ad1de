"""The best blocks of each query, kept within tasks, against scores of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill.operators import ranking, retrieval

QUERIES = [(1, "alpha beta gamma common"), (2, "common rare1"), (3, "common common word"), (4, "nothing here"), (5, ""), (6, "rare1 rare2 common word alpha"), (7, None)]


def tables(spark):
    """Blocks of few words, so that many tie, copies among them, and such that hold nothing."""
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "word", "rare1", "rare2", "other", "more"]
    rows = [(f"b{k}", f"f{k % 7}", " ".join(["common"] + list(rng.choice(words, rng.integers(0, 5))))) for k in range(900)]
    rows += [(f"c{k}", "f0", "common word") for k in range(300)] + [("n", "f1", None), ("e", "f1", "")]
    return spark.createDataFrame(QUERIES, "query_id long, text string"), spark.createDataFrame(rows, "item string, file string, text string").repartition(4)


def rows_of(found, k, *more):
    best = ranking.top_k(found, ["query_id"], k)
    return sorted((r["query_id"], r["rank"], r["item"], round(r["score"], 8), *(r[c] for c in more)) for r in best.collect())


@pytest.mark.parametrize("cells", [1, 50, 1 << 20])
@pytest.mark.parametrize("k", [1, 20, 5000])
def test_best_equal_those_of_all_pairs(spark, monkeypatch, k, cells):
    monkeypatch.setattr(retrieval, "_CELLS", cells)
    queries, blocks = tables(spark)
    params = retrieval.Bm25(stop_words=("other",))
    all_bm25 = retrieval.bm25(queries, blocks, params).withColumn("score", F.round("score", 9))
    found = retrieval.bm25_best(queries, blocks, k, params)
    assert rows_of(found, k) == rows_of(all_bm25, k)
    assert rows_of(retrieval.jaccard_best(queries, blocks, k, ("file",)), k, "file") == rows_of(retrieval.jaccard(queries, blocks, ("file",)), k, "file")


def test_tasks_return_no_more_than_the_best(spark):
    """All pairs that share a word are some thousands here; of copies no more than k come out either."""
    queries, blocks = tables(spark)
    for found in (retrieval.bm25_best(queries, blocks, 5), retrieval.jaccard_best(queries, blocks, 5)):
        assert found.count() <= 5 * 4 * 4  # k, queries that find any, tasks


def test_items_that_are_there_twice_are_one(spark):
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    blocks = spark.createDataFrame([("a", "common alpha"), ("a", "common alpha"), ("b", "word word")], "item string, text string")
    for best, every in ((retrieval.bm25_best, retrieval.bm25), (retrieval.jaccard_best, retrieval.jaccard)):
        assert rows_of(best(queries, blocks, 3), 3) == rows_of(every(queries, blocks).withColumn("score", F.round("score", 9)), 3)


def test_halves_are_rounded_up(spark):
    """1 / 128 in millionths is 7812.5."""
    queries = spark.createDataFrame([(1, "a")], "query_id long, text string")
    blocks = spark.createDataFrame([("x", "a " + " ".join(f"w{k}" for k in range(127)))], "item string, text string")
    assert retrieval.jaccard_best(queries, blocks, 1, places=6).first()["score"] == 0.007813
