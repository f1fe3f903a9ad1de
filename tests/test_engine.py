"""From files and issues to evaluated locations."""

import pytest
from pyspark.sql import functions as F

from siftmill.plans import engine
from siftmill.sources import stores

FILES = [
    ("r", "pkg/io.py", "import os\n\n\nclass Reader:\n    def read_table(self, path):\n        return open(path).read()\n"),
    ("r", "pkg/net.py", "def fetch_socket(url):\n    return connect(url)\n"),
    ("other", "pkg/io.py", "def read_table(path):\n    return path\n"),
]


@pytest.mark.parametrize("method", ["bm25", "jaccard", "dense"])
def test_localise_and_evaluate(spark, method):
    files = spark.createDataFrame(FILES, "repo string, path string, text string")
    issues = spark.createDataFrame([("q1", "r", "def fetch_socket url fails"), ("q2", "r", "class reader read_table self path")], "query_id string, repo string, text string")
    ranked = engine.rank_blocks(issues, engine.ingest(files), method, 5)
    assert {r["repo"] for r in ranked.collect()} == {"r"}
    found = {r["query_id"]: r for r in engine.localize(ranked, files).collect()}
    assert "pkg/io.py:read_table" not in found["q2"]["found_entities"]
    assert found["q1"]["found_files"][0] == "pkg/net.py" and found["q1"]["found_entities"][0] == "pkg/net.py:fetch_socket"
    assert found["q2"]["found_files"][0] == "pkg/io.py" and "pkg/io.py:Reader" in found["q2"]["found_modules"]
    truth = spark.createDataFrame([("q1", "file", "pkg/net.py"), ("q2", "file", "pkg/io.py")], "query_id string, level string, item string")
    scores = engine.evaluated(engine.localize(ranked, files), truth, {"file": [1]})
    assert {r["metric"]: r["value"] for r in scores.collect()}["acc"] == 1.0


@pytest.mark.parametrize("method", ["bm25", "jaccard", "dense"])
def test_other_repositories_do_not_count(spark, method):
    rest = [(f"other{k}", "a.py", "def fetch_socket(url):\n    return url\n") for k in range(100)]
    issues = spark.createDataFrame([("q1", "r", "fetch_socket url")], "query_id string, repo string, text string")
    scored = lambda rows: [(r["file"], round(r["score"], 6)) for r in engine.rank_blocks(issues, engine.ingest(spark.createDataFrame(rows, "repo string, path string, text string")), method, 2).orderBy("rank").collect()]
    alone = [f for f in FILES if f[0] == "r"]
    assert scored(alone) == scored(FILES + rest) and scored(alone)[0][0] == "pkg/net.py"


@pytest.mark.parametrize("strategy", sorted(engine.STRATEGIES))
def test_every_strategy_makes_blocks_of_a_repository(spark, strategy):
    files = spark.createDataFrame(FILES, "repo string, path string, text string")
    found = engine.ingest(files, strategy).collect()
    assert {(r["repo"], r["file"]) for r in found} == {f[:2] for f in FILES} and all(len(r["vector"]) == 64 for r in found)


def test_vector_store(spark, tmp_path):
    empty = spark.createDataFrame([], stores.SCHEMA)
    new = spark.createDataFrame([("a", [0.0, 1.0], "test"), ("b", [1.0, 0.0], "implementation")], "doc_id string, vector array<float>, category string")
    store = stores.added(stores.added(empty, new), new.withColumn("doc_id", F.concat("doc_id", F.lit("2"))))
    assert [r["vector_id"] for r in store.orderBy("vector_id").collect()] == [0, 1, 2, 3]
    asked = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, vector array<float>")
    assert [r["doc_id"] for r in stores.nearest(store, asked, 2).orderBy("rank").collect()] == ["b", "b2"]
    assert stores.nearest(store, asked, 2, "test").count() == 0
    assert {r["doc_id"] for r in stores.deleted(store, new).collect()} == {"a2", "b2"}
    stores.Settings(dimensions=64).write(spark, str(tmp_path / "s"))
    assert stores.Settings.read(spark, str(tmp_path / "s")).dimensions == 64
