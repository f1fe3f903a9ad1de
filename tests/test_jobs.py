"""The jobs and the index that follows its files: growing input, edits, deletes, reruns."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from jobs import common, compare_methods, index_blocks
from siftmill.operators.retrieval import hashing_encoder
from siftmill.plans.engine import STRATEGIES
from siftmill.streaming import ingestion
from tests.conftest import ROOT
from tests.oracle import SMALL, rows_of_query, rows_of_sql

KIND = "repo string, path string, text string, deleted boolean"


def lines(name, n, changed=()):
    return "\n".join(f"{name} line {k}{' edited' if k in changed else ''}" for k in range(n))


FIRST = [("a", "x.py", lines("x", 40), False), ("a", "y.py", lines("y", 20), False), ("b", "x.py", lines("bx", 5), False), (None, "n.py", "one\ntwo", False), ("", "n.py", "three", False), ("a", "blank.py", "\n\n", False), ("a", "null.py", None, False)]
SECOND = [("a", "x.py", lines("x", 40, {3}), False), ("a", "y.py", None, True), ("a", "z.py", lines("y", 20), False), ("b", "x.py", lines("bx", 5), False)]  # an edit, a rename, no change
THIRD = [("b", "x.py", None, True), ("b", "new\x1f.py", "fresh", False), ("a", "x.py", lines("x", 41, {3}), False), ("c", "never.py", None, True)]


def batch(spark, rows):
    return spark.createDataFrame(rows, KIND)


def after(*batches):
    """The files as they are after all batches."""
    held = {}
    for rows in batches:
        for repo, path, text, deleted in rows:
            held[repo, path] = None if deleted else text or ""
    return [(repo, path, text, False) for (repo, path), text in held.items() if text is not None]


def blocks(spark, index, *extra):
    return sorted(map(tuple, ingestion.blocks(spark, index).select("repo", "path", "content_id", "block_no", "start", "end", "tokens", "block_id", "content", *extra).collect()), key=repr)


def files_of(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_batches_equal_a_rebuild(spark, tmp_path):
    index, whole = f"{tmp_path}/index", f"{tmp_path}/whole"
    counts = [ingestion.upsert(batch(spark, rows), index, k, buckets=4) for k, rows in enumerate((FIRST, SECOND, THIRD))]
    ingestion.upsert(batch(spark, after(FIRST, SECOND, THIRD)), whole, 0, buckets=4)
    assert blocks(spark, index) == blocks(spark, whole)
    assert [(c["files"], c["changed"], c["deleted"]) for c in counts] == [(7, 7, 0), (4, 3, 1), (4, 3, 1)]
    heads = {(r["repo"], r["path"]) for r in ingestion.read(spark, index).filter("block_no IS NULL AND content_id IS NOT NULL").collect()}
    assert heads == {(repo, path) for repo, path, _, _ in after(FIRST, SECOND, THIRD)}


def test_only_partitions_with_changes_are_written(spark, tmp_path):
    index = f"{tmp_path}/index"
    ingestion.upsert(batch(spark, FIRST), index, 0, buckets=8)
    before = files_of(index)
    counts = ingestion.upsert(batch(spark, SECOND), index, 1, buckets=8)
    now = files_of(index)
    touched = {os.path.dirname(f) for f in before ^ now}
    assert len(touched) == counts["partitions"] and not any("repo-b" in f or "none" in f for f in touched)
    again = ingestion.upsert(batch(spark, SECOND), index, 1, buckets=8)
    assert again["changed"] == again["partitions"] == 0 and files_of(index) == now


def test_old_versions_are_void_and_the_latest_row_of_a_path_counts(spark, tmp_path):
    index = f"{tmp_path}/index"
    rows = [("a", "x.py", "old", 1), ("a", "x.py", "new", 2), ("a", "x.py", "older", 0), ("a", "y.py", "b", 1), ("a", "y.py", "a", 1)]
    ingestion.upsert(spark.createDataFrame(rows, "repo string, path string, text string, modified int"), index, 5)
    assert [(r["path"], r["content"]) for r in ingestion.blocks(spark, index).orderBy("path").collect()][0] == ("x.py", "new")
    assert ingestion.blocks(spark, index).count() == 2
    assert ingestion.upsert(batch(spark, [("a", "x.py", "late", False)]), index, 4)["changed"] == 0
    ingestion.upsert(batch(spark, [("a", "x.py", None, True)]), index, 6)
    assert ingestion.upsert(batch(spark, [("a", "x.py", "new", False)]), index, 5)["changed"] == 0
    assert {r["path"] for r in ingestion.blocks(spark, index).collect()} == {"y.py"}


def test_only_new_blocks_are_encoded(spark, tmp_path):
    index, seen = f"{tmp_path}/index", spark.sparkContext.accumulator(0)

    def encoder():
        encode = hashing_encoder(8)

        def counted(texts):
            seen.add(len(texts))
            return encode(texts)

        return counted

    ingestion.upsert(batch(spark, [("a", "x.py", lines("x", 60), False)]), index, 0, encoder=encoder)
    first = {r["block_no"]: list(r["vector"]) for r in ingestion.blocks(spark, index).collect()}
    assert seen.value == 4
    ingestion.upsert(batch(spark, [("a", "x.py", lines("x", 60, {20}), False)]), index, 1, encoder=encoder)
    rows = {r["block_no"]: r for r in ingestion.blocks(spark, index).collect()}
    assert {k: r["since"] for k, r in rows.items()} == {0: 0, 1: 1, 2: 0, 3: 0} and seen.value == 5
    assert {k: list(r["vector"]) for k, r in rows.items() if k != 1} == {k: v for k, v in first.items() if k != 1}


@pytest.mark.parametrize("strategy", sorted(STRATEGIES))
def test_every_chunker_can_feed_an_index(spark, tmp_path, strategy):
    ingestion.upsert(batch(spark, FIRST), f"{tmp_path}/index", 0, STRATEGIES[strategy])
    assert {(r["repo"], r["path"]) for r in ingestion.blocks(spark, f"{tmp_path}/index").select("repo", "path").distinct().collect()} >= {("a", "x.py"), (None, "n.py"), ("", "n.py")}


def test_an_index_follows_a_growing_folder(spark, tmp_path):
    """Two runs over growing input: the second takes the new file alone, and all is as if built at once."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    source, index, mark = f"{tmp_path}/source", f"{tmp_path}/index", f"{tmp_path}/mark"
    docs.filter("doc_id % 3 <> 0").coalesce(1).write.parquet(source)
    first = index_blocks.run(spark, source, index, mark)
    assert sum(b["files"] for b in first) == docs.filter("doc_id % 3 <> 0").count()
    before = files_of(index)
    changed = docs.filter("doc_id % 3 = 0 OR doc_id = 1").withColumn("text", F.when(F.col("doc_id") == 1, "changed").otherwise(F.col("text")))
    changed.coalesce(1).write.mode("append").parquet(source)
    second = index_blocks.run(spark, source, index, mark)
    assert sum(b["files"] for b in second) == changed.count() and all(b["batch"] > first[-1]["batch"] for b in second)
    assert index_blocks.run(spark, source, index, mark) == []
    final = docs.withColumn("text", F.when(F.col("doc_id") == 1, "changed").otherwise(F.col("text")))
    final.select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), "text", F.lit(False).alias("deleted")).createOrReplaceTempView("whole_files")
    ingestion.upsert(spark.table("whole_files"), f"{tmp_path}/whole", 0)
    spark.catalog.dropTempView("whole_files")
    assert blocks(spark, index) == blocks(spark, f"{tmp_path}/whole")
    assert before & files_of(index) or second[0]["partitions"] == len({os.path.dirname(f) for f in before})


def test_small_batches_give_the_same_index(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.repartition(5).write.parquet(f"{tmp_path}/source")
    config = f"{tmp_path}/config.json"
    with open(config, "w") as out:
        json.dump({"files_per_batch": 2, "buckets": 3}, out)
    assert len(index_blocks.run(spark, f"{tmp_path}/source", f"{tmp_path}/index", f"{tmp_path}/mark", config)) == 3
    index_blocks.run(spark, f"{tmp_path}/source", f"{tmp_path}/other", f"{tmp_path}/other-mark")
    assert blocks(spark, f"{tmp_path}/index") == blocks(spark, f"{tmp_path}/other")


def test_settings(spark, tmp_path):
    with open(f"{tmp_path}/bad.json", "w") as out:
        json.dump({"bucket": 3}, out)
    with pytest.raises(ValueError, match="bucket"):
        common.settings(spark, f"{tmp_path}/bad.json", index_blocks.DEFAULTS)
    for job in (index_blocks, compare_methods):
        path = f"{ROOT}/jobs/{job.__name__.split('.')[-1]}.json"
        assert common.settings(spark, path, job.DEFAULTS) == job.DEFAULTS


@pytest.mark.parametrize("name", ["job1_index_blocks", "job2_compare_methods"])
def test_jobs_equal_their_sql(spark, name):
    assert rows_of_query(__spark_entry__.queries()[name](spark, SMALL)) == rows_of_sql(__spark_entry__.oracle_sql()[name])


def test_a_method_is_added_and_reruns_agree(spark, tmp_path):
    out, config = f"{tmp_path}/out", f"{tmp_path}/config.json"
    paths = (f"{SMALL}/documents.parquet", f"{SMALL}/benchmark.parquet", out)
    rows = lambda: sorted(map(tuple, spark.read.schema(compare_methods.SCHEMA).parquet(out).collect()), key=repr)
    with open(config, "w") as file:
        json.dump({"methods": ["jaccard"]}, file)
    compare_methods.run(spark, *paths, config)
    first, kept = rows(), files_of(out)
    with open(config, "w") as file:
        json.dump({"methods": ["bm25"]}, file)
    compare_methods.run(spark, *paths, config)
    assert kept <= files_of(out) and set(first) < set(rows())
    both = rows()
    compare_methods.run(spark, *paths)
    assert rows() == both


def test_empty_tables(spark, tmp_path):
    docs, issues = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    docs.limit(0).write.parquet(f"{tmp_path}/docs")
    issues.limit(0).write.parquet(f"{tmp_path}/issues")
    assert compare_methods.run(spark, f"{tmp_path}/docs", f"{tmp_path}/issues", f"{tmp_path}/out")["ranked"] == 0
    assert {r["value"] for r in spark.read.schema(compare_methods.SCHEMA).parquet(f"{tmp_path}/out").collect()} <= {0.0}
    index_blocks.run(spark, f"{tmp_path}/docs", f"{tmp_path}/index", f"{tmp_path}/mark")
    assert ingestion.read(spark, f"{tmp_path}/index").count() == 0


def test_command_line(spark, tmp_path):
    """Started and stopped by the command line, in a session of its own."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    docs.coalesce(1).write.parquet(f"{tmp_path}/source")
    command = [sys.executable, "-m", "jobs.index_blocks", "--source", f"{tmp_path}/source", "--index", f"{tmp_path}/index", "--checkpoint", f"{tmp_path}/mark", "--config", f"{ROOT}/jobs/index_blocks.json"]
    done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_MASTER": "local[2]"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "batch 0: 30 files read, 30 changed" in done.stderr
    assert ingestion.read(spark, f"{tmp_path}/index").filter("block_no IS NULL").count() == 30
