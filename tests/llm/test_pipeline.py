"""The pipeline's stages, one by one and together."""

import collections

import corpus_pipeline
from siftmill.llm import quality_rules, secret_scan, simhash_dedup
from tests.oracle import SMALL


def test_stages_in_order(spark):
    docs, counts = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SMALL).cache()
        counts.append((name, before.count(), docs.count()))
        if name == "best-fit packing":
            assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
            continue
        assert docs.columns == before.columns
        if name == "quality rules":
            good = {r["doc_id"] for r in quality_rules.judge(before).filter("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == good
        if name == "simhash near-dedup":
            groups = {r["component_id"] for r in simhash_dedup.link(before).collect()}
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(groups)
        if name == "secret scan":
            told = secret_scan.scan(docs).filter("n_access + n_hex > 0").count()
            assert told == 0 and docs.count() == before.count()
        if name == "source mixing":
            times = collections.Counter(r["doc_id"] for r in docs.collect())
            assert max(times.values()) <= 3
    assert counts[0][2] < counts[0][1] and counts[1][2] < counts[1][1]


def test_odd_rows_and_empty_tables(spark, odd):
    assert corpus_pipeline.run(spark, f"{odd}/full").count() > 0
    assert corpus_pipeline.run(spark, f"{odd}/none").count() == 0
