"""A corpus pipeline of five stages over ``documents``, each an operator of ``siftmill.llm``.

1. quality rules: documents that the rules reject go.
2. SimHash near-dedup: of each group of near copies the row with the smallest doc_id stays.
3. secret scan: reported spans are masked in the text.
4. mixing: documents leave or repeat so that sources come near their target weights.
5. packing: the mix as pieces in sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread for the next. All but the last return the columns of documents. Nulls, empty and very long
texts, repeated rows, empty tables and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import mixing, packing, quality_rules, secret_scan, simhash_dedup
from siftmill.llm.common import table, written


def _chars(docs: DataFrame) -> DataFrame:
    """n_chars anew, where a stage changes texts."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep. Null, empty and short texts go; repeated rows are judged alike; an empty table stays empty."""
    return quality_rules.good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id (null last); of equal rows one. Texts without words are copies of each other."""
    return simhash_dedup.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with reported spans masked; null and empty texts as they are. ``n_chars`` follows the text."""
    return _chars(secret_scan.redacted(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as many times as the mix takes them, none or up to three; texts without words go. Equal rows count each for itself."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: null or empty texts are one piece of id 0; long texts are cut; an empty table has none."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("secret scan", secrets), ("source mixing", mixed), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Fingerprints and token ids are not expressible in SQL; the stages are tested one by one.
ORACLE_SQL = None
