"""Rank files for issues by several methods, and score each method against the files that are right.

    python -m jobs.compare_methods --files DOCS --issues ISSUES --out OUT [--config jobs/compare_methods.json]

Files are cut into blocks, each method ranks the best blocks of every issue, files come in the order of
the sums of their blocks' scores, and the right files of an issue are those that contain its text. The output is one
Parquet folder, partitioned by method and kind, in long form:

* ``kind=ranked``: ``query_id``, ``name`` (the file), ``k`` (its rank) and ``value`` (its score);
* ``kind=metric``: ``name`` (acc, ndcg, precision, recall, map), ``k`` and ``value``, without query_id.

A run overwrites the partitions of the methods that it is asked for, and leaves those of others, so that a method can
be added later; a run on the same tables writes the same rows.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from siftmill.operators import metrics, ranking, retrieval, search
from siftmill.operators.scratch import folder, kept
from siftmill.plans.engine import STRATEGIES
from siftmill.sources import readers

DEFAULTS = {"methods": ["bm25", "jaccard"], "strategy": "fixed", "top_blocks": 50, "top_files": 10, "k_values": [1, 3, 5, 10], "query": "item_id", "query_text": "text", "path": "doc_id", "text": "text"}
SCHEMA = "query_id string, name string, k int, value double, method string, kind string"
#: Scores are added up as whole millionths, so that sums do not depend on their order.
_PARTS = 1_000_000

log = logging.getLogger("jobs.compare_methods")


def _ranked(method: str, issues: DataFrame, blocks: DataFrame, top_blocks: int, top_files: int) -> DataFrame:
    """``query_id, item, rank, score``: files by the sum of the scores of their blocks among the best."""
    scored = {"bm25": retrieval.bm25_best, "jaccard": retrieval.jaccard_best}[method](issues, blocks.select("item", "text"), top_blocks, places=6)
    scored = scored.withColumn("score", F.round(F.col("score") * _PARTS).cast("long"))
    best = ranking.top_k(scored, ["query_id"], top_blocks).withColumn("file", F.regexp_replace("item", r":\d+$", ""))
    return ranking.group_scores(best, ["query_id"], "file", top_files).select("query_id", F.col("file").alias("item"), "rank", (F.col("score") / _PARTS).alias("score"))


def run(spark: SparkSession, files: str, issues: str, out: str, config: str | None = None) -> dict[str, int]:
    """Returns the number of files, issues and ranked rows."""
    given = common.settings(spark, config, DEFAULTS)
    docs = spark.read.parquet(files).select(F.col(given["path"]).cast("string").alias("doc_id"), F.col(given["text"]).alias("text"))
    docs = readers.spread(docs, "doc_id")
    asked = spark.read.parquet(issues).select(F.col(given["query"]).cast("string").alias("query_id"), F.col(given["query_text"]).alias("text"))
    blocks = STRATEGIES[given["strategy"]](docs).select(F.concat_ws(":", "doc_id", F.col("start").cast("string")).alias("item"), F.col("content").alias("text"))
    truth = kept(search.containing(docs.withColumnRenamed("doc_id", "item"), asked.withColumnRenamed("text", "part")).select("query_id", "item"))
    counts = {"files": docs.count(), "issues": asked.count(), "ranked": 0}
    log.info("read %(files)d files and %(issues)d issues", counts)
    for method in given["methods"]:
        ranked = kept(_ranked(method, asked, blocks, given["top_blocks"], given["top_files"]))
        scores = metrics.evaluate(ranked.filter(F.col("rank") <= max(given["k_values"])), truth, given["k_values"])
        long = ranked.select("query_id", F.col("item").alias("name"), F.col("rank").cast("int").alias("k"), F.round("score", 6).alias("value"), F.lit("ranked").alias("kind"))
        rows = long.unionByName(scores.select(F.lit(None).cast("string").alias("query_id"), F.col("metric").alias("name"), F.col("k").cast("int").alias("k"), "value", F.lit("metric").alias("kind")))
        rows = rows.withColumn("method", F.lit(method)).repartition("kind", F.pmod(F.xxhash64("query_id"), F.lit(8)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "kind").parquet(out)
        counts["ranked"] += (n := ranked.count())
        log.info("%s: wrote %d ranked files to %s", method, n, out)
    return counts


def job2_compare_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings and metrics of both methods after two runs."""
    top = folder(spark, "job2")
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{top}/out")
    return spark.read.schema(SCHEMA).parquet(f"{top}/out")


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"
SQL = rf"""WITH l AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[1:len(l)-1] ELSE l END AS l FROM (
  SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM documents)),
b AS (SELECT doc_id || ':' || s AS item, array_to_string(l[s+1:s+15], chr(10)) AS text FROM l, unnest(range(0, len(l), 15)) AS u(s) WHERE regexp_matches(array_to_string(l[s+1:s+15], chr(10)), '\S')),
bw AS MATERIALIZED (SELECT item, {_WORDS} AS w FROM b), qw AS (SELECT item_id::VARCHAR AS query_id, {_WORDS} AS w FROM benchmark),
jw AS MATERIALIZED (SELECT item, list_distinct(w) AS w FROM bw), jv AS MATERIALIZED (SELECT query_id, list_distinct(w) AS w FROM qw),
jb AS MATERIALIZED (SELECT item, len(w) AS n, unnest(w) AS token FROM jw), jq AS MATERIALIZED (SELECT query_id, len(w) AS n, unnest(w) AS token FROM jv),
js AS (SELECT 'jaccard' AS method, query_id, item, count(*) / (any_value(jq.n) + any_value(jb.n) - count(*)) AS score FROM jq JOIN jb USING (token) GROUP BY query_id, item),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM bw),
p AS MATERIALIZED (SELECT item, dl, token, count(*) AS tf FROM (SELECT item, len(w) AS dl, unnest(w) AS token FROM bw) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM p GROUP BY token), q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest(w) AS token FROM qw) GROUP BY ALL),
bs AS (SELECT 'bm25' AS method, query_id, item, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM q JOIN df USING (token) JOIN p USING (token), n GROUP BY query_id, item),
s AS (SELECT method, query_id, item, round(score * {_PARTS})::BIGINT AS score FROM (FROM js UNION ALL FROM bs)),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, item) AS rank FROM s),
f AS (SELECT method, query_id, regexp_replace(item, ':\d+$', '') AS name, sum(score)::BIGINT AS score, min(rank) AS seen FROM r WHERE rank <= 50 GROUP BY ALL),
o AS MATERIALIZED (SELECT method, query_id, name, score / {_PARTS} AS value, row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, seen, name)::INTEGER AS rank FROM f),
g AS (SELECT * FROM o WHERE rank <= 10),
truth AS MATERIALIZED (SELECT b.item_id::VARCHAR AS query_id, d.doc_id::VARCHAR AS name FROM documents d JOIN benchmark b ON contains(d.text, b.text)), size AS (SELECT query_id, count(*) AS g FROM truth GROUP BY query_id),
h AS (SELECT method, query_id, g.rank, row_number() OVER (PARTITION BY method, query_id ORDER BY g.rank) AS nth FROM g JOIN truth USING (query_id, name)),
ks AS (SELECT m AS method, k FROM (SELECT unnest(['bm25', 'jaccard']) AS m), (SELECT unnest([1, 3, 5, 10]) AS k)),
e AS (SELECT ks.method, s.query_id, k, g, count(h.rank) AS n, coalesce(sum(1 / log2(h.rank + 1)), 0) AS dcg, coalesce(sum(h.nth / h.rank), 0) AS ap FROM size s CROSS JOIN ks LEFT JOIN h ON h.query_id = s.query_id AND h.method = ks.method AND h.rank <= k GROUP BY ks.method, s.query_id, k, g),
v AS (SELECT method, k, round(avg((n = least(g, k))::INTEGER), 4) AS acc, round(avg(n / k), 4) AS precision, round(avg(n / least(g, 10)), 4) AS recall, round(avg(dcg / list_sum(list_transform(range(1, least(g, k) + 1), lambda i: 1 / log2(i + 1)))), 4) AS ndcg, round(avg(ap / k), 4) AS map FROM e GROUP BY ALL)
SELECT query_id, name, rank AS k, round(value, 6) AS value, method, 'ranked' AS kind FROM g
UNION ALL SELECT NULL, name, k::INTEGER, value, method, 'metric' FROM v UNPIVOT (value FOR name IN (acc, ndcg, precision, recall, map))"""


def main() -> None:
    parser = argparse.ArgumentParser(prog="jobs.compare_methods", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--files", required=True, help="Parquet table of files")
    parser.add_argument("--issues", required=True, help="Parquet table of issues")
    parser.add_argument("--out", required=True, help="folder of rankings and metrics")
    parser.add_argument("--config", help="JSON file of settings")
    args = parser.parse_args()
    common.logs()
    spark = SparkSession.builder.appName("compare_methods").getOrCreate()
    try:
        run(spark, args.files, args.issues, args.out, args.config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
