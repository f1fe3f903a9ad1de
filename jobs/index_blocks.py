"""Keep an index of blocks up to date with a growing folder of files.

    python -m jobs.index_blocks --source DOCS --index INDEX --checkpoint MARK [--config jobs/index_blocks.json]

Takes the Parquet files of the source that are new since the last run (file stream, availableNow), finds which paths
changed, cuts those into blocks and overwrites only the partitions they are in; see
``siftmill.streaming.ingestion``. A run without new files writes nothing, and a run after a failure ends where
the failed one would have. Each setting has a default; ``deleted`` names a boolean column, if the source has one.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from siftmill.operators.scratch import folder
from siftmill.plans.engine import STRATEGIES
from siftmill.streaming import ingestion

DEFAULTS = {"strategy": "fixed", "buckets": 8, "files_per_batch": 1000, "repo": "source", "path": "doc_id", "text": "text", "deleted": None}

log = logging.getLogger("jobs.index_blocks")


def run(spark: SparkSession, source: str, index: str, checkpoint: str, config: str | None = None) -> list[dict[str, int]]:
    """Returns what each batch read and wrote; an empty list where nothing was new."""
    given = common.settings(spark, config, DEFAULTS)
    columns = {name: F.col(given[name]) for name in ("repo", "path", "text", "deleted") if given[name]}
    log.info("reads what is new in %s since %s", source, checkpoint)
    batches = ingestion.follow(spark, source, index, checkpoint, columns, STRATEGIES[given["strategy"]], given["buckets"], given["files_per_batch"])
    for batch in batches:
        log.info("batch %(batch)d: %(files)d files read, %(changed)d changed, %(deleted)d of them deleted, %(partitions)d partitions written", batch)
    log.info("%d batches written to %s", len(batches), index)
    return batches


def job1_index_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents after two runs; ``version`` and ``since`` number batches, not rows, and are left out."""
    top = folder(spark, "job1")
    for _ in range(2):
        # As a pattern, since the table may be one file, and the folder of a file stream must be a folder.
        run(spark, f"{sf_dir}/document[s].parquet", f"{top}/index", f"{top}/checkpoint")
    found = ingestion.read(spark, f"{top}/index")
    return found.select("repo", "path", "content_id", "block_no", "start", "end", "tokens", "block_id", "content")


#: Blocks of 15 lines; a file's own row has no block number.
SQL = r"""WITH d AS (SELECT source AS repo, doc_id::VARCHAR AS path, sha256(coalesce(text, '')) AS content_id, CASE WHEN l[-1] = '' THEN l[1:len(l)-1] ELSE l END AS l FROM (
  SELECT doc_id, source, text, string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents)),
b AS (SELECT repo, path, content_id, s AS start, least(s + 15, len(l)) - 1 AS "end", array_to_string(l[s+1:s+15], chr(10)) AS content FROM d, unnest(range(0, len(l), 15)) AS u(s)),
k AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY start) - 1 AS block_no FROM b WHERE regexp_matches(content, '\S'))
SELECT repo, path, content_id, block_no, start, "end", len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> ''))::BIGINT AS tokens, md5(content) AS block_id, content FROM k
UNION ALL SELECT repo, path, content_id, NULL, NULL, NULL, NULL, NULL, NULL FROM d"""


def main() -> None:
    parser = argparse.ArgumentParser(prog="jobs.index_blocks", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--source", required=True, help="Parquet folder of files, which grows, or a pattern")
    parser.add_argument("--index", required=True, help="folder of the index")
    parser.add_argument("--checkpoint", required=True, help="folder that keeps what was taken")
    parser.add_argument("--config", help="JSON file of settings")
    args = parser.parse_args()
    common.logs()
    spark = SparkSession.builder.appName("index_blocks").getOrCreate()
    try:
        run(spark, args.source, args.index, args.checkpoint, args.config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
