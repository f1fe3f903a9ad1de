"""Whole runs: ingest files into an index, localise issues, evaluate the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.operators import chunking, mapping, metrics, pyast, ranking, retrieval

#: Chunkers of ``doc_id, text`` by name.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fixed": chunking.fixed,
    "sliding": chunking.sliding,
    "rl_fixed": chunking.filled_fixed,
    "rl_mini": chunking.packed_paragraphs,
    "separated": chunking.separated,
    "sentences": chunking.sentences,
    "tokens": chunking.token_windows,
    "recursive": chunking.recursive,
}


def ingest(files: DataFrame, strategy: str = "fixed", encoder=None) -> DataFrame:
    """``files`` (repo, path, text) as blocks: repo, file, block_no, start, end, text, item, vector."""
    own = files.select(F.concat("repo", F.lit("\x1f"), "path").alias("doc_id"), "text")
    cut = STRATEGIES[strategy](own).withColumnRenamed("content", "text")
    part = lambda k: F.split_part("doc_id", F.lit("\x1f"), F.lit(k))
    found = cut.select(part(1).alias("repo"), part(2).alias("file"), *[c for c in cut.columns if c != "doc_id"])
    found = found.withColumn("item", F.xxhash64("repo", "file", "block_no", "start"))
    return retrieval.embed(found, encoder=encoder)


def rank_blocks(instances: DataFrame, blocks: DataFrame, method: str = "bm25", k: int = 50, encoder=None) -> DataFrame:
    """The best ``k`` blocks of each instance's repository (query_id, repo, text): query_id, rank, score
    and the block's columns. Candidates and counts are those of the repository alone."""
    asked, repo = instances.select("query_id", "repo", "text"), ("repo",)
    if method == "dense":
        scored = retrieval.dense(retrieval.embed(asked, encoder=encoder).drop("text"), blocks.select("item", "repo", "vector"), k, by=repo)
    elif method == "jaccard":
        scored = retrieval.jaccard(asked, blocks.select("item", "repo", "text"), by=repo).drop("repo")
    else:
        scored = retrieval.bm25(asked, blocks.select("item", "repo", "text"), by=repo).drop("repo")
    return ranking.top_k(scored, ["query_id"], k).join(blocks.drop("vector", "text"), "item")


def localize(ranked: DataFrame, files: DataFrame, k_files: int = 10, k_modules: int = 10, k_entities: int = 50, sum_scores: bool = True) -> DataFrame:
    """``query_id`` with found_files, found_modules and found_entities, best first, of ranked blocks
    (query_id, repo, file, ...) and ``files`` (repo, path, text) of any number of repositories. Files by
    the sum of their blocks' scores, or in order of appearance."""
    by_file = ranking.group_scores(ranked, ["query_id"], "file", k_files) if sum_scores else mapping.found_files(ranked, k_files)
    line_map = pyast.line_map(files, ("repo",))
    entities, modules = mapping.by_lines(ranked.select("query_id", "repo", "rank", "file", "start", "end"), line_map, k_modules, k_entities, ("repo",))
    listed = lambda df, item, name: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda r: r[item]).alias(name))
    found = listed(by_file, "file", "found_files").join(listed(modules, "item", "found_modules"), "query_id", "left").join(listed(entities, "item", "found_entities"), "query_id", "left")
    none = F.array().cast("array<string>")
    return found.withColumns({c: F.coalesce(c, none) for c in ("found_modules", "found_entities")})


def evaluated(results: DataFrame, truth: DataFrame, levels: dict[str, list[int]] | None = None) -> DataFrame:
    """Metrics of ``localize`` against ``truth`` (query_id, level, item), a row per level, metric and k."""
    levels = levels or {"file": [1, 3, 5, 10], "module": [5, 10], "function": [5, 10]}
    column = {"file": "found_files", "module": "found_modules", "function": "found_entities"}
    out = None
    for level, k_values in levels.items():
        long = results.select("query_id", F.posexplode(column[level]).alias("at", "item")).select("query_id", (F.col("at") + 1).alias("rank"), "item")
        found = metrics.evaluate(long, truth.filter(F.col("level") == level), k_values).withColumn("level", F.lit(level))
        out = found if out is None else out.unionByName(found)
    return out
