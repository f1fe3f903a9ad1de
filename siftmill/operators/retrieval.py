"""Scoring of blocks against queries: BM25, Jaccard, dense vectors, fuzzy names.

Lexical scores of all pairs are joins on tokens: the queries' tokens go to the blocks, and only pairs with a common
token meet (with a common word in most texts that is most pairs). Where queries are too many for a
broadcast, frequent tokens make large join groups, which are split by Spark's skew handling.

Where only each query's best are wanted (``bm25_best``, ``jaccard_best``), no pair leaves its task: blocks are scored in
small lots against the broadcast words of all queries, and a task returns at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.functions.text import word_set, words
from siftmill.operators.ranking import preferring, top_k
from siftmill.operators.scratch import kept


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75
    stop_words: tuple[str, ...] = ()


#: Rows of queries' tokens up to which they are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 200_000


def _small(df: DataFrame, most: int = MOST_BROADCAST) -> bool:
    return df.limit(most + 1).count() <= most


#: Bytes of a table, by Spark's estimate, whose pairs with all queries a task adds up.
_LOT_BYTES = 4 << 20


def _lots(df: DataFrame) -> int:
    """Into how many partitions the blocks of ``df`` are dealt: the more, the larger it is, so that a task's pairs do not grow."""
    spark = df.sparkSession
    files = df.inputFiles()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if files else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // _LOT_BYTES, 20_000))


def postings(blocks: DataFrame, params: Bm25 = Bm25(), by: tuple[str, ...] = (), wanted: DataFrame | None = None) -> DataFrame:
    """``token, item, tf, length`` (and the columns ``by``) of ``item, text``: the index that ``bm25``
    takes. Each block has a row with the empty token too, so that blocks and lengths can be counted.
    With ``wanted`` (by, token) only those tokens; a block's rows then lie together."""
    kept = F.filter(words(F.col("text")), lambda w: ~w.isin(list(params.stop_words))) if params.stop_words else words(F.col("text"))
    tokens = blocks.select(*by, "item", kept.alias("w")).select(*by, "item", F.size("w").alias("length"), F.explode(F.array_append("w", F.lit(""))).alias("token"))
    if wanted is not None:
        tokens = tokens.join(wanted, [*by, "token"], "left_semi").repartition(_lots(blocks), "item")
    return tokens.groupBy(*by, "item", "length", "token").agg(F.count(F.when(F.col("token") != "", 1)).alias("tf"))


def document_frequency(index: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return index.filter("token <> ''").groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"))


def bm25(queries: DataFrame, blocks: DataFrame | None, params: Bm25 = Bm25(), index: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, item, score`` of all pairs with a common token, and equal columns ``by`` (say the
    repository), within which tokens and lengths are counted too. idf is ln(1 + (N - df + 0.5) /
    (df + 0.5)); a token of a query counts as often as it occurs there. ``index``: see ``postings``.

    Only tokens of queries are kept of the blocks, before anything is shuffled, and the blocks' tokens
    then lie together, so that scores are summed where they are; queries' tokens are broadcast up to
    ``MOST_BROADCAST`` rows."""
    asked = queries.select("query_id", *by, F.explode(words(F.col("text"))).alias("token")).groupBy("query_id", *by, "token").agg(F.count(F.lit(1)).alias("qtf"))
    near = F.broadcast if _small(asked) else (lambda df: df)
    markers = queries.select(*by).distinct().withColumn("token", F.lit("")) if by else queries.sparkSession.range(1).select(F.lit("").alias("token"))
    wanted = near(asked.select(*by, "token").unionByName(markers).distinct())
    own = index.join(wanted, [*by, "token"], "left_semi").repartition(_lots(index), "item") if index is not None else postings(blocks, params, by, wanted)
    own = kept(own)  # read for scores, frequencies and lengths
    found = own.filter("token <> ''")
    stats = own.filter("token = ''").groupBy(*by).agg(F.count(F.lit(1)).alias("n_blocks"), F.avg("length").alias("mean"))
    weighed = asked.join(document_frequency(own, by), [*by, "token"])
    if by:
        weighed = weighed.join(stats, list(by))
        n, mean = F.col("n_blocks"), F.col("mean")
    else:
        n, mean = stats.select("n_blocks").scalar(), stats.select("mean").scalar()
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = weighed.select("query_id", *by, "token", (F.col("qtf") * idf).alias("weight"), mean.alias("mean"))
    tf = F.col("tf") * (params.k1 + 1) / (F.col("tf") + params.k1 * (1 - params.b + params.b * F.col("length") / F.col("mean")))
    return found.join(near(weighed), [*by, "token"]).groupBy("query_id", *by, "item").agg(F.sum(F.col("weight") * tf).alias("score"))


def bm25_files(queries: DataFrame, blocks: DataFrame, files: DataFrame, k_blocks: int, k_files: int, params: Bm25 = Bm25()) -> DataFrame:
    """Files in the order in which their blocks first appear among the best; ``files``: item, file."""
    best = top_k(bm25_best(queries, blocks, k_blocks, params), ["query_id"], k_blocks)
    seen = best.join(files, "item").groupBy("query_id", "file").agg(F.min("rank").alias("score"))
    return top_k(seen, ["query_id"], k_files, ties=("file",), ascending=True).select("query_id", "file", "rank")


def bm25_preferred(queries: DataFrame, blocks: DataFrame, included: DataFrame, k: int) -> DataFrame:
    """The best positive scores; of each query only included items, if any of those scores."""
    scored = bm25(queries, blocks).filter("score > 0").join(included.select("item", F.lit(True).alias("_in")), "item", "left")
    kept = preferring(scored, F.coalesce("_in", F.lit(False)), ["query_id"]).drop("_in")
    return top_k(kept, ["query_id"], k)


def jaccard(queries: DataFrame, blocks: DataFrame, keep: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, item, score``: common over all distinct words, of pairs with a common word and equal
    columns ``by``. Columns of ``blocks`` to ``keep`` come along, which saves a join back. Queries' words
    are broadcast up to ``MOST_BROADCAST`` rows: only a block's words that some query has are shuffled,
    and pairs are counted where they then lie."""
    q = queries.select("query_id", *by, word_set(F.col("text")).alias("w")).select("query_id", *by, F.size("w").alias("n_query"), F.explode("w").alias("token"))
    b = blocks.select("item", *by, *keep, word_set(F.col("text")).alias("w")).select("item", *by, *keep, F.size("w").alias("n_item"), F.explode("w").alias("token"))
    near = F.broadcast if _small(q) else (lambda df: df)
    own = b.join(near(q.select(*by, "token").distinct()), [*by, "token"], "left_semi").repartition(_lots(blocks), "item")
    common = own.join(near(q), [*by, "token"]).groupBy("query_id", *by, "item", *keep, "n_query", "n_item").agg(F.count(F.lit(1)).alias("both"))
    return common.select("query_id", *by, "item", *keep, (F.col("both") / (F.col("n_query") + F.col("n_item") - F.col("both"))).alias("score"))


#: Sums of scores, and pairs of a block's word and a query, that a task works on at once.
_CELLS = 1 << 20


def _single(df: DataFrame, item: str) -> bool:
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _numbered(blocks: DataFrame, tokens: Column, keep: tuple[str, ...], vocabulary: list[str]) -> DataFrame:
    """``item``, the columns ``keep``, ``n`` (tokens), ``ids`` and ``tfs``: of each block the numbers of those of its tokens that are
    in ``vocabulary``, and how often each occurs. A row a block, written to the shared folder."""
    shared = blocks.sparkSession.sparkContext.broadcast(vocabulary)
    own = blocks.select("item", *keep, tokens.alias("_tokens"))
    names = ["item", *keep]
    schema = T.StructType([*(own.schema[c] for c in names), *(T.StructField(c, kind) for c, kind in (("n", T.IntegerType()), ("ids", T.ArrayType(T.IntegerType())), ("tfs", T.ArrayType(T.IntegerType()))))])

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.string())
        for whole in parts:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                held = part.column("_tokens")
                n = pc.list_value_length(held)
                place = pc.index_in(pc.list_flatten(held), value_set=wanted)
                found = place.is_valid().to_numpy(zero_copy_only=False)
                row = pc.list_parent_indices(held).to_numpy()[found].astype(np.int64)
                key, tf = np.unique(row * max(1, len(wanted)) + place.drop_null().to_numpy(), return_counts=True)
                row, ids = np.divmod(key, max(1, len(wanted)))
                ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, tf)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), n.cast(pa.int32()), *lists], names=[*names, "n", "ids", "tfs"])

    return kept(own.mapInArrow(number, schema))


def _best_scored(numbered: DataFrame, keep: tuple[str, ...], names: list, query_type: T.DataType, postings_of: list[tuple], n_words: int, k: int, score, gain, places: int | None, bounds: tuple[np.ndarray, np.ndarray] | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """``query_id, item, keep, score``: at most ``k`` rows a query and task, the best by score, then by item.

    ``postings_of``: number of a word, number of a query in ``names``, weight. A word's ``gain`` in a block (tf, n) times its weight is
    added up; ``score`` makes a score of the sums (of blocks by queries) and n. ``places``: scores are rounded before they are compared.

    With ``bounds``, each query's floor under its k-th best sum and what its words that are not essential can add at most, ``postings_of`` say too
    whether a word is essential to its query; only pairs whose essential words and the rest reach the floor are scored. ``counts``, if given,
    gets the numbers of those and of all pairs."""
    by_word, tally = sorted(postings_of), counts is not None
    essential = np.array([p[3] for p in by_word], bool) if bounds is not None else None
    by_word = [p[:3] for p in by_word]
    first = np.searchsorted(np.array([w for w, _, _ in by_word], np.int64), np.arange(n_words + 1))
    shared = numbered.sparkSession.sparkContext.broadcast((first, np.array([q for _, q, _ in by_word], np.int64), np.array([x for _, _, x in by_word], np.float64), essential, bounds))
    n_queries = max(1, len(names))
    columns = ["item", *keep]
    schema = T.StructType([T.StructField("_query", T.IntegerType()), *(numbered.schema[c] for c in columns), T.StructField("score", T.DoubleType())])
    order = [("_query", "ascending"), ("score", "descending"), ("item", "ascending")]

    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, queries, weights, essential, bounds = shared.value
        held, part, floor, seen = None, None, np.full(n_queries, -np.inf), np.zeros(2, np.int64)
        for part in parts:
            ids, tfs = (pc.list_flatten(part.column(c)).to_numpy() for c in ("ids", "tfs"))
            each = pc.list_value_length(part.column("ids")).to_numpy()
            n, starts = part.column("n").to_numpy(), np.concatenate([[0], np.cumsum(each)])
            meets = np.concatenate([[0], np.cumsum(first[ids + 1] - first[ids])])[starts]
            at = 0
            while at < part.num_rows:
                # As many blocks as stay within the bounds, one at least.
                to = max(at + 1, min(at + max(1, _CELLS // n_queries), int(np.searchsorted(meets, meets[at] + _CELLS, "right")) - 1))
                a, z = starts[at], starts[to]
                row, own = np.repeat(np.arange(to - at), each[at:to]), ids[a:z]
                times = first[own + 1] - first[own]
                word = np.repeat(np.arange(len(own)), times)
                post = first[own][word] + np.arange(len(word)) - np.repeat(np.cumsum(times) - times, times)
                each_gain, cell = gain(tfs[a:z], n[at:to][row]), row[word] * n_queries + queries[post]
                if bounds is not None:
                    some = essential[post]
                    sums = np.bincount(cell[some], each_gain[word[some]] * weights[post[some]], (to - at) * n_queries).reshape(to - at, n_queries)
                    wanted = (sums > 0) & (sums + bounds[1] >= bounds[0])
                    if tally:
                        seen += np.count_nonzero(wanted), len(np.unique(cell))
                    some = wanted.ravel()[cell]
                    word, post, cell = word[some], post[some], cell[some]
                sums = np.bincount(cell, each_gain[word] * weights[post], (to - at) * n_queries).reshape(to - at, n_queries)
                scores = np.where(sums > 0, score(sums, n[at:to, None]), -np.inf)
                if places is not None:
                    scores = np.floor(scores * 10.0**places + 0.5) / 10.0**places
                if to - at > k:
                    floor = np.maximum(floor, np.partition(scores, to - at - k, axis=0)[to - at - k])
                block, query = np.nonzero((scores >= floor) & (scores > -np.inf))
                at, began = to, at
                if not len(block):
                    continue
                taken = part.select(columns).take(pa.array(block + began))
                new = pa.table([pa.array(query, pa.int32()), *taken.columns, pa.array(scores[block, query])], names=[*schema.names])
                held = new if held is None else pa.concat_tables([held, new])
                held = held.take(pc.sort_indices(held, order, null_placement="at_start"))
                query = held.column("_query").to_numpy()
                nth = np.arange(len(query)) - np.searchsorted(query, query)
                held, query, nth = held.filter(pa.array(nth < k)), query[nth < k], nth[nth < k]
                full = nth == k - 1
                floor[query[full]] = np.maximum(floor[query[full]], held.column("score").to_numpy()[full])
        if held is not None:
            yield from held.combine_chunks().to_batches()
        if tally and part is not None:  # as queries that none has the number of
            rows = [pa.array([-1, -2], pa.int32()), *(pa.nulls(2, f.type) for f in part.select(columns).schema), pa.array(seen, pa.float64())]
            yield pa.RecordBatch.from_arrays(rows, names=schema.names)

    found = numbered.mapInArrow(best, schema)
    spark = numbered.sparkSession
    if counts is not None:
        found = kept(found)
        sums = {r["_query"]: int(r["n"]) for r in found.filter("_query < 0").groupBy("_query").agg(F.sum("score").alias("n")).collect()}
        for q, name in ((-1, "candidates"), (-2, "pairs")):
            counts[name] = counts.get(name, 0) + sums.get(q, 0)
    named = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("_query", T.IntegerType()), T.StructField("query_id", query_type)]))
    return found.join(F.broadcast(named), "_query").select("query_id", *columns, "score")


def bm25_best(queries: DataFrame, blocks: DataFrame, k: int, params: Bm25 = Bm25(), places: int = 9) -> DataFrame:
    """``query_id, item, score``: candidates for the ``k`` best blocks of each query by ``bm25`` (see there), rounded to ``places``,
    ties by item; unranked. Nothing is grouped by pairs of query and block: a block's words are counted in its row, a task keeps
    ``k`` rows a query. More query words than ``MOST_BROADCAST``, and items that are there twice, go through all pairs."""
    asked = kept(queries.select("query_id", F.explode(words(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf")))
    rounded = lambda: bm25(queries, blocks, params).withColumn("score", F.round("score", places))
    if not _small(asked):
        return rounded()
    rows = asked.collect()  # MOST_BROADCAST at most
    vocabulary = sorted({r["token"] for r in rows} - set(params.stop_words))
    tokens = words(F.col("text"))
    if params.stop_words:
        tokens = F.filter(tokens, lambda w: ~w.isin(list(params.stop_words)))
    own = _numbered(blocks, tokens, (), vocabulary)
    if not _single(own, "item"):
        return rounded()
    df = {r["id"]: r["df"] for r in own.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).collect()}
    whole = own.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    n, mean, k1, b = whole["n"], whole["mean"] or 1.0, params.k1, params.b
    names, place = sorted({r["query_id"] for r in rows}, key=lambda x: (x is not None, x)), {w: i for i, w in enumerate(vocabulary)}
    at = {q: i for i, q in enumerate(names)}
    posted = [(place[r["token"]], at[r["query_id"]], r["qtf"] * float(np.log(1 + (n - df[place[r["token"]]] + 0.5) / (df[place[r["token"]]] + 0.5)))) for r in rows if place.get(r["token"]) in df]
    gain = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
    return _best_scored(own, (), names, queries.schema["query_id"].dataType, posted, len(vocabulary), k, lambda sums, _: sums, gain, places)


def jaccard_best(queries: DataFrame, blocks: DataFrame, k: int, keep: tuple[str, ...] = (), places: int | None = None) -> DataFrame:
    """``query_id, item, keep, score``: candidates for the ``k`` best blocks of each query by ``jaccard``, ties by item; unranked, as ``bm25_best``
    gives them. ``places``: scores are rounded first."""
    asked = kept(queries.select("query_id", word_set(F.col("text")).alias("w")).select("query_id", F.size("w").alias("n_query"), F.explode("w").alias("token")))
    every = lambda: jaccard(queries, blocks, keep) if places is None else jaccard(queries, blocks, keep).withColumn("score", F.round("score", places))
    if not _small(asked):
        return every()
    rows = asked.collect()  # MOST_BROADCAST at most
    vocabulary = sorted({r["token"] for r in rows})
    own = _numbered(blocks, word_set(F.col("text")), keep, vocabulary)
    if len({(r["query_id"], r["token"]) for r in rows}) < len(rows) or not _single(own, "item"):
        return every()
    sizes = {r["query_id"]: r["n_query"] for r in rows}
    if any(sizes[r["query_id"]] != r["n_query"] for r in rows):
        return every()
    names, place = sorted(sizes, key=lambda x: (x is not None, x)), {w: i for i, w in enumerate(vocabulary)}
    at = {q: i for i, q in enumerate(names)}
    n_query = np.array([sizes[q] for q in names], np.float64)
    return _best_scored(own, keep, names, queries.schema["query_id"].dataType, [(place[r["token"]], at[r["query_id"]], 1.0) for r in rows], len(vocabulary), k, lambda both, n: both / (n_query[None, :] + n - both), lambda tf, _: np.ones(len(tf)), places)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.empty((0, 0))


def _best(ids: np.ndarray, q: np.ndarray, names: np.ndarray, x: np.ndarray, k: int, metric: str) -> pd.DataFrame:
    """The ``k`` best rows of ``x`` for each row of ``q``, by a matrix product."""
    s = q @ x.T
    s = -s if metric == "dot" else (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * s
    s = np.round(s, 12)
    order = np.lexsort((np.broadcast_to(names, s.shape), s), axis=1)[:, :k]
    rows = np.repeat(np.arange(len(ids)), order.shape[1])
    score = s[rows, order.ravel()]
    return pd.DataFrame({"query_id": ids[rows], "item": names[order.ravel()], "score": -score if metric == "dot" else score})


def dense(queries: DataFrame, items: DataFrame, k: int, metric: str = "dot", by: tuple[str, ...] = (), query_block: int = 1024, split: int = 8192) -> DataFrame:
    """The ``k`` best items per query by ``dot`` (descending) or ``l2`` (squared distance, ascending)
    of ``query_id, vector`` with ``item, vector``, among those with equal columns ``by``: ``query_id,
    item, score``, unranked candidates.

    Queries are dealt into blocks of about ``query_block`` and items into splits of about ``split``, of
    each ``by`` by itself; a task takes one block and one split through a matrix product, whatever the
    number of either, and returns at most k rows a query. At most ``query_block`` queries, without
    ``by``, go to the items as a broadcast instead, which moves no item."""
    if metric not in ("dot", "l2"):
        raise ValueError(metric)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (items, "item"))]
    result = f"query_id {kinds[0]}, item {kinds[1]}, score double"
    if not by and len(few := queries.select("query_id", "vector").limit(query_block + 1).toPandas()) <= query_block:
        shared = queries.sparkSession.sparkContext.broadcast((few["query_id"].to_numpy(), _vectors(few["vector"])))

        def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for part in parts:
                if len(part) and len(ids):
                    yield _best(ids, q, part["item"].to_numpy(), _vectors(part["vector"]), k, metric)

        return items.filter("item IS NOT NULL AND vector IS NOT NULL").select("item", "vector").mapInPandas(best, result)
    key = list(by) or ["_all"]
    asked = queries.withColumn("_all", F.lit(0)).select("query_id", *key, "vector")
    held = items.withColumn("_all", F.lit(0)).select("item", *key, "vector")
    count = lambda df, size, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = count(asked, query_block, "_blocks").join(count(held, split, "_splits"), key)
    if by:
        asked, held = asked.join(sizes, key), held.join(sizes, key)
    else:
        row = sizes.first()
        counts = {c: F.lit(row[c] if row else 0) for c in ("_blocks", "_splits")}
        asked, held = asked.withColumns(counts), held.withColumns(counts)
    every = lambda n: F.explode(F.filter(F.sequence(F.lit(0), n), lambda i: i < n))
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    asked = asked.select(*key, F.col("query_id").alias("_query"), F.lit(None).cast(items.schema["item"].dataType).alias("_item"), "vector", own("query_id", "_blocks").alias("_block"), every(F.col("_splits")).alias("_split"))
    held = held.select(*key, F.lit(None).cast(queries.schema["query_id"].dataType).alias("_query"), F.col("item").alias("_item"), "vector", every(F.col("_blocks")).alias("_block"), own("item", "_splits").alias("_split"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        is_item = part["_item"].notna().to_numpy()
        q, x = part[~is_item], part[is_item]
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "item": [], "score": []})
        exact = lambda ids, like: ids.astype("int64").to_numpy() if like else ids.to_numpy()
        return _best(exact(q["_query"], whole[0]), _vectors(q["vector"]), exact(x["_item"], whole[1]), _vectors(x["vector"]), k, metric)

    whole = [kind in ("bigint", "int") for kind in kinds]
    # Ids as text, so that nulls of the other side don't turn them into floats.
    both = asked.unionByName(held).withColumns({c: F.col(c).cast("string") for c in ("_query", "_item")})
    return both.groupBy(*key, "_block", "_split").applyInPandas(solve, result)


def fuzzy_ratio(a: str, b: str) -> float:
    """100 times the share of matching characters in the longest common subsequence alignment."""
    total = len(a) + len(b)
    if not total:
        return 100.0
    # A row of lengths as bits: a zero stands where the length grows by one (Hyyrö 2004).
    at: dict[str, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    ones = (1 << len(a)) - 1
    row = ones
    for y in b:
        same = row & at.get(y, 0)
        row = (row + same | row - same) & ones
    return 100.0 * 2 * (len(a) - row.bit_count()) / total


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of sets of words: common words are compared with either set's whole."""
    return token_list_ratio(sorted(set(a.split())), sorted(set(b.split())))


def token_list_ratio(x: list[str], y: list[str]) -> float:
    """``token_set_ratio`` of distinct words, each list in the order in which they are compared."""
    if not x or not y:
        return 0.0
    in_x, in_y = set(x), set(y)
    both, only_a, only_b = " ".join(w for w in x if w in in_y), " ".join(w for w in x if w not in in_y), " ".join(w for w in y if w not in in_x)
    if both and (not only_a or not only_b):
        return 100.0
    whole_a, whole_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    found = [fuzzy_ratio(whole_a, whole_b)]
    if both:
        found += [fuzzy_ratio(both, whole_a), fuzzy_ratio(both, whole_b)]
    return max(found)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a part of the longer as long as it."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    return max(fuzzy_ratio(short, long[k : k + len(short)]) for k in range(len(long) - len(short) + 1))


@F.pandas_udf(T.DoubleType())
def token_set_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def partial_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x or "", y or "") for x, y in zip(a, b)])


def hashing_encoder(dimensions: int = 64):
    """A deterministic stand-in for a text encoder: hashed words, of unit length. Any function from
    a list of texts to a matrix serves as encoder."""
    import xxhash

    known: dict[str, int] = {}

    def place(word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        return known.setdefault(word, h % dimensions + (dimensions if h >> 63 else 0))

    def encode(texts: list[str]) -> np.ndarray:
        if len(known) > 1 << 16:
            known.clear()
        parts = [(text or "").lower().split() for text in texts]
        at = np.fromiter((known[w] if w in known else place(w) for part in parts for w in part), np.int64)
        row = np.repeat(np.arange(len(parts)), [len(part) for part in parts])
        sums = np.bincount(row * 2 * dimensions + at, minlength=len(parts) * 2 * dimensions).reshape(len(parts), 2, dimensions)
        out = (sums[:, 1] - sums[:, 0]).astype(np.float64)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return encode


def embed(rows: DataFrame, column: str = "text", encoder=None, batch: int = 256) -> DataFrame:
    """``rows`` with ``vector`` from an encoder, loaded once a task and fed in batches."""
    make = encoder or hashing_encoder

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = make()
        for texts in parts:
            done = [np.asarray(encode(texts.slice(k, batch).to_pylist()), np.float32) for k in range(0, len(texts), batch)]
            flat = np.concatenate(done) if done else np.empty((0, 0), np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel(), pa.float32()))

    return rows.withColumn("vector", run(F.col(column)))
