"""Search by name and by content over nodes and blocks."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions.text import glob_regex, is_test_file, matches_file, search_name, squeezed_contains
from siftmill.operators.ranking import first_choice, preferring, top_k
from siftmill.operators.retrieval import bm25, partial_score, token_list_ratio
from siftmill.operators.scratch import kept


def by_name(terms: DataFrame, index: DataFrame) -> DataFrame:
    """``term, node_id`` by exact name, else by lower-case name (index: see ``graph.name_index``)."""
    asked = terms.select("term", search_name(F.col("term")).alias("name"))
    exact = asked.join(index.select("name", "node_id"), "name").select("term", "node_id")
    lower = asked.withColumn("lower_name", F.lower("name")).join(index.select("lower_name", "node_id"), "lower_name").select("term", "node_id")
    return first_choice([exact.distinct(), lower.distinct()], ["term"])


def by_dotted_name(terms: DataFrame, index: DataFrame) -> list[DataFrame]:
    """Options ``term, node_id, found_by`` for terms such as ``Class.method``, by the name after the last
    dot: nodes with all parts before it in their path; nodes of a file that it names; any node.

    Nodes of equal names are many, so terms meet only those that have the rarest of their parts, or a file that is
    a piece of what stands before the last dot; both are joins on equal keys. Only the last option returns all nodes of a name."""
    before = F.regexp_replace(F.regexp_replace("term", r"\.[^.]*\z", ""), r"^\s+|\s+\z", "")
    asked = terms.filter(F.contains("term", F.lit("."))).select("term", F.element_at(F.split(before, r"\s+"), -1).alias("prefix"), F.trim(F.regexp_extract("term", r"([^.]*)\z", 1)).alias("last"))
    hits = kept(by_name(asked.select(F.col("last").alias("term")).distinct(), index).withColumnRenamed("term", "last"))
    asked = kept(asked.join(hits.select("last").distinct(), "last", "left_semi"))
    path = F.split(F.replace(F.lower("node_id"), F.lit(".py"), F.lit("")), "[./:]")
    path = F.slice(path, F.lit(1), F.size(path) - 1)
    own = hits.select("last", "node_id", F.explode(F.array_distinct(path)).alias("part"))
    wanted = asked.filter("prefix <> ''").select("term", "last", F.array_distinct(F.split(F.lower("prefix"), r"\.")).alias("parts"))
    each = wanted.select("term", "last", "parts", F.explode("parts").alias("part"))
    counts = own.join(each.select("last", "part").distinct(), ["last", "part"], "left_semi").groupBy("last", "part").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counts, ["last", "part"]).groupBy("term", "last", "parts").agg(F.count(F.lit(1)).alias("known"), F.min_by("part", F.struct("n", "part")).alias("part"))
    within = rarest.filter(F.col("known") == F.size("parts")).join(own, ["last", "part"]).filter(F.size(F.array_except("parts", path)) == 0).select("term", "node_id")
    within = within.unionByName(asked.filter("prefix = ''").join(hits, "last").select("term", "node_id"))
    # Pieces of the prefix, of the lengths that files have, which are few.
    files = hits.withColumn("file", F.split_part("node_id", F.lit(":"), F.lit(1)))
    lengths = files.select(F.length("file").alias("n")).distinct()
    pieces = asked.join(F.broadcast(lengths), F.length("prefix") >= F.col("n")).select("term", "last", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("prefix") - F.col("n") + 1), lambda k: F.substring("prefix", k, F.col("n"))))).alias("file"))
    in_file = pieces.join(files, ["last", "file"]).select("term", "node_id")
    anywhere = asked.join(hits, "last").select("term", "node_id")
    return [found.withColumn("found_by", F.lit(by)) for found, by in ((within, "prefix"), (in_file, "file"), (anywhere, "suffix"))]


def cascade(terms: DataFrame, nodes: DataFrame, index: DataFrame, k: int = 5, k_fuzzy: int = 3) -> DataFrame:
    """``term, node_id, found_by`` of the first that finds any: exact id, the id without
    ``.__init__``, name, dotted name within its prefix or file, BM25 over ids, fuzzy ids. Nodes with only
    the last part of a dotted name come beside those of BM25 or fuzzy ids."""
    ids = nodes.select("node_id")
    exact = terms.join(ids, F.col("term") == F.col("node_id")).select("term", "node_id", F.lit("id").alias("found_by"))
    bare = terms.withColumn("node_id", F.regexp_replace("term", r"\.__init__$", "")).join(ids, "node_id", "left_semi").select("term", "node_id", F.lit("init").alias("found_by"))
    named = by_name(terms, index).withColumn("found_by", F.lit("name"))
    within, in_file, _ = by_dotted_name(terms, index)
    # What is read by several steps is kept, or each step's plan would hold all those before.
    sure = kept(first_choice([exact, bare, named, within, in_file], ["term"]))
    # All nodes of a name, BM25 and fuzzy ids only for what is left, since a part such as ``py`` is in most ids.
    rest = kept(terms.select("term").distinct().join(sure.select("term"), "term", "left_anti"))
    anywhere = by_dotted_name(rest, index)[-1]
    lexical = top_k(bm25(rest.select(F.col("term").alias("query_id"), F.col("term").alias("text")), ids.select(F.col("node_id").alias("item"), F.translate("node_id", "_./:", "    ").alias("text"))), ["query_id"], k)
    lexical = kept(lexical.select(F.col("query_id").alias("term"), F.col("item").alias("node_id"), F.lit("bm25").alias("found_by")))
    similar = fuzzy(rest.join(lexical.select("term"), "term", "left_anti"), ids, k_fuzzy).select("term", "node_id", F.lit("fuzzy").alias("found_by"))
    return sure.unionByName(first_choice([anywhere, lexical.unionByName(similar)], ["term", "node_id"]))


def fuzzy(terms: DataFrame, nodes: DataFrame, k: int = 5, term_block: int = 256, split: int = 1 << 15) -> DataFrame:
    """The best nodes by token-set ratio of their ids: ``term, node_id, score, rank``. Every term is
    scored against every distinct id, since close ones need not share any run of characters: terms are dealt into
    blocks of about ``term_block`` and ids into splits of about ``split``, a task takes one of each, and returns at
    most k rows a term. Neither comes to the driver.

    A digit that a term has not matches nothing of it, whichever it is. So ids that differ in such digits alone have
    one score, which is worked out once, for the k of them that come first."""
    plain = lambda c: F.translate(F.lower(c), "_-./:", "     ")
    terms = kept(terms.filter("term IS NOT NULL").select("term", plain(F.col("term")).alias("words")).distinct())
    ids = kept(nodes.filter("node_id IS NOT NULL").select("node_id", plain(F.col("node_id")).alias("words")).distinct())
    blocks, splits = max(1, -(-terms.count() // term_block)), max(1, -(-ids.count() // split))
    lot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = terms.select(F.col("term").alias("name"), "words", F.lit(True).alias("asks"), lot("term", blocks).alias("block"), every(splits).alias("split"))
    held = ids.select(F.col("node_id").alias("name"), "words", F.lit(False).alias("asks"), every(blocks).alias("block"), lot("node_id", splits).alias("split"))

    def best(part: pd.DataFrame) -> pd.DataFrame:
        names = [(name, " ".join(sorted(set(words.split())))) for name, words in part.loc[~part["asks"], ["name", "words"]].itertuples(index=False, name=None)]
        names.sort()
        shapes: dict[str, list[tuple[list[str], list[str]]]] = {}
        rows = []
        for term, words in part.loc[part["asks"], ["name", "words"]].itertuples(index=False, name=None):
            digits = "".join(c for c in "0123456789" if c in words)
            if digits not in shapes:
                alike: dict[str, list[str]] = {}
                other = {ord(c): "\0" for c in "0123456789" if c not in digits}
                for name, own in names:
                    if len(first := alike.setdefault(own.translate(other), [])) < k:
                        first.append(name)
                shapes[digits] = [(shape.split(), first) for shape, first in alike.items()]
            mine = sorted(set(words.split()))
            scored = ((-score, name) for shape, first in shapes[digits] for score in (token_list_ratio(mine, shape),) for name in first)
            rows += [(term, name, -score) for score, name in heapq.nsmallest(k, scored)]
        return pd.DataFrame(rows, columns=["term", "node_id", "score"]).astype({"score": "float64"})

    found = asked.unionByName(held).groupBy("block", "split").applyInPandas(best, "term string, node_id string, score double")
    return top_k(found, ["term"], k, ties=("node_id",))


def rerank_files(files: DataFrame, pattern: str) -> DataFrame:
    """``file`` with the score of its path against a pattern."""
    bare = F.regexp_replace("file", r"\.py$", "")
    return files.withColumn("score", partial_score(bare, F.lit(pattern.replace("*", "").removesuffix(".py").strip("/"))))


#: Characters of the parts that are looked for at once, which bounds what a task holds and what is broadcast.
MOST_CHARS = 1 << 20


def _finder(keys: list[str]) -> Callable[[str | None], list[str]]:
    """From a text to the digests of those of ``keys`` that it contains, in one pass over it."""
    import hashlib

    import ahocorasick

    every = [hashlib.md5(k.encode()).hexdigest() for k in keys if k == ""]
    found = ahocorasick.Automaton()
    for key in keys:
        if key:
            found.add_word(key, hashlib.md5(key.encode("utf-8", "surrogatepass")).hexdigest())
    if len(found):
        found.make_automaton()
    return lambda text: [] if text is None else every + (sorted({digest for _, digest in found.iter(text)}) if len(found) else [])


def containing(docs: DataFrame, parts: DataFrame, clean: Callable[[Column], Column] = lambda c: c, lot: int = 1000) -> DataFrame:
    """Rows of ``docs`` (text) with each of ``parts`` (part) that their text contains, both seen through ``clean``.

    Texts are read once, by an automaton of all parts, and stay where they are while the parts have no more than
    ``MOST_CHARS`` characters. More parts are dealt into blocks of that size and texts into lots of about ``lot``;
    a task takes one of each. Nothing is tested pair by pair."""
    spark = docs.sparkSession
    keyed = kept(parts.filter("part IS NOT NULL").withColumn("_key", clean(F.col("part"))).withColumn("_digest", F.md5("_key")))
    keys = keyed.select("_key").distinct()
    blocks = max(1, -(-(keys.agg(F.sum(F.length("_key"))).first()[0] or 0) // MOST_CHARS))
    if blocks == 1:
        shared = spark.sparkContext.broadcast([r[0] for r in keys.collect()])

        # One text at a time is made a Python string, whatever the size of a batch.
        @F.arrow_udf("array<string>")
        def digests(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            find = _finder(shared.value)
            for own in texts:
                yield pa.array((find(text.as_py()) for text in own), pa.list_(pa.string()), size=len(own))

        found = docs.withColumn("_digest", F.explode(digests(clean(F.col("text")))))
        return found.join(keyed.drop("_key"), "_digest").drop("_digest")
    rows = kept(docs.withColumn("_row", F.monotonically_increasing_id()))
    lots = max(1, -(-rows.count() // lot))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    texts = rows.select("_row", clean(F.col("text")).alias("text"), of("_row", lots).alias("lot"), every(blocks).alias("block"))
    wanted = keys.select(F.lit(-1).cast("long").alias("_row"), F.col("_key").alias("text"), every(lots).alias("lot"), of("_key", blocks).alias("block"))

    def find_all(part: pd.DataFrame) -> pd.DataFrame:
        is_key = part["_row"] == -1
        find = _finder(part.loc[is_key, "text"].tolist())
        pairs = [(row, digest) for row, text in part.loc[~is_key, ["_row", "text"]].itertuples(index=False, name=None) for digest in find(text)]
        return pd.DataFrame(pairs, columns=["_row", "_digest"]).astype({"_row": "int64", "_digest": "object"})

    pairs = texts.unionByName(wanted).groupBy("lot", "block").applyInPandas(find_all, "_row long, _digest string")
    return rows.join(pairs, "_row").drop("_row").join(keyed.drop("_key"), "_digest").drop("_digest")


def filtered_hits(hits: DataFrame, file_pattern: str | None = None, with_tests: bool = False, content: str | None = None) -> DataFrame:
    """Filters on hits (file, content) after the top-k of a vector search."""
    if not with_tests:
        hits = hits.filter(~is_test_file(F.col("file")))
    if file_pattern:
        hits = hits.filter(matches_file(F.col("file"), file_pattern))
    if content:
        hits = hits.filter(squeezed_contains(F.col("content"), F.lit(content)))
    return hits


def capped_spans(hits: DataFrame, by: list[str], most: int, per_file: int | None = None) -> DataFrame:
    """The best hits, at most ``per_file`` of a file."""
    if per_file:
        hits = top_k(hits, [*by, "file"], per_file, ties=("span_id",)).drop("rank")
    return top_k(hits, by, most, ties=("file", "span_id"))


def entity_contents(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of ids in the ids' order (position, node_id)."""
    return ids.join(nodes, "node_id").orderBy("position")


def hybrid(named: DataFrame, classes: DataFrame, functions: DataFrame, semantic: DataFrame, by: list[str], k: int = 25) -> DataFrame:
    """Hits by class and function name together; where there are none, hits of either alone; where
    there are none, semantic hits. Each option has by, file, span_id and score."""
    return capped_spans(first_choice([named, classes.unionByName(functions).distinct(), semantic], by), by, k)


def spans_of_hits(hits: DataFrame, blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Vector hits (query_id, item, score) as spans: the blocks' span ids, or for blocks without any the
    spans (file, span_id, start, end, tokens) on their lines; best score first, with running tokens."""
    from siftmill.operators.ranges import overlap_join

    found = hits.join(blocks, "item")
    listed = found.filter(F.size("span_ids") > 0).select("query_id", "file", "score", F.explode("span_ids").alias("span_id"))
    bare = found.filter(F.size("span_ids") == 0).select("query_id", "file", "score", "start", "end")
    on_lines = overlap_join(bare, spans.select("file", "span_id", F.col("start").alias("other_start"), F.col("end").alias("other_end")), ["file"]).select("query_id", "file", "score", "span_id")
    best = listed.unionByName(on_lines).groupBy("query_id", "file", "span_id").agg(F.max("score").alias("score"))
    sized = best.join(spans.select("file", "span_id", "tokens"), ["file", "span_id"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "file", "span_id").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("tokens_so_far", F.sum("tokens").over(order))


def line_windows(lines: DataFrame, around: int = 20) -> DataFrame:
    """Wanted lines (file, line, last) as merged windows of ``around`` lines on either side."""
    from siftmill.operators.ranges import merge

    wide = lines.select("file", F.greatest(F.col("line") - around, F.lit(1)).alias("start"), F.least(F.col("line") + around, F.col("last")).alias("end"))
    return merge(wide, ["file"])


def grouped_results(results: DataFrame) -> DataFrame:
    """Merged results (node_id, format, queries with position) by their queries, in the order of the
    first of them, then by format."""
    found = results.groupBy("queries").agg(F.min("position").alias("first"), F.sort_array(F.collect_list(F.struct("format", "node_id"))).alias("results"))
    return found.orderBy("first", F.array_join("queries", ","))


#: Spans that are no code of their own, and the order of formats, best first.
INERT_SPANS = ("docstring", "imports", "comments")
FORMATS = {"complete": 1, "code_snippet": 2, "preview": 3, "fold": 4}


def content_hits(hits: DataFrame, blocks: DataFrame, nodes: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """Ranked blocks as results, the first ``most`` of each group ``by``: ``by, place, kind, format, node_id, file,
    start, end, nodes, cut_before, cut_behind``.

    ``hits``: by, item, rank; ``blocks``: item, file, start, end, span_ids; ``nodes``: node_id, type, start, end. A block whose spans
    are all docstring, imports or comments (kind ``all``) is a snippet; one with some of them (``any``) is a snippet with the nodes of its
    other spans, and whether the first begins before or the last ends behind it; of one without (``none``) each
    span's node is a preview. Spans without a node are left out."""
    inert = lambda s: s.isin(list(INERT_SPANS))
    kind = F.when(F.forall("span_ids", inert), "all").when(F.exists("span_ids", inert), "any").otherwise("none")
    own = hits.select(*by, "item", "rank").join(blocks.select("item", "file", "start", "end", F.coalesce("span_ids", F.array().cast("array<string>")).alias("span_ids")), "item").withColumn("kind", kind)
    each = own.select(*by, "item", "rank", F.posexplode("span_ids").alias("_at", "span"), "file").withColumn("node_id", F.concat("file", F.lit(":"), "span"))
    known = each.join(nodes.select("node_id", F.col("start").alias("_from"), F.col("end").alias("_to")), "node_id")
    listed = known.groupBy(*by, "item").agg(F.array_sort(F.collect_list(F.struct("_from", "node_id", "_to"))).alias("_nodes"))
    none = F.array().cast("array<string>")
    snippets = own.filter("kind <> 'none'").join(listed, [*by, "item"], "left")
    some = (F.col("kind") == "any") & F.col("_nodes").isNotNull()
    snippets = snippets.select(
        *by, "rank", F.lit(0).alias("_at"), "kind", F.lit("code_snippet").alias("format"), F.col("file").alias("node_id"), "file", "start", "end",
        F.when(some, F.transform("_nodes", lambda n: n["node_id"])).otherwise(none).alias("nodes"),
        F.when(some & (F.get("_nodes", F.lit(0))["_from"] < F.col("start")), F.get("_nodes", F.lit(0))["node_id"]).alias("cut_before"),
        F.when(some & (F.element_at("_nodes", -1)["_to"] > F.col("end")), F.element_at("_nodes", -1)["node_id"]).alias("cut_behind"),
    )
    nothing = F.lit(None).cast("string")
    previews = known.join(own.filter("kind = 'none'").select(*by, "item", "kind"), [*by, "item"]).select(
        *by, "rank", "_at", "kind", F.lit("preview").alias("format"), "node_id", "file", F.col("_from").alias("start"), F.col("_to").alias("end"), none.alias("nodes"), nothing.alias("cut_before"), nothing.alias("cut_behind")
    )
    both = snippets.unionByName(previews)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("rank", "_at"))
    return both.withColumn("place", place).filter(F.col("place") <= most).drop("rank", "_at")


def _entities(terms: DataFrame, nodes: DataFrame, index: DataFrame) -> DataFrame:
    """``request_id, at, term, node_id, found_by`` of terms (request_id, at, term, pattern) that are names: an id, an id without
    ``.__init__``, a name, or a dotted name within its prefix or file; in files of the request's pattern, if any is. Nodes with only the
    last part of a dotted name (``suffix``) come along, but settle nothing."""
    key = ["request_id", "at"]
    distinct = terms.select("term").distinct()
    ids = nodes.select("node_id")
    exact = distinct.join(ids, F.col("term") == F.col("node_id")).select("term", "node_id", F.lit("id").alias("found_by"))
    bare = distinct.filter(F.endswith("term", F.lit(".__init__"))).withColumn("node_id", F.regexp_replace("term", r"\.__init__\z", "")).join(ids, "node_id", "left_semi").select("term", "node_id", F.lit("init").alias("found_by"))
    named = by_name(distinct, index).withColumn("found_by", F.lit("name"))
    within, in_file, _ = by_dotted_name(distinct, index)
    sure = kept(first_choice([exact, bare, named, within, in_file], ["term"]))
    # All nodes of a name only for terms that nothing else finds.
    found = sure.unionByName(by_dotted_name(distinct.join(sure.select("term"), "term", "left_anti"), index)[-1])
    asked = terms.join(found, "term")
    within = F.col("found_by").isin("id", "init") | F.col("pattern").isNull() | F.rlike(F.split_part("node_id", F.lit(":"), F.lit(1)), glob_regex(F.col("pattern")))
    return preferring(asked, within, key).select(*key, "term", "pattern", "node_id", "found_by")


def snippets(requests: DataFrame, nodes: DataFrame, index: DataFrame, blocks: DataFrame, k: int = 10) -> DataFrame:
    """Results of a table of requests: ``request_id, place, terms, format, node_id, file, start, end, source``.

    ``requests``: request_id, terms (array), lines (array) and pattern (a file or a glob; null for all files); ``nodes``: node_id, type, start, end; ``index``: see
    ``graph.name_index``; ``blocks``: item, file, text, start, end, span_ids.

    Each term is looked up by name. Those that no name settles, and all such terms of a request joined to one, go
    to BM25 over ids (else fuzzy ids) and over contents. Lines are windows of the file that the pattern names. A node
    that several terms find is one result in its best format, with the positions of its terms; formats are: complete for an id,
    preview for up to three nodes of a type by name, else fold. Previews that another of the same terms covers
    are left out. Results come in the order of their first term, then of their format. Terms for tests are left
    out. All requests go through one plan, whatever their number."""
    from siftmill.operators.ranges import not_covered

    key = ["request_id", "at"]
    clean = F.regexp_replace(F.trim(F.regexp_replace("term", r"^\s+|\s+\z", "")), r"^\.+|\.+\z", "")
    terms = requests.select("request_id", F.posexplode("terms").alias("at", "term"), "pattern").filter(~is_test_file(F.col("term"))).withColumn("term", clean).filter("term <> ''")
    first = kept(_entities(terms, nodes, index))
    settled = first.filter("found_by <> 'suffix'").select(*key).distinct()
    rest = kept(terms.join(settled, key, "left_anti"))
    joint = rest.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda r: r["term"]), " ").alias("term"), F.first("pattern").alias("pattern"), F.count(F.lit(1)).alias("n"))
    # Behind all single terms.
    joint = kept(joint.filter("n > 1").select("request_id", F.lit(1_000_000).alias("at"), "term", "pattern"))
    second = kept(_entities(joint, nodes, index))
    open_terms = kept(rest.unionByName(joint.join(second.filter("found_by <> 'suffix'").select(*key), key, "left_anti")))
    entities = first.unionByName(second).join(nodes.select("node_id", "type", "start", "end"), "node_id")
    many = F.count(F.lit(1)).over(Window.partitionBy(*key, "type"))
    by_format = F.when(F.col("found_by") == "id", "complete").when((F.col("found_by") == "init") | (many <= 3), "preview").otherwise("fold")
    found = entities.withColumn("format", by_format).select(*key, "format", "node_id", "type", "start", "end", F.col("found_by").alias("source"))

    texts = kept(open_terms.select("term").distinct())
    asked = texts.select(F.col("term").alias("query_id"), F.col("term").alias("text"))
    matches = lambda file: F.col("pattern").isNull() | F.rlike(F.col(file), glob_regex(F.col("pattern")))
    lexical = top_k(bm25(asked, nodes.select(F.col("node_id").alias("item"), F.translate("node_id", "_./:", "    ").alias("text"))), ["query_id"], 10)
    lexical = kept(lexical.select(F.col("query_id").alias("term"), F.col("item").alias("node_id"), "rank"))
    similar = fuzzy(texts.join(lexical.select("term"), "term", "left_anti"), nodes, 3).select("term", "node_id", "rank", F.lit("fuzzy").alias("source"))
    ranked = open_terms.join(lexical.withColumn("source", F.lit("bm25")).unionByName(similar), "term").join(nodes.select("node_id", "type", "start", "end"), "node_id").withColumn("file", F.split_part("node_id", F.lit(":"), F.lit(1)))
    ranked = top_k(preferring(ranked, matches("file"), key).withColumnRenamed("rank", "_rank"), key, 5, score="_rank", ties=("node_id",), ascending=True)
    whole = F.col("type").isin("file", "directory")
    nth = F.row_number().over(Window.partitionBy(*key, whole).orderBy("rank"))
    ranked = ranked.withColumn("_nth", nth).filter(whole | (F.col("_nth") <= 3))
    found = found.unionByName(ranked.select(*key, F.when(whole, "fold").otherwise("preview").alias("format"), "node_id", "type", "start", "end", "source"))

    content = top_k(bm25(asked, blocks.select("item", "text")), ["query_id"], k).select(F.col("query_id").alias("term"), "item", "rank")
    hits = open_terms.join(content, "term").join(blocks.select("item", "file"), "item").filter(matches("file")).select(*key, "item", "rank")
    content = content_hits(hits, blocks, nodes, key)
    previews = content.filter("format = 'preview'").join(nodes.select("node_id", "type"), "node_id").select(*key, "format", "node_id", "type", "start", "end", F.lit("content").alias("source"))
    found = found.unionByName(previews)

    order = F.lit(len(FORMATS) + 1)
    for name, n in FORMATS.items():
        order = F.when(F.col("format") == name, n).otherwise(order)
    merged = found.groupBy("request_id", "node_id").agg(
        F.min_by(F.struct("format", "source", "start", "end"), F.struct(order, "at", "source")).alias("b"), F.array_sort(F.collect_set("at")).alias("terms")
    ).select("request_id", "terms", "b.format", "node_id", F.split_part("node_id", F.lit(":"), F.lit(1)).alias("file"), "b.start", "b.end", "b.source")
    group = ["request_id", "terms", "file"]
    shown = not_covered(merged.filter("format = 'preview'"), group).unionByName(merged.filter("format <> 'preview'"))
    alone = content.filter("format = 'code_snippet'").select("request_id", F.array("at").alias("terms"), "format", "node_id", "file", "start", "end", F.lit("content").alias("source"))
    files = nodes.filter("type = 'file'").select(F.col("node_id").alias("file"), F.col("end").alias("last"))
    wanted = requests.select("request_id", F.col("pattern").alias("file"), F.explode("lines").alias("line")).join(files, "file")
    # One request's windows of a file are merged with no other's.
    wide = line_windows(wanted.select(F.concat_ws("\x1f", F.col("request_id").cast("string"), "file").alias("file"), "line", "last"))
    part = lambda n: F.get(F.split("file", "\x1f", 2), F.lit(n))
    wide = wide.select(part(0).cast(requests.schema["request_id"].dataType).alias("request_id"), F.array(F.lit(2_000_000)).alias("terms"), F.lit("code_snippet").alias("format"), part(1).alias("node_id"), part(1).alias("file"), "start", "end", F.lit("lines").alias("source"))
    rows = shown.unionByName(alone).unionByName(wide)
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.get("terms", F.lit(0)), "terms", order, "file", "start", "node_id"))
    return rows.withColumn("place", place).select("request_id", "place", "terms", "format", "node_id", "file", "start", "end", "source")
