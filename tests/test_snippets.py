"""Snippet search over a table of requests, and hits by the kinds of their spans, on a small code base."""

import pytest
from pyspark.sql import functions as F

from siftmill.functions import text as tx
from siftmill.operators import graph, search

NODES = [
    ("src/a.py", "file", 1, 90), ("src/a.py:Loader", "class", 5, 60), ("src/a.py:Loader.run", "function", 10, 30), ("src/a.py:helper", "function", 61, 80),
    ("src/b.py", "file", 1, 200), ("src/b.py:Loader", "class", 1, 150), ("src/b.py:Loader.stop", "function", 20, 40), ("lib/c.py", "file", 1, 10), ("lib/c.py:run", "function", 1, 9),
    *((f"lib/d{k}.py:many", "function", k, k + 3) for k in range(5)),
]
BLOCKS = [
    (1, "src/a.py", "imports of the zebra module", 1, 4, ["imports"]), (2, "src/a.py", "a zebra crossing in the loader", 8, 20, ["docstring", "Loader", "Loader.run"]),
    (3, "src/b.py", "stop the zebra now", 20, 40, ["Loader.stop", "gone"]), (4, "lib/c.py", "nothing of note", 1, 9, []), (5, "lib/c.py", "giraffe", 1, 9, ["run"]),
]


def results(spark, requests):
    nodes = spark.createDataFrame(NODES, "node_id string, type string, start int, end int")
    blocks = spark.createDataFrame(BLOCKS, "item int, file string, text string, start int, end int, span_ids array<string>")
    asked = spark.createDataFrame(requests, "request_id int, terms array<string>, lines array<int>, pattern string")
    found = search.snippets(asked, nodes, graph.name_index(nodes), blocks)
    return [(r["request_id"], r["terms"], r["format"], r["node_id"], r["source"]) for r in found.orderBy("request_id", "place").collect()], found


def test_requests_of_every_kind(spark):
    requests = [
        (1, ["src/a.py:Loader.run"], None, None),  # an id
        (2, ["Loader"], None, None),  # a name of two nodes
        (3, ["Loader"], None, "src/b*"),  # within a pattern
        (4, ["many"], None, None),  # more than three
        (5, ["Loader.stop", "helper"], None, "nowhere*"),  # by prefix; a pattern that no file has
        (6, ["zebra", "crossing"], None, None),  # by content, single and joined
        (7, [], [12, 15], "src/a.py"),  # lines
        (8, ["tests/test_x.py", "src/b.py:Loader.__init__"], None, None),  # tests are left out
        (9, ["helper", "src/a.py:helper"], None, None),  # two terms, one node
        (10, None, None, None),
    ]
    rows, found = results(spark, requests)
    of = lambda k: [r[1:] for r in rows if r[0] == k]
    assert of(1) == [([0], "complete", "src/a.py:Loader.run", "id")]
    assert of(2) == [([0], "preview", "src/a.py:Loader", "name"), ([0], "preview", "src/b.py:Loader", "name")]
    assert of(3) == [([0], "preview", "src/b.py:Loader", "name")]
    assert of(4) == [([0], "fold", f"lib/d{k}.py:many", "name") for k in range(5)]
    assert of(5) == [([0], "preview", "src/b.py:Loader.stop", "prefix"), ([1], "preview", "src/a.py:helper", "name")]
    six = of(6)
    assert {r[2] for r in six if r[3] == "content" and r[1] == "code_snippet"} == {"src/a.py"} and any({0, 1_000_000} <= set(r[0]) and r[1:] == ("preview", "src/b.py:Loader.stop", "content") for r in six)
    assert sum(r[3] == "content" and r[1] == "code_snippet" and r[0] == [1_000_000] for r in six) == 2
    assert of(7) == [([2_000_000], "code_snippet", "src/a.py", "lines")]
    lines = found.filter("request_id = 7").first()
    assert (lines["start"], lines["end"]) == (1, 35)
    assert of(8) == [([1], "preview", "src/b.py:Loader", "init")]
    assert of(9) == [([0, 1], "complete", "src/a.py:helper", "id")]
    assert of(10) == []


def test_all_requests_go_through_one_plan(spark):
    """Requests do not see each other: together they give what each gives alone."""
    requests = [(k, terms, None, pattern) for k, (terms, pattern) in enumerate([(["Loader", "zebra"], None), (["zebra"], "src/b.py"), (["Loader"], "src/a.py"), (["girafe"], None)])]
    together, _ = results(spark, requests)
    alone = [r for request in requests for r in results(spark, [request])[0]]
    assert together == alone and any(r[4] == "fuzzy" for r in together)


def test_kinds_of_spans(spark):
    nodes = spark.createDataFrame(NODES, "node_id string, type string, start int, end int")
    blocks = spark.createDataFrame(BLOCKS, "item int, file string, text string, start int, end int, span_ids array<string>")
    hits = spark.createDataFrame([(1, k, k) for k in range(1, 6)], "query_id int, item int, rank int")
    found = search.content_hits(hits, blocks, nodes, ["query_id"]).orderBy("place").collect()
    assert [(r["kind"], r["format"], r["node_id"]) for r in found] == [("all", "code_snippet", "src/a.py"), ("any", "code_snippet", "src/a.py"), ("none", "preview", "src/b.py:Loader.stop"), ("all", "code_snippet", "lib/c.py"), ("none", "preview", "lib/c.py:run")]
    assert found[1]["nodes"] == ["src/a.py:Loader", "src/a.py:Loader.run"] and found[1]["cut_before"] == "src/a.py:Loader" and found[1]["cut_behind"] == "src/a.py:Loader.run"
    assert (found[2]["start"], found[2]["end"]) == (20, 40)
    assert search.content_hits(hits, blocks, nodes, ["query_id"], 2).count() == 2


@pytest.mark.parametrize("pattern", ["src/*.py", "**/*.py", "a?c", "[!x]y", "x.y", "a(b", "plain", "*[0-9].py", "a+b*"])
def test_patterns_of_a_column(spark, pattern):
    paths = ["src/a.py", "src/b/c.py", "abc", "ay", "xy", "x.y", "xzy", "a(b", "plain.py", "d1.py", "a+bc", "aab"]
    frame = spark.createDataFrame([(p, pattern) for p in paths], "path string, pattern string")
    rows = frame.select("path", F.rlike("path", tx.glob_regex(F.col("pattern"))).alias("a"), tx.matches_file(F.col("path"), pattern).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows), rows


@pytest.mark.parametrize("most", [1 << 20, 40])
@pytest.mark.parametrize("squeeze", [False, True])
def test_texts_that_contain_parts(spark, monkeypatch, most, squeeze):
    """By one automaton, and by blocks of parts and lots of texts, against every pair."""
    monkeypatch.setattr(search, "MOST_CHARS", most)
    texts = [(1, "the quick brown fox"), (2, "quick\tbrown"), (3, None), (4, ""), (5, "aaaa"), (6, "a line\nof quick brown foxes"), (6, "a line\nof quick brown foxes"), (7, "é ü ß 漢字 text")]
    parts = [(10, "quick brown"), (11, "aa"), (12, ""), (13, None), (14, "brown fox"), (15, "aa"), (16, "漢字"), (17, "qui ck"), (18, "nowhere at all"), (19, "\n")]
    clean = (lambda x: x.translate(str.maketrans("", "", " \t\n"))) if squeeze else (lambda x: x)
    want = sorted((d, p) for d, t in texts for p, x in parts if t is not None and x is not None and clean(x) in clean(t))
    docs, wanted = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(parts, "item_id int, part string")
    found = search.containing(docs, wanted, tx.squeezed if squeeze else (lambda c: c), lot=3)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == want
    assert "NestedLoopJoin" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [2, 256])
def test_fuzzy_names_by_all_pairs(spark, block):
    from siftmill.operators.retrieval import token_set_ratio

    names = ["load_file", "file.loader", "run", "Run.all", "a/b.py:Loader.load", "x", "zebra crossing", None]
    terms = ["loader", "load file", "zebra", "", None, "RUN"]
    plain = lambda x: x.lower().translate(str.maketrans("_-./:", "     "))
    want = sorted((t, n, k + 1) for t in terms if t is not None for k, (_, n) in enumerate(sorted((-token_set_ratio(plain(t), plain(n)), n) for n in names if n)[:3]))
    found = search.fuzzy(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(n,) for n in names], "node_id string"), 3, term_block=block, split=block)
    assert sorted((r["term"], r["node_id"], r["rank"]) for r in found.collect()) == want


def test_dotted_names_meet_only_their_parts(spark):
    """As many terms as nodes of one name: each finds its own by its parts."""
    n = 3000
    nodes = spark.range(n).select(F.concat(F.lit("p"), "id", F.lit("/q.py:work")).alias("node_id"), F.lit("function").alias("type"))
    terms = spark.range(n).select(F.concat(F.lit("p"), "id", F.lit(".q.work")).alias("term"))
    odd = spark.createDataFrame([(".work",), ("see p7/q.py.work",), ("xp7/q.pyx.work",), ("nothing.work",), ("p7.p8.work",)], "term string")
    within, in_file, anywhere = search.by_dotted_name(terms.unionByName(odd), graph.name_index(nodes))
    found = {t: k for t, k in within.groupBy("term").count().collect()}
    assert found.pop(".work") == n and len(found) == n and set(found.values()) == {1}
    # Parts split at dots: a term that ends in a file's name is found by the file.
    files = sorted((r["term"], r["node_id"]) for r in in_file.collect())
    assert files == [("see p7/q.py.work", "p7/q.py:work"), ("xp7/q.pyx.work", "p7/q.py:work")]
    assert anywhere.filter("term = 'nothing.work'").count() == n


def test_fuzzy_ids_that_differ_in_digits_alone(spark):
    from siftmill.operators import retrieval

    ids = [f"p{k:05d}.py:Brand" for k in range(500)] + [f"p{k:05d}.py:Brend{k % 7}" for k in range(500)]
    nodes = spark.createDataFrame([(i,) for i in ids], "node_id string")
    terms = ["Brandx", "Brend3 p00017", "Brond 9x"]
    plain = lambda c: "".join(" " if x in "_-./:" else x for x in c.lower())
    want = sorted((t, i, k + 1) for t in terms for k, (_, i) in enumerate(sorted((-retrieval.token_set_ratio(plain(t), plain(i)), i) for i in ids)[:3]))
    found = search.fuzzy(spark.createDataFrame([(t,) for t in terms], "term string"), nodes, 3)
    assert sorted((r["term"], r["node_id"], r["rank"]) for r in found.collect()) == want
