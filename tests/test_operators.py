"""Hand-built cases with expected values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from siftmill.functions import text as tx
from siftmill.operators import chunking, context, graph, metrics, patches, pyast, ranges, ranking, retrieval, search
from siftmill.plans import catalogue
from siftmill.sources import readers, writers
from siftmill.streaming import incremental
from tests.oracle import SMALL


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_fixed_drops_blank_blocks(spark):
    found = chunking.fixed(docs(spark, "a\n\n\n\nb", None, ""), 2)
    assert rows(found, "doc_id", "block_no", "start", "end", "content") == [(0, 0, 0, 1, "a\n"), (0, 1, 4, 4, "b")]


def test_sliding_windows(spark):
    found = chunking.sliding(docs(spark, "1\n2\n3\n4\n5"), 4, 2)
    assert rows(found, "start", "end") == [(0, 1), (0, 3), (2, 4)]


def test_filled_lines_keep_numbers(spark):
    text = "\n\n".join(str(k) for k in range(13))
    assert rows(chunking.filled_fixed(docs(spark, text)), "start", "end") == [(0, 22), (24, 24)]


def test_packed_paragraphs(spark):
    text = "\n".join(["x"] * 20) + "\n\n" + "\n".join(["y"] * 4)
    assert rows(chunking.packed_paragraphs(docs(spark, text)), "start", "end") == [(0, 14), (15, 24)]


def test_separated_overlap(spark):
    found = chunking.separated(docs(spark, "aaaa\nbbbb\ncccc\ndddd"), "\n", 9, 4)
    assert rows(found, "content") == [("aaaa\nbbbb",), ("bbbb\ncccc",), ("cccc\ndddd",)]


def test_recursive_pieces_fit(spark):
    text = "word " * 500 + "\n\n" + "x" * 2500
    pieces = chunking.split_recursively(text, 1000, 200)
    assert all(len(p) <= 1000 for p in pieces) and "x" * 1000 in pieces


def test_merge_intervals(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 3, 5), (1, 7, 8), (1, 9, 9)], "k int, start int, end int")
    assert rows(ranges.merge(df, ["k"]), "start", "end") == [(1, 5), (7, 8), (9, 9)]


def test_uncovered(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 6, 6)], "k int, start int, end int")
    whole = spark.createDataFrame([(1, 0, 9), (2, 0, 1)], "k int, first int, last int")
    assert rows(ranges.uncovered(df, whole, ["k"]), "k", "start", "end") == [(1, 0, 1), (1, 4, 5), (1, 7, 9), (2, 0, 1)]


@pytest.mark.parametrize(("path", "expected"), [("tests/a.py:x", True), ("src/my_testing.py", True), ("src/latest.py", False)])
def test_is_test_file(spark, path, expected):
    assert one(spark, tx.is_test_file(F.lit(path))) is expected


def test_identifiers(spark):
    assert one(spark, tx.instance_repo(F.lit("Own__name-1117"))) == "Own_name"
    assert one(spark, tx.module_of(F.lit("a/b.py:C.m"))) == "a/b.py:C"
    assert one(spark, tx.docs_entity(F.lit("a/b.py/C/m"))) == "a/b.py:C.m"
    assert one(spark, tx.clean_path(F.lit("/x/own/repo/src/a.py"), F.lit("own_repo"))) == "src/a.py"
    assert one(spark, tx.clean_path(F.lit("p//a.py"), F.lit("own_repo"))) == "a.py"
    assert one(spark, tx.path_in_text(F.lit("see /home/src/pkg/a.py now"), ["pkg", "src"])) == "src/pkg/a.py"
    assert one(spark, tx.function_name(F.lit("  async def go(x):"))) == "go"
    assert one(spark, tx.files_in_answer(F.lit("a.py\n```python\nx\n```\n"))) == {"a.py": "x"}
    assert one(spark, tx.numbered(F.lit("a\nb"), F.lit(9))) == "```\n 9 | a\n10 | b\n```"


def test_metrics_by_hand(spark):
    predicted = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "x"), (2, 2, "a")], "query_id int, rank int, item string")
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, "c")], "query_id int, item string")
    each = {(r["metric"], r["query_id"]): r["v"] for q in (1, 2) for m in metrics.METRICS for r in [{"metric": m, "query_id": q, "v": metrics.evaluate(predicted.filter(f"query_id = {q}"), truth.filter(f"query_id = {q}"), [2, 5], (m,)).filter("k = 2").first()["value"]}]}
    assert [each[m, 1] for m in ("acc", "precision", "recall", "ndcg", "map")] == [1, 0.5, 1, 1, 0.5]
    ndcg = round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 4)
    assert [each[m, 2] for m in ("acc", "precision", "recall", "ndcg", "map")] == [0, 0.5, round(1 / 3, 4), ndcg, 0.25]


def test_fusion(spark):
    df = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "b")], "q int, position int, rank int, item string")
    assert rows(ranking.majority(df, ["q"]), "rank", "item", "score") == [(1, "b", 2.0), (2, "a", 1.0)]
    assert rows(ranking.reciprocal_ranks(df, ["q"]), "rank", "item", "score") == [(1, "b", 1.5), (2, "a", 1.0)]


CODE = '''import os
from . import helper


class A(Base):
    size = 1

    def __init__(self):
        self.run()

    @property
    def run(self):
        def inner():
            return os.getcwd()
        return inner()


def top():
    return A()
'''


def test_python_relations(spark):
    files = spark.createDataFrame([("pkg/a.py", CODE), ("pkg/helper.py", "def h(): pass"), ("pkg/bad.py", "def (")], "path string, text string")
    assert rows(pyast.entities(files).filter("node_id LIKE '%a.py%'"), "node_id", "type") == [("pkg/a.py:A", "class"), ("pkg/a.py:A.run", "function"), ("pkg/a.py:A.run.inner", "function"), ("pkg/a.py:top", "function")]
    assert rows(pyast.calls(files), "src", "name", "etype") == [("pkg/a.py:A", "Base", "inherits"), ("pkg/a.py:A", "run", "invokes"), ("pkg/a.py:A.run", "inner", "invokes"), ("pkg/a.py:A.run", "property", "invokes"), ("pkg/a.py:A.run.inner", "getcwd", "invokes"), ("pkg/a.py:top", "A", "invokes")]
    nodes = files.select(F.col("path").alias("node_id"))
    assert rows(graph.module_files(pyast.imports(files), nodes), "src", "target") == [("pkg/a.py", "pkg/helper.py")]
    assert "size = 1" in pyast.skeleton_of(CODE) and "getcwd" not in pyast.skeleton_of(CODE)
    assert pyast.skeleton_of("def (") == "def ("
    names = [r[1] for r in pyast.function_rows("m.py", CODE)]
    assert names == ["m.py::A::__init__", "m.py::A::run", "m.py::A::inner", "m.py::top"]
    assert [r[1] for r in pyast.context_rows("m.py", CODE)] == ["m.py::A::__init__", "m.py::A::run", "m.py::A::run::inner", "m.py::top"]
    lines = pyast.line_entities(CODE)
    assert lines[6] == (None, "A") and lines[14] == ("A.inner", "A") and lines[19] == ("top", None)


def test_patch_lines():
    patch = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -2,2 +2,3 @@\n a\n-b\n+c\n+\n"
    assert list(patches.change_rows(patch)) == [("x.py", 0, "delete", 3, "b"), ("x.py", 0, "add", 3, "c")]


def test_import_lines(spark):
    code = ["from a import (", "  b,", ")", "x = 1", "import y"]
    df = spark.createDataFrame([(1, k, line) for k, line in enumerate(code)], "f int, line int, content string")
    assert [r["is_import"] for r in patches.import_lines(df, ["f"]).orderBy("line").collect()] == [True, True, True, False, True]


def test_fuzzy_scores():
    assert retrieval.token_set_ratio("a b c", "c b a d") == 100.0
    assert retrieval.fuzzy_ratio("abcd", "abce") == 75.0
    assert retrieval.partial_ratio("abc", "xxabcxx") == 100.0


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] + 1 if x == y else max(last[j], row[j - 1]))
    return row[-1]


def test_fuzzy_ratio_by_table():
    import random

    draw = random.Random(7)
    for _ in range(500):
        a, b = ("".join(draw.choices("abc ", k=draw.randint(0, 80))) for _ in range(2))
        assert retrieval.fuzzy_ratio(a, b) == (100.0 * 2 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0)


@pytest.mark.parametrize("block", [1024, 1])
def test_fuzzy_names_by_brute_force(spark, block):
    terms = ["abcdef", "red_widget", "zz", "hot bolt", ""]
    names = ["a1b2c3d4e5f", "xyz", "widget.red:x", "bolt", "hat_belt", "b/c.py:d", "q"]
    plain = lambda x: x.lower().translate(str.maketrans("_-./:", "     "))
    expected = [(t, n, r, s) for t in terms for r, (s, n) in enumerate(sorted(((retrieval.token_set_ratio(plain(t), plain(n)), n) for n in names), key=lambda x: (-x[0], x[1]))[:5], 1)]
    found = search.fuzzy(spark.createDataFrame([(x,) for x in terms], "term string"), spark.createDataFrame([(x,) for x in names * 2], "node_id string"), 5, block)
    assert rows(found, "term", "node_id", "rank", "score") == sorted(expected)
    assert ("abcdef", "a1b2c3d4e5f", 1) in {r[:3] for r in expected}


def test_cascade_takes_each_way(spark):
    nodes = spark.createDataFrame([("a/x.py:Foo.run", "function"), ("a/x.py:Foo", "class"), ("b/y.py:Bar.run", "function"), ("b/y.py:Parser", "class")], "node_id string, type string")
    asked = ["a/x.py:Foo", "a/x.py:Foo.__init__", "class Bar.run", "Foo.run", "foo.run", "b/y.py:Nope.run", "Other.run", "zzz y", "Pasrer", "class Parser", ".run"]
    found = search.cascade(spark.createDataFrame([(a,) for a in asked], "term string"), nodes.select("node_id"), graph.name_index(nodes), k_fuzzy=1)
    runs = [("a/x.py:Foo.run",), ("b/y.py:Bar.run",)]
    expected = {("a/x.py:Foo", "a/x.py:Foo", "id"), ("a/x.py:Foo.__init__", "a/x.py:Foo", "init"), ("class Parser", "b/y.py:Parser", "name"), ("class Bar.run", "b/y.py:Bar.run", "prefix")}
    expected |= {(t, "a/x.py:Foo.run", "prefix") for t in ("Foo.run", "foo.run")} | {("b/y.py:Nope.run", "b/y.py:Bar.run", "file"), ("Pasrer", "b/y.py:Parser", "fuzzy")}
    expected |= {("Other.run", n, "suffix") for (n,) in runs} | {(".run", n, "prefix") for (n,) in runs} | {("zzz y", n, "bm25") for n in ("b/y.py:Bar.run", "b/y.py:Parser")}
    assert set(rows(found, "term", "node_id", "found_by")) == expected


def test_terms_of_all_parts_take_each_way(spark):
    found = catalogue.QUERIES["search_cascade_parts"](spark, SMALL).toPandas()
    assert set(found["found_by"]) == {"id", "init", "name", "prefix", "suffix", "bm25", "fuzzy"}
    parts = spark.read.parquet(f"{SMALL}/part.parquet").toPandas()
    brands = {w: set(parts[parts["p_partkey"] % 7 == w]["p_brand"]) for w in range(7)}
    assert set(found["term"]) == {f"p{k}.py:{b}{'.__init__' if k % 7 else ''}" for k, b in zip(parts["p_partkey"], parts["p_brand"]) if k % 7 < 2} | {f"class {b}" for b in brands[2]} | {f"p{k}.{b}" for k, b in zip(parts["p_partkey"], parts["p_brand"]) if k % 7 == 3} | {f"Other.{b}" for b in brands[4]} | {f"number {b[6:]}" for b in brands[5]} | {f"Brend{b[6:]}x" for b in brands[6]}


def test_graph_distance(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x")], "src string, dst string, etype string")
    found = graph.k_hop(edges, spark.createDataFrame([("a",)], "node_id string"), -1)
    assert rows(found, "node_id", "distance") == [("a", 0), ("b", 1), ("c", 2)]


def test_mean_distance_of_a_long_path(spark):
    edges = spark.createDataFrame([(f"v{k}", f"v{k + 1}", "x") for k in range(24)] + [("v24", "v0", "x"), ("w", "v3", "x")], "src string, dst string, etype string")
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "node_id string")
    assert graph.mean_shortest_distance(edges, ids("v0", "w"), ids("v24", "v1", "gone")).first()[0] == 11.5
    assert graph.mean_shortest_distance(edges, ids("v0"), ids("w")).first()[0] is None


def test_span_budget_all_fit(spark):
    df = spark.createDataFrame([(1, "a", 0, 40), (1, "b", 1, 500)], "k int, span_id string, rank int, tokens int")
    assert rows(context.pack_spans(df, 1000, ["k"]), "span_id", "allotted") == [("a", 40), ("b", 500)]
    assert rows(context.pack_spans(df, 60, ["k"]), "span_id", "allotted") == [("a", 40)]


def test_repositories_keep_init_files(spark, tmp_path):
    for name, text in (("r/pkg/__init__.py", "x = 1"), ("r/pkg/a.py", "y"), ("r/.git/b.py", "z"), ("r/notes.txt", "n"), ("r/tests/test_a.py", "t")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    files = readers.repositories(spark, str(tmp_path))
    assert rows(files, "repo", "path") == [("r", "pkg/__init__.py"), ("r", "pkg/a.py"), ("r", "tests/test_a.py")]
    assert rows(readers.without_tests(files), "path") == [("pkg/__init__.py",), ("pkg/a.py",)]
    assert rows(readers.with_metadata(files).filter("category = 'test'"), "file_name") == [("test_a.py",)]


def test_block_index_round_trip(spark, tmp_path):
    blocks = spark.createDataFrame([("r", "fixed", "a.py", 0, 4, "x"), ("r", "fixed", "a.py", 5, 9, "y")], "repo string, strategy string, file_path string, start_line int, end_line int, content string")
    writers.block_index(blocks, str(tmp_path / "index"))
    assert rows(readers.index(spark, str(tmp_path / "index"), "r"), "block_id", "content") == [(0, "x"), (1, "y")]


def test_stream_takes_each_key_once(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(batch, "id long, x string").coalesce(1).write.mode("append").parquet(source)
        incremental.stream_new(spark, source, "id long, x string", sink, str(tmp_path / "check"), lambda df: df.withColumn("y", F.upper("x")), "id").awaitTermination()
    assert rows(spark.read.parquet(sink), "id", "y") == [(1, "A"), (2, "B"), (3, "C")]


def test_merge_of_equal_ranges(spark):
    """Equal ranges, whose order no ORDER BY settles, neither join two islands nor make one more."""
    from siftmill.operators import ranges

    rows = [("a", 10, 13)] * 3 + [("a", 15, 17)] * 2 + [("a", 22, 25)] * 5 + [("a", 22, 23), ("b", 1, 2)]
    own = spark.createDataFrame(rows, "k string, start long, end long").repartition(5)
    assert sorted(map(tuple, ranges.merge(own, ["k"]).collect())) == [("a", 10, 13), ("a", 15, 17), ("a", 22, 25), ("b", 1, 2)]
    whole = spark.createDataFrame([("a", 0, 30)], "k string, first long, last long")
    gaps = ranges.uncovered(own.filter("k = 'a'"), whole, ["k"])
    assert sorted(map(tuple, gaps.collect())) == [("a", 0, 9), ("a", 14, 14), ("a", 18, 21), ("a", 26, 30)]


def test_facts_of_files_by_one_parse(spark, monkeypatch):
    """Entities, imports and calls as their own operators give them; each file is parsed once."""
    from siftmill.operators import pyast

    texts = ["import os\nfrom . import b as c\n\n\nclass A(B):\n    def run(self):\n        return go()\n", "def (", "", None]
    files = spark.createDataFrame([(f"f{k}.py", text) for k, text in enumerate(texts)], "path string, text string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    found = pyast.facts(files)
    assert rows(pyast.of_kind(found, "entity")) == rows(pyast.entities(files).select("node_id", "type"))
    assert rows(pyast.of_kind(found, "import")) == rows(pyast.imports(files)) and rows(pyast.of_kind(found, "call")) == rows(pyast.calls(files))
    parsed, n = pyast.parsed, []
    monkeypatch.setattr(pyast, "parsed", lambda text: n.append(text) or parsed(text))
    tree = pyast.parsed(texts[0])
    assert [len(list(each("f0.py", texts[0], tree))) for each in (pyast.entity_rows, pyast.import_rows, pyast.call_rows)] == [2, 2, 2] and len(n) == 1
