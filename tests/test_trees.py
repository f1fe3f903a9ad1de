"""Trees as intervals, depth-first walks, batches of vectors and prompts against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from siftmill.operators import context, graph, metrics, trees
from siftmill.operators.scratch import folder
from siftmill.plans import catalogue
from siftmill.sources import stores


def forest(seed, n=60):
    """Rows of (file, path, start, end, span_id, tokens): random trees, two of the same shape."""
    rng = random.Random(seed)
    rows = []
    for file in ("a.py", "b.py"):
        paths = [["m"]]
        for k in range(n):
            paths.append([*rng.choice(paths), f"x{k:03d}"])
        for k, path in enumerate(sorted(paths)):
            rows.append((file, path, k, 0, rng.choice(["s", "t", "u", None]), rng.randint(0, 9)))
    return rows


@pytest.fixture(scope="module")
def tree(spark):
    rows = forest(1)
    below = lambda r, o: r[0] == o[0] and o[1][: len(r[1])] == r[1]
    rows = [(f, p, s, max(o[2] for o in rows if below((f, p), o)), span, t) for f, p, s, _, span, t in rows]
    frame = spark.createDataFrame(rows, "file string, path array<string>, start int, end int, span_id string, tokens int").repartition(3)
    return rows, trees.numbered(frame, ["file"], {"whole": F.col("tokens")}).cache()


def at(tree):
    return {(r["file"], tuple(r["path"])): r for r in tree.collect()}


def test_intervals_and_sums(tree):
    rows, numbers = tree
    found = at(numbers)
    for f, p, *_ in rows:
        r, below = found[f, tuple(p)], [o for o in rows if o[0] == f and o[1][: len(p)] == p]
        assert r["below"] == len(below) - 1 and r["whole"] == sum(o[5] for o in below) and r["depth"] == len(p) - 1
        inner = {k for k, o in found.items() if k[0] == f and r["left"] < o["left"] and o["right"] < r["right"]}
        assert inner == {(o[0], tuple(o[1])) for o in below} - {(f, tuple(p))}
    for f, p, *_ in rows:
        beside = sorted(o[1] for o in rows if o[0] == f and o[1][:-1] == p[:-1])
        r = next(x for x in trees.beside(numbers, ["file"], "whole").filter(F.col("file") == f).collect() if x["path"] == p)
        assert r["before"] == sum(found[f, tuple(x)]["whole"] for x in beside if x < p) and r["after"] == sum(found[f, tuple(x)]["whole"] for x in beside if x > p)
        if len(beside) > 2:
            break


def test_lookups(spark, tree):
    rows, numbers = tree
    found = at(numbers)
    left = {(k[0], r["left"]): list(k[1]) for k, r in found.items()}
    above = {(r["file"], r["left"]): r["above"] for r in trees.nearest_above(numbers, ["file"], F.col("span_id") == "s", width=16).collect()}
    for f, p, *_ in rows:
        wanted = [o[1] for o in rows if o[0] == f and o[4] == "s" and len(o[1]) < len(p) and p[: len(o[1])] == o[1]]
        got = above[f, found[f, tuple(p)]["left"]]
        assert (left[f, got] if got else None) == (max(wanted, key=len) if wanted else None)
    lines = spark.createDataFrame([(f, k) for f in ("a.py", "b.py", "c.py") for k in range(-1, 64)], "file string, line int")
    for r in trees.at_lines(numbers, lines, ["file"], width=16).collect():
        on = [o[1] for o in rows if o[0] == r["file"] and o[2] <= r["line"] <= o[3]]
        assert (left[r["file"], r["left"]] if r["left"] else None) == (max(on, key=len) if on else None)
    for r in trees.next_from(numbers, lines, ["file"]).collect():
        on = [o for o in rows if o[0] == r["file"] and o[2] >= r["line"]]
        assert (left[r["file"], r["left"]] if r["left"] else None) == (min(on, key=lambda o: o[2])[1] if on else None)
    for r in trees.spans(numbers, ["file"]).collect():
        own = sorted(o[1] for o in rows if o[0] == r["file"] and o[4] == r["span_id"])
        ahead = sorted(o[1] for o in rows if o[0] == r["file"] and o[1] < own[0])
        assert left[r["file"], r["first"]] == own[0] and left[r["file"], r["last"]] == own[-1]
        assert (left[r["file"], r["preceding"]] if r["preceding"] else None) == (ahead[-1] if ahead else None)
    top = trees.span_ids_below(numbers, ["file"], F.col("depth") == 0).collect()
    assert {(r["file"], tuple(r["span_ids"])) for r in top} == {(f, tuple(sorted({o[4] for o in rows if o[0] == f and o[4]}))) for f in ("a.py", "b.py")}


def plain_walk(edges, root, hops, direction):
    """The walk by recursion."""
    lines, expanded, shown = [], set(), set()

    def visit(node, depth, etype, way):
        if depth > hops:
            return
        lines.append((depth, etype, node))
        if node in expanded:
            return
        expanded.add(node)
        nexts = []
        for to in ("downstream", "upstream"):
            if way == to or (node == root and direction == "both"):
                for s, d, kind in sorted(edges, key=lambda e: (e[1], e[2]) if to == "downstream" else (e[0], e[2])):
                    a, b = (s, d) if to == "downstream" else (d, s)
                    if a == node and (s, kind, d) not in shown:
                        shown.add((s, kind, d))
                        nexts.append((b, kind if to == "downstream" else f"{kind}-by", to))
        for b, kind, to in nexts:
            visit(b, depth + 1, kind, to)

    visit(root, 0, None, direction)
    return lines


@pytest.mark.parametrize("direction", ["downstream", "upstream", "both"])
@pytest.mark.parametrize("hops", [1, 2, 4, -1])
def test_walks_by_recursion(spark, direction, hops):
    """Graphs with cycles, diamonds, parallel edges and an edge to itself."""
    rng = random.Random(hops)
    names = [f"n{k}" for k in range(9)]
    edges = sorted({(rng.choice(names), rng.choice(names), rng.choice(["calls", "imports"])) for _ in range(22)} | {("n0", "n0", "calls"), ("n0", "n1", "calls"), ("n0", "n1", "imports")})
    frame = spark.createDataFrame(edges, "src string, dst string, etype string")
    found = graph.walked_trees(frame, spark.createDataFrame([(n,) for n in ("n0", "n1", "alone")], "node_id string"), hops, direction)
    rows = sorted(found.collect(), key=lambda r: (r["root"], r["line_no"]))
    for root in ("n0", "n1", "alone"):
        assert [(r["depth"], r["etype"], r["node"]) for r in rows if r["root"] == root] == plain_walk(edges, root, hops if hops > 0 else graph.MOST_HOPS, direction)


def test_walks_are_drawn_and_filtered(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("a", "c", "x"), ("b", "d", "y"), ("a", "test_z", "x")], "src string, dst string, etype string")
    nodes = spark.createDataFrame([(n, "file" if n != "c" else "class") for n in "abcd"] + [("test_z", "file")], "node_id string, type string")
    root = spark.createDataFrame([("a",)], "node_id string")
    lines = lambda **more: [r["line"] for r in graph.walked_trees(edges, root, 2, nodes=nodes, **more).orderBy("line_no").collect()]
    assert lines() == ["a", "├── x ── b", "│        └── y ── d", "└── x ── c"]
    assert lines(node_types=["file"]) == ["a", "└── x ── b", "         └── y ── d"] and lines(edge_types=["y"]) == ["a"]


def test_unbounded_walks_reach_the_end(spark):
    chain = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}", "e") for k in range(30)], "src string, dst string, etype string")
    assert graph.k_hop(chain, spark.createDataFrame([("n00",)], "node_id string"), -1).agg(F.max("distance")).first()[0] == 30


def test_vector_batches(spark, tmp_path):
    path, rows = f"{tmp_path}/store", lambda ids: spark.createDataFrame([(f"d{k:03d}", [float(k)], "c") for k in ids], "doc_id string, vector array<float>, category string").repartition(4)
    stores.appended(spark, path, rows(range(50)), 0)
    stores.dropped(spark, path, rows(range(40, 50)), 0)
    stores.appended(spark, path, rows(range(45, 80)), 1)
    stores.appended(spark, path, rows(range(45, 80)), 1)  # again
    held = {r["doc_id"]: r["vector_id"] for r in stores.held(spark, path).collect()}
    assert held == {f"d{k:03d}": k for k in range(40)} | {f"d{k:03d}": 50 + k - 45 for k in range(45, 80)}
    stores.compacted(spark, path, f"{tmp_path}/whole")
    assert {r["doc_id"]: r["vector_id"] for r in stores.held(spark, f"{tmp_path}/whole").collect()} == held
    plan = stores.added(stores.held(spark, path).drop("batch"), rows(range(3)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number() windowspecdefinition(doc_id" not in plan
    assert sorted(r["vector_id"] for r in stores.added(stores.held(spark, path).drop("batch"), rows(range(90, 93))).filter("doc_id >= 'd090'").collect()) == [85, 86, 87]


def test_samples_of_lengths_are_the_same_in_any_order(spark):
    rows = [(k, k * 7 % 1000) for k in range(3000)] + [(5000, None)]
    read = lambda r, parts: metrics.sampled_lengths(spark.createDataFrame(r, "k int, n int").repartition(parts), "k", F.col("n"), 600, size=500, parts=8).first()
    one, other = read(rows, 2), read(rows[::-1], 7)
    assert one == other and one["n"] == 3000 and one["truncated"] == sum(n > 600 for _, n in rows[:-1])
    assert abs(one["p50"] - 500) < 80 and abs(one["p99"] - 990) < 15


def test_lengths_of_all_rows(spark):
    """More rows than a sample holds: the percentiles are those of all."""
    rows = spark.range(25_000).select("id", (F.col("id") * 7919 % 25_000).alias("n"))
    rows.write.parquet(path := folder(spark, "lengths"))
    found = metrics.sampled_lengths(spark.read.parquet(path), "id", F.col("n"), 600, size=None).first()
    assert [found[c] for c in ("n", "p50", "p90", "p95", "p99")] == [25_000, 12_499, 22_499, 23_749, 24_749]
    rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_chars")).write.parquet(f"{path}-t/documents.parquet")
    assert catalogue.QUERIES["sampled_lengths"](spark, f"{path}-t").first()["p99"] == 24_749


def test_prompts(spark):
    files = spark.createDataFrame([("a", "1\n2\n3\n4\n5\n6"), ("b", "x\ny"), ("c", None), ("d", "1\n2")], "file string, text string")
    spans = spark.createDataFrame([("a", 2, 3, 1, 5), ("a", 3, 3, 2, 5), ("a", 6, 6, 3, 5), ("d", 7, 9, 1, 1)], "file string, start int, end int, rank int, tokens int")
    found = {r["file"]: r["text"] for r in context.prompts(files, spans).collect()}
    assert found == {"a": "a\n```\n2\n3\n... other code\n6\n\n```\n", "b": "b\n```\nx\ny\n```\n", "c": "c\n```\n\n```\n", "d": "d\n```\n\n```\n"}
    assert {r["file"]: r["text"] for r in context.prompts(files, spans, 10).collect()}["a"] == "a\n```\n2\n3\n... other code\n\n```\n"


def plan(frame):
    import contextlib
    import io

    with contextlib.redirect_stdout(text := io.StringIO()):
        frame.explain("extended")
    return text.getvalue()


def test_next_block_and_block_ahead_across_cuts(spark):
    """Windows that take a cut of lines each find blocks in others, and none looks to its end anew for every row."""
    at = [5, 70_000, 70_000, 200_000, 400_000]
    tree = spark.createDataFrame([("a", s, k * 50_000 + 1, "x" if k % 2 else "y") for k, s in enumerate(at)] + [("b", 9, 1, "x")], "file string, start long, left long, span_id string")
    lines = [("a", n) for n in (1, 5, 6, 65_536, 70_000, 70_001, 399_999, 400_000, 400_001)] + [("b", 9), ("b", 10), ("c", 1)]
    found = trees.next_from(tree, spark.createDataFrame(lines, "file string, line long"), ["file"])
    assert "unboundedfollowing" not in plan(found).lower()
    want = {(f, n): next((k * 50_000 + 1 for k, s in enumerate(at if f == "a" else [9] if f == "b" else []) if s >= n), None) for f, n in lines}
    assert {(r["file"], r["line"]): r["left"] for r in found.collect()} == want
    spans = trees.spans(tree, ["file"])
    assert sorted(map(tuple, spans.collect()), key=str) == [("a", "x", 50_001, 150_001, 1), ("a", "y", 1, 200_001, None), ("b", "x", 1, 1, None)]


def test_references_meet_one_block_of_a_scope(spark):
    """As many references as blocks of one name: each takes that of its own scope, the others the first of all."""
    n = 2000
    blocks = spark.range(n).select(F.lit("f").alias("file"), F.explode(F.array(F.array(F.concat(F.lit("c"), "id")), F.array(F.concat(F.lit("c"), "id"), F.lit("run")))).alias("path"), F.lit("k").alias("kind"))
    references = spark.range(n + 5).select(F.lit("f").alias("file"), F.array(F.concat(F.lit("c"), "id")).alias("path"), F.array(F.lit("run")).alias("target"))
    found = trees.resolved(references, blocks, ["file"])
    assert "_scope" in plan(found)
    rows = {r["path"][0]: r["found"] for r in found.collect()}
    assert len(rows) == n + 5 and all(rows[f"c{k}"] == [f"c{k}" if k < n else "c0", "run"] for k in range(n + 5))


def test_references_are_not_broadcast(spark, tmp_path):
    """A small file of references, each many rows by its targets and scopes, none of which fit the driver."""
    spark.range(3000).select("id").write.parquet(f"{tmp_path}/ids")
    own = spark.read.parquet(f"{tmp_path}/ids")
    path = F.array(F.concat(F.lit("s"), F.col("id") % 7), F.concat(F.lit("c"), "id"))
    blocks = own.select(F.lit(1).alias("file"), path.alias("path"), F.when(F.col("id") % 11 == 0, "test").otherwise("class").alias("kind"))
    references = own.select(F.lit(1).alias("file"), path.alias("path"), F.explode(F.array(F.array(F.concat(F.lit("c"), "id")), F.array(F.lit("none")))).alias("target"))
    setting = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(setting, "64k")
    try:
        found = trees.resolved(references, blocks, ["file"], ("test",)).collect()
    finally:
        spark.conf.unset(setting)
    kept = [k for k in range(3000) if k % 11]
    assert len(found) == 2 * len(kept) and all(r["found"] == (None if r["target"] == ["none"] else r["path"]) for r in found)


def test_numbers_of_a_tree_in_ranges(spark):
    """One wide tree is numbered in ranges, not in one window of it; names of any characters keep their order."""
    names = ["a", "a\x00", "a\x00b", "a\x01", "a\x01\x01", "a b", "é", "ab", "", None] + [f"n{k:04d}" for k in range(600)]
    paths = [["t"]] + [["t", n] for n in names] + [["t", n, "x"] for n in names[::2]]
    found = trees.numbered(spark.createDataFrame([("f", p, 1) for p in paths], "file string, path array<string>, w int"), ["file"], {"all": F.col("w")})
    assert "_cut" in plan(found)
    rows = {tuple(r["path"]): (r["left"], r["right"], r["below"], r["all"]) for r in found.collect()}
    order = sorted(map(tuple, paths), key=lambda p: [(n is not None, n or "") for n in p])
    below = lambda p: sum(o[: len(p)] == p for o in order) - 1
    assert rows == {p: (left := 2 * k + 2 - len(p), left + 2 * below(p) + 1, below(p), below(p) + 1) for k, p in enumerate(order)}


def test_lines_of_a_tree_meet_in_cuts(spark, monkeypatch):
    """Texts over many cuts, marks at their borders and a null tree; what is gathered for a tree are cuts, not lines."""
    monkeypatch.setattr(trees, "_CUT_LINES", 4)
    rng = random.Random(5)
    rows = [(t, [f"p{k:03d}"], k, 0, rng.random() < 0.4) for t in ("a", None) for k in rng.sample(range(200), 120)]
    tree = spark.createDataFrame(rows, "tree string, path array<string>, left long, depth int, broken boolean")
    name = F.element_at("path", -1)
    whole = {r["tree"]: r["text"] for r in trees.rendered(tree, ["tree"], name).collect()}
    marked = {r["tree"]: r["text"] for r in trees.rendered(tree, ["tree"], name, highlighted=F.col("broken"), only_highlighted=True).collect()}
    for t in ("a", None):
        own = sorted((left, path[0], broken) for tree_of, path, left, _, broken in rows if tree_of == t)
        assert whole[t] == "\n".join(p for _, p, _ in own)
        before = [True, *(b for _, _, b in own)]
        assert marked[t] == "\n".join(f"* {p}" if b else "..." for (_, p, b), ahead in zip(own, before) if b or ahead)
    plan = trees.rendered(tree, ["tree"], name)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 2 and "_cut" in plan


def test_a_walk_takes_and_returns_batches():
    """A root with many children, in several batches: no more than some thousand rows come out at once, in the order of names."""
    import pyarrow as pa

    n = 25_000
    names = [f"c{k:06d}" for k in range(n)]
    edges = pa.RecordBatch.from_pydict({"root": ["r"] * n, "a": ["r"] * n, "b": names[::-1], "etype": ["e"] * n, "way": ["downstream"] * n})
    alone = pa.RecordBatch.from_pydict({"root": ["r"], "a": pa.array([None], pa.string()), "b": pa.array([None], pa.string()), "etype": pa.array([None], pa.string()), "way": pa.array([None], pa.string())})
    found = list(graph._walk(2, "downstream")(iter([edges.slice(0, 9_000), edges.slice(9_000), alone])))
    assert max(part.num_rows for part in found) <= 10_000 and len(found) == 3
    rows = [r for part in found for r in part.to_pylist()]
    assert [r["node"] for r in rows] == ["r", *names] and [r["line_no"] for r in rows] == list(range(1, n + 2))
    assert rows[-1]["line"] == f"└── e ── {names[-1]}" and rows[1]["line"] == f"├── e ── {names[0]}"
