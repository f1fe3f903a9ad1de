"""Sources, sinks and smaller operators."""

import json

from pyspark.sql import functions as F

from siftmill.functions import text as tx
from siftmill.operators import context, graph, mapping, metrics, pyast, search
from siftmill.sources import readers, writers


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_json_lines_and_ground_truth(spark, tmp_path):
    row = {"instance_id": "a-1", "file_changes": [{"file": "x.py", "changes": {"edited_modules": ["x.py:C"], "edited_entities": ["x.py:C.m", "x.py:C.n"]}}]}
    (tmp_path / "t.jsonl").write_text(json.dumps(row) + "\n" + json.dumps({"instance_id": "b-2"}) + "\n")
    truth = readers.json_lines(spark, str(tmp_path / "t.jsonl"), readers.TRUTH)
    assert rows(readers.ground_truth(truth, "file"), "query_id", "item") == [("a-1", "x.py")]
    assert rows(readers.ground_truth(truth, "function"), "item") == [("x.py:C.m",), ("x.py:C.n",)]
    assert readers.instance(truth, "b-2").count() == 1
    assert readers.json_lines(spark, str(tmp_path / "t.jsonl"), readers.TRUTH, first=1).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, x string")
    for _ in range(2):
        writers.append_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    writers.replace_json(df, str(tmp_path / "j"))
    writers.csv(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1


def test_run_statistics_and_edited_files(spark):
    results = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", None)], "instance_id string, found_files array<string>")
    assert rows(metrics.run_statistics(results), "n", "found", "failed", "mean_files") == [(3, 1, 2, 2 / 3)]
    patches = spark.createDataFrame([("a", "r", "--- a/x.py\n+++ b/x.py\n--- a/y.py\n"), ("b", "r", "--- a/x.py\n")], "instance_id string, repo string, patch string")
    assert rows(metrics.edited_file_counts(patches), "n_files", "n") == [(1, 1), (2, 1)]


def test_tokens_fit_an_encoder(spark):
    df = spark.createDataFrame([([1, 2, 3], [7, 8, 9])], "f array<int>, c array<int>")
    assert df.select(metrics.fitted_tokens(F.col("f"), F.col("c"), 5)).first()[0] == [1, 2, 3, 7, 8]
    assert df.select(metrics.fitted_tokens(F.col("f"), F.col("c"), 2)).first()[0] == [1, 2]


def test_hits_become_spans(spark):
    hits = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5)], "query_id int, item int, score double")
    blocks = spark.createDataFrame([(10, "a.py", 1, 5, ["A.m"]), (11, "a.py", 8, 9, [])], "item int, file string, start int, end int, span_ids array<string>")
    spans = spark.createDataFrame([("a.py", "A.m", 1, 5, 30), ("a.py", "f", 7, 12, 20)], "file string, span_id string, start int, end int, tokens int")
    assert rows(search.spans_of_hits(hits, blocks, spans), "span_id", "score", "tokens_so_far") == [("A.m", 0.9, 30), ("f", 0.5, 50)]


def test_spans_map_to_nodes(spark):
    blocks = spark.createDataFrame([(1, 1, "a.py", ["C", "C.m", "imports"]), (1, 2, "a.py", ["f"])], "query_id int, rank int, file string, span_ids array<string>")
    nodes = spark.createDataFrame([("a.py:C", "class"), ("a.py:C.m", "function"), ("a.py:f", "function")], "node_id string, type string")
    entities, modules = mapping.by_spans(blocks, nodes)
    assert rows(entities, "rank", "item") == [(1, "a.py:C.m"), (2, "a.py:f")]
    assert rows(modules, "rank", "item") == [(1, "a.py:C"), (2, "a.py:f")]


def test_related_spans(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    spans = spark.createDataFrame([("a", "A"), ("b", "B")], "span_id string, owner string")
    initial = spark.createDataFrame([("A", "A.init")], "owner string, span_id string")
    assert rows(context.related_spans(edges, spans, initial), "span_id", "related") == [("a", "A.init"), ("a", "b"), ("b", "a")]


def test_walks_as_json(spark):
    paths = spark.createDataFrame([(["a"], 0), (["a", "b"], 1)], "path array<string>, depth int")
    assert [json.loads(r[0]) for r in rows(graph.as_json(paths), "json")] == [{"node": "a", "depth": 0}, {"node": "b", "parent": "a", "depth": 1}]


def test_results_by_query(spark):
    df = spark.createDataFrame([("n1", "fold", ["q2"], 2), ("n2", "preview", ["q1"], 1), ("n3", "fold", ["q1"], 1)], "node_id string, format string, queries array<string>, position int")
    found = search.grouped_results(df).collect()
    assert [r["queries"] for r in found] == [["q1"], ["q2"]] and [x["node_id"] for x in found[0]["results"]] == ["n3", "n2"]


def test_labels_and_terms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.issue_category(F.lit("It is a bug report."))) == "Bug Report" and one(tx.issue_category(F.lit("?"))) == "Uncategorized"
    assert one(tx.search_name(F.lit("def run"))) == "run" and one(tx.search_name(F.lit("Classic"))) == "Classic"
    assert one(tx.enriched_query(F.lit("q"), F.array(F.lit("A")), F.array().cast("array<string>"), F.lit("*.py"))) == "q, class A file:*.py"


def test_functions_within_functions_and_large_compound_statements():
    code = "def f():\n    class K:\n        def m(self):\n            pass\n    if f:\n        def g():\n            pass\n    def h():\n        pass\n\n\nif True:\n    def k():\n        pass\nelse:\n    def e():\n        pass\n"
    assert [r[1] for r in pyast.function_rows("a.py", code)] == ["a.py::f", "a.py::h", "a.py::k"]
    large = "try:\n" + "".join(f"    x{k} = {k}\n" for k in range(40)) + "except E:\n    y = 1\nz = 2\n"
    found = list(pyast.syntax_chunk_rows("a.py", large, least=1, size=30, most=60, hard=60))
    covered = {k for r in found for k in range(r[2], r[3] + 1)}
    assert {1, 2, 41, 43, 44} <= covered and all(r[4] <= 60 for r in found)


def plain_patch(text, diff):
    """Hunks one after another, by trying all places from the nearest on."""
    import re

    ended, lines = text.endswith("\n"), text.split("\n")
    lines = lines[:-1] if ended or text == "" else lines
    ended = ended or text == ""
    out, done, shift, offsets = [], 0, 0, []
    for part in re.split(r"(?m)(?=^@@ -\d)", diff)[1:]:
        at = int(re.match(r"@@ -(\d+)", part)[1])
        body = [x for x in part.rstrip("\n").split("\n")[1:] if not x.startswith("\\")]
        old, new = [x[1:] for x in body if x[:1] in ("", " ", "-")], [x[1:] for x in body if x[:1] in ("", " ", "+")]
        stated = at - (1 if old else 0)
        if old:
            fits = [i for i in range(done, len(lines) - len(old) + 1) if lines[i : i + len(old)] == old]
            if not fits:
                return False, None, None
            i = min(fits, key=lambda i: (abs(i - stated - shift), i < stated + shift))
        else:
            i = min(max(stated + shift, done), len(lines))
        out += lines[done:i] + new
        shift, done = i - stated, i + len(old)
        offsets.append(shift)
    out += lines[done:]
    return True, offsets, "\n".join(out) + ("\n" if ended and out else "")


def test_patches_by_trying_all_places(spark):
    import difflib
    import random

    from siftmill.operators import patches

    rng = random.Random(3)
    files, diffs = [], []
    for k in range(60):
        old = [rng.choice(["a", "b", "c", "", "d e", "@@ -1 +1 @@"]) + rng.choice(["", "1", "2"]) for _ in range(rng.randint(0, 60))]
        new = [x for x in old if rng.random() > 0.06]
        for _ in range(rng.randint(0, 4)):
            new.insert(rng.randint(0, len(new)), f"new{rng.randint(0, 9)}")
        diff = "".join(x + "\n" for x in difflib.unified_diff(old, new, "a/x.py", "b/x.py", n=rng.choice([0, 1, 3]), lineterm=""))
        moved = ["moved"] * rng.randint(0, 3) + old
        files.append((str(k), "x.py", "\n".join(moved) + rng.choice(["", "\n"]) if moved else ""))
        diffs.append((str(k), f"diff --git a/x.py b/x.py\n{diff}"))
    files.append(("two", "x.py", "one\ntwo\n"))
    diffs.append(("two", "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -2 +2 @@\n-two\n+2\n\\ No newline at end of file\ndiff --git a/n.py b/n.py\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+x\n+y\ndiff --git a/gone.py b/gone.py\n--- a/gone.py\n+++ b/gone.py\n@@ -1 +1 @@\n-x\n+y\n"))
    made = patches.applied(spark.createDataFrame(diffs, "instance_id string, patch string"), spark.createDataFrame(files, "instance_id string, file string, text string"))
    found = {(r["instance_id"], r["file"]): (r["ok"], r["offsets"], r["text"]) for r in made.collect()}
    for (key, _, text), (_, diff) in zip(files[:-1], diffs[:-1]):
        if "@@" in diff.split("b/x.py", 2)[-1]:
            assert found[key, "x.py"] == plain_patch(text, diff.split("\n", 3)[3]), (key, diff)
    assert found["two", "x.py"] == (True, [0], "one\n2\n") and found["two", "n.py"] == (True, [0], "x\ny\n") and found["two", "gone.py"] == (False, None, None)


def test_files_that_cannot_be_read_are_reported(spark, tmp_path):
    import os

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.py").write_text("x = 1")
    (tmp_path / "r" / "b.py").mkdir()  # a folder by that name is no file
    os.mkfifo(tmp_path / "r" / "fifo.txt")
    os.makedirs(tmp_path / "r" / "deep")
    (tmp_path / "r" / "deep" / "gone.py").write_text("y = 2")
    from siftmill.sources.readers import _Folder, _RepoReader

    reader = _RepoReader({"path": str(tmp_path)})
    part = reader.partitions()[0]
    (tmp_path / "r" / "deep" / "gone.py").unlink()
    found = {row[1]: row for row in reader.read(_Folder(part.root, part.paths))}
    assert found["a.py"] == ("r", "a.py", "x = 1", 5, None)
    assert found["deep/gone.py"] == ("r", "deep/gone.py", None, None, "FileNotFoundError: No such file or directory")
    assert "b.py" not in found and "fifo.txt" not in found


def test_references_in_scopes(spark):
    """Equal names at three depths, references from within and without, kinds left out."""
    from siftmill.operators import trees

    blocks = [("f", ["m"], "module"), ("f", ["m", "run"], "function"), ("f", ["m", "C"], "class"), ("f", ["m", "C", "run"], "function"), ("f", ["m", "C", "D"], "class"), ("f", ["m", "C", "D", "run"], "function"), ("f", ["m", "test_C"], "test"), ("f", ["m", "test_C", "run"], "function"), ("g", ["m", "other"], "function")]
    asked = [("f", ["m", "C", "D", "x"], ["run"]), ("f", ["m", "C", "y"], ["run"]), ("f", ["m", "z"], ["run"]), ("f", ["m", "z"], ["D", "run"]), ("f", ["m", "z"], ["other"]), ("f", ["m", "test_C", "t"], ["run"]), ("g", ["m", "z"], ["other"])]
    found = trees.resolved(spark.createDataFrame(asked, "file string, path array<string>, target array<string>"), spark.createDataFrame(blocks, "file string, path array<string>, kind string"), ["file"], ("test",))
    got = {(r["file"], ".".join(r["path"]), ".".join(r["target"])): r["found"] and ".".join(r["found"]) for r in found.collect()}
    assert got == {("f", "m.C.D.x", "run"): "m.C.D.run", ("f", "m.C.y", "run"): "m.C.run", ("f", "m.z", "run"): "m.run", ("f", "m.z", "D.run"): "m.C.D.run", ("f", "m.z", "other"): None, ("g", "m.z", "other"): "m.other"}
