"""Unified diffs as relations, and the ground truth of edits derived from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def changed_files(patch: Column) -> Column:
    """Distinct source files of a diff."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^--- a/(.+)$"), F.lit(1)))


def by_file(patch: Column) -> Column:
    """The diff in pieces, one a file."""
    return F.filter(F.split(patch, r"(?m)(?=^diff --git )"), lambda p: F.startswith(p, F.lit("diff --git ")))


def change_rows(patch: str, only: str = ".py", skip_blank: bool = True) -> Iterator[tuple]:
    """(file, hunk, op, line, content): deletions by source line, additions by target line."""
    file, hunk, old, new = None, -1, 0, 0
    left_old = left_new = 0
    for line in (patch or "").split("\n"):
        if left_old <= 0 and left_new <= 0:
            if line.startswith("--- "):
                file, hunk = (line[6:] if line.startswith("--- a/") else None), -1
            elif line.startswith("+++ ") and file is None:
                file = line[6:] if line.startswith("+++ b/") else None
            elif m := _HUNK.match(line):
                hunk, old, new = hunk + 1, int(m[1]), int(m[3])
                left_old, left_new = int(m[2] or 1), int(m[4] or 1)
            continue
        mark, content = line[:1], line[1:]
        wanted = file is not None and file.endswith(only) and (content.strip() or not skip_blank)
        if mark == "-":
            if wanted:
                yield file, hunk, "delete", old, content
            old, left_old = old + 1, left_old - 1
        elif mark == "+":
            if wanted:
                yield file, hunk, "add", new, content
            new, left_new = new + 1, left_new - 1
        elif mark != "\\":
            old, new, left_old, left_new = old + 1, new + 1, left_old - 1, left_new - 1


def changes(patches: DataFrame) -> DataFrame:
    """From ``instance_id, patch``: ``instance_id, file, hunk, op, line, content``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, *row) for i, patch in zip(part["instance_id"], part["patch"]) for row in change_rows(patch)]
            yield pd.DataFrame(rows, columns=["instance_id", "file", "hunk", "op", "line", "content"])

    return patches.select("instance_id", "patch").mapInPandas(run, "instance_id string, file string, hunk int, op string, line int, content string")


def edited_entities(changed: DataFrame, outlines: DataFrame, inert: DataFrame) -> DataFrame:
    """``instance_id, file, entity, module``: definitions over changed lines that aren't imports,
    comments, docstrings or globals. outlines, inert: see ``pyast``, with path."""
    from siftmill.operators.ranges import tightest_container

    lines = changed.select("instance_id", F.col("file").alias("path"), "line").distinct()
    idle = inert.select("path", F.explode(F.sequence("start", "end")).alias("line")).distinct()
    lines = lines.join(idle, ["path", "line"], "left_anti")
    ranges = outlines.filter("kind <> 'class'").select("path", "start", "end", F.concat_ws(".", "class_name", "name").alias("range_id"))
    found = tightest_container(lines.select("instance_id", "path", "line"), ranges, ["path"]).filter("range_id IS NOT NULL")
    entity = F.concat("path", F.lit(":"), "range_id")
    return found.select("instance_id", F.col("path").alias("file"), entity.alias("entity"), F.concat("path", F.lit(":"), F.split_part("range_id", F.lit("."), F.lit(1))).alias("module")).distinct()


def import_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` (keys, line, content) with ``is_import``: an import statement's lines, those within its
    open parentheses included."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("line")
    starts = F.col("content").rlike(r"^\s*(import|from)\s")
    depth = F.length(F.regexp_replace("content", r"[^(]", "")) - F.length(F.regexp_replace("content", r"[^)]", ""))
    marked = lines.withColumns({"_starts": starts, "_depth": depth})
    marked = marked.withColumn("_open", F.coalesce(F.sum("_depth").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.last(F.when(F.col("_open") <= 0, F.col("_starts")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("is_import", F.coalesce(last, F.lit(False))).drop("_starts", "_depth", "_open")


def answer_locations(lines: DataFrame, known_files: DataFrame) -> DataFrame:
    """``answer_id, position, location`` from lines (answer_id, position, content) of a model's answer:
    entries such as ``function:`` belong to the file named last before them."""
    from pyspark.sql import Window

    order = Window.partitionBy("answer_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    line = F.trim(F.regexp_replace("content", r"^[`\s]+|[`\s:]+$", ""))
    named = lines.withColumn("_line", line).withColumn("_names_file", F.col("_line").endswith(".py") & ~F.col("_line").rlike(r"^(function|class|method|variables?|lines?):"))
    known = known_files.select(F.col("file").alias("_line"), F.lit(True).alias("_known"))
    named = named.join(known, "_line", "left")
    file = F.when(F.col("_names_file"), F.struct(F.when(F.col("_known"), F.col("_line")).alias("f")))
    carried = named.withColumn("_file", F.last(file, ignorenulls=True).over(order)["f"])
    entry = carried.filter(F.col("_line").rlike(r"^(function|class|method|variables?|lines?):"))
    found = entry.select("answer_id", "position", F.concat(F.coalesce("_file", F.lit("None")), F.lit(":"), F.col("_line")).alias("location"))
    return found.groupBy("answer_id", "location").agg(F.min("position").alias("position")).select("answer_id", "position", "location")


_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def hunks(piece: Column) -> Column:
    """The hunks of one file's diff: ``at`` (first old line, from 1), ``old`` and ``new`` lines."""
    parts = F.filter(F.split(piece, r"(?m)(?=^@@ -\d)"), lambda p: F.startswith(p, F.lit("@@ -")))

    def hunk(p: Column) -> Column:
        body = F.filter(F.slice(F.split(F.regexp_replace(p, r"\n+\z", ""), "\n"), 2, 1 << 30), lambda x: ~F.startswith(x, F.lit("\\")))
        side = lambda mark: F.transform(F.filter(body, lambda x: (x == "") | F.substring(x, 1, 1).isin(" ", mark)), lambda x: F.substring(x, 2, 1 << 30))
        return F.struct(F.regexp_extract(p, _HEADER, 1).cast("int").alias("at"), side("-").alias("old"), side("+").alias("new"))

    return F.transform(parts, hunk)


def _placed(lines: Column, found: Column) -> Column:
    """Hunks put in one after the other: each where its old lines stand in ``lines`` nearest to its own line
    shifted like the hunk before, later places first, behind what is done."""
    start = F.struct(F.lit(0).alias("shift"), F.lit(0).alias("done"), F.lit(True).alias("ok"), F.array().cast("array<int>").alias("offsets"), F.array().cast("array<string>").alias("out"))

    def put(acc: Column, h: Column) -> Column:
        w = F.size(h["old"])
        # A hunk without old lines goes behind its line.
        stated = F.when(w == 0, h["at"]).otherwise(h["at"] - 1)
        guess = F.least(F.greatest(stated + acc["shift"], acc["done"]), F.size(lines))
        last = F.size(lines) - w
        places = F.when(acc["ok"] & (last >= acc["done"]), F.sequence(acc["done"], last)).otherwise(F.array().cast("array<int>"))
        fits = F.filter(places, lambda i: (F.get(lines, i) == F.get(h["old"], F.lit(0))) & (F.slice(lines, i + 1, w) == h["old"]))
        nearest = F.array_min(F.transform(fits, lambda i: F.struct(F.abs(i - stated - acc["shift"]).alias("far"), (i < stated + acc["shift"]).alias("before"), i.alias("i"))))["i"]
        at = F.when(w == 0, F.when(acc["ok"], guess)).otherwise(nearest)
        done = F.struct((at - stated).alias("shift"), (at + w).alias("done"), F.lit(True).alias("ok"), F.array_append(acc["offsets"], at - stated).alias("offsets"), F.concat(acc["out"], F.slice(lines, acc["done"] + 1, at - acc["done"]), h["new"]).alias("out"))
        failed = F.struct(acc["shift"], acc["done"], F.lit(False).alias("ok"), acc["offsets"], acc["out"])
        return F.when(at.isNull(), failed).otherwise(done)

    return F.aggregate(found, start, put)


def applied(patches: DataFrame, files: DataFrame) -> DataFrame:
    """``instance_id, file, ok, offsets, text`` of each file that a patch (instance_id, patch) names: ``files``
    (instance_id, file, text) with its hunks put in, and how many lines from where it says each hunk was.
    If one hunk does not fit, ``ok`` is false and the others null. Context has to match whole.

    A file is one row with its lines as an array: hunks depend on one another, but files don't, so all
    of it is array functions, and texts are shuffled once, to meet their diffs."""
    from siftmill.functions.text import let

    pieces = patches.select("instance_id", F.explode(by_file(F.col("patch"))).alias("_piece"))
    name = lambda mark, side: F.regexp_extract("_piece", rf"(?m)^{mark} {side}/(.+)$", 1)
    old = name("---", "a")
    pieces = pieces.select("instance_id", F.when(old != "", old).otherwise(name(r"\+\+\+", "b")).alias("file"), (old == "").alias("_new"), "_piece")
    both = pieces.join(files.select("instance_id", "file", "text"), ["instance_id", "file"], "left")
    text = F.when(F.col("_new"), F.coalesce("text", F.lit(""))).otherwise(F.col("text"))
    # A last line feed ends the last line and begins none.
    ended = F.endswith(text, F.lit("\n"))
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.when(ended, F.regexp_replace(text, r"\n\z", "")).otherwise(text), "\n"))
    put = let(F.struct(lines.alias("l"), hunks(F.col("_piece")).alias("h")), lambda x: let(_placed(x["l"], x["h"]), lambda r: F.struct(r["ok"].alias("ok"), r["offsets"].alias("offsets"), F.concat(r["out"], F.slice(x["l"], r["done"] + 1, F.size(x["l"]))).alias("lines"))))
    found = both.withColumns({"_put": put, "_ended": ended | (text == "")})
    ok = F.coalesce(F.col("_put.ok") & text.isNotNull(), F.lit(False))
    whole = F.concat(F.array_join("_put.lines", "\n"), F.when(F.col("_ended") & (F.size("_put.lines") > 0), "\n").otherwise(""))
    return found.select("instance_id", "file", ok.alias("ok"), F.when(ok, F.col("_put.offsets")).alias("offsets"), F.when(ok, whole).alias("text"))
