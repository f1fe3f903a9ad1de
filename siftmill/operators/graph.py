"""Dependency graphs as two DataFrames: ``nodes`` (node_id, type, code, start, end) and ``edges``
(src, dst, etype), and traversals as joins on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions.text import is_test_file
from siftmill.operators.scratch import kept

MOST_HOPS = 20
#: Rounds between which a frontier's lineage is cut.
CUT_EVERY = 4


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as steps ``a, b, etype`` along (downstream), against (upstream), or both."""
    down = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "etype")
    up = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "etype")
    if direction in ("downstream", "forward"):
        return down
    if direction in ("upstream", "backward"):
        return up
    if direction == "both":
        return down.unionByName(up)
    raise ValueError(direction)


def neighbors(nodes: DataFrame, edges: DataFrame, start: DataFrame, direction: str = "forward", node_types: list[str] | None = None, edge_types: list[str] | None = None, skip_tests: bool = True) -> DataFrame:
    """``node_id, neighbor, etype`` of one step; parallel edges stay. Filters hold for the neighbor."""
    steps = directed(edges, direction)
    if edge_types:
        steps = steps.filter(F.col("etype").isin(edge_types))
    kept = nodes.select(F.col("node_id").alias("b"), "type")
    if node_types:
        kept = kept.filter(F.col("type").isin(node_types))
    if skip_tests:
        kept = kept.filter(~is_test_file(F.col("b")))
    return start.select(F.col("node_id").alias("a")).join(steps, "a").join(kept, "b").select(F.col("a").alias("node_id"), F.col("b").alias("neighbor"), "etype")


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ``ids``."""
    return edges.join(ids.select(F.col("node_id").alias("src")), "src", "left_semi").join(ids.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(edges.columns)


def k_hop(edges: DataFrame, roots: DataFrame, hops: int, direction: str = "downstream", edge_types: list[str] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """``root, node_id, distance`` of all nodes within ``hops`` steps (negative: until nothing new is
    reached), breadth first, so that distances are shortest. ``allowed``: nodes that a walk may enter."""
    steps = directed(edges, direction)
    if edge_types:
        steps = steps.filter(F.col("etype").isin(edge_types))
    steps = steps.select("a", "b").distinct()
    if allowed is not None:
        steps = steps.join(allowed.select(F.col("node_id").alias("b")), "b", "left_semi")
    seen = roots.select(F.col("node_id").alias("root"), "node_id", F.lit(0).alias("distance")).distinct()
    frontier = seen
    for hop in count(1) if hops < 0 else range(1, hops + 1):
        reached = frontier.select("root", F.col("node_id").alias("a")).join(steps, "a").select("root", F.col("b").alias("node_id")).distinct()
        frontier = reached.join(seen.select("root", "node_id"), ["root", "node_id"], "left_anti").withColumn("distance", F.lit(hop))
        if hop % CUT_EVERY == 0:
            frontier = kept(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
        if hop % CUT_EVERY == 0:
            seen = kept(seen)
    return seen


def tree_paths(edges: DataFrame, roots: DataFrame, hops: int, direction: str = "downstream") -> DataFrame:
    """``path`` (array of nodes from a root) and ``depth`` of all simple paths of up to ``hops`` steps."""
    steps = directed(edges, direction).select("a", "b").distinct()
    level = roots.select(F.array("node_id").alias("path"), F.lit(0).alias("depth"))
    out = level
    for depth in range(1, hops + 1):
        grown = level.withColumn("a", F.element_at("path", -1)).join(steps, "a").filter(~F.array_contains("path", F.col("b")))
        level = grown.select(F.array_append("path", F.col("b")).alias("path"), F.lit(depth).alias("depth"))
        out = out.unionByName(level)
    return out


def walked_trees(edges: DataFrame, roots: DataFrame, hops: int = 2, direction: str = "downstream", nodes: DataFrame | None = None, node_types: list[str] | None = None, edge_types: list[str] | None = None) -> DataFrame:
    """``root, line_no, depth, etype, node, line``: a depth-first walk from each root of up to ``hops`` steps (-1:
    ``MOST_HOPS``). A node is expanded where it is met first and only named after that, and an edge is
    shown once; edges against their direction are called ``-by``. Of ``both`` directions, a walk keeps the one
    in which it left the root. Tests are not entered; neighbours come by direction, name and type.

    Depth-first order depends on all that was visited before, so a root's walk is one task over the edges within
    its hops, which a join has found; roots are apart."""
    hops = MOST_HOPS if hops < 0 else hops
    own = edges.filter(F.col("etype").isin(edge_types)) if edge_types else edges
    ends = [F.col("node_id")]
    if nodes is not None:
        may = nodes.filter(F.col("type").isin(node_types)) if node_types else nodes
        may = may.filter(~is_test_file(F.col("node_id"))).select(*ends)
    found = None
    for way in ("downstream", "upstream") if direction == "both" else (direction,):
        steps = directed(own, way).filter(~is_test_file(F.col("b")))
        if nodes is not None:
            steps = steps.join(may.withColumnRenamed("node_id", "b"), "b", "left_semi")
        # One hop less than is shown: the last nodes are named but not expanded.
        met = k_hop(steps.select(F.col("a").alias("src"), F.col("b").alias("dst"), "etype"), roots, max(hops - 1, 0)).select("root", F.col("node_id").alias("a"))
        part = met.join(steps.distinct(), "a").select("root", "a", "b", "etype", F.lit(way).alias("way"))
        found = part if found is None else found.unionByName(part)
    alone = roots.select(F.col("node_id").alias("root"), *[F.lit(None).cast("string").alias(c) for c in ("a", "b", "etype", "way")]).distinct()
    return found.unionByName(alone).groupBy("root").applyInArrow(_walk(hops, direction), "root string, line_no int, depth int, etype string, node string, line string")


#: Rows that a walk returns at once.
_ROWS = 10_000
_WALKED = pa.schema([("root", pa.string()), ("line_no", pa.int32()), ("depth", pa.int32()), ("etype", pa.string()), ("node", pa.string()), ("line", pa.string())])


def _walk(hops: int, direction: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Edges are numbers of names in order; of the strings, each name is held once, and lines only until they are returned.
        root, ends, kinds, up = None, ([], []), [], []
        for part in parts:
            root = part.column("root")[0].as_py()
            part = part.filter(pc.is_valid(part.column("a")))
            for held, c in zip(ends, "ab"):
                held.append(part.column(c))
            kinds.append(part.column("etype").dictionary_encode())
            up.append(pc.equal(part.column("way"), "upstream").to_numpy(zero_copy_only=False))
        names = pc.unique(pa.chunked_array([*ends[0], *ends[1], pa.array([root], pa.string())]))
        names = names.take(pc.sort_indices(names))
        a, b = (np.concatenate([pc.index_in(x, value_set=names).to_numpy() for x in held]).astype(np.int32) for held in ends)
        ends = part = None
        labels = sorted({k for x in kinds for k in x.dictionary.to_pylist() if k is not None})
        own = lambda x: pc.fill_null(pc.index_in(x.dictionary_decode(), value_set=pa.array(labels, pa.string())), len(labels))
        kind = np.concatenate([own(x).to_numpy() for x in kinds]).astype(np.int32)
        labels.append(None)
        up = np.concatenate(up)
        order = np.lexsort((kind, b, a, up))
        a, b, kind, up = a[order], b[order], kind[order], up[order]
        n_down, n = int((~up).sum()), len(names)
        first = {"downstream": np.searchsorted(a[:n_down], np.arange(n + 1)), "upstream": n_down + np.searchsorted(a[n_down:], np.arange(n + 1))}
        # An edge has one number, from whichever end it is met.
        edge = np.arange(len(a))
        if 0 < n_down < len(a):
            src, dst = np.where(up, b, a).astype(np.int64), np.where(up, a, b)
            edge = np.unique((src * n + dst) * len(labels) + kind, return_inverse=True)[1]
        expanded, shown, rows, count = np.zeros(n, bool), np.zeros(len(a), bool), [], 0

        def nexts(node: int, way: str) -> np.ndarray:
            found = []
            for to in ("downstream", "upstream") if way == "both" else (way,):
                at = np.arange(first[to][node], first[to][node + 1])
                at = at[~shown[edge[at]]]
                shown[edge[at]] = True
                found.append(at)
            return np.concatenate(found)

        # What is to be visited: edges of one parent, how many of them are done, their depth and indent.
        left = [(None, 0, 0, "")]
        while left:
            at, k, depth, indent = left.pop()
            if at is None:
                node, etype, way, line = pc.index_in(pa.array([root], pa.string()), value_set=names)[0].as_py(), None, direction, root
            else:
                if k + 1 < len(at):
                    left.append((at, k + 1, depth, indent))
                e = int(at[k])
                node, way = int(b[e]), "upstream" if up[e] else "downstream"
                etype = f"{labels[kind[e]]}-by" if up[e] else labels[kind[e]]
                last = k + 1 == len(at)
                joint = f"{'└── ' if last else '├── '}{etype} ── "
                line, indent = f"{indent}{joint}{names[node].as_py()}", indent + (" " if last else "│") + " " * (len(joint) - 1)
            count += 1
            rows.append((root, count, depth, etype, root if at is None else names[node].as_py(), line))
            if len(rows) == _ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _WALKED)], schema=_WALKED)
                rows = []
            if expanded[node]:
                continue
            expanded[node] = True
            below = nexts(node, way)
            if depth < hops and len(below):
                left.append((below, 0, depth + 1, indent))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _WALKED)], schema=_WALKED)

    return walk


def tree_text(paths: DataFrame) -> DataFrame:
    """Lines of an indented tree in depth-first order, one row per path."""
    return paths.select(F.array_join("path", " > ").alias("key"), F.concat(F.repeat(F.lit("  "), F.col("depth")), F.element_at("path", -1)).alias("line"))


def mean_shortest_distance(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The mean over reachable targets of the distance from the nearest source; null without one. All
    sources walk as one, until nothing new is reached."""
    steps = directed(edges, "downstream").select("a", "b").distinct()
    frontier = seen = sources.select("node_id").distinct().withColumn("distance", F.lit(0))
    hop = 0
    while not frontier.isEmpty():
        hop += 1
        reached = frontier.select(F.col("node_id").alias("a")).join(steps, "a").select(F.col("b").alias("node_id")).distinct()
        frontier = kept(reached.join(seen.select("node_id"), "node_id", "left_anti").withColumn("distance", F.lit(hop)))
        seen = seen.unionByName(frontier)
        if hop % CUT_EVERY == 0:
            seen = kept(seen)
    return targets.select("node_id").distinct().join(seen, "node_id").agg(F.avg("distance").alias("mean_distance"))


def without_empty_folders(nodes: DataFrame) -> DataFrame:
    """Nodes but for folders that hold no file at any depth. Paths are parted by ``/``."""
    files = nodes.filter("type = 'file'").select(F.split("node_id", "/").alias("p"))
    holding = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda n: F.array_join(F.slice("p", 1, n), "/"))).alias("node_id")).distinct()
    return nodes.filter("type <> 'directory' OR node_id = '/'").unionByName(nodes.filter("type = 'directory' AND node_id <> '/'").join(holding, "node_id", "left_semi").select(nodes.columns))


def contains_edges(nodes: DataFrame) -> DataFrame:
    """Containment by ids: folder to file, file to entity, entity to inner entity."""
    name = F.when(F.contains("node_id", F.lit(":")), F.split_part("node_id", F.lit(":"), F.lit(-1)))
    file = F.split_part("node_id", F.lit(":"), F.lit(1))
    outer = F.regexp_replace(name, r"\.[^.]*$", "")
    folder = F.when(F.contains("node_id", F.lit("/")), F.regexp_replace("node_id", "/[^/]*$", "")).otherwise("/")
    parent = F.when(name.isNull(), folder).when(outer == name, file).otherwise(F.concat(file, F.lit(":"), outer))
    found = nodes.filter("node_id <> '/'").select(parent.alias("src"), F.col("node_id").alias("dst"), F.lit("contains").alias("etype"))
    return found.join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi").select("src", "dst", "etype")


def name_index(nodes: DataFrame) -> DataFrame:
    """``name, lower_name, node_id``: the last part of an entity's name; files by their base name with
    and without ending. Test files are left out."""
    base = F.element_at(F.split(F.split_part("node_id", F.lit(":"), F.lit(1)), "/"), -1)
    entity = F.element_at(F.split(F.split_part("node_id", F.lit(":"), F.lit(-1)), r"\."), -1)
    names = F.when(F.col("type") == "file", F.array(base, F.regexp_replace(base, r"\.py$", ""))).otherwise(F.array(entity))
    return nodes.filter(~is_test_file(F.col("node_id")) & (F.col("type") != "directory")).select(F.explode(names).alias("name"), "node_id").distinct().withColumn("lower_name", F.lower("name"))


def module_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (src, module, entity, alias, level) with ``target``: the imported submodule's file, else
    the node of the entity in the module's file, else that file. ``files``: node_id of files and
    entities. A relative import drops ``level`` last parts of the importing file's path."""
    parts = F.split(F.split_part("src", F.lit(":"), F.lit(1)), "/")
    base = F.when(F.col("level") > 0, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - F.col("level"), F.lit(0))), "/")).otherwise("")
    dotted = F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(F.replace("module", F.lit("."), F.lit("/")), F.lit("")))
    rows = imports.distinct().withColumn("_at", dotted)
    inner = F.concat_ws("/", F.nullif(F.col("_at"), F.lit("")), F.col("entity"))
    options = F.array(
        F.when(F.col("entity").isNotNull() & (F.col("entity") != "*"), F.concat(inner, F.lit(".py"))),
        F.when(F.col("entity").isNotNull() & (F.col("entity") != "*"), F.concat(inner, F.lit("/__init__.py"))),
        F.when(F.col("entity").isNotNull() & (F.col("entity") != "*"), F.concat("_at", F.lit(".py:"), "entity")),
        F.when(F.col("entity").isNotNull() & (F.col("entity") != "*"), F.concat("_at", F.lit("/__init__.py:"), "entity")),
        F.concat("_at", F.lit(".py")),
        F.concat("_at", F.lit("/__init__.py")),
    )
    tried = rows.select(*imports.columns, F.posexplode(options).alias("choice", "target")).join(files.select(F.col("node_id").alias("target")), "target", "left_semi")
    return tried.groupBy(*imports.columns).agg(F.min_by("target", "choice").alias("target"))


def call_edges(calls: DataFrame, candidates: DataFrame, index: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Edges from ``calls`` (src, name, etype) to ``candidates`` (see ``scope_candidates``) of that name:
    to all of them, or if ``strict`` to the nearest alone. With ``index`` (see ``name_index``), names
    without a candidate go to every node of it."""
    asked = calls.distinct()
    local = asked.join(candidates, ["src", "name"])
    if strict:
        local = local.groupBy("src", "name", "etype").agg(F.min_by("node_id", F.struct("near", "node_id")).alias("node_id"))
    out = local.select("src", F.col("node_id").alias("dst"), "etype")
    if index is not None:
        left = asked.join(local.select("src", "name").distinct(), ["src", "name"], "left_anti")
        out = out.unionByName(left.join(index.select("name", "node_id"), "name").select("src", F.col("node_id").alias("dst"), "etype"))
    return out.distinct()


def _last_name(node_id: str) -> Column:
    return F.element_at(F.split(F.element_at(F.split(node_id, ":"), -1), r"\."), -1)


def scope_candidates(contains: DataFrame, nodes: DataFrame, imports: DataFrame, deepest: int = -1) -> DataFrame:
    """``src, node_id, name, near``: what a class or function can name, and how far off that is. First
    aliases of imports; the members of it and of every scope around it up to its file; then what
    ``__init__`` files define and import that the file imports, or that those do in turn; then what the
    file imports itself. Members of imported files come along, and of all classes at any depth."""
    kind = lambda *kinds: nodes.filter(F.col("type").isin(*kinds))
    # What several steps read is kept, or each would parse the files again.
    nodes, contains, imports = kept(nodes.select("node_id", "type")), kept(contains), kept(imports)
    of_classes = contains.join(kind("class").select(F.col("node_id").alias("src")), "src", "left_semi")
    inner = kept(k_hop(of_classes, kind("class").select("node_id"), deepest).filter("distance > 0").select(F.col("root").alias("a"), F.col("node_id").alias("b")))

    def with_inner(found: DataFrame) -> DataFrame:
        more = found.withColumnRenamed("node_id", "a").join(inner, "a").drop("a").withColumnRenamed("b", "node_id")
        return found.unionByName(more.select(found.columns))

    members = contains.select(F.col("src").alias("scope"), F.col("dst").alias("node_id"))
    up = k_hop(contains, kind("class", "function").select("node_id"), deepest, "upstream")
    up = kept(up.join(kind("class", "function", "file").select("node_id"), "node_id", "left_semi").select(F.col("root").alias("src"), F.col("node_id").alias("scope"), F.col("distance").alias("near")))
    around = up.join(members, "scope").select("src", "node_id", "near").join(up.select("src", F.col("scope").alias("node_id")), ["src", "node_id"], "left_anti")
    near = with_inner(around)

    own = imports.select(F.split_part("src", F.lit(":"), F.lit(1)).alias("file"), "target", "alias").distinct()
    to_init = own.filter(F.endswith("target", F.lit("__init__.py"))).select(F.col("file").alias("src"), F.col("target").alias("dst"), F.lit("imports").alias("etype"))
    inits = k_hop(to_init, own.select(F.col("file").alias("node_id")), -1).filter("distance > 0 AND root <> node_id").select(F.col("root").alias("file"), F.col("node_id").alias("via"))
    inits = kept(inits)
    of_inits = inits.join(members.withColumnRenamed("scope", "via"), "via").select("file", "node_id", F.lit(1000).alias("near"))
    through = inits.join(own.withColumnRenamed("file", "via"), "via").select("file", "target", "alias", F.lit(1001).alias("near")).unionByName(own.withColumn("near", F.lit(1002)))
    files = kind("file").select(F.col("node_id").alias("scope"))
    brought = through.join(files, F.col("target") == F.col("scope")).join(members, "scope").select("file", "node_id", "near")
    direct = through.join(kind("class", "function").select(F.col("node_id").alias("target")), "target", "left_semi").select("file", F.col("target").alias("node_id"), "near")
    far = with_inner(of_inits.unionByName(brought).unionByName(direct)).withColumn("name", _last_name("node_id"))
    renamed = through.filter("alias IS NOT NULL").select("file", F.col("target").alias("node_id"), F.lit(-1).alias("near"), F.col("alias").alias("name"))
    users = kind("class", "function").select(F.col("node_id").alias("src"), F.split_part("node_id", F.lit(":"), F.lit(1)).alias("file"))
    imported = users.join(far.unionByName(renamed.select(far.columns)), "file").select("src", "node_id", "name", "near")
    found = near.withColumn("name", _last_name("node_id")).select("src", "node_id", "name", "near").unionByName(imported)
    return kept(found.filter("src <> node_id").groupBy("src", "node_id", "name").agg(F.min("near").alias("near")))


def by_type_with_members(nodes: DataFrame, contains: DataFrame, kind: str) -> DataFrame:
    """Nodes of a type, tests left out; classes with the sorted ids of their members."""
    own = nodes.filter((F.col("type") == kind) & ~is_test_file(F.col("node_id")))
    members = contains.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list("dst")).alias("members"))
    return own.join(members, "node_id", "left").withColumn("members", F.coalesce("members", F.array().cast("array<string>")))


def explore(nodes: DataFrame, edges: DataFrame, start: list[str], direction: str = "downstream", depth: int = 1, node_types: list[str] | None = None, edge_types: list[str] | None = None) -> DataFrame:
    """Edges among the nodes within ``depth`` steps of ``start``, after checks of the arguments."""
    if direction not in ("downstream", "upstream", "both"):
        raise ValueError(f"direction: {direction}")
    if depth < -1 or depth == 0:
        raise ValueError(f"depth: {depth}")
    known = {r["type"] for r in nodes.select("type").distinct().collect()}
    if unknown := set(node_types or ()) - known:
        raise ValueError(f"node types: {sorted(unknown)}")
    roots = nodes.filter(F.col("node_id").isin(start)).select("node_id")
    if missing := set(start) - {r["node_id"] for r in roots.collect()}:
        raise ValueError(f"unknown nodes: {sorted(missing)}")
    allowed = nodes.filter(F.col("type").isin(node_types)).select("node_id") if node_types else None
    reached = k_hop(edges, roots, depth if depth > 0 else MOST_HOPS, direction, edge_types, allowed).select("node_id").distinct()
    kept = edges.filter(F.col("etype").isin(edge_types)) if edge_types else edges
    return subgraph(kept, reached)


def as_json(paths: DataFrame) -> DataFrame:
    """Paths of a walk as JSON texts, with the node, its parent and its depth."""
    return paths.select(F.to_json(F.struct(F.element_at("path", -1).alias("node"), F.try_element_at("path", F.lit(-2)).alias("parent"), "depth")).alias("json"))
