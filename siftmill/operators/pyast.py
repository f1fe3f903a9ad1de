"""Python source files as relations, by the standard library's syntax trees.

Each operator takes ``path, text`` and runs batch by batch within the tasks that hold the files; a
file that doesn't parse gives no rows. Lines are from 1, both included, unless said otherwise.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def parsed(text: str | None) -> ast.Module | None:
    try:
        return ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _rows(files: DataFrame, schema: str, each: Callable[[str, str], Iterator[tuple]], by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of each file; the file's columns ``by`` come along as texts."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(*row, *own) for path, text, *own in zip(part["path"], part["text"], *(part[c] for c in by)) for row in each(path, text or "")]
            yield pd.DataFrame(found, columns=[*names, *by])

    return files.select("path", "text", *[F.col(c).cast("string").alias(c) for c in by]).mapInPandas(run, ", ".join([schema, *(f"{c} string" for c in by)]))


def _inside(node: ast.AST) -> list[ast.stmt]:
    return [x for x in getattr(node, "body", []) if isinstance(x, ast.stmt)]


def _inner(node: ast.AST) -> list[ast.stmt]:
    """Statements of all branches of a compound statement."""
    found: list[ast.stmt] = []
    for field in ("body", "handlers", "cases", "orelse", "finalbody"):
        for x in getattr(node, field, ()):
            found += [x] if isinstance(x, ast.stmt) else x.body
    return found


def entity_rows(path: str, text: str, tree: ast.Module | None = None) -> Iterator[tuple]:
    """(node_id, type, start, end, code) with dotted nesting. A class's ``__init__`` belongs to the
    class: neither it nor what it defines is a node."""
    tree, lines = tree or parsed(text), text.split("\n")

    def walk(node: ast.AST, above: tuple[str, ...], in_class: bool) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, *_DEFS)):
                if isinstance(child, ast.FunctionDef) and child.name == "__init__" and in_class:
                    continue
                name = (*above, child.name)
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                yield f"{path}:{'.'.join(name)}", kind, child.lineno, child.end_lineno, "\n".join(lines[child.lineno - 1 : child.end_lineno])
                yield from walk(child, name, kind == "class")
            else:
                yield from walk(child, above, in_class)

    if tree is not None:
        yield from walk(tree, (), False)


def entities(files: DataFrame) -> DataFrame:
    return _rows(files, "node_id string, type string, start int, end int, code string", entity_rows)


def import_rows(path: str, text: str, tree: ast.Module | None = None) -> Iterator[tuple]:
    """(src, module, entity, alias, level): one row per imported name."""
    tree = tree or parsed(text)
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.Import):
            for name in node.names:
                yield path, name.name, None, name.asname, 0
        elif isinstance(node, ast.ImportFrom):
            for name in node.names:
                yield path, node.module or "", name.name, name.asname, node.level


def imports(files: DataFrame) -> DataFrame:
    return _rows(files, "src string, module string, entity string, alias string, level int", import_rows)


def _called(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def call_rows(path: str, text: str, tree: ast.Module | None = None) -> Iterator[tuple]:
    """(src, name, etype): names that functions call, and bases, decorators and calls of the
    constructor of classes."""
    tree = tree or parsed(text)

    def calls(body: list[ast.stmt]) -> Iterator[str]:
        stack: list[ast.AST] = list(body)
        while stack:
            node = stack.pop()
            if isinstance(node, (*_DEFS, ast.ClassDef)):
                continue
            if isinstance(node, ast.Call) and (name := _called(node.func)):
                yield name
            stack += ast.iter_child_nodes(node)

    def walk(node: ast.AST, above: tuple[str, ...]) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(node, ast.ClassDef) and isinstance(child, ast.FunctionDef) and child.name == "__init__":
                continue
            if isinstance(child, (ast.ClassDef, *_DEFS)):
                src = f"{path}:{'.'.join((*above, child.name))}"
                for d in child.decorator_list:
                    if name := _called(d.func if isinstance(d, ast.Call) else d):
                        yield src, name, "invokes"
                if isinstance(child, ast.ClassDef):
                    for base in child.bases:
                        if name := _called(base):
                            yield src, name, "inherits"
                    for own in _inside(child):
                        if isinstance(own, ast.FunctionDef) and own.name == "__init__":
                            yield from ((src, name, "invokes") for name in calls(own.body))
                else:
                    yield from ((src, name, "invokes") for name in calls(child.body))
                yield from walk(child, (*above, child.name))
            else:
                yield from walk(child, above)

    if tree is not None:
        yield from dict.fromkeys(walk(tree, ()))


def facts(files: DataFrame) -> DataFrame:
    """What ``entities`` (without code), ``imports`` and ``calls`` give, by one parse of each file: rows of ``kind`` entity, import or call
    with the columns of that kind; see ``of_kind``."""
    schema = "kind string, node_id string, type string, src string, module string, entity string, alias string, level int, name string, etype string"

    def each(path: str, text: str) -> Iterator[tuple]:
        tree = parsed(text)
        none = (None,) * 5
        yield from (("entity", node_id, kind, None, *none, None) for node_id, kind, *_ in entity_rows(path, text, tree))
        yield from (("import", None, None, *row, None, None) for row in import_rows(path, text, tree))
        yield from (("call", None, None, src, None, None, None, None, name, etype) for src, name, etype in call_rows(path, text, tree))

    return _rows(files, schema, each)


#: Columns of the kinds of ``facts``.
_KINDS = {"entity": ("node_id", "type"), "import": ("src", "module", "entity", "alias", "level"), "call": ("src", "name", "etype")}


def of_kind(found: DataFrame, kind: str) -> DataFrame:
    return found.filter(F.col("kind") == kind).select(*_KINDS[kind])


def calls(files: DataFrame) -> DataFrame:
    return _rows(files, "src string, name string, etype string", call_rows)


def function_rows(path: str, text: str) -> Iterator[tuple]:
    """(path, qualified_name, class_name, function_name, start, end, content), lines from 0. Functions
    that stand in bodies of modules and classes, in those of their ``if``, ``for``, ``with`` and ``try``
    (not in ``else`` or ``except``), and directly in functions; decorators belong to them; the name has
    the innermost class alone."""
    tree, lines = parsed(text), text.splitlines()

    def walk(body: list[ast.stmt], owner: str | None) -> Iterator[tuple]:
        for node in body:
            if isinstance(node, _DEFS):
                start = min([node.lineno, *(d.lineno for d in node.decorator_list)]) - 1
                name = "::".join(x for x in (path, owner, node.name) if x)
                content = f"# {name}\n\n" + "\n".join(lines[start : node.end_lineno])
                yield path, name, owner, node.name, start, node.end_lineno - 1, content
                yield from walk([n for n in node.body if isinstance(n, _DEFS)], owner)
            elif isinstance(node, ast.ClassDef):
                yield from walk(node.body, node.name)
            elif hasattr(node, "body"):
                yield from walk(_inside(node), owner)

    if tree is not None:
        yield from walk(tree.body, None)


def functions(files: DataFrame) -> DataFrame:
    return _rows(files, "path string, qualified_name string, class_name string, function_name string, start int, end int, content string", function_rows)


def context_rows(path: str, text: str) -> Iterator[tuple]:
    """(path, qualified_name, start, end, content): functions with their file, class, the module's
    imports and assignments, and the class's attributes, each on one line."""
    tree, lines = parsed(text), text.splitlines()
    if tree is None:
        return
    flat = lambda n: " ".join(x.strip() for x in lines[n.lineno - 1 : n.end_lineno])
    module = " ".join(flat(n) for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom, ast.Assign, ast.AnnAssign)))

    def walk(body: list[ast.stmt], owners: tuple[ast.ClassDef, ...], outer: tuple[str, ...]) -> Iterator[tuple]:
        for node in body:
            if isinstance(node, _DEFS):
                start = min([node.lineno, *(d.lineno for d in node.decorator_list)]) - 1
                owner = owners[-1] if owners else None
                name = "::".join([path, *([owner.name] if owner else []), *outer, node.name])
                fields = " ".join(flat(n) for n in owner.body if isinstance(n, (ast.Assign, ast.AnnAssign))) if owner else ""
                parts = [path, owner.name if owner else "", module, fields, "\n".join(lines[start : node.end_lineno])]
                yield path, name, start, node.end_lineno - 1, " ".join(p for p in parts if p)
                yield from walk([n for n in node.body if isinstance(n, _DEFS)], owners, (*outer, node.name))
            elif isinstance(node, ast.ClassDef) and not outer and len(owners) < 2:
                yield from walk(node.body, (*owners, node), outer)

    yield from walk(tree.body, (), ())


def contexts(files: DataFrame) -> DataFrame:
    return _rows(files, "path string, qualified_name string, start int, end int, content string", context_rows)


def functions_with_rest(files: DataFrame, size: int = 15) -> DataFrame:
    """Functions, and what no function covers in fixed blocks of ``size`` lines: path, start, end,
    block_type, content, by start. A file without functions is all fixed blocks."""

    def each(path: str, text: str) -> Iterator[tuple]:
        lines, own = text.splitlines(), list(function_rows(path, text))
        covered = {k for f in own for k in range(f[4], f[5] + 1)}
        out = [(path, f[4], f[5], "function", f[6]) for f in own]
        free = [k for k in range(len(lines)) if k not in covered]
        run: list[int] = []
        for k in [*free, None]:
            if run and (k is None or k != run[-1] + 1):
                for a in range(run[0], run[-1] + 1, size):
                    z = min(a + size - 1, run[-1])
                    content = "\n".join(lines[a : z + 1])
                    if content.strip():
                        out.append((path, a, z, "fixed", content))
                run = []
            if k is not None:
                run.append(k)
        yield from sorted(out, key=lambda r: (r[1], r[3]))

    return _rows(files, "path string, start int, end int, block_type string, content string", each)


def outline_rows(path: str, text: str) -> Iterator[tuple]:
    """(path, kind, class_name, name, start, end) of classes, their methods and top-level functions."""
    tree = parsed(text)
    for node in tree.body if tree else ():
        if isinstance(node, ast.ClassDef):
            yield path, "class", None, node.name, node.lineno, node.end_lineno
            for own in node.body:
                if isinstance(own, _DEFS):
                    yield path, "method", node.name, own.name, own.lineno, own.end_lineno
        elif isinstance(node, _DEFS):
            yield path, "function", None, node.name, node.lineno, node.end_lineno


def outline(files: DataFrame) -> DataFrame:
    return _rows(files, "path string, kind string, class_name string, name string, start int, end int", outline_rows)


def inert_rows(path: str, text: str) -> Iterator[tuple]:
    """(path, kind, start, end): imports, comments, docstrings and global assignments."""
    tree = parsed(text)
    if tree is None:
        return
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            yield path, "import", node.lineno, node.end_lineno
        if isinstance(node, (ast.Module, ast.ClassDef, *_DEFS)) and node.body:
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                yield path, "docstring", first.lineno, first.end_lineno
    for node in tree.body:
        if isinstance(node, (ast.Assign, ast.AnnAssign)):
            yield path, "global", node.lineno, node.end_lineno
    for token in tokenize.generate_tokens(io.StringIO(text).readline):
        if token.type == tokenize.COMMENT:
            yield path, "comment", token.start[0], token.end[0]


def inert_lines(files: DataFrame) -> DataFrame:
    return _rows(files, "path string, kind string, start int, end int", inert_rows)


def line_entities(text: str) -> dict[int, tuple[str | None, str | None]]:
    """For each line the entity and class that the last visited definition over it gives: methods are
    ``Class.method``, functions within functions ``outer.inner``, class lines have no entity."""
    tree, out = parsed(text), {}

    def walk(node: ast.AST, owner: str | None, outer: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                out.update((k, (None, child.name)) for k in range(child.lineno, child.end_lineno + 1))
                walk(child, child.name, None)
            elif isinstance(child, _DEFS):
                name = f"{owner}.{child.name}" if owner else f"{outer}.{child.name}" if outer else child.name
                out.update((k, (name, owner)) for k in range(child.lineno, child.end_lineno + 1))
                walk(child, owner, None if owner else name)
            else:
                walk(child, owner, outer)

    if tree is not None:
        walk(tree, None, None)
    return out


def line_map(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``path, start, end, entity, class_name`` (and ``by``): runs of lines with the same entity and class."""

    def each(path: str, text: str) -> Iterator[tuple]:
        last: list | None = None
        for line, (entity, owner) in sorted(line_entities(text).items()):
            if last and last[2] == line - 1 and last[3:] == [entity, owner]:
                last[2] = line
                continue
            if last:
                yield tuple(last)
            last = [path, line, line, entity, owner]
        if last:
            yield tuple(last)

    return _rows(files, "path string, start int, end int, entity string, class_name string", each, by)


class _Skeleton(ast.NodeTransformer):
    def __init__(self, constants: bool):
        self.constants = constants

    def visit_FunctionDef(self, node):
        node.body = [ast.Expr(ast.Constant(...))]
        return node

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        kept = [self.visit(x) for x in node.body if isinstance(x, (ast.ClassDef, *_DEFS)) or self.constants and isinstance(x, (ast.Assign, ast.AnnAssign))]
        node.body = kept or [ast.Expr(ast.Constant(...))]
        return node

    def visit_Module(self, node):
        node.body = [self.visit(x) for x in node.body if isinstance(x, (ast.ClassDef, *_DEFS)) or self.constants and isinstance(x, (ast.Assign, ast.AnnAssign))]
        return node


def skeleton_of(text: str, constants: bool = True) -> str:
    """Classes, functions and, if wanted, constants, bodies replaced by ``...``; text that doesn't
    parse stays as it is."""
    tree = parsed(text)
    return text if tree is None else ast.unparse(ast.fix_missing_locations(_Skeleton(constants).visit(tree)))


@F.pandas_udf(T.StringType())
def skeleton(texts: pd.Series) -> pd.Series:
    return pd.Series([skeleton_of(t or "") for t in texts])


def _tokens(text: str) -> int:
    return len(text.split())


def block_rows(path: str, text: str) -> Iterator[tuple]:
    """(path, block_path, parent_path, kind, start, end, tokens, span_id): the tree of a module's
    statements that have names or stand for others, by materialised paths. Repeated names get a number;
    a block's tokens are those of its own lines, without its inner blocks'."""
    tree, lines = parsed(text), text.split("\n")
    if tree is None:
        return
    kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.Import: "import", ast.ImportFrom: "import", ast.Assign: "assignment", ast.AnnAssign: "assignment"}

    def walk(node: ast.AST, above: tuple[str, ...], span: str | None) -> Iterator[tuple]:
        seen: dict[str, int] = {}
        for child in _inside(node):
            kind = kinds.get(type(child), "statement")
            name = child.name if kind in ("class", "function") else kind
            if name == "__init__" and isinstance(node, ast.ClassDef):
                kind = "constructor"
            seen[name] = seen.get(name, 0) + 1
            own = (*above, name if seen[name] == 1 else f"{name}_{seen[name]}")
            start = min([child.lineno, *(d.lineno for d in getattr(child, "decorator_list", []))])
            inner = [x for x in _inside(child) if kind in ("class", "function", "constructor")]
            covered = {k for x in inner for k in range(x.lineno, x.end_lineno + 1)}
            tokens = sum(_tokens(lines[k - 1]) for k in range(start, child.end_lineno + 1) if k not in covered)
            named = ".".join(own) if kind in ("class", "function", "constructor") else span or ("imports" if kind == "import" else "impl")
            yield path, list(own), list(above), kind, start, child.end_lineno, tokens, named
            if kind in ("class", "function", "constructor"):
                yield from walk(child, own, named)

    yield from walk(tree, (), None)


def blocks(files: DataFrame) -> DataFrame:
    return _rows(files, "path string, block_path array<string>, parent_path array<string>, kind string, start int, end int, tokens int, span_id string", block_rows)


def syntax_chunk_rows(path: str, text: str, least: int = 100, size: int = 500, most: int = 2000, hard: int = 2000, most_chunks: int = 200) -> Iterator[tuple]:
    """(path, chunk_no, start, end, tokens, span_ids, content): neighbouring statements grouped by a
    budget of tokens; classes and functions over it are entered, and other compound statements over ``most``;
    a simple statement over ``most`` is left out. Small chunks join the smaller neighbour while the
    result is within ``hard``, first all under ``least``, then until there are ``most_chunks``. A file
    under ``least`` is one chunk; generated files over ``hard`` and files that don't parse give none."""
    tree, lines = parsed(text), text.split("\n")
    total = _tokens(text)
    if tree is None or not total or (lines[0].startswith("#") and "generated" in lines[0].lower() and total > hard):
        return
    count = lambda a, z: sum(_tokens(x) for x in lines[a - 1 : z])
    units: list[tuple[int, int, int, str]] = []

    def cut(body: list[ast.stmt], span: str) -> None:
        for node in body:
            start = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            named = isinstance(node, (ast.ClassDef, *_DEFS))
            own = f"{span}.{node.name}".lstrip(".") if named else span or ("imports" if isinstance(node, (ast.Import, ast.ImportFrom)) else "impl")
            if named and count(start, node.end_lineno) > size and _inside(node):
                units.append((start, max(start, node.body[0].lineno - 1), count(start, max(start, node.body[0].lineno - 1)), own))
                cut(node.body, own)
            elif count(start, node.end_lineno) > most and _inner(node):
                units.append((start, max(start, _inner(node)[0].lineno - 1), count(start, max(start, _inner(node)[0].lineno - 1)), own))
                cut(_inner(node), span)
            elif count(start, node.end_lineno) <= most:
                units.append((start, node.end_lineno, count(start, node.end_lineno), own))

    cut(tree.body, "")
    chunks: list[list] = []
    for start, end, tokens, span in units if total >= least else [(1, len(lines), total, "impl")]:
        if chunks and chunks[-1][2] + tokens <= size:
            chunks[-1] = [chunks[-1][0], max(end, chunks[-1][1]), chunks[-1][2] + tokens, chunks[-1][3] | {span}]
        else:
            chunks.append([start, end, tokens, {span}])

    def join(limit: Callable[[], bool]) -> None:
        while len(chunks) > 1 and limit():
            for k in sorted(range(len(chunks)), key=lambda k: (chunks[k][2], k)):
                beside = [j for j in (k - 1, k + 1) if 0 <= j < len(chunks) and chunks[j][2] + chunks[k][2] <= hard]
                if beside:
                    a, z = sorted((k, min(beside, key=lambda j: chunks[j][2])))
                    chunks[a : z + 1] = [[chunks[a][0], max(chunks[a][1], chunks[z][1]), chunks[a][2] + chunks[z][2], chunks[a][3] | chunks[z][3]]]
                    break
            else:
                return

    join(lambda: min(c[2] for c in chunks) < least)
    join(lambda: len(chunks) > most_chunks)
    for k, (start, end, tokens, spans) in enumerate(chunks):
        yield path, k, start, end, tokens, sorted(spans), "\n".join(lines[start - 1 : end])


def syntax_chunks(files: DataFrame, **budget: int) -> DataFrame:
    return _rows(files, "path string, chunk_no int, start int, end int, tokens int, span_ids array<string>, content string", lambda path, text: syntax_chunk_rows(path, text, **budget))


def code_split_rows(path: str, text: str, most_chars: int = 1500, fallback_lines: int = 40) -> Iterator[tuple]:
    """(path, start, end, content): whole statements grouped up to ``most_chars``, longer ones entered;
    fixed blocks of ``fallback_lines`` where the file doesn't parse. Lines from 0."""
    tree, lines = parsed(text), text.split("\n")
    if tree is None:
        for a in range(0, len(lines), fallback_lines):
            content = "\n".join(lines[a : a + fallback_lines])
            if content.strip():
                yield path, a, min(a + fallback_lines, len(lines)) - 1, content
        return
    spans: list[list[int]] = []

    def cut(body: list[ast.stmt]) -> None:
        for node in body:
            start = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            size = len("\n".join(lines[start - 1 : node.end_lineno]))
            if size > most_chars and _inside(node):
                spans.append([start, max(start, node.body[0].lineno - 1)])
                cut(node.body)
            elif spans and len("\n".join(lines[spans[-1][0] - 1 : node.end_lineno])) <= most_chars:
                spans[-1][1] = node.end_lineno
            else:
                spans.append([start, node.end_lineno])

    cut(tree.body)
    for start, end in spans:
        yield path, start - 1, end - 1, "\n".join(lines[start - 1 : end])


def code_splits(files: DataFrame) -> DataFrame:
    return _rows(files, "path string, start int, end int, content string", code_split_rows)
