"""Column functions on text, paths and identifiers.

Each takes and returns Columns and stays within the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends of Python's str.splitlines; a last empty line is no line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Not a word character, for any alphabet; the same in Java and RE2.
NOT_WORD = r"[^\p{L}\p{N}_]+"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once though ``body`` names it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    """Lines as ``str.splitlines`` gives them."""
    return let(F.split(F.coalesce(text, F.lit("")), LINE_END, -1), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def newline_lines(text: Column) -> Column:
    """Lines parted by line feeds alone, a last empty one included."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def is_blank(line: Column) -> Column:
    """Whether only white space, of any alphabet, is in ``line``."""
    return ~line.rlike(r"(?U)\S")


def instance_repo(instance_id: Column) -> Column:
    """``owner__name-123`` to ``owner_name``."""
    return F.replace(F.regexp_replace(instance_id, r"-\d+$", ""), F.lit("__"), F.lit("_"))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def clean_path(path: Column, repo: Column) -> Column:
    """What follows the repository's name (its ``_`` standing for ``_`` or ``/``) in ``path``; else
    what follows the last ``//``; else ``path``."""
    pattern = F.concat(F.lit("(?i)"), F.replace(repo, F.lit("_"), F.lit("[_/]")), F.lit("/(.+)$"))
    inner = F.call_function("regexp_extract", path, pattern, F.lit(1))
    return F.when(inner != "", inner).when(F.contains(path, F.lit("//")), F.substring_index(path, "//", -1)).otherwise(path)


def is_test_file(node_id: Column) -> Column:
    """Whether a part of the path before ``:``, parted at spaces, ``_`` and ``/``, begins with test."""
    parts = F.split(F.lower(F.split_part(node_id, F.lit(":"), F.lit(1))), "[ _/]")
    return F.exists(parts, lambda p: F.startswith(p, F.lit("test")))


def is_skipped_folder(folder: Column) -> Column:
    return F.contains(folder, F.lit(".git"))


def node_file(node_id: Column) -> Column:
    return F.split_part(node_id, F.lit(":"), F.lit(1))


def node_name(node_id: Column) -> Column:
    return F.split_part(node_id, F.lit(":"), F.lit(-1))


def module_of(entity_id: Column) -> Column:
    """``file:Class.method`` to ``file:Class``; an id without ``:`` stays."""
    name = F.substring(entity_id, F.instr(entity_id, ":") + 1, F.length(entity_id))
    return F.when(F.instr(entity_id, ":") > 0, F.concat(node_file(entity_id), F.lit(":"), F.substring_index(name, ".", 1))).otherwise(entity_id)


def without_init(entity_id: Column) -> Column:
    return F.regexp_replace(entity_id, r"\.__init__$", "")


def docs_entity(path: Column) -> Column:
    """``a/b.py/Class/method`` to ``a/b.py:Class.method``."""
    file, rest = F.regexp_extract(path, r"^(.*?\.py)(?:/(.*))?$", 1), F.regexp_extract(path, r"^(.*?\.py)(?:/(.*))?$", 2)
    rest = F.replace(F.trim(rest, F.lit("/")), F.lit("/"), F.lit("."))
    return F.when(file == "", path).when(rest == "", file).otherwise(F.concat(file, F.lit(":"), rest))


def python_path(text: Column) -> Column:
    """The longest prefix that ends in ``.py``; null without one."""
    found = F.regexp_extract(text, r"(.+\.py)(/.*)?", 1)
    return F.nullif(found, F.lit(""))


def path_in_text(line: Column, folders: Sequence[str]) -> Column:
    """The first Python path in ``line``, cut to begin at the earliest of ``folders`` in it."""
    found = F.regexp_extract(line, r"[\w./-]+\.py", 0)
    starts = [F.nullif(F.instr(found, f"{f}/"), F.lit(0)) for f in folders]
    at = F.array_min(F.array(*starts, F.lit(None).cast("int")))
    return F.nullif(F.when(at.isNull(), found).otherwise(F.substring(found, at, F.length(found))), F.lit(""))


def glob_pattern(glob: str) -> str:
    """A regular expression for the whole string: ``*`` is any run, ``/`` included, ``?`` one
    character, ``[...]`` a class."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        end = glob.find("]", at + 2) if c == "[" else -1
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif end > 0:
            inner = glob[at + 1 : end].replace("\\", "\\\\")
            out.append("[^" + inner[1:] + "]" if inner[0] == "!" else "[" + inner + "]")
            at = end
        else:
            out.append("\\" + c if c in "\\.^$|()[]{}+" else c)
        at += 1
    return "^" + "".join(out) + "$"


def glob_regex(pattern: Column) -> Column:
    """``glob_pattern`` of a column, and of a pattern without a wildcard what is contained."""
    plain = F.regexp_replace(pattern, r"([\\.^$|(){}+])", r"\\$1")
    wild = F.replace(F.regexp_replace(F.regexp_replace(plain, r"\[!", "[^"), r"\?", "(?s:.)"), F.lit("*"), F.lit("(?s:.*)"))
    return F.when(pattern.rlike(r"[*?\[]"), F.concat(F.lit("^"), wild, F.lit("$"))).otherwise(plain)


def matches_file(path: Column, pattern: str) -> Column:
    """Glob match if ``pattern`` has a wildcard, else whether it is contained."""
    return path.rlike(glob_pattern(pattern)) if any(c in pattern for c in "*?[") else F.contains(path, F.lit(pattern))


def squeezed(text: Column) -> Column:
    """Without spaces, tabs and line feeds."""
    return F.translate(text, " \t\n", "")


def squeezed_contains(text: Column, part: Column) -> Column:
    return F.contains(squeezed(text), squeezed(part))


def word_set(text: Column) -> Column:
    """Distinct lower-case words in order of appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != ""))


def words(text: Column) -> Column:
    """Lower-case words in order, repeats included."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def spaced_words(text: Column) -> Column:
    """Words of names, in which ``_`` and ``-`` part words."""
    return F.filter(F.split(F.translate(text, "_-", "  "), NOT_WORD), lambda w: w != "")


def space_tokens(text: Column) -> Column:
    """Number of parts between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def context_header(path: Column, text: Column, start_line: Column) -> Column:
    """A block with its file, the class within the first 50 lines if any, and its line."""
    class_name = F.regexp_extract(F.array_join(F.slice(newline_lines(text), 1, 50), "\n"), r"class\s+(\w+)", 1)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), path),
        F.when(class_name != "", F.concat(F.lit("Class: "), class_name)),
        F.when(start_line > 0, F.concat(F.lit("Lines: "), start_line.cast("string"), F.lit("-"))),
        F.lit(""),
        F.lit("Code:"),
        text,
    )


def embedding_input(path: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.lit("file path: "), path, F.lit("\nlines: "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n\n"), text)


def named_code(name: Column, code: Column) -> Column:
    return F.concat(F.lit("# "), name, F.lit("\n\n"), code)


def numbered(code: Column, start_line: Column) -> Column:
    """A fenced block whose lines begin with right-aligned numbers."""

    def whole(x: Column) -> Column:
        width = F.length((start_line + F.size(x) - 1).cast("string"))
        each = F.transform(x, lambda line, i: F.concat(F.lpad((start_line + i).cast("string"), width, F.lit(" ")), F.lit(" | "), line))
        return F.concat(F.lit("```\n"), F.array_join(each, "\n"), F.lit("\n```"))

    return let(newline_lines(code), whole)


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, from 1, both included."""
    return F.array_join(F.slice(newline_lines(text), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (end >= other_start) & (start <= other_end)


def within(start: Column, end: Column, outer_start: Column, outer_end: Column) -> Column:
    return (start >= outer_start) & (end <= outer_end)


def function_name(code: Column) -> Column:
    return F.regexp_extract(code, r"\bdef\s+([A-Za-z_]\w*)\s*\(", 1)


def files_in_answer(answer: Column) -> Column:
    """Map of paths to code from ``path``, fence, code, fence."""
    pattern = F.lit(r"(?s)(\S+)\n```\w*\n(.*?)\n```")
    return F.map_from_entries(F.arrays_zip(F.regexp_extract_all(answer, pattern, F.lit(1)), F.regexp_extract_all(answer, pattern, F.lit(2))))


def is_elided(comment: Column) -> Column:
    return F.startswith(comment, F.lit("# ...")) | comment.rlike("rest of the code|existing code|other code")


def is_license(comment: Column) -> Column:
    return comment.rlike("(?i)copyright|license|author") | (F.trim(comment) == "")


def content_id(text: Column, metadata: Column) -> Column:
    return F.sha2(F.concat(text, F.to_json(metadata)), 256)


def safe_divide(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    found = F.try_divide(a.cast("double"), b.cast("double"))
    return F.coalesce(F.when(~F.isnan(found) & (F.abs(found) < float("inf")), found), F.lit(otherwise))


def issue_category(answer: Column) -> Column:
    """One of four labels that a model's answer names, else Uncategorized."""
    low = F.lower(answer)
    found = F.lit("Uncategorized")
    for label in ("Security Vulnerability", "Performance Issue", "Feature Request", "Bug Report"):
        found = F.when(F.contains(low, F.lit(label.lower())), label).otherwise(found)
    return found


def enriched_query(query: Column, class_names: Column, function_names: Column, file_pattern: Column) -> Column:
    many = lambda names, what: F.array_join(F.transform(names, lambda n: F.concat(F.lit(f", {what} "), n)), "")
    return F.concat(query, many(class_names, "class"), many(function_names, "function"), F.coalesce(F.concat(F.lit(" file:"), file_pattern), F.lit("")))


def search_name(term: Column) -> Column:
    """A search term without a leading ``class``, ``function``, ``method`` or ``def``."""
    return F.trim(F.regexp_replace(term, r"^(?:[Cc]lass|function|method|def)\s+", ""))
