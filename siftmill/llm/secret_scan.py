"""Secret scans with multipart credential linking (DataFrame functions only).

Base spans are the leftmost non-overlapping matches of three fixed patterns. The method adds weak
candidates, parts of credentials that mean little alone: access identifiers, keys without a name,
and endpoints. All parts, base spans among them, are interval-joined with the weak candidates whose
scope (``SCOPE`` code points on either side) they meet: an identifier is reported where a secret
co-occurs, a secret where an identifier or an endpoint does, an endpoint where both do. A weak
candidate that overlaps a base span is not reported again.

Spans depend on the text alone, so parts are found per distinct text (by SHA-256): copies, however
many, are one row in the join. The join's key is a text and a cell of ``SCOPE`` code points, and a
cell holds a few parts at most, so its pairs grow with the text and no key is hot.

Defined cases. Null or empty text: no spans; the digest is that of the empty string. Null doc_id
or lang or source: ordinary rows. Repeated rows: each gets its text's result. Very long texts:
positions come from prefix sums in chunks, so the work grows with the matches. An empty table: an
empty result. Further columns are kept by ``scan`` and ``redacted``; of columns named like a result
column, ``scan`` keeps the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.common import let, table, written

SCOPE = 200
LEAST_SECRET = 16
MASK = "[secret]"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")

_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
#: Pattern and number of the group that the length test looks at.
BASE = {
    "assign": (rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run that is long enough is the same match as the whole run with a test of its length.
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "weak_id": r"""A(?:KIA|SIA|IDA|ROA|GPA)[A-Z0-9]{8,}|(?:[Uu]ser|[Ll]ogin|[Aa]ccount|[Cc]lient)(?:_?(?:id|name))?["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    # A whole run, kept if it is ``MIXED``.
    "weak_secret": rf"[A-Za-z0-9+/_-]{{{LEAST_SECRET},}}={{0,2}}",
    "weak_endpoint": r"[a-z]{2,12}://[A-Za-z0-9.-]+(?::[0-9]+)?|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?",
}
#: What a run must have to be a weak secret: a letter and a digit, or letters of both cases where an upper
#: one is not just the first letter, as of a long noun.
MIXED = r"[A-Za-z][^A-Za-z0-9]*[0-9]|[0-9][^A-Za-z0-9]*[A-Za-z]|[a-z][^a-z]*[A-Z]|[A-Z][^A-Z]*[A-Z][^a-z]*[a-z]"
#: Without a match of this, a text has no part at all; it is cheaper than the patterns.
_ANY = rf"[A-Za-z0-9+/_-]{{{LEAST_SECRET}}}|A[A-Z]{{3}}[A-Z0-9]{{8,}}|://|[0-9]\.[0-9]{{1,3}}\.|(?:{_NAMES}|[Uu]ser|[Ll]ogin|[Aa]ccount|[Cc]lient)[A-Za-z_]{{0,5}}[\"']?\x20*[:=]"
_CHUNK = 128

RESULT = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
_SPAN = "array<struct<start:bigint,end:bigint,kind:int>>"


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)


def spans_of(text: Column, kind: str, pattern: str, tested: Column, holds: Callable[[Column], Column]) -> Column:
    """The matches of ``pattern`` in ``text`` as spans, those where ``holds`` is true for what
    ``tested`` has at their ordinal."""

    def spans(x: Column) -> Column:
        """x: m, the matches; b, the texts before each; t, what is tested; n, lengths of b and m;
        c, sums of n by chunk."""

        def span(m: Column, i: Column) -> Column:
            chunk = F.floor(i / _CHUNK).cast("int")
            start = _sum(F.slice(x["c"], 1, chunk)) + _sum(F.slice(x["n"], chunk * _CHUNK + 1, i % _CHUNK)) + F.length(F.get(x["b"], i))
            return F.when(holds(F.get(x["t"], i)), F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.lit(KINDS.index(kind)).alias("kind")))

        return F.filter(F.transform(x["m"], span), lambda s: s.isNotNull())

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"), tested.alias("t"))
    steps = lambda x: F.zip_with(x["b"], x["m"], lambda b, m: (F.length(b) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
    chunks = lambda n: F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / _CHUNK).cast("int")), lambda c: _sum(F.slice(n, c * _CHUNK + 1, _CHUNK)))
    return let(found, lambda x: let(steps(x), lambda n: let(F.struct(x["m"].alias("m"), x["b"].alias("b"), x["t"].alias("t"), n.alias("n"), chunks(n).alias("c")), spans))).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """All base spans, ordered by start, then kind."""
    found = []
    for kind, (pattern, group, least) in BASE.items():
        own = spans_of(text, kind, pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), _at_least(least))
        found.append(F.when(text.rlike(pattern), own).otherwise(F.array().cast(_SPAN)))
    return F.array_sort(F.concat(*found), _by_start)


def _at_least(n: int) -> Callable[[Column], Column]:
    return lambda t: F.length(t) >= n


def weak_spans(text: Column) -> Column:
    found = []
    for kind, pattern in WEAK.items():
        holds = (lambda t: t.rlike(MIXED)) if kind == "weak_secret" else (lambda t: t.isNotNull())
        own = spans_of(text, kind, pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), holds)
        found.append(F.when(text.rlike(pattern), own).otherwise(F.array().cast(_SPAN)))
    return F.concat(*found)


def _by_start(a: Column, b: Column) -> Column:
    order = lambda x: F.struct(x["start"], x["kind"], x["end"])
    return F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0)


def _parts(docs: DataFrame) -> DataFrame:
    """``docs`` with _s_key (the text's digest), _s_base and _s_weak, from each row alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_SPAN)
    has = text.rlike(_ANY)
    return docs.withColumns({"_s_key": F.sha2(text, 256), "_s_base": F.when(has, base_spans(text)).otherwise(none), "_s_weak": F.when(has, weak_spans(text)).otherwise(none)})


def linked(parts: DataFrame) -> DataFrame:
    """From _s_key, _s_base, _s_weak: per text with any, ``_s_more``, the weak spans to report."""
    alone = parts.filter(F.size("_s_weak") > 0).select("_s_key", F.explode(F.concat("_s_base", "_s_weak")).alias("p")).select("_s_key", "p.*").distinct()
    cell = lambda x: F.floor(x / SCOPE).cast("long")
    part = alone.select("_s_key", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))).alias("cell"), F.col("start").alias("ps"), F.col("end").alias("pe"), F.col("kind").alias("pk"))
    weak = alone.filter(F.col("kind") >= len(BASE))
    probe = weak.withColumn("cell", F.explode(F.sequence(cell(F.col("start") - SCOPE), cell(F.col("end") + SCOPE))))
    near = probe.join(part, ["_s_key", "cell"]).filter((F.col("ps") < F.col("end") + SCOPE) & (F.col("pe") > F.col("start") - SCOPE))
    is_a = lambda *kinds: F.col("pk").isin([KINDS.index(k) for k in kinds])
    apart = ~((F.col("ps") < F.col("end")) & (F.col("pe") > F.col("start")))
    seen = near.groupBy("_s_key", "start", "end", "kind").agg(
        F.max(apart & is_a("access", "weak_id")).alias("id"),
        F.max(apart & is_a("assign", "hex", "weak_secret")).alias("secret"),
        F.max(apart & is_a("weak_endpoint")).alias("endpoint"),
        F.max(~apart & is_a(*BASE)).alias("covered"),
    )
    kind = F.col("kind")
    links = (
        F.when(kind == KINDS.index("weak_id"), F.col("secret"))
        .when(kind == KINDS.index("weak_secret"), F.col("id") | F.col("endpoint"))
        .otherwise(F.col("id") & F.col("secret"))
    )
    found = seen.filter(links & ~F.col("covered")).groupBy("_s_key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("_s_more"))
    return found.withColumnRenamed("_s_key", "_s_key2")


def _told(spans: Column) -> Column:
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _results(parts: DataFrame, more: DataFrame) -> DataFrame:
    """Add the columns of ``RESULT`` and ``_s_all``, all spans in order."""
    both = parts.join(more, parts["_s_key"] == more["_s_key2"], "left").drop("_s_key2")
    both = both.withColumn("_s_all", F.when(F.col("_s_more").isNull(), F.col("_s_base")).otherwise(F.array_sort(F.concat("_s_base", "_s_more"), _by_start)))
    count = lambda k: F.size(F.filter("_s_base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return both.withColumns({f"n_{k}": count(k) for k in BASE} | {"base_sha256": F.sha2(_told(F.col("_s_base")), 256), "spans": _told(F.col("_s_all"))})


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) with the columns of ``RESULT``."""
    clash = [c for c in docs.columns if c in RESULT or c.startswith("_s_")]
    docs = docs.drop(*clash)
    parts = written(_parts(docs), "secret-parts")
    return _results(parts, linked(parts)).select(*docs.columns, *RESULT)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``MASK``; columns as they were."""
    rest = [c for c in docs.columns if c != "text"]
    parts = written(_parts(docs.select(F.struct(*rest).alias("_d_own") if rest else F.lit(0).alias("_d_own"), "text")), "secret-parts")
    found = _results(parts, written(linked(parts), "secret-links"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        piece = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = s["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], F.array(piece, F.lit(MASK)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("_s_all", start, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    text = F.when(F.size("_s_all") > 0, done).otherwise(F.col("text"))
    return found.withColumn("_d_text", text).select(*[F.col("_d_text").alias(c) if c == "text" else F.col("_d_own")[c].alias(c) for c in docs.columns])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = written(_parts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "secret-parts")
    return _results(parts, linked(parts)).select("doc_id", *RESULT)


QUERY = ("op10_secret_scan", op10_secret_scan)


def _sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    arms = []
    for kind, (pattern, group, least) in BASE.items():
        arms.append((kind, pattern, f"length(regexp_extract_all(t, {quote(pattern)}, {group})[i]) >= {least}"))
    for kind, pattern in WEAK.items():
        arms.append((kind, pattern, f"regexp_matches(m, {quote(MIXED)})" if kind == "weak_secret" else "true"))
    each = " UNION ALL ".join(
        f"SELECT rid, {KINDS.index(kind)} AS kind, {holds} AS holds, length(m) AS n, sum(length(b) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS e FROM (SELECT rid, t, i, string_split_regex(t, {quote(pattern)})[i] AS b, regexp_extract_all(t, {quote(pattern)})[i] AS m FROM d, unnest(range(1, len(regexp_extract_all(t, {quote(pattern)})) + 1)) AS u(i))"
        for kind, pattern, holds in arms
    )
    name = "['" + "','".join(KINDS) + "'][kind + 1]"
    told = f"coalesce(string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, kind), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT rid, kind, (e - n)::BIGINT AS s, e::BIGINT AS e FROM ({each}) WHERE holds),
near AS (SELECT w.rid, w.kind, w.s, w.e, p.kind AS pk, NOT (p.s < w.e AND p.e > w.s) AS apart FROM m w JOIN m p ON w.rid = p.rid AND p.s < w.e + {SCOPE} AND p.e > w.s - {SCOPE} WHERE w.kind > 2),
seen AS (SELECT rid, kind, s, e, bool_or(apart AND pk IN (1, 3)) AS a, bool_or(apart AND pk IN (0, 2, 4)) AS b, bool_or(apart AND pk = 5) AS c, bool_or(NOT apart AND pk < 3) AS covered FROM near GROUP BY ALL),
reported AS (SELECT rid, kind, s, e FROM m WHERE kind < 3 UNION ALL SELECT rid, kind, s, e FROM seen WHERE NOT covered AND CASE kind WHEN 3 THEN b WHEN 4 THEN a OR c ELSE a AND b END)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, {told} AS spans
FROM d LEFT JOIN reported USING (rid) GROUP BY rid
"""


SQL = _sql()
