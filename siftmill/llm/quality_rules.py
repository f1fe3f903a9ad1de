"""Quality rules by distribution divergence (DataFrame functions only).

Base rules: a document fails with fewer than ``MIN_WORDS`` words, or when over
``MAX_REPEAT_PERCENT`` % of its words lie in 8-word windows that occur twice or more in it.

Divergence: each document's histogram of character classes, and of the common words of its
language, is compared with its language's reference by Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1). Common words are the ``N_COMMON`` that most documents of the ``lang``
have, ties by the word. The references are sums over all documents of that ``lang`` that pass
the length guard and have ordinary text (at most ``MOST_RARE_PERCENT`` % of capitals, digits and
symbols), so they follow the corpus at any size; they are a few numbers per language.
Distances of short texts are mostly sampling noise, so each test has a minimum length, below which
it doesn't reject. A document is kept if the base rules pass and neither distance is over its limit.

Words are counted per language by partial aggregates. All else about a document is computed within its
row, once, and written; the references are sums over what is written, and a row per language is
joined back each time.

Defined cases. Null or empty text: zero words, base_failed, not kept. Null lang: compared with the
sums over all documents by the character classes alone. A language of few words: as many common words. Very long texts: all words count. Repeated rows: each is judged alike. An empty table: an
empty result. Further columns are kept; of columns named like a result column, the result stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.llm.common import GAP, let, table, words_of, written

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Words from which a document counts for the references and is tested.
CLASS_GUARD, WORD_GUARD = 50, 100
#: The limit for classes, and what it is higher for short texts: CLASS_NOISE divided by the words.
MAX_CLASS_DISTANCE, CLASS_NOISE, MAX_WORD_DISTANCE = 0.18, 5.0, 0.4
MOST_RARE_PERCENT = 15

SYMBOLS = r"[#*$%&|<>]"
#: Character classes besides symbols; what is left of the word characters is the last class.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "mark": r"""[.,;:!?'"()\[\]/_=+-]""", "beyond": r"[^\x00-\x7F]"}
#: Common words of a language, and how many of all languages are looked up as literals.
N_COMMON, MOST_LITERALS = 20, 10_000

RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def _left_of(text: Column, kept: str) -> Column:
    """Number of code points of ``text`` in the class ``kept``."""
    return F.length(F.regexp_replace(text, f"[^{kept[1:]}+" if not kept.startswith("[^") else f"[{kept[2:]}+", ""))


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash (one for each window, in order) occurs twice or more."""

    def starts(ordered: Column) -> Column:
        hash_at = lambda k: F.get(ordered, k)["h"]
        again = F.transform(ordered, lambda x, k: F.when(((k > 0) & (hash_at(k - 1) == x["h"])) | (hash_at(k + 1) == x["h"]), x["i"]))
        return F.sort_array(F.filter(again, lambda i: i.isNotNull()))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    counted = F.aggregate(let(ordered, starts), zero, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(counted["n"])


def common_words(docs: DataFrame, most: int = N_COMMON) -> DataFrame:
    """``_q_lang, _q_listed``: per language the words that most of its documents have, most first."""
    words = docs.filter("lang IS NOT NULL").select("lang", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = counted.withColumn("nth", nth).filter(F.col("nth") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("nth", "word"))), lambda x: x["word"])
    return best.groupBy(F.col("lang").alias("_q_lang")).agg(listed.alias("_q_listed"))


def _histograms(docs: DataFrame) -> DataFrame:
    """Add ``_q_words`` and the counts of both histograms, from each row alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    common = written(common_words(docs), "common-words")
    literals = [r[0] for r in common.select(F.explode("_q_listed")).distinct().limit(MOST_LITERALS + 1).collect()]
    found = docs.join(common, F.col("lang") == F.col("_q_lang"), "left").drop("_q_lang")
    found = found.withColumn("_q_words", F.filter(F.split(text, GAP), lambda w: w != ""))
    # Words hold no space, so that it can part them.
    hit = (lambda w: w.isin(literals)) if len(literals) <= MOST_LITERALS else (lambda w: F.array_contains("_q_listed", w))
    found = found.withColumns(
        {
            "n_words": F.size("_q_words").cast("long"),
            "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
            "n_symbols": _left_of(text, SYMBOLS).cast("long"),
            "_q_hits": F.concat(F.lit(" "), F.array_join(F.filter("_q_words", hit), "  "), F.lit(" ")),
        }
    )
    classes = [_left_of(text, pattern) for pattern in CLASSES.values()]
    found = found.withColumn("_q_class", F.array(*[c.cast("long") for c in classes], F.col("n_symbols")))
    rest = F.col("word_chars") - F.aggregate("_q_class", F.lit(0).cast("long"), lambda a, x: a + x)
    found = found.withColumn("_q_class", F.array_append("_q_class", F.greatest(rest, F.lit(0).cast("long"))))
    hits, zero = F.col("_q_hits"), F.lit(0).cast("long")

    def count(word: Column) -> Column:
        return ((F.length(hits) - F.length(F.replace(hits, F.concat(F.lit(" "), word, F.lit(" ")), F.lit("")))) / (F.length(word) + 2)).cast("long")

    counts = F.transform(F.sequence(F.lit(0), F.lit(N_COMMON - 1)), lambda k: F.coalesce(count(F.get("_q_listed", k)), zero))
    found = found.withColumn("_q_common", F.when(F.col("_q_listed").isNotNull(), counts))
    seen = F.aggregate("_q_common", zero, lambda a, x: a + x)
    return found.withColumn("_q_common", F.array_append("_q_common", F.col("n_words") - seen)).drop("_q_hits", "_q_listed")


def references(counted: DataFrame) -> DataFrame:
    """Per language, and for '*' over all: ``_q_ref_class`` and ``_q_ref_common``, summed counts."""
    n_class, n_common = len(CLASSES) + 2, N_COMMON + 1
    rare = F.col("_q_class")[0] + F.col("_q_class")[1] + F.col("n_symbols")
    ordinary = counted.filter((F.col("n_words") >= CLASS_GUARD) & (100 * rare <= MOST_RARE_PERCENT * F.col("word_chars")))
    sums = [F.sum(F.col("_q_class")[i]).alias(f"c{i}") for i in range(n_class)] + [F.sum(F.col("_q_common")[i]).alias(f"w{i}") for i in range(n_common)]
    by = written(ordinary.groupBy("lang").agg(*sums), "quality-references")
    every = by.groupBy(F.lit("*").alias("_q_lang")).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n_class)], *[F.lit(None).cast("bigint").alias(f"w{i}") for i in range(n_common)])
    both = by.filter("lang IS NOT NULL").withColumnRenamed("lang", "_q_lang").unionByName(every)
    common = F.array(*[F.col(f"w{i}") for i in range(n_common)])
    return both.select("_q_lang", F.array(*[F.col(f"c{i}") for i in range(n_class)]).alias("_q_ref_class"), F.when(F.col("w0").isNotNull(), common).alias("_q_ref_common"))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; null if either sums to zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    share = lambda x, n: F.when(n > 0, F.transform(x, lambda v: v / n))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    shares = lambda x: let(total(x), lambda n: share(x, n))
    terms = F.zip_with(shares(a), shares(b), lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    return F.sqrt(F.greatest(total(terms), F.lit(0.0)))


def _with_next(step: int) -> Callable[[Column], Column]:
    return lambda hashes: F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (text, lang, ...), or their columns to ``keep``, with the columns of ``RESULT``."""
    clash = [c for c in docs.columns if c in RESULT or c.startswith("_q_")]
    docs = docs.drop(*clash)
    kept = [c for c in docs.columns if c in keep] if keep is not None else docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    found = _histograms(docs)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform("_q_words", lambda w: F.xxhash64(w))
    for step in (1, 2, 4):  # hashes of 2, 4 and at last 8 words
        hashes = let(hashes, _with_next(step))
    windows = F.slice(hashes, 1, F.greatest(F.col("n_words") - WINDOW + 1, F.lit(0)).cast("int"))
    found = found.withColumns(
        {
            "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": let(windows, repeated_words),
        }
    )
    found = written(found.select(*dict.fromkeys([*kept, "lang"]), "_q_class", "_q_common", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "quality-counts")
    found = found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    found = found.withColumn("_q_key", F.coalesce("lang", F.lit("*")))
    found = found.join(references(found), F.col("_q_key") == F.col("_q_lang"), "left")
    found = found.withColumns({"class_distance": js_distance(F.col("_q_class"), F.col("_q_ref_class")), "word_distance": js_distance(F.col("_q_common"), F.col("_q_ref_common"))})
    limit = F.when(F.col("n_words") >= CLASS_GUARD, MAX_CLASS_DISTANCE + CLASS_NOISE / F.col("n_words"))
    far = ((F.col("n_words") >= CLASS_GUARD) & (F.col("class_distance") > limit)) | ((F.col("n_words") >= WORD_GUARD) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    return found.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).select(*kept, *RESULT)


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    clash = [c for c in docs.columns if c in RESULT]
    held = docs.withColumn("_d_own", F.struct(*clash)) if clash else docs
    found = judge(held).filter("kept")
    return found.select(*[F.col("_d_own")[c].alias(c) if c in clash else F.col(c) for c in docs.columns])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERY = ("op5_quality_rules", op5_quality_rules)


def _sql() -> str:
    chars = lambda pattern: f"length(regexp_replace(t, '{pattern}', '', 'g'))"
    kept = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "mark": r"""[^.,;:!?''"()\[\]/_=+-]+""", "beyond": r"[\x00-\x7F]+"}
    classes = ", ".join(chars(p) for p in kept.values())
    n_class, n_common = len(CLASSES) + 2, N_COMMON + 1
    ordinary = f"100 * (cls[1] + cls[2] + n_symbols) <= {MOST_RARE_PERCENT} * word_chars"
    sums = ", ".join(f"sum({a}[{i}])::BIGINT" for a, n in (("cls", n_class), ("com", n_common)) for i in range(1, n + 1))
    names = [f"{a}{i}" for a, n in (("c", n_class), ("w", n_common)) for i in range(1, n + 1)]
    every, nulls = ", ".join(f"sum(cls[{i}])::BIGINT" for i in range(1, n_class + 1)), ", ".join(["NULL"] * n_common)
    ref_c, ref_w = (f"[{', '.join(x for x in names if x[0] == a)}]" for a in "cw")

    def distance(a: str, b: str) -> str:
        p, q = f"({a}[i] / list_sum({a}))", f"({b}[i] / list_sum({b}))"
        part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"
        return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({part(p, q)} + {part(q, p)}) / 2))))"

    return rf"""
WITH w0 AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w1 AS (SELECT *, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {chars(r'[^#*$%&|<>]+')}::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM w0),
df AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS nth FROM (SELECT lang, unnest(list_distinct(w)) AS word FROM w0 WHERE lang IS NOT NULL) GROUP BY lang, word),
common AS (SELECT lang, list(word ORDER BY nth) AS cw FROM df WHERE nth <= {N_COMMON} GROUP BY lang),
w2 AS (SELECT w1.*, [{classes}, n_symbols] AS cls0, CASE WHEN cw IS NOT NULL THEN list_transform(range(1, {N_COMMON + 1}), lambda i: CASE WHEN i <= len(cw) THEN len(list_filter(w, lambda x: x = cw[i])) ELSE 0 END) END AS com0 FROM w1 LEFT JOIN common ON w1.lang = common.lang),
h AS (SELECT *, list_append(cls0, greatest(0, word_chars - list_sum(cls0))) AS cls, CASE WHEN com0 IS NOT NULL THEN list_append(com0, n_words - list_sum(com0)) END AS com FROM w2),
win AS (SELECT rid, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS x FROM w0, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, x) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, {WINDOW})) AS v(k) GROUP BY rid),
base AS (SELECT h.*, coalesce(c.n, 0)::BIGINT AS n_repeat_words, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM h LEFT JOIN covered c USING (rid)),
judged AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM base),
refs({', '.join(['lang', *names])}) AS (SELECT lang, {sums} FROM h WHERE n_words >= {CLASS_GUARD} AND {ordinary} AND lang IS NOT NULL GROUP BY lang
  UNION ALL SELECT '*', {every}, {nulls} FROM h WHERE n_words >= {CLASS_GUARD} AND {ordinary}),
ref AS (SELECT lang, {ref_c} AS rc, CASE WHEN w1 IS NOT NULL THEN {ref_w} END AS rw FROM refs),
far AS (SELECT j.*, {distance('cls', 'rc')} AS cd, {distance('com', 'rw')} AS wd FROM judged j LEFT JOIN ref r ON coalesce(j.lang, '*') = r.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce((n_words >= {CLASS_GUARD} AND cd > {MAX_CLASS_DISTANCE} + {CLASS_NOISE} / greatest(n_words, 1)) OR (n_words >= {WORD_GUARD} AND wd > {MAX_WORD_DISTANCE}), false) AS kept
FROM far
"""


SQL = _sql()
