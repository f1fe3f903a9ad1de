"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

Method. Each source gets a target: its weight's share of all words, stopped at ``MAX_REPEATS``
times the source's own words, the excess reshared by weight. The mix is cut into blocks of equal
word counts. Sainte-Laguë apportionment (highest quotients ``votes / (2 i + 1)``) hands the blocks
to the sources, then each source's blocks to its shards by their words. Within a shard, documents
stand in the order of a seeded hash, their words are numbered through, and ``quota mod blocks``
blocks are selected at even steps from a seeded offset, on top of ``quota div blocks`` whole
passes. What a document gives is the part of it that lies in selected blocks, so no word is taken
more than ``MAX_REPEATS`` times.

Only sums per source and bucket (``BUCKETS`` rows a source, more for over ``BUCKETS * ROWS_PER_SHARD``
rows) meet in small windows, and a row per source in one; document rows are shuffled once, by source
and shard, so a source that holds a third of all rows is spread over its shards.

Defined cases. Null text: size 0, nothing taken. Null source: a source of its own, after all
others. Null doc_id: an ordinary row. Repeated rows: each counts and takes for itself. An empty
table: an empty result. Rows stand in the order of a hash of doc_id and text, so that reruns agree and
rows without doc_id, or with one in common, are spread; only rows equal in both stand together, in one
shard. Very long texts: whole, by their number of words. All sizes 0: all targets 0. Further columns of
the input are kept; of columns named like a result column, the result's value stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.llm.common import n_words_of, table, written

MAX_REPEATS = 3
BLOCK_WORDS = 128
#: Small corpora get smaller blocks: at least so many blocks where there are as many words.
LEAST_BLOCKS = 100_000
BUCKETS = 4096
ROWS_PER_SHARD = 5000
SEED = "siftmill-mix"

RESULT = ("size", "source_size", "target", "taken")


def sainte_lague(df: DataFrame, group: list[str], votes: str, seats: str, ties: list[Column]) -> DataFrame:
    """Add ``quota``: the long number of ``seats`` (equal within a group) that each row of a group
    gets for its ``votes``. Equal quotients go by ``ties``. Zero votes get no seat.

    Two divisors that certainly enclose the right one bound each row's seats, so only about four
    quotients a row are ranked, however many seats there are.
    """
    in_group = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(in_group), F.sum(votes).over(in_group)

    def at(more: Column) -> Column:
        return F.floor(F.col(votes) * (F.col(seats) + more) / F.col("_total") + 0.5)

    ranged = (
        df.withColumns({"_n": n, "_total": total.cast("double"), "_row": F.row_number().over(in_group.orderBy(*ties))})
        .withColumn("_low", F.when(F.col("_total") > 0, F.greatest(at(-F.col("_n") / 2) - 1, F.lit(0))).otherwise(0).cast("long"))
        .withColumn("_high", F.when(F.col(votes) > 0, at(F.col("_n") / 2) + 1).otherwise(0).cast("long"))
        .withColumn("_low", F.least("_low", "_high"))
        .withColumn("_rest", F.col(seats) - F.sum("_low").over(in_group))
    )
    seat = ranged.withColumn("_seat", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1))))
    order = in_group.orderBy(F.desc_nulls_last(F.col(votes) / (2 * F.col("_seat") + 1)), "_row", "_seat")
    won = F.when(F.col("_seat").isNotNull() & (F.row_number().over(order) <= F.col("_rest")), 1).otherwise(0)
    back = seat.withColumn("_won", won).groupBy(*group, "_row")
    return back.agg(*[F.first(c).alias(c) for c in df.columns if c not in group], (F.first("_low") + F.sum("_won")).alias("quota")).select(*df.columns, "quota")


def source_targets(sources: DataFrame) -> DataFrame:
    """From ``source, source_size``: add ``weight`` (1, 2, 3, repeating in code point order, null
    last) and ``target``, the capped share of the sum of all sizes."""
    every = Window.partitionBy()
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weighed = sources.withColumn("_no", number).withColumn("weight", ((F.col("_no") - 1) % 3 + 1).cast("long"))
    cap = MAX_REPEATS * F.col("source_size")
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    # The first source, by cap per weight, whose cap is not below the level of those from it on sets the level.
    found = weighed.withColumn("_cap", cap).withColumn("_level", level)
    found = found.withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), "_no", "_level"))).over(every)["_level"])
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("weight"))
    return found.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and taken."""
    return _dealt(docs).drop("_m_copies")


def _dealt(docs: DataFrame) -> DataFrame:
    """``mix`` with ``_m_copies``: how many whole copies of a document stand for what is taken of it."""
    clash = [c for c in docs.columns if c in RESULT or c.startswith("_m_")]
    # By the text too, so that rows without doc_id, or with one in common, are spread like any others.
    key = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("#"), F.md5(F.coalesce("text", F.lit("")))))
    buckets = max(BUCKETS, 1 << (docs.count() // ROWS_PER_SHARD).bit_length())
    sized = docs.drop(*clash).withColumns({"size": n_words_of(F.col("text")), "_m_key": key})
    sized = sized.withColumn("_m_bucket", F.conv(F.substring("_m_key", 1, 8), 16, 10).cast("long") % buckets)

    sums = written(sized.groupBy("source", "_m_bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")), "mix-sums")
    sources = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows")).select("source", "source_size"))
    rows = sums.groupBy(F.col("source").alias("_s")).agg(F.sum("rows").alias("rows"))
    every = Window.partitionBy()
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.sum("source_size").over(every) / LEAST_BLOCKS))).cast("long")
    sources = sources.join(rows, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumns({"block": block, "seats": F.round(F.sum("target").over(every) / block).cast("long")})
    sources = sainte_lague(sources, [], "target", "seats", [F.asc_nulls_last("source")])
    sources = written(sources.withColumn("shards", F.least(F.lit(buckets), 1 + F.floor(F.col("rows") / ROWS_PER_SHARD)).cast("long")).drop("rows", "seats", "weight").withColumnRenamed("quota", "source_quota"), "mix-sources")

    shard = F.floor(F.col("_m_bucket") * F.col("_m_shards") / buckets)
    by_source = sources.withColumnsRenamed({"source": "_m_source", "shards": "_m_shards", "block": "_m_block"})
    shards = sums.join(by_source, sums["source"].eqNullSafe(by_source["_m_source"])).groupBy("source", shard.alias("shard")).agg(F.sum("words").alias("words"), F.first("source_quota").alias("source_quota"), F.first("_m_block").alias("block"))
    shards = sainte_lague(shards, ["source"], "words", "source_quota", [F.col("shard")])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / F.col("block")))
    quota = F.least(F.col("quota"), MAX_REPEATS * blocks)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "#"), F.coalesce("source", F.lit("")), F.lit("#"), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long") % blocks
    shards = shards.select(F.col("source").alias("_m_source"), F.col("shard").alias("_m_shard_q"), blocks.alias("_m_blocks"), F.floor(quota / blocks).alias("_m_passes"), (quota % blocks).alias("_m_extra"), offset.alias("_m_offset"))
    shards = written(shards, "mix-shards")

    dealt = sized.join(by_source.select("_m_source", "source_size", "target", "_m_block", "_m_shards"), sized["source"].eqNullSafe(F.col("_m_source"))).drop("_m_source")
    dealt = dealt.withColumn("_m_shard", shard).drop("_m_shards", "_m_bucket")
    dealt = dealt.join(shards, dealt["source"].eqNullSafe(shards["_m_source"]) & (dealt["_m_shard"] == shards["_m_shard_q"]))
    order = Window.partitionBy("source", "_m_shard").orderBy("_m_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("_m_end", F.sum("size").over(order))

    def picked(word: Column) -> Column:
        """Words in extra blocks before this word of the shard."""
        at, inside = F.floor(word / F.col("_m_block")), word % F.col("_m_block")
        upto = lambda b: F.floor((b * F.col("_m_extra") + F.col("_m_offset")) / F.col("_m_blocks"))
        return F.col("_m_block") * (upto(at) - upto(F.lit(0))) + inside * (upto(at + 1) - upto(at))

    extra = picked(F.col("_m_end")) - picked(F.col("_m_end") - F.col("size"))
    taken = F.when(F.col("size") == 0, 0).otherwise(F.col("_m_passes") * F.col("size") + extra).cast("long")
    dealt = dealt.withColumn("taken", taken)
    # Parts of documents are added up along the shard, and each whole that is reached is a copy: equal rows
    # are not rounded alike, and a shard has as many copies as its parts make, up to one.
    part = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0)
    start = (F.col("_m_offset") % 997) / F.lit(997.0)
    upto = F.sum(part).over(order) + start
    dealt = dealt.withColumn("_m_copies", (F.floor(upto + 1e-9) - F.floor(upto - part + 1e-9)).cast("int"))
    return dealt.select(*[c for c in docs.columns if c not in clash], *RESULT, "_m_copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row of ``docs`` as many times as ``taken`` holds it, with the parts of
    documents rounded so that each source's words come near its target. Columns are those of ``docs``."""
    clash = [c for c in docs.columns if c in RESULT]
    kept = docs.withColumn("_d_own", F.struct(*clash)) if clash else docs
    found = _dealt(kept).filter((F.col("size") > 0) & (F.col("_m_copies") > 0))
    found = found.withColumn("_d_copy", F.explode(F.sequence(F.lit(1), F.col("_m_copies"))))
    return found.select(*[F.col("_d_own")[c].alias(c) if c in clash else F.col(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERY = ("op6_mixing", op6_mixing)

SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || '#' || md5(coalesce(text, ''))) AS h,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
bucketed AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % {BUCKETS} AS bucket FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM bucketed GROUP BY source),
weighed AS (SELECT *, (no - 1) % 3 + 1 AS weight, {MAX_REPEATS} * source_size AS cap FROM sources),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM weighed),
level AS (SELECT lv FROM levels WHERE lv * weight <= cap ORDER BY cap / weight, no LIMIT 1),
targets AS (SELECT s.source, s.no, s.source_size, s.n_rows, least(s.cap::DOUBLE, l.lv * s.weight) AS target FROM weighed s, level l),
seated AS (SELECT *, greatest(1, least({BLOCK_WORDS}, floor(sum(source_size) OVER () / {LEAST_BLOCKS})))::BIGINT AS block, count(*) OVER () AS n FROM targets),
seats AS (SELECT *, round(sum(target) OVER () / block)::BIGINT AS seats FROM seated),
quotients AS (SELECT source, no, target / (2 * i + 1) AS q, seats, i FROM seats, unnest(range(0, (target / block + n + 3)::BIGINT)) AS u(i) WHERE target > 0),
won AS (SELECT no FROM quotients QUALIFY row_number() OVER (ORDER BY q DESC, no, i) <= seats),
quota AS (SELECT s.*, (SELECT count(*) FROM won w WHERE w.no = s.no) AS source_quota, least({BUCKETS}, 1 + n_rows // {ROWS_PER_SHARD}) AS shards FROM seats s),
dealt AS (SELECT b.*, q.source_size, q.target, q.block, q.source_quota, q.no, b.bucket * q.shards // {BUCKETS} AS shard FROM bucketed b JOIN quota q ON b.source IS NOT DISTINCT FROM q.source),
shards AS (SELECT source, no, shard, sum(size)::BIGINT AS words, any_value(source_quota) AS seats, any_value(block) AS block, count(*) OVER (PARTITION BY no) AS n, sum(sum(size)) OVER (PARTITION BY no) AS total FROM dealt GROUP BY source, no, shard),
shard_won AS (SELECT no, shard FROM (SELECT no, shard, words / (2 * i + 1) AS q, seats, i FROM shards, unnest(range(0, (words * seats / total + n + 3)::BIGINT)) AS u(i) WHERE words > 0) QUALIFY row_number() OVER (PARTITION BY no ORDER BY q DESC, shard, i) <= seats),
shard_quota AS (SELECT s.*, ceil(words / block)::BIGINT AS blocks, (SELECT count(*) FROM shard_won w WHERE w.no = s.no AND w.shard = s.shard) AS quota FROM shards s),
capped AS (SELECT *, least(quota, {MAX_REPEATS} * blocks) AS got, ('0x' || substr(md5('{SEED}#' || coalesce(source, '') || '#' || shard), 1, 8))::BIGINT AS seed FROM shard_quota WHERE blocks > 0),
placed AS (
  SELECT d.*, c.blocks, c.got // c.blocks AS passes, c.got % c.blocks AS extra, c.seed % c.blocks AS o, sum(d.size) OVER (PARTITION BY d.no, d.shard ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS e
  FROM dealt d LEFT JOIN capped c ON d.no = c.no AND d.shard = c.shard),
counted AS (
  SELECT *, block * ((e // block * extra + o) // blocks) + e % block * (((e // block + 1) * extra + o) // blocks - (e // block * extra + o) // blocks)
    - block * (((e - size) // block * extra + o) // blocks) - (e - size) % block * ((((e - size) // block + 1) * extra + o) // blocks - ((e - size) // block * extra + o) // blocks) AS part FROM placed)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE passes * size + part END::BIGINT AS taken FROM counted
"""
