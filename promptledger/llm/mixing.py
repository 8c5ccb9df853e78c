"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source deals its documents in a seeded shuffle, again and again up to ``cap`` times. A document's virtual finish
time is the source's words up to and with it, divided by the source's target; merging all sources by finish time and
stopping at the total budget gives every source its share. Both running sums (within a source, and over all) are taken
in two levels: totals of fine ranges of the sort key, a running sum over those few totals, and a window inside each
range. So no task holds a whole source and none holds the whole merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, discard, documents, freeze, lookup, numbered, unused, word_count

WEIGHTS, RATIO, CAP, SEED = (5, 2, 1), 1.5, 2, "mix-1"

#: Rows that a range of the sort key holds on average.
ROWS_A_RANGE = 10_000


def _ranges(rows: int) -> int:
    """A power of two, by the size of the input."""
    return 1 << max(0, (max(rows, 1) // ROWS_A_RANGE).bit_length())


def targets(sources: DataFrame, total: int, weights=WEIGHTS, ratio=RATIO, cap=CAP) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): shares of ratio * total by weight, none above cap times
    its source's size. Sources whose cap binds come first when sorted by cap / weight; what is left after any number of
    them, over the weights left, is the level of the rest, and the least number that fits its successor is right. One
    row per source, a table far smaller than the documents, so a single ordered window serves."""
    by_code, by_level = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("limit", "rank")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    k = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank"), F.lit(k)) + 1).cast("int"))
    levels = (
        sources.withColumn("rank", F.row_number().over(by_code) - 1).withColumn("w", w)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size").cast("double"))
        .withColumn("limit", F.col("most") / F.col("w"))
        .withColumn("spent", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.lit(float(ratio) * float(total)) - F.col("spent")) / (F.sum("w").over(W.partitionBy()) - F.col("used")))
    )
    first = F.min(F.when(F.col("level") <= F.col("limit"), F.struct("limit", "rank", "level"))).over(W.partitionBy())
    return levels.withColumn("at", first).select(
        "source", "source_size",
        F.when(F.col("at").isNull() | (F.struct("limit", "rank") < F.struct("at.limit", "at.rank")), F.col("most"))
        .otherwise(F.col("at.level") * F.col("w")).alias("target"),
    )


def _queued(docs: DataFrame, stats: DataFrame, rows: int, seed: str) -> DataFrame:
    """Adds source_size, target and the finish times of the first and second dealing: f1, f2 (null where the size is 0)."""
    n, bits = _ranges(rows), 60
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")
    keyed = docs.withColumn("_key", key).withColumn("_range", F.shiftright("_key", bits - (n.bit_length() - 1)))
    keyed = keyed.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    totals = keyed.groupBy("_source", "_range").agg(F.sum("size").alias("_words"))
    ahead = W.partitionBy("_source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ahead = totals.select("_source", "_range", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_ahead"))
    keyed = keyed.join(ahead.hint("merge"), ["_source", "_range"])
    inside = W.partitionBy("_source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    keyed = keyed.withColumn("_upto", F.col("_ahead") + F.sum("size").over(inside))
    keyed = lookup(keyed, stats, "_source", "_rows")
    return keyed.select(
        *docs.columns, "source_size", "target",
        F.when(F.col("size") > 0, F.col("_upto").cast("double") / F.col("target")).alias("f1"),
        F.when(F.col("size") > 0, (F.col("source_size") + F.col("_upto")).cast("double") / F.col("target")).alias("f2"),
    )


def _cut(queue: DataFrame, total: int, rows: int, ratio: float) -> float:
    """The last finish time whose documents, with all before, are within the budget; none at virtual time 2 or later."""
    n = _ranges(2 * rows)
    both = queue.select(F.explode(F.array("f1", "f2")).alias("f"), "size").filter("f < 2")
    both = both.withColumn("range", F.floor(F.col("f") * n).cast("long"))
    spans = both.groupBy("range").agg(F.sum("size").alias("words"), F.max("f").alias("last"))
    spans = spans.withColumn("upto", F.sum("words").over(W.orderBy("range")))
    within = F.col("upto").cast("double") <= F.lit(float(ratio) * float(total))
    found = spans.agg(F.max(F.when(within, F.col("last"))), F.max(F.when(within, F.col("upto"))), F.min(F.when(~within, F.col("range")))).first()
    last, before, edge = found[0], found[1] or 0, found[2]
    if edge is not None:  # one range straddles the budget
        times = both.filter(F.col("range") == edge).groupBy("f").agg(F.sum("size").alias("words"))
        times = times.withColumn("upto", before + F.sum("words").over(W.orderBy("f")))
        last = times.filter(F.col("upto").cast("double") <= float(ratio) * float(total)).agg(F.max("f")).first()[0] or last
    return -1.0 if last is None else last


def taken(sizes: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Frozen ``sizes`` (doc_id, source, size and whatever else tells a row) with source_size, target and taken."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sums = freeze(sums, "mix-sources")
    total, rows = sums.agg(F.sum("source_size"), F.sum("_rows")).first()
    total, rows = total or 0, rows or 0
    stats = targets(sums.select("source", "source_size"), total, weights, ratio, cap)
    stats = freeze(
        stats.join(sums.select(F.col("source").alias("s"), "_rows"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("_source"), "source_size", "target", "_rows"),
        "mix-targets",
    )
    queue = freeze(_queued(sizes, stats, rows, seed), "mix-queue")
    discard(sums, stats)
    cut = _cut(queue, total, rows, ratio)
    times = F.when(F.col("f1") <= cut, 1).otherwise(0) + F.when((F.col("f2") <= cut) & F.lit(cap > 1), 1).otherwise(0)
    return queue.withColumn("taken", F.col("size") * times).drop("f1", "f2")


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs`` (doc_id, text, source, ...). taken: words
    the mix takes, so taken / size (0, 1 or 2) is how often it repeats the document.

    Null texts have size 0 and are never taken. A null source is a source of its own, last in order. Equal rows share
    one place in their source's order, in which ties fall to doc_id, then size; equal finish times are taken together
    or not at all. An empty table gives an empty result; other columns are ignored. Reruns give the same rows, whatever the
    partitions.
    """
    sizes = freeze(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return taken(sizes, **options)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, whatever their names, each row as often as ``mix`` takes it. The queue is of
    row numbers and sizes; the texts are shuffled once, to meet how often they are taken."""
    rows, row = numbered(docs)
    sizes = rows.select(F.col(row).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = freeze(sizes, "mix-sizes")
    copies = unused("_copies", rows.columns)
    chosen = freeze(taken(sizes, **options).filter("taken > 0").select(F.col("row").alias(row), (F.col("taken") / F.col("size")).cast("int").alias(copies)), "mix-taken")
    discard(sizes)
    many = rows.join(chosen.hint("merge"), row).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return many.select(*columns_of(docs))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
t AS (SELECT sum(source_size)::DOUBLE AS total FROM s),
w AS (SELECT *, ([5.0, 2.0, 1.0])[(rk % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size::DOUBLE AS most FROM s),
l AS (
  SELECT *, most / w AS lim,
    (1.5::DOUBLE * (SELECT total FROM t) - coalesce(sum(most) OVER (ORDER BY most / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w),
f AS (SELECT min((lim, rk, level)) AS edge FROM l WHERE level <= lim),
g AS (SELECT source, source_size, CASE WHEN edge IS NULL OR (lim, rk) < (edge[1], edge[2]) THEN most ELSE edge[3] * w END AS target FROM l LEFT JOIN f ON true),
q AS (
  SELECT doc_id, size, source_size, target,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (
  SELECT upto::DOUBLE / target AS f, size FROM q WHERE size > 0
  UNION ALL SELECT (source_size + upto)::DOUBLE / target, size FROM q WHERE size > 0),
r AS (SELECT f, sum(size) OVER (ORDER BY f) AS run FROM c WHERE f < 2),
x AS (SELECT coalesce(max(f), -1) AS cut FROM r WHERE run::DOUBLE <= 1.5::DOUBLE * (SELECT total FROM t))
SELECT doc_id, size, source_size, target,
       (size * (CASE WHEN size > 0 AND upto::DOUBLE / target <= cut THEN 1 ELSE 0 END
              + CASE WHEN size > 0 AND (source_size + upto)::DOUBLE / target <= cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q, x
"""
