"""Spend attribution: reports by tags, unpriced calls, the bounded buffer, limits and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import MONEY


def report(calls: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """Spend per combination of tags. A missing tag is a group of its own (null); an unpriced call counts as zero spend
    and as unpriced; no calls give no group, also without ``group_by``."""
    keys = [F.col("tags")[k].alias(k) for k in group_by or []]
    out = calls.select(*keys, "cost", "input_tokens", "output_tokens", F.coalesce("reasoning_tokens", F.lit(0)).alias("reasoning_tokens")).groupBy(*(group_by or [])).agg(
        F.coalesce(F.sum("cost"), F.lit(0)).cast(MONEY).alias("usd"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("reasoning_tokens").alias("reasoning_tokens"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col("cost").isNull()).alias("unpriced_calls"),
    ).filter("calls > 0")
    return out.withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))


def total(reported: DataFrame) -> DataFrame:
    return reported.agg(F.sum("usd").cast(MONEY).alias("usd"))


def assert_under(reported: DataFrame, usd, **tags) -> DataFrame:
    """Rows (usd, cap) if the report's spend under these tags is above ``usd``; none if it is not."""
    for k, v in tags.items():
        reported = reported.filter(F.col(k) == v)
    return total(reported).withColumn("cap", F.lit(str(usd)).cast(MONEY)).filter("usd > cap")


def unpriced_calls(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count_if(F.col("cost").isNull()).alias("unpriced_calls"))


def unpriced_models(calls: DataFrame) -> DataFrame:
    """One diagnostic per model that has no price, however often it was called."""
    return calls.filter("cost is null").groupBy("model").agg(F.count(F.lit(1)).alias("calls"))


def buffer(rows: DataFrame, order: list, most: int = 100_000, keys: list[str] | None = None) -> DataFrame:
    """The newest ``most`` rows, of each key if ``keys`` are named. Without keys a sort with a limit keeps every task to
    its own newest rows."""
    if not keys:
        return rows.orderBy(*[F.col(c).desc() for c in order]).limit(most)
    newest = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= most).drop("_n")


def dropped(rows: DataFrame, most: int = 100_000) -> DataFrame:
    return rows.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("dropped"))


def counters(calls: DataFrame, tags: list[str]) -> DataFrame:
    """Metric counters by model and tags: tokens, reasoning tokens, cost."""
    keys = [F.col("tags")[k].alias(k) for k in tags]
    return calls.groupBy("model", *keys).agg(
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum(F.coalesce("reasoning_tokens", F.lit(0))).alias("reasoning_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0)).cast(MONEY).alias("cost"),
    )


def sum_usage(calls: DataFrame) -> DataFrame:
    """Field by field; all zero without calls."""
    names = [c for c in ("input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens", "cache_write") if c in calls.columns]
    return calls.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
