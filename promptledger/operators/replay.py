"""Record and replay: matching live requests to recordings in order, drift, and promotion of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import detect
from ..functions.hashing import request_hash
from ..functions.similarity import lexical_score


def with_ordinal(rows: DataFrame, order: list[str], hash_column: str = "request_hash") -> DataFrame:
    """Equal requests are told apart by their order: the first live one gets the first recorded one."""
    return rows.withColumn("ordinal", F.row_number().over(W.partitionBy(hash_column).orderBy(*order)))


def record(calls: DataFrame, order: list[str], request: str = "request", response: str = "response", version: int = 2) -> DataFrame:
    """Recordings: seq, request_hash of the request as it stands, and request and response redacted. ``seq`` is an
    order, taken from ``order`` by a struct rather than a global count, which one task would have to make."""
    return calls.select(
        F.struct(*order).alias("seq"), request_hash(F.col(request), version).alias("request_hash"),
        detect.redact_recording(F.col(request)).alias("request"), detect.redact_recording(F.col(response)).alias("response"))


def replay(live: DataFrame, recorded: DataFrame, live_order: list[str], recorded_order: list[str]) -> DataFrame:
    """Live requests (request_hash, ...) with the response recorded for them; a miss has none and ``hit`` false."""
    left = with_ordinal(live, live_order)
    right = with_ordinal(recorded, recorded_order).select("request_hash", "ordinal", F.col("response").alias("replayed"), F.lit(True).alias("_hit"))
    return left.join(right, ["request_hash", "ordinal"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def drift(live: DataFrame, recorded: DataFrame, live_order: list[str], recorded_order: list[str]) -> DataFrame:
    """Live responses that differ from the recorded ones, missing ones included."""
    return replay(live, recorded, live_order, recorded_order).filter(~F.col("replayed").eqNullSafe(F.col("response")))


def semantic_drift(drifted: DataFrame, threshold: float = 0.8, scorer=lexical_score) -> DataFrame:
    return drifted.withColumn("score", scorer(F.coalesce("response", F.lit("")), F.coalesce("replayed", F.lit("")))).filter(F.col("score") < threshold)


def promote(spark: SparkSession, path: str, version: int = 2) -> DataFrame:
    """A trace of JSON lines -> recordings. Headers and unknown kinds are left out."""
    lines = spark.read.option("lineSep", "\n").text(path).withColumn("line", F.monotonically_increasing_id())
    kind = F.get_json_object("value", "$.kind")
    rows = lines.filter(F.get_json_object("value", "$._meta").isNull()).withColumn("kind", kind).filter("kind in ('llm', 'tool')")
    request = F.coalesce(F.get_json_object("value", "$.request"), F.col("value"))
    body = F.concat(F.lit('{"kind":"'), F.col("kind"), F.lit('",'), F.substring(F.trim(request), 2, 1 << 30))
    return rows.select(F.col("line").alias("seq"), "kind", request_hash(body, version).alias("request_hash"), detect.redact_recording(request).alias("request"), detect.redact_recording(F.get_json_object("value", "$.response")).alias("response"))
