"""Tables, and the call log that the sample tables imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tokens

USAGE = T.StructType([T.StructField(n, T.LongType()) for n in ("input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens", "cache_write")])
MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
MONEY, RATE = T.DecimalType(38, 12), T.DecimalType(18, 12)

LLM_CALLS = T.StructType([
    T.StructField("call_id", T.StringType()), T.StructField("provider", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("messages", MESSAGES), T.StructField("request_kwargs", T.StringType()), T.StructField("response", T.StringType()),
    *USAGE.fields, T.StructField("cost", MONEY), T.StructField("currency", T.StringType()), T.StructField("cost_source", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()), T.StructField("ttft_ms", T.DoubleType()), T.StructField("trace_id", T.StringType()),
    T.StructField("agent", T.StringType()), T.StructField("agent_id", T.StringType()), T.StructField("conversation_id", T.StringType()),
    T.StructField("decision_id", T.StringType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType())), T.StructField("ts", T.TimestampType()),
])

#: Models that the sample log deals to conversations by number; the last has no price.
MODELS = ("gpt-4o", "claude-opus-4-8", "gemini-2.0-flash", "o1", "house-llm")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with an instant for ts and the number that props holds."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def sample_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per assistant turn: its input is all earlier turns of the conversation, its output the turn's text."""
    earlier = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("conv_id") % len(MODELS) + 1).cast("int"))
    turns = table(spark, sf_dir, "conversations").withColumn("n", tokens.count_quarter(F.col("text")))
    turns = turns.withColumn("before", F.coalesce(F.sum(F.col("n") + tokens.PER_MESSAGE).over(earlier), F.lit(0)))
    return turns.filter("role = 'assistant'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("call_id"), "conv_id", "turn", model.alias("model"),
        (F.col("before") + tokens.PRIMING).alias("input_tokens"), F.col("n").alias("output_tokens"), F.lit(0).cast("long").alias("reasoning_tokens"),
        F.create_map(F.lit("feature"), F.concat(F.lit("f"), (F.col("conv_id") % 3).cast("string")), F.lit("user_id"), F.concat(F.lit("u"), (F.col("conv_id") % 10).cast("string"))).alias("tags"),
    )


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines by schema; a corrupt line fails the job. Records end at a newline only, not at Unicode separators."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the lines of a file as they stand, in order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.withColumn("line_no", F.monotonically_increasing_id())
