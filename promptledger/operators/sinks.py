"""Sinks: rows as spans, metric counters, governance spans, content capture and appended tables."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

OWN = "promptledger."


def _attributes(pairs: list[tuple[str, Column]]) -> Column:
    """A map of those attributes that have a value."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def _positive(name: str) -> Column:
    return F.when(F.col(name) > 0, F.col(name))


def call_spans(calls: DataFrame) -> DataFrame:
    """Calls as chat spans: name, start, end, attributes, and the step within the trace."""
    step = F.when(F.col("trace_id").isNotNull(), F.row_number().over(W.partitionBy("trace_id").orderBy("ts", "call_id")))
    pairs = [
        ("gen_ai.operation.name", F.lit("chat")), ("gen_ai.system", F.nullif("provider", F.lit(""))), ("gen_ai.request.model", F.col("model")), ("gen_ai.usage.input_tokens", F.col("input_tokens")),
        ("gen_ai.usage.output_tokens", F.col("output_tokens")), ("gen_ai.usage.reasoning_tokens", _positive("reasoning_tokens")), ("gen_ai.usage.cost", F.col("cost")),
        (OWN + "latency_ms", F.col("latency_ms")), (OWN + "ttft_ms", F.col("ttft_ms")), (OWN + "trace_id", F.col("trace_id")), (OWN + "step", F.col("_step")),
        ("gen_ai.agent.name", F.nullif("agent", F.lit(""))), ("gen_ai.agent.id", F.nullif("agent_id", F.lit("")))]
    start = F.timestamp_micros((F.unix_micros("ts") - F.coalesce("latency_ms", F.lit(0.0)) * 1000).cast("long"))
    return calls.withColumn("_step", step).select(F.concat(F.lit("chat "), "model").alias("name"), start.alias("start"), F.col("ts").alias("end"), _attributes(pairs).alias("attributes"))


def tool_spans(calls: DataFrame) -> DataFrame:
    pairs = [("gen_ai.operation.name", F.lit("execute_tool")), ("gen_ai.tool.name", F.col("name")), (OWN + "latency_ms", F.col("latency_ms")), (OWN + "trace_id", F.col("trace_id"))]
    start = F.timestamp_micros((F.unix_micros("ts") - F.coalesce("latency_ms", F.lit(0.0)) * 1000).cast("long"))
    return calls.select(F.concat(F.lit("execute_tool "), "name").alias("name"), start.alias("start"), F.col("ts").alias("end"), _attributes(pairs).alias("attributes"))


def governance_spans(events: DataFrame, kind: str) -> DataFrame:
    """Budget, guardrail, compression and packing events as spans: each scalar column an attribute, texts to 200 characters."""
    pairs = []
    for f in events.schema.fields:
        if f.name == "ts" or isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            continue
        c = F.col(f.name)
        pairs.append((f"{OWN}{kind}.{f.name}", F.substring(c, 1, 200) if isinstance(f.dataType, T.StringType) else c))
    return events.select(F.lit(f"{kind}").alias("name"), F.col("ts").alias("start"), F.col("ts").alias("end"), _attributes(pairs).alias("attributes"))


def audit_spans(entries: DataFrame) -> DataFrame:
    """Audit entries mirrored as spans."""
    pairs = [(OWN + "audit.seq", F.col("seq")), (OWN + "audit.hash", F.col("hash")), (OWN + "audit.payload", F.substring("payload", 1, 200))]
    return entries.select(F.concat(F.lit("audit."), "type").alias("name"), F.col("ts").alias("ts"), _attributes(pairs).alias("attributes"))


def deduplicate_spans(audit: DataFrame, governance: DataFrame, key: str) -> DataFrame:
    """Where both tell of one event, the audit span stands."""
    return audit.unionByName(governance.join(audit.select(key), key, "left_anti"), allowMissingColumns=True)


CUT = "…[truncated]"


def capture_content(df: DataFrame, column: str, mode: str = "off", mask: Callable[[Column], Column] | None = None, max_bytes: int = 8192) -> DataFrame:
    """Message content as JSON text for spans: off by default, masked if asked, cut to a number of UTF-8 bytes with a mark.
    What cannot be encoded or masked is left out, never passed on."""
    if mode == "off":
        return df.withColumn(column, F.lit(None).cast("string"))

    @F.pandas_udf(T.StringType())
    def fit(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                raw = json.dumps(json.loads(t), ensure_ascii=False).encode()
            except (ValueError, UnicodeError):
                return None
            if len(raw) <= max_bytes:
                return raw.decode()
            mark = CUT.encode()
            return raw[: max(0, max_bytes - len(mark))].decode("utf-8", "ignore") + CUT

        return texts.map(one)

    text = F.to_json(column) if not isinstance(df.schema[column].dataType, T.StringType) else F.col(column)
    return df.withColumn(column, mask(text) if mask else text).withColumn(column, fit(column))


def spend_rows(calls: DataFrame) -> DataFrame:
    """Rows of a spend sink: tags as JSON in order of key, costs as exact decimals."""
    tags = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("tags"))))
    return calls.select("ts", "model", tags.alias("tags"), "cost", "input_tokens", "output_tokens", "reasoning_tokens")


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append to a table: Spark's commit makes the rows appear together or not at all."""
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
