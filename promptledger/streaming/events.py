"""Event streams: exactly one row per call, fan-out to sinks, streamed responses put together, budgets and trends.

The same functions read batch tables: what is a Column or DataFrame expression in batch is one on a stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import spend
from ..sources.tables import MONEY


def read(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def event_time(df: DataFrame, column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Timestamps without zone become instants, which watermarks need. Attribution goes by the row, not by arrival."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def exactly_once(df: DataFrame, key: str = "call_id") -> DataFrame:
    """One row per key, also when it is delivered again within the watermark."""
    return df.dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def fan_out(df: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, dead_letters: list | None = None):
    """Every micro-batch to every sink. A sink that fails does not keep the others from theirs; the first failure is
    raised when all have had their turn, so the batch is tried again."""

    def deliver(batch: DataFrame, number: int) -> None:
        first = None
        batch.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch, number)
                except Exception as e:  # noqa: BLE001
                    if dead_letters is not None:
                        dead_letters.append((name, number, str(e)))
                    first = first or e
        finally:
            batch.unpersist()
        if first is not None and dead_letters is None:
            raise first

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver)


def trend(df: DataFrame, width: str = "1 hour", slide: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Spend per time window (tumbling, or sliding with ``slide``): an extension, not of the original libraries."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = df.groupBy(at.alias("w"), *(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").cast(MONEY).alias("usd"))
    return out.select(F.col("w.start").alias("start"), *(keys or []), "n", "usd")


def sessions(df: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    out = df.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def spend_stream(df: DataFrame, tags: list[str]) -> DataFrame:
    return spend.counters(df, tags)


FINAL = T.StructType([T.StructField("call_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("chunks", T.LongType()), T.StructField("ttft_ms", T.DoubleType()), T.StructField("complete", T.BooleanType())])


def finalise(chunks: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """chunks (call_id, seq, text, ts, started_ms, last) of streamed responses -> one row per call, at its end mark or,
    without one, when ``timeout_ms`` pass without a chunk. Late chunks of a finished call do not count again."""

    def run(key, batches, state):
        parts, first, started, done = state.get if state.exists else ("{}", None, None, False)
        texts = json.loads(parts)
        if state.hasTimedOut:
            if done:
                state.remove()
                return
            ended, complete = True, False
        else:
            ended = complete = False
            for pdf in batches:
                for r in pdf.itertuples():
                    texts[str(r.seq)] = r.text or ""
                    at = int(pd.Timestamp(r.ts).timestamp() * 1000)
                    first = at if first is None else min(first, at)
                    started = int(r.started_ms) if started is None else started
                    ended = complete = ended or bool(r.last)
            if done:
                return
        state.update(("{}" if ended else json.dumps(texts), first, started, ended))
        state.setTimeoutDuration(timeout_ms)
        if ended:
            text = "".join(texts[k] for k in sorted(texts, key=int))
            ttft = None if first is None or started is None else float(first - started)
            yield pd.DataFrame([(key[0], text, len(texts), ttft, complete)], columns=FINAL.names)

    state = "parts string, first long, started long, done boolean"
    return chunks.groupBy("call_id").applyInPandasWithState(run, FINAL, state, "append", "ProcessingTimeTimeout")


def block_stream(calls: DataFrame, scope: str, cap_tokens: int, reserve: int = 256) -> DataFrame:
    """A running budget per scope that refuses calls before they run; a refused call does not accrue. calls: scope,
    order_key, input_tokens, output_tokens; decided in order within a micro-batch and across them."""

    def run(key, batches, state):
        spent = state.get[0] if state.exists else 0
        out = []
        for r in pd.concat(list(batches)).sort_values("order_key").itertuples():
            blocked = spent + r.input_tokens + reserve > cap_tokens
            spent += 0 if blocked else int(r.input_tokens + r.output_tokens)
            out.append((str(key[0]), int(r.order_key), "blocked" if blocked else "run", int(spent)))
        state.update((int(spent),))
        yield pd.DataFrame(out, columns=["scope", "order_key", "action", "spent_tokens"])

    schema = "scope string, order_key long, action string, spent_tokens long"
    return calls.groupBy(scope).applyInPandasWithState(run, schema, "spent long", "append", "NoTimeout")
