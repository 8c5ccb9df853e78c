"""Queries on ingest, price feeds, sinks and labelled extensions, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prices, sinks
from ..sources import price_feeds, providers
from ..sources.tables import events, table
from ..streaming import events as streams
from .spend_queries import CALLS, priced

RESPONSES = [
    ("openai", '{"usage":{"prompt_tokens":100,"completion_tokens":20,"prompt_tokens_details":{"cached_tokens":30},"completion_tokens_details":{"reasoning_tokens":5}}}', 100, 20, 30, 5, 0),
    ("openai_responses", '{"usage":{"input_tokens":7,"output_tokens":3,"output_tokens_details":{"reasoning_tokens":1}}}', 7, 3, 0, 1, 0),
    ("openai_embeddings", '{"usage":{"prompt_tokens":9,"total_tokens":9}}', 9, 0, 0, 0, 0),
    ("anthropic", '{"usage":{"input_tokens":10,"output_tokens":4,"cache_read_input_tokens":6,"cache_creation_input_tokens":2}}', 16, 4, 6, 0, 2),
    ("bedrock", '{"usage":{"inputTokens":8,"outputTokens":2}}', 8, 2, 0, 0, 0), ("google", '{"usage_metadata":{"prompt_token_count":5,"candidates_token_count":6,"thoughts_token_count":4}}', 5, 10, 0, 4, 0),
    ("ollama", '{"prompt_eval_count":11,"eval_count":12}', 11, 12, 0, 0, 0), ("openai", '{"id":"x"}', None, None, None, None, None)]


def provider_usage(spark, sf_dir):
    rows = spark.createDataFrame([(i, p, r) for i, (p, r, *_) in enumerate(RESPONSES)], "id long, provider string, response string")
    return providers.with_usage(rows).drop("response")


def feed_litellm(spark, sf_dir):
    raw = spark.createDataFrame([('{"sample_spec":"x","vertex_ai/claude-a":{"input_cost_per_token":1e-6,"output_cost_per_token":4e-6},"claude-a":{"input_cost_per_token":8e-7,"output_cost_per_token":4e-6,"cache_read_input_token_cost":8e-8},"free":{"input_cost_per_token":0},"openai/gpt-b":{"input_cost_per_token":0.000002}}',)], "value string")
    return price_feeds.litellm(raw)


def spend_spans(spark, sf_dir):
    """Priced calls as spans; the oracle counts their attributes."""
    calls = priced(spark, sf_dir).select(
        "call_id", "model", "input_tokens", "output_tokens", "reasoning_tokens", "cost", F.lit("openai").alias("provider"), F.lit(12.5).alias("latency_ms"), F.lit(None).cast("double").alias("ttft_ms"),
        F.col("conv_id").cast("string").alias("trace_id"), F.lit("").alias("agent"), F.lit(None).cast("string").alias("agent_id"), F.timestamp_seconds(F.col("turn")).alias("ts"))
    out = sinks.call_spans(calls)
    return out.select("name", F.col("attributes")["promptledger.step"].cast("int").alias("step"), F.col("attributes")["gen_ai.usage.input_tokens"].cast("long").alias("input_tokens"), F.size("attributes").alias("n_attributes"))


def trend_hourly(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("cost", F.col("value").cast("decimal(18,2)").cast("decimal(38,12)"))
    return streams.trend(rows, "1 hour").select(F.unix_timestamp("start").alias("start"), "n", "usd")


def sessions_by_user(spark, sf_dir):
    return streams.sessions(events(spark, sf_dir), "user_id", "6 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("largest"))


def spend_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.rollup("o_orderpriority", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"))


def value_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


def price_status_cases(spark, sf_dir):
    rows = [("ok", "0.1", "0.2", None, False), ("noinput", None, "0.2", None, False), ("neg", "0.1", "0.2", "-1", False), ("zero", "0", "0.2", None, False), ("zeroreg", "0", "0", None, True), ("noout", "0.1", None, None, False)]
    from decimal import Decimal

    d = lambda x: None if x is None else Decimal(x)
    table_ = spark.createDataFrame([(m, d(i), d(o), d(c), None, "t", None, r) for m, i, o, c, r in rows], prices.SCHEMA)
    calls = spark.createDataFrame([(m, 10, 5) for m in [*[r[0] for r in rows], "other"]], "model string, input_tokens long, output_tokens long")
    return prices.price_calls(calls, table_).select("model", "price_status", "cost")


QUERIES = {f.__name__: f for f in (provider_usage, feed_litellm, spend_spans, trend_hourly, sessions_by_user, spend_rollup, value_percentiles, price_status_cases)}
_V = ", ".join("({}, '{}', {})".format(i, p, ", ".join("NULL" if x is None else str(x) for x in u)) for i, (p, _, *u) in enumerate(RESPONSES))
ORACLES = {
    "provider_usage": f"SELECT id::BIGINT AS id, provider, input_tokens::BIGINT AS input_tokens, output_tokens::BIGINT AS output_tokens, cached_tokens::BIGINT AS cached_tokens, reasoning_tokens::BIGINT AS reasoning_tokens, cache_write::BIGINT AS cache_write FROM (VALUES {_V}) AS t(id, provider, input_tokens, output_tokens, cached_tokens, reasoning_tokens, cache_write)",
    "feed_litellm": "SELECT model, input::DECIMAL(18,12) AS input, output::DECIMAL(18,12) AS output, cached::DECIMAL(18,12) AS cached, NULL::DECIMAL(18,12) AS cache_write FROM (VALUES ('claude-a', 0.0000008, 0.000004, 0.00000008), ('gpt-b', 0.000002, NULL, NULL)) AS t(model, input, output, cached)",
    "spend_spans": f"WITH {CALLS} SELECT 'chat ' || model AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn, call_id)::INT AS step, input_tokens, CASE WHEN cost IS NULL THEN 8 ELSE 9 END AS n_attributes FROM priced",
    "trend_hourly": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,12)) AS usd FROM events GROUP BY 1",
    "sessions_by_user": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY user_id, s)
        SELECT user_id, count(*) AS sessions, max(n) AS largest FROM c GROUP BY user_id""",
    "spend_rollup": "SELECT o_orderpriority, l_returnflag, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ROLLUP (o_orderpriority, l_returnflag)",
    "value_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "price_status_cases": """SELECT model, price_status, cost::DECIMAL(38,12) AS cost FROM (VALUES ('ok', 'priced', 2.0), ('noinput', 'missing_input', NULL), ('neg', 'negative_rate', NULL), ('zero', 'zero_input', NULL), ('zeroreg', 'priced', 0), ('noout', 'missing_output', NULL), ('other', 'unknown_model', NULL)) AS t(model, price_status, cost)""",
}
