"""Queries on tokens, prices, spend and budgets, with equivalent SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import budgets, prices, spend
from ..sources.tables import MONEY, events, sample_calls, table

QUARTER = "CAST(ceil(length({0}) / 4.0::DOUBLE) AS BIGINT)"
PIECES_SQL = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
SUBWORD = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, CAST(ceil((length({0}) / 3.5::DOUBLE + " + PIECES_SQL + " * 1.2::DOUBLE) / 2.0::DOUBLE) AS BIGINT)) END"

CALLS = f"""
turns AS (
  SELECT *, {QUARTER.format('text')} AS n,
    coalesce(sum({QUARTER.format('text')} + 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM conversations),
calls AS (
  SELECT conv_id || '-' || turn AS call_id, conv_id, turn,
    (['gpt-4o', 'claude-opus-4-8', 'gemini-2.0-flash', 'o1', 'house-llm'])[(conv_id % 5 + 1)::INT] AS model,
    CAST(before + 3 AS BIGINT) AS input_tokens, n AS output_tokens, 'f' || (conv_id % 3) AS feature, 'u' || (conv_id % 10) AS user_id
  FROM turns WHERE role = 'assistant'),
rates(model, i, o) AS (VALUES
  ('gpt-4o', 0.0000025::DECIMAL(18,12), 0.00001::DECIMAL(18,12)), ('claude-opus-4-8', 0.000005, 0.000025),
  ('gemini-2.0-flash', 0.0000001, 0.0000004), ('o1', 0.000015, 0.00006)),
priced AS (
  SELECT c.*, CAST(i * CAST(input_tokens AS DECIMAL(10,0)) + o * CAST(output_tokens AS DECIMAL(10,0)) AS DECIMAL(38,12)) AS cost
  FROM calls c LEFT JOIN rates USING (model))"""


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.price_calls(sample_calls(spark, sf_dir), prices.snapshot(spark))


def tokens_docs(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tokens.count_quarter(t).alias("openai_tokens"), tokens.count_subword(t).alias("other_tokens"))


def tokens_messages(spark, sf_dir):
    each = tokens.count_quarter(F.col("text")) + tokens.PER_MESSAGE
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.sum(each) + tokens.PRIMING).alias("n_tokens"))


IDS = ["gpt-4o", "o3-mini", "ft:gpt-4o:acme::abc123", "claude-opus-4-8", "mistral-large", "gemini-2.0-flash", "olmo-7b", "us.anthropic.claude-opus-4-8-20260115-v1:0",
       "openai/GPT-4o", "gpt-4o-2025-11-13", "anthropic.claude-opus-4-8-v2", "o1", "house-llm", "text-embedding-3-small"]
_IDS_SQL = "(VALUES " + ", ".join(f"('{x}')" for x in IDS) + ") AS ids(model)"


def _ids(spark):
    return spark.createDataFrame([(x,) for x in IDS], "model string")


def model_family(spark, sf_dir):
    m = F.col("model")
    return _ids(spark).select("model", tokens.family(m).alias("family"), prices.lookup_id(m).alias("lookup_id"))


def price_lookup(spark, sf_dir):
    found = prices.with_rates(_ids(spark), prices.snapshot(spark))
    return found.withColumn("price_status", prices.price_status()).select("model", "how", "resolved", "price_status", F.col("rate_input").cast("string").alias("input_rate"))


def cost_estimate(spark, sf_dir):
    return priced(spark, sf_dir).select("call_id", "model", "cost", "price_status")


def spend_by_feature(spark, sf_dir):
    return spend.report(priced(spark, sf_dir), ["feature"])


def spend_by_feature_user(spark, sf_dir):
    return spend.report(priced(spark, sf_dir), ["feature", "user_id"])


def spend_total(spark, sf_dir):
    return spend.report(priced(spark, sf_dir))


def spend_assert_under(spark, sf_dir):
    return spend.assert_under(spend.report(priced(spark, sf_dir), ["feature"]), "0.001", feature="f1")


def unpriced_calls(spark, sf_dir):
    return spend.unpriced_calls(priced(spark, sf_dir))


def unpriced_models(spark, sf_dir):
    return spend.unpriced_models(priced(spark, sf_dir))


def spend_counters(spark, sf_dir):
    return spend.counters(priced(spark, sf_dir), ["feature"])


def usage_sum(spark, sf_dir):
    return spend.sum_usage(sample_calls(spark, sf_dir))


def _spend_events(spark, sf_dir):
    return events(spark, sf_dir).withColumn("usd", F.col("value").cast("decimal(18,2)"))


def spend_buffer_window(spark, sf_dir):
    """The newest 20 rows of each user."""
    return spend.buffer(_spend_events(spark, sf_dir), ["ts", "event_id"], 20, ["user_id"]).select("user_id", "event_id", "usd")


def spend_buffer_dropped(spark, sf_dir):
    return spend.dropped(events(spark, sf_dir), 4000)


def budget_raise(spark, sf_dir):
    rows = _spend_events(spark, sf_dir).select("user_id", "event_id", "ts", F.col("usd").cast(MONEY).alias("cost"), F.col("k").alias("input_tokens"), F.lit(0).alias("output_tokens"))
    out = budgets.stop_after(rows, ["user_id"], ["ts", "event_id"], usd="500.00")
    return out.select("user_id", "event_id", "spent_usd", "executed", "tripped")


def _scoped(spark, sf_dir):
    calls = priced(spark, sf_dir).withColumn("order_key", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long"))
    return calls.select(
        F.col("conv_id"), "order_key", "model", "input_tokens", "output_tokens", F.lit(None).cast("long").alias("max_tokens"),
        F.col("rate_input").alias("in_rate"), F.col("rate_output").alias("out_rate"))


def budget_block(spark, sf_dir):
    return budgets.preflight(_scoped(spark, sf_dir), "conv_id", budgets.Budget(tokens=900, on_exceed="block"))


BLOCK_SQL = f"""
WITH RECURSIVE {CALLS.strip()},
ordered AS (SELECT conv_id, model, input_tokens, output_tokens, i, o, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS order_key FROM calls LEFT JOIN rates USING (model)),
fold(conv_id, order_key, action, model, output_tokens, usd, tokens, spent_usd, spent_tokens) AS (
  SELECT conv_id, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, 0::DECIMAL(38,12), 0::BIGINT, 0::DECIMAL(38,12), 0::BIGINT FROM (SELECT DISTINCT conv_id FROM calls)
  UNION ALL
  SELECT r.conv_id, r.order_key, CASE WHEN f.spent_tokens + r.input_tokens + 256 > 900 THEN 'blocked' ELSE 'run' END, r.model,
    CASE WHEN f.spent_tokens + r.input_tokens + 256 > 900 THEN 0 ELSE r.output_tokens END,
    CASE WHEN f.spent_tokens + r.input_tokens + 256 > 900 OR i IS NULL THEN 0 ELSE i * r.input_tokens::DECIMAL(10,0) + o * r.output_tokens::DECIMAL(10,0) END::DECIMAL(38,12),
    CASE WHEN f.spent_tokens + r.input_tokens + 256 > 900 THEN 0 ELSE r.input_tokens + r.output_tokens END,
    (f.spent_usd + CASE WHEN f.spent_tokens + r.input_tokens + 256 > 900 OR i IS NULL THEN 0 ELSE i * r.input_tokens::DECIMAL(10,0) + o * r.output_tokens::DECIMAL(10,0) END)::DECIMAL(38,12),
    f.spent_tokens + CASE WHEN f.spent_tokens + r.input_tokens + 256 > 900 THEN 0 ELSE r.input_tokens + r.output_tokens END
  FROM fold f JOIN ordered r ON r.conv_id = f.conv_id AND r.order_key = f.order_key + 1)
SELECT * FROM fold WHERE order_key > 0
"""


def budget_clamp(spark, sf_dir):
    return budgets.preflight(_scoped(spark, sf_dir), "conv_id", budgets.Budget(tokens=900, on_exceed="clamp"))


def budget_downgrade(spark, sf_dir):
    b = budgets.Budget(usd="0.004", on_exceed="downgrade", downgrade={"gpt-4o": "gemini-2.0-flash", "o1": "gpt-4o"})
    cheap = F.when(F.col("model") == "gpt-4o", F.struct(F.lit(Decimal("0.0000001")).alias("i"), F.lit(Decimal("0.0000004")).alias("o"))).when(F.col("model") == "o1", F.struct(F.lit(Decimal("0.0000025")).alias("i"), F.lit(Decimal("0.00001")).alias("o")))
    calls = _scoped(spark, sf_dir).withColumn("_c", cheap).withColumn("down_in", F.col("_c.i").cast("decimal(18,12)")).withColumn("down_out", F.col("_c.o").cast("decimal(18,12)")).drop("_c")
    return budgets.preflight(calls, "conv_id", b)


def budget_scopes(spark, sf_dir):
    """Nested budgets: each call counts in the whole log, its feature and its feature and user."""
    return budgets.explode_scopes(priced(spark, sf_dir), [[], ["feature"], ["feature", "user_id"]]).groupBy("scope").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0)).cast(MONEY).alias("usd"))


def stream_break(spark, sf_dir):
    chunks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return budgets.stream_break(chunks, "conv_id", "turn", 300, tokens.count_quarter(F.col("text"))).select("conv_id", "turn", "counted", "delivered", "broken")


REPORT_SQL = "CAST(coalesce(sum(cost), 0) AS DECIMAL(38,12)) AS usd, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS reasoning_tokens, count(*) AS calls, count(*) FILTER (cost IS NULL) AS unpriced_calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens"
_LOOKUP = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(trim(model), '^[^/]*/', '')), '^(?:[a-z]+\.)+', ''), '-v[0-9]+(?::[0-9]+)?$', ''), '-(?:[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$', '')"
_SIX = "SELECT user_id, event_id, ts, CAST(value AS DECIMAL(18,2)) AS usd, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"

QUERIES = {f.__name__: f for f in (
    tokens_docs, tokens_messages, model_family, price_lookup, cost_estimate, spend_by_feature, spend_by_feature_user, spend_total, spend_assert_under, unpriced_calls, unpriced_models,
    spend_counters, usage_sum, spend_buffer_window, spend_buffer_dropped, budget_raise, budget_block, budget_clamp, budget_downgrade, budget_scopes, stream_break)}

ORACLES = {
    "tokens_docs": f"SELECT doc_id, {QUARTER.format('text')} AS openai_tokens, {SUBWORD.format('text')} AS other_tokens FROM documents",
    "tokens_messages": f"SELECT conv_id, CAST(3 + sum({QUARTER.format('text')} + 4) AS BIGINT) AS n_tokens FROM conversations GROUP BY conv_id",
    "model_family": f"""WITH b AS (SELECT model, lower(CASE WHEN lower(model) LIKE 'ft:%' THEN split_part(model, ':', 2) ELSE model END) AS m FROM {_IDS_SQL})
        SELECT model, CASE WHEN regexp_matches(m, '^(gpt|chatgpt|text-|davinci|o[0-9])') THEN 'openai' WHEN m LIKE '%claude%' THEN 'anthropic' WHEN m LIKE '%gemini%' THEN 'google' ELSE 'default' END AS family, {_LOOKUP} AS lookup_id FROM b""",
    "price_lookup": f"""WITH r(m, i) AS (VALUES ('gpt-4o', '0.000002500000'), ('claude-opus-4-8', '0.000005000000'), ('gemini-2.0-flash', '0.000000100000'), ('text-embedding-3-small', '0.000000020000'), ('o1', '0.000015000000')),
        j AS (SELECT model, a.m AS am, b.m AS bm, coalesce(a.i, b.i) AS i FROM {_IDS_SQL} LEFT JOIN r a ON a.m = model LEFT JOIN r b ON b.m = {_LOOKUP})
        SELECT model, CASE WHEN am IS NOT NULL THEN 'exact' WHEN bm IS NOT NULL THEN 'normalized' ELSE 'unpriced' END AS how, coalesce(am, bm) AS resolved,
          CASE WHEN coalesce(am, bm) IS NULL THEN 'unknown_model' ELSE 'priced' END AS price_status, i AS input_rate FROM j""",
    "cost_estimate": f"WITH {CALLS} SELECT call_id, model, cost, CASE WHEN cost IS NULL THEN 'unknown_model' ELSE 'priced' END AS price_status FROM priced",
    "spend_by_feature": f"WITH {CALLS} SELECT feature, {REPORT_SQL} FROM priced GROUP BY feature",
    "spend_by_feature_user": f"WITH {CALLS} SELECT feature, user_id, {REPORT_SQL} FROM priced GROUP BY feature, user_id",
    "spend_total": f"WITH {CALLS} SELECT {REPORT_SQL} FROM priced HAVING count(*) > 0",
    "spend_assert_under": f"WITH {CALLS} SELECT * FROM (SELECT CAST(sum(cost) AS DECIMAL(38,12)) AS usd, CAST(0.001 AS DECIMAL(38,12)) AS cap FROM priced WHERE feature = 'f1') WHERE usd > cap",
    "unpriced_calls": f"WITH {CALLS} SELECT count(*) FILTER (cost IS NULL) AS unpriced_calls FROM priced",
    "unpriced_models": f"WITH {CALLS} SELECT model, count(*) AS calls FROM priced WHERE cost IS NULL GROUP BY model",
    "spend_counters": f"WITH {CALLS} SELECT model, feature, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS reasoning_tokens, CAST(coalesce(sum(cost), 0) AS DECIMAL(38,12)) AS cost FROM priced GROUP BY model, feature",
    "usage_sum": f"WITH {CALLS} SELECT CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS reasoning_tokens FROM calls",
    "spend_buffer_window": f"SELECT user_id, event_id, usd FROM ({_SIX}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20",
    "spend_buffer_dropped": "SELECT greatest(count(*) - 4000, 0) AS dropped FROM events",
    "budget_raise": f"""WITH s AS (SELECT user_id, event_id, ts, CAST(sum(usd) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,12)) AS spent_usd FROM ({_SIX})),
        p AS (SELECT *, coalesce(max(spent_usd) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 500 AS executed FROM s)
        SELECT user_id, event_id, spent_usd, executed, executed AND spent_usd > 500 AS tripped FROM p""",
    "budget_block": BLOCK_SQL,
    "budget_scopes": f"""WITH {CALLS}, x AS (SELECT '0' AS scope, * FROM priced UNION ALL SELECT '1/' || feature, * FROM priced UNION ALL SELECT '2/' || feature || '/' || user_id, * FROM priced)
        SELECT scope, count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, CAST(coalesce(sum(cost), 0) AS DECIMAL(38,12)) AS usd FROM x GROUP BY scope""",
    "stream_break": f"""WITH c AS (SELECT conv_id, turn, CAST(sum({QUARTER.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS counted FROM conversations),
        d AS (SELECT *, coalesce(lag(counted) OVER (PARTITION BY conv_id ORDER BY turn), 0) <= 300 AS delivered FROM c)
        SELECT conv_id, turn, counted, delivered, counted > 300 AND delivered AS broken FROM d""",
}
