"""Budgets over ordered call logs: what each policy would have done.

``raise`` and ``truncate`` let the call that crosses the cap run and stop after it: a running sum. ``block``,
``downgrade`` and ``clamp`` decide before a call, and what they refuse or change does not accrue as it stood: a fold.
``break`` cuts a stream where its running token count crosses what the budget leaves.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import MONEY
from .fold import ordered_fold

RESERVE = 256
MODES = ("raise", "truncate", "block", "downgrade", "clamp", "break")


class Budget:
    """A validated budget: caps, what happens beyond them, and reserves for output that is not known beforehand."""

    def __init__(self, usd=None, tokens: int | None = None, on_exceed: str = "raise", downgrade: dict | None = None, output_reserve: int = RESERVE, reasoning_reserve: int = 0, name: str = "budget"):
        if usd is None and tokens is None:
            raise ValueError("a budget needs a cap in usd or tokens")
        if on_exceed not in MODES:
            raise ValueError(f"on_exceed is one of {MODES}")
        if on_exceed == "downgrade" and (usd is None or not downgrade):
            raise ValueError("downgrade needs a usd cap and a map of models")
        if on_exceed == "clamp" and tokens is None:
            raise ValueError("clamp needs a cap in tokens")
        self.usd, self.tokens, self.on_exceed, self.downgrade = (None if usd is None else Decimal(str(usd))), tokens, on_exceed, downgrade or {}
        self.output_reserve, self.reasoning_reserve, self.name = output_reserve, reasoning_reserve, name


def stop_after(calls: DataFrame, scope: list[str], order: list[str], usd=None, tokens: int | None = None) -> DataFrame:
    """``raise``/``truncate``: each call with what was spent with it, whether it ran and whether it tripped the cap.
    Equal to the cap does not trip."""
    upto = W.partitionBy(*scope).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = calls.withColumn("spent_usd", F.sum(F.coalesce("cost", F.lit(0).cast(MONEY))).over(upto).cast(MONEY))
    out = out.withColumn("spent_tokens", F.sum(F.col("input_tokens") + F.col("output_tokens")).over(upto))
    over = F.lit(False)
    if usd is not None:
        over = over | (F.col("spent_usd") > F.lit(str(usd)).cast(MONEY))
    if tokens is not None:
        over = over | (F.col("spent_tokens") > tokens)
    before = W.partitionBy(*scope).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("_over", over)
    out = out.withColumn("executed", ~F.coalesce(F.max("_over").over(before), F.lit(False)))
    return out.withColumn("tripped", F.col("executed") & F.col("_over")).drop("_over")


def preflight(calls: DataFrame, scope: str, budget: Budget) -> DataFrame:
    """``block``, ``downgrade`` and ``clamp`` decided call by call.

    calls: scope, order_key, model, input_tokens, output_tokens, max_tokens (null if not asked), cost (null if
    unpriced), in_rate, out_rate; for ``downgrade`` also down_in, down_out: the cheaper model's rates. Result: scope,
    order_key, action (run, blocked, downgraded, clamped, unpriced), model, output_tokens, usd and tokens accrued, and
    what was spent with it.
    """
    mode, cap_usd, cap_tokens = budget.on_exceed, budget.usd, budget.tokens
    reserve, down = budget.output_reserve + budget.reasoning_reserve, dict(budget.downgrade)
    schema = T.StructType([
        T.StructField(scope, dict((f.name, f.dataType) for f in calls.schema.fields)[scope]), T.StructField("order_key", T.LongType()), T.StructField("action", T.StringType()), T.StructField("model", T.StringType()),
        T.StructField("output_tokens", T.LongType()), T.StructField("usd", MONEY), T.StructField("tokens", T.LongType()), T.StructField("spent_usd", MONEY), T.StructField("spent_tokens", T.LongType()),
    ])
    zero, places = Decimal(0), Decimal("0.000000000001")

    def start(key):
        return key[0], zero, 0

    def step(state, r):
        key, spent, used = state
        action, model, out = "run", r["model"], r["output_tokens"]
        asked = r["max_tokens"] if r["max_tokens"] is not None else reserve
        priced = r["in_rate"] is not None
        projected = r["in_rate"] * r["input_tokens"] + r["out_rate"] * asked if priced else None
        rates = (r["in_rate"], r["out_rate"])
        if mode == "block":
            if cap_tokens is not None and used + r["input_tokens"] + asked > cap_tokens:
                action = "blocked"
            elif cap_usd is not None and not priced:
                action = "unpriced"
            elif cap_usd is not None and spent + projected > cap_usd:
                action = "blocked"
        elif mode == "downgrade" and model in down:
            if not priced:
                action = "unpriced"
            elif spent + projected > cap_usd:
                action, model, rates = "downgraded", down[model], (r["down_in"], r["down_out"])
        elif mode == "clamp":
            left = cap_tokens - used - r["input_tokens"]
            if left <= 0:
                action = "blocked"
            elif r["max_tokens"] is None or r["max_tokens"] > left:
                action, out = "clamped", min(out, left)
        if action == "blocked":
            return state, [(key, r["order_key"], action, model, 0, zero, 0, spent, used)]
        usd = (rates[0] * r["input_tokens"] + rates[1] * out).quantize(places) if rates[0] is not None else zero
        spent, used = spent + usd, used + r["input_tokens"] + out
        return (key, spent, used), [(key, r["order_key"], action, model, out, usd, r["input_tokens"] + out, spent, used)]

    columns = ["order_key", "model", "input_tokens", "output_tokens", "max_tokens", "in_rate", "out_rate", "down_in", "down_out"]
    for c in ("down_in", "down_out"):
        if c not in calls.columns:
            calls = calls.withColumn(c, F.lit(None).cast("decimal(18,12)"))
    return ordered_fold(calls, [scope], ["order_key"], columns, start, step, schema)


def stream_break(chunks: DataFrame, stream: str, order: str, allowance: int, count) -> DataFrame:
    """Each chunk with the running count of its stream's output tokens, whether it was delivered, and whether the cut
    fell on it: where the count is first above ``allowance``. Tokens are counted chunk by chunk."""
    upto = W.partitionBy(stream).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = chunks.withColumn("counted", F.sum(count).over(upto))
    before = F.coalesce(F.lag("counted").over(W.partitionBy(stream).orderBy(order)), F.lit(0))
    return out.withColumn("delivered", before <= allowance).withColumn("broken", (F.col("counted") > allowance) & F.col("delivered"))


def output_allowance(cap_tokens, spent_tokens, cap_usd, spent_usd, input_tokens, in_rate, out_rate, reasoning_reserve=0):
    """Output tokens that the tighter of two caps leaves to a stream, as a Column; null where no cap can be enforced."""
    by_tokens = cap_tokens - spent_tokens - input_tokens
    left = cap_usd - spent_usd - in_rate * input_tokens.cast("decimal(10,0)")
    by_usd = F.when(out_rate > 0, F.when(left <= 0, 0).otherwise(F.floor(left / out_rate)))
    return F.least(by_tokens, by_usd.cast("long")) - reasoning_reserve


def explode_scopes(calls: DataFrame, scopes: list[list[str]]) -> DataFrame:
    """A row per call and budget scope (a list of tags, none for the whole log), for nested budgets."""
    scope = F.array(*[F.concat_ws("/", F.lit(str(i)), *[F.coalesce(F.col("tags")[t], F.lit("")) for t in s]) for i, s in enumerate(scopes)])
    return calls.withColumn("scope", F.explode(scope))


def events(decided: DataFrame, budget: Budget, scope: str) -> DataFrame:
    """Budget events of preflight decisions that are not plain runs; caps as decimal strings."""
    return decided.filter("action <> 'run'").select(
        F.col("action"), F.lit(budget.name).alias("name"), "model", F.col(scope).cast("string").alias("scope"), F.col("spent_usd").cast("string").alias("projected_usd"),
        F.lit(None if budget.usd is None else str(budget.usd)).alias("cap_usd"), F.col("spent_tokens").alias("projected_tokens"), F.lit(budget.tokens).cast("long").alias("cap_tokens"),
    )
