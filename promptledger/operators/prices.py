"""Prices: ids, rates, exact decimal estimates, reasons why a model cannot be priced, overlays and provenance."""

from __future__ import annotations

from functools import reduce

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import MONEY, RATE

RATES = ("input", "output", "cached", "cache_write")
SCHEMA = "model string, input decimal(18,12), output decimal(18,12), cached decimal(18,12), cache_write decimal(18,12), src string, asof date, registered boolean"

#: Rates per token in USD.
SNAPSHOT = [
    ("gpt-4o", "0.0000025", "0.00001", "0.00000125", None),
    ("claude-opus-4-8", "0.000005", "0.000025", "0.0000005", "0.00000625"),
    ("gemini-2.0-flash", "0.0000001", "0.0000004", None, None),
    ("text-embedding-3-small", "0.00000002", "0", None, None),
    ("o1", "0.000015", "0.00006", None, None),
]


def snapshot(spark: SparkSession, asof: str | None = None) -> DataFrame:
    """The built-in rates as a literal relation: known while planning, so joins with it need no job of their own."""
    rate = lambda x: f"CAST({'NULL' if x is None else x} AS DECIMAL(18,12))"
    rows = ", ".join(f"('{m}', {', '.join(map(rate, r))}, 'snapshot', CAST(NULL AS DATE), false)" for m, *r in SNAPSHOT)
    df = spark.sql(f"SELECT * FROM VALUES {rows} AS t(model, input, output, cached, cache_write, src, asof, registered)")
    return df if asof is None else df.withColumn("asof", F.lit(asof).cast("date"))


def registration(spark: SparkSession, model: str, input=0, output=0, cached=None, cache_write=None, per: int = 1) -> DataFrame:
    """A rate row stated by the user, per token or per ``per`` (1000, 1000000). Negative rates are refused."""
    if per not in (1, 1000, 1_000_000):
        raise ValueError("per is 1, 1000 or 1000000")
    rates = [None if x is None else Decimal(str(x)) / per for x in (input, output, cached, cache_write)]
    if any(r is not None and r < 0 for r in rates):
        raise ValueError(f"a rate of {model} is negative")
    return spark.createDataFrame([(model, *rates, "registered", None, True)], SCHEMA)


def deployment(prices: DataFrame, name: str, like: str) -> DataFrame:
    """A copy of ``like``'s rates under another name; later changes of ``like`` do not reach it."""
    rows = prices.filter(F.col("model") == like)
    return rows.withColumn("model", F.lit(name)).withColumn("registered", F.lit(True)).withColumn("src", F.lit("registered"))


def overlay(*tables: DataFrame) -> DataFrame:
    """Tables in rising precedence, then registrations above all: one row per model."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("_rank", F.when(F.col("registered"), 1_000_000).otherwise(0) + i)
        out = t if out is None else out.unionByName(t)
    first = F.row_number().over(W.partitionBy("model").orderBy(F.col("_rank").desc()))
    return out.withColumn("_n", first).filter("_n = 1").drop("_rank", "_n")


def normalize_id(model: Column) -> Column:
    """Without what stands before the first slash, trimmed, in lower case."""
    m = F.trim(model)
    return F.lower(F.when(F.instr(m, "/") > 0, F.substring(m, F.instr(m, "/") + 1, F.length(m))).otherwise(m))


def lookup_id(model: Column) -> Column:
    """A wire id reduced to a table's: provider prefixes, then a version, then a date, taken off in that order."""
    out = normalize_id(model)
    for pattern in (r"^(?:[a-z]+\.)+", r"-v[0-9]+(?::[0-9]+)?$", r"-(?:[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$"):
        out = F.regexp_replace(out, pattern, "")
    return out


def with_rates(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Each call with its rates and how they were found: exact, normalized or none. The rate table holds a row per
    model in the market; Spark broadcasts it while that is small and joins by shuffle beyond."""
    keys = ("resolved", "registered", *RATES)
    by_id = prices.select(F.col("model").alias("_m"), F.struct(F.col("model").alias("resolved"), "registered", *RATES).alias("_exact"))
    by_key = prices.select(F.col("model").alias("_k"), F.struct(F.col("model").alias("resolved"), "registered", *RATES).alias("_near"))
    joined = calls.withColumn("_key", lookup_id(F.col("model"))).join(by_id, F.col("model") == F.col("_m"), "left").join(by_key, F.col("_key") == F.col("_k"), "left")
    found = F.coalesce("_exact", "_near")
    how = F.when(F.col("_exact").isNotNull(), F.when(F.col("_exact.registered"), "registered").otherwise("exact")).when(F.col("_near").isNotNull(), "normalized").otherwise("unpriced")
    out = joined.withColumn("_r", found).withColumn("how", how)
    for k in keys:
        out = out.withColumn(k if k in ("resolved", "registered") else f"rate_{k}", F.col(f"_r.{k}"))
    return out.drop("_key", "_m", "_k", "_exact", "_near", "_r")


def price_status() -> Column:
    """Why rates can or cannot price: unknown is not free."""
    negative = None
    for k in RATES:
        c = F.coalesce(F.col(f"rate_{k}") < 0, F.lit(False))
        negative = c if negative is None else negative | c
    return (
        F.when(F.col("how") == "unpriced", "unknown_model").when(F.col("rate_input").isNull(), "missing_input").when(negative, "negative_rate")
        .when((F.col("rate_input") == 0) & ~F.coalesce("registered", F.lit(False)), "zero_input").when(F.col("rate_output").isNull(), "missing_output").otherwise("priced")
    )


def _n(column: Column | str) -> Column:
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(0)).cast("decimal(10,0)")


def estimate() -> Column:
    """Exact cost of input, output, cached (a part of input, clamped to it) and cache-write tokens; null if unpriced."""
    n = F.coalesce(F.col("input_tokens"), F.lit(0))
    cached = F.least(F.greatest(F.coalesce(F.col("cached_tokens"), F.lit(0)), F.lit(0)), n)
    write = F.coalesce(F.col("rate_cache_write").cast("decimal(20,14)"), (F.col("rate_input") * F.lit(Decimal("1.25"))).cast("decimal(20,14)"))
    parts = [
        (F.col("rate_input") * _n(n - cached)).cast(MONEY), (F.col("rate_output") * _n("output_tokens")).cast(MONEY),
        (F.coalesce("rate_cached", "rate_input") * _n(cached)).cast(MONEY), (write * _n(F.greatest(F.coalesce(F.col("cache_write_tokens"), F.lit(0)), F.lit(0)))).cast(MONEY),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.when(F.col("price_status") == "priced", total.cast(MONEY))


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds how, resolved, rates, price_status and cost to calls (model, input_tokens, output_tokens, and where they
    have them cached_tokens, cache_write_tokens)."""
    for c in ("cached_tokens", "cache_write_tokens"):
        if c not in calls.columns:
            calls = calls.withColumn(c, F.lit(0).cast("long"))
    return with_rates(calls, prices).withColumn("price_status", price_status()).withColumn("cost", estimate())


def reported_cost(body: Column) -> Column:
    """The first cost that a response states and that is a number of zero or more."""
    out = None
    for path in ("$.usage.cost", "$.usage.total_cost", "$.cost", "$.total_cost"):
        v = F.get_json_object(body, path).try_cast(MONEY)
        v = F.when(v >= 0, v)
        out = v if out is None else F.coalesce(out, v)
    return out


def settle_cost(calls: DataFrame, response: str = "response") -> DataFrame:
    """A reported cost first, else the estimate, else null: cost and cost_source."""
    own = reported_cost(F.col(response))
    source = F.when(own.isNotNull(), "reported").when(F.col("cost").isNotNull(), "estimated")
    return calls.withColumn("cost_source", source).withColumn("cost", F.coalesce(own, F.col("cost")))


def explain(models: DataFrame, prices: DataFrame, today: str) -> DataFrame:
    """How each model would be priced: resolved id, how, rates, status, age in days of its table."""
    asof = prices.select(F.col("model").alias("resolved"), "src", "asof")
    found = with_rates(models, prices).withColumn("price_status", price_status()).join(asof, "resolved", "left")
    return found.withColumn("age_days", age_days(F.col("asof"), today)).withColumn("stale", is_stale(F.col("age_days")))


def age_days(asof: Column, today: str) -> Column:
    return F.datediff(F.lit(today).cast("date"), asof)


def is_stale(age: Column, most: int = 30) -> Column:
    """An undated table is never stale."""
    return F.coalesce(age > most, F.lit(False))


def drop_unpriceable(prices: DataFrame) -> DataFrame:
    return prices.filter("input > 0 and output is not null")


def curate(prices: DataFrame, include: list[str], exclude: list[str], always: list[str]) -> DataFrame:
    """Models that match ``always``, or match ``include`` and not ``exclude``."""
    any_of = lambda xs: F.col("model").rlike("|".join(f"(?:{x})" for x in xs)) if xs else F.lit(False)
    return prices.filter(any_of(always) | (any_of(include) & ~any_of(exclude)))


def save(prices: DataFrame, path: str) -> None:
    """JSON lines with rates as plain decimal strings."""
    plain = [F.col(k).cast("string").alias(k) for k in RATES]
    prices.select("model", *plain, "src", "asof", "registered").write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """What ``save`` wrote, or any such file: rates read as strings, then exact. Rows that cannot price, or in which a rate is below
    zero or no number, are dropped; what was registered by hand may be free."""
    raw = spark.read.schema("model string, input string, output string, cached string, cache_write string, src string, asof date, registered boolean").json(path)
    own = F.coalesce("registered", F.lit(False))
    bad = [(F.col(k).isNotNull() & F.col(k).try_cast(RATE).isNull()) | F.coalesce(F.col(k).try_cast(RATE) < 0, F.lit(False)) for k in RATES]
    kept = raw.filter(~reduce(lambda a, b: a | b, bad))
    rates = kept.select("model", *[F.col(k).try_cast(RATE).alias(k) for k in RATES], "src", "asof", own.alias("registered"))
    return rates.filter("output is not null and (input > 0 or (registered and input = 0))")
