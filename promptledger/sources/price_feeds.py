"""Price feeds of several shapes to one rate table: (model, input, output, cached, cache_write) per token.

Feeds are read as JSON text, numbers stay decimal strings until they are exact decimals, and precedence between listings
of one model is a window over the feed's own order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.prices import RATES, normalize_id

WIDE = "decimal(30,18)"

#: Providers whose listings count, best first.
PROVIDERS = ("openai", "anthropic", "google", "google-vertex", "xai", "deepseek", "mistral", "meta", "alibaba", "moonshotai", "cohere", "amazon-bedrock", "azure", "groq", "fireworks-ai", "huggingface")


def is_host_id(model: Column) -> Column:
    """Is this id a host's listing of a model, not the model's own name?"""
    m = F.lower(F.trim(model))
    return m.contains("/") | m.rlike(r"^(?:[a-z][a-z0-9_-]*\.)+[a-z]")


def _entries(raw: Column) -> Column:
    return F.from_json(raw, "map<string,string>")


def _rate(obj: Column, key: str) -> Column:
    return F.get_json_object(obj, "$." + key).try_cast(WIDE)


def _finish(rows: DataFrame, order: list[Column]) -> DataFrame:
    first = F.row_number().over(W.partitionBy("model").orderBy(*order))
    return rows.withColumn("_n", first).filter("_n = 1").select("model", *[F.col(k).cast("decimal(18,12)").alias(k) for k in RATES])


def litellm(raw: DataFrame, column: str = "value") -> DataFrame:
    """An object by id. The first bare id of a model stands; without one, its last host listing."""
    rows = raw.select(F.posexplode(F.map_entries(_entries(F.col(column)))).alias("pos", "e")).select("pos", F.col("e.key").alias("id"), F.col("e.value").alias("v")).filter("v like '{%'")
    rates = [_rate(F.col("v"), k).alias(n) for n, k in zip(RATES, ("input_cost_per_token", "output_cost_per_token", "cache_read_input_token_cost", "cache_creation_input_token_cost"), strict=True)]
    rows = rows.select("pos", normalize_id(F.col("id")).alias("model"), is_host_id(F.col("id")).alias("host"), *rates).filter("input > 0")
    return _finish(rows, [F.col("host"), F.when(F.col("host"), -F.col("pos")).otherwise(F.col("pos"))])


def _listed(raw: DataFrame, column: str, array: str) -> DataFrame:
    return raw.select(F.posexplode(F.from_json(F.get_json_object(F.col(column), array), "array<string>")).alias("pos", "v"))


def openrouter(raw: DataFrame, column: str = "value") -> DataFrame:
    """Listings with prompt and completion rates as strings; the last listing of a model stands."""
    v = F.col("v")
    read = _rate(v, "pricing.input_cache_read")
    rows = _listed(raw, column, "$.data").select(
        "pos", normalize_id(F.get_json_object(v, "$.id")).alias("model"), _rate(v, "pricing.prompt").alias("input"), _rate(v, "pricing.completion").alias("output"),
        F.when(read > 0, read).alias("cached"), F.lit(None).cast(WIDE).alias("cache_write")).filter("model <> '' and input is not null")
    return _finish(rows, [F.col("pos").desc()])


def vercel(raw: DataFrame, column: str = "value") -> DataFrame:
    """Language models of a gateway; only rates above zero count."""
    v = F.col("v")
    keys = ("input", "output", "input_cache_read", "input_cache_write")
    rates = [F.when(_rate(v, "pricing." + k) > 0, _rate(v, "pricing." + k)).alias(n) for n, k in zip(RATES, keys, strict=True)]
    rows = _listed(raw, column, "$.data").filter(F.get_json_object(v, "$.type") == "language").select("pos", normalize_id(F.get_json_object(v, "$.id")).alias("model"), *rates).filter("input is not null")
    return _finish(rows, [F.col("pos").desc()])


def modelsdev(raw: DataFrame, column: str = "value") -> DataFrame:
    """Providers of models, per million tokens. Of accepted providers the best ranked stands, and a model's own name
    stands before a host's listing."""
    ranks = F.create_map(*[x for i, p in enumerate(PROVIDERS) for x in (F.lit(p), F.lit(i))])
    rows = raw.select(F.explode(_entries(F.col(column))).alias("provider", "p")).withColumn("rank", ranks[F.col("provider")]).filter("rank is not null")
    rows = rows.select("rank", F.posexplode(F.map_entries(_entries(F.get_json_object("p", "$.models")))).alias("pos", "e"))
    v = F.col("e.value")
    rates = [(_rate(v, "cost." + k) / 1_000_000).cast(WIDE).alias(n) for n, k in zip(RATES, ("input", "output", "cache_read", "cache_write"), strict=True)]
    rows = rows.select("rank", "pos", normalize_id(F.col("e.key")).alias("model"), is_host_id(F.col("e.key")).alias("host"), *rates).filter("input > 0")
    return _finish(rows, [F.col("host"), F.col("rank"), F.col("pos").desc()])


#: Words of meter names.
DIRECTIONS = {"inp": "input", "inpt": "input", "input": "input", "in": "input", "outp": "output", "outpt": "output", "output": "output", "out": "output", "opt": "output"}
CACHE_READ, CACHE_WRITE = ("cd", "cchd", "ccchd", "cached", "cache"), ("wr",)
NOT_INFERENCE = (
    "batch", "ft", "finetuned", "training", "trng", "hosting", "pp", "ptu", "provisioned", "grader", "grdr", "img", "image", "aud", "audio", "rt", "realtime", "tts",
    "trscb", "tcrb", "transcribe", "ocr", "doc", "video", "speech", "shortco", "longco", "reservation", "embedding", "l")
TIERS = ("gl", "glbl", "global", "dz", "dzone", "datazone", "dzn", "regnl", "regional", "rgnl", "regn", "std", "zone", "data", "mn")
SKIPPED = ("Azure OpenAI Media", "Azure BFL Flux Models", "Managed Compute", "Azure AI Foundry Provisioned Throughput Reservation", "Azure OpenAI PP FT GPT4s", "Azure OpenAI Embedding")
ROOTS = {
    "Azure OpenAI GPT5": "gpt", "Azure Grok Models": "grok", "Azure Deepseek Models": "deepseek", "Azure Kimi": "kimi", "Azure Llama Models": "llama", "Azure Mistral Models": "mistral",
    "Qwen models": "qwen", "Azure Phi Models": "phi", "MAI Models": "mai", "Azure OpenAI OSS Models": "gpt-oss"}


def _cheapest(rows: DataFrame) -> DataFrame:
    """(model, key, rate) -> a row per model with the least rate of each kind; models without an input rate are left out."""
    out = rows.groupBy("model").agg(*[F.min(F.when(F.col("key") == k, F.col("rate"))).cast("decimal(18,12)").alias(k) for k in RATES])
    return out.filter("input is not null")


def azure(raw: DataFrame, column: str = "value") -> DataFrame:
    """Meters whose names tell model, direction and cache role in words; the cheapest of the tiers counts."""
    v = F.col("v")
    field = lambda k: F.get_json_object(v, "$." + k)
    rows = _listed(raw, column, "$.Items").select(
        field("productName").alias("product"), F.upper(F.trim(field("unitOfMeasure"))).alias("unit"), F.coalesce(field("type"), F.lit("Consumption")).alias("kind"),
        field("retailPrice").try_cast(WIDE).alias("price"), F.filter(F.split(F.lower(F.coalesce(field("skuName"), F.lit(""))), r"[\s\-_]+"), lambda w: w != "").alias("words"))
    rows = rows.filter(~F.coalesce(F.col("product").isin(*SKIPPED), F.lit(False)) & (F.col("kind") == "Consumption") & F.col("unit").isin("1K", "1M") & (F.col("price") > 0))
    rows = rows.filter(~F.exists("words", lambda w: w.isin(*NOT_INFERENCE)))
    names = F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv])
    turns = F.transform("words", lambda w: names[w])
    rows = rows.withColumn("_d", F.filter(turns, lambda d: d.isNotNull())).filter("size(_d) > 0").withColumn("direction", F.element_at("_d", -1))
    rows = rows.withColumn("cached", F.exists("words", lambda w: w.isin(*CACHE_READ))).withColumn("write", F.exists("words", lambda w: w.isin(*CACHE_WRITE)))
    key = F.when(F.col("cached") & (F.col("direction") == "input"), F.when(F.col("write"), "cache_write").otherwise("cached")).when(~F.col("write"), F.col("direction"))
    first = F.array_position(F.transform(turns, lambda d: d.isNotNull()), True)
    head = F.filter(F.slice("words", F.lit(1), (first - 1).cast("int")), lambda w: ~w.isin(*CACHE_READ, *CACHE_WRITE, *TIERS))
    name = F.regexp_replace(F.array_join(head, "-"), r"(?:(?:^|-)(?:\d{3,4}|\d{8}))+$", "")
    root = F.create_map(*[F.lit(x) for kv in ROOTS.items() for x in kv])[F.col("product")]
    rows = rows.withColumn("key", key).withColumn("name", name).withColumn("root", root).filter("key is not null and name <> ''")
    model = normalize_id(F.when(F.col("root").isNotNull() & ~F.col("name").startswith(F.col("root")), F.concat_ws("-", "root", "name")).otherwise(F.col("name")))
    return _cheapest(rows.select(model.alias("model"), "key", (F.col("price") / F.when(F.col("unit") == "1M", 1_000_000).otherwise(1000)).cast(WIDE).alias("rate")))


#: Marks of usage types that are not on demand, units and inference types.
NOT_ON_DEMAND = ("batch", "long-context", "reserved", "priority", "flex", "provisioned")
UNITS = {"1k tokens": 1000, "1k token": 1000, "1m tokens": 1_000_000, "1m token": 1_000_000}


def aws(raw: DataFrame, column: str = "value") -> DataFrame:
    """Offer files: products by sku, and on-demand terms whose dimensions state a price and its unit."""
    offers = raw.select(F.explode(F.from_json(F.get_json_object(F.col(column), "$.offers"), "array<string>")).alias("o"))
    products = offers.select("o", F.explode(_entries(F.get_json_object("o", "$.products"))).alias("sku", "p"))
    a = lambda k: F.get_json_object("p", "$.attributes." + k)
    rows = products.select("sku", F.trim(a("model")).alias("name"), F.lower(F.coalesce(a("usagetype"), F.lit(""))).alias("use"), F.lower(F.trim(F.coalesce(a("inferenceType"), F.lit("")))).alias("kind"), _entries(F.get_json_object("o", "$.terms.OnDemand")).alias("terms"))
    rows = rows.filter("name <> ''").filter(~F.col("use").rlike("|".join(NOT_ON_DEMAND)))
    by_use = F.when(F.col("use").contains("cache-read"), "cached").when(F.col("use").contains("cache-write"), "cache_write").when(F.col("use").contains("input-token"), "input").when(F.col("use").contains("output-token"), "output")
    by_kind = (
        F.when(F.col("kind") == "prompt cache read input tokens", "cached").when(F.col("kind") == "prompt cache write input tokens", "cache_write")
        .when(F.col("kind").isin("input tokens", "text input tokens", "text input token"), "input").when(F.col("kind").isin("output tokens", "text output tokens", "text output token"), "output"))
    rows = rows.withColumn("key", F.coalesce(by_use, by_kind)).filter("key is not null")
    rows = rows.select("name", "key", F.explode(_entries(F.element_at("terms", F.col("sku")))).alias("_t", "term"))
    rows = rows.select("name", "key", F.explode(_entries(F.get_json_object("term", "$.priceDimensions"))).alias("_d", "d"))
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])[F.lower(F.trim(F.get_json_object("d", "$.unit")))]
    lower = F.lower("name")
    model = F.when(~F.col("name").contains(" "), F.regexp_replace(lower, r"^(?:[a-z0-9]+\.)+", "")).otherwise(F.regexp_replace(F.regexp_replace(lower, r"(?<=\d)\.(?=\d)", "-"), r"[\s_]+", "-"))
    priced = rows.select(model.alias("model"), "key", (F.get_json_object("d", "$.pricePerUnit.USD").try_cast(WIDE) / unit).cast(WIDE).alias("rate")).filter("rate > 0")
    return _cheapest(priced)


FEEDS = {"litellm": litellm, "openrouter": openrouter, "modelsdev": modelsdev, "vercel": vercel, "azure": azure, "aws": aws}
