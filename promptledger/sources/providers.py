"""Provider shapes to common columns: requests, usage, streamed usage, response texts, telemetry spans and run trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import count_quarter

OPENAI_LIKE = ("openai", "openai_responses", "openai_embeddings", "huggingface")
USAGE = ("input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens", "cache_write")


def _long(body: Column, *paths: str) -> Column:
    found = [F.get_json_object(body, p).cast("long") for p in paths]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def _usage(body: Column, provider: Column) -> Column:
    z = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    none = F.lit(0).cast("long")
    build = lambda i, o, c=none, r=none, w=none: F.when(i.isNotNull(), F.struct(i.alias("input_tokens"), z(o).alias("output_tokens"), z(c).alias("cached_tokens"), z(r).alias("reasoning_tokens"), z(w).alias("cache_write")))
    u, m = "$.usage.", "$.usage_metadata."
    thoughts = z(_long(body, m + "thoughts_token_count"))
    read = z(_long(body, u + "cache_read_input_tokens"))
    return (
        F.when(provider == "google", build(_long(body, m + "prompt_token_count"), z(_long(body, m + "candidates_token_count")) + thoughts, none, thoughts))
        .when(provider == "ollama", build(_long(body, "$.prompt_eval_count"), _long(body, "$.eval_count")))
        .when(provider.isin(*OPENAI_LIKE), build(
            _long(body, u + "prompt_tokens", u + "input_tokens"), _long(body, u + "completion_tokens", u + "output_tokens"),
            _long(body, u + "prompt_tokens_details.cached_tokens", u + "input_tokens_details.cached_tokens"),
            _long(body, u + "completion_tokens_details.reasoning_tokens", u + "output_tokens_details.reasoning_tokens")))
        .when(provider == "bedrock", build(_long(body, u + "inputTokens"), _long(body, u + "outputTokens")))
        .otherwise(build(_long(body, u + "input_tokens") + read, _long(body, u + "output_tokens"), read, none, _long(body, u + "cache_creation_input_tokens"))))


def with_usage(calls: DataFrame, response: str = "response", provider: str = "provider") -> DataFrame:
    """Adds the five counts; all null where a response states no input count. Cached tokens are a part of the input
    everywhere, reasoning tokens a part of the output."""
    out = calls.withColumn("_u", _usage(F.col(response), F.col(provider)))
    for k in USAGE:
        out = out.withColumn(k, F.col(f"_u.{k}"))
    return out.drop("_u")


def stream_usage(chunks: DataFrame, call: str, order: str, chunk: str = "chunk", provider: str = "provider") -> DataFrame:
    """Chunks (call, order, provider, chunk as JSON) -> a row per call with its usage. Running totals count at the last
    chunk (google), split ones are put together (anthropic), others count where they first appear."""
    c = F.col(chunk)
    body = F.when(F.col(provider) == "openai_responses", F.get_json_object(c, "$.response")).when(F.col(provider) == "bedrock", F.get_json_object(c, "$.metadata")).otherwise(c)
    rows = chunks.withColumn("_u", F.when(F.col(provider) != "anthropic", _usage(body, F.col(provider))))
    start, delta = F.get_json_object(c, "$.type") == "message_start", F.get_json_object(c, "$.type") == "message_delta"
    rows = rows.withColumn("_in", F.when(start, F.get_json_object(c, "$.message"))).withColumn("_out", F.when(delta, _long(c, "$.usage.output_tokens")))
    has = F.col("_u").isNotNull()
    agg = rows.groupBy(call, provider).agg(
        F.min_by("_u", F.when(has, F.col(order))).alias("first"), F.max_by("_u", F.when(has, F.col(order))).alias("last"),
        F.max_by("_in", F.when(F.col("_in").isNotNull(), F.col(order))).alias("_in"), F.max_by("_out", F.when(F.col("_out").isNotNull(), F.col(order))).alias("_out"))
    joined = _usage(F.col("_in"), F.lit("anthropic"))
    split = F.when(joined.isNotNull(), joined.withField("output_tokens", F.coalesce("_out", F.lit(0).cast("long"))))
    u = F.when(F.col(provider) == "google", F.col("last")).when(F.col(provider) == "anthropic", split).otherwise(F.col("first"))
    out = agg.withColumn("_u", u)
    return out.select(call, provider, *[F.col(f"_u.{k}").alias(k) for k in USAGE])


def chunk_text(c: Column) -> Column:
    """Visible text of a streamed chunk, in any provider's shape."""
    paths = ("$.choices[0].delta.content", "$.delta.text", "$.contentBlockDelta.delta.text", "$.candidates[0].content.parts[0].text", "$.message.content", "$.text")
    return F.coalesce(*[F.get_json_object(c, p) for p in paths], F.when(F.get_json_object(c, "$.type") == "response.output_text.delta", F.get_json_object(c, "$.delta")), F.lit(""))


def chunk_thinking(c: Column) -> Column:
    paths = ("$.choices[0].delta.reasoning_content", "$.choices[0].delta.reasoning", "$.delta.thinking", "$.contentBlockDelta.delta.reasoningContent.text", "$.message.thinking")
    return F.coalesce(*[F.get_json_object(c, p) for p in paths], F.lit(""))


def estimate_stream_usage(chunks: DataFrame, call: str, order: str, chunk: str = "chunk") -> DataFrame:
    """Output and reasoning tokens of streams that report none, from their text, marked as estimated. Texts are counted
    whole; a stream's chunks are joined in its one row."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), chunk_text(F.col(chunk)).alias("t"), chunk_thinking(F.col(chunk)).alias("k"))))
    rows = chunks.groupBy(call).agg(parts.alias("p"))
    text, thinking = F.array_join(F.col("p.t"), ""), F.array_join(F.col("p.k"), "")
    return rows.select(call, (count_quarter(text) + count_quarter(thinking)).alias("output_tokens"), count_quarter(thinking).alias("reasoning_tokens"), F.lit(True).alias("usage_estimated"))


def response_text(body: Column) -> Column:
    """The text of a whole response, in any provider's shape."""
    joined = [F.array_join(F.from_json(F.get_json_object(body, p), "array<struct<text:string>>")["text"], "") for p in ("$.content", "$.output.message.content", "$.candidates[0].content.parts")]
    output = F.from_json(F.get_json_object(body, "$.output"), "array<struct<content:array<struct<text:string>>>>")
    flat = F.array_join(F.flatten(F.transform(output, lambda o: F.coalesce(o["content"]["text"], F.array().cast("array<string>")))), "")
    plain = [F.get_json_object(body, p) for p in ("$.output_text", "$.choices[0].message.content", "$.choices[0].text", "$.message.content", "$.text")]
    return F.coalesce(*plain, *[F.nullif(x, F.lit("")) for x in (*joined, flat)], F.lit(""))


def normalize_request(calls: DataFrame, request: str = "request", provider: str = "provider") -> DataFrame:
    """Adds model and messages (array of role, text; parts of one message joined, its images counted) from a raw request."""
    r, p = F.col(request), F.col(provider)
    model = F.coalesce(F.get_json_object(r, "$.model"), F.get_json_object(r, "$.modelId"), F.lit(""))
    field = F.when(p.isin("openai_responses", "openai_embeddings"), F.coalesce(F.get_json_object(r, "$.input"), F.get_json_object(r, "$.messages"))).when(p == "google", F.get_json_object(r, "$.contents")).otherwise(F.get_json_object(r, "$.messages"))
    raw = F.from_json(field, "array<string>")
    part = lambda j: F.from_json(j, "array<struct<type:string,text:string>>")

    def message(m):
        content = F.coalesce(F.get_json_object(m, "$.content"), F.get_json_object(m, "$.parts"))
        parts = part(content)
        text = F.when(content.startswith("[") & parts.isNotNull(), F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], F.lit(""))), "")).otherwise(F.coalesce(content, F.when(~m.startswith("{"), m), F.lit("")))
        images = F.when(content.startswith("["), F.size(F.filter(parts, lambda x: x["type"].isin("image", "image_url")))).otherwise(0)
        return F.struct(F.coalesce(F.get_json_object(m, "$.role"), F.lit("user")).alias("role"), text.alias("text"), F.coalesce(images, F.lit(0)).alias("n_images"))

    single = F.array(F.struct(F.lit("user").alias("role"), field.alias("text"), F.lit(0).alias("n_images")))
    messages = F.when(field.isNull(), F.array().cast("array<struct<role:string,text:string,n_images:int>>")).when(field.startswith("["), F.transform(raw, message)).otherwise(single)
    return calls.withColumn("model", model).withColumn("messages", messages)


#: Attributes of generative-AI spans and their older names.
SPAN = {
    "model": ("gen_ai.request.model", "gen_ai.response.model"), "provider": ("gen_ai.system",), "input_tokens": ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens"),
    "output_tokens": ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens"), "cached_tokens": ("gen_ai.usage.cached_tokens", "gen_ai.usage.cache_read_input_tokens"), "reasoning_tokens": ("gen_ai.usage.reasoning_tokens",),
}


def ingest_spans(spans: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Span attributes (a map of strings) as calls. No input count, no usage."""
    out = spans
    for name, keys in SPAN.items():
        v = F.coalesce(*[F.col(attributes)[k] for k in keys])
        out = out.withColumn(name, v.try_cast("long") if name.endswith("tokens") else F.coalesce(v, F.lit("")))
    for name in ("output_tokens", "cached_tokens", "reasoning_tokens"):
        out = out.withColumn(name, F.when(F.col("input_tokens").isNotNull(), F.coalesce(name, F.lit(0).cast("long"))))
    return out.withColumn("source", F.lit("otel"))


def callback_usage(rows: DataFrame, metadata: str = "usage_metadata") -> DataFrame:
    """Usage metadata of framework callbacks (JSON)."""
    m = F.col(metadata)
    paths = {"input_tokens": "$.input_tokens", "output_tokens": "$.output_tokens", "cached_tokens": "$.input_token_details.cache_read", "reasoning_tokens": "$.output_token_details.reasoning", "cache_write": "$.input_token_details.cache_creation"}
    return rows.select("*", *[F.coalesce(_long(m, p), F.lit(0).cast("long")).alias(k) for k, p in paths.items()])


def run_roots(runs: DataFrame, run: str = "run_id", parent: str = "parent_run_id", agent: str = "agent") -> DataFrame:
    """(run, root, agent): the root of each run's chain of parents and the nearest agent on the way to it.

    Pointers double: each pass joins what a run points at with what that points at, so paths of any length take a
    logarithm of passes. A parent that is not in the table counts as the root."""
    at = runs.select(F.col(run).alias("r"), F.coalesce(parent, run).alias("up"), F.col(agent).alias("a"))
    spark = runs.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        raise ValueError("run_roots cuts lineage by checkpoints: set spark.checkpoint.dir")
    for _ in range(40):
        above = at.select(F.col("r").alias("k"), F.col("up").alias("u2"), F.col("a").alias("a2"))
        step = at.join(above, at["up"] == above["k"], "left")
        after = step.select("r", F.coalesce("u2", "up").alias("up"), F.coalesce("a", "a2").alias("a"), (F.coalesce("u2", "up") != F.col("up")).alias("moved")).checkpoint()
        at = after.drop("moved")
        if not after.filter("moved").limit(1).count():
            break
    return at.select(F.col("r").alias(run), F.col("up").alias("root"), F.col("a").alias(agent))


def agent_columns(rows: DataFrame, bedrock_agent: str | None = None, bedrock_alias: str | None = None) -> DataFrame:
    """Agent identity as columns; an agent with an alias is named by both."""
    if bedrock_agent:
        rows = rows.withColumn("agent_id", F.concat_ws("/", bedrock_agent, bedrock_alias) if bedrock_alias else F.col(bedrock_agent))
    return rows


def merge_maps(first: Column, then: Column) -> Column:
    """Two maps as one; where both have a key the second one's value stands. Null counts as empty."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    a, b = F.coalesce(first, empty), F.coalesce(then, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def enrich(rows: DataFrame, metadata: str, *ambient: Column) -> DataFrame:
    """Ambient attributes in order, none over what is there already."""
    out = F.col(metadata)
    for a in ambient:
        out = merge_maps(a, out)
    return rows.withColumn(metadata, out)
