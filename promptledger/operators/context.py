"""Packing contexts into token budgets: history suffixes, prioritised blocks with eviction, and render orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compress import SHAPES, cut
from ..functions.tokens import PER_MESSAGE, PRIMING, count_text
from .fold import ordered_fold

#: Marks of a cut text.
MARKS = {"head": "\n…[truncated]", "tail": "[truncated]…\n"}
#: Render ranks of roles.
RANKS = {"system": 0, "history": 1, "tool": 1, "assistant": 2, "user": 3}


def history_suffix(turns: DataFrame, key: str, order: str, n_tokens, budget: int, reserve: int = 0) -> DataFrame:
    """The newest turns that fit: a running sum from the end. Costs are positive, so what fits is a suffix."""
    back = W.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    out = turns.withColumn("n_tokens", n_tokens).withColumn("used", F.sum(F.col("n_tokens") + PER_MESSAGE).over(back) + PRIMING)
    return out.withColumn("kept", F.col("used") <= max(0, budget - reserve))


def truncate(text: str, target: int, keep: str = "head", family: str = "openai") -> str:
    """At most ``target`` tokens of a text's head or tail, the mark included where there is room for it."""
    if target <= 0:
        return ""
    if count_text(text, family) <= target:
        return text
    room = target - count_text(MARKS[keep], family)
    size = room if room > 0 else target
    body = cut(text, size, family) if keep == "head" else cut(text[::-1], size, family)[::-1]
    if room <= 0:
        return body
    return body + MARKS[keep] if keep == "head" else MARKS[keep] + body


DECISIONS = [T.StructField("idx", T.LongType()), T.StructField("role", T.StringType()), T.StructField("action", T.StringType()), T.StructField("tokens_before", T.LongType()),
             T.StructField("tokens_after", T.LongType()), T.StructField("note", T.StringType()), T.StructField("content", T.StringType()), T.StructField("pin", T.BooleanType()),
             T.StructField("priority", T.LongType()), T.StructField("used", T.LongType()), T.StructField("error", T.StringType())]


def compressor(text: str, target: int) -> str:
    """The default: the text's own kind, found as the column functions find it."""
    import json

    s = text.strip()
    try:
        kind = "json" if s[:1] in ("{", "[") and json.loads(s) is not None else "prose"
    except ValueError:
        kind = "prose"
    return SHAPES[kind](text, target)[0]


def pack(blocks: DataFrame, key: str, budget: int, reserve: int = 0, family: str = "openai", summarizer: Callable[[str, int], str] | None = None,
         compress: Callable[[str, int], str] | None = compressor, custom: dict[str, Callable[[str, int], tuple[str | None, str]]] | None = None) -> DataFrame:
    """Admit blocks (key, idx, role, content, priority, pin, evict, keep) by pin, priority and place; what does not fit
    is evicted its way, and smaller blocks behind it may still fit. A pinned block that does not fit is an error of its
    context, in the ``error`` column; nothing fails. ``used`` is what is taken with the row."""
    fields = {f.name: f.dataType for f in blocks.schema.fields}
    schema = T.StructType([T.StructField(key, fields[key]), *DECISIONS])
    room = max(0, budget - reserve)
    count = lambda t: count_text(t, family)

    def evict(r, text, target):
        how, keep = r["evict"] or "drop_oldest", r["keep"] or "head"
        fitted = lambda t: t if count(t) <= target else truncate(t, target, keep, family)
        if how == "drop_oldest":
            return None, "dropped", "dropped whole"
        if how == "truncate":
            return truncate(text, target, keep, family), "truncated", ""
        if how == "summarize":
            return (fitted(summarizer(text, target)), "summarized", "") if summarizer else (truncate(text, target, keep, family), "truncated", "no summarizer; truncated")
        if how == "compress":
            return (fitted(compress(text, target)), "compressed", "") if compress else (truncate(text, target, keep, family), "truncated", "no compressor; truncated")
        if custom and how in custom:
            new, action = custom[how](text, target)
            return (None, "dropped", action or "") if new is None else (fitted(new), action or "evicted", "")
        return None, "dropped", f"unknown strategy {how!r}"

    def step(state, r):
        ctx, used, any_, error = state
        text = r["content"] or ""
        n, frame = count(text), PER_MESSAGE + (0 if any_ else PRIMING)
        row = lambda action, after, note, content: (ctx, r["idx"], r["role"], action, n, after, note, content, bool(r["pin"]), r["priority"] or 0, used, error)
        if error:
            return state, [row("dropped", 0, "context has an error", None)]
        if used + frame + n <= room:
            used += frame + n
            return (ctx, used, True, error), [row("kept", n, "", text)]
        left = room - used - frame
        if r["pin"]:
            error = f"pinned block exceeds budget: needs {frame + n}, {room - used} of {room} left"
            return (ctx, used, any_, error), [row("error", 0, "", None)]
        if left <= 0:
            return state, [row("dropped", 0, "no room (framing)", None)]
        new, action, note = evict(r, text, left)
        if new is None:
            return state, [row("dropped", 0, note, None)]
        after = count(new)
        used += frame + after
        return (ctx, used, True, error), [row(action, after, note, new)]

    order = [F.coalesce("pin", F.lit(False)).desc(), F.coalesce("priority", F.lit(0)).desc(), "idx"]
    return ordered_fold(blocks, [key], order, ["idx", "role", "content", "priority", "pin", "evict", "keep"], lambda k: (k[0], 0, False, None), step, schema)


def render_order(packed: DataFrame, key: str, mode: str = "default") -> DataFrame:
    """Adds ``place`` to blocks that were kept: by role (default), by pin and priority (cache), or with the strongest at
    both edges of the middle (attention)."""
    kept = packed.filter("content is not null")
    role_rank = F.coalesce(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[F.col("role")], F.lit(1))
    if mode == "default":
        order = [role_rank, F.col("idx")]
    elif mode == "cache":
        order = [F.col("pin").desc(), F.col("priority").desc(), F.col("idx")]
    elif mode == "attention":
        part = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 2).otherwise(1)
        kept = kept.withColumn("_part", part)
        by = F.when(F.col("_part") == 2, F.col("priority")).otherwise(-F.col("priority"))
        r = F.row_number().over(W.partitionBy(key, "_part").orderBy(by, "idx")) - 1
        n = F.count(F.lit(1)).over(W.partitionBy(key, "_part"))
        edge = F.when(r % 2 == 0, F.floor(r / 2)).otherwise(n - 1 - F.floor((r - 1) / 2))
        kept = kept.withColumn("_in", F.when(F.col("_part") == 1, edge).otherwise(r))
        order = [F.col("_part"), F.col("_in")]
    else:
        raise ValueError("mode is default, cache or attention")
    return kept.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).drop("_part", "_in")


def report(packed: DataFrame, key: str) -> DataFrame:
    """Per context: tokens used, blocks by action, error."""
    return packed.groupBy(key).agg(
        F.max("used").alias("used"), F.count_if(F.col("action") == "kept").alias("kept"), F.count_if(F.col("action").isin("truncated", "summarized", "compressed", "evicted")).alias("shrunk"),
        F.count_if(F.col("action").isin("dropped", "error")).alias("dropped"), F.max("error").alias("error"))


def for_provider(messages: DataFrame, key: str, provider: str, place: str = "place") -> DataFrame:
    """Messages (key, place, role, content) in a provider's shape: the system text apart, roles in its words."""
    ordered = F.array_sort(F.collect_list(F.struct(place, "role", "content")))
    rows = messages.groupBy(key).agg(ordered.alias("m"))
    system = F.array_join(F.transform(F.filter("m", lambda x: x["role"] == "system"), lambda x: x["content"]), "\n\n")
    rest = F.filter("m", lambda x: x["role"] != "system")
    if provider == "gemini":
        turned = F.transform(rest, lambda x: F.struct(F.when(x["role"] == "assistant", "model").otherwise("user").alias("role"), F.array(F.struct(x["content"].alias("text"))).alias("parts")))
    elif provider == "bedrock":
        turned = F.transform(rest, lambda x: F.struct(F.when(x["role"] == "assistant", "assistant").otherwise("user").alias("role"), F.array(F.struct(x["content"].alias("text"))).alias("content")))
    elif provider == "anthropic":
        turned = F.transform(rest, lambda x: F.struct(F.when(x["role"] == "assistant", "assistant").otherwise("user").alias("role"), x["content"].alias("content")))
    else:
        raise ValueError("provider is anthropic, gemini or bedrock")
    return rows.select(key, F.nullif(system, F.lit("")).alias("system"), turned.alias("messages"))
