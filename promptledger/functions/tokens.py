"""Token counts as Column expressions: the heuristic tier, which needs no vocabulary files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIMING, PER_MESSAGE = 3, 4

#: Word runs, or one character that is neither word nor space; Unicode classes, alike in Java and RE2.
PIECES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

_COUNTERS: dict[str, Callable[[Column], Column]] = {}


def register(family_name: str, counter: Callable[[Column], Column] | None) -> None:
    """Count a family's texts by ``counter`` (a function from Column to Column, a vectorised UDF included); None resets."""
    if counter is None:
        _COUNTERS.pop(family_name, None)
    else:
        _COUNTERS[family_name] = counter


def base_model(model: Column) -> Column:
    """A fine-tune's id names its base in second place: ft:<base>:<organisation>:..."""
    return F.when(F.lower(model).startswith("ft:"), F.split_part(model, F.lit(":"), F.lit(2))).otherwise(model)


def family(model: Column) -> Column:
    m = F.lower(F.coalesce(base_model(model), F.lit("")))
    return (
        F.when(m.rlike(r"^(gpt|chatgpt|text-|davinci|o[0-9])"), "openai")
        .when(m.contains("claude"), "anthropic").when(m.contains("gemini"), "google").otherwise("default")
    )


def method(model: Column) -> Column:
    """How a model's tokens are counted here: registered or heuristic."""
    f = family(model)
    return F.when(f.isin(list(_COUNTERS)), "registered").otherwise("heuristic") if _COUNTERS else F.when(f.isNotNull(), "heuristic")


def is_exact(model: Column) -> Column:
    return method(model).isin("exact", "registered")


def count_quarter(text: Column) -> Column:
    """A token for each four characters begun."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(4.0)).cast("long")


def count_subword(text: Column) -> Column:
    """The mean of two estimates, by characters and by pieces; at least one for a text that is not empty."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.regexp_count(t, F.lit("(?U)" + PIECES))
    estimate = F.ceil((F.length(t) / F.lit(3.5) + pieces * F.lit(1.2)) / F.lit(2.0)).cast("long")
    return F.when(F.length(t) == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), estimate))


def count(text: Column, model: Column) -> Column:
    f = family(model)
    out = F.when(f == "openai", count_quarter(text)).otherwise(count_subword(text))
    for name, counter in _COUNTERS.items():
        out = F.when(f == name, counter(text).cast("long")).otherwise(out)
    return out


def count_messages(messages: Column, model: Column) -> Column:
    """messages: array of structs with ``text`` (parts of one message joined). Null or empty: no tokens but priming."""
    each = F.transform(F.coalesce(messages, F.array().cast("array<struct<role:string,text:string>>")), lambda m: F.lit(PER_MESSAGE) + count(m["text"], model))
    return F.aggregate(each, F.lit(PRIMING).cast("long"), lambda a, x: a + x)


def truncate_quarter(text: Column, target: Column | int) -> Column:
    """The longest head of at most ``target`` tokens of four characters."""
    n = F.lit(target) if isinstance(target, int) else target
    return F.when(n <= 0, F.lit("")).otherwise(F.substring(text, F.lit(1), (n * 4).cast("int")))


def count_text(text: str, family_name: str = "openai") -> int:
    """The same counts for one string, for operators that fold text in Python."""
    import math

    import regex

    if not text:
        return 0
    if family_name == "openai":
        return math.ceil(len(text) / 4.0)
    pieces = len(regex.findall(r"\w+|[^\w\s]", text))
    return max(1, math.ceil((len(text) / 3.5 + pieces * 1.2) / 2))
