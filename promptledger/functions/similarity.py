"""Similarity of vectors and of texts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), _dot(a, b) / norm).otherwise(F.lit(0.0))


def embedding_score(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), cosine(a, b))


#: Exemplars that a plan may hold as literals; more are refused.
MOST_EXEMPLARS = 2000


def _scored(vectors: DataFrame, exemplars: list[tuple[str, list[float]]], vector: str) -> DataFrame:
    """Adds ``closest`` and ``_top``: the exemplar of the highest cosine, the first of equals, and that cosine. Exemplars are what
    a person listed; their norms are taken once, while planning, and each row is scored in place without a join."""
    if len(exemplars) > MOST_EXEMPLARS:
        raise ValueError(f"more than {MOST_EXEMPLARS} exemplars: search them in an index instead")
    names = F.array(*[F.lit(n) for n, _ in exemplars]) if exemplars else F.array().cast("array<string>")
    norms = [sum(x * x for x in v) ** 0.5 for _, v in exemplars]
    own = F.sqrt(_dot(F.col(vector), F.col(vector)))
    out = vectors.withColumn("_norm", own)
    scores = [F.when((F.col("_norm") > 0) & (F.size(vector) == len(v)), _dot(F.col(vector), F.array(*[F.lit(float(x)) for x in v])) / (F.col("_norm") * n)).otherwise(F.lit(0.0)) if n > 0 else F.lit(0.0) for (_, v), n in zip(exemplars, norms, strict=True)]
    out = out.withColumn("_s", F.array(*scores) if scores else F.array().cast("array<double>"))
    out = out.withColumn("_top", F.coalesce(F.array_max("_s"), F.lit(0.0)))
    return out.withColumn("closest", F.get(names, (F.array_position("_s", F.col("_top")) - 1).cast("int"))).drop("_s", "_norm")


def _told(scored: DataFrame, **rules: Column) -> DataFrame:
    """Adds the rules' columns, which read the exact cosine, and ``score``, which shows it rounded."""
    return scored.withColumns(rules).withColumn("score", F.round("_top", 4)).drop("_top")


def nearest(vectors: DataFrame, exemplars: list[tuple[str, list[float]]], vector: str = "embedding") -> DataFrame:
    """Adds ``closest`` and ``score``: the exemplar of the highest cosine, the first of equals, and that cosine, rounded."""
    return _told(_scored(vectors, exemplars, vector))


def denied_topics(vectors: DataFrame, topics: list[tuple[str, list[float]]], threshold: float = 0.8, vector: str = "embedding") -> DataFrame:
    return _told(_scored(vectors, topics, vector), trips=F.col("_top") >= threshold)


custom_category = denied_topics


def groundedness(vectors: DataFrame, sources: list[tuple[str, list[float]]], threshold: float = 0.75, vector: str = "embedding") -> DataFrame:
    """Trips where no source is close enough; without sources everything passes."""
    return _told(_scored(vectors, sources, vector), trips=(F.col("_top") < threshold) & F.lit(bool(sources)))


def intent(vectors: DataFrame, exemplars: list[tuple[str, list[float]]], mode: str = "deny", threshold: float = 0.75, vector: str = "embedding") -> DataFrame:
    """``deny`` trips on an intent at or above the threshold, ``allow`` where none reaches it."""
    if mode not in ("deny", "allow"):
        raise ValueError("mode is deny or allow")
    hit = F.col("_top") >= threshold
    return _told(_scored(vectors, exemplars, vector), trips=hit if mode == "deny" else ~hit)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9']+"), F.lit(0))


def containment(actual: Column, expected: Column) -> Column:
    """Share of the expected text's distinct words that the actual one has; 1 where nothing is expected."""
    e = F.array_distinct(words(expected))
    return F.when(F.size(e) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(e, words(actual))) / F.size(e))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(actual: pd.Series, expected: pd.Series) -> pd.Series:
    """Matching-blocks ratio of texts normalised to their words; row by row, so meant for recorded pairs, not corpora."""
    return pd.Series([SequenceMatcher(None, a, e).ratio() for a, e in zip(actual, expected, strict=True)], dtype="float64")


def lexical_score(actual: Column, expected: Column) -> Column:
    a, e = F.array_join(words(actual), " "), F.array_join(words(expected), " ")
    return F.when(e == "", F.lit(1.0)).otherwise(F.greatest(sequence_ratio(a, e), containment(actual, expected)))


def semantic_match(actual: Column, expected: Column, threshold: float = 0.6, scorer=lexical_score) -> Column:
    return scorer(actual, expected) >= threshold
