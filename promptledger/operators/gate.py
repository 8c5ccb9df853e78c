"""The gate: rules in order over a table, and red-team reports.

The fold runs over the list of rules while the plan is built: each rule sees the text that the one before left, and rows
that a rule blocked are not judged further. There is no loop over rows.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.rules import Rule


def evaluate(df: DataFrame, rules: list[Rule], stage: str, text: str = "text") -> DataFrame:
    """Adds decisions (array of rule, action, detail), blocked, and the text as it leaves (of blocked rows, as it was
    when blocked). Null texts are judged as empty."""
    out = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_alive", F.lit(True))
    marks = []
    for i, r in enumerate(x for x in rules if stage in x.stages):
        v = r.check(F.col("_t"))
        out = out.withColumn(f"_v{i}", F.when(F.col("_alive") & v.trips, F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), v.detail.cast("string").alias("detail"))))
        if r.action == "block":
            out = out.withColumn("_alive", F.col("_alive") & F.col(f"_v{i}").isNull())
        elif r.action == "redact" and v.replacement is not None:
            out = out.withColumn("_t", F.when(F.col(f"_v{i}").isNotNull(), v.replacement).otherwise(F.col("_t")))
        marks.append(f"_v{i}")
    decisions = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<struct<rule:string,action:string,detail:string>>")
    return out.withColumn("decisions", decisions).withColumn("blocked", ~F.col("_alive")).withColumn(text, F.col("_t")).drop("_t", "_alive", *marks)


def decisions(evaluated: DataFrame, keys: list[str], stage: str) -> DataFrame:
    """One row per decision, in order."""
    return evaluated.select(*keys, F.posexplode("decisions").alias("ordinal", "d")).select(*keys, F.lit(stage).alias("stage"), "ordinal", "d.rule", "d.action", "d.detail")


def red_team(cases: DataFrame, rules: list[Rule], stage: str = "input") -> DataFrame:
    """Per category and in all (category null): cases, attacks, benign, caught, false positives and rates. Labels other
    than attack and benign count in the total only."""
    tripped = evaluate(cases.select("text", "label", "category"), rules, stage).select("label", "category", (F.size("decisions") > 0).alias("tripped"))
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = tripped.groupingSets([["category"], []], "category").agg(
        F.grouping_id().alias("whole"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == "attack").alias("attacks"), F.count_if(F.col("label") == "benign").alias("benign"),
        F.count_if((F.col("label") == "attack") & F.col("tripped")).alias("caught"), F.count_if((F.col("label") == "benign") & F.col("tripped")).alias("false_positives"))
    return out.withColumn("trip_rate", rate(F.col("caught"), F.col("attacks"))).withColumn("false_positive_rate", rate(F.col("false_positives"), F.col("benign")))


def load_corpus(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Cases (text, label, category, id) from JSON lines, a JSON array or CSV; a case without text fails the job."""
    kind = format or path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        raw = spark.read.option("multiLine", kind == "json").schema("text string, label string, category string, id string").json(path)
    for c in ("label", "category", "id"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    text = F.coalesce("text", F.raise_error(F.lit("a case has no text")))
    return raw.select(text.alias("text"), F.coalesce("label", F.lit("attack")).alias("label"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("id", F.lit("")).alias("id"))


DECLARABLE = {"keyword_deny": R.keyword_deny, "regex_rule": R.regex_rule, "url_allowlist": R.url_allowlist, "url_deny": R.url_deny, "length_bounds": R.length_bounds, "json_schema": R.json_schema}


def policy_hash(document: dict) -> str:
    return "sha256:" + hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def load_policy(document: str | dict) -> tuple[list[Rule], str, str]:
    """A declared policy {version, guardrails: [{rule, args, stage, action, name}]} -> rules, version, hash."""
    doc = json.loads(document) if isinstance(document, str) else document
    if not isinstance(doc, dict) or not isinstance(doc.get("guardrails"), list):
        raise ValueError("a policy is an object with a list of guardrails")
    out = []
    for i, g in enumerate(doc["guardrails"]):
        if g.get("rule") not in DECLARABLE:
            raise ValueError(f"guardrails[{i}]: unknown rule {g.get('rule')!r}")
        args = dict(g.get("args") or {})
        if "stage" in g:
            args["stages"] = (g["stage"],) if isinstance(g["stage"], str) else tuple(g["stage"])
        for k in ("action", "name"):
            if k in g:
                args[k] = g[k]
        out.append(DECLARABLE[g["rule"]](**args))
    return out, str(doc.get("version", "")), policy_hash(doc)
