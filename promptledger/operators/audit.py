"""Audit trails: payloads from event tables, hash chains, verification, evidence and controls.

A chain is sequential by nature: each entry's hash holds the one before. Chains are many and independent, so they are
built in parallel by chain and streamed in order inside it; verification needs only each entry's neighbour and is a
window over entries that are hashed in place.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import GENESIS, canonical, canonical_json, chain_hash, meta_signature, sign
from .fold import ordered_fold

ENTRY = [T.StructField("seq", T.LongType()), T.StructField("ts", T.StringType()), T.StructField("type", T.StringType()), T.StructField("payload", T.StringType()),
         T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("sig", T.StringType())]


def quote(text: Column) -> Column:
    """A JSON string as the canonical encoder writes it."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    whole = reduce(lambda t, k: F.replace(t, F.lit(chr(k)), F.lit(json.dumps(chr(k))[1:-1])), range(32), plain)
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), whole).otherwise(plain), F.lit('"'))


def body(seq: Column, ts: Column, kind: Column, payload: Column) -> Column:
    """The canonical text of an entry around its canonical payload: keys in order of name."""
    return F.concat(F.lit('{"payload":'), payload, F.lit(',"seq":'), seq.cast("string"), F.lit(',"ts":'), quote(ts), F.lit(',"type":'), quote(kind), F.lit("}"))


def union_events(**tables: DataFrame) -> DataFrame:
    """Event tables by type -> (chain_id, ts, id, type, payload): each row's other columns become its payload, null ones
    left out, in canonical JSON."""
    out = []
    for kind, df in tables.items():
        rest = sorted(c for c in df.columns if c not in ("chain_id", "ts", "id"))
        out.append(df.select("chain_id", F.col("ts").cast("string").alias("ts"), F.col("id").cast("string").alias("id"), F.lit(kind).alias("type"), canonical_json(F.to_json(F.struct(*rest))).alias("payload")))
    return reduce(DataFrame.unionByName, out)


def build_chain(events: DataFrame, key: str | None = None) -> DataFrame:
    """(chain_id, ts, id, type, payload) -> entries with seq, prev_hash, hash and, with a key, signatures."""
    schema = T.StructType([T.StructField("chain_id", dict((f.name, f.dataType) for f in events.schema.fields)["chain_id"]), *ENTRY])

    def step(state, r):
        chain, seq, prev = state
        h = chain_hash(prev, r["body_head"] + str(seq) + r["body_tail"])
        return (chain, seq + 1, h), [(chain, seq, r["ts"], r["type"], r["payload"], prev, h, sign(key, h) if key else "")]

    parts = events.withColumn("body_head", F.concat(F.lit('{"payload":'), "payload", F.lit(',"seq":'))).withColumn("body_tail", F.concat(F.lit(',"ts":'), quote(F.col("ts")), F.lit(',"type":'), quote(F.col("type")), F.lit("}")))
    return ordered_fold(parts, ["chain_id"], ["ts", "id"], ["ts", "type", "payload", "body_head", "body_tail"], lambda k: (k[0], 0, GENESIS), step, schema)


def checked(entries: DataFrame, key: str | None = None) -> DataFrame:
    """Each entry with what is wrong with it: a broken link, an edited content, a bad signature, or null."""
    before = F.lag("hash", 1, GENESIS).over(W.partitionBy("chain_id").orderBy("line_no"))
    own = F.sha2(F.concat(F.coalesce(before, F.lit(GENESIS)), body(F.col("seq"), F.col("ts"), F.col("type"), F.col("payload"))), 256)
    out = entries.withColumn("_before", before).withColumn("_own", own)
    bad = F.when(~F.col("prev_hash").eqNullSafe(F.col("_before")), "broken link").when(~F.col("hash").eqNullSafe(F.col("_own")), "tampered entry")
    if key is not None:
        @F.pandas_udf(T.StringType())
        def signature(hashes: pd.Series) -> pd.Series:
            return hashes.map(lambda h: sign(key, h or ""))

        bad = bad.when(~F.col("sig").eqNullSafe(signature(F.col("hash"))), "bad signature")
    return out.withColumn("problem", bad).drop("_before", "_own")


def verify(entries: DataFrame, key: str | None = None, expected: DataFrame | None = None) -> DataFrame:
    """A row per chain: ok, detail of its first problem, entries, head. entries: chain_id, line_no and an entry's columns.
    ``expected`` (chain_id, head_hash, n) tells completeness, without which a cut tail cannot be seen."""
    rows = checked(entries, key)
    first = F.min(F.when(F.col("problem").isNotNull(), F.struct("line_no", "problem", "seq")))
    out = rows.groupBy("chain_id").agg(first.alias("f"), F.count(F.lit(1)).alias("entries"), F.max_by("hash", "line_no").alias("head"))
    if expected is not None:
        out = out.join(expected.select("chain_id", "head_hash", "n"), "chain_id", "full").withColumn("entries", F.coalesce("entries", F.lit(0)))
    else:
        out = out.withColumn("head_hash", F.lit(None).cast("string")).withColumn("n", F.lit(None).cast("long"))
    detail = (
        F.when(F.col("f").isNotNull(), F.concat("f.problem", F.lit(" at seq "), F.col("f.seq").cast("string")))
        .when(F.col("head_hash").isNotNull() & ~F.coalesce(F.col("head"), F.lit(GENESIS)).eqNullSafe(F.col("head_hash")), "incomplete log: head differs")
        .when(F.col("n").isNotNull() & (F.col("entries") != F.col("n")), "incomplete log: entries missing").otherwise("ok"))
    return out.withColumn("detail", detail).select("chain_id", (F.col("detail") == "ok").alias("ok"), "detail", "entries", "head")


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, dict | None]:
    """An audit file -> entries (chain_id: the path) and its header. Payloads become canonical again from the raw line; a
    line that is no JSON object fails the read."""
    lines = spark.read.option("lineSep", "\n").text(path).withColumn("line_no", F.monotonically_increasing_id()).filter("trim(value) <> ''")
    head = lines.filter(F.get_json_object("value", "$._meta").isNotNull()).orderBy("line_no").limit(1).collect()
    meta = json.loads(head[0]["value"])["_meta"] if head else None
    fields = T.StructType([*ENTRY[:3], *ENTRY[4:]])

    @F.pandas_udf(T.StringType())
    def payload(values: pd.Series) -> pd.Series:
        return values.map(lambda v: canonical(json.loads(v)["payload"]))

    rows = lines.filter(F.get_json_object("value", "$._meta").isNull())
    rows = rows.select("line_no", F.from_json("value", fields, {"mode": "FAILFAST"}).alias("e"), payload("value").alias("payload"))
    return rows.select(F.lit(path).alias("chain_id"), "line_no", "e.seq", "e.ts", "e.type", "payload", "e.prev_hash", "e.hash", F.coalesce("e.sig", F.lit("")).alias("sig")), meta


def verify_log(spark: SparkSession, path: str, key: str | None = None) -> tuple[bool, str]:
    """One file, its header included: with a key the header must be signed with it."""
    entries, meta = read_log(spark, path)
    expected = None
    if meta is not None:
        if key is not None and meta.get("sig") != meta_signature(key, meta):
            return False, "forged or unsigned header"
        expected = spark.createDataFrame([(path, meta.get("head_hash"), meta.get("entries"))], "chain_id string, head_hash string, n long")
    row = verify(entries, key, expected).first()
    return (True, "ok: 0 entries") if row is None else (row.ok, row.detail)


#: Which controls of a framework an entry type is evidence for. A template, not legal advice.
CONTROLS = {
    "eu_ai_act": {
        "audit_open": ["Art.12 record-keeping", "Art.19 automatically generated logs"], "decision": ["Art.12 record-keeping", "Art.13 transparency"],
        "decision_record": ["Art.12 record-keeping", "Art.13 transparency"], "decision_end": ["Art.12 record-keeping"],
        "llm_call": ["Art.12 logging", "Art.19 automatically generated logs", "Art.72 post-market monitoring"], "tool_call": ["Art.12 logging", "Art.19 automatically generated logs"],
        "context_assembly": ["Art.12 logging", "Art.13 transparency"], "human_oversight": ["Art.14 human oversight", "Art.26(5) deployer oversight"],
        "policy_flag": ["Art.10 data governance", "Art.12 record-keeping"], "budget_event": ["Art.12 record-keeping", "Art.72 post-market monitoring"], "compression": ["Art.12 record-keeping"],
    },
    "gdpr": {
        "audit_open": ["Art.30 records of processing", "Art.5(2) accountability"], "decision": ["Art.22 automated decision-making", "Art.5(2) accountability"],
        "decision_record": ["Art.22 automated decision-making"], "decision_end": ["Art.30 records of processing"], "llm_call": ["Art.30 records of processing"],
        "tool_call": ["Art.30 records of processing"], "context_assembly": ["Art.30 records of processing"], "human_oversight": ["Art.22(3) right to human intervention"],
        "budget_event": ["Art.30 records of processing"], "compression": ["Art.5(1)(c) data minimisation"],
        "policy_flag": ["Art.9 special-category data", "Art.5(1)(c) data minimisation", "Art.30 records of processing"],
    },
    "iso_42001": {
        "audit_open": ["A.6.2.8 event logs"], "decision": ["A.6.2.8 event logs", "A.5.2 AI system impact assessment"], "decision_record": ["A.6.2.8 event logs"], "decision_end": ["A.6.2.8 event logs"],
        "llm_call": ["A.6.2.8 event logs", "A.6.2.6 operation & monitoring", "Cl.9.1 monitoring & measurement"], "tool_call": ["A.6.2.8 event logs", "A.6.2.6 operation & monitoring"],
        "context_assembly": ["A.6.2.8 event logs", "A.6.2.6 operation & monitoring"], "human_oversight": ["A.9.2 responsible use", "A.9.4 intended use"],
        "policy_flag": ["A.7 data for AI systems", "A.6.2.8 event logs", "A.9.2 responsible use"], "budget_event": ["A.6.2.6 operation & monitoring", "A.6.2.8 event logs"], "compression": ["A.6.2.6 operation & monitoring"],
    },
    "nist_rmf": {
        "audit_open": ["GOVERN-1.1"], "decision": ["MAP-1.1", "MEASURE-2.1"], "decision_record": ["MEASURE-2.1"], "decision_end": ["MEASURE-2.1"], "llm_call": ["MEASURE-2.1"], "tool_call": ["MEASURE-2.1"],
        "context_assembly": ["MEASURE-2.1"], "human_oversight": ["MANAGE-2.1"], "policy_flag": ["MANAGE-2.1", "MEASURE-2.1"], "budget_event": ["MANAGE-2.1", "MEASURE-2.1"], "compression": ["MEASURE-2.1"],
    },
}
#: Further controls of a flag by the category or group that it names.
CATEGORY_CONTROLS = {
    "special_category": {"gdpr": ["Art.9 special-category data"], "eu_ai_act": ["Art.10(5) special categories for bias detection"]},
    "gov_id": {"gdpr": ["Art.87 processing of national identification numbers"]},
    "financial": {"gdpr": ["PCI-DSS 3.3/3.4 (payment-card data — cross-reference)"], "eu_ai_act": ["PCI-DSS 3.3/3.4 (payment-card data — cross-reference)"]},
    "pii": {"gdpr": ["Art.4(1) personal data", "Art.5(1)(c) data minimisation"]},
    "secret": {"gdpr": ["Art.32 security of processing"]},
    "credential": {"gdpr": ["Art.32 security of processing"]},
}


def frameworks() -> list[str]:
    return sorted(CONTROLS)


def controls(entries: DataFrame, framework: str) -> DataFrame:
    """Adds ``controls``: those of the type, and for flags those of the categories in payload.data and of their groups,
    each once, in that order. The maps are literals of the plan."""
    from ..functions.detect import BUILT_IN

    lit_map = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    none = F.array().cast("array<string>")
    by_type = F.coalesce(lit_map(CONTROLS[framework])[F.col("type")], none)
    extra = {k: v[framework] for k, v in CATEGORY_CONTROLS.items() if framework in v}
    full = dict(extra)
    for d in BUILT_IN:
        own = extra.get(d.category, []) if d.category != d.group else []
        full[d.category] = [*own, *[c for c in extra.get(d.group, []) if c not in own]]
    data = F.get_json_object("payload", "$.data")
    names = F.coalesce(F.from_json(data, "array<string>"), F.array(data))
    found = F.flatten(F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.coalesce(lit_map(full)[n], none))) if extra else none
    return entries.withColumn("controls", F.array_distinct(F.concat(by_type, F.when(F.col("type") == "policy_flag", F.coalesce(found, none)).otherwise(none))))


def summary(entries: DataFrame) -> DataFrame:
    """Per chain: entries by kind, and flags by action and severity."""
    kinds = {"decisions": "decision", "llm_calls": "llm_call", "tool_calls": "tool_call", "context_assemblies": "context_assembly", "human_oversight": "human_oversight", "policy_flags": "policy_flag"}
    flag = lambda path, v: F.count_if((F.col("type") == "policy_flag") & (F.get_json_object("payload", path) == v))
    return entries.groupBy("chain_id").agg(
        *[F.count_if(F.col("type") == t).alias(n) for n, t in kinds.items()], *[flag("$.action", a).alias(f"flags_{a}") for a in ("blocked", "redacted", "flagged")],
        *[flag("$.severity", s).alias(f"flags_{s}") for s in ("info", "warning", "critical")])


def controls_covered(entries: DataFrame, framework: str) -> DataFrame:
    return controls(entries, framework).select("chain_id", F.explode("controls").alias("control")).groupBy("chain_id", "control").agg(F.count(F.lit(1)).alias("entries"))


def export(entries: DataFrame, path: str, framework: str, system: str, risk_tier: str, key: str | None = None) -> None:
    """An evidence pack of one chain: a header, then the entries in order with their controls, as JSON lines."""
    spark = entries.sparkSession
    head = entries.agg(F.max_by("hash", "seq"), F.count(F.lit(1))).first()
    covered = sorted(r[0] for r in controls_covered(entries, framework).select("control").distinct().collect())  # a framework's controls
    meta = {"system": system, "risk_tier": risk_tier, "framework": framework, "controls_covered": covered, "head_hash": head[0] or GENESIS, "entries": head[1]}
    if key:
        meta["sig"] = meta_signature(key, meta)
    first = spark.createDataFrame([(-1, json.dumps({"_meta": meta}, ensure_ascii=False))], "seq long, value string")
    line = F.concat(
        F.lit('{"seq":'), F.col("seq").cast("string"), F.lit(',"ts":'), quote(F.col("ts")), F.lit(',"type":'), quote(F.col("type")), F.lit(',"payload":'), F.col("payload"),
        F.lit(',"prev_hash":'), quote(F.col("prev_hash")), F.lit(',"hash":'), quote(F.col("hash")), F.lit(',"sig":'), quote(F.col("sig")), F.lit(',"controls":'), F.to_json("controls"), F.lit("}"))
    rows = controls(entries, framework).select("seq", line.alias("value"))
    first.unionByName(rows).repartitionByRange(1, "seq").sortWithinPartitions("seq").select("value").write.mode("overwrite").text(path)
