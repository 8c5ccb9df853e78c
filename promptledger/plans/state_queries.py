"""Queries on similarity, compression, packing, replay and audit, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compress, hashing, similarity, tokens
from ..operators import audit, context, replay
from ..sources.tables import events, table


def _exemplars(spark, sf_dir):
    """The vector of the lowest id of each label: what a person would list."""
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).orderBy("label").collect()
    return [(str(r.label), list(r.v)) for r in rows]


def topic_match(spark, sf_dir):
    out = similarity.denied_topics(table(spark, sf_dir, "embeddings"), _exemplars(spark, sf_dir), 0.3)
    return out.select("vec_id", "closest", "score", "trips")


def groundedness(spark, sf_dir):
    return similarity.groundedness(table(spark, sf_dir, "embeddings"), _exemplars(spark, sf_dir), 0.3).select("vec_id", "trips")


def intent_nearest(spark, sf_dir):
    out = similarity.intent(table(spark, sf_dir, "embeddings"), _exemplars(spark, sf_dir), "allow", 0.3)
    return out.groupBy("closest").agg(F.count_if("trips").alias("tripped"), F.count(F.lit(1)).alias("n"))


def lexical_containment(spark, sf_dir):
    """Each conversation's answer against the question before it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return turns.filter("role = 'assistant'").join(asked, ["conv_id", "turn"]).select("conv_id", "turn", F.round(similarity.containment(F.col("text"), F.col("question")), 6).alias("containment"))


def lexical_score(spark, sf_dir):
    """Each turn against the turn before it in its conversation, whatever their roles."""
    turns = table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", "role", F.round(similarity.lexical_score(F.col("text"), F.col("before")), 6).alias("score"))


def detect_kind(spark, sf_dir):
    return compress.detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "kind")


def log_dedup(spark, sf_dir):
    return compress.log_patterns(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.md5(F.col("pattern").cast("binary")).alias("pattern_md5"), "n", "first")


def log_compress(spark, sf_dir):
    out = compress.compress_logs(table(spark, sf_dir, "documents"), "doc_id")
    return out.select("doc_id", F.md5(F.col("small").cast("binary")).alias("small_md5"), "patterns")


def cas_store(spark, sf_dir):
    return compress.originals(table(spark, sf_dir, "documents")).select("key", F.length("value").alias("n"))


def cas_expand(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    handles = docs.select("doc_id", F.sha2("text", 256).alias("original_ref"))
    return compress.expand(handles, compress.originals(docs)).select("doc_id", F.md5(F.col("original").cast("binary")).alias("text_md5"))


def compress_documents(spark, sf_dir):
    return compress.compress(table(spark, sf_dir, "documents").select("doc_id", "text"), target=200).select("doc_id", "kind", "compressed.small", "compressed.technique", "compressed.handle_id")


def compression_events(spark, sf_dir):
    done = compress.compress(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return compress.compression_events(done).groupBy("kind", "technique").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"))


def compress_props(spark, sf_dir):
    """JSON payloads, minified."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("text"))
    return compress.compress(rows).filter("kind = 'json'").select("event_id", F.col("compressed.small").alias("small"))


def history_pack(spark, sf_dir):
    out = context.history_suffix(table(spark, sf_dir, "conversations"), "conv_id", "turn", tokens.count_quarter(F.col("text")), 500, 100)
    return out.select("conv_id", "turn", "used", "kept")


def _blocks(spark, sf_dir):
    priority = F.when(F.col("role") == "system", 9).when(F.col("role") == "user", 5).otherwise(F.col("turn") % 4)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("idx"), "role", F.col("text").alias("content"), priority.cast("long").alias("priority"), (F.col("role") == "system").alias("pin"),
        F.when(F.col("turn") % 3 == 0, "truncate").when(F.col("turn") % 3 == 1, "compress").otherwise("drop_oldest").alias("evict"), F.lit("head").alias("keep"))


def block_pack(spark, sf_dir):
    return context.pack(_blocks(spark, sf_dir), "conv_id", 600, 100).select("conv_id", "idx", "role", "action", "tokens_before", "tokens_after", "used")


def block_report(spark, sf_dir):
    return context.report(context.pack(_blocks(spark, sf_dir), "conv_id", 600, 100), "conv_id")


def _whole(spark, sf_dir):
    return _blocks(spark, sf_dir)


def order_default(spark, sf_dir):
    return context.render_order(_whole(spark, sf_dir), "conv_id").select("conv_id", "idx", "place")


def order_cache(spark, sf_dir):
    return context.render_order(_whole(spark, sf_dir), "conv_id", "cache").select("conv_id", "idx", "place")


def order_attention(spark, sf_dir):
    return context.render_order(_whole(spark, sf_dir), "conv_id", "attention").select("conv_id", "idx", "place")


def provider_messages(spark, sf_dir):
    rows = context.render_order(_blocks(spark, sf_dir), "conv_id")
    return context.for_provider(rows, "conv_id", "anthropic").select("conv_id", "system", F.size("messages").alias("n_messages"))


def _requests(spark, sf_dir, response=None):
    """``response`` is the text's digest if not given: what the SQL compares."""
    turns = table(spark, sf_dir, "conversations")
    response = F.md5(F.col("text").cast("binary")) if response is None else response
    return turns.select("conv_id", "turn", F.sha2(F.concat_ws("|", "role", F.length("text").cast("string")), 256).alias("request_hash"), response.alias("response"))


def request_hash_plain(spark, sf_dir):
    return _requests(spark, sf_dir).select("conv_id", "turn", "request_hash")


def request_hash(spark, sf_dir):
    request = F.to_json(F.struct(F.lit("llm").alias("kind"), F.lit("openai").alias("provider"), F.lit("gpt-4o").alias("model"), F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    rows = table(spark, sf_dir, "conversations").withColumn("request", request)
    return rows.select("conv_id", "turn", hashing.request_hash(F.col("request")).alias("request_hash"))


def _live(spark, sf_dir):
    """The requests of a run after the one recorded: a tenth of them ask differently, so those miss."""
    altered = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(10)) == 0
    return _requests(spark, sf_dir).withColumn("request_hash", F.when(altered, F.sha2(F.concat("request_hash", F.lit("|altered")), 256)).otherwise(F.col("request_hash")))


def replay_fifo(spark, sf_dir):
    out = replay.replay(_live(spark, sf_dir), _requests(spark, sf_dir), ["conv_id", "turn"], ["conv_id", "turn"])
    return out.select("conv_id", "turn", "ordinal", "replayed", "hit")


def drift(spark, sf_dir):
    return replay.drift(_live(spark, sf_dir), _requests(spark, sf_dir), ["conv_id", "turn"], ["conv_id", "turn"]).select("conv_id", "turn", "response", "replayed")


def semantic_drift(spark, sf_dir):
    """Whole texts against what is replayed for them. All conversations are recorded; the live run asks a tenth of the
    requests differently, so those miss, and equal requests behind them get the recording before their own."""
    recorded = _requests(spark, sf_dir, F.col("text"))
    altered = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) == 0
    live = recorded.withColumn("request_hash", F.when(altered, F.sha2(F.concat("request_hash", F.lit("|altered")), 256)).otherwise(F.col("request_hash")))
    found = replay.drift(live, recorded, ["conv_id", "turn"], ["conv_id", "turn"])
    return replay.semantic_drift(found).select("conv_id", "turn", F.round("score", 6).alias("score"))


def _chain_events(spark, sf_dir):
    """A chain per user; each event is an entry."""
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").alias("chain_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.format_string("%012d", "event_id").alias("id"), F.col("event_type").alias("type"), F.concat(F.lit('{"k":'), F.col("k").cast("string"), F.lit("}")).alias("payload"))


def chain_build(spark, sf_dir):
    return audit.build_chain(_chain_events(spark, sf_dir))


CHAIN_SQL = """
WITH RECURSIVE e AS (
  SELECT user_id AS chain_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type AS type, '{"k":' || json_extract_string(props, '$.k') || '}' AS payload,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
c AS (
  SELECT chain_id, seq, ts, type, payload, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '{"payload":' || payload || ',"seq":0,"ts":"' || ts || '","type":"' || type || '"}') AS hash FROM e WHERE seq = 0
  UNION ALL
  SELECT e.chain_id, e.seq, e.ts, e.type, e.payload, c.hash, sha256(c.hash || '{"payload":' || e.payload || ',"seq":' || e.seq || ',"ts":"' || e.ts || '","type":"' || e.type || '"}') FROM c JOIN e ON e.chain_id = c.chain_id AND e.seq = c.seq + 1)
"""


def chain_verify(spark, sf_dir):
    return audit.verify(chain_build(spark, sf_dir).withColumn("line_no", F.col("seq"))).select("chain_id", "ok", "detail", "entries", "head")


def chain_tamper(spark, sf_dir):
    """Three kinds of damage, by chain: an edited payload, a lost entry, a lost tail."""
    entries = chain_build(spark, sf_dir)
    expected = entries.groupBy("chain_id").agg(F.max_by("hash", "seq").alias("head_hash"), F.count(F.lit(1)).alias("n"))
    kind = F.col("chain_id") % 4
    last = expected.select("chain_id", F.col("n"))
    hurt = entries.join(last, "chain_id").filter(~((kind == 1) & (F.col("seq") == 3)) & ~((kind == 2) & (F.col("seq") == F.col("n") - 1))).drop("n")
    edited = F.when(F.col("payload") == '{"k":0}', F.lit('{"k":1}')).otherwise(F.lit('{"k":0}'))  # never what stood there
    hurt = hurt.withColumn("payload", F.when((kind == 0) & (F.col("seq") == 2), edited).otherwise(F.col("payload"))).withColumn("line_no", F.col("seq"))
    return audit.verify(hurt, expected=expected).select("chain_id", "ok", "detail")


def _entries(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for kv in (("click", "llm_call"), ("view", "decision"), ("purchase", "policy_flag"), ("signup", "human_oversight")) for x in kv])
    kind = F.coalesce(kinds[F.col("event_type")], F.lit("tool_call"))
    data = F.element_at(F.array(F.lit("email"), F.lit("credit_card"), F.lit("aws_key")), (F.col("event_id") % 3 + 1).cast("int"))
    payload = F.concat(F.lit('{"action":"flagged","data":["'), data, F.lit('"],"severity":"warning"}'))
    return events(spark, sf_dir).select((F.col("user_id") % 10).alias("chain_id"), kind.alias("type"), payload.alias("payload"))


def evidence_summary(spark, sf_dir):
    return audit.summary(_entries(spark, sf_dir))


def control_coverage(spark, sf_dir):
    return audit.controls_covered(_entries(spark, sf_dir), "gdpr")


def framework_controls(spark, sf_dir):
    rows = [(f, t, i, c) for f, types in audit.CONTROLS.items() for t, cs in types.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "framework string, type string, place int, control string")


QUERIES = {f.__name__: f for f in (
    topic_match, groundedness, intent_nearest, lexical_containment, lexical_score, detect_kind, log_dedup, log_compress, cas_store, cas_expand, compress_documents, compression_events, compress_props,
    history_pack, block_pack, block_report, order_default, order_cache, order_attention, provider_messages, request_hash_plain, request_hash, replay_fifo, drift, semantic_drift,
    chain_build, chain_verify, chain_tamper, evidence_summary, control_coverage, framework_controls)}

_EX = "ex AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label)"
_NEAR = f"""WITH {_EX}, n AS (SELECT vec_id, max(score) AS score, CAST(arg_max(label, (score, -label)) AS VARCHAR) AS closest FROM (
  SELECT e.vec_id, x.label, list_cosine_similarity(e.embedding::DOUBLE[], x.v::DOUBLE[]) AS score FROM embeddings e CROSS JOIN ex x) GROUP BY vec_id)"""
_LINES = r"""l AS (SELECT doc_id, unnest(CASE WHEN text = '' THEN [] WHEN a[-1] = '' THEN a[:-2] ELSE a END) AS line, unnest(range(CASE WHEN text = '' THEN 0 WHEN a[-1] = '' THEN len(a) - 1 ELSE len(a) END)) AS pos
  FROM (SELECT doc_id, text, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]') AS a FROM documents)),
p AS (SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b', '<ts>', 'g'),
  '\b[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\b', '<uuid>', 'g'), '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', '<ip>', 'g'), '\b0x[0-9a-fA-F]+\b|\b[0-9a-fA-F]{8,}\b', '<hex>', 'g'), '\b\d+\b', '<n>', 'g') AS pattern FROM l),
g AS (SELECT doc_id, pattern, count(*) AS n, min(pos)::INT AS first FROM p GROUP BY doc_id, pattern)"""
_REQ = "q AS (SELECT conv_id, turn, sha256(role || '|' || length(text)) AS request_hash, md5(text) AS response FROM conversations)"
_FIFO = f"""WITH {_REQ}, live AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 10 = 0 THEN sha256(request_hash || '|altered') ELSE request_hash END AS request_hash, response FROM q),
  a AS (SELECT *, row_number() OVER (PARTITION BY request_hash ORDER BY conv_id, turn) AS ordinal FROM live),
  b AS (SELECT request_hash, response AS replayed, row_number() OVER (PARTITION BY request_hash ORDER BY conv_id, turn) AS ordinal FROM q),
  j AS (SELECT a.*, b.replayed, b.request_hash IS NOT NULL AS hit FROM a LEFT JOIN b USING (request_hash, ordinal))"""
_PRIORITY = "b AS (SELECT conv_id, turn AS idx, role, CASE role WHEN 'system' THEN 9 WHEN 'user' THEN 5 ELSE turn % 4 END AS priority, role = 'system' AS pin, text FROM conversations)"
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9'']+'))"
_TYPE = "coalesce(map {'click': 'llm_call', 'view': 'decision', 'purchase': 'policy_flag', 'signup': 'human_oversight'}[event_type], 'tool_call')"

ORACLES = {
    "topic_match": _NEAR + " SELECT vec_id, closest, round(score, 4) AS score, score >= 0.3 AS trips FROM n",
    "groundedness": _NEAR + " SELECT vec_id, score < 0.3 AS trips FROM n",
    "intent_nearest": _NEAR + " SELECT closest, count(*) FILTER (score < 0.3) AS tripped, count(*) AS n FROM n GROUP BY closest",
    "lexical_containment": f"""WITH j AS (SELECT a.conv_id, a.turn, {_WORDS.format('a.text')} AS w, {_WORDS.format('b.text')} AS e FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn + 1 = a.turn AND b.role = 'user' WHERE a.role = 'assistant')
        SELECT conv_id, turn, round(CASE WHEN len(e) = 0 THEN 1.0 ELSE len(list_intersect(e, w)) / len(e)::DOUBLE END, 6) AS containment FROM j""",
    "log_dedup": f"WITH {_LINES} SELECT doc_id, md5(pattern) AS pattern_md5, n, first FROM g",
    "log_compress": f"WITH {_LINES} SELECT doc_id, md5(string_agg(CASE WHEN n > 1 THEN pattern || ' (×' || n || ')' ELSE pattern END, chr(10) ORDER BY first)) AS small_md5, count(*) AS patterns FROM g GROUP BY doc_id",
    "framework_controls": "SELECT * FROM (VALUES " + ", ".join(
        "('" + "', '".join((f, t)) + f"', {i}, '{c}')" for f, types in audit.CONTROLS.items() for t, cs in types.items() for i, c in enumerate(cs)) + ") AS v(framework, type, place, control)",
    "cas_store": "SELECT sha256(text) AS key, length(any_value(text)) AS n FROM documents GROUP BY 1",
    "cas_expand": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "compress_props": "SELECT event_id, json(props)::VARCHAR AS small FROM events",
    "history_pack": "WITH r AS (SELECT conv_id, turn, CAST(3 + sum(4 + ceil(length(text) / 4.0)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) SELECT *, used <= 400 AS kept FROM r",
    "order_default": f"WITH {_PRIORITY} SELECT conv_id, idx, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 2 WHEN 'user' THEN 3 ELSE 1 END, idx) AS place FROM b",
    "order_cache": f"WITH {_PRIORITY} SELECT conv_id, idx, row_number() OVER (PARTITION BY conv_id ORDER BY pin DESC, priority DESC, idx) AS place FROM b",
    "order_attention": f"""WITH {_PRIORITY}, p AS (SELECT *, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 2 ELSE 1 END AS part FROM b),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY CASE WHEN part = 2 THEN priority ELSE -priority END, idx) - 1 AS r, count(*) OVER (PARTITION BY conv_id, part) AS n FROM p)
        SELECT conv_id, idx, row_number() OVER (PARTITION BY conv_id ORDER BY part, CASE WHEN part <> 1 THEN r WHEN r % 2 = 0 THEN r // 2 ELSE n - 1 - (r - 1) // 2 END) AS place FROM r""",
    "provider_messages": "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system') AS system, count(*) FILTER (role <> 'system') AS n_messages FROM conversations GROUP BY conv_id",
    "request_hash_plain": f"WITH {_REQ} SELECT conv_id, turn, request_hash FROM q",
    "replay_fifo": _FIFO + " SELECT conv_id, turn, ordinal, replayed, hit FROM j",
    "drift": _FIFO + " SELECT conv_id, turn, response, replayed FROM j WHERE replayed IS DISTINCT FROM response",
    "chain_build": CHAIN_SQL + "SELECT *, '' AS sig FROM c",
    "chain_verify": CHAIN_SQL + "SELECT chain_id, true AS ok, 'ok' AS detail, count(*) AS entries, arg_max(hash, seq) AS head FROM c GROUP BY chain_id",
    "chain_tamper": """WITH n AS (SELECT user_id AS chain_id, count(*) AS n FROM events GROUP BY user_id)
        SELECT chain_id, detail = 'ok' AS ok, detail FROM (SELECT chain_id, CASE WHEN chain_id % 4 = 0 AND n > 2 THEN 'tampered entry at seq 2' WHEN chain_id % 4 = 1 AND n > 4 THEN 'broken link at seq 4' WHEN chain_id % 4 = 1 AND n = 4 THEN 'incomplete log: head differs' WHEN chain_id % 4 = 2 THEN 'incomplete log: head differs' ELSE 'ok' END AS detail FROM n)""",
    "evidence_summary": f"""WITH e AS (SELECT user_id % 10 AS chain_id, {_TYPE} AS t FROM events)
        SELECT chain_id, count(*) FILTER (t = 'decision') AS decisions, count(*) FILTER (t = 'llm_call') AS llm_calls, count(*) FILTER (t = 'tool_call') AS tool_calls, 0::BIGINT AS context_assemblies, count(*) FILTER (t = 'human_oversight') AS human_oversight,
          count(*) FILTER (t = 'policy_flag') AS policy_flags, 0::BIGINT AS flags_blocked, 0::BIGINT AS flags_redacted, count(*) FILTER (t = 'policy_flag') AS flags_flagged, 0::BIGINT AS flags_info, count(*) FILTER (t = 'policy_flag') AS flags_warning, 0::BIGINT AS flags_critical FROM e GROUP BY chain_id""",
    "control_coverage": f"""WITH e AS (SELECT user_id % 10 AS chain_id, {_TYPE} AS t, event_id % 3 AS d FROM events),
        m(t, d, control) AS (VALUES ('decision', -1, 'Art.22 automated decision-making'), ('decision', -1, 'Art.5(2) accountability'), ('llm_call', -1, 'Art.30 records of processing'), ('tool_call', -1, 'Art.30 records of processing'), ('human_oversight', -1, 'Art.22(3) right to human intervention'),
          ('policy_flag', -1, 'Art.9 special-category data'), ('policy_flag', -1, 'Art.5(1)(c) data minimisation'), ('policy_flag', -1, 'Art.30 records of processing'), ('policy_flag', 0, 'Art.4(1) personal data'), ('policy_flag', 1, 'PCI-DSS 3.3/3.4 (payment-card data — cross-reference)'), ('policy_flag', 2, 'Art.32 security of processing'))
        SELECT chain_id, control, count(*) AS entries FROM e JOIN m ON e.t = m.t AND (m.d = -1 OR m.d = e.d) GROUP BY chain_id, control""",
}
