"""Queries on sensitive data and gate rules, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import detect, rules
from ..operators import gate
from ..sources.tables import table


def scan_findings(spark, sf_dir):
    return detect.scan(table(spark, sf_dir, "documents"), "text", ["doc_id"]).filter("category in ('email', 'ipv4', 'aws_key', 'password', 'credit_card')")


def scan_by_group(spark, sf_dir):
    found = detect.scan_totals(table(spark, sf_dir, "documents"), "text")
    return found.groupBy("group").agg(F.sum("count").alias("n"))


def scan_all_categories(spark, sf_dir):
    return detect.scan_totals(table(spark, sf_dir, "documents"), "text", detect.with_entropy(detect.with_packs("uk", "in")))


def redact_docs(spark, sf_dir):
    some = tuple(d for d in detect.BUILT_IN if d.category in ("email", "ipv4"))
    out = detect.scrub(table(spark, sf_dir, "documents"), "text", some)
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def redact_strict(spark, sf_dir):
    return detect.redact(table(spark, sf_dir, "documents"), "text", detect.POLICIES["strict"]).select("doc_id", "text")


def luhn_cards(spark, sf_dir):
    card = next(d for d in detect.BUILT_IN if d.category == "credit_card")
    t = F.col("text")
    return table(spark, sf_dir, "documents").filter(t.rlike(card.pattern)).select("doc_id", detect.count(t, card).alias("n_cards"))


def auto_flags(spark, sf_dir):
    found = detect.scan(table(spark, sf_dir, "documents"), "text", ["doc_id"]).filter("category in ('email', 'ipv4', 'aws_key', 'password')")
    return detect.auto_flags(detect.resolve(found, detect.POLICIES["gdpr"]), ["doc_id"])


def policy_actions(spark, sf_dir):
    return detect.policy_table(spark).withColumn("key", F.coalesce("key", F.lit("*")))


def guard_documents(spark, sf_dir):
    some = tuple(d for d in detect.BUILT_IN if d.category in ("email", "password", "aws_key"))
    out = detect.guard(table(spark, sf_dir, "documents"), "text", detect.POLICIES["gdpr"], some)
    return out.select("doc_id", "blocked", F.md5(F.col("text").cast("binary")).alias("text_md5"))


DENY = ["idiot", "scum", "lowei", "vequ"]


def _gated(spark, sf_dir, *some):
    return gate.evaluate(table(spark, sf_dir, "documents"), list(some), "input")


def keyword_deny(spark, sf_dir):
    return _gated(spark, sf_dir, rules.keyword_deny(DENY)).filter("blocked").select("doc_id", F.lower(F.col("decisions")[0]["detail"]).alias("matched"))


def keyword_deny_words(spark, sf_dir):
    """Whole words, with Unicode hardening."""
    return _gated(spark, sf_dir, rules.keyword_deny(["the idiot", "clown"], match="word", normalization=("nfkc", "casefold", "strip_zero_width"))).filter("blocked").select("doc_id")


def regex_rule(spark, sf_dir):
    return _gated(spark, sf_dir, rules.regex_rule(r"password=[0-9a-f]+", "redact", replacement="password=$0")).filter(F.size("decisions") > 0).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def length_bounds(spark, sf_dir):
    return _gated(spark, sf_dir, rules.length_bounds(3000, 1000)).select("doc_id", "blocked")


def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.get(rules.hosts(F.col("url")), 0).alias("host"))


def url_deny(spark, sf_dir):
    out = gate.evaluate(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text")), [rules.url_deny(["example.net", "cheap-pills.example.com"])], "input")
    return out.filter("blocked").select("page_id", F.col("decisions")[0]["detail"].alias("host"))


def url_allowlist(spark, sf_dir):
    out = gate.evaluate(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text")), [rules.url_allowlist(["example.com"])], "input")
    return out.select("page_id", "blocked")


def json_schema_props(spark, sf_dir):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}
    out = gate.evaluate(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("text")), [rules.json_schema(schema)], "output")
    return out.groupBy("blocked").agg(F.count(F.lit(1)).alias("n"))


def spotlight(spark, sf_dir):
    out = gate.evaluate(table(spark, sf_dir, "conversations"), [rules.spotlight()], "tool_output")
    return out.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def language_rule(spark, sf_dir):
    return _gated(spark, sf_dir, rules.language(["en", "fr"])).groupBy("lang").agg(F.count_if("blocked").alias("blocked"))


def gate_chain(spark, sf_dir):
    """Redaction feeds the next rule; the first block ends the chain."""
    chain = [rules.regex_rule("idiot", "redact", replacement="[x]"), rules.keyword_deny(["[x]"], "flag", name="saw_mark"), rules.length_bounds(2000), rules.keyword_deny(["the"], "flag", name="after")]
    out = _gated(spark, sf_dir, *chain)
    return out.select("doc_id", "blocked", F.array_join(F.transform("decisions", lambda d: d["rule"]), ",").alias("rules"))


def redteam_report(spark, sf_dir):
    cases = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("text", F.when(F.col("toxic") == 1, "attack").otherwise("benign").alias("label"), F.col("lang").alias("category"))
    return gate.red_team(cases, [rules.keyword_deny(DENY), rules.length_bounds(20_000)]).withColumn("whole", F.col("whole").cast("int"))


def injection_scan(spark, sf_dir):
    out = gate.evaluate(table(spark, sf_dir, "conversations"), [rules.prompt_injection()], "input")
    return out.groupBy("role").agg(F.count_if("blocked").alias("blocked"))


_W = r"(?i)(idiot|scum|lowei|vequ)"
_COUNTS = {
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "pii", "warning"), "aws_key": (r"\bAKIA[0-9A-Z]{16}\b", "secret", "critical"),
    "ipv4": (r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", "pii", "warning"),
    "password": (r"(?i)\b(?:password|passphrase|passwd|pwd)\b\s*(?:is|:|=)\s*\S+", "credential", "critical"),
}
_CARDS = r"list_filter(list_transform(regexp_extract_all(text, '\b\d(?:[ -]?\d){12,18}\b'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda d: list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN substr(d, length(d) - i, 1)::INT ELSE (substr(d, length(d) - i, 1)::INT * 2) % 10 + (substr(d, length(d) - i, 1)::INT * 2) // 10 END)) % 10 = 0)"
_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, '{g}' AS \"group\", '{s}' AS severity, len(regexp_extract_all(text, '{p}')) AS count FROM documents" for c, (p, g, s) in _COUNTS.items())
_FOUND += f" UNION ALL SELECT doc_id, 'credit_card', 'financial', 'critical', len({_CARDS}) FROM documents"
_EM, _IP, _PW, _AK = (_COUNTS[k][0] for k in ("email", "ipv4", "password", "aws_key"))

QUERIES = {f.__name__: f for f in (
    scan_findings, scan_by_group, scan_all_categories, redact_docs, redact_strict, luhn_cards, auto_flags, policy_actions, guard_documents, keyword_deny, keyword_deny_words, regex_rule, length_bounds,
    url_hosts, url_deny, url_allowlist, json_schema_props, spotlight, language_rule, gate_chain, redteam_report, injection_scan)}

_HOST = r"lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
ORACLES = {
    "scan_findings": f"SELECT * FROM ({_FOUND}) WHERE count > 0",
    "redact_docs": f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{_EM}', '<redacted>', 'g'), '{_IP}', '<redacted>', 'g')) AS text_md5 FROM documents",
    "luhn_cards": rf"SELECT doc_id, len({_CARDS}) AS n_cards FROM documents WHERE regexp_matches(text, '\b\d(?:[ -]?\d){{12,18}}\b')",
    "auto_flags": f"""WITH f AS (SELECT doc_id, category, severity, CASE WHEN category = 'password' THEN 'block' ELSE 'redact' END AS a FROM ({_FOUND}) WHERE count > 0 AND category <> 'credit_card')
        SELECT doc_id, CASE a WHEN 'block' THEN 'blocked' ELSE 'redacted' END AS action, CASE a WHEN 'block' THEN 'critical' ELSE 'info' END AS severity, string_agg(category, ', ' ORDER BY category) AS categories FROM f GROUP BY doc_id, a""",
    "policy_actions": """SELECT * FROM (VALUES ('default', 'secret', 'redact'), ('default', 'email', 'redact'), ('default', '*', 'flag'),
        ('gdpr', 'special_category', 'block'), ('gdpr', 'pii', 'redact'), ('gdpr', 'gov_id', 'redact'), ('gdpr', 'financial', 'redact'), ('gdpr', 'secret', 'redact'), ('gdpr', 'credential', 'block'), ('gdpr', '*', 'flag'),
        ('pci', 'financial', 'block'), ('pci', 'secret', 'redact'), ('pci', 'pii', 'redact'), ('pci', '*', 'flag'),
        ('strict', 'secret', 'block'), ('strict', 'credential', 'block'), ('strict', 'financial', 'block'), ('strict', 'gov_id', 'block'), ('strict', '*', 'redact')) AS t(policy, key, action)""",
    "guard_documents": f"""SELECT doc_id, regexp_matches(text, '{_PW}') AS blocked, CASE WHEN NOT regexp_matches(text, '{_PW}') THEN md5(regexp_replace(regexp_replace(text, '{_EM}', '<redacted>', 'g'), '{_AK}', '<redacted>', 'g')) END AS text_md5 FROM documents""",
    "keyword_deny": f"SELECT doc_id, lower(regexp_extract(text, '{_W}', 1)) AS matched FROM documents WHERE regexp_matches(text, '{_W}')",
    "keyword_deny_words": r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\bthe\s+idiot\b|\bclown\b')",
    "regex_rule": r"SELECT doc_id, md5(regexp_replace(text, 'password=[0-9a-f]+', 'password=$0', 'g')) AS text_md5 FROM documents WHERE regexp_matches(text, 'password=[0-9a-f]+')",
    "length_bounds": "SELECT doc_id, length(text) > 3000 OR ceil(length(text) / 4.0) > 1000 AS blocked FROM documents",
    "url_hosts": f"SELECT page_id, nullif({_HOST}, '') AS host FROM pages",
    "url_deny": f"SELECT page_id, {_HOST} AS host FROM pages WHERE regexp_matches({_HOST}, '(^|\\.)(example\\.net|cheap-pills\\.example\\.com)$')",
    "url_allowlist": f"SELECT page_id, {_HOST} <> '' AND NOT regexp_matches({_HOST}, '(^|\\.)example\\.com$') AS blocked FROM pages",
    "json_schema_props": "SELECT NOT coalesce(json_type(props) = 'OBJECT' AND json_type(props, '$.k') IN ('BIGINT', 'UBIGINT'), false) AS blocked, count(*) AS n FROM events GROUP BY 1",
    "spotlight": r"SELECT conv_id, turn, md5(CASE WHEN trim(text, E' \t\r\n') = '' THEN text ELSE '<untrusted>' || chr(10) || text || chr(10) || '</untrusted>' END) AS text_md5 FROM conversations",
    "language_rule": "SELECT lang, count(*) FILTER (lang NOT IN ('en', 'fr') AND trim(text) <> '') AS blocked FROM documents GROUP BY lang",
    "gate_chain": """WITH t AS (SELECT doc_id, text LIKE '%idiot%' AS hit, replace(text, 'idiot', '[x]') AS x FROM documents)
        SELECT doc_id, length(x) > 2000 AS blocked, array_to_string(list_filter([CASE WHEN hit THEN 'regex_rule' END, CASE WHEN contains(lower(x), '[x]') THEN 'saw_mark' END, CASE WHEN length(x) > 2000 THEN 'length_bounds' END,
          CASE WHEN length(x) <= 2000 AND contains(lower(x), 'the') THEN 'after' END], lambda v: v IS NOT NULL), ',') AS rules FROM t""",
    "redteam_report": f"""WITH c AS (SELECT lang AS category, toxic = 1 AS attack, regexp_matches(text, '{_W}') OR length(text) > 20000 AS tripped FROM documents JOIN labels USING (doc_id)),
        g AS (SELECT category, grouping(category)::INT AS whole, count(*) AS total, count(*) FILTER (attack) AS attacks, count(*) FILTER (NOT attack) AS benign, count(*) FILTER (attack AND tripped) AS caught, count(*) FILTER (NOT attack AND tripped) AS false_positives FROM c GROUP BY GROUPING SETS ((category), ()))
        SELECT *, coalesce(caught::DOUBLE / nullif(attacks, 0), 0) AS trip_rate, coalesce(false_positives::DOUBLE / nullif(benign, 0), 0) AS false_positive_rate FROM g""",
    "injection_scan": "SELECT role, count(*) FILTER (contains(lower(text), 'ignore previous instructions') OR contains(lower(text), 'jailbreak mode') OR contains(lower(text), 'do anything now')) AS blocked FROM conversations GROUP BY role",
}
