"""Sensitive data: a table of detectors, counts per category, redaction, and policies.

Detectors are regular expressions, some with a check of the match. Patterns and checks are Column expressions, so scans
stay in the JVM; a cheap test for any occurrence guards each extraction. Where a redaction must keep matches that fail
their check, the text is taken apart at the matches and put together again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REDACTED = "<redacted>"


def _digits(v: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(v, r"[^0-9]", ""), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def luhn(v: Column) -> Column:
    d = F.regexp_replace(v, "[^0-9]", "")
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def iban(v: Column) -> Column:
    """Mod 97 of the rearranged number, letter by letter: a letter stands for two digits."""
    s = F.upper(F.regexp_replace(v, r"\s+", ""))
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    left = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (left == 1)


def aba(v: Column) -> Column:
    d = _digits(v)
    weights = F.array(*[F.lit(w) for w in (3, 7, 1) * 3])
    digits = F.regexp_replace(v, "[^0-9]", "")
    return (F.length(digits) == 9) & (_sum(F.zip_with(F.slice(d, 1, 9), weights, lambda a, w: a * w)) % 10 == 0)


def ssn(v: Column) -> Column:
    d = F.regexp_replace(v, "[^0-9]", "")
    return (F.length(d) == 9) & ~d.rlike("^(000|666|9)|^...00|0000$")


def phone(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)


#: ISO 3166-1 alpha-2 country codes.
COUNTRIES = (
    "AD AE AF AG AI AL AM AO AQ AR AS AT AU AW AX AZ BA BB BD BE BF BG BH BI BJ BL BM BN BO BQ BR BS BT BV BW BY BZ "
    "CA CC CD CF CG CH CI CK CL CM CN CO CR CU CV CW CX CY CZ DE DJ DK DM DO DZ EC EE EG EH ER ES ET FI FJ FK FM FO FR "
    "GA GB GD GE GF GG GH GI GL GM GN GP GQ GR GS GT GU GW GY HK HM HN HR HT HU ID IE IL IM IN IO IQ IR IS IT JE JM JO JP "
    "KE KG KH KI KM KN KP KR KW KY KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MF MG MH MK ML MM MN MO MP MQ MR MS MT "
    "MU MV MW MX MY MZ NA NC NE NF NG NI NL NO NP NR NU NZ OM PA PE PF PG PH PK PL PM PN PR PS PT PW PY QA RE RO RS RU RW "
    "SA SB SC SD SE SG SH SI SJ SK SL SM SN SO SR SS ST SV SX SY SZ TC TD TF TG TH TJ TK TL TM TN TO TR TT TV TW TZ "
    "UA UG UM US UY UZ VA VC VE VG VI VN VU WF WS YE YT ZA ZM ZW"
)


def bic(v: Column) -> Column:
    return F.length(v).isin(8, 11) & F.substring(v, 5, 2).isin(*COUNTRIES.split())


def verhoeff(v: Column) -> Column:
    """The checksum over the dihedral group of ten: its product is a rule, so only the permutation is a table."""
    # One step of the permutation; place i applies it i times.
    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    powers, row = [], list(range(10))
    for _ in range(8):
        powers += row
        row = [step[x] for x in row]

    def times(a, b):  # 0 to 4 are rotations, 5 to 9 reflections
        turned = F.when(a < 5, (a + b % 5) % 5).otherwise((a - b % 5) % 5)
        turned = F.pmod(turned, F.lit(5))
        return F.when((a < 5) == (b < 5), turned).otherwise(turned + 5)

    table = F.array(*[F.lit(x) for x in powers])
    placed = F.transform(F.reverse(_digits(v)), lambda d, i: F.element_at(table, ((i % 8) * 10 + d + 1).cast("int")))
    return F.aggregate(placed, F.lit(0), times) == 0


def nino(v: Column) -> Column:
    s = F.upper(F.regexp_replace(v, " ", ""))
    return (F.length(s) == 9) & ~s.rlike("^[DFIQUV]|^.[DFIOQUV]") & ~F.substring(s, 1, 2).isin("BG", "GB", "NK", "KN", "NT", "TN", "ZZ")


def entropy(v: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


@dataclass(frozen=True)
class Detector:
    category: str
    group: str
    severity: str
    pattern: str
    check: Callable[[Column], Column] | None = None


#: Categories and their patterns, in the order in which redaction applies them.
BUILT_IN = (
    Detector("email", "pii", "warning", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    Detector("api_key", "secret", "critical", r"\bsk-[A-Za-z0-9_-]{8,}"),
    Detector("aws_key", "secret", "critical", r"\bAKIA[0-9A-Z]{16}\b"),
    Detector("google_api_key", "secret", "critical", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    Detector("jwt", "secret", "critical", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Detector("bearer_token", "secret", "critical", r"\b[Bb]earer\s+[A-Za-z0-9._-]+\b"),
    Detector("github_token", "secret", "critical", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    Detector("slack_token", "secret", "critical", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    Detector("private_key", "secret", "critical", r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----"),
    Detector("password", "credential", "critical", r"(?i)\b(?:password|passphrase|passwd|pwd)\b\s*(?:is|:|=)\s*\S+"),
    Detector("credit_card", "financial", "critical", r"\b\d(?:[ -]?\d){12,18}\b", luhn),
    Detector("iban", "financial", "critical", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", iban),
    Detector("us_routing", "financial", "critical", r"\b\d{9}\b", aba),
    Detector("swift_bic", "financial", "critical", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", bic),
    Detector("us_ssn", "gov_id", "critical", r"\b\d{3}-\d{2}-\d{4}\b", ssn),
    Detector("phone", "pii", "warning", r"(?<!\w)(?:\+?1[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)|(?<!\w)\+\d{9,15}(?!\d)", phone),
    Detector("ipv4", "pii", "warning", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"),
    Detector("ipv6", "pii", "warning", r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b|\b(?:[A-Fa-f0-9]{1,4}:){1,7}:(?:[A-Fa-f0-9]{1,4}\b)?"),
    Detector("mac_address", "pii", "warning", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"),
    Detector("special_category", "special_category", "warning",
             r"(?i)\b(?:diagnos(?:is|es|ed)?|hiv|pregnan(?:t|cy)|disab(?:led|ility)|biometric|fingerprints?|genetic|ethnicity|religio(?:n|us))\b"),
)

PACKS = {
    "uk": (Detector("uk_nino", "gov_id", "critical", r"\b[A-Z]{2}\d{6}[A-D]\b", nino),),
    "in": (Detector("in_aadhaar", "gov_id", "critical", r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b", verhoeff),),
}


def with_packs(*codes: str, base: tuple[Detector, ...] = BUILT_IN) -> tuple[Detector, ...]:
    have = {d.category for d in base}
    for c in codes:
        if c.lower() not in PACKS:
            raise ValueError(f"unknown pack {c!r}; there are {sorted(PACKS)}")
        base += tuple(d for d in PACKS[c.lower()] if d.category not in have)
    return base


def with_entropy(base: tuple[Detector, ...] = BUILT_IN, min_length: int = 24, min_entropy: float = 3.5) -> tuple[Detector, ...]:
    check = lambda v: (F.length(v) >= min_length) & (entropy(v) >= min_entropy)
    own = Detector("high_entropy_secret", "secret", "warning", rf"\b[A-Za-z0-9+/=_-]{{{min_length},}}\b", check)
    return (*[d for d in base if d.category != own.category], own)


_beyond = lambda t: F.octet_length(t) != F.length(t)
_has_digit = lambda t: t.rlike("[0-9]") | (_beyond(t) & t.rlike(r"(?U)\d"))
_named = lambda *parts: lambda t: _beyond(t) | F.lower(t).rlike("|".join(parts))

#: What a text has wherever a pattern matches, and what is cheap to look for. Letters compare by Unicode's case in patterns
#: that ignore it, so their words are only looked for in ASCII texts.
NEEDED = {
    "email": lambda t: t.contains("@"), "api_key": lambda t: t.contains("sk-"), "aws_key": lambda t: t.contains("AKIA"), "google_api_key": lambda t: t.contains("AIza"),
    "jwt": lambda t: t.contains("eyJ"), "bearer_token": lambda t: t.contains("earer"), "github_token": lambda t: t.rlike("gh[pousr]_"), "slack_token": lambda t: t.contains("xox"),
    "private_key": lambda t: t.contains("-----BEGIN"), "password": _named("pass", "pwd"), "credit_card": _has_digit, "iban": _has_digit, "us_routing": _has_digit,
    "swift_bic": lambda t: t.rlike("[A-Z]{6}"), "us_ssn": _has_digit, "phone": _has_digit, "ipv4": _has_digit, "ipv6": lambda t: t.rlike("[A-Fa-f0-9]:"),
    "mac_address": lambda t: t.rlike("[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"),
    "special_category": _named("diagnos", "hiv", "pregnan", "disab", "biometric", "fingerprint", "genetic", "ethnicity", "religio"),
    "uk_nino": _has_digit, "in_aadhaar": _has_digit,
}


def count(text: Column, d: Detector) -> Column:
    """Matches of a detector that pass its check. Words and digits are Unicode's, as the patterns mean them."""
    p = "(?U)" + d.pattern
    if d.check is None:
        n = F.regexp_count(text, F.lit(p))
    else:
        n = F.size(F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(0)), d.check))
    # a category that a caller defines may have the name of a built-in one
    built_in = any(d is x for x in (*BUILT_IN, *(x for pack in PACKS.values() for x in pack)))
    return F.when(NEEDED[d.category](text), n).otherwise(0).cast("long") if built_in else n.cast("long")


def scan(df: DataFrame, text: str, keys: list[str], detectors: tuple[Detector, ...] = BUILT_IN) -> DataFrame:
    """Findings: a row per key and category that occurs, with its group, severity and count; never the value."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.array(*[F.struct(F.lit(d.category).alias("category"), F.lit(d.group).alias("grp"), F.lit(d.severity).alias("severity"), count(t, d).alias("n")) for d in detectors])
    rows = df.select(*keys, F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("x"))
    return rows.select(*keys, "x.category", F.col("x.grp").alias("group"), "x.severity", F.col("x.n").alias("count"))


def scan_totals(df: DataFrame, text: str, detectors: tuple[Detector, ...] = BUILT_IN) -> DataFrame:
    """Counts per category over a whole table: sums before anything is shuffled."""
    return scan(df, text, [], detectors).groupBy("category", "group", "severity").agg(F.sum("count").alias("count"))


def _scrub_checked(text: Column, pattern: str, check: Callable[[Column], Column]) -> Column:
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.transform(hits, lambda h: F.when(check(h), F.lit(REDACTED)).otherwise(h))
    return F.concat_ws("", F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(kept, i), F.lit("")))))


def scrub(df: DataFrame, text: str, detectors: tuple[Detector, ...]) -> DataFrame:
    """Redact a column in order, each detector reading what the one before left; matches that fail their check stay. One
    projection a detector, so that no expression holds copies of the ones before."""
    for d in detectors:
        p, t = "(?U)" + d.pattern, F.col(text)
        step = F.regexp_replace(t, p, REDACTED) if d.check is None else F.when(t.rlike(p), _scrub_checked(t, p, d.check)).otherwise(t)
        df = df.withColumn(text, step)
    return df


@dataclass(frozen=True)
class Policy:
    """Category, then group, then default decides what happens to a finding: redact, block, flag or allow."""

    name: str
    actions: tuple[tuple[str, str], ...]
    default: str = "flag"

    def action(self, category: str, group: str) -> str:
        own = dict(self.actions)
        return own.get(category, own.get(group, self.default))

    def redacted(self, detectors: tuple[Detector, ...] = BUILT_IN) -> tuple[Detector, ...]:
        return tuple(d for d in detectors if self.action(d.category, d.group) in ("redact", "block"))


#: The presets.
POLICIES = {p.name: p for p in (
    Policy("default", (("secret", "redact"), ("email", "redact"))),
    Policy("gdpr", (("special_category", "block"), ("pii", "redact"), ("gov_id", "redact"), ("financial", "redact"), ("secret", "redact"), ("credential", "block"))),
    Policy("pci", (("financial", "block"), ("secret", "redact"), ("pii", "redact"))),
    Policy("strict", (("secret", "block"), ("credential", "block"), ("financial", "block"), ("gov_id", "block")), "redact"),
)}


def policy_table(spark: SparkSession) -> DataFrame:
    rows = [(p.name, k, a) for p in POLICIES.values() for k, a in p.actions] + [(p.name, None, p.default) for p in POLICIES.values()]
    return spark.createDataFrame(rows, "policy string, key string, action string")


def resolve(findings: DataFrame, policy: Policy) -> DataFrame:
    """Adds each finding's action. Policies are a few literals, so this is a projection, not a join."""
    own = F.create_map(*[F.lit(x) for kv in policy.actions for x in kv])
    return findings.withColumn("action", F.coalesce(own[F.col("category")], own[F.col("group")], F.lit(policy.default)))


def redact(df: DataFrame, text: str, policy: Policy, detectors: tuple[Detector, ...] = BUILT_IN) -> DataFrame:
    return scrub(df, text, policy.redacted(detectors))


_RANK = "CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END"


def auto_flags(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One flag per key and action: sorted categories, and the highest severity (info for redactions)."""
    verb = F.create_map(*[F.lit(x) for kv in (("block", "blocked"), ("redact", "redacted"), ("flag", "flagged")) for x in kv])
    out = findings.filter("action <> 'allow'").groupBy(*keys, "action").agg(F.array_sort(F.collect_set("category")).alias("data"), F.max(F.expr(_RANK)).alias("rank"))
    severity = F.when(F.col("action") == "redact", "info").otherwise(F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("critical")), F.col("rank") + 1))
    return out.select(*keys, verb[F.col("action")].alias("action"), severity.alias("severity"), F.array_join("data", ", ").alias("categories"))


def guard(df: DataFrame, text: str, policy: Policy, detectors: tuple[Detector, ...] = BUILT_IN) -> DataFrame:
    """Per row: blocked (any category whose action is block), flagged categories, and the text with redactions; a
    blocked row's text becomes null. Unknown actions flag."""
    t = F.coalesce(F.col(text), F.lit(""))
    present = lambda want: F.array_compact(F.array(*[F.when(count(t, d) > 0, F.lit(d.category)) for d in detectors if want(policy.action(d.category, d.group))] or [F.lit(None).cast("string")]))
    blocked = F.size(present(lambda a: a == "block")) > 0
    only = tuple(d for d in detectors if policy.action(d.category, d.group) == "redact")
    marked = df.withColumn("flagged", present(lambda a: a not in ("block", "redact"))).withColumn("blocked", blocked)
    return scrub(marked.withColumn(text, F.when(~F.col("blocked"), F.col(text))), text, only)


#: The recording redactor's patterns, in order.
RECORDING = (
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", r"\bsk-[A-Za-z0-9_-]{8,}", r"\bAKIA[0-9A-Z]{16}\b", r"\bAIza[0-9A-Za-z_-]{35}\b",
    r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"\b[Bb]earer\s+[A-Za-z0-9._-]+\b", r"\b[A-Za-z0-9_-]{32,}\b",
)


def redact_recording(text: Column) -> Column:
    for p in RECORDING:
        text = F.regexp_replace(text, "(?U)" + p, REDACTED)
    return text
