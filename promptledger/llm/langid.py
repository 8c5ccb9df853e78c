"""Language identification of web pages by Bayesian fusion of evidence.

Four kinds of evidence meet as log probabilities: the page's text (hashed byte n-grams, naive Bayes, tempered since
n-grams overlap), the language that its markup declares, the suffix of its address, and the host's prior. Host priors
are smoothed level by level: what the texts say is summed by grouped aggregation for each host, for each registered
domain and for all, and each level shrinks to the one above. How far to trust declarations and suffixes is measured, by
the same sums, from how often they agree with the texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, freeze, lookup

SAMPLE, SAMPLE_CHARS, BITS, TEMPER = 2000, 20_000, 15, 0.25
SHRINK_HOST, SHRINK_DOMAIN, SHRINK_TABLE = 5.0, 20.0, 10.0

_DROP = re.compile(r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;")


def page_text(html: str | None) -> str:
    return _DROP.sub(" ", html) if html else ""


def _rows(text: str) -> np.ndarray:
    """Hashed two- and three-byte grams at each position, letters lower-cased, anything else a space."""
    raw = re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "surrogatepass")
    a = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    out = []
    for n in (2, 3):
        h = np.full(max(len(a) - n + 1, 0), n, np.uint32)
        for k in range(n):
            h = (h + a[k:k + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append(h >> np.uint32(32 - BITS))
    return np.concatenate(out).astype(np.int64) if len(raw.strip()) else np.zeros(0, np.int64)


class TextModel:
    """Log likelihoods of grams by language."""

    def __init__(self, texts: list[str], languages: list[str]):
        self.languages = sorted(set(languages)) or ["und"]
        counts = np.full((1 << BITS, len(self.languages)), 0.1)
        for t, lang in zip(texts, languages, strict=True):
            counts[:, self.languages.index(lang)] += np.bincount(_rows(t), minlength=1 << BITS)
        self.logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    def evidence(self, text: str) -> np.ndarray:
        """Log likelihood by language, tempered and centred; zero for a text without letters."""
        rows = _rows(text)
        total = np.zeros(len(self.languages))
        for i in range(0, len(rows), 1 << 16):
            total += self.logs[rows[i:i + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return TEMPER * (total - total.max())


def fit(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> TextModel:
    """From at most ``sample`` documents of each language (null languages and texts over ``chars`` are not drawn)."""
    known = docs.filter(F.col("lang").isNotNull() & (F.length("text") <= chars)).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").count().collect()  # a row per language
    if not counts:
        return TextModel([], [])
    # each language's share by hash holds some more than the sample, so this is all that leaves the executors
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(-(-1_300_000 * sample // r["count"])))])
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    drawn = known.withColumn("key", key).filter(F.col("key") < share[F.col("lang")]).collect()
    rows, taken = [], dict.fromkeys((r["lang"] for r in counts), 0)
    for r in sorted(drawn, key=lambda r: (r["key"], r["doc_id"] is None, r["doc_id"] or 0, r["text"])):
        if taken[r.lang] < sample:
            taken[r.lang] += 1
            rows.append(r)
    return TextModel([r.text for r in rows], [r.lang for r in rows])


def _smoothed(counts: str, above, shrink: float):
    """Counts by language, shrunk to the level above."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, above, lambda c, p: (c + shrink * p) / (total + shrink))


def _sums(n: int):
    return F.array(*[F.sum(F.col("belief")[i]) for i in range(n)])


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """A row per page: page_id, lang, probability, declared, host, text_lang.

    Pages without text, markup language or address are judged by what is left, in the end by the prior of all pages.
    Null ids pass through; repeated rows count as pages; ties fall to the language first by name. Hosts compare in
    lower case; null and unreadable addresses share a host "". An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    k, names = len(model.languages), model.languages
    sent = spark.sparkContext.broadcast((model.languages, model.logs))

    def read(batches):
        own = TextModel.__new__(TextModel)
        own.languages, own.logs = sent.value
        for b in batches:
            e = [own.evidence(page_text(h.as_py())).tolist() for h in b.column("html")]
            rest = [b.column(n) for n in ("page_id", "host", "declared", "suffix")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(e, pa.list_(pa.float64()))], names=["page_id", "host", "declared", "suffix", "evidence"])

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    markup = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")  # no tag stands in those
    declared = F.lower(F.regexp_extract(markup, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", host.alias("host"), declared.alias("declared"))
    rows = rows.withColumn("suffix", F.regexp_extract("host", r"\.([a-z0-9\-]+)$", 1))
    rows = rows.mapInArrow(read, "page_id long, host string, declared string, suffix string, evidence array<double>")
    belief = F.transform("evidence", lambda x: F.exp(x))
    total = F.aggregate("belief", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("belief", belief).withColumn("belief", F.transform("belief", lambda x: x / total))
    rows = rows.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    rows = freeze(rows, "langid-evidence")

    even = F.array(*[F.lit(1.0 / k)] * k)
    whole = rows.agg(_sums(k).alias("c")).first()[0]
    whole = [(x or 0.0) + 1.0 for x in whole]
    prior = F.array(*[F.lit(x / sum(whole)) for x in whole])
    domains = freeze(rows.groupBy("domain").agg(_sums(k).alias("c")).select("domain", _smoothed("c", prior, SHRINK_DOMAIN).alias("above")), "langid-domains")
    hosts = rows.groupBy("host", "domain").agg(_sums(k).alias("c"), F.count(F.lit(1)).alias("n"))
    hosts = freeze(hosts.join(domains, "domain").select("host", "n", _smoothed("c", "above", SHRINK_HOST).alias("host_prior")), "langid-hosts")
    rows = lookup(rows, hosts, "host", "n").drop("n")
    for name in ("declared", "suffix"):  # P(language | value) against P(language), both by what the texts say
        sums = rows.groupBy(name).agg(_sums(k).alias("c"), F.count(F.lit(1)).alias("n"))
        ratio = F.zip_with(_smoothed("c", prior, SHRINK_TABLE), prior, lambda p, q: F.log(p / q))
        ratio = F.when(F.col(name) == "", F.transform(even, lambda x: F.lit(0.0))).otherwise(ratio)
        table = freeze(sums.select(name, "n", ratio.alias(f"{name}_ratio")), f"langid-{name}")
        rows = lookup(rows, table, name, "n").drop("n")
    added = F.zip_with("evidence", F.transform("host_prior", lambda p: F.log(p)), lambda a, b: a + b)
    added = F.zip_with(F.zip_with(added, "declared_ratio", lambda a, b: a + b), "suffix_ratio", lambda a, b: a + b)
    rows = rows.withColumn("log", added).withColumn("top", F.array_max("log"))
    name_of = F.array(*[F.lit(x) for x in names])
    mass = F.aggregate(F.transform("log", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "page_id", F.element_at(name_of, F.array_position("log", F.col("top")).cast("int")).alias("lang"), (1.0 / mass).alias("probability"),
        F.when(F.col("declared") != "", F.col("declared")).alias("declared"), "host",
        F.element_at(name_of, F.array_position("evidence", F.array_max("evidence")).cast("int")).alias("text_lang"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir, "pages"), fit(documents(spark, sf_dir)))
