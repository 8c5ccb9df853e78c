"""Secret scanning with a random forest against false positives, in DataFrame operations only.

A pattern draws candidates: runs of 16 or more characters that keys are made of, provider keys and dotted tokens of
known form, what is assigned to a name that secrets have (any characters but spaces, of any length; quotes end a quoted
one), and what stands between a colon and an @ as in user:pass@host. Each is described by its length, how
its characters follow one another, how much of it dictionary pieces cover, the path it comes from and the words around
it. A random forest (the JVM's own) trained on labelled findings tells secrets from digests, identifiers and long words.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

_NAME = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|authorization|credentials?)"
_AFTER_NAME = rf"(?<=[=:\s])(?<={_NAME}[\"']?\s{{0,2}}:?[=:]>?\s{{0,2}})"
_END = r"(?=[\"',;.)\]}>]*(?:\s|$)|&[\w.\-]+=)"
CANDIDATE = "|".join((
    rf"(?<=[\"'])(?:(?<={_NAME}[\"']?\s{{0,2}}:?[=:]>?\s{{0,2}}\")[^\s\"]+|(?<={_NAME}[\"']?\s{{0,2}}:?[=:]>?\s{{0,2}}')[^\s']+)",
    rf"{_AFTER_NAME}(?![\"'])(?!(?i:bearer|basic)\s)\S+?{_END}",
    r"(?<=(?i:bearer|basic)\s)[^\s\"',;]+",
    r"(?<=:)(?!//)[^\s\"'<>]{1,256}(?=@[A-Za-z0-9\[])",
    r"\beyJ[A-Za-z0-9_\-]*(?:\.[A-Za-z0-9_\-]+)+", r"\bsk[-_][A-Za-z0-9_\-]{8,}",
    r"[A-Za-z0-9+/_\-]{16,}={0,2}"))
NEAR, TREES, DEPTH, FINDINGS, SEED, THRESHOLD = 48, 20, 7, 6000, 11, 0.5

#: Pieces of common words in the languages at hand, longest first within each start.
DICTIONARY = (
    "tion|ment|able|ible|ness|ing|ence|ance|ought|ould|ther|ent|ers|est|ess|and|the|for|with|from|this|that|have|"
    "schaft|lich|keit|heit|ung|sch|chen|ein|ver|ber|gen|ten|tel|ich|ach|und|der|die|das|nicht|aux|eau|eux|que|"
    "elle|ette|ique|oir|our|ais|les|des|une|dans|pour|ciones|cion|mente|ado|ido|ando|iendo|dad|ar|er|ir|os|as|es|"
    "user|name|list|data|file|test|value|string|number|index|key|config|service|client|server|module|class|method|"
    "re|de|en|on|an|in|at|st|nd|nt|ed|ly|ou|ea|ha|he|ti|or|al|le|la|li|ne|ra|ri|ro|se|si|ta|te|to|co|ca|ma|me|mi|"
    "mo|pa|pe|po|da|di|do|no|na|ni|be|ge|ga|go|ja|lo|ll|rr|tz|au|ie|oi|ai"
)
SECRET_WORDS = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_\- ]?key|access[_\- ]?key|auth|credential|private|bearer)\W*$"
DIGEST_WORDS = r"(?i)(sha\d*|md5|hash|digest|checksum|commit|revision|uuid|guid|etag|integrity|fingerprint|version|id)\W*$"
EXAMPLE_WORDS = r"(?i)(example|sample|dummy|placeholder|fake|changeme|your[_\- ]|xxxx|test[_\- ]?(key|token))"
TEST_PATH = r"(?i)(^|[/_.\-])(tests?|spec|examples?|samples?|fixtures?|mocks?|docs?|lock)([/_.\-]|$)"

FEATURES = ["length", "letters", "digits", "uppers", "turns", "distinct", "vowels", "covered", "hexadecimal", "known_form",
            "separators", "path_test", "before_secret", "before_digest", "near_example", "assigned", "symbols", "in_address", "reference"]


def candidates(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, path, ordinal, value, before, after (what stands around it)."""
    gaps, hits = F.split(F.col("t"), CANDIDATE, -1), F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col(path), F.lit("")).alias("path"), F.col(text).alias("t")).filter(F.col("t").rlike(CANDIDATE))
    rows = rows.select("doc_id", "path", gaps.alias("gaps"), hits.alias("hits"))
    found = F.transform("hits", lambda h, i: F.struct(
        h.alias("value"),
        F.right(F.element_at("gaps", i + 1), F.lit(NEAR)).alias("before"),
        F.left(F.element_at("gaps", i + 2), F.lit(NEAR)).alias("after")))
    return rows.select("doc_id", "path", F.posexplode(found).alias("ordinal", "x")).select("doc_id", "path", "ordinal", "x.value", "x.before", "x.after")


def described(found: DataFrame) -> DataFrame:
    """Adds the forest's features to rows of path, value, before, after."""
    v = F.col("value")
    n = F.length(v).cast("double")
    count = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    turns = count(r"(?<=[a-z])(?=[^a-z])") + count(r"(?<=[A-Z])(?=[^A-Z])") + count(r"(?<=[0-9])(?=[^0-9])")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.select(
        "*", n.alias("length"), (count("[A-Za-z]") / n).alias("letters"), (count("[0-9]") / n).alias("digits"), (count("[A-Z]") / n).alias("uppers"),
        (turns / n).alias("turns"), (F.size(F.array_distinct(F.split(v, ""))) / n).alias("distinct"), (count("(?i)[aeiou]") / n).alias("vowels"),
        ((n - F.length(F.regexp_replace(v, f"(?i)(?:{DICTIONARY})", ""))) / n).alias("covered"), flag(v.rlike("^[0-9a-fA-F]+$")).alias("hexadecimal"),
        flag(v.rlike(r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^sk[-_](?=.*[0-9])[A-Za-z0-9_\-]{8,}|^xox[abprs]-|^AIza[0-9A-Za-z_\-]{35}$|^eyJ")).alias("known_form"),
        (count(r"[+/_\-]") / n).alias("separators"), flag(F.col("path").rlike(TEST_PATH)).alias("path_test"),
        flag(F.col("before").rlike(SECRET_WORDS)).alias("before_secret"), flag(F.col("before").rlike(DIGEST_WORDS)).alias("before_digest"),
        flag(F.concat("before", v, "after").rlike(EXAMPLE_WORDS)).alias("near_example"), flag(F.col("before").rlike("[=:]\\s*[\"']?$")).alias("assigned"),
        (count(r"[^A-Za-z0-9+/_\-]") / n).alias("symbols"), flag(F.col("before").rlike(r"://[^\s/@]*:$") & F.col("after").startswith("@")).alias("in_address"),
        flag(v.rlike(r"^[$<{%\[(]|^\*+$|[(\[].*[)\]]?$|^\w+(\.[A-Za-z_]+)+$")).alias("reference"),
    )


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """Labelled findings (path, value, before, after, label) made from their number by rule: provider keys, assigned
    passwords and tokens, short ones and those in addresses too, against digests, UUIDs, identifiers, paths, words, code and
    placeholders. Users pass their own
    reviewed findings of the same columns instead."""
    i = F.col("id")
    hexes = lambda salt, n: F.substring(F.sha2(F.concat_ws("|", i.cast("string"), F.lit(salt)), 256), 1, n)
    b64 = lambda salt, n: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat_ws("|", i.cast("string"), F.lit(salt)), 512))), "[+/=\r\n]", ""), 1, n)
    pieces = ["tion", "ing", "er", "sch", "lich", "keit", "aux", "eur", "ado", "cion", "heit", "ver", "en", "re", "the", "and", "ment", "que"]
    piece = lambda k: F.element_at(F.array(*[F.lit(p) for p in pieces]), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(pieces))) + 1).cast("int"))
    word = F.concat(*[piece(k) for k in range(6)])
    pick = lambda salt, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    short = lambda k: F.concat(F.initcap(piece(k)), F.substring(hexes("o", 4), 1, 3), pick("mark", "&", "!", "#", "$", "@", "%", "*", ".", ""), b64("z", 5), pick("end", "!", "?", "", "", "9"))
    kind = F.pmod(i, F.lit(20))
    cases = [  # value, before, label
        (F.concat(F.lit("AKIA"), F.upper(b64("a", 16))), pick("b0", "key ", "", "use ", "aws_access_key_id = "), 1),
        (hexes("p", 18), pick("b1", "password=", "passwd: ", "pwd='", "PASSWORD = "), 1),
        (hexes("t", 40), pick("b2", 'token = "', "secret: ", 'api_key="', "auth_token="), 1),
        (b64("s", 40), pick("b3", "secret_key=", "aws_secret = '", "credentials: ", "api-key: "), 1),
        (F.concat(F.lit("ghp_"), b64("g", 36)), pick("b4", "token ", "", "with ", "auth "), 1),
        (F.concat(F.lit("sk-"), b64("k", 32)), pick("b5", "key ", "", "bearer ", "OPENAI="), 1),
        (hexes("d", 40), pick("c0", "commit ", "revision ", "sha1: ", "from "), 0),
        (hexes("e", 64), pick("c1", "sha256:", "digest ", "checksum = ", "integrity "), 0),
        (hexes("m", 32), pick("c2", "md5 ", "etag: ", "hash=", "id "), 0),
        (word, pick("c3", "und ", "the ", "la ", "que "), 0),
        (F.concat(hexes("u", 8), F.lit("-"), hexes("v", 4), F.lit("-4"), hexes("w", 3), F.lit("-a"), hexes("x", 3), F.lit("-"), hexes("y", 12)), pick("c4", "uuid ", "id=", "request ", ""), 0),
        (F.concat(piece(7), F.lit("_"), word, F.lit("_"), piece(8)), pick("c5", "def ", "call ", "var ", "module "), 0),
        (F.concat(piece(9), F.lit("/"), word, F.lit("/"), piece(10)), pick("c6", "in ", "path ", "see ", "open "), 0),
        (pick("v", "your_api_key_here_xxxx", "xxxxxxxxxxxxxxxxxxxx", "EXAMPLEKEYEXAMPLEKEY", "changemechangeme123"), pick("c7", "token = ", "password=", "secret: ", "key="), 0),
        (short(11), pick("c8", "password=", "passwd: ", 'pwd="', "PASSWORD = '", "secret: ", "api_key="), 1),
        (F.concat(F.lit("sk-"), F.substring(b64("k2", 12), 1, 11), F.lit("7")), pick("c9", "key ", "", "use ", "OPENAI_KEY="), 1),
        (short(12), pick("d0", "postgres://app:", "mysql://root:", "https://user:", "redis://:"), 1),
        (F.concat(F.lit("eyJ"), b64("j1", 30), F.lit("."), F.lit("eyJ"), b64("j2", 40), F.lit("."), b64("j3", 40)), pick("d1", "token: ", "", "bearer ", "jwt "), 1),
        (F.when(i % 40 < 20, pick("w1", "required", "string", "None", "null", "true", "yes", "the", "and", "incorrect", "str", "int", "false")).otherwise(F.concat(piece(13), piece(14))), pick("d2", "password: ", "token = ", "key: ", "secret=", "auth: "), 0),
        (pick("w2", "os.environ['PASSWORD']", "getpass()", "${TOKEN}", "$SECRET", "<password>", "config.secret", "self.token", "{{ key }}", "****", "get_token(user)", "%s", "[redacted]"), pick("d3", "password = ", "token=", "key: ", 'secret="'), 0),
    ]
    at = lambda k: F.coalesce(*[F.when(kind == j, F.lit(c[k]) if k == 2 else c[k]) for j, c in enumerate(cases)])
    return spark.range(0, rows, 1, 4).select(
        pick("path", "src/app.py", "lib/config.yml", "web", "src7", "notes", "deploy/env").alias("path"), at(0).alias("value"), at(1).alias("before"),
        F.when(kind == 16, F.lit("@db.internal/main")).otherwise(pick("after", " in ", '"\n', " the ", ", und ", "")).alias("after"), at(2).cast("double").alias("label"))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """Fit on labelled findings (path, value, before, after, label), a reviewed set of bounded size."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(findings)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt").fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = THRESHOLD, path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, ordinal (of the candidate in its text), value_sha256, length, score, is_secret.

    The value itself is not returned. Null and empty texts have no candidate; a null path counts as empty; null ids
    pass through; repeated rows are scanned as often as they occur; no rows give no rows; other columns are ignored.
    """
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(candidates(docs, path=path)))
    rows = model.transform(rows.select("doc_id", "ordinal", "value", "features"))
    score = vector_to_array("probability")[1]
    return rows.select("doc_id", "ordinal", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), score.alias("score"), (score >= threshold).alias("is_secret"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), train(labelled_findings(spark)))
