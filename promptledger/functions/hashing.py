"""Canonical JSON and the hashes over it. Canonical text is made by Python's encoder with sorted keys, since number text
and key order must survive; digests of ready text are the JVM's."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return texts.map(one)


def request_json(request: dict, version: int = 2) -> str:
    """The canonical text of a recorded request: calls by provider, model, messages and (version 2) whether they stream;
    tools by name and arguments in positional and named form."""
    if request.get("kind", "llm") == "llm":
        out = {"kind": "llm", "provider": request.get("provider"), "model": request.get("model"), "messages": request.get("messages")}
        if version >= 2:
            out["stream"] = bool((request.get("request_kwargs") or {}).get("stream", request.get("stream", False)))
        return canonical(out)
    given = request.get("arguments")
    if isinstance(given, dict) and {"args", "kwargs"} & set(given):
        args = {"args": given.get("args", []), "kwargs": given.get("kwargs", {})}
    elif isinstance(given, dict):
        args = {"args": [], "kwargs": given}
    else:
        args = {"args": given if isinstance(given, list) else [given], "kwargs": {}}
    return canonical({"kind": "tool", "name": request.get("name"), "arguments": args})


def request_hash(request: Column, version: int = 2) -> Column:
    """SHA-256 of a request given as JSON text."""

    @F.pandas_udf(T.StringType())
    def text(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else request_json(json.loads(r), version))

    return F.sha2(text(request), 256)


def chain_body(seq: int, ts: str, kind: str, payload) -> str:
    return canonical({"seq": seq, "ts": ts, "type": kind, "payload": payload})


def chain_hash(prev: str, body: str) -> str:
    return hashlib.sha256((prev + body).encode("utf-8", "surrogatepass")).hexdigest()


def sign(key: str, text: str) -> str:
    return hmac.new(key.encode(), text.encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()


def meta_signature(key: str, meta: dict) -> str:
    return sign(key, canonical({k: meta.get(k) for k in ("system", "risk_tier", "head_hash", "entries")}))
