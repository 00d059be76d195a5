"""Identity: stable ids, content hashes, canonical JSON and event hashes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NUL = "\u0000"


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as lower-case hex."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """prefix_ and the first hex digits of SHA-256 over the parts, each followed by NUL; a null part is empty."""
    ended = [x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit(NUL))]
    return F.concat(F.lit(prefix + "_"), F.substring(content_hash(F.concat(*ended)), 1, length))


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


@F.pandas_udf(StringType())  # type: ignore[call-overload]
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys, no spaces and ASCII escapes; null where it is no JSON."""
    return text.map(_canonical)


@F.pandas_udf(StringType())  # type: ignore[call-overload]
def event_header_json(ts: pd.Series, kind: pd.Series, writer: pd.Series, session_id: pd.Series, body_hash: pd.Series, prev_hash: pd.Series) -> pd.Series:
    """Canonical JSON of the hashed part of an event."""
    names = ("ts", "kind", "writer", "session_id", "body_hash", "prev_hash")
    rows = zip(ts, kind, writer, session_id, body_hash, prev_hash, strict=True)
    clean = lambda x: None if x is None or x != x else x
    return pd.Series([json.dumps({n: clean(v) for n, v in zip(names, row, strict=True)}, sort_keys=True, separators=(",", ":")) for row in rows])


def event_hash(ts: Column, kind: Column, writer: Column, session_id: Column, body_hash: Column, prev_hash: Column) -> Column:
    return content_hash(event_header_json(ts, kind, writer, session_id, body_hash, prev_hash))


def event_id(kind: Column, hashed: Column) -> Column:
    return stable_id("evt", kind, hashed)


def json_list(text: Column) -> Column:
    """A JSON array of strings; anything else is the empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
