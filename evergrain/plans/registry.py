"""Where queries are registered: name -> callable, name -> DuckDB SQL, and what several of them share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrain.functions import scope as S
from evergrain.functions import text as T

from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CONTEXT = S.ScopeContext(project="src1", repo="src4", client="src2")


def now():
    return F.to_timestamp(F.lit(V.NOW))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


IDS = "('global:doctrine','project:src1','repo:src4','client:src2')"
WEIGHT = f"CASE WHEN scope_type='global' THEN 1.0 WHEN scope_type='legacy_unscoped' THEN {{unscoped}} WHEN scope_id IN {IDS} THEN 1.25 WHEN visibility IN ('confidential','secret') OR scope_type='client' THEN 0.0 ELSE {{other}} END"
WORDS = r"regexp_extract_all(lower(coalesce({0},'')), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}-]{{2,}}')"
STOP = "[" + ",".join(f"'{w}'" for w in T.FTS_STOPWORDS) + "]"
MEANING_STOP = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(T.STOP_TERMS + T.NEGATIONS)) + "]"


def sql_text(pattern: str) -> str:
    """A pattern as a literal of SQL, without look-aheads, which DuckDB's expressions do not have."""
    for ahead in (r"(?!\[REDACTED\])", r"(?!\"\[REDACTED\]\")", r"(?!'\[REDACTED\]')"):
        pattern = pattern.replace(ahead, "")
    pattern = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern)
    return "'" + pattern.replace("'", "''") + "'"


def sql_names(text: str, rules) -> str:
    """The names of the rules that a text fires, in order, as a list."""
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, {sql_text(p)}) THEN '{n}' END" for n, p in rules)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def sql_any(text: str, rules) -> str:
    return "(" + " OR ".join(f"coalesce(regexp_matches({text}, {sql_text(p)}), false)" for _, p in rules) + ")"


def sql_score(text: str) -> str:
    """The correction score of a text."""
    parts = [f"CASE WHEN coalesce(regexp_matches({text}, {sql_text(p)}), false) THEN {w} ELSE 0.0 END" for p, w in T.CORRECTION_CUES]
    praised = f"coalesce(regexp_matches({text}, {sql_text(T.AFFIRMATION)}), false)"
    return f"CASE WHEN {text} IS NULL OR trim({text}) = '' OR ({praised} AND greatest({', '.join(parts)}) < 0.5) THEN 0.0 ELSE least(1.0, {' + '.join(parts)}) END::DOUBLE"
