"""Registered queries of the text scanners."""

from __future__ import annotations

from pyspark.sql import functions as F

from evergrain.functions import text as T
from evergrain.session import table

from .registry import STOP, WORDS, query, sql_text


def _redacted_sql() -> str:
    out = "text"
    for pattern, put in T.REDACTIONS:
        out = f"regexp_replace({out}, {sql_text(pattern)}, {sql_text(put.replace('$', chr(92)))}, 'g')"
    return out


@query("redacted_texts", f"""WITH t AS (SELECT doc_id, {_redacted_sql()} AS r FROM documents)
    SELECT doc_id, sha256(r) AS redacted_sha256, len(regexp_extract_all(r, '\\[REDACTED[A-Z_]*\\]')) AS n_redacted FROM t""")
def redacted_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(T.redact_secrets(F.col("text")))).alias("r"))
    return d.select("doc_id", F.sha2("r", 256).alias("redacted_sha256"), F.size(F.regexp_extract_all("r", F.lit(r"(\[REDACTED[A-Z_]*\])"), 1)).cast("long").alias("n_redacted"))


@query("entropy_span_lists", f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, {sql_text(T.ENTROPY_RUN)}), lambda s: length(s) >= 40 AND list_entropy(string_split(s, '')) >= 3.5) AS s FROM documents)
    SELECT doc_id, len(s) AS n_spans, array_to_string(s, ' ') AS spans FROM t""")
def entropy_span_lists(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(T.entropy_spans(F.col("text")))).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_spans"), F.array_join("s", " ").alias("spans"))


@query("title_lines", r"""WITH t AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')[1] AS f FROM documents),
    b AS (SELECT doc_id, source, f, CASE WHEN starts_with(f, '#') THEN trim(regexp_replace(f, '^#+', '')) ELSE f END AS b FROM t)
    SELECT doc_id, CASE WHEN coalesce(b, '') <> '' THEN substring(b, 1, 160) WHEN f IS NULL THEN substring(source, 1, 160) ELSE source END AS title FROM b""")
def title_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.title_of(F.col("text"), F.col("source")).alias("title"))


@query("style_admissible", r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS b FROM documents)
    SELECT doc_id, b <> '' AND NOT regexp_matches(b, '^\s*/[a-zA-Z]') AND NOT regexp_matches(b, '^\s*https?://\S+\s*$') AND NOT regexp_matches(b, '^\s*```')
        AND NOT (regexp_matches(b, '^\s*(?:/|~/|\./)?[\w./-]+\.\w{1,5}\s*$') AND NOT contains(b, ' '))
        AND length(regexp_replace(b, '[^\p{L}\s]', '', 'g')) / greatest(length(b), 1) >= 0.5 AS admissible FROM t""")
def style_admissible(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.is_style_admissible(F.col("text")).alias("admissible"))


@query("tool_error_flags", f"SELECT conv_id, turn, regexp_matches(text, {sql_text(T.TOOL_ERROR)}) AS tool_error, regexp_matches(text, {sql_text(T.AFFIRMATION)}) AS affirms FROM conversations")
def tool_error_flags(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_tool_error(F.col("text")).alias("tool_error"), T.is_affirmation(F.col("text")).alias("affirms"))


@query("query_terms", f"""WITH q AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM q),
    m AS (SELECT item_id, t, min(p) AS p FROM u WHERE NOT list_contains({STOP}, t) GROUP BY item_id, t), k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY p) <= 24)
    SELECT item_id, array_to_string(w[1:8], ' ') AS legacy_terms, (SELECT string_agg(t, ' ' ORDER BY p) FROM k WHERE k.item_id = q.item_id) AS terms FROM q""")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.legacy_fts_terms(F.col("text")), " ").alias("legacy_terms"), F.array_join(T.fts_terms(F.col("text")), " ").alias("terms"))


@query("source_kinds", "SELECT CASE WHEN url IS NULL OR url = '' THEN 'inline' WHEN regexp_matches(url, '^https?://') THEN 'web' ELSE 'local' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def source_kinds(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.source_kind(F.col("url")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("summary_and_keys", r"""SELECT doc_id, substring(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 1, 80) AS key, sha256(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}\p{Pc}-]+'), ' ')) AS content_key FROM documents""")
def summary_and_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.claim_key(F.col("text"), 80).alias("key"), F.sha2(T.dedupe_text(F.col("text")), 256).alias("content_key"))
