"""Registered queries over kept state: the inverted index, the beliefs' histories, and the vector cells."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrain.functions import scope as S
from evergrain.functions import text as T
from evergrain.operators import admin, digests, patterns, retrieval
from evergrain.operators.history import BeliefStore
from evergrain.operators.index import SearchIndex
from evergrain.operators.vectors import VectorStore
from evergrain.session import table
from evergrain.sources.store import shared_folder

from . import views as V
from .catalog import BM25_SQL
from .queries_log import APPROVED, RICH
from .queries_retrieval import HYBRID, _beliefs
from .registry import CONTEXT, WORDS, now, query

GATE_COLUMNS = ("scope_type", "scope_id", "visibility", "egress_policy")


def _state_of(spark: SparkSession, path: str) -> str:
    """What tells a stored table from its later states: number, bytes and times of its files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.getContentSummary(where)
    return f"{path} {held.getFileCount()} {held.getLength()} {fs.getFileStatus(where).getModificationTime()}"


def _kept_root(spark: SparkSession, name: str, path: str) -> str:
    """The folder of what is kept of a table as it is now: the next call finds it there."""
    return f"{shared_folder(spark)}/evergrain-kept/{name}-{hashlib.sha256(_state_of(spark, path).encode()).hexdigest()[:24]}"


def _fresh_root(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/evergrain-kept/{name}-{uuid.uuid4().hex}"


# ---- the inverted index ---------------------------------------------------------------------------------------------


def belief_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index over the bodies of all beliefs, built where none is kept of the table's present state."""
    kept = SearchIndex(spark, _kept_root(spark, "bm25-cut-by-shard", f"{sf_dir}/documents.parquet"), {"body": 1.0}, "belief_id", GATE_COLUMNS)
    if kept.store.current() is None:
        kept.build(V.beliefs(spark, sf_dir))
    return kept


BEST_TEN = " SELECT query_id, belief_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, belief_id) AS rank FROM sc QUALIFY rank <= 10"


@query("indexed_bm25_topk", BM25_SQL + BEST_TEN)
def indexed_bm25_topk(spark, sf_dir):
    """bm25_topk from the kept index."""
    return belief_index(spark, sf_dir).search(V.benchmark_queries(spark, sf_dir), 10, S.scope_gate(CONTEXT), digits=6)


@query("indexed_after_changes", BM25_SQL.replace("FROM documents\n)", "FROM documents WHERE doc_id % 50 <> 7\n)") + BEST_TEN)
def indexed_after_changes(spark, sf_dir):
    """An index of all beliefs, a tenth of them with another body, after these have changed and a fiftieth has gone."""
    docs, k = V.beliefs(spark, sf_dir), F.col("belief_id")
    kept = SearchIndex(spark, _fresh_root(spark, "bm25-changed"), {"body": 1.0}, "belief_id", GATE_COLUMNS, buckets=16)
    kept.build(docs.withColumn("body", F.when(k % 10 == 3, F.concat(F.reverse("body"), F.lit(" the earlier text"))).otherwise(F.col("body"))))
    kept.update(docs.where(k % 10 == 3).where(k % 50 != 7), docs.where(k % 50 == 7).select("belief_id"))
    return kept.search(V.benchmark_queries(spark, sf_dir), 10, S.scope_gate(CONTEXT), digits=6)


# ---- histories ------------------------------------------------------------------------------------------------------


@query("stored_fold", APPROVED + """ SELECT 'bel_'||user_id AS belief_id, 'v'||prop AS body, CASE WHEN tomb IS NULL AND wrong IS NULL THEN 'current' WHEN coalesce(tomb,-1) > coalesce(wrong,-1) THEN 'tombstoned' ELSE 'retracted' END AS status FROM t""")
def stored_fold(spark, sf_dir):
    """Beliefs kept after half of the log and folded on from their buckets' histories."""
    events = V.event_log(spark, sf_dir).withColumn("event_hash", F.col("id"))
    half = events.agg((F.max("event_seq") / 2).cast("long")).first()[0]
    kept = BeliefStore(spark, _fresh_root(spark, "beliefs"), buckets=16)
    kept.advance(events.where(F.col("event_seq") <= half))
    kept.advance(events)
    return kept.beliefs().select("belief_id", "body", "status")


@query("stored_fold_all_operations", RICH)
def stored_fold_all_operations(spark, sf_dir):
    """Every operation, with the last hundredth of the log folded on in a step of its own."""
    events = V.varied_log(spark, sf_dir).withColumn("event_hash", F.col("id"))
    last = events.agg((F.max("event_seq") * 0.99).cast("long")).first()[0]
    kept = BeliefStore(spark, _fresh_root(spark, "beliefs-varied"), buckets=16)
    kept.advance(events.where(F.col("event_seq") <= last))
    kept.step(events.where(F.col("event_seq") > last))
    return kept.beliefs().select("belief_id", "body", "status", "pinned", F.round("confidence", 6).alias("confidence"), "scope_id", F.size("evidence_ids").alias("n_evidence"), "last_event_id")


# ---- vectors --------------------------------------------------------------------------------------------------------


def vector_cells(spark: SparkSession, sf_dir: str) -> VectorStore:
    """The cells of all embeddings, built where none are kept of the table's present state."""
    kept = VectorStore(spark, _kept_root(spark, "cells", f"{sf_dir}/embeddings.parquet"))
    if kept.store.current() is None:
        kept.build(table(spark, sf_dir, "embeddings"))
    return kept


@query("cell_neighbours", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0),
    p AS (SELECT query_id, vec_id, round(list_dot_product(e, qe)/(sqrt(list_dot_product(e,e))*sqrt(list_dot_product(qe,qe))), 6) AS similarity FROM v CROSS JOIN q)
    SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p QUALIFY rank <= 5""")
def cell_neighbours(spark, sf_dir):
    """cosine_topk from the kept cells: the rows whose id is divisible by 20 against all rows."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_cells(spark, sf_dir).neighbours(asked, 5, digits=6)


_DENSE = """dn AS (SELECT item_id AS query_id, v.vec_id AS belief_id, round(list_dot_product(v.e, qv.e)/(sqrt(list_dot_product(v.e,v.e))*sqrt(list_dot_product(qv.e,qv.e))), 6) AS c
        FROM benchmark JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) qv ON qv.vec_id = item_id CROSS JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v JOIN d ON d.belief_id = v.vec_id AND d.ok),"""
_STAND_IN = HYBRID[HYBRID.index("dn AS (") : HYBRID.index("dr AS (")]


@query("hybrid_with_vectors", HYBRID.replace(_STAND_IN, _DENSE + "\n    ") + " SELECT query_id, belief_id, score::DOUBLE AS score, rank FROM a")
def hybrid_with_vectors(spark, sf_dir):
    """Lexical ranks fused with exact neighbours among eligible beliefs: a belief's vector has its id, a question's the question's."""
    beliefs, asked = _beliefs(spark, sf_dir), V.benchmark_queries(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    eligible = beliefs.where(S.scope_gate(CONTEXT) & S.delivery_gate("local_model")).select("belief_id")
    dense = vector_cells(spark, sf_dir).neighbours(asked.select("query_id").join(vectors, "query_id"), 120, eligible, "belief_id", digits=6)
    return retrieval.hybrid(beliefs, asked, dense, CONTEXT, now(), digits=8).select("query_id", "belief_id", "score", "rank")


# ---- many patterns, snippets, digests -------------------------------------------------------------------------------

_PAIRS = f"""w AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark), p AS (SELECT DISTINCT pattern FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pattern FROM w))"""


def _word_pairs(spark, sf_dir):
    """All pairs of neighbouring words of the benchmark's texts as patterns."""
    words = table(spark, sf_dir, "benchmark").select(T.terms(F.col("text")).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1)))
    return words.where(F.size("w") > 1).select(F.explode(pairs).alias("pattern")).distinct()


@query("denied_counts", f"WITH {_PAIRS} SELECT doc_id, count(*) AS n_patterns FROM documents JOIN p ON contains(lower(text), pattern) GROUP BY doc_id")
def denied_counts(spark, sf_dir):
    """How many of some thousand patterns, taken from a table, occur in each document."""
    return admin.denied_counts(table(spark, sf_dir, "documents"), "doc_id", "text", _word_pairs(spark, sf_dir))


@query("pattern_places", f"WITH {_PAIRS}, f AS (SELECT doc_id, pattern, lower(text) AS t FROM documents JOIN p ON contains(lower(text), pattern)) SELECT doc_id, pattern, instr(t, pattern) - 1 AS first_at FROM f")
def pattern_places(spark, sf_dir):
    """Every occurrence of the patterns, overlapping ones too; the first of each pattern in a document."""
    found = patterns.matches(table(spark, sf_dir, "documents"), "doc_id", "text", _word_pairs(spark, sf_dir), longest=False)
    return found.groupBy("doc_id", "pattern").agg(F.min("start").alias("first_at"))


@query("ranked_snippets", BM25_SQL + f""", hit AS (SELECT query_id, belief_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, belief_id) AS rank FROM sc QUALIFY rank <= 3),
    qw AS (SELECT query_id, list(term) AS terms FROM q GROUP BY 1), sb AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[\\s\\x0B\\x{{85}}\\x{{A0}}]+', ' ', 'g')), ' ') AS parts FROM documents),
    sc2 AS (SELECT *, list_transform(parts, lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}_-]', '', 'g')) AS bare FROM sb),
    sh AS (SELECT query_id, belief_id, rank, terms, parts, bare, list_filter(range(1, len(bare) + 1), lambda i: list_contains(terms, bare[i])) AS places FROM hit JOIN qw USING (query_id) JOIN sc2 ON doc_id = belief_id),
    sn AS (SELECT *, list_transform(places, lambda i: len(list_distinct(list_filter(list_slice(bare, i, i + 11), lambda x: list_contains(terms, x))))) AS n_terms FROM sh),
    sg AS (SELECT *, coalesce(places[list_position(n_terms, list_max(n_terms))], 1) AS g FROM sn)
    SELECT query_id, rank, belief_id, CASE WHEN g > 1 THEN '…' ELSE '' END || array_to_string(list_transform(range(g, least(g + 12, len(parts) + 1)), lambda i: CASE WHEN list_contains(terms, bare[i]) THEN '[' || parts[i] || ']' ELSE parts[i] END), ' ')
        || CASE WHEN g + 11 < len(parts) THEN '…' ELSE '' END AS snippet FROM sg""")
def ranked_snippets(spark, sf_dir):
    """The three best beliefs of each question from the kept index, with the window that holds most of its terms."""
    asked = V.benchmark_queries(spark, sf_dir)
    found = belief_index(spark, sf_dir).search(asked, 3, S.scope_gate(CONTEXT), digits=6)
    rows = found.join(asked.select("query_id", T.fts_terms(F.col("query")).alias("terms")), "query_id").join(V.beliefs(spark, sf_dir).select("belief_id", "body"), "belief_id")
    rows = V.dealt(rows.select("query_id", "rank", "belief_id", "body", "terms"))  # long texts, few of them
    return rows.select("query_id", "rank", "belief_id", admin.best_snippet(F.col("body"), F.col("terms")).alias("snippet"))


@query("table_differences", """SELECT o_orderkey, CASE o_orderkey % 1000 WHEN 7 THEN 'changed' WHEN 33 THEN 'missing' ELSE 'added' END AS state FROM orders WHERE o_orderkey % 1000 IN (7, 33) UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 1000 = 66""")
def table_differences(spark, sf_dir):
    """Orders against a copy in which few rows have changed, gone or come, found through the ranges of their keys."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    copy = orders.where(k % 1000 != 33).withColumn("o_totalprice", F.when(k % 1000 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    copy = copy.unionByName(orders.where(k % 1000 == 66).withColumn("o_orderkey", -k))
    return digests.differences(orders, copy, "o_orderkey")


@query("table_digest_of_a_copy", "SELECT count(*) AS n_rows, true AS equal, false AS changed_equal FROM orders")
def table_digest_of_a_copy(spark, sf_dir):
    """The digest in key order of orders and of the same rows dealt anew, and of a copy with one row changed."""
    orders = table(spark, sf_dir, "orders")
    cuts = digests.bounds(orders, "o_orderkey")
    last = lambda df: digests.tree(df, "o_orderkey", cuts).orderBy(F.desc("level")).limit(1).select("n_rows", "digest")
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == F.lit(1), -1.0).otherwise(F.col("o_totalprice")))
    a, b, c = last(orders), last(orders.repartition(7, "o_custkey")), last(changed)
    both = a.crossJoin(F.broadcast(b.select(F.col("digest").alias("x")))).crossJoin(F.broadcast(c.select(F.col("digest").alias("y"))))  # one row each
    return both.select("n_rows", (F.col("digest") == F.col("x")).alias("equal"), (F.col("digest") == F.col("y")).alias("changed_equal"))
