"""Gated retrieval: inventory, BM25, exact cosine, rank fusion with priors, dedupe, budgets, contradictions.

Queries come as a DataFrame (query_id, query): every operator answers a batch of queries in one plan, its statistics are
computed once, and per-query top-k is a window limit that Spark prunes before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evergrain.functions import text as T
from evergrain.functions.scope import ScopeContext, delivery_gate, scope_gate, scope_weight

# Fixed values
K1, B = 1.2, 0.75
RRF_K = 60
MIN_COSINE = 0.15
FEEDBACK = {"helpful": 2.0, "used": 1.0, "irrelevant": -1.5, "ignored": -0.5, "harmful": -4.0}

#: Vectors, and queries, in a block of cosine_topk().
BLOCK_ROWS = 20_000
#: Documents of a partition in which queries' terms are counted.
PART_DOCS = 2_000


def top(df: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ("query_id",), name: str = "rank") -> DataFrame:
    """The first k rows of each query, numbered."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def inventory(beliefs: DataFrame, context: ScopeContext, target: str, cross_scope: bool = False) -> DataFrame:
    """One row: what the scope gate and the delivery gate leave out, and what is eligible."""
    in_scope, deliverable = scope_gate(context, cross_scope), delivery_gate(target)
    count = lambda c, n: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n)
    return beliefs.where("serve and status = 'current'").agg(
        count(~in_scope, "excluded_scope_count"), count(in_scope & ~deliverable, "excluded_delivery_count"), count(in_scope & deliverable, "eligible_count")
    )


def bm25(docs: DataFrame, queries: DataFrame, fields: dict[str, float], doc_id: str = "doc_id", eligible: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """query_id, doc id, score of every document with a query term, and its columns `keep` (of one value for an id).

    Okapi BM25 over weighted fields: term frequencies and lengths are weighted sums, statistics cover all documents and the
    gate applies after them. Query terms are the driver: postings are filtered to them before anything is shuffled, so the
    size of the shuffle follows the matches and not the corpus.
    """
    asked = queries.select("query_id", F.explode(T.fts_terms(F.col("query"))).alias("term"))
    # each field is cut into terms once, below the explode
    measured = docs
    for f in fields:
        measured = measured.withColumn(f"__{f}", T.terms(F.col(f)))
    measured = measured.withColumn("__len", sum((F.size(f"__{f}") * F.lit(w) for f, w in fields.items()), F.lit(0.0)))
    stats = measured.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("__len").alias("avg_len"))
    measured = measured.withColumn("__ok", eligible if eligible is not None else F.lit(True))
    parts = [measured.select(doc_id, "__len", "__ok", *keep, F.explode(f"__{f}").alias("term"), F.lit(w).alias("w")) for f, w in fields.items()]
    postings = parts[0]
    for p in parts[1:]:
        postings = postings.unionByName(p)
    matched = postings.join(asked.select("term").distinct(), "term", "left_semi")
    tf = matched.groupBy("term", doc_id).agg(F.sum("w").alias("tf"), F.first("__len").alias("len"), F.first("__ok").alias("ok"), *[F.first(c).alias(c) for c in keep])
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = tf.where("ok").join(df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return asked.join(weighed.withColumn("part", part), "term").groupBy("query_id", doc_id).agg(F.sum("part").alias("score"), *[F.first(c).alias(c) for c in keep])


def normalised(vector: Column, dims: int | None = None) -> Column:
    """The first dims numbers (all by default), scaled to length 1; a zero vector stays."""
    v = vector if dims is None else F.slice(vector, 1, dims)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """query_id, id, similarity, rank: exact neighbours of a stated query set (query_id, vector) among all vectors.

    Vectors and queries are dealt into blocks, every block of queries meets every block of vectors in a matrix product, and
    only its best k go on. Equal similarities (after rounding to `digits`, where given) go by id. A zero vector is similar to nothing (0).
    """
    n_blocks = max(1, -(-vectors.count() // block))
    n_asked = max(1, -(-queries.count() // block))
    held = vectors.select(F.pmod(F.xxhash64(id_col), F.lit(n_blocks)).alias("vector_block"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(n_asked)).alias("query_block"), "query_id", F.col("vector").cast("array<double>").alias("q"))
    # each side goes to the blocks of the other: rows times blocks, not rows times rows
    left = held.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))).withColumn("query_block", F.col("query_block").cast("long"))
    right = asked.withColumn("vector_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("vector_block", F.col("vector_block").cast("long"))
    query_type, id_type = asked.schema["query_id"].dataType.simpleString(), held.schema["id"].dataType.simpleString()

    def unit(rows) -> np.ndarray:
        m = np.array(rows.tolist(), float).reshape(len(rows), -1)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            vectors = vectors.sort_values("id", kind="stable")
            ids, m = vectors["id"].to_numpy(), unit(vectors["v"])
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                found = unit(part["q"]) @ m.T
                found = found if digits is None else np.round(found, digits)
                best = np.argsort(-found, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), best.shape[1]), "id": ids[best].ravel(), "similarity": np.take_along_axis(found, best, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "similarity": []})

    keys = ("vector_block", "query_block")
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"query_id {query_type}, id {id_type}, similarity double")
    return top(pairs.withColumnRenamed("id", id_col), k, F.desc("similarity"), F.asc(id_col))


def fuse(lexical: DataFrame, dense: DataFrame, id_col: str) -> DataFrame:
    """Weighted reciprocal ranks: 1/(60 + lexical rank) + cosine/(60 + dense rank), cosine from 0.15 on."""
    near = dense.where(F.col("similarity") >= MIN_COSINE).select("query_id", id_col, F.col("rank").alias("dense_rank"), "similarity")
    joined = lexical.select("query_id", id_col, F.col("rank").alias("lexical_rank")).join(near, ["query_id", id_col], "full_outer")
    lex = F.coalesce(1.0 / (RRF_K + F.col("lexical_rank")), F.lit(0.0))
    den = F.coalesce(F.col("similarity") / (RRF_K + F.col("dense_rank")), F.lit(0.0))
    return joined.withColumn("lexical_component", lex).withColumn("dense_component", den).withColumn("rrf", lex + den)


def recency(ts: Column, now: Column) -> Column:
    days = F.greatest((F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(ts))) / 86_400_000_000.0, F.lit(0.0))
    return F.when(F.try_to_timestamp(ts).isNull(), F.lit(0.0)).otherwise(F.exp(-days / 365.0))


def source_quality(attributes: Column) -> Column:
    raw = F.coalesce(F.get_json_object(attributes, "$.source_quality"), F.get_json_object(attributes, "$.quality_score"))
    number = F.coalesce(raw.try_cast("double"), F.lit(0.75))
    return F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))


def prior(weight: Column, confidence: Column, quality: Column, recent: Column) -> Column:
    conf = F.coalesce(confidence, F.lit(0.65))
    return weight * (0.85 + 0.15 * conf) * (0.85 + 0.15 * quality) * (0.99 + 0.01 * recent)


def exact_boost(query: Column, body: Column, belief_id: Column) -> Column:
    q = T.dedupe_text(query)
    inside = F.when((q != "") & T.dedupe_text(body).contains(q), 0.25).otherwise(0.0)
    return inside + F.when(F.lower(query).contains(F.lower(belief_id.cast("string"))), 1.0).otherwise(0.0)


def hybrid_candidates(beliefs: DataFrame, queries: DataFrame, dense: DataFrame | None, context: ScopeContext, now: Column, feedback: DataFrame | None = None,
                      target: str = "local_model", cross_scope: bool = False, limit: int = 12, digits: int | None = None) -> DataFrame:
    """Scored candidates of each query before equal contents are joined: the fused best of both lists with priors, feedback and exact boosts.

    digits rounds scores before they are ranked, so that equal documents stay equal whatever the order of summation.
    """
    many = max(limit * 10, 120)
    exact = lambda c: c if digits is None else F.round(c, digits)
    serving = beliefs.where("serve and status = 'current'")
    gate = scope_gate(context, cross_scope) & delivery_gate(target)
    scored = bm25(serving, queries, {"kind": 0.25, "title": 5.0, "body": 1.0}, "belief_id", gate, ("pinned", "last_compiled_at")).withColumn("score", exact(F.col("score")))
    lexical = top(scored, many, F.desc("score"), F.desc("pinned"), F.desc("last_compiled_at"), F.asc("belief_id"))
    empty = lexical.where("false").withColumn("similarity", F.lit(0.0))
    fused = fuse(lexical, dense if dense is not None else empty, "belief_id")
    rows = fused.join(serving.where(gate), "belief_id").join(queries, "query_id")
    rows = rows.withColumn("scope_weight", scope_weight(context, cross_scope)).where("scope_weight > 0")
    boost = F.lit(0.0)
    if feedback is not None:
        rows = rows.join(feedback.select("belief_id", "feedback_boost"), "belief_id", "left")
        boost = F.coalesce("feedback_boost", F.lit(0.0))
    ranked = prior(F.col("scope_weight"), F.col("confidence"), source_quality(F.col("attributes")), recency(F.col("last_compiled_at"), now))
    score = F.col("rrf") * ranked * (1 + boost) * (1 + exact_boost(F.col("query"), F.col("body"), F.col("belief_id")))
    return rows.withColumn("score", exact(score))


def hybrid(beliefs: DataFrame, queries: DataFrame, dense: DataFrame | None, context: ScopeContext, now: Column, limit: int = 12, **options) -> DataFrame:
    """The ranked answer: query_id, belief_id, score, rank, components. Equal contents count once, the best first."""
    return dedupe_topk(hybrid_candidates(beliefs, queries, dense, context, now, limit=limit, **options), limit, "body", "belief_id")


def hybrid_counters(candidates: DataFrame, answer: DataFrame, queries: DataFrame, inventory_row: DataFrame, has_dense: bool) -> DataFrame:
    """The envelope of each query's answer: mode, candidates by list, what deduplication and the limit left out, and the inventory's counts."""
    found = candidates.groupBy("query_id").agg(F.count("lexical_rank").alias("lexical_candidates"), F.count("dense_rank").alias("dense_candidates"), F.count(F.lit(1)).alias("n"))
    kept = answer.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_items"))
    rows = queries.select("query_id").join(found, "query_id", "left").join(kept, "query_id", "left").na.fill(0)
    rows = rows.withColumn("deduplicated_candidates", F.col("n") - F.col("n_items")).drop("n")
    return rows.withColumn("mode", F.lit("hybrid_rrf" if has_dense else "lexical")).crossJoin(F.broadcast(inventory_row))  # one row


def merge_results(existing: DataFrame, files: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """query_id, belief_id, score, source, rank: scored beliefs, then repository files, then search hits, each object once, by score.

    existing: query_id, belief_id, score; files: query_id, belief_id, rank (from 1); found: query_id, belief_id, rank (from 1), relevance. A
    file's score is 0.95 less 0.03 a rank, 0.7 at least; a hit's 0.6 less 0.02 a rank, 0.21 at least, from a relevance of 0.4 on.
    """
    parts = [existing.select("query_id", "belief_id", F.col("score").cast("double").alias("score"), F.lit("event_core").alias("source"), F.lit(0).alias("__list"))]
    parts.append(files.select("query_id", "belief_id", F.greatest(F.lit(0.7), 0.95 - (F.col("rank") - 1) * 0.03).alias("score"), F.lit("repo_files").alias("source"), F.lit(1).alias("__list")))
    hits = found.where("relevance >= 0.4")
    parts.append(hits.select("query_id", "belief_id", F.greatest(F.lit(0.21), 0.6 - (F.col("rank") - 1) * 0.02).alias("score"), F.lit("fts_repo_fallback").alias("source"), F.lit(2).alias("__list")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    once = rows.groupBy("query_id", "belief_id").agg(F.min_by(F.struct("score", "source"), "__list").alias("x")).select("query_id", "belief_id", F.round("x.score", 6).alias("score"), F.col("x.source").alias("source"))
    return top(once, limit, F.desc("score"), F.asc("belief_id"))


def dedupe_topk(scored: DataFrame, limit: int, text_col: str, id_col: str) -> DataFrame:
    """The best row of each content of a query, then the best `limit` of those."""
    keyed = scored.withColumn("content_key", F.sha2(F.encode(T.dedupe_text(F.col(text_col)), "UTF-8"), 256))
    first = top(keyed, 1, F.desc("score"), F.asc(id_col), by=("query_id", "content_key"), name="__first").drop("__first")
    return top(first, limit, F.desc("score"), F.asc(id_col))


def feedback_scores(uses: DataFrame, items: DataFrame) -> DataFrame:
    """object_id, feedback_boost: the mean of the labelled outcomes of its servings, scaled and bounded."""
    value = F.lit(None).cast("double")
    for name, points in FEEDBACK.items():
        value = F.when(F.col("outcome") == name, points).otherwise(value)
    joined = items.join(uses.select("retrieval_id", "outcome"), "retrieval_id").withColumn("points", value)
    mean = joined.groupBy("object_id").agg(F.avg("points").alias("mean")).where("mean is not null")
    return mean.select("object_id", F.greatest(F.least(F.col("mean") * 0.006, F.lit(0.018)), F.lit(-0.03)).alias("feedback_boost"))


def relevance_of(wanted: Column, found: Column) -> Column:
    """Share of the wanted terms (a set) that occur, and share of the found terms (a list) that are such."""
    n_both = F.size(F.array_intersect(wanted, found))
    # a found term is in both where it is wanted: nothing of the lists' lengths is done again for each term
    density = F.size(F.filter(found, lambda t: F.array_contains(wanted, t))) / F.greatest(F.size(found), F.lit(1))
    return F.when(n_both > 0, n_both / F.size(wanted) + density).otherwise(F.lit(0.0))


def lexical_relevance(query: Column, body: Column) -> Column:
    return relevance_of(T.meaningful_terms(query), T.terms(body))


def lexical_hits(docs: DataFrame, queries: DataFrame, id_col: str = "belief_id", text_col: str = "body", keep: tuple[str, ...] = (), part: int = PART_DOCS) -> DataFrame:
    """query_id, id, relevance of every document that shares a meaningful term with a query, and its columns `keep`: lexical_relevance() from postings.

    Only the queries' terms are kept of the documents, and each is counted in its document before it meets the queries. Documents are dealt by
    id, some `part` to a partition, before they are cut: what is counted of them stays there, so a task's memory does not follow the corpus.
    """
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // part))
    docs = docs.select(id_col, text_col, *keep).repartition(n_parts, id_col)
    asked = queries.select("query_id", T.meaningful_terms(F.col("query")).alias("wanted"))
    asked = asked.select("query_id", F.size("wanted").alias("n_terms"), F.explode("wanted").alias("term"))
    cut = docs.select(id_col, *keep, F.explode(F.array(T.terms(F.col(text_col)))).alias("found"))
    postings = cut.select(id_col, *keep, F.size("found").alias("n_words"), F.explode("found").alias("term"))
    postings = postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy(id_col, *keep, "n_words", "term").agg(F.count(F.lit(1)).alias("tf"))
    hits = postings.join(asked, "term").groupBy("query_id", id_col, *keep, "n_words", "n_terms").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("hits"))
    return hits.select("query_id", id_col, *keep, (F.col("n") / F.col("n_terms") + F.col("hits") / F.col("n_words")).alias("relevance"))


def legacy_search(beliefs: DataFrame, queries: DataFrame, weight: Column, limit: int, digits: int = 6) -> DataFrame:
    """query_id, belief_id, score, rank: relevance * scope weight * confidence, pinned rows 1.1 times, catalogue stubs 0.15 times."""
    factor = weight * F.coalesce("confidence", F.lit(0.5)) * F.when(F.col("pinned"), 1.1).otherwise(1.0) * F.when(T.is_catalog_stub(F.col("body")), 0.15).otherwise(1.0)
    rows = lexical_hits(beliefs.select("belief_id", "body", F.explode(F.array(factor)).alias("factor")), queries, keep=("factor",)).withColumn("score", F.round(F.col("relevance") * F.col("factor"), digits))
    return top(rows.select("query_id", "belief_id", "score"), limit, F.desc("score"), F.asc("belief_id"))


def legacy_score(query: Column, body: Column, weight: Column, confidence: Column, pinned: Column) -> Column:
    return (
        lexical_relevance(query, body) * weight * F.coalesce(confidence, F.lit(0.5))
        * F.when(pinned, 1.1).otherwise(1.0) * F.when(T.is_catalog_stub(body), 0.15).otherwise(1.0)
    )


def contradictions(visible: DataFrame, queries: DataFrame, limit: int = 12, most: int = 200) -> DataFrame:
    """Pairs of visible beliefs that share two terms and differ in negation, best first, per query.

    visible: belief_id, body, scope_weight, confidence and the order column `pos`. As the rule has it, `most` rows that share a term
    with the query (the first of all, where none does) are compared, so a query meets 19,900 pairs at most, whatever the number of beliefs.
    """
    asked = queries.select("query_id", T.meaningful_terms(F.col("query")).alias("wanted"))
    terms = asked.select("query_id", F.explode("wanted").alias("t"))
    # of each term only its first `most` rows can be among a query's: that bounds what meets the queries, however common the term
    held = visible.select("belief_id", "pos", F.explode(T.meaningful_terms(F.col("body"))).alias("t")).join(terms.select("t").distinct(), "t", "left_semi")
    held = top(held, most, F.asc("pos"), by=("t",), name="__nth").drop("__nth")
    hits = top(terms.join(held, "t").select("query_id", "belief_id", "pos").distinct(), most, F.asc("pos"), name="nth").select("query_id", "belief_id", "nth")
    # a query that no row shares a term with takes the first of all rows: one set of `most`
    first = top(visible.select("belief_id", "pos").orderBy("pos").limit(most).withColumn("__one", F.lit(1)), most, F.asc("pos"), by=("__one",), name="nth").select("belief_id", "nth")
    lost = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    chosen = hits.unionByName(lost.crossJoin(F.broadcast(first)))
    # words are cut and joined for the rows chosen only
    body = F.explode(F.array(F.struct(T.meaningful_terms(F.col("body")).alias("words"), T.has_negation(F.col("body")).alias("negated")))).alias("w")
    needed = visible.join(chosen.select("belief_id").distinct(), "belief_id", "left_semi").select("belief_id", "scope_weight", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), body)
    chosen = chosen.join(needed.select("belief_id", "scope_weight", "confidence", "w.words", "w.negated"), "belief_id").join(asked, "query_id")
    rows = chosen.select("query_id", "belief_id", "nth", "scope_weight", "confidence", "words", "negated", "wanted")
    types = {c: rows.schema[c].dataType.simpleString() for c in ("query_id", "belief_id")}

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        """All pairs of a query's rows, `most` at most, by products of their incidence matrices."""
        g = group.sort_values("nth")
        number: dict[str, int] = {}
        cells = [(i, number.setdefault(w, len(number))) for i, words in enumerate(g["words"]) for w in words]
        held = np.zeros((len(g), len(number)), np.float32)
        if cells:
            held[tuple(np.array(cells).T)] = 1
        asked_for = np.zeros(len(number), np.float32)
        asked_for[[number[w] for w in g["wanted"].iat[0] if w in number]] = 1
        shared, in_query, negated = held @ held.T, held * asked_for, g["negated"].to_numpy(bool)
        i, j = np.nonzero(np.triu((shared >= 2) & (negated[:, None] != negated[None, :]), 1))
        either = in_query.sum(1)[i] + in_query.sum(1)[j] - (in_query @ in_query.T)[i, j]
        size, ids = held.sum(1), g["belief_id"].to_numpy()
        n_shared = shared[i, j].astype(np.int64)
        over = either.astype(float) / max(1, len(g["wanted"].iat[0]))
        dense = n_shared / np.maximum(np.minimum(size[i], size[j]), 1).astype(float)
        weight, sure = g["scope_weight"].to_numpy(float), g["confidence"].to_numpy(float)
        score = (1 + over + dense) * np.minimum(weight[i], weight[j]) * np.minimum(sure[i], sure[j])
        return pd.DataFrame({"query_id": np.repeat(g["query_id"].iat[0], len(i)), "belief_id": ids[i], "other_belief_id": ids[j], "n_shared": n_shared, "score": score})

    made = f"query_id {types['query_id']}, belief_id {types['belief_id']}, other_belief_id {types['belief_id']}, n_shared int, score double"
    scored = rows.groupBy("query_id").applyInPandas(pairs, made).withColumn("score", F.round("score", 6))
    return top(scored, limit, F.desc("score"), F.asc("belief_id"), F.asc("other_belief_id"))


def explicit_contradictions(items: DataFrame, most: int = 12) -> DataFrame:
    """Unordered pairs of served items that name each other as contradicting; items: query_id, belief_id, rank, contradicts."""
    named = items.select("query_id", "belief_id", "rank", F.explode("contradicts").alias("other"))
    seen = items.select("query_id", F.col("belief_id").alias("other"))
    pairs = named.join(seen, ["query_id", "other"]).where("belief_id <> other")
    pairs = pairs.groupBy("query_id", F.least("belief_id", "other").alias("a"), F.greatest("belief_id", "other").alias("b")).agg(F.min("rank").alias("first"))
    return top(pairs, most, F.asc("first"), F.asc("a"), F.asc("b"), name="nth")


def budget_prefix(ranked: DataFrame, by: str, order: str, size: Column, most: int, first_always: bool = True) -> DataFrame:
    """Rows in order while their sizes, with one separator each, sum to `most` or less; nothing after the first that does not fit."""
    w = Window.partitionBy(by).orderBy(order)
    run = ranked.withColumn("used", F.sum(size + 1).over(w) - 1).withColumn("nth", F.row_number().over(w))
    fits = F.col("used") <= most
    return run.where(fits | (F.col("nth") == 1)) if first_always else run.where(fits)


def rare_term_gate(docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Best paragraph of each file for a query, of files that have one of the query's two rarest terms.

    Paragraphs of 60 to 20,000 characters, a heading joined to what follows it; two query terms must occur in a paragraph
    where the query has three or more.
    """
    words = docs.select("path", F.explode(T.meaningful_terms(F.col("text"))).alias("term"))
    cut_queries = queries.select("query_id", T.meaningful_terms(F.col("query")).alias("wanted"))
    asked = cut_queries.select("query_id", "wanted", F.explode("wanted").alias("term"))
    df = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counted = asked.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    present = F.sum((F.col("df") > 0).cast("int")).over(Window.partitionBy("query_id"))
    pool = counted.withColumn("present", present).where((F.col("present") < 3) | (F.col("df") > 0))
    rarest = top(pool, 2, F.asc("df"), F.asc("term"), name="nth")
    files = rarest.join(words, "term").select("query_id", "wanted", "path").distinct()
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), T.strip), lambda p: p != "")
    cut = docs.select("path", F.posexplode(parts).alias("nth", "para")).withColumn("next", F.lead("para").over(Window.partitionBy("path").orderBy("nth")))
    heading = F.col("para").rlike(r"^#{1,4}\s")
    chunk = F.when(heading & F.col("next").isNotNull(), F.concat_ws("\n\n", "para", "next")).when(~heading, F.col("para"))
    # terms are cut once for each chunk, before it meets its queries
    chunks = cut.select("path", "nth", chunk.alias("chunk")).where("chunk is not null and length(chunk) between 60 and 20000").withColumn("found", T.terms(F.col("chunk")))
    found = files.join(chunks, "path")
    overlap = F.size(F.array_intersect("wanted", "found"))
    found = found.where(overlap >= F.when(F.size("wanted") >= 3, 2).otherwise(1)).withColumn("score", relevance_of(F.col("wanted"), F.col("found")))
    best = top(found, 1, F.desc("score"), F.asc("nth"), by=("query_id", "path"), name="__one").drop("__one")
    shown = F.element_at(F.transform(F.array(F.substring(T.redact_secrets(F.col("chunk")), 1, 1200)), lambda s: F.struct(s.alias("snippet"), F.size(T.injections(s)).alias("n_bad"))), 1)
    best = best.withColumn("shown", shown).where("shown.n_bad = 0").withColumn("snippet", F.col("shown.snippet"))
    return top(best, limit, F.desc("score"), F.asc("path")).withColumn("merged_score", F.greatest(F.lit(0.7), 0.95 - (F.col("rank") - 1) * 0.03))


def blend(lexical: Column, semantic: Column, alpha: float = 0.5) -> Column:
    return alpha * F.coalesce(lexical, F.lit(0.0)) + (1 - alpha) * F.coalesce(semantic, F.lit(0.0))


def source_handles(items: DataFrame, evidence: DataFrame, per_item: int = 3) -> DataFrame:
    """Content-addressed handles of served items: handle_id over belief, evidence and its content hash; the first few of an item."""
    from evergrain.functions.ids import content_hash, stable_id

    rows = items.select("query_id", "belief_id", F.posexplode("evidence_ids").alias("nth", "evidence_id")).join(evidence.select("evidence_id", F.col("body").alias("source")), "evidence_id")
    rows = rows.withColumn("source_hash", content_hash(F.col("source"))).withColumn("handle_id", stable_id("src", F.col("belief_id"), F.col("evidence_id"), F.col("source_hash")))
    return top(rows, per_item, F.asc("nth"), by=("query_id", "belief_id"), name="slot")


def expand_handles(handles: DataFrame, evidence: DataFrame, context: ScopeContext, target: str, max_chars: int = 4000) -> DataFrame:
    """Sources of issued handles, authorised anew: the evidence must still pass the gates and have the same content."""
    from evergrain.functions.ids import content_hash

    live = evidence.where(scope_gate(context) & delivery_gate(target)).select("evidence_id", F.col("body").alias("live"))
    joined = handles.join(live, "evidence_id", "left")
    state = F.when(F.col("live").isNull(), "denied").when(content_hash(F.col("live")) != F.col("source_hash"), "changed").otherwise("ok")
    return joined.withColumn("state", state).withColumn("excerpt", F.when(state == "ok", F.substring("live", 1, max_chars)))


def evaluate_cases(cases: DataFrame, items: DataFrame) -> DataFrame:
    """id, runtime, passed, top5, forbidden_free, in_scope, cited, fast, latency_ms of each benchmark case.

    cases: id, runtime, kind (positive, negative, injection), top_k, expected_any and forbidden (arrays), latency_ms, max_latency_ms (1,500). items: id, rank,
    body, score, scope_weight, evidence_ids. A positive case needs one of its expected words in a body, a negative one no
    item of score 0.2 or more, an injection case no body with an injection. Words match in any case.
    """
    asked = cases.withColumn("kind", F.coalesce("kind", F.lit("positive"))).withColumn("most", F.greatest(F.lit(1), F.least(F.coalesce("top_k", F.lit(5)), F.lit(20))))
    rows = items.join(asked.select("id", "kind", "most", "expected_any", "forbidden"), "id").where("rank <= most")
    has = lambda words: F.coalesce(F.exists(words, lambda w: F.lower("body").contains(F.lower(w))), F.lit(False))
    injected = F.when(F.col("kind") == "injection", F.size(T.injections(F.col("body"))) > 0).otherwise(F.lit(False))
    found = rows.groupBy("id").agg(
        F.max(has("expected_any")).alias("hit"), F.max(has("forbidden")).alias("bad"), F.max("score").alias("best"), F.max(injected).alias("injected"),
        F.min("scope_weight").alias("least_weight"), F.min(F.coalesce(F.size("evidence_ids"), F.lit(0))).alias("least_cited"),
    )
    joined = asked.join(found, "id", "left")
    top5 = F.when(F.col("kind") == "positive", F.coalesce("hit", F.lit(False))).when(F.col("kind") == "negative", F.coalesce(F.col("best") < 0.2, F.lit(True))).when(F.col("kind") == "injection", ~F.coalesce("injected", F.lit(False))).otherwise(F.lit(True))
    parts = joined.select(
        "id", "runtime", top5.alias("top5"), (~F.coalesce("bad", F.lit(False))).alias("forbidden_free"), F.coalesce(F.col("least_weight") > 0, F.lit(True)).alias("in_scope"),
        F.coalesce(F.col("least_cited") > 0, F.lit(True)).alias("cited"), (F.col("latency_ms") <= F.coalesce("max_latency_ms", F.lit(1500))).alias("fast"), "latency_ms",
    )
    return parts.withColumn("passed", F.col("top5") & F.col("forbidden_free") & F.col("in_scope") & F.col("cited") & F.col("fast"))


def benchmark_report(cases: DataFrame) -> DataFrame:
    """cases: runtime, passed, top5, cited, in_scope, latency_ms -> rates overall and by runtime (grouping sets)."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate")
    return cases.rollup("runtime").agg(F.count(F.lit(1)).alias("n_cases"), rate("passed"), rate("top5"), rate("cited"), rate("in_scope"), F.avg("latency_ms").alias("latency_mean"), F.max("latency_ms").alias("latency_max"))


def egress_preview(beliefs: DataFrame, context: ScopeContext, target: str, needle: str | None = None, sample: int = 50) -> DataFrame:
    """What a delivery would send: allowed rows, redacted, with a payload hash; the first `sample` by id."""
    from evergrain.functions.ids import content_hash
    from evergrain.functions.scope import egress

    rows = beliefs.withColumn("egress", egress(context, target)).where("egress.allowed")
    rows = rows if not needle else rows.where(F.lower("body").contains(needle.lower()))
    rows = rows.withColumn("redacted", T.redact_secrets(F.col("body"))).withColumn("payload_hash", content_hash(F.col("redacted")))
    return rows.orderBy("belief_id").limit(sample).select("belief_id", "redacted", "payload_hash")
