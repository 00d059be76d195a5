"""Registered queries of retrieval, packets and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from evergrain.functions import scope as S
from evergrain.operators import admin, packet, retrieval
from evergrain.session import table

from . import views as V
from .registry import CONTEXT, IDS, MEANING_STOP, STOP, WEIGHT, WORDS, now, query

# ---- the main read path ---------------------------------------------------------------------------------------------


def _beliefs(spark, sf_dir):
    """beliefs with titles, kinds, times and attributes of their own."""
    k = F.col("belief_id")
    at = F.date_format(F.expr("timestamp '2029-12-31' - make_dt_interval(cast(belief_id % 700 as int))"), "yyyy-MM-dd HH:mm:ss")
    quality = F.when(k % 3 == 0, F.concat(F.lit('{"source_quality": '), ((k % 5) / 4.0).cast("string"), F.lit("}"))).otherwise("{}")
    return V.beliefs(spark, sf_dir).withColumn("title", F.col("source")).withColumn("kind", F.lit("note")).withColumn("last_compiled_at", at).withColumn("attributes", quality)


def _dense(spark, sf_dir):
    """A stand-in for a dense index: each query is near the documents of its residue."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("belief_id"), (0.9 - (F.col("doc_id") % 100) / 100.0).alias("similarity"), (F.col("doc_id") % 40).alias("k"))
    q = V.benchmark_queries(spark, sf_dir)
    return retrieval.top(q.select("query_id", (F.col("query_id") % 40).alias("k")).join(d, "k"), 120, F.desc("similarity"), F.asc("belief_id"))


HYBRID = f"""WITH {V.BELIEFS_SQL},
    q0 AS (SELECT item_id AS query_id, {WORDS.format('text')} AS w FROM benchmark), q1 AS (SELECT query_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM q0),
    q2 AS (SELECT query_id, term, min(pos) AS pos FROM q1 WHERE NOT list_contains({STOP}, term) GROUP BY ALL), q AS (SELECT query_id, term FROM q2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 24),
    d AS (SELECT belief_id, (scope_type='global' OR scope_id IN {IDS}) AND egress_policy <> 'prohibited' AS ok, {WORDS.format('body')} AS w, {WORDS.format('source')} AS tw FROM beliefs),
    l AS (SELECT *, 0.25 + 5.0*len(tw) + len(w) AS l FROM d), s AS (SELECT count(*) AS n, avg(l) AS al FROM l),
    p AS (SELECT belief_id, ok, l, unnest(w) AS term, 1.0 AS f FROM l UNION ALL SELECT belief_id, ok, l, unnest(tw), 5.0 FROM l UNION ALL SELECT belief_id, ok, l, 'note', 0.25 FROM l),
    tf AS (SELECT belief_id, ok, l, term, sum(f) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    sc AS (SELECT query_id, belief_id, round(sum(greatest(ln((n-df+0.5)/(df+0.5)),1e-6)*tf*2.2/(tf+1.2*(0.25+0.75*l/al))),8) AS score FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN s WHERE ok GROUP BY ALL),
    lx AS (SELECT query_id, belief_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, belief_id%11=0 DESC, TIMESTAMP '2029-12-31' - INTERVAL 1 DAY * (belief_id%700) DESC, belief_id) AS lr FROM sc QUALIFY lr <= 120),
    dn AS (SELECT item_id AS query_id, doc_id AS belief_id, 0.9 - (doc_id % 100)/100.0 AS c FROM benchmark JOIN documents ON documents.doc_id % 40 = item_id % 40),
    dr AS (SELECT query_id, belief_id, c, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, belief_id) AS r FROM dn), de AS (SELECT * FROM dr WHERE c >= 0.15 AND r <= 120),
    f AS (SELECT coalesce(lx.query_id, de.query_id) AS query_id, coalesce(lx.belief_id, de.belief_id) AS belief_id, lr, r, coalesce(1.0/(60+lr),0)+coalesce(c/(60+r),0) AS rrf FROM lx FULL JOIN de ON lx.query_id=de.query_id AND lx.belief_id=de.belief_id),
    norm AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(coalesce(text,'')), '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}-]+'), ' ') AS t FROM documents), qn AS (SELECT item_id, lower(text) AS raw, array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}-]+'), ' ') AS t FROM benchmark),
    w AS (SELECT f.*, norm.t AS body, {WEIGHT.format(unscoped='0.0', other='0.0')} AS weight, b.confidence, CASE WHEN f.belief_id%3=0 THEN (f.belief_id%5)/4.0 ELSE 0.75 END AS quality, exp(-(1 + f.belief_id%700)/365.0) AS recent,
        CASE WHEN qn.t <> '' AND contains(norm.t, qn.t) THEN 0.25 ELSE 0 END + CASE WHEN contains(qn.raw, f.belief_id::VARCHAR) THEN 1.0 ELSE 0 END AS exact
        FROM f JOIN beliefs b USING (belief_id) JOIN d USING (belief_id) JOIN norm ON norm.doc_id = f.belief_id JOIN qn ON qn.item_id = f.query_id WHERE d.ok),
    c AS (SELECT *, round(rrf * weight*(0.85+0.15*confidence)*(0.85+0.15*quality)*(0.99+0.01*recent) * (1 + exact), 8) AS score FROM w WHERE weight > 0),
    u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, body ORDER BY score DESC, belief_id) = 1), a AS (SELECT query_id, belief_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, belief_id) AS rank FROM u QUALIFY rank <= 12)"""


@query("hybrid_search", HYBRID + " SELECT query_id, belief_id, score::DOUBLE AS score, rank FROM a")
def hybrid_search(spark, sf_dir):
    found = retrieval.hybrid(_beliefs(spark, sf_dir), V.benchmark_queries(spark, sf_dir), _dense(spark, sf_dir), CONTEXT, now(), digits=8)
    return found.select("query_id", "belief_id", "score", "rank")


@query("hybrid_envelope", HYBRID + f""", n AS (SELECT query_id, count(lr) AS lexical_candidates, count(r) AS dense_candidates, count(*) AS n FROM c GROUP BY 1), i AS (SELECT query_id, count(*) AS n_items FROM a GROUP BY 1),
    v AS (SELECT scope_type='global' OR scope_id IN {IDS} AS s, egress_policy<>'prohibited' AS d FROM beliefs), g AS (SELECT count(*) FILTER (NOT s) AS excluded_scope_count, count(*) FILTER (s AND NOT d) AS excluded_delivery_count, count(*) FILTER (s AND d) AS eligible_count FROM v)
    SELECT item_id AS query_id, coalesce(lexical_candidates, 0) AS lexical_candidates, coalesce(dense_candidates, 0) AS dense_candidates, coalesce(n_items, 0) AS n_items, coalesce(n, 0) - coalesce(n_items, 0) AS deduplicated_candidates, 'hybrid_rrf' AS mode, g.* FROM benchmark LEFT JOIN n ON n.query_id = item_id LEFT JOIN i ON i.query_id = item_id CROSS JOIN g""")
def hybrid_envelope(spark, sf_dir):
    b, q = _beliefs(spark, sf_dir), V.benchmark_queries(spark, sf_dir)
    found = retrieval.hybrid_candidates(b, q, _dense(spark, sf_dir), CONTEXT, now(), digits=8)
    return retrieval.hybrid_counters(found, retrieval.dedupe_topk(found, 12, "body", "belief_id"), q, retrieval.inventory(b, CONTEXT, "local_model"), True)


@query("hybrid_prior_parts", f"""WITH {V.BELIEFS_SQL}, t AS (SELECT belief_id, confidence, {WEIGHT.format(unscoped='0.05', other='0.15')} AS w FROM beliefs)
    SELECT belief_id, round(w*(0.85+0.15*confidence)*(0.85+0.15*CASE WHEN belief_id%3=0 THEN (belief_id%5)/4.0 ELSE 0.75 END)*(0.99+0.01*CASE WHEN belief_id%9=0 THEN 0 ELSE exp(-(1 + belief_id%700)/365.0) END), 6)::DOUBLE AS prior FROM t""")
def hybrid_prior_parts(spark, sf_dir):
    """Qualities from attributes and recency from times; a bad time counts as 0."""
    b = _beliefs(spark, sf_dir).withColumn("last_compiled_at", F.when(F.col("belief_id") % 9 == 0, "long ago").otherwise(F.col("last_compiled_at")))
    found = retrieval.prior(S.scope_weight(CONTEXT, True), F.col("confidence"), retrieval.source_quality(F.col("attributes")), retrieval.recency(F.col("last_compiled_at"), now()))
    return b.select("belief_id", F.round(found, 6).alias("prior"))


@query("exact_boosts", r"""WITH n AS (SELECT doc_id, text, array_to_string(regexp_extract_all(lower(coalesce(text,'')), '[\p{L}\p{M}\p{N}\p{Pc}-]+'), ' ') AS t FROM documents)
    SELECT doc_id, (CASE WHEN contains(t, 'the') THEN 0.25 ELSE 0 END + CASE WHEN contains('the note 7 and 12', doc_id::VARCHAR) THEN 1.0 ELSE 0 END)::DOUBLE AS boost FROM n""")
def exact_boosts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    boost = retrieval.exact_boost(F.lit("THE"), F.col("text"), F.lit("-")) + retrieval.exact_boost(F.lit("the note 7 and 12"), F.lit(""), F.col("doc_id"))
    return d.select("doc_id", boost.alias("boost"))


@query("legacy_search_scoped", f"""WITH {V.BELIEFS_SQL}, q AS (SELECT item_id AS query_id, list_filter(list_distinct({WORDS.format('text')}), lambda x: NOT list_contains({MEANING_STOP}, x)) AS qw FROM benchmark),
    qt AS (SELECT query_id, unnest(qw) AS term FROM q), b AS (SELECT belief_id, confidence, pinned, {WEIGHT.format(unscoped='0.05', other='0.15')} AS weight, belief_id%6=0 AS stub, CASE WHEN belief_id%6=0 THEN 'the river notes /Users/me/file'||belief_id||'.md' ELSE body END AS body FROM beliefs),
    d AS (SELECT *, {WORDS.format('body')} AS w FROM b), p AS (SELECT belief_id, unnest(w) AS term FROM d), m AS (SELECT query_id, belief_id, count(*) AS hits, count(DISTINCT term) AS n FROM qt JOIN p USING (term) GROUP BY ALL),
    sc AS (SELECT query_id, belief_id, round((n/len(qw) + hits/len(w)) * weight * confidence * CASE WHEN pinned THEN 1.1 ELSE 1.0 END * CASE WHEN stub THEN 0.15 ELSE 1.0 END, 6) AS score FROM m JOIN q USING (query_id) JOIN d USING (belief_id))
    SELECT query_id, belief_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, belief_id) AS rank FROM sc QUALIFY rank <= 20""")
def legacy_search_scoped(spark, sf_dir):
    """Every sixth belief is a catalogue stub; weights are those of a search across scopes."""
    k = F.col("belief_id")
    b = V.beliefs(spark, sf_dir).withColumn("body", F.when(k % 6 == 0, F.concat(F.lit("the river notes /Users/me/file"), k.cast("string"), F.lit(".md"))).otherwise(F.col("body")))
    return retrieval.legacy_search(b, V.benchmark_queries(spark, sf_dir), S.scope_weight(CONTEXT, True), 20)


@query("repo_merge", """WITH e AS (SELECT item_id AS q, 'b'||(item_id%7) AS id, 0.5 + (item_id%5)/10.0 AS score FROM benchmark), f AS (SELECT item_id AS q, 'b'||(item_id%7 + n) AS id, n + 1 AS r FROM benchmark, range(0, 12) t(n)), h AS (SELECT item_id AS q, 'h'||n AS id, n + 1 AS r, (n%5)/5.0 AS rel FROM benchmark, range(0, 30) t(n)),
    u AS (SELECT q, id, score, 'event_core' AS source, 0 AS l FROM e UNION ALL SELECT q, id, greatest(0.7, 0.95 - (r-1)*0.03), 'repo_files', 1 FROM f UNION ALL SELECT q, id, greatest(0.21, 0.6 - (r-1)*0.02), 'fts_repo_fallback', 2 FROM h WHERE rel >= 0.4),
    o AS (SELECT q, id, round(arg_min(score, l), 6) AS score, arg_min(source, l) AS source FROM u GROUP BY ALL)
    SELECT q AS query_id, id AS belief_id, score::DOUBLE AS score, source, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM o QUALIFY rank <= 15""")
def repo_merge(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    name = lambda head, c: F.concat(F.lit(head), c.cast("string")).alias("belief_id")
    core = b.select("query_id", name("b", F.col("query_id") % 7), (0.5 + (F.col("query_id") % 5) / 10.0).alias("score"))
    files = b.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("n")).select("query_id", name("b", F.col("query_id") % 7 + F.col("n")), (F.col("n") + 1).alias("rank"))
    hits = b.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("n")).select("query_id", name("h", F.col("n")), (F.col("n") + 1).alias("rank"), ((F.col("n") % 5) / 5.0).alias("relevance"))
    return retrieval.merge_results(core, files, hits, 15)


@query("explicit_contradiction_pairs", """WITH i AS (SELECT user_id AS q, event_id AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events), n AS (SELECT q, b, rank, unnest([b + 3, b - 5, b]) AS other FROM i),
    p AS (SELECT n.q, least(n.b, n.other) AS a, greatest(n.b, n.other) AS b, min(n.rank) AS first FROM n JOIN i s ON s.q = n.q AND s.b = n.other WHERE n.b <> n.other GROUP BY ALL)
    SELECT q AS query_id, a, b, row_number() OVER (PARTITION BY q ORDER BY first, a, b) AS nth FROM p QUALIFY nth <= 12""")
def explicit_contradiction_pairs(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    items = e.select(F.col("user_id").alias("query_id"), k.alias("belief_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"), F.array(k + 3, k - 5, k).alias("contradicts"))
    return retrieval.explicit_contradictions(items).select("query_id", "a", "b", "nth")


@query("source_handles", """WITH i AS (SELECT item_id AS q, item_id*10 AS b, n, item_id*3 + n AS e FROM benchmark, range(0, 5) t(n)), j AS (SELECT q, b, n, doc_id, sha256(text) AS h FROM i JOIN documents ON doc_id = e)
    SELECT q AS query_id, b AS belief_id, doc_id AS evidence_id, 'src_'||substring(sha256(b||chr(0)||doc_id||chr(0)||h||chr(0)), 1, 16) AS handle_id, row_number() OVER (PARTITION BY q, b ORDER BY n) AS slot FROM j QUALIFY slot <= 3""")
def source_handles(spark, sf_dir):
    k = F.col("item_id")
    items = table(spark, sf_dir, "benchmark").select(k.alias("query_id"), (k * 10).alias("belief_id"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda n: k * 3 + n).alias("evidence_ids"))
    evidence = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("body"))
    return retrieval.source_handles(items, evidence).select("query_id", "belief_id", "evidence_id", "handle_id", "slot")


@query("benchmark_rates", """WITH c AS (SELECT CASE o_orderkey%3 WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'three' END AS runtime, o_orderkey%2=0 AS passed, o_orderkey%5<>0 AS top5, o_orderkey%7<>0 AS cited, o_orderkey%11<>0 AS in_scope, o_orderkey%100 AS ms FROM orders)
    SELECT runtime, count(*) AS n_cases, round(avg(passed::INT), 6) AS passed_rate, round(avg(top5::INT), 6) AS top5_rate, round(avg(cited::INT), 6) AS cited_rate, round(avg(in_scope::INT), 6) AS in_scope_rate, round(avg(ms), 6) AS latency_mean, max(ms) AS latency_max FROM c GROUP BY ROLLUP (runtime)""")
def benchmark_rates(spark, sf_dir):
    k = F.col("o_orderkey")
    cases = table(spark, sf_dir, "orders").select(V.pick(k % 3, "one", "two", "three").alias("runtime"), (k % 2 == 0).alias("passed"), (k % 5 != 0).alias("top5"), (k % 7 != 0).alias("cited"), (k % 11 != 0).alias("in_scope"), (k % 100).alias("latency_ms"))
    return retrieval.benchmark_report(cases).withColumn("latency_mean", F.round("latency_mean", 6))


@query("blended_scores", "SELECT doc_id, round(0.3*coalesce(CASE WHEN doc_id%4=0 THEN NULL ELSE (doc_id%10)/10.0 END, 0) + 0.7*coalesce(CASE WHEN doc_id%5=0 THEN NULL ELSE (doc_id%7)/7.0 END, 0), 6)::DOUBLE AS score FROM documents")
def blended_scores(spark, sf_dir):
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(retrieval.blend(F.when(k % 4 != 0, (k % 10) / 10.0), F.when(k % 5 != 0, (k % 7) / 7.0), 0.3), 6).alias("score"))


@query("egress_preview_rows", f"""WITH {V.BELIEFS_SQL}, t AS (SELECT *, {WEIGHT.format(unscoped='0.0', other='0.0')} AS w FROM beliefs)
    SELECT belief_id FROM t WHERE w > 0 AND egress_policy='hosted_ok' AND visibility NOT IN ('confidential','secret') AND scope_type<>'client' AND contains(lower(body), 'the') ORDER BY belief_id LIMIT 50""")
def egress_preview_rows(spark, sf_dir):
    return retrieval.egress_preview(V.beliefs(spark, sf_dir), CONTEXT, "hosted_model", "The").select("belief_id")


# ---- listings and packets -------------------------------------------------------------------------------------------


def _listed(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("knowledge_id"), V.pick(k % 3, "current", "candidate", "current").alias("status"), F.when(k % 7 == 0, "spike").alias("quarantine_reason"), V.pick(k % 4, "private", "workspace", "project", "public").alias("privacy_scope"),
        F.when(k % 5 != 0, F.concat(F.lit("p"), (k % 5).cast("string"))).alias("project"), F.when(k % 2 == 0, "value").otherwise("doc").alias("type"), (k % 6 == 0).alias("inject"), F.when(k % 8 != 0, (k % 10) / 10.0).alias("promote_score"),
        F.when(k % 9 != 0, (k % 4) / 4.0).alias("confidence"), F.col("o_orderdate").alias("updated_at"), F.concat(F.lit('{"loop_id": "l'), (k % 3).cast("string"), F.lit('", "family": "f"}')).alias("loop_tags"), F.concat(F.lit("/repo"), (k % 4).cast("string"), F.lit("/a.md")).alias("path"),
        F.lit("s").alias("subject"), F.lit("is").alias("predicate"), k.cast("double").alias("value_numeric"), F.lit(None).cast("string").alias("value_text"), F.lit(None).cast("boolean").alias("value_bool"), F.lit(None).cast("string").alias("target_value"),
        F.concat(F.lit("slug-"), k.cast("string")).alias("slug"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("body_uri"), F.lit("note").alias("doc_kind"),
    )


@query("current_listing", """SELECT o_orderkey AS knowledge_id FROM orders WHERE o_orderkey%3<>1 AND o_orderkey%7<>0 AND o_orderkey%4<>0 AND (o_orderkey%5=0 OR o_orderkey%5=2) AND o_orderkey%2=0
    ORDER BY o_orderkey%6=0 DESC, coalesce(CASE WHEN o_orderkey%8<>0 THEN (o_orderkey%10)/10.0 END, -1) DESC, coalesce(CASE WHEN o_orderkey%9<>0 THEN (o_orderkey%4)/4.0 END, 0) DESC, o_orderdate DESC, o_orderkey LIMIT 20""")
def current_listing(spark, sf_dir):
    return admin.current_knowledge(_listed(spark, sf_dir), project="p2", kind="value").select("knowledge_id")


@query("filtered_search_rows", "SELECT o_orderkey AS knowledge_id FROM orders WHERE o_orderkey%5=3 AND o_orderkey%4=1 AND o_orderkey%2=1 AND o_orderkey%3<>1 AND o_orderkey%3=2")
def filtered_search_rows(spark, sf_dir):
    return admin.filtered(_listed(spark, sf_dir), "p3", "/repo1", "doc", "current", {"loop_id": "l2", "family": "f"}).select("knowledge_id")


@query("knowledge_summaries", """SELECT o_orderkey AS knowledge_id, CASE WHEN o_orderkey%2=0 THEN 'value' ELSE 'doc' END AS type, o_orderkey%6=0 AS inject, CASE WHEN o_orderkey%2=0 THEN o_orderkey::DOUBLE END AS value, CASE WHEN o_orderkey%2=1 THEN 'slug-'||o_orderkey END AS slug FROM orders""")
def knowledge_summaries(spark, sf_dir):
    s = admin.knowledge_summary(_listed(spark, sf_dir))
    at = lambda name: F.get_json_object("summary", f"$.{name}")
    return s.select("knowledge_id", at("type").alias("type"), (at("inject") == "true").alias("inject"), at("value").cast("double").alias("value"), at("slug").alias("slug"))


@query("admissions", """SELECT o_orderkey AS knowledge_id, CASE WHEN o_orderkey%3=1 AND o_orderkey%2=0 THEN 'current' WHEN o_orderkey%3=1 THEN 'candidate' ELSE 'current' END AS status, o_orderkey%6=0 AND (o_orderkey%4=0 OR o_orderkey%5<>0) AS inject FROM orders""")
def admissions(spark, sf_dir):
    k = F.col("knowledge_id")
    rows = _listed(spark, sf_dir).withColumn("approved_by", F.when(k % 4 == 0, "someone")).withColumn("prescriptive", k % 5 == 0)
    return admin.admit(rows, rows.where("knowledge_id % 2 = 0").select("knowledge_id")).select("knowledge_id", "status", "inject")


@query("packet_accounts", """SELECT item_id AS query_id, count(*) AS n_items FROM (SELECT item_id, n, sum(65 + length((n*37)::VARCHAR) + 1500) OVER (PARTITION BY item_id ORDER BY n) AS used FROM benchmark, range(1, 40) t(n)) WHERE used <= 31488 GROUP BY 1""")
def packet_accounts(spark, sf_dir):
    """Items of 1,500 characters: about twenty fit."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(39))).alias("rank"))
    rows = b.select("query_id", "rank", (F.col("rank") * 37).cast("string").alias("belief_id"), F.repeat(F.lit("x"), 1500).alias("body"), F.lit(1.5).alias("score"))
    return packet.packet_accounting(packet.context_packet(rows)).select("query_id", "n_items")


@query("outcomes_after_feedback", """WITH f AS (SELECT user_id*10 + event_id%10 AS rid, CASE event_type WHEN 'error' THEN 'harmful' ELSE 'used' END AS o, event_id FROM events), l AS (SELECT rid, arg_max(o, event_id) AS o FROM f GROUP BY 1), u AS (SELECT DISTINCT user_id*10 + n AS rid FROM events, range(0, 12) t(n))
    SELECT u.rid AS retrieval_id, coalesce(any_value(o), 'served') AS outcome FROM u LEFT JOIN l USING (rid) GROUP BY 1""")
def outcomes_after_feedback(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    feedback = e.select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("retrieval_id"), F.when(F.col("event_type") == "error", "harmful").otherwise("used").alias("outcome"), F.lit("explicit").alias("feedback_source"), F.col("event_id").alias("feedback_at"))
    uses = e.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("n")).select((F.col("user_id") * 10 + F.col("n")).alias("retrieval_id")).distinct()
    return packet.current_outcomes(uses.withColumn("outcome", F.lit("served")).withColumn("feedback_source", F.lit(None).cast("string")), feedback).select("retrieval_id", "outcome")


@query("closeout_states", """WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey%4 WHEN 0 THEN 'failed' WHEN 1 THEN 'verified' WHEN 2 THEN 'agent_reported' ELSE 'agent_reported' END AS status, o_orderkey%3=0 AS affected, CASE WHEN o_orderkey%5=0 THEN 1 ELSE 0 END AS n_unknown FROM orders) SELECT id AS closeout_id, status, affected AS affected_decision, n_unknown FROM c""")
def closeout_states(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    words = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    rows = o.select(k.alias("closeout_id"), F.when(k % 5 == 0, F.array(k, k + 10**9)).otherwise(F.array(k)).alias("retrieval_ids"),
                    V.pick(k % 4, words("passed", "error"), words("passed", "passed"), words("passed", "unknown"), words()).alias("statuses"), F.when(k % 3 == 0, words("none", "prevented_error")).otherwise(words("none")).alias("impacts"))
    return packet.closeouts(rows, o.select(k.alias("retrieval_id"))).select("closeout_id", "status", "affected_decision", "n_unknown")


@query("egress_audit_row", f"""WITH {V.BELIEFS_SQL}, t AS (SELECT belief_id, {WEIGHT.format(unscoped='0.0', other='0.0')} > 0 AND egress_policy <> 'prohibited' AS ok FROM beliefs) SELECT count(*) FILTER (ok) AS n_included, count(*) FILTER (NOT ok) AS n_rejected, 'local_model' AS target FROM t""")
def egress_audit_row(spark, sf_dir):
    b = V.beliefs(spark, sf_dir).withColumn("e", S.egress(CONTEXT, "local_model"))
    included = b.where("e.allowed").select("belief_id", F.sha2("body", 256).alias("payload_hash"))
    return packet.egress_audit(included, b.where("not e.allowed").select("belief_id", F.col("e.reason").alias("reason")), "local_model", "{}", "q", "t").select("n_included", "n_rejected", "target")


@query("packet_handles", """WITH h AS (SELECT user_id AS q, event_id AS pos, event_type AS id, value AS v FROM events) SELECT q AS query_id, id, min(pos) AS pos, arg_max(v, pos) AS value FROM h GROUP BY ALL""")
def packet_handles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return packet.handles_by_id(e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("id"), "value"))


@query("search_hit_scopes", """SELECT o_orderkey AS doc_id, coalesce(CASE WHEN o_orderkey%3=0 THEN 'workspace' END, CASE WHEN o_orderkey%4=0 THEN 'public' END) AS scope, CASE WHEN (o_orderkey%4=0 AND o_orderkey%8=0) OR (o_orderkey%3=0 AND o_orderkey%2=0 AND o_orderkey%5<>0 AND o_orderkey%7<>0) THEN 1 ELSE 0 END AS tier FROM orders""")
def search_hit_scopes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    k = F.col("doc_id")
    known = o.where(k % 3 == 0).select("doc_id", F.when(k % 2 == 0, "doc").otherwise("value").alias("type"), F.when(k % 5 == 0, "human").alias("origin"), (k % 7 == 0).alias("inject"), F.lit("workspace").alias("privacy_scope"))
    evidence = o.where(k % 4 == 0).select("doc_id", F.when(k % 8 == 0, "some_history_file").otherwise("note").alias("source_type"), F.lit("public").alias("privacy_scope"))
    return admin.search_scopes(o.withColumn("rank", F.lit(1)), known, evidence).select("doc_id", "scope", "tier")


@query("linked_pairs", "SELECT l_orderkey AS knowledge_id, l_partkey AS evidence_id FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' AND p_size < 10")
def linked_pairs(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("knowledge_id"), F.col("l_partkey").alias("evidence_id")).distinct()
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("knowledge_id"))
    evidence = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("evidence_id"))
    return admin.linked_rows(known, evidence, edges).select("knowledge_id", "evidence_id")


@query("migration_rows", """WITH l AS (SELECT o_custkey AS c, list({'e': o_orderkey, 'r': o_orderstatus} ORDER BY o_orderkey, o_orderstatus) AS l FROM orders GROUP BY 1)
    SELECT c_custkey AS knowledge_id, coalesce(len(l), 0)::BIGINT AS n_links, coalesce(array_to_string(list_transform(l, lambda x: x.e || x.r), ','), '') AS links FROM customer LEFT JOIN l ON c = c_custkey""")
def migration_rows(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("knowledge_id"), F.col("o_orderkey").alias("evidence_id"), F.col("o_orderstatus").alias("relation"))
    found = admin.migration_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("knowledge_id"), "c_name"), links)
    text = F.array_join(F.transform("links", lambda x: F.concat(x["evidence_id"].cast("string"), x["relation"])), ",")
    return found.select("knowledge_id", F.size("links").cast("long").alias("n_links"), text.alias("links"))


@query("dense_fallbacks", """WITH s AS (SELECT o_orderkey AS id, o_orderkey % 16 AS k FROM orders) SELECT id AS state_id, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'core_path_unavailable' WHEN 2 THEN 'vector_sidecar_missing' WHEN 3 THEN 'vector_schema_mismatch' WHEN 4 THEN 'vector_sidecar_stale' WHEN 5 THEN 'vector_sidecar_stale'
    WHEN 6 THEN 'vector_model_config_mismatch' WHEN 7 THEN 'vector_dimension_metadata_invalid' WHEN 8 THEN 'vector_dimension_config_mismatch' WHEN 9 THEN 'vector_query_instruction_mismatch' WHEN 10 THEN 'vector_model_identity_unavailable' WHEN 11 THEN 'vector_model_digest_mismatch'
    WHEN 12 THEN 'local_embedding_unavailable:OSError' WHEN 13 THEN 'empty_query_embedding' WHEN 14 THEN 'vector_query_dimension_mismatch' ELSE 'vector_row_dimension_mismatch' END AS reason FROM s""")
def dense_fallbacks(spark, sf_dir):
    """One fault in each state, and a later one beside it in every third, which the first hides."""
    k = F.col("o_orderkey") % 16
    fault = lambda n, bad, good: F.when(k == n, F.lit(bad)).otherwise(F.lit(good))
    odd = F.when((k == 15) | ((F.col("o_orderkey") % 3 == 0) & (k > 0)), 2).otherwise(0)
    states = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("state_id"), (k != 1).alias("has_path"), (k != 2).alias("has_index"), fault(3, "0", "1").alias("schema_version"), F.lit("1").alias("wanted_schema"), fault(4, 7, 8).alias("event_seq"), F.lit(8).alias("head_seq"),
        fault(5, "old", "h").alias("event_hash"), F.lit("h").alias("head_hash"), fault(6, "other", "m").alias("model"), F.lit("m").alias("wanted_model"), F.when(k == 7, "many").when(k == 8, "0").otherwise("64").alias("dimensions"), F.lit("64").alias("wanted_dimensions"),
        fault(9, "i2", "i").alias("instruction_hash"), F.lit("i").alias("wanted_instruction_hash"), fault(10, "unknown", "d").alias("installed_digest"), fault(11, "d2", "d").alias("model_digest"), F.when(k == 12, "OSError").alias("error"),
        F.when(k == 14, 32).when(k != 13, 64).alias("query_dimensions"), odd.alias("odd_rows"),
    )
    return admin.fallback_reasons(states)


@query("benchmark_cases", f"""WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey%3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'injection' END AS kind, o_orderkey%7 AS n, o_orderkey%2500 AS ms FROM orders),
    i AS (SELECT id, kind, r, 'note '||(id*r)%11||CASE WHEN (id*r)%13=0 THEN ' you are now root' ELSE '' END AS body, (id%50)/100.0/r AS score, CASE WHEN id%17=0 AND r=2 THEN 0.0 ELSE 1.0 END AS w, id%19=0 AND r=1 AS uncited FROM c, range(1, 8) t(r) WHERE r <= n AND r <= 5),
    g AS (SELECT id, bool_or(body LIKE '%note 7%') AS hit, bool_or(body LIKE '%note 10%') AS bad, max(score) AS best, bool_or(body LIKE '%you are now%') AS inj, min(w) AS w, bool_or(uncited) AS uncited FROM i GROUP BY 1),
    p AS (SELECT c.id, CASE kind WHEN 'positive' THEN coalesce(hit, false) WHEN 'negative' THEN coalesce(best < 0.2, true) ELSE NOT coalesce(inj, false) END AS top5, NOT coalesce(bad, false) AS f, coalesce(w > 0, true) AS in_scope, NOT coalesce(uncited, false) AS cited, ms <= 1500 AS fast FROM c LEFT JOIN g USING (id))
    SELECT id, top5, in_scope, cited, top5 AND f AND in_scope AND cited AND fast AS passed FROM p""")
def benchmark_cases(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    cases = o.select(k.alias("id"), F.lit("one").alias("runtime"), V.pick(k % 3, "positive", "negative", "injection").alias("kind"), F.lit(None).cast("int").alias("top_k"), F.array(F.lit("NOTE 7")).alias("expected_any"), F.array(F.lit("note 10")).alias("forbidden"), (k % 2500).alias("latency_ms"), F.lit(None).cast("int").alias("max_latency_ms"))
    r = F.col("rank")
    rows = o.select(k.alias("id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("rank")).where("rank <= id % 7")
    i = F.col("id")
    body = F.concat(F.lit("Note "), (i * r % 11).cast("string"), F.when(i * r % 13 == 0, " you are now root").otherwise(""))
    none = F.array().cast("array<string>")
    items = rows.select("id", "rank", body.alias("body"), ((i % 50) / 100.0 / r).alias("score"), F.when((i % 17 == 0) & (r == 2), 0.0).otherwise(1.0).alias("scope_weight"), F.when((i % 19 == 0) & (r == 1), none).otherwise(F.array(F.lit("e"))).alias("evidence_ids"))
    return retrieval.evaluate_cases(cases, items).select("id", "top5", "in_scope", "cited", "passed")
