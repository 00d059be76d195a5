"""Registered queries of the event log, the fold and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from evergrain.functions import ids
from evergrain.operators import feedback, fold, log
from evergrain.session import table

from . import views as V
from .registry import query

HEADER = """'{{"body_hash":"' || {body} || '","kind":"click","prev_hash":"' || {prev} || '","session_id":null,"ts":"t","writer":"w"}}'"""
FIRST = "sha256('start')"


@query("chain_check", f"""WITH e AS (SELECT event_id, '{{"n":' || event_id || '}}' AS body FROM events), h AS (SELECT event_id, sha256(body) AS bh FROM e),
    o AS (SELECT event_id, bh, sha256({HEADER.format(body='bh', prev=FIRST)}) AS odd FROM h),
    c AS (SELECT a.event_id, row_number() OVER (ORDER BY a.event_id) AS nth, a.event_id % 2 = 0 AS even, p.odd AS before FROM o a LEFT JOIN o p ON p.event_id = a.event_id - 1)
    SELECT event_id AS event_seq, CASE WHEN NOT even THEN 'prev_hash_mismatch' WHEN event_id % 7 = 0 THEN 'body_hash_mismatch' WHEN event_id % 11 = 0 THEN 'event_hash_mismatch' WHEN event_id % 13 = 0 THEN 'id_mismatch' END AS reason
    FROM c WHERE (nth > 1 OR even) AND (NOT even OR event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0)""")
def chain_check(spark, sf_dir):
    """Events in pairs: the second of a pair follows the first, no pair follows the pair before; bodies, hashes and ids are spoilt here and there."""
    e = table(spark, sf_dir, "events").select("event_id").withColumn("body_json", F.concat(F.lit('{"n":'), F.col("event_id").cast("string"), F.lit("}"))).withColumn("good_body", ids.content_hash(F.col("body_json")))
    hashed = lambda prev: ids.event_hash(F.lit("t"), F.lit("click"), F.lit("w"), F.lit(None).cast("string"), F.col("good_body"), prev)
    start = F.sha2(F.lit("start"), 256)
    odd = e.withColumn("odd", hashed(start))
    even = odd.join(odd.select((F.col("event_id") + 1).alias("event_id"), F.col("odd").alias("before")), "event_id", "left")
    k = F.col("event_id")
    rows = even.withColumn("prev_hash", F.when(k % 2 == 1, start).otherwise(F.coalesce("before", start))).withColumn("own", hashed(F.col("prev_hash")))
    rows = rows.withColumn("event_hash", F.when((k % 2 == 0) & (k % 11 == 0) & (k % 7 != 0), F.lit("spoilt")).otherwise(F.col("own")))
    rows = rows.withColumn("id", F.when((k % 2 == 0) & (k % 13 == 0), F.lit("spoilt")).otherwise(ids.event_id(F.lit("click"), F.col("event_hash"))))
    rows = rows.withColumn("body_json", F.when((k % 2 == 0) & (k % 7 == 0), F.lit("{}")).otherwise(F.col("body_json")))
    head = rows.agg(F.min_by("prev_hash", "event_id")).first()[0]
    chain = rows.select(F.col("event_id").alias("event_seq"), "id", F.lit("t").alias("ts"), F.lit("click").alias("kind"), F.lit("w").alias("writer"), F.lit(None).cast("string").alias("session_id"), "body_json", F.col("good_body").alias("body_hash"), "prev_hash", "event_hash")
    return log.verify_chain(chain, head)


PROPOSED = """p AS (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type='view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS prop FROM events),
    d AS (SELECT DISTINCT prop FROM p WHERE event_type='purchase' AND prop IS NOT NULL),
    u AS (SELECT user_id, bool_or(event_type='signup') AS tomb, max(event_id) FILTER (event_type='error') AS fix, bool_or(event_type='error' AND event_id%3=0) AS hard FROM events GROUP BY 1)"""


@query("block_reasons", f"""WITH {PROPOSED}, r AS (SELECT 'evt_'||event_id AS proposal_id, 'bel_'||user_id AS belief_id,
        CASE WHEN tomb THEN 'tombstoned' WHEN fix > event_id THEN 'corrected_after_proposal' WHEN hard THEN 'hard_corrected' WHEN d.prop IS NOT NULL THEN 'already_approve' END AS reason
        FROM p JOIN u USING (user_id) LEFT JOIN d ON d.prop = p.event_id WHERE event_type='view')
    SELECT * FROM r WHERE reason IS NOT NULL""")
def block_reasons(spark, sf_dir):
    return log.block_reasons(V.event_log(spark, sf_dir)).select("proposal_id", "belief_id", "reason")


@query("evidence_objects", """SELECT 'evd_'||event_id AS evidence_id, props AS body, 'observation' AS evidence_kind, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS occurred_at, 'w'||(user_id%5) AS source_runtime, false AS conflicting FROM events WHERE event_type='click'""")
def evidence_objects(spark, sf_dir):
    return fold.fold_evidence(V.event_log(spark, sf_dir)).select("evidence_id", "body", "evidence_kind", "occurred_at", "source_runtime", "conflicting")


APPROVED = """WITH p AS (SELECT event_id, user_id, event_type, round(value/1000, 3) AS conf, last_value(CASE WHEN event_type='view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS prop, ts FROM events),
    a AS (SELECT user_id, event_id AS at, prop FROM p WHERE event_type='purchase' AND prop IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1),
    t AS (SELECT a.user_id, a.prop, max(e.event_id) FILTER (e.event_type='signup') AS tomb, max(e.event_id) FILTER (e.event_type='error' AND e.event_id%2=1 AND (e.event_id>a.prop OR e.event_id%3=0)) AS wrong FROM a LEFT JOIN events e USING (user_id) GROUP BY ALL)"""


@query("support_edges", APPROVED + " SELECT 'bel_'||user_id AS belief_id, 'evd_'||prop AS evidence_id, 'supports' AS relation FROM t")
def support_edges(spark, sf_dir):
    return fold.support_edges(fold.fold(V.event_log(spark, sf_dir)))


@query("search_documents", APPROVED + " SELECT 'bel_'||user_id AS doc_id, 'belief:compiled' AS kind, 'bel_'||user_id AS title, 'v'||prop AS body FROM t WHERE tomb IS NULL AND wrong IS NULL")
def search_documents(spark, sf_dir):
    return fold.search_rows(fold.fold(V.event_log(spark, sf_dir)))


@query("incremental_fold", APPROVED + """ SELECT 'bel_'||user_id AS belief_id, 'v'||prop AS body, CASE WHEN tomb IS NULL AND wrong IS NULL THEN 'current' WHEN coalesce(tomb,-1) > coalesce(wrong,-1) THEN 'tombstoned' ELSE 'retracted' END AS status FROM t""")
def incremental_fold(spark, sf_dir):
    """Beliefs stored after half of the log, then folded on from the cursor."""
    events = V.event_log(spark, sf_dir).withColumn("event_hash", F.col("id"))
    half = events.agg((F.max("event_seq") / 2).cast("long")).first()[0]
    stored = fold.fold(log.scan(events.where(F.col("event_seq") <= half)))
    return fold.advance(events, stored, (half, f"evt_{half}")).select("belief_id", "body", "status")


RICH = """WITH e AS (SELECT event_id AS s, user_id*50 + event_id%50 AS b, event_type AS ty, round(value/1000, 3) AS conf FROM events),
    p AS (SELECT *, last_value(CASE WHEN ty='view' THEN s END IGNORE NULLS) OVER (PARTITION BY b ORDER BY s) AS prop FROM e),
    a AS (SELECT b, s AS at, prop, CASE WHEN s%5=0 THEN 'x'||s ELSE 'v'||prop END AS body FROM p WHERE ty='purchase' AND prop IS NOT NULL AND s%7<>0 QUALIFY row_number() OVER (PARTITION BY b ORDER BY s DESC)=1),
    c AS (SELECT p.b, p.s, p.ty, CASE ty WHEN 'error' THEN s > a.at OR s > a.prop OR (s%4=0 AND s%6 IN (2,3,5)) ELSE s%3=0 OR (s > a.at AND s%5<>0) END AS counts FROM p JOIN a USING (b) WHERE ty IN ('error','signup')),
    g AS (SELECT b, arg_max(CASE ty WHEN 'signup' THEN 'tombstoned' ELSE 'retracted' END, s) FILTER ((ty='signup' AND s%3=0) OR (ty='error' AND s%6 IN (3,5))) AS ended,
        arg_max(CASE ty WHEN 'signup' THEN '[shredded by tombstone]' ELSE 'e'||s END, s) FILTER ((ty='signup' AND s%6=0) OR (ty='error' AND s%6 IN (0,4))) AS text,
        coalesce(bool_or(ty='error' AND s%6=1), false) AS pinned, coalesce(bool_or(ty='error' AND s%6=2), false) AS demoted, coalesce(bool_or(ty='signup' AND s%6=0), false) AS shredded,
        arg_max('project:'||s, s) FILTER (ty='signup' AND s%3<>0) AS moved, max(s) AS last FROM c WHERE counts GROUP BY b)
    SELECT 'bel_'||a.b AS belief_id, coalesce(g.text, a.body) AS body, coalesce(g.ended, 'current') AS status, coalesce(g.pinned, false) AS pinned,
        CASE WHEN g.demoted THEN least(CASE WHEN v.conf=0 THEN 0.5 ELSE v.conf END, 0.4) ELSE v.conf END AS confidence, coalesce(g.moved, 'global:doctrine') AS scope_id,
        CASE WHEN coalesce(g.shredded, false) THEN 0 ELSE 1 END AS n_evidence, 'evt_'||coalesce(g.last, a.at) AS last_event_id FROM a JOIN e v ON v.s = a.prop LEFT JOIN g ON g.b = a.b"""


@query("belief_fold_all_operations", RICH)
def belief_fold_all_operations(spark, sf_dir):
    """Edits, pins, demotions, retractions, reframes, shreds, scope promotions and rejected decisions, on beliefs with a few events each."""
    found = fold.fold(V.varied_log(spark, sf_dir))
    return found.select("belief_id", "body", "status", "pinned", F.round("confidence", 6).alias("confidence"), "scope_id", F.size("evidence_ids").alias("n_evidence"), "last_event_id")


@query("confidence_bands", """SELECT CASE WHEN value IS NULL THEN 'unknown' WHEN value/1000 >= 0.75 THEN 'strong' WHEN value/1000 >= 0.45 THEN 'moderate' ELSE 'weak' END AS band, count(*) AS n FROM events GROUP BY 1""")
def confidence_bands(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("confidence", F.col("value") / 1000).groupBy(fold.confidence_band().alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("alias_resolution", """SELECT 'know_'||c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'know_'||c_custkey WHEN 1 THEN 'bel_'||c_custkey WHEN 2 THEN 'legacy:know_'||c_custkey ELSE 'know_'||c_custkey END AS canonical_id FROM customer""")
def alias_resolution(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("know_"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_custkey") % 4).alias("k"), F.concat(F.lit("bel_"), F.col("c_custkey").cast("string")).alias("bel"))
    objects = c.where("k = 0").select(F.col("id").alias("object_id")).unionByName(c.where("k = 1").select(F.col("bel").alias("object_id"))).unionByName(c.where("k = 2").select(F.concat(F.lit("legacy:"), "id").alias("object_id")))
    return fold.resolve_aliases(c.select("id"), objects, c.where("k = 1").select(F.col("id").alias("alias_id"), F.col("bel").alias("canonical_id")))


@query("scan_after_cursor", "SELECT event_type, count(*) AS n FROM events WHERE event_id > 100 AND strftime(ts, '%Y-%m-%dT%H:%M:%S') <= '2024-01-20T00:00:00' GROUP BY 1")
def scan_after_cursor(spark, sf_dir):
    kinds = {"evidence_recorded": "click", "compilation_proposed": "view", "compilation_decided": "purchase", "correction_recorded": "error", "tombstone_recorded": "signup"}
    named = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return log.scan(V.event_log(spark, sf_dir), 100, "2024-01-20T00:00:00").groupBy(named[F.col("kind")].alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("imported_beliefs", """WITH b AS (SELECT c_custkey AS k, 'body '||c_custkey AS body, CASE c_custkey%4 WHEN 0 THEN 'current' WHEN 1 THEN 'retracted' WHEN 2 THEN 'current' ELSE 'tombstoned' END AS st, c_custkey%6=0 AS pin, CASE WHEN c_custkey%5<>0 THEN (c_custkey%10)/10.0 END AS conf FROM customer WHERE c_custkey%3<>0),
    i AS (SELECT c_custkey AS k, 'old '||c_custkey AS body, CASE c_custkey%4 WHEN 0 THEN 'current' WHEN 1 THEN 'stale' WHEN 2 THEN 'archived' ELSE 'candidate' END AS st, c_custkey%7=0 AS pin, 0.7 AS conf FROM customer WHERE c_custkey%2=0),
    j AS (SELECT coalesce(b.k, i.k) AS k, coalesce(b.body, i.body) AS body, b.st AS bs, i.st AS ist, coalesce(b.pin, i.pin, false) AS pin, coalesce(b.conf, i.conf) AS conf, i.k IS NOT NULL AS imp FROM b FULL JOIN i ON b.k = i.k),
    r AS (SELECT *, CASE WHEN imp AND k%11=0 THEN 'tombstoned' WHEN imp AND k%13=0 THEN 'retracted' WHEN bs IS NULL THEN ist WHEN ist IS NULL THEN bs
        WHEN list_position(['current','candidate','superseded','stale','archived','retracted','tombstoned'], bs) >= list_position(['current','candidate','superseded','stale','archived','retracted','tombstoned'], ist) THEN bs ELSE ist END AS status FROM j)
    SELECT 'bel_'||k AS belief_id, body, status, k%3<>0 AND k%4 IN (0,2) AND NOT imp AS serve, pin AS pinned, round(CASE WHEN imp AND k%17=0 THEN least(CASE WHEN conf=0 THEN 0.5 ELSE conf END, 0.4) ELSE conf END, 6)::DOUBLE AS confidence FROM r""")
def imported_beliefs(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("bel_"), k.cast("string"))
    evidence = F.array(F.concat(F.lit("e"), k.cast("string")))
    beliefs = c.where(k % 3 != 0).select(name.alias("belief_id"), F.concat(F.lit("body "), k.cast("string")).alias("body"), V.pick(k % 4, "current", "retracted", "current", "tombstoned").alias("status"), (k % 2 == 0).alias("serve"), (k % 6 == 0).alias("pinned"), F.when(k % 5 != 0, (k % 10) / 10.0).alias("confidence"), evidence.alias("evidence_ids"))
    old = c.where(k % 2 == 0).select(name.alias("belief_id"), F.concat(F.lit("old "), k.cast("string")).alias("body"), V.pick(k % 4, "current", "stale", "archived", "unheard of").alias("status"), F.lit(0.7).alias("confidence"), F.when(k % 7 == 0, "human").alias("origin"), F.lit(True).alias("inject"), evidence.alias("evidence_ids"))
    fixes = c.where((k % 11 == 0) | (k % 13 == 0) | (k % 17 == 0)).select(name.alias("target_id"), F.explode(F.array_compact(F.array(F.when(k % 11 == 0, F.lit("tombstone")), F.when(k % 13 == 0, F.lit("retract")), F.when(k % 17 == 0, F.lit("demote"))))).alias("op"))
    return fold.merge_imports(beliefs, old, fixes).select("belief_id", "body", "status", "serve", "pinned", F.round("confidence", 6).alias("confidence"))


@query("first_event_that_names", f"""WITH r AS (SELECT event_id AS rid, user_id, ts FROM events WHERE event_type='purchase'),
    x AS (SELECT rid, e.event_id, e.event_type, row_number() OVER (PARTITION BY rid ORDER BY e.ts, e.event_id) AS nth FROM r JOIN events e ON e.user_id = r.user_id AND e.event_type IN ('view','error','signup') AND e.ts > r.ts AND e.ts <= r.ts + INTERVAL 24 HOUR)
    SELECT rid AS retrieval_id, CASE WHEN event_type='error' AND (event_id%2=1 OR event_id%3=0) THEN 'harmful' ELSE 'used' END AS outcome, CASE WHEN event_type='error' AND (event_id%2=1 OR event_id%3=0) THEN 'inferred_exact_correction' ELSE 'inferred_exact_reference' END AS feedback_source, event_id AS event_seq FROM x WHERE nth = 1""")
def first_event_that_names(spark, sf_dir):
    """No session matches: only what a later event's body names decides."""
    e = table(spark, sf_dir, "events")
    uses = e.where("event_type = 'purchase'").select(F.col("event_id").alias("retrieval_id"), F.col("ts").alias("served_at"), F.lit("elsewhere").alias("session_id"), F.array(F.lit("none"), F.concat(F.lit("bel_"), F.col("user_id").cast("string"))).alias("served_ids"), F.lit("served").alias("outcome"), F.lit(None).cast("string").alias("feedback_source"))
    rows = V.event_log(spark, sf_dir).join(e.select(F.col("event_id").alias("event_seq"), F.col("ts").alias("exact")), "event_seq").withColumn("ts", F.col("exact"))
    return feedback.first_event_after(uses, rows, V.NOW).select("retrieval_id", "outcome", "feedback_source", "event_seq")


# ---- feedback -----------------------------------------------------------------------------------------------------

OUTCOME = "CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN 'improved' WHEN 1 THEN 'helpful' WHEN 2 THEN 'used' WHEN 3 THEN 'harmful' WHEN 4 THEN 'failed' WHEN 5 THEN 'irrelevant' WHEN 6 THEN 'ignored' ELSE 'served' END"


def _outcome():
    return V.pick((F.col("l_orderkey") + F.col("l_linenumber")) % 8, "improved", "helpful", "used", "harmful", "failed", "irrelevant", "ignored", "served")


@query("retrieval_votes", f"""WITH u AS (SELECT DISTINCT l_orderkey*10+l_linenumber AS rid, l_partkey AS kid, {OUTCOME} AS o FROM lineitem),
    v AS (SELECT kid, CASE WHEN o IN ('improved','helpful','used') THEN 'good' WHEN o IN ('harmful','failed') THEN 'bad' ELSE 'neutral' END AS polarity,
        CASE o WHEN 'improved' THEN 0.5 WHEN 'helpful' THEN 0.4 WHEN 'used' THEN 0.4 WHEN 'harmful' THEN 0.9 WHEN 'failed' THEN 0.6 WHEN 'irrelevant' THEN 0.2 ELSE 0.1 END AS w FROM u WHERE o <> 'served')
    SELECT kid AS knowledge_id, 'retrieval_feedback' AS kind, polarity, round(sum(w), 6)::DOUBLE AS weight, count(*) AS n FROM v GROUP BY ALL""")
def retrieval_votes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    uses = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("retrieval_id"), F.array("l_partkey").alias("served_ids"), _outcome().alias("outcome"), F.col("l_shipdate").alias("served_at"))
    return feedback.retrieval_signals(uses).groupBy("knowledge_id", "kind", "polarity").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


@query("correction_votes", "SELECT 'bel_'||user_id AS knowledge_id, 'hard_correction_event' AS kind, 'bad' AS polarity, count(*)::DOUBLE AS weight FROM events WHERE event_type='error' AND event_id%3=0 GROUP BY 1")
def correction_votes(spark, sf_dir):
    return feedback.correction_signals(V.event_log(spark, sf_dir)).groupBy("knowledge_id", "kind", "polarity").agg(F.sum("weight").alias("weight"))


@query("verifier_votes", """SELECT 'sig_'||substring(sha256('events'||chr(0)||'verifier_result'||chr(0)||CASE o_orderstatus WHEN 'F' THEN 'good' ELSE 'bad' END||chr(0)||'evidence:'||o_orderkey||chr(0)||o_custkey||chr(0)), 1, 16) AS signal_id,
    o_custkey AS knowledge_id, CASE o_orderstatus WHEN 'F' THEN 'good' ELSE 'bad' END AS polarity, CASE o_orderstatus WHEN 'F' THEN 0.5 ELSE 0.6 END::DOUBLE AS weight FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def verifier_votes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    evidence = o.select(F.col("o_orderkey").alias("evidence_id"), F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "failed").otherwise("unknown").alias("verifier_status"))
    return feedback.verifier_signals(evidence, o.select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("knowledge_id"))).select("signal_id", "knowledge_id", "polarity", "weight")


@query("learning_votes", """SELECT p_partkey AS learning_id, round((p_partkey % 10)/10.0 * least(1.0, 0.5 + 0.1*(p_size % 9)), 6)::DOUBLE AS weight FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 4 <> 3""")
def learning_votes(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = p.select(k.alias("learning_id"), V.pick(k % 3, "GATE", "correction", "NOTE").alias("rule_type"), V.pick(k % 4, "active", "", F.lit(None).cast("string"), "retired").alias("status"), ((k % 10) / 10.0).alias("confidence"), (F.col("p_size") % 9).alias("recurrence"))
    return feedback.learning_signals(rows).select(F.substring("source_ref", 11, 20).cast("long").alias("learning_id"), F.round("weight", 6).alias("weight"))


@query("commitment_and_run_votes", """WITH c AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'Missed' WHEN 2 THEN 'open' WHEN 3 THEN 'kept' ELSE 'broken' END AS s, CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'running' ELSE 'success' END AS r, o_orderkey % 3 <> 0 AS delivered FROM orders)
    SELECT 'commitment_outcome' AS kind, CASE WHEN s IN ('completed','kept') THEN 'good' ELSE 'bad' END AS polarity, 0.5::DOUBLE AS weight, count(*) AS n FROM c WHERE s <> 'open' GROUP BY ALL
    UNION ALL SELECT 'cron_run', CASE WHEN r = 'ERROR' THEN 'bad' ELSE 'good' END, CASE WHEN r = 'ERROR' THEN 0.5 ELSE 0.3 END::DOUBLE, count(*) FROM c WHERE r = 'ERROR' OR (r IN ('ok','success') AND delivered) GROUP BY ALL""")
def commitment_and_run_votes(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    made = feedback.commitment_signals(o.select(k.alias("commitment_id"), V.pick(k % 5, "completed", "Missed", "open", "kept", "broken").alias("status"), F.lit("t").alias("updated_at")))
    ran = feedback.run_signals(o.select(k.alias("job_id"), V.pick(k % 4, "ok", "ERROR", "running", "success").alias("status"), (k % 3 != 0).alias("delivered"), F.lit("t").alias("updated_at")))
    return feedback.union_signals(made, ran).groupBy("kind", "polarity", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("feedback_coverage", f"""WITH u AS (SELECT {OUTCOME} AS o, l_linenumber % 3 = 0 AS inferred FROM lineitem)
    SELECT count(*) AS total, count(*) FILTER (o='served') AS pending, count(*) FILTER (o<>'served' AND NOT inferred) AS explicit, count(*) FILTER (o<>'served' AND inferred) AS inferred, round((count(*) - count(*) FILTER (o='served'))/count(*), 6) AS coverage FROM u""")
def feedback_coverage(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return feedback.coverage(li.select(_outcome().alias("outcome"), F.when(F.col("l_linenumber") % 3 == 0, "inferred_session_evidence").alias("feedback_source")))


@query("attributed_signals", """WITH s AS (SELECT o_orderkey AS id, o_custkey % 50 AS kid, o_orderpriority AS t FROM orders) SELECT id AS signal_id, 'k'||kid AS knowledge_id FROM s WHERE (kid % 2 = 0 AND t LIKE '%URGENT%') OR (kid % 2 = 1 AND t LIKE '%HIGH%')""")
def attributed_signals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 50)
    key = F.concat(F.lit("k"), F.col("k").cast("string"))
    known = o.select(key.alias("knowledge_id"), F.when(F.col("k") % 2 == 0, "an urgent note of 1").otherwise("high 2-4 notes").alias("text")).distinct()
    return feedback.attribute(o.select(F.col("o_orderkey").alias("signal_id"), F.col("o_orderpriority").alias("text")), o.select(F.col("o_orderkey").alias("signal_id"), key.alias("knowledge_id"), F.lit(1).alias("rank")), known, prefix="k")
