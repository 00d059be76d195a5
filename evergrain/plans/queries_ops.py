"""Registered queries of operations on knowledge rows, reviews and stalls."""

from __future__ import annotations

from pyspark.sql import functions as F

from evergrain.functions import text as T
from evergrain.operators import ops, review
from evergrain.session import table

from . import views as V
from .registry import ORACLES, now, query, sql_any

# ---- tripwires and promotion --------------------------------------------------------------------------------------

ORACLES["tripwire_flags"] = f"""WITH s AS (SELECT user_id AS k, count(*) FILTER (event_type='error' AND ts >= TIMESTAMP '2024-01-13') AS n_bad, count(*) FILTER (event_type='signup' AND ts >= TIMESTAMP '2024-01-06') AS n_thrash,
        bool_or(event_type='purchase') AS ok, bool_or(event_type='error' AND event_id%97=0) AS hard FROM events GROUP BY 1),
    t AS (SELECT doc_id AS knowledge_id, CASE WHEN {sql_any('text', T.INJECTIONS)} THEN 'injection_suspected' WHEN {sql_any('text', T.LEAKS)} THEN 'secret_leak' WHEN n_bad >= 2 THEN 'bad_feedback_spike'
        WHEN hard THEN 'hard_correction' WHEN n_thrash >= 3 THEN 'contradiction_thrash' WHEN doc_id%6=0 AND NOT coalesce(ok, false) THEN 'prescriptive_unverified_serving' END AS tripwire FROM documents LEFT JOIN s ON k = doc_id)
    SELECT * FROM t WHERE tripwire IS NOT NULL"""


def _knowledge(spark, sf_dir):
    """documents as knowledge rows with all that promotion looks at."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        k.alias("knowledge_id"), F.col("text").alias("body"), V.pick(k % 4, "current", "current", "current", "stale").alias("status"), F.when(k % 9 == 0, "spike").alias("quarantine_reason"),
        F.when(k % 3 == 0, "good").otherwise("neutral").alias("quality_label"), ((k % 10) / 10.0).alias("quality_confidence"), ((k % 7) / 7.0).alias("confidence"), (k % 5 == 0).alias("prescriptive"),
        F.lit("doc").alias("type"), V.pick(k % 6, "low", "low", "low", "high", "low", "low").alias("risk"), F.lit("2029-12-01 00:00:00").alias("updated_at"), V.pick(k % 4, "private", "workspace", "project", "public").alias("privacy_scope"),
        F.when(k % 50 == 0, "human").alias("origin"),
    )


@query("promotion", f"""WITH u AS (SELECT user_id AS k, count(*) AS served, count(*) FILTER (event_type='purchase') AS useful, bool_or(event_type='signup') AS passed FROM events GROUP BY 1),
    d AS (SELECT *, text AS body FROM documents), r AS (SELECT doc_id, body, coalesce(passed, false) AS passed,
        0.4*(doc_id%10)/10.0 + 0.25*pow(0.5, epoch(TIMESTAMP '{V.NOW}' - TIMESTAMP '2029-12-01')/86400/30) + 0.2*coalesce(useful,0)/greatest(1, coalesce(served,0)) + 0.15*(doc_id%4)/3.0 AS score,
        NOT {sql_any('body', T.INJECTIONS)} AND NOT {sql_any('body', T.LEAKS)} AS clean FROM d LEFT JOIN u ON k = doc_id),
    e AS (SELECT *, doc_id%4<>3 AND doc_id%9<>0 AND ((doc_id%3=0 AND (doc_id%10)/10.0 >= 0.6) OR ((doc_id%7)/7.0 >= 0.85 AND passed)) AND clean AND (passed OR NOT (doc_id%5=0 OR doc_id%6=3)) AS eligible FROM r),
    h AS (SELECT * FROM e WHERE eligible ORDER BY score DESC, doc_id DESC LIMIT 40), b AS (SELECT doc_id, doc_id%50=0 AS pinned, sum(length(body)) OVER (ORDER BY doc_id%50=0 DESC, score DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS chars FROM h)
    SELECT e.doc_id AS knowledge_id, round(score, 6) AS promote_score, eligible, coalesce(b.pinned OR b.chars <= 6000, false) AS inject FROM e LEFT JOIN b USING (doc_id)""")
def promotion(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    uses = e.select(F.col("user_id").alias("knowledge_id"), F.when(F.col("event_type") == "purchase", "used").otherwise("served").alias("outcome"))
    links = e.select(F.col("user_id").alias("knowledge_id"), F.col("event_id").alias("evidence_id"))
    evidence = e.select(F.col("event_id").alias("evidence_id"), F.lit("plain").alias("claim"), F.when(F.col("event_type") == "signup", "passed").otherwise("unknown").alias("verifier_status"), F.lit("local").alias("source_type"), F.lit("clean").alias("injection_scan_status"))
    signals = e.where("false").select(F.col("user_id").alias("knowledge_id"), F.lit("user_thanks").alias("kind"), F.lit("good").alias("polarity"))
    return ops.promote(_knowledge(spark, sf_dir), uses, links, evidence, signals, now()).select("knowledge_id", F.round("promote_score", 6).alias("promote_score"), "eligible", "inject")


@query("demoted_scores", """WITH u AS (SELECT l_orderkey AS k, count(*) AS served, count(*) FILTER (l_returnflag='A') AS useful FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 3 <> 1 GROUP BY 1)
    SELECT o_orderkey AS knowledge_id, ((o_orderkey % 10)/10.0 * CASE WHEN served > 0 AND useful = 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS promote_score FROM orders LEFT JOIN u ON k = o_orderkey""")
def demoted_scores(spark, sf_dir):
    return ops.demote(V.knowledge(spark, sf_dir).withColumn("promote_score", F.col("quality_confidence")), V.uses(spark, sf_dir)).select("knowledge_id", F.round("promote_score", 6).alias("promote_score"))


@query("embed_queue", """SELECT o_orderkey AS knowledge_id, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS tier FROM orders WHERE o_orderkey % 3 = 0 AND (o_orderkey % 4 = 0 OR o_orderkey % 7 <> 0)
    ORDER BY tier, o_orderdate DESC, o_orderkey LIMIT 200""")
def embed_queue(spark, sf_dir):
    k = F.col("knowledge_id")
    rows = V.knowledge(spark, sf_dir).withColumn("inject", k % 5 == 0).withColumn("type", F.when(k % 2 == 0, "value").otherwise("doc"))
    at = F.when(k % 4 == 0, F.lit(None).cast("timestamp")).when(k % 7 == 0, F.col("updated_at")).otherwise(F.col("updated_at") - F.expr("interval 1 day"))
    return ops.embed_candidates(rows.withColumn("embedded_at", at), 200).select("knowledge_id", "tier")


@query("judge_queue", """WITH t AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 3 <> 1)
    SELECT o_orderkey AS knowledge_id FROM orders LEFT JOIN t ON k = o_orderkey WHERE (k IS NOT NULL OR o_orderkey % 4 = 0 OR o_orderkey % 9 = 0) AND NOT (o_orderkey % 4 = 1 AND k IS NULL)
    ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END NULLS FIRST, o_orderkey LIMIT 100""")
def judge_queue(spark, sf_dir):
    k = F.col("knowledge_id")
    rows = V.knowledge(spark, sf_dir).withColumn("doc_kind", V.pick(k % 4, "lesson", "catalog", "note", "note")).withColumn("origin", F.when(k % 9 == 0, "session")).withColumn("quality_updated_at", F.when(k % 5 != 0, F.col("updated_at")))
    return ops.judge_targets(rows, V.uses(spark, sf_dir)).select("knowledge_id")


@query("rows_after_cursor", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate, o_orderkey) > 501")
def rows_after_cursor(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"))
    at = o.orderBy("at", "o_orderkey").offset(500).limit(1).first()
    return ops.after_cursor(o, "at", "o_orderkey", at["at"], at["o_orderkey"]).select("o_orderkey")


@query("heal_conflicts_with_ties", """WITH v AS (SELECT l_partkey*10 + l_linenumber AS id, l_partkey%500 AS s, l_linenumber%3 AS p, l_quantity AS n, CASE WHEN l_linenumber%2=0 THEN (l_partkey%3)/3.0 END AS c, l_shipdate AS d FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_quantity, l_shipdate) = 1),
    g AS (SELECT s, p FROM v GROUP BY ALL HAVING count(*) > 1 AND max(n) - min(n) > 1), w AS (SELECT s, p, id AS winner FROM v JOIN g USING (s, p) QUALIFY row_number() OVER (PARTITION BY s, p ORDER BY coalesce(c, 0) DESC, date_trunc('year', d) DESC, id) = 1)
    SELECT id AS knowledge_id, winner AS superseded_by FROM v JOIN w USING (s, p) WHERE id <> winner""")
def heal_conflicts_with_ties(spark, sf_dir):
    """Confidences, null ones among them, and times are equal for many values of a key."""
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    one = li.groupBy("l_partkey", "l_linenumber").agg(F.min(F.struct("l_orderkey", "l_quantity", "l_shipdate")).alias("x"))
    rows = one.select((k * 10 + F.col("l_linenumber")).alias("knowledge_id"), (k % 500).alias("subject"), (F.col("l_linenumber") % 3).alias("predicate"), F.lit(None).cast("string").alias("project"), F.col("x.l_quantity").alias("value_numeric"), F.lit(None).cast("string").alias("value_text"),
                      F.lit(None).cast("boolean").alias("value_bool"), F.when(F.col("l_linenumber") % 2 == 0, (k % 3) / 3.0).alias("confidence"), F.date_trunc("year", "x.l_shipdate").alias("updated_at"))
    return ops.heal_conflicts(rows, 1.0).select("knowledge_id", "superseded_by")


# ---- loops --------------------------------------------------------------------------------------------------------

DECISION = "CASE {0} % 5 WHEN 0 THEN 'kept' WHEN 1 THEN 'failed' WHEN 2 THEN 'reverted' WHEN 3 THEN 'needs_review' ELSE 'skipped' END"


def _decision(k):
    return V.pick(k % 5, "kept", "failed", "reverted", "needs_review", "skipped")


@query("run_summaries", f"""WITH r AS (SELECT o_custkey AS run_id, {DECISION.format('o_orderkey')} AS d FROM orders)
    SELECT run_id, count(*) AS items, count(*) FILTER (d IN ('kept','reverted','skipped')) AS done, count(*) FILTER (d='failed') AS failed, count(*) FILTER (d='kept') AS kept, count(*) FILTER (d='reverted') AS reverted, count(*) FILTER (d='skipped') AS skipped, count(*) FILTER (d='needs_review') AS needs_review FROM r GROUP BY 1""")
def run_summaries(spark, sf_dir):
    return ops.run_summary(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), _decision(F.col("o_orderkey")).alias("decision")))


@query("best_metrics", """WITH v AS (SELECT p_brand AS b, p_partkey AS o, CASE WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS t FROM part), n AS (SELECT *, coalesce(try_cast(t AS DOUBLE), 'infinity'::DOUBLE) AS x FROM v)
    SELECT b AS family, arg_min(t, (x, o)) AS lowest, arg_max(t, (x, -o)) AS highest, arg_max(t, o) AS latest FROM n GROUP BY 1""")
def best_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("nth"), F.when(F.col("p_partkey") % 11 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("value"))
    best = lambda d, name: ops.best_metric(rows, "family", "value", "nth", d).withColumnRenamed("best", name)
    return best("lower_is_better", "lowest").join(best("higher_is_better", "highest"), "family").join(best("target", "latest"), "family")


@query("lesson_candidates", f"""WITH l AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'skill' WHEN 1 THEN 'wiki' ELSE 'policy' END AS target, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body, {DECISION.format('doc_id')} AS d, doc_id FROM documents),
    k AS (SELECT *, substring(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), 1, 160) AS key FROM l WHERE body <> ''), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY target, key ORDER BY doc_id) = 1)
    SELECT target, sha256(body) AS body_sha256, round(0.74 + CASE WHEN d='kept' THEN 0.06 ELSE 0 END - CASE WHEN target <> 'wiki' THEN 0.02 ELSE 0 END, 2)::DOUBLE AS confidence, CASE WHEN target <> 'wiki' THEN 'medium' ELSE 'low' END AS risk, CASE WHEN target <> 'wiki' THEN 'proposal_only' ELSE 'staged' END AS status FROM f""")
def lesson_candidates(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = d.select(V.pick(k % 3, "skill", "wiki", "policy").alias("target"), F.col("text").alias("body"), _decision(k).alias("decision"), k.alias("pos"))
    return ops.knowledge_candidates(rows).select("target", F.sha2("body", 256).alias("body_sha256"), "confidence", "risk", "status")


@query("overdue_kinds", """WITH l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS due, o_orderkey % 2 = 0 AS beat, o_orderkey % 3 = 0 AS ledger, o_orderkey % 5 = 0 AS running FROM orders)
    SELECT id AS loop_id, CASE WHEN due IS NULL THEN 'invalid_deadman_due' ELSE array_to_string(list_filter([CASE WHEN NOT beat THEN 'heartbeat_starved' END, CASE WHEN NOT ledger THEN 'no_ledger_writes' END, CASE WHEN running THEN 'stale_running_item' END], lambda x: x IS NOT NULL), ',') END AS kinds
    FROM l WHERE due IS NULL OR due <= TIMESTAMP '1997-01-01'""")
def overdue_kinds(spark, sf_dir):
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    later, before = text(at + F.expr("interval 1 day")), text(at - F.expr("interval 1 day"))
    rows = table(spark, sf_dir, "orders").select(k.alias("loop_id"), F.when(k % 13 == 0, "soon").otherwise(text(at)).alias("due_at"), F.when(k % 2 == 0, later).otherwise(before).alias("last_heartbeat_at"), F.when(k % 3 == 0, later).alias("last_ledger_at"), F.when(k % 5 == 0, before).alias("running_since"))
    return ops.overdue(rows, F.to_timestamp(F.lit("1997-01-01 00:00:00"))).select("loop_id", F.array_join("kinds", ",").alias("kinds"))


STALLS = """f AS (SELECT o_custkey AS fingerprint, min(o_orderdate) AS seen FROM orders GROUP BY 1), n AS (SELECT * FROM f WHERE fingerprint % 3 <> 0),
    p AS (SELECT fingerprint FROM n WHERE seen >= TIMESTAMP '{0}' - INTERVAL 48 HOUR ORDER BY seen, fingerprint LIMIT 8)"""


@query("stall_states", f"""WITH {STALLS.format('1993-01-01')} SELECT n.fingerprint, CASE WHEN seen < TIMESTAMP '1993-01-01' - INTERVAL 48 HOUR THEN 'retired' WHEN p.fingerprint IS NOT NULL THEN 'paged' ELSE 'waiting' END AS state FROM n LEFT JOIN p USING (fingerprint)""")
def stall_states(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    found = o.select(F.col("o_custkey").alias("fingerprint"), F.lit("workflow").alias("class"), F.lit("x").alias("detail"), F.col("o_orderdate").alias("seen_at"))
    findings = ops.stall_findings(found.where("o_orderkey % 2 = 0"), found.where("o_orderkey % 2 = 1"))
    return ops.stall_lifecycle(findings, o.where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("fingerprint")), F.to_timestamp(F.lit("1993-01-01 00:00:00")), False).select("fingerprint", "state")


@query("auto_decisions", f"""WITH b AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type='error' AND event_id%3=0 AND user_id%2=0)
    SELECT doc_id AS proposal_id, CASE WHEN {sql_any('text', T.INJECTIONS)} OR k IS NOT NULL OR doc_id % 8 = 0 THEN 'shadow' ELSE 'approve' END AS decision FROM documents LEFT JOIN b ON k = doc_id""")
def auto_decisions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("proposal_id"), F.col("doc_id").alias("belief_id"), F.col("text").alias("body"), F.when(F.col("doc_id") % 8 == 0, "discard").otherwise("keep").alias("action"))
    blocked = table(spark, sf_dir, "events").where("event_type = 'error' and event_id % 3 = 0 and user_id % 2 = 0").select(F.col("user_id").alias("target_id")).distinct()
    return ops.auto_decide(d, blocked).select("proposal_id", "decision")


@query("consolidated_notes", """WITH f AS (SELECT n_regionkey AS r, n_name AS t, min(n_nationkey) AS f FROM nation GROUP BY ALL) SELECT r AS region, substring(string_agg('- ' || t, chr(10) ORDER BY f), 1, 700) AS body, count(*) AS n_lines FROM f GROUP BY r""")
def consolidated_notes(spark, sf_dir):
    return ops.consolidate(table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "region"), "region", "n_nationkey", "n_name")


@query("spend_of_a_day", "SELECT coalesce(round(sum(value), 4), 0.0) AS usd FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-15'")
def spend_of_a_day(spark, sf_dir):
    return ops.spend_today(table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("value").alias("usd")), "2024-01-15").select(F.round("usd", 4).alias("usd"))


# ---- session review -----------------------------------------------------------------------------------------------

REVIEWED = f"""WITH {V.PLAIN_TURNS_SQL}, w AS (SELECT *, coalesce(max((role='assistant')::INT) OVER (PARTITION BY session_id ORDER BY turn_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) = 1 AS answered, lag(role) OVER (PARTITION BY session_id ORDER BY turn_idx) AS prev FROM turns),
    s AS (SELECT session_id, turn_idx, 'user_correction' AS kind, 'bad' AS polarity, 0.8 AS weight FROM w WHERE role='user' AND k%6=1 AND answered
        UNION ALL SELECT session_id, turn_idx, 'user_thanks', 'good', 0.6 FROM w WHERE role='user' AND k%6=0
        UNION ALL SELECT session_id, turn_idx, 'user_approval', 'good', 0.5 FROM w WHERE role='user' AND k%6=3 AND prev='assistant'
        UNION ALL SELECT session_id, turn_idx, 'revert', 'bad', 0.7 FROM w WHERE role='user' AND k%6=5
        UNION ALL SELECT session_id, turn_idx, CASE text WHEN '12 passed' THEN 'test_pass' WHEN '3 failed' THEN 'test_fail' ELSE 'deploy_success' END, CASE WHEN text = '3 failed' THEN 'bad' ELSE 'good' END, CASE WHEN text = '12 passed' THEN 0.4 ELSE 0.6 END FROM w WHERE role='tool' AND text IN ('12 passed','3 failed','deployment succeeded'))"""


@query("review_signals", REVIEWED + " SELECT session_id, turn_idx, kind, polarity, weight::DOUBLE AS weight FROM s")
def review_signals(spark, sf_dir):
    return review.turn_signals(V.plain_turns(spark, sf_dir)).select("session_id", "turn_idx", "kind", "polarity", "weight")


@query("review_outcomes", REVIEWED + """, t AS (SELECT session_id, count(*) FILTER (role='tool' AND NOT tool_error) AS n_clean, count(*) FILTER (role='tool' AND tool_error) AS n_errors, min(turn_idx) FILTER (role='tool' AND tool_error) AS fe, max(turn_idx) FILTER (role='tool' AND tool_error) AS le, max(turn_idx) FILTER (role='tool' AND NOT tool_error) AS lc FROM turns GROUP BY 1),
    c AS (SELECT DISTINCT session_id, true AS corrected FROM s WHERE kind='user_correction'),
    o AS (SELECT t.*, coalesce(le > coalesce(lc, -1), false) AS ends_bad, coalesce(corrected, false) AS corrected FROM t LEFT JOIN c USING (session_id))
    SELECT session_id, 'error_recovery' AS kind, 0.6::DOUBLE AS weight FROM o WHERE n_errors > 0 AND n_clean > 0 AND NOT ends_bad AND lc > fe
    UNION ALL SELECT session_id, 'task_closeout_success', 0.7 FROM o WHERE n_clean >= 1 AND NOT ends_bad AND NOT corrected
    UNION ALL SELECT session_id, 'novel_workflow', 0.2 FROM o WHERE n_clean >= 3 AND session_id::BIGINT % 2 = 1""")
def review_outcomes(spark, sf_dir):
    t = V.plain_turns(spark, sf_dir)
    corrected = review.turn_signals(t).where("kind = 'user_correction'")
    known = t.where("cast(session_id as long) % 2 = 0").select("session_id")
    return review.outcome_signals(review.session_outcomes(t, 1, corrected), known).select("session_id", "kind", "weight")


@query("passive_waits", """WITH t AS (SELECT conv_id, turn, role, CASE conv_id % 4 WHEN 0 THEN 'Standing by.' WHEN 1 THEN 'Waiting for the run to finish' WHEN 2 THEN 'All done.' ELSE 'holding until the monitor reports' END AS text FROM conversations), l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
    SELECT conv_id::VARCHAR AS session_id FROM l WHERE role='assistant' AND conv_id % 4 <> 2""")
def passive_waits(spark, sf_dir):
    t = V.turns(spark, sf_dir).withColumn("text", V.pick(F.col("session_id").cast("long") % 4, "Standing by.", "Waiting for the run to finish", "All done.", "holding until the monitor reports"))
    return review.passive_waits(t).select("session_id")


@query("pending_calls", """WITH r AS (SELECT user_id AS s, event_id AS pos, CASE WHEN event_type IN ('view','click') THEN 'use' ELSE 'result' END AS kind, event_id % 7 AS c FROM events), a AS (SELECT s, c, max(pos) AS answered FROM r WHERE kind='result' GROUP BY ALL)
    SELECT r.s AS session_id, r.c AS call_id, r.pos FROM r LEFT JOIN a USING (s, c) WHERE r.kind='use' AND (answered IS NULL OR answered < pos)""")
def pending_calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return review.pending_calls(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type").isin("view", "click"), "use").otherwise("result").alias("kind"), (F.col("event_id") % 7).alias("call_id")))


@query("grades_and_calibration", """WITH g AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN NULL ELSE (o_orderkey % 11)/10.0 END AS score, o_orderkey % 2 = 0 AS accept FROM orders)
    SELECT count(*) FILTER (score IS NOT NULL) AS graded, count(*) FILTER (score IS NULL) AS errors, round(avg(((score >= 0.8) = accept)::INT) FILTER (score IS NOT NULL), 6) AS agreement FROM g""")
def grades_and_calibration(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    answer = F.when(k % 6 == 0, "no json").when(k % 6 == 1, '{"score": 7}').otherwise(F.concat(F.lit('{"score": '), ((k % 11) / 10.0).cast("string"), F.lit(', "reason": "r"}')))
    graded = review.grade(o.select(k.alias("id"), answer.alias("answer")))
    counts = graded.agg(F.count_if(F.col("grade_state") == "graded").alias("graded"), F.count_if(F.col("grade_state") == "error").alias("errors"))
    found = review.calibrate(graded.where("grade_state = 'graded'"), o.select(k.alias("id"), (k % 2 == 0).alias("accept")))
    return counts.crossJoin(F.broadcast(found.select(F.round("agreement", 6).alias("agreement"))))  # one row each


@query("stall_digest", """WITH f AS (SELECT o_orderkey AS k, 'agent ' || o_orderkey || ' waits since ' || strftime(o_orderdate, '%Y-%m-%d') AS b, o_orderdate AS d FROM orders WHERE o_orderkey % 7 = 0),
    r AS (SELECT *, row_number() OVER (ORDER BY d, k) AS nth, count(*) OVER () AS total, sum(length(b) + 2) OVER (ORDER BY d, k ROWS UNBOUNDED PRECEDING) AS used FROM f),
    z AS (SELECT *, length(total || ' stalled agent(s):') + used + CASE WHEN total - nth > 0 THEN length('… +' || (total - nth) || ' more (next digest)') + 1 ELSE 0 END AS size FROM r), k AS (SELECT * FROM z WHERE size <= 3900 OR nth = 1)
    SELECT any_value(total) || ' stalled agent(s):' || chr(10) || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY nth) || CASE WHEN any_value(total) > count(*) THEN chr(10) || chr(10) || '… +' || (any_value(total) - count(*)) || ' more (next digest)' ELSE '' END AS message, count(*) AS n_included FROM k""")
def stall_digest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0")
    block = F.concat(F.lit("agent "), F.col("o_orderkey").cast("string"), F.lit(" waits since "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return ops.digest_message(o.select(F.col("o_orderkey").alias("fingerprint"), block.alias("block"), F.col("o_orderdate").alias("seen_at")))
