"""Registered queries of what is applied under rules: grading under caps, curated facts, loop results into many tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evergrain.operators import curated, factory, fold, ops
from evergrain.operators.grading import Caps, GradeLedger, request_hash
from evergrain.session import table
from evergrain.sources import files
from evergrain.streaming.ingest import LoopTables

from . import views as V
from .queries_store import _fresh_root
from .registry import CONTEXT, WEIGHT, now, query


@query("grading_admission", """WITH c AS (SELECT doc_id, text, doc_id % 3 AS priority, greatest(length(text) // 4, 1) AS cost FROM documents), a AS (SELECT DISTINCT text FROM documents WHERE doc_id % 10 = 0),
    f AS (SELECT text, min({'p': priority, 'id': doc_id, 'c': cost}) AS r FROM c WHERE text NOT IN (SELECT text FROM a) GROUP BY text), n AS (SELECT r.id AS example_id, r.c AS cost, row_number() OVER w AS nth, sum(r.c) OVER w AS used FROM f WINDOW w AS (ORDER BY r.p, r.id))
    SELECT example_id, cost, nth FROM n WHERE nth <= 300 AND used <= 60000""")
def grading_admission(spark, sf_dir):
    """Which requests a run may send, after the answers to a tenth of all are in the ledger of the day before."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("example_id"), (F.col("doc_id") % 3).alias("priority"), F.greatest(F.floor(F.length("text") / 4), F.lit(1)).cast("long").alias("cost"), request_hash("m", "v1", F.lit("taste"), F.col("text")).alias("request_hash"))
    ledger = GradeLedger(spark, _fresh_root(spark, "grades"))
    ledger.record(rows.where("example_id % 10 = 0").withColumn("score", F.lit(0.5)), "2024-01-01")
    return ledger.admit(rows, "2024-01-02", Caps(run_items=300, day_items=1000, run_cost=60_000, day_cost=10**9)).select("example_id", "cost", "nth")


@query("curated_fact_verdicts", """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE text END AS body FROM documents UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 29 = 0), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS times FROM f)
    SELECT 'f' || doc_id AS id, array_to_string(list_filter([CASE WHEN trim(coalesce(body, ''), ' ') = '' THEN 'no_body' END, CASE WHEN times > 1 THEN 'duplicate_id' END, CASE WHEN doc_id % 19 = 0 THEN 'no_source' END, CASE WHEN doc_id % 17 = 0 AND doc_id % 19 <> 0 THEN 'unknown_source' END,
        CASE WHEN doc_id % 4 = 0 AND doc_id % 7 < 2 THEN 'hosted_but_closed' END, CASE WHEN doc_id % 4 = 0 THEN 'hosted_not_acknowledged' END], lambda x: x IS NOT NULL), ',') AS verdicts FROM n""")
def curated_fact_verdicts(spark, sf_dir):
    """What is wrong with each of many facts, some named twice, some without sources or with unknown ones."""
    b, k = V.beliefs(spark, sf_dir), F.col("belief_id")
    refs = F.when(k % 19 == 0, F.array().cast("array<string>")).when(k % 17 == 0, F.array(F.lit("s0"), F.lit("s9"))).otherwise(F.array(F.concat(F.lit("s"), (k % 5).cast("string"))))
    facts = b.select(F.concat(F.lit("f"), k.cast("string")).alias("id"), F.when(k % 13 == 0, " ").otherwise(F.col("body")).alias("body"), refs.alias("source_refs"), "visibility", "egress_policy", k)
    facts = facts.unionByName(facts.where(k % 29 == 0).drop("body").join(b.select("belief_id", "body"), "belief_id")).drop("belief_id")
    sources = table(spark, sf_dir, "region").select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("ref"), F.lit("ok").alias("verdict"))
    return curated.fact_verdicts(facts, sources).select("id", F.array_join("verdicts", ",").alias("verdicts"))


def _envelopes(spark, sf_dir):
    """events as result envelopes, one in eleven kept without a verifier."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    kept = F.col("event_type") == "purchase"
    data = F.struct(
        F.lit("1").alias("schema_version"), F.concat(F.lit("loop"), (k % 3).cast("string")).alias("loop_id"), F.lit("run").alias("run_id"), F.concat(F.lit("i"), k.cast("string")).alias("item_id"),
        F.when(kept, "kept").when(F.col("event_type") == "error", "failed").otherwise("reverted").alias("decision"), F.when(F.col("event_type") == "error", V.pick(k % 3, "approach", "infra", "safety")).alias("failure_class"),
        F.concat(F.lit("fam"), (k % 4).cast("string")).alias("experiment_family"),
        F.struct(F.lit("score").alias("metric_name"), F.lit("higher_is_better").alias("direction"), F.col("value").cast("string").alias("result_value"), F.lit("1").alias("delta_value"), kept.alias("passed")).alias("eval"),
        F.struct((kept & (k % 11 != 0)).alias("passed")).alias("verifier"), F.array(F.struct(F.lit("memory").alias("target"), F.concat(F.lit("lesson "), (k % 50).cast("string")).alias("body"))).alias("lesson_candidates"),
        F.array(F.struct(F.lit("budget").alias("name"), (k % 13 != 0).alias("passed"))).alias("guardrails"),
    )
    errors = F.array_compact(F.array(F.when(kept & (k % 11 == 0), F.lit("kept_without_verifier"))))
    return e.select(F.concat(F.lit("/r/"), k.cast("string")).alias("path"), F.from_json(F.to_json(data), files.ENVELOPE).alias("data"), errors.alias("errors"), k)


@query("loop_tables", """WITH e AS (SELECT *, event_type='purchase' AND event_id%11=0 AS bad FROM events), n AS (SELECT 'evidence' AS name, count(*) AS n FROM e WHERE NOT bad UNION ALL SELECT 'metrics', count(*) FROM e WHERE NOT bad UNION ALL SELECT 'results', count(*) FROM e WHERE NOT bad
    UNION ALL SELECT 'lessons', count(DISTINCT (event_id%3, event_id%50)) FROM e WHERE NOT bad UNION ALL SELECT 'tripwires', count(*) FROM e WHERE bad OR event_id%13=0)
    SELECT name, n FROM n UNION ALL SELECT 'loop' || event_id%3 || ' fam' || event_id%4, count(*) FROM e WHERE NOT bad GROUP BY 1""")
def loop_tables(spark, sf_dir):
    """Rows of each table, and attempts of each family, after overlapping batches of which one comes twice."""
    rows = _envelopes(spark, sf_dir)
    kept = LoopTables(spark, _fresh_root(spark, "loops"))
    kept.step(rows.where("event_id % 2 = 0"), 0)
    kept.step(rows.where("event_id % 3 <> 0"), 1)
    kept.step(rows.where("event_id % 3 <> 0"), 1)
    kept.step(rows, 2)
    out = kept.families().select(F.concat_ws(" ", "loop_id", "family").alias("name"), F.col("attempts").alias("n"))
    for name in ("evidence", "metrics", "results", "lessons", "tripwires"):
        out = out.unionByName(kept.table(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n"))
    return out


# ---- judging, healing and pairs from events -------------------------------------------------------------------------


@query("judge_rows", """WITH s AS (SELECT user_id AS k, sum((0.1 + (event_id % 9) / 10.0) * pow(0.5, epoch(TIMESTAMP '2024-02-01' - ts) / 86400 / 30)) AS mass FROM events WHERE user_id % 3 <> 0 GROUP BY 1)
    SELECT o_orderkey AS knowledge_id FROM orders LEFT JOIN s ON k = o_orderkey WHERE o_orderkey % 3 <> 2 AND o_orderkey % 7 <> 0 AND ((o_orderkey % 2 = 0 AND coalesce(mass, 0) >= 0.3) OR (o_orderkey % 2 = 1 AND mass IS NULL))
    ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE (o_orderkey % 10) / 10.0 END DESC, (o_orderkey % 11) / 11.0 DESC, o_orderkey LIMIT 50""")
def judge_rows(spark, sf_dir):
    k = F.col("knowledge_id")
    rows = V.knowledge(spark, sf_dir).withColumn("quarantine_reason", F.when(k % 7 == 0, "spike")).withColumn("quality_label", F.when(k % 2 == 0, "neutral"))
    rows = rows.withColumn("promote_score", F.when(k % 5 != 0, (k % 10) / 10.0)).withColumn("confidence", (k % 11) / 11.0)
    return ops.judge_rows(rows, V.signals(spark, sf_dir).where(k % 3 != 0), F.to_timestamp(F.lit("2024-02-01 00:00:00"))).select("knowledge_id")


@query("judged_labels", """WITH v AS (SELECT DISTINCT o_custkey AS k, o_orderkey AS h, CASE o_orderkey % 5 WHEN 0 THEN 'bad' WHEN 1 THEN 'neutral' WHEN 2 THEN 'unsure' ELSE 'good' END AS label FROM orders),
    f AS (SELECT k, sum(CASE label WHEN 'good' THEN 0.4 WHEN 'bad' THEN -0.4 ELSE 0 END) AS score, sum(0.4) AS mass FROM v WHERE label <> 'unsure' GROUP BY 1)
    SELECT k AS knowledge_id, round(score, 6)::DOUBLE AS score, round(mass, 6)::DOUBLE AS mass FROM f""")
def judged_labels(spark, sf_dir):
    """Verdicts folded into labels as votes of little weight."""
    from evergrain.operators import feedback

    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    verdicts = o.select(F.col("o_custkey").alias("knowledge_id"), V.pick(k % 5, "bad", "neutral", "unsure", "good", "good").alias("label"), k.cast("string").alias("request_hash"))
    found = feedback.fold_labels(ops.judge_signals(verdicts, F.lit(V.NOW)), now())
    return found.select("knowledge_id", F.round("score", 6).alias("score"), F.round("mass", 6).alias("mass"))


@query("hosted_batch", f"""WITH {V.BELIEFS_SQL}, t AS (SELECT *, {WEIGHT.format(unscoped='0.0', other='0.0')} AS w, egress_policy='hosted_ok' AND visibility NOT IN ('confidential','secret') AND scope_type<>'client' AS host FROM beliefs)
    SELECT belief_id AS knowledge_id, CASE WHEN belief_id % 6 = 0 OR w = 0 THEN false ELSE host END AS included, CASE WHEN belief_id % 6 = 0 THEN 'private_scope' WHEN w = 0 THEN 'scope_mismatch' WHEN host THEN 'allowed_hosted' ELSE 'egress_policy:'||egress_policy||';visibility:'||visibility END AS reason,
        CASE WHEN belief_id % 6 <> 0 AND w <> 0 AND host THEN 'note '||belief_id||' key [REDACTED]' END AS text FROM t""")
def hosted_batch(spark, sf_dir):
    k = F.col("belief_id")
    rows = V.beliefs(spark, sf_dir).withColumn("knowledge_id", k).withColumn("privacy_scope", F.when(k % 6 == 0, "private").otherwise("workspace"))
    return ops.hosted_batch(rows, CONTEXT, F.concat(F.lit("note "), k.cast("string"), F.lit(" key sk-abcdefghijklmnopqrstu")))


@query("heal_signals", """WITH v AS (SELECT s_suppkey AS id, s_nationkey % 5 AS s, s_nationkey % 3 AS p, s_acctbal AS n FROM supplier), g AS (SELECT s, p FROM v GROUP BY ALL HAVING count(*) > 1 AND max(n) - min(n) > 1), w AS (SELECT s, p, min(id) AS winner FROM v JOIN g USING (s, p) GROUP BY ALL),
    h AS (SELECT id AS loser, winner FROM v JOIN w USING (s, p) WHERE id <> winner) SELECT loser AS knowledge_id, 'bad' AS polarity, 0.4::DOUBLE AS weight, 'loser:'||winner||':'||loser AS source_ref FROM h UNION ALL SELECT winner, 'good', 0.3, 'winner:'||winner||':'||loser FROM h""")
def heal_signals(spark, sf_dir):
    s, none = table(spark, sf_dir, "supplier"), F.lit(None)
    rows = s.select(F.col("s_suppkey").alias("knowledge_id"), (F.col("s_nationkey") % 5).alias("subject"), (F.col("s_nationkey") % 3).alias("predicate"), none.cast("string").alias("project"), F.col("s_acctbal").alias("value_numeric"),
                    none.cast("string").alias("value_text"), none.cast("boolean").alias("value_bool"), F.lit(0.5).alias("confidence"), F.lit("2024-01-01").alias("updated_at"))
    return ops.heal_signals(ops.heal_conflicts(rows, 1.0), now()).select("knowledge_id", "polarity", "weight", "source_ref")


_OLD = "'the plan for part '||{0}||' names a quiet river crossing near town'"
_NEW = "'the plan for part '||{0}||' names the northern bridge '||{1}||' instead of any ferry'"


def _said(head: str, *parts):
    pieces = head.split("#")
    cols = [F.lit(pieces[0])]
    for piece, part in zip(pieces[1:], parts):
        cols += [part.cast("string"), F.lit(piece)]
    return F.concat(*cols)


@query("correction_pairs", f"""SELECT 'evt_'||event_id AS event_id, 'k'||user_id AS knowledge_id, 'State the correct value for: subject '||user_id AS prompt, {_OLD.format('user_id')} AS rejected, {_NEW.format('user_id', 'event_id')} AS chosen, CASE WHEN event_id % 4 = 0 THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence
    FROM events WHERE event_type = 'error' AND event_id % 3 <> 0 AND user_id % 2 = 0""")
def correction_pairs(spark, sf_dir):
    e, k, u = V.dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")), F.col("event_id"), F.col("user_id")
    key = _said("k#", u)
    body = F.to_json(F.struct(F.lit("knowledge").alias("target_layer"), key.alias("target_id"), V.pick(k % 3, "retract", "edit", "reframe").alias("op"), _said("the plan for part # names the northern bridge # instead of any ferry", u, k).alias("body"), (k % 4 == 0).alias("hard")))
    log = e.where("event_type = 'error'").select(_said("evt_#", k).alias("id"), F.lit("correction_recorded").alias("kind"), body.alias("body_json"), F.col("ts").cast("string").alias("ts"))
    rows = e.select("user_id").distinct().select(key.alias("knowledge_id"), _said("the plan for part # names a quiet river crossing near town", u).alias("value_text"), F.lit("title").alias("title"), _said("subject #", u).alias("subject"), F.lit(None).cast("string").alias("predicate"))
    links = e.where(u % 2 == 0).select(key.alias("knowledge_id"))
    return factory.correction_pairs(log, rows, links).select("event_id", "knowledge_id", "prompt", "rejected", "chosen", "confidence")


@query("superseded_pairs", f"""SELECT 'k'||s_suppkey AS loser_id, 'w'||s_suppkey AS knowledge_id, 'State the current value for: bridge '||s_suppkey AS prompt, {_OLD.format('s_suppkey')} AS rejected, {_NEW.format('s_suppkey', 's_nationkey')} AS chosen FROM supplier WHERE s_suppkey % 3 <> 0""")
def superseded_pairs(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    common = lambda text, by: (F.lit("value").alias("type"), text.alias("value_text"), F.lit("bridge").alias("subject"), k.cast("string").alias("predicate"), by.alias("superseded_by"))
    losers = s.select(_said("k#", k).alias("knowledge_id"), *common(_said("the plan for part # names a quiet river crossing near town", k), _said("w#", k)))
    winners = s.select(_said("w#", k).alias("knowledge_id"), *common(_said("the plan for part # names the northern bridge # instead of any ferry", k, F.col("s_nationkey")), F.lit(None).cast("string")))
    return factory.superseded_pairs(losers.unionByName(winners), s.where(k % 3 != 0).select(_said("w#", k).alias("knowledge_id"))).select("loser_id", "knowledge_id", "prompt", "rejected", "chosen")


@query("search_titles", """SELECT doc_id::VARCHAR AS doc_id, CASE doc_id % 3 WHEN 0 THEN 'title '||source WHEN 1 THEN 'subject '||source ELSE doc_id::VARCHAR END AS title, 'belief:note' AS kind FROM documents WHERE doc_id % 4 <> 1""")
def search_titles(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    said = F.when(k % 3 == 0, F.to_json(F.struct(F.concat(F.lit("title "), "source").alias("title")))).when(k % 3 == 1, F.to_json(F.struct(F.lit("").alias("title"), F.concat(F.lit("subject "), "source").alias("subject"))))
    rows = d.select(k.cast("string").alias("belief_id"), F.col("text").alias("body"), (k % 4 != 1).alias("serve"), F.lit("current").alias("status"), F.lit("note").alias("belief_type"), said.alias("attributes"))
    return fold.search_rows(rows).select("doc_id", "title", "kind")
