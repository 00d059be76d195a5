"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrain.operators.scans import ScanStore
from evergrain.session import table
from evergrain.sources.store import shared_folder

NOW = "2030-01-01 00:00:00"


def pick(expr, *values):
    """values[expr]."""
    return F.element_at(F.array(*[v if hasattr(v, "_jc") else F.lit(v) for v in values]), (expr + 1).cast("int"))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of few bytes and much work each, which may lie in one file, over all shuffle partitions."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as beliefs; scope, visibility and policy follow from the id, source and language."""
    d, doc = table(spark, sf_dir, "documents"), F.col("doc_id")
    src = F.col("source")
    return d.select(
        doc.alias("belief_id"), F.col("text").alias("body"), "lang", src,
        pick(doc % 5, "global", "project", "client", "legacy_unscoped", "repo").alias("scope_type"),
        pick(doc % 5, F.lit("global:doctrine"), F.concat(F.lit("project:"), src), F.concat(F.lit("client:"), src), F.lit("legacy:unscoped"), F.concat(F.lit("repo:"), src)).alias("scope_id"),
        pick(doc % 7, "confidential", "secret", "public", "internal", "internal", "internal", "internal").alias("visibility"),
        pick(doc % 4, "hosted_ok", "local_only", "approval_required", "prohibited").alias("egress_policy"),
        ((doc % 10) / 10.0).alias("confidence"), (doc % 11 == 0).alias("pinned"), F.lit("current").alias("status"), F.lit(True).alias("serve"),
    )


BELIEFS_SQL = """beliefs AS (
    SELECT doc_id AS belief_id, text AS body, lang, source,
        CASE doc_id % 5 WHEN 0 THEN 'global' WHEN 1 THEN 'project' WHEN 2 THEN 'client' WHEN 3 THEN 'legacy_unscoped' ELSE 'repo' END AS scope_type,
        CASE doc_id % 5 WHEN 0 THEN 'global:doctrine' WHEN 1 THEN 'project:' || source WHEN 2 THEN 'client:' || source WHEN 3 THEN 'legacy:unscoped' ELSE 'repo:' || source END AS scope_id,
        CASE doc_id % 7 WHEN 0 THEN 'confidential' WHEN 1 THEN 'secret' WHEN 2 THEN 'public' ELSE 'internal' END AS visibility,
        CASE doc_id % 4 WHEN 0 THEN 'hosted_ok' WHEN 1 THEN 'local_only' WHEN 2 THEN 'approval_required' ELSE 'prohibited' END AS egress_policy,
        (doc_id % 10) / 10.0 AS confidence, doc_id % 11 = 0 AS pinned
    FROM documents
)"""


def kept_scans(spark: SparkSession) -> ScanStore:
    """Scans of all texts that a query of this cluster has met."""
    return ScanStore(spark, f"{shared_folder(spark)}/evergrain-kept/scans")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as turns; every third answer has tool calls."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("turn_idx"), "role", F.when(F.col("role") == "user", "bare").otherwise("").alias("kind"),
        "text", F.lit(None).cast("string").alias("ts"), F.lit(False).alias("tool_error"),
        F.when((F.col("role") == "assistant") & (F.col("conv_id") % 3 == 0), 6).otherwise(0).cast("long").alias("n_tool_calls"),
        F.when(F.col("role") == "user", F.concat(F.lit("u"), (F.col("conv_id") % 4).cast("string"))).alias("authored_by"), ((F.col("role") == "user") & (F.col("conv_id") % 2 == 0)).alias("sender_verified"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of beliefs, one for each user: a purchase proposes and a signup approves it in the same event pair.

    Every event becomes one log row; clicks record evidence, views propose, purchases approve the user's last proposal,
    errors correct (mark_wrong on odd ids, demote on even ones), signups bury.
    """
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    user = F.concat(F.lit("bel_"), F.col("user_id").cast("string"))
    kinds = F.create_map(*[F.lit(x) for x in ("click", "evidence_recorded", "view", "compilation_proposed", "purchase", "compilation_decided", "error", "correction_recorded", "signup", "tombstone_recorded")])
    w = Window.partitionBy("user_id").orderBy("event_id")
    proposal = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    e = e.withColumn("proposal", proposal)
    evt = lambda c: F.concat(F.lit("evt_"), c.cast("string"))
    body = (
        F.when(F.col("event_type") == "click", F.to_json(F.struct(F.concat(F.lit("evd_"), F.col("event_id").cast("string")).alias("evidence_id"), F.col("props").alias("body"), F.lit("observation").alias("kind"))))
        .when(F.col("event_type") == "view", F.to_json(F.struct(user.alias("belief_id"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("body"), F.round(F.col("value") / 1000, 3).alias("confidence"), F.array(F.concat(F.lit("evd_"), F.col("event_id").cast("string"))).alias("evidence_ids"))))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(evt(F.col("proposal")).alias("proposal_event_id"), F.lit("approve").alias("decision"))))
        .when(F.col("event_type") == "error", F.to_json(F.struct(F.lit("belief").alias("target_layer"), user.alias("target_id"), F.when(F.col("event_id") % 2 == 1, "mark_wrong").otherwise("demote").alias("op"), (F.col("event_id") % 3 == 0).alias("hard"))))
        .otherwise(F.to_json(F.struct(user.alias("target"), F.lit("hide").alias("mode"))))
    )
    return e.select(
        F.col("event_id").alias("event_seq"), evt(F.col("event_id")).alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), kinds[F.col("event_type")].alias("kind"),
        F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string")).alias("writer"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), body.alias("body_json"), "user_id",
    )


def varied_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log in which every operation occurs, of fifty beliefs for each user."""
    from pyspark.sql import Window

    k, kind = F.col("event_id"), F.col("event_type")
    e = table(spark, sf_dir, "events").withColumn("b", F.col("user_id") * 50 + k % 50)
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    seen = F.last(F.when(kind == "view", k), ignorenulls=True).over(Window.partitionBy("b").orderBy("event_id"))
    e = e.withColumn("proposal", seen).withColumn("belief", text("bel_", F.col("b")))
    scope = lambda name: F.struct(F.lit("project").alias("scope_type"), name.alias("scope_id"), F.lit("internal").alias("visibility"), F.lit("local_only").alias("egress_policy")).alias("scope")
    decision = F.when(k % 7 == 0, "reject").when(k % 5 == 0, "edit").otherwise("approve")
    body = (
        F.when(kind == "click", F.to_json(F.struct(text("evd_", k).alias("evidence_id"), F.lit("seen").alias("body"))))
        .when(kind == "view", F.to_json(F.struct(F.col("belief").alias("belief_id"), text("v", k).alias("body"), F.round(F.col("value") / 1000, 3).alias("confidence"), F.array(text("evd_", k)).alias("evidence_ids"), scope(F.lit("global:doctrine")))))
        .when(kind == "purchase", F.to_json(F.struct(text("evt_", F.col("proposal")).alias("proposal_event_id"), decision.alias("decision"), F.when(decision == "edit", text("x", k)).alias("edited_body"))))
        .when(kind == "error", F.to_json(F.struct(F.lit("belief").alias("target_layer"), F.col("belief").alias("target_id"), pick(k % 6, "edit", "pin", "demote", "mark_wrong", "reframe", "retract").alias("op"), text("e", k).alias("body"), (k % 4 == 0).alias("hard"))))
        .when(k % 3 == 0, F.to_json(F.struct(F.col("belief").alias("target"), F.when(k % 2 == 0, "shred").otherwise("hide").alias("mode"))))
        .otherwise(F.to_json(F.struct(F.col("belief").alias("belief_id"), F.when(k % 5 != 0, "someone").alias("approved_by"), scope(text("project:", k)))))
    )
    named = F.when(kind == "click", "evidence_recorded").when(kind == "view", "compilation_proposed").when(kind == "purchase", "compilation_decided").when(kind == "error", "correction_recorded")
    return e.select(k.alias("event_seq"), text("evt_", k).alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.coalesce(named, F.when(k % 3 == 0, "tombstone_recorded").otherwise("scope_promoted")).alias("kind"), F.lit("w").alias("writer"), F.lit("s").alias("session_id"), body.alias("body_json"))


def plain_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as turns whose texts need no cleaning: users ask, thank, approve or correct, every fifth answer is a tool's result."""
    c, t = table(spark, sf_dir, "conversations"), F.col("turn")
    k = F.col("conv_id") * 7 + t * 3
    n = t.cast("string")
    asked = pick(k % 6, "thanks, that is perfect", F.concat(F.lit("that's wrong, not what i asked "), n), F.concat(F.lit("please list item "), n), "yes, go ahead", F.concat(F.lit("what about part "), n), F.lit("rolling back the change"))
    result = pick(k % 5, "12 passed", "3 failed", "deployment succeeded", "error: no such file", "done")
    answer = F.concat(F.lit("answer "), n, F.lit(" "), F.repeat(F.lit("lorem ipsum "), (k % 13 + 1).cast("int")), F.lit("end"))
    tool = (F.col("role") == "assistant") & (k % 5 == 4)
    role = F.when(tool, "tool").otherwise(F.col("role"))
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"), t.alias("turn_idx"), role.alias("role"), F.when(role == "user", "bare").otherwise("").alias("kind"),
        F.when(role == "user", asked).when(tool, result).otherwise(answer).alias("text"), F.lit(None).cast("string").alias("ts"), (tool & (k % 3 == 0)).alias("tool_error"),
        F.when(role == "assistant", F.col("conv_id") % 3).otherwise(0).cast("long").alias("n_tool_calls"), F.when(role == "user", F.concat(F.lit("u"), (F.col("conv_id") % 4).cast("string"))).alias("authored_by"), ((role == "user") & (F.col("conv_id") % 2 == 0)).alias("sender_verified"),
    )


PLAIN_TURNS_SQL = """k AS (SELECT conv_id, turn, role, conv_id*7 + turn*3 AS k FROM conversations),
    r AS (SELECT *, CASE WHEN role='assistant' AND k%5=4 THEN 'tool' ELSE role END AS who FROM k),
    turns AS (SELECT conv_id::VARCHAR AS session_id, turn AS turn_idx, who AS role, k, CASE who
        WHEN 'user' THEN CASE k%6 WHEN 0 THEN 'thanks, that is perfect' WHEN 1 THEN 'that''s wrong, not what i asked '||turn WHEN 2 THEN 'please list item '||turn WHEN 3 THEN 'yes, go ahead' WHEN 4 THEN 'what about part '||turn ELSE 'rolling back the change' END
        WHEN 'tool' THEN CASE k%5 WHEN 0 THEN '12 passed' WHEN 1 THEN '3 failed' WHEN 2 THEN 'deployment succeeded' WHEN 3 THEN 'error: no such file' ELSE 'done' END
        ELSE 'answer '||turn||' '||repeat('lorem ipsum ', k%13+1)||'end' END AS text, who='tool' AND k%3=0 AS tool_error, CASE WHEN who='assistant' THEN conv_id%3 ELSE 0 END AS n_tool_calls, who='user' AND conv_id%2=0 AS sender_verified FROM r)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as votes on users."""
    e = table(spark, sf_dir, "events")
    polarity = F.when(F.col("event_type").isin("purchase", "signup"), "good").when(F.col("event_type") == "error", "bad").otherwise("neutral")
    return e.select(F.col("user_id").alias("knowledge_id"), polarity.alias("polarity"), (0.1 + (F.col("event_id") % 9) / 10.0).alias("weight"), F.col("ts").alias("occurred_at"))


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as knowledge rows."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("knowledge_id"), pick(F.col("o_orderkey") % 3, "current", "candidate", "stale").alias("status"), F.col("o_orderdate").alias("updated_at"),
                    ((F.col("o_orderkey") % 10) / 10.0).alias("quality_confidence"), pick(F.col("o_orderkey") % 4, "private", "workspace", "project", "public").alias("privacy_scope"))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as servings of orders."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 and l_orderkey % 3 <> 1")
    return rows.select(F.col("l_orderkey").alias("knowledge_id"), F.when(F.col("l_returnflag") == "R", "harmful").when(F.col("l_returnflag") == "A", "used").otherwise("served").alias("outcome"), F.col("l_shipdate").alias("served_at"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as dataset examples."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("id"), pick(F.col("doc_id") % 3, "sft", "dpo", "persona").alias("dataset"), pick(F.col("doc_id") % 5, "correction_event", "git_commit", "a_session", "authored_doc", "other").alias("source_kind"),
        F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").otherwise("neutral").alias("quality_label"), pick(F.col("doc_id") % 4, "private", "workspace", "project", "public").alias("privacy_scope"),
        ((F.col("doc_id") % 10) / 10.0).alias("grade_score"), "text", F.col("lang"),
    )
