"""Feedback: outcomes inferred from later events, coverage, signals and the decayed label fold."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evergrain.functions.ids import json_list, stable_id

EXPLICIT = ("helpful", "used", "irrelevant", "ignored", "harmful", "improved", "failed")


@dataclass(frozen=True)
class LabelRules:
    half_life_days: float = 30.0
    good: float = 0.35
    bad: float = -0.35
    min_mass: float = 0.6
    hard_bad: float = 0.9


def first_event_after(uses: DataFrame, log: DataFrame, now: str, hours: int = 24, look: int = 50) -> DataFrame:
    """retrieval_id, outcome, feedback_source inferred from what happens within `hours` after a serving.

    uses: retrieval_id, served_at, session_id, served_ids (array); log: event_seq, ts, kind, session_id, body_json. An event counts
    in the same session, or where its body names a served id. Two equi-joins (session and day; id named in the body, by the
    tokens of both, and day) replace the range join's all-pairs; of the first `look` events the first that says something wins.
    """
    pending = uses.where("outcome = 'served' and feedback_source is null").withColumn("at", F.to_timestamp("served_at")).where(F.col("at") <= F.to_timestamp(F.lit(now)))
    until = F.least(F.col("at") + F.expr(f"interval {int(hours)} hours"), F.to_timestamp(F.lit(now)))
    pending = pending.withColumn("until", until).select("retrieval_id", "session_id", "served_ids", "at", "until")
    events = log.select("event_seq", "kind", F.col("session_id").alias("event_session"), "body_json", F.to_timestamp("ts").alias("event_at"))
    inside = (F.col("event_at") > F.col("at")) & (F.col("event_at") <= F.col("until"))
    # a serving meets the events of the days of its window only
    day = lambda c: F.floor(F.unix_seconds(c) / 86_400)
    pending = pending.where("until > at").withColumn("day", F.explode(F.sequence(day(F.col("at")), day(F.col("until")))))
    events = events.withColumn("day", day(F.col("event_at")))
    # what no event names would bring all its servings to one task, so it goes before the joins
    by_session = _met(pending, "session_id", events.select(F.col("event_session").alias("session_id"))).join(events.withColumn("session_id", F.col("event_session")), ["session_id", "day"]).where(inside)
    tokens = F.array_distinct(F.regexp_extract_all("body_json", F.lit(r"([A-Za-z0-9_.:-]+)"), 1))
    asked = pending.select(F.explode("served_ids").alias("served_id")).distinct()
    named = events.withColumn("served_id", F.explode(tokens)).join(asked, "served_id", "left_semi")
    by_id = _met(pending.withColumn("served_id", F.explode("served_ids")), "served_id", named.select("served_id")).join(named, ["served_id", "day"]).where(inside).drop("served_id")
    rows = by_session.select(by_id.columns).unionByName(by_id).dropDuplicates(["retrieval_id", "event_seq"])
    exact = F.exists("served_ids", lambda s: F.col("body_json").contains(s))
    wrong = (F.col("kind") == "correction_recorded") & (F.get_json_object("body_json", "$.op").isin("mark_wrong", "retract") | F.coalesce(F.get_json_object("body_json", "$.hard").isin("true", "1"), F.lit(False)))
    source = F.when(exact & wrong, "inferred_exact_correction").when(exact, "inferred_exact_reference").when(F.col("kind").isin("evidence_recorded", "correction_recorded"), "inferred_session_evidence")
    w = Window.partitionBy("retrieval_id").orderBy("event_at", "event_seq")
    rows = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= look).withColumn("feedback_source", source).where("feedback_source is not null")
    first = rows.groupBy("retrieval_id").agg(F.min_by(F.struct("feedback_source", "event_seq"), "nth").alias("f"))
    outcome = F.when(F.col("f.feedback_source") == "inferred_exact_correction", "harmful").otherwise("used")
    return first.select("retrieval_id", outcome.alias("outcome"), F.col("f.feedback_source").alias("feedback_source"), F.col("f.event_seq").alias("event_seq"))


def _met(rows: DataFrame, key: str, there: DataFrame, salts: int = 16) -> DataFrame:
    """The rows whose key is there; rows of one key are dealt over as many tasks as salts, and only distinct keys are repeated for them."""
    each = there.distinct().withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("retrieval_id", "day"), F.lit(salts)).cast("int")).join(each, [key, "__salt"], "left_semi").drop("__salt")


def coverage(uses: DataFrame) -> DataFrame:
    """One row: servings, pending, explicit and inferred outcomes, and the share covered."""
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    inferred = F.coalesce(F.col("feedback_source").startswith("inferred"), F.lit(False))
    found = uses.agg(F.count(F.lit(1)).alias("total"), n(F.col("outcome") == "served", "pending"), n((F.col("outcome") != "served") & ~inferred, "explicit"), n((F.col("outcome") != "served") & inferred, "inferred"))
    return found.withColumn("coverage", F.round((F.col("total") - F.col("pending")) / F.greatest(F.col("total"), F.lit(1)), 6))


def signal(rows: DataFrame, kind: Column, polarity: Column, weight: Column, source: str, ref: Column, knowledge_id: Column, at: Column) -> DataFrame:
    """Signals with content ids, so that mining twice adds nothing."""
    out = rows.select(kind.alias("kind"), polarity.alias("polarity"), weight.cast("double").alias("weight"), F.lit(source).alias("source"), ref.alias("source_ref"), knowledge_id.alias("knowledge_id"), at.alias("occurred_at"))
    return out.withColumn("signal_id", stable_id("sig", F.col("source"), F.col("kind"), F.col("polarity"), F.col("source_ref"), F.col("knowledge_id"))).dropDuplicates(["signal_id"])


def union_signals(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["signal_id"])


#: What an outcome of a serving, a verifier's result, a gate rule, a commitment or a scheduled run counts as.
RETRIEVAL_VOTES = {
    "improved": ("good", 0.5), "helpful": ("good", 0.4), "used": ("good", 0.4), "harmful": ("bad", 0.9), "failed": ("bad", 0.6),
    "irrelevant": ("neutral", 0.2), "ignored": ("neutral", 0.1),
}
VERIFIER_VOTES = {"passed": ("good", 0.5), "failed": ("bad", 0.6)}
COMMITMENT_VOTES = {k: ("good", 0.5) for k in ("completed", "fulfilled", "done", "kept")} | {k: ("bad", 0.5) for k in ("expired", "missed", "broken", "failed")}
RUN_VOTES = {k: ("good", 0.3) for k in ("ok", "success", "completed")} | {k: ("bad", 0.5) for k in ("error", "failed", "failure")}
GATE_RULES = ("GATE", "CORRECTION")
VIOLATION_WEIGHT = 0.7


def _voted(rows: DataFrame, by: Column, votes: dict[str, tuple[str, float]]) -> DataFrame:
    """rows whose value has a vote, with it as __polarity and __weight."""
    polarity, weight = F.lit(None).cast("string"), F.lit(None).cast("double")
    for value, (p, w) in votes.items():
        polarity, weight = F.when(by == value, p).otherwise(polarity), F.when(by == value, w).otherwise(weight)
    return rows.withColumn("__polarity", polarity).withColumn("__weight", weight).where("__polarity is not null")


def retrieval_signals(uses: DataFrame) -> DataFrame:
    """Outcomes of servings as signals on what was served; an outcome without a vote gives none."""
    rows = _voted(uses, F.col("outcome"), RETRIEVAL_VOTES).withColumn("kid", F.explode("served_ids")).where("kid is not null")
    return signal(rows, F.lit("retrieval_feedback"), F.col("__polarity"), F.col("__weight"), "retrieval", F.concat(F.lit("retrieval_uses:"), F.col("retrieval_id").cast("string")), F.col("kid"), F.col("served_at"))


def correction_signals(log: DataFrame) -> DataFrame:
    """Hard corrections of knowledge or beliefs as bad signals of full weight; soft ones and other layers give none."""
    at = lambda name: F.get_json_object("body_json", f"$.{name}")
    hard = log.where("kind = 'correction_recorded'").where(at("hard").isin("true", "1") & at("target_layer").isin("knowledge", "belief"))
    return signal(hard, F.lit("hard_correction_event"), F.lit("bad"), F.lit(1.0), "events", F.concat(F.lit("brain_events:"), F.col("event_seq").cast("string")), at("target_id"), F.col("ts"))


def verifier_signals(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Passed and failed verifiers as signals on what the evidence is linked to."""
    rows = _voted(evidence.select("evidence_id", "verifier_status"), F.col("verifier_status"), VERIFIER_VOTES).join(links.select("evidence_id", "knowledge_id"), "evidence_id")
    return signal(rows, F.lit("verifier_result"), F.col("__polarity"), F.col("__weight"), "events", F.concat(F.lit("evidence:"), F.col("evidence_id").cast("string")), F.col("knowledge_id"), F.lit(None).cast("string"))


def learning_signals(learnings: DataFrame) -> DataFrame:
    """Active gate and correction rules as bad signals that weigh confidence (0.6) * min(1, 0.5 + 0.1 * recurrence (1)).

    learnings: learning_id, rule_type, status, confidence, recurrence.
    """
    rows = learnings.where(F.upper("rule_type").isin(*GATE_RULES) & F.lower(F.coalesce("status", F.lit("active"))).isin("active", ""))
    weight = F.coalesce("confidence", F.lit(0.6)) * F.least(F.lit(1.0), 0.5 + 0.1 * F.coalesce("recurrence", F.lit(1)))
    ref = F.concat(F.lit("learnings:"), F.col("learning_id").cast("string"))
    return signal(rows, F.lit("learning_gate_rule"), F.lit("bad"), weight, "learning_db", ref, F.lit(None).cast("string"), F.lit(None).cast("string"))


def violation_signals(violations: DataFrame) -> DataFrame:
    """Gate violations (violation_id) as bad signals."""
    ref = F.concat(F.lit("gate_violations:"), F.col("violation_id").cast("string"))
    return signal(violations, F.lit("gate_violation"), F.lit("bad"), F.lit(VIOLATION_WEIGHT), "learning_db", ref, F.lit(None).cast("string"), F.lit(None).cast("string"))


def commitment_signals(commitments: DataFrame) -> DataFrame:
    """Ended commitments (commitment_id, status, updated_at) as signals."""
    rows = _voted(commitments, F.lower("status"), COMMITMENT_VOTES)
    ref = F.concat(F.lit("commitment:"), F.col("commitment_id").cast("string"))
    return signal(rows, F.lit("commitment_outcome"), F.col("__polarity"), F.col("__weight"), "commitments", ref, F.lit(None).cast("string"), F.col("updated_at"))


def run_signals(runs: DataFrame) -> DataFrame:
    """Scheduled runs (job_id, status, delivered, updated_at) as signals; one that went well counts only where it was delivered."""
    rows = _voted(runs, F.lower("status"), RUN_VOTES).where((F.col("__polarity") == "bad") | F.coalesce("delivered", F.lit(True)))
    ref = F.concat(F.lit("cron:"), F.col("job_id").cast("string"), F.lit(":"), F.coalesce(F.col("updated_at").cast("string"), F.lit("")))
    return signal(rows, F.lit("cron_run"), F.col("__polarity"), F.col("__weight"), "cron", ref, F.lit(None).cast("string"), F.col("updated_at"))


def fold_labels(signals: DataFrame, now: Column, rules: LabelRules = LabelRules(), key: str = "knowledge_id") -> DataFrame:  # noqa: B008
    """key, label, confidence, score, mass: votes decay by half every half_life_days; a bad vote of full weight decides alone."""
    age = F.greatest((F.unix_micros(now) - F.unix_micros(F.to_timestamp("occurred_at"))) / 86_400_000_000.0, F.lit(0.0))
    decay = F.pow(F.lit(0.5), age / rules.half_life_days)
    sign = F.when(F.col("polarity") == "good", 1.0).when(F.col("polarity") == "bad", -1.0).otherwise(0.0)
    weight = F.coalesce("weight", F.lit(0.0))
    found = signals.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.sum(sign * weight * decay).alias("score"), F.sum(weight * decay).alias("mass"), F.count(F.lit(1)).alias("n"),
        F.max(F.when((F.col("polarity") == "bad") & (weight >= rules.hard_bad), weight)).alias("hard"),
    )
    ratio = F.col("score") / F.when(F.col("mass") > 0, F.col("mass"))
    enough = F.col("mass") >= rules.min_mass
    label = F.when(F.col("hard").isNotNull(), "bad").when(enough & (ratio >= rules.good), "good").when(enough & (ratio <= rules.bad), "bad").otherwise("neutral")
    soft = F.coalesce(F.least(F.lit(0.95), F.abs(ratio) * (F.col("n") / (F.col("n") + 1))), F.lit(0.0))
    confidence = F.when(F.col("hard").isNotNull(), F.least(F.lit(0.95), F.col("hard"))).otherwise(soft)
    return found.select(key, label.alias("label"), confidence.alias("confidence"), "score", "mass")


def served_ids(text: Column) -> Column:
    return F.filter(json_list(text), lambda s: F.trim(s) != "")


def attribute(signals: DataFrame, hits: DataFrame, knowledge: DataFrame, prefix: str = "know") -> DataFrame:
    """Signals without an object get the best search hit for their text, where its id has the prefix and it shares a word of three letters or more.

    hits: signal_id, knowledge_id, rank; knowledge: knowledge_id, text; signals: signal_id, text."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    best = hits.where("rank = 1").where(F.col("knowledge_id").startswith(prefix)).join(signals.select("signal_id", F.col("text").alias("said")), "signal_id").join(knowledge.select("knowledge_id", "text"), "knowledge_id")
    return best.where(F.arrays_overlap(words(F.col("said")), words(F.col("text")))).select("signal_id", "knowledge_id")
