"""Operations on knowledge rows: promotion, tripwires, pruning, healing, loop families, stalls and deadlines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evergrain.functions import text as T
from evergrain.functions.scope import ScopeContext, egress, privacy_rank

from .scans import ScanStore

USEFUL = ("improved", "helpful", "used")
APPROVALS = ("user_approval", "user_thanks")
PINNED = ("human", "human_bootstrap")
THIRD_PARTY = ("web", "email", "external")


@dataclass(frozen=True)
class OpsRules:
    bad_feedback_count: int = 2
    bad_feedback_days: int = 7
    thrash_count: int = 3
    thrash_days: int = 14
    min_confidence: float = 0.6
    bootstrap_confidence: float = 0.85
    max_injected: int = 40
    max_chars: int = 6000
    decay_days: int = 30


def age_days(ts: Column, now: Column) -> Column:
    return F.greatest((F.unix_micros(now) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000.0, F.lit(0.0))


def promote_score(quality: Column, updated: Column, served: Column, useful: Column, scope: Column, now: Column, decay_days: int = 30) -> Column:
    """0.4 quality + 0.25 recency + 0.2 use rate + 0.15 scope."""
    recent = F.coalesce(F.pow(F.lit(0.5), age_days(updated, now) / decay_days), F.lit(1.0))
    rate = F.coalesce(useful, F.lit(0)) / F.greatest(F.lit(1), F.coalesce(served, F.lit(0)))
    return 0.4 * F.coalesce(quality, F.lit(0.0)) + 0.25 * recent + 0.2 * rate + 0.15 * privacy_rank(scope) / 3.0


def use_counts(uses: DataFrame, key: str = "knowledge_id") -> DataFrame:
    return uses.groupBy(key).agg(F.count(F.lit(1)).alias("served"), F.sum(F.col("outcome").isin(*USEFUL).cast("long")).alias("useful"))


def flagged_texts(rows: DataFrame, text: Column, name: str = "dirty", scans: ScanStore | None = None) -> DataFrame:
    """rows with whether the text has an injection or a leak; each text is scanned once, wherever the flag is used, or known from kept scans."""
    if scans is not None:
        return scans.flags(rows, text).withColumn(name, (F.size("injections") > 0) | (F.size("leaks") > 0)).drop("injections", "leaks")
    bad = F.explode(F.array((F.size(T.injections(text)) > 0) | (F.size(T.secret_leaks(text)) > 0)))
    return rows.select("*", bad.alias(name))


def evidence_flags(links: DataFrame, evidence: DataFrame, scans: ScanStore | None = None) -> DataFrame:
    """knowledge_id, passed, dirty, flagged: a verifier passed some evidence; some claim has an injection or a leak; some third-party evidence is flagged.

    Claims are scanned once for each piece of evidence, before it meets its links.
    """
    scored = flagged_texts(evidence.select("evidence_id", "claim", "verifier_status", "source_type", "injection_scan_status"), F.coalesce("claim", F.lit("")), scans=scans)
    scored = scored.select("evidence_id", "dirty", (F.col("verifier_status") == "passed").alias("passed"), (F.col("source_type").isin(*THIRD_PARTY) & (F.col("injection_scan_status") == "flagged")).alias("flagged"))
    return links.select("knowledge_id", "evidence_id").join(scored, "evidence_id").groupBy("knowledge_id").agg(F.max("passed").alias("passed"), F.max("dirty").alias("dirty"), F.max("flagged").alias("flagged"))


def promote(knowledge: DataFrame, uses: DataFrame, links: DataFrame, evidence: DataFrame, signals: DataFrame, now: Column, rules: OpsRules = OpsRules()) -> DataFrame:  # noqa: B008
    """knowledge_id, promote_score, eligible, inject: the best max_injected eligible rows, less what does not fit into max_chars.

    Ranked by score and id, both descending. While the rendered rows are too long the one with the lowest score (ties: the
    smallest id) goes, but for rows that a person put there (origin), which stay. What a row takes is its body.
    """
    flags = evidence_flags(links, evidence)
    approved = signals.where(F.col("kind").isin(*APPROVALS) & (F.col("polarity") == "good")).select("knowledge_id").distinct().withColumn("approved", F.lit(True))
    rows = knowledge if "origin" in knowledge.columns else knowledge.withColumn("origin", F.lit(None).cast("string"))
    rows = flagged_texts(rows, F.coalesce("body", F.lit("")), "body_dirty")
    rows = rows.join(use_counts(uses), "knowledge_id", "left").join(flags, "knowledge_id", "left").join(approved, "knowledge_id", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    normal = (F.col("quality_label") == "good") & (F.coalesce("quality_confidence", F.lit(0.0)) >= rules.min_confidence)
    boot = (F.coalesce("confidence", F.lit(0.0)) >= rules.bootstrap_confidence) & is_("passed")
    clean = ~F.col("body_dirty") & ~is_("dirty")
    risky = is_("prescriptive") | (F.col("type") == "capability") | F.coalesce(F.col("risk").isin("high", "critical"), F.lit(False))
    ok = (F.col("status") == "current") & F.col("quarantine_reason").isNull() & F.coalesce(normal | boot, F.lit(False)) & clean & (~risky | is_("passed") | is_("approved"))
    score = promote_score(F.col("quality_confidence"), F.to_timestamp("updated_at"), F.col("served"), F.col("useful"), F.col("privacy_scope"), now, rules.decay_days)
    scored = rows.withColumn("promote_score", score).withColumn("eligible", ok)
    # the budget looks at max_injected rows, so only they are numbered in one place
    head = scored.where("eligible").orderBy(F.desc("promote_score"), F.desc("knowledge_id")).limit(rules.max_injected)
    pinned = F.coalesce(F.col("origin").isin(*PINNED), F.lit(False))
    # from the highest score down: pinned rows first, others as long as they and all better ones fit
    w = Window.orderBy(F.desc(pinned), F.desc("promote_score"), F.desc("knowledge_id")).rowsBetween(Window.unboundedPreceding, 0)
    kept = head.withColumn("chars", F.sum(F.length("body")).over(w)).where(pinned | (F.col("chars") <= rules.max_chars)).select("knowledge_id", F.lit(True).alias("inject"))
    return scored.join(F.broadcast(kept), "knowledge_id", "left").select("knowledge_id", "promote_score", "eligible", is_("inject").alias("inject"))


def demote(knowledge: DataFrame, uses: DataFrame) -> DataFrame:
    """Scores halve where a row was served and never useful."""
    rows = knowledge.join(use_counts(uses), "knowledge_id", "left")
    return rows.withColumn("promote_score", F.when((F.col("served") > 0) & (F.col("useful") == 0), F.col("promote_score") * 0.5).otherwise(F.col("promote_score"))).select("knowledge_id", "promote_score")


def tripwires(knowledge: DataFrame, uses: DataFrame, links: DataFrame, evidence: DataFrame, signals: DataFrame, blocked: DataFrame, now: Column, rules: OpsRules = OpsRules(), scans: ScanStore | None = None) -> DataFrame:  # noqa: B008
    """knowledge_id, tripwire: the first of six that fires.

    With kept scans only texts that they do not know are scanned, and known by then; no text goes through a join.
    """
    spikes = uses.where(F.col("outcome").isin("harmful", "failed") & (F.to_timestamp("served_at") >= now - F.expr(f"interval {rules.bad_feedback_days} days")))
    spikes = spikes.groupBy("knowledge_id").agg(F.count(F.lit(1)).alias("n_bad"))
    thrash = links.where(F.col("relation").isin("contradicts", "supersedes") & (F.to_timestamp("created_at") >= now - F.expr(f"interval {rules.thrash_days} days")))
    thrash = thrash.groupBy("knowledge_id").agg(F.count(F.lit(1)).alias("n_thrash"))
    approved = signals.where(F.col("kind").isin(*APPROVALS) & (F.col("polarity") == "good")).select("knowledge_id").distinct().withColumn("approved", F.lit(True))
    hard = blocked.select(F.col("target_id").alias("knowledge_id")).withColumn("hard", F.lit(True))
    text = F.concat_ws("\n", F.coalesce("body", F.lit("")), F.coalesce("title", F.lit("")) if "title" in knowledge.columns else F.lit(""))
    if scans is None:
        scan = F.explode(F.array(F.struct((F.size(T.injections(text)) > 0).alias("injected"), (F.size(T.secret_leaks(text)) > 0).alias("leaks"))))
        rows = knowledge.select("knowledge_id", "prescriptive", "type", "inject", scan.alias("scan"))  # each text once, before the joins
    else:
        scans.learn((knowledge, text), (evidence, F.col("claim")))
        found = scans.flags(knowledge.select("knowledge_id", "prescriptive", "type", "inject", text.alias("__text")), F.col("__text"))
        rows = found.withColumn("scan", F.struct((F.size("injections") > 0).alias("injected"), (F.size("leaks") > 0).alias("leaks"))).drop("injections", "leaks", "__text")
    for part in (spikes, thrash, approved, hard, evidence_flags(links, evidence, scans)):
        rows = rows.join(part, "knowledge_id", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    fired = F.coalesce(
        F.when(F.col("scan.injected") | is_("flagged"), "injection_suspected"),
        F.when(F.col("scan.leaks"), "secret_leak"),
        F.when(F.col("n_bad") >= rules.bad_feedback_count, "bad_feedback_spike"),
        F.when(is_("hard"), "hard_correction"),
        F.when(F.col("n_thrash") >= rules.thrash_count, "contradiction_thrash"),
        F.when((is_("prescriptive") | (F.col("type") == "capability")) & is_("inject") & ~is_("passed") & ~is_("approved"), "prescriptive_unverified_serving"),
    )
    return rows.select("knowledge_id", fired.alias("tripwire")).where("tripwire is not null")


def after_cursor(rows: DataFrame, ts_col: str, id_col: str, ts: str, last_id: str) -> DataFrame:
    """Rows after a composite cursor, so that equal timestamps are neither skipped nor seen twice."""
    return rows.where(F.struct(ts_col, id_col) > F.struct(F.lit(ts).alias(ts_col), F.lit(last_id).alias(id_col)))


def prune(knowledge: DataFrame, uses: DataFrame, now: Column, ttl_days: int = 30, unhelpful_days: int = 14) -> DataFrame:
    """knowledge_id, reason of candidate and current rows to mark stale."""
    rows = knowledge.where(F.col("status").isin("candidate", "current")).join(use_counts(uses), "knowledge_id", "left")
    old = lambda days: F.to_timestamp("updated_at") < now - F.expr(f"interval {int(days)} days")
    served, useful = F.coalesce("served", F.lit(0)), F.coalesce("useful", F.lit(0))
    reason = F.when(old(ttl_days) & (served == 0), "ttl_unreferenced").when(old(unhelpful_days) & (served > 0) & (useful == 0), "ttl_served_without_usefulness")
    return rows.withColumn("reason", reason).where("reason is not null").select("knowledge_id", "reason")


def unreferenced(knowledge: DataFrame, uses: DataFrame, batch: int) -> DataFrame:
    """The oldest catalogue rows that nothing served, a batch of them."""
    return knowledge.join(uses.select("knowledge_id").distinct(), "knowledge_id", "left_anti").orderBy("updated_at", "knowledge_id").limit(batch)


def heal_conflicts(values: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Conflicting current values of a key: winner by confidence, then time, then smallest id; the others are superseded by it.

    values: knowledge_id, subject, predicate, project, value_numeric, value_text, value_bool, confidence, updated_at.
    """
    key = ["subject", "predicate", "project"]
    sure = F.coalesce("confidence", F.lit(0.0))
    rows = values.withColumn("project", F.coalesce("project", F.lit("")))
    spread = F.max("value_numeric") - F.min("value_numeric")
    conflict = (F.count(F.lit(1)) > 1) & (F.coalesce(spread > threshold, F.lit(False)) | (F.count_distinct("value_text") > 1) | (F.count_distinct("value_bool") > 1))
    groups = rows.groupBy(*key).agg(F.max(F.struct(sure.alias("sure"), "updated_at")).alias("best"), conflict.alias("conflict")).where("conflict").drop("conflict")
    joined = rows.join(groups, key)
    tops = joined.where((sure == F.col("best.sure")) & F.col("updated_at").eqNullSafe(F.col("best.updated_at")))
    winners = tops.groupBy(*key).agg(F.min("knowledge_id").alias("winner"))
    return joined.join(winners, key).where("knowledge_id <> winner").select("knowledge_id", F.col("winner").alias("superseded_by"), *key)


#: What a healed conflict says of its loser and its winner.
HEALED = (("loser", "knowledge_id", "bad", 0.4), ("winner", "superseded_by", "good", 0.3))


def heal_signals(healed: DataFrame, at: Column) -> DataFrame:
    """Two signals for each superseded row (heal_conflicts): one against it and one for what it gave way to."""
    from .feedback import signal, union_signals

    pair = F.concat(F.col("superseded_by").cast("string"), F.lit(":"), F.col("knowledge_id").cast("string"))
    parts = [signal(healed, F.lit("heal_superseded"), F.lit(polarity), F.lit(weight), "maintenance", F.concat(F.lit(f"{role}:"), pair), F.col(c), at) for role, c, polarity, weight in HEALED]
    return union_signals(*parts)


def family_summary(results: DataFrame) -> DataFrame:
    """Per experiment family: attempts, decisions, failure classes, explorations, guardrails, mean delta, status.

    results: experiment_family, decision, failure_class, forced, direction, passed, delta_value (text), guardrail_failures.
    """
    delta = F.coalesce(F.col("delta_value").try_cast("double"), F.lit(0.0))
    better = F.when(F.col("decision") == "kept", True).when(F.col("direction") == "lower_is_better", delta < 0).when(F.col("direction") == "higher_is_better", delta > 0).otherwise(F.coalesce("passed", F.lit(False)))
    n = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
    failed = F.col("decision") == "failed"
    rows = results.groupBy(F.coalesce(F.when(F.col("experiment_family") != "", F.col("experiment_family")), F.lit("unknown")).alias("family")).agg(
        F.count(F.lit(1)).alias("attempts"), n(F.col("decision") == "kept", "kept"), n(failed, "failed"), n(F.col("decision") == "reverted", "reverted"),
        n(failed & (F.col("failure_class") == "approach"), "approach_failures"), n(failed & F.col("failure_class").isin("precondition", "infra"), "blocking_failures"),
        n(failed & (F.col("failure_class") == "safety"), "safety_failures"), n(F.col("forced"), "forced_attempts"), n(F.col("forced") & better, "forced_improvements"),
        F.sum(F.coalesce("guardrail_failures", F.lit(0))).alias("guardrail_failures"), F.round(F.avg(delta), 3).alias("mean_delta"),
    )
    status = (
        F.when((F.col("guardrail_failures") > 0) | (F.col("safety_failures") > 0), "risky")
        .when(F.col("blocking_failures") > 0, "blocked")
        .when((F.col("attempts") >= 3) & (F.col("kept") == 0) & (F.col("approach_failures") >= 2), "exhausted")
        .when(F.col("kept") >= 2, "promising").when(F.col("kept") == 1, "needs_more_evidence").otherwise("unclear")
    )
    return rows.withColumn("status", status)


def best_metric(results: DataFrame, by: str, value: str, order: str, direction: str) -> DataFrame:
    """The first best result: least, greatest or last by direction; a value that is no number counts as infinite."""
    number = F.coalesce(F.col(value).try_cast("double"), F.lit(float("inf")))
    pick = {"lower_is_better": F.min_by(value, F.struct(number, order)), "higher_is_better": F.max_by(value, F.struct(number, -F.col(order)))}.get(direction, F.max_by(value, order))
    return results.groupBy(by).agg(pick.alias("best"))


def run_summary(results: DataFrame, by: str = "run_id") -> DataFrame:
    n = lambda *d: F.sum(F.col("decision").isin(*d).cast("long"))
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("items"), n("kept", "reverted", "skipped").alias("done"), n("failed").alias("failed"), n("kept").alias("kept"), n("reverted").alias("reverted"), n("skipped").alias("skipped"), n("needs_review").alias("needs_review"))


def knowledge_candidates(lessons: DataFrame) -> DataFrame:
    """First lesson of each (target, claim key) in emission order, with confidence, risk and status. lessons: target, body, decision, pos."""
    rows = lessons.withColumn("body", T.compact_space(F.col("body"))).where("body <> ''").withColumn("key", T.claim_key(F.col("body")))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("target", "key").orderBy("pos"))).where("nth = 1")
    conf = F.round(0.74 + F.when(F.col("decision") == "kept", 0.06).otherwise(0.0) - F.when(F.col("target").isin("skill", "policy"), 0.02).otherwise(0.0), 2)
    shaped = F.col("target").isin("skill", "policy")
    return first.select("target", "body", conf.alias("confidence"), F.when(shaped, "medium").otherwise("low").alias("risk"), F.when(shaped, "proposal_only").otherwise("staged").alias("status"), F.substring(F.split("body", r"\.")[0], 1, 120).alias("title"))


def failure_streaks(runs: DataFrame, by: str, order: Column, failed: Column) -> DataFrame:
    """Consecutive failures counted from the newest run of each key."""
    w = Window.partitionBy(by).orderBy(order.desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = runs.withColumn("__unbroken", F.min(failed.cast("int")).over(w))
    return rows.groupBy(by).agg(F.sum("__unbroken").alias("streak"))


def overdue(liveness: DataFrame, now: Column) -> DataFrame:
    """Deadlines that passed, with what is amiss. liveness: loop_id, due_at (text), last_heartbeat_at, last_ledger_at, running_since."""
    due = F.try_to_timestamp("due_at")
    old = lambda c: F.coalesce(F.to_timestamp(c) < due, F.lit(True))
    kinds = F.array_compact(F.array(
        F.when(due.isNull(), "invalid_deadman_due"), F.when(due.isNotNull() & old("last_heartbeat_at"), "heartbeat_starved"),
        F.when(due.isNotNull() & old("last_ledger_at"), "no_ledger_writes"), F.when(due.isNotNull() & F.col("running_since").isNotNull() & (F.to_timestamp("running_since") < due), "stale_running_item"),
    ))
    return liveness.where(due.isNull() | (due <= now)).select("loop_id", "due_at", kinds.alias("kinds"))


def stall_findings(*parts: DataFrame) -> DataFrame:
    """Findings of all readers, once for each fingerprint: class, fingerprint, detail, seen_at."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("fingerprint").agg(F.min_by(F.struct("class", "detail", "seen_at"), "seen_at").alias("f")).select("fingerprint", "f.*")


def stall_lifecycle(findings: DataFrame, handled: DataFrame, now: Column, first_run: bool, most: int = 8, hours: int = 48) -> DataFrame:
    """What becomes of each new finding: backlog on the first run, retired when old, paged up to `most`, else waiting."""
    new = findings.join(handled.select("fingerprint").distinct(), "fingerprint", "left_anti")
    old = F.to_timestamp("seen_at") < now - F.expr(f"interval {int(hours)} hours")
    paged = new.where(~old).orderBy("seen_at", "fingerprint").limit(most).select("fingerprint", F.lit(True).alias("page"))
    state = F.when(F.lit(first_run), "backlog").when(old, "retired").when(F.col("page"), "paged").otherwise("waiting")
    return new.join(F.broadcast(paged), "fingerprint", "left").withColumn("state", state).drop("page")


def auto_decide(proposed: DataFrame, blocked: DataFrame) -> DataFrame:
    """shadow for proposals with injections, blocked targets or discards; approve for the rest."""
    rows = proposed.join(blocked.select(F.col("target_id").alias("belief_id"), F.lit(True).alias("blocked")), "belief_id", "left")
    bad = (F.size(T.injections(F.col("body"))) > 0) | F.coalesce("blocked", F.lit(False)) | F.coalesce(F.col("action") == "discard", F.lit(False))
    return rows.select("proposal_id", "belief_id", F.when(bad, "shadow").otherwise("approve").alias("decision"))


def judge_targets(knowledge: DataFrame, uses: DataFrame, limit: int = 100) -> DataFrame:
    """Rows worth judging: served before, lessons, or from sessions; catalogue rows nobody served are left out."""
    touched = uses.select("knowledge_id").distinct().withColumn("touched", F.lit(True))
    rows = knowledge.join(touched, "knowledge_id", "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
    worth = F.col("touched") | (F.col("doc_kind") == "lesson") | F.coalesce(F.col("origin") == "session", F.lit(False))
    return rows.where(worth & ~((F.col("doc_kind") == "catalog") & ~F.col("touched"))).orderBy(F.asc_nulls_first("quality_updated_at"), "knowledge_id").limit(limit)


def judge_rows(knowledge: DataFrame, signals: DataFrame, now: Column, cap: int = 50) -> DataFrame:
    """Rows that a judge should see: neutral ones whose votes still weigh 0.3 or more, and unlabelled ones without a vote; best first.

    knowledge: knowledge_id, status, quarantine_reason, quality_label, promote_score, confidence; signals: knowledge_id, polarity, weight, occurred_at.
    """
    from .feedback import fold_labels

    mass = fold_labels(signals, now).select("knowledge_id", "mass")
    rows = knowledge.where(F.col("quarantine_reason").isNull() & F.col("status").isin("candidate", "current")).join(mass, "knowledge_id", "left")
    torn = (F.col("quality_label") == "neutral") & (F.coalesce("mass", F.lit(0.0)) >= 0.3)
    worth = F.coalesce(torn, F.lit(False)) | (F.col("quality_label").isNull() & F.col("mass").isNull())
    return rows.where(worth).orderBy(F.desc(F.coalesce("promote_score", F.lit(-1.0))), F.desc(F.coalesce("confidence", F.lit(0.0))), F.asc("knowledge_id")).limit(cap)


#: Fixed value: what a judge's verdict weighs, which is too little to decide alone.
JUDGE_WEIGHT = 0.4


def judge_signals(verdicts: DataFrame, at: Column) -> DataFrame:
    """Verdicts (knowledge_id, label: good, bad or neutral, request_hash) as signals, which fold_labels() takes with all others; other labels say nothing."""
    from .feedback import signal

    rows = verdicts.where(F.col("label").isin("good", "bad", "neutral") & F.col("knowledge_id").isNotNull())
    return signal(rows, F.lit("llm_judge"), F.col("label"), F.lit(JUDGE_WEIGHT), "judge", F.col("request_hash"), F.col("knowledge_id"), at)


def hosted_batch(rows: DataFrame, context: ScopeContext, text: Column, target: str = "hosted_teacher") -> DataFrame:
    """knowledge_id, included, reason, text: what of a batch may go to a host, redacted, and why the rest may not.

    rows: knowledge_id, privacy_scope and the columns of a scope. Text of rows that stay is null.
    """
    decided = F.when(F.col("privacy_scope") == "private", F.struct(F.lit(False).alias("allowed"), F.lit("private_scope").alias("reason"))).otherwise(egress(context, target))
    rows = rows.select("knowledge_id", decided.alias("e"), text.alias("__text"))
    return rows.select("knowledge_id", F.col("e.allowed").alias("included"), F.col("e.reason").alias("reason"), F.when(F.col("e.allowed"), T.redact_secrets(F.col("__text"))).alias("text"))


def embed_candidates(knowledge: DataFrame, limit: int) -> DataFrame:
    """Rows whose vector is missing or older than the row, by tier: injected, served values, the rest."""
    stale = F.col("embedded_at").isNull() | (F.col("embedded_at") < F.col("updated_at"))
    tier = F.when(F.col("inject"), 0).when(F.col("type") == "value", 1).otherwise(2)
    return knowledge.where(stale & (F.col("status") == "current")).withColumn("tier", tier).orderBy("tier", F.desc("updated_at"), "knowledge_id").limit(limit)


def consolidate(evidence: DataFrame, by: str, order: str, text: str, most: int = 700) -> DataFrame:
    """Evidence of a scope as one body, distinct lines in first-seen order, cut at `most` characters."""
    firsts = evidence.groupBy(by, text).agg(F.min(order).alias("__at"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", text))), lambda x: F.concat(F.lit("- "), x[text])), "\n")
    return firsts.groupBy(by).agg(F.substring(body, 1, most).alias("body"), F.count(F.lit(1)).alias("n_lines"))


def spend_today(runs: DataFrame, day: str) -> DataFrame:
    return runs.where(F.substring("ts", 1, 10) == day).agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))


def digest_message(findings: DataFrame, most: int = 3900, backlog: bool = False) -> DataFrame:
    """One row: the message of a run's findings (fingerprint, block, seen_at) within `most` characters, and how many it holds.

    Blocks follow each other in order of time while what they need, with a line for the rest, fits; the first always does.
    """
    total = findings.agg(F.count(F.lit(1)).alias("total"))
    head = findings.orderBy("seen_at", "fingerprint").limit(most)  # a block has one character at least
    w = Window.orderBy("seen_at", "fingerprint")
    rows = head.withColumn("nth", F.row_number().over(w)).withColumn("used", F.sum(F.length("block") + 2).over(w.rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(total))
    title = F.concat(F.col("total").cast("string"), F.lit(" stalled agent(s)" + (" (backlog on first run)" if backlog else "") + ":"))
    footer = lambda n: F.concat(F.lit("\n\n… +"), n.cast("string"), F.lit(" more (next digest)"))
    rest = F.col("total") - F.col("nth")
    size = F.length(title) + F.col("used") + F.when(rest > 0, F.length(footer(rest)) - 1).otherwise(0)
    rows = rows.withColumn("fits", (size <= most) | (F.col("nth") == 1)).withColumn("open", F.min(F.col("fits").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    kept = rows.where("open").groupBy("total").agg(F.count(F.lit(1)).alias("n_included"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "block"))), lambda x: x["block"]), "\n\n").alias("blocks"))
    left = F.col("total") - F.col("n_included")
    return kept.select(F.concat(title, F.lit("\n\n"), "blocks", F.when(left > 0, footer(left)).otherwise("")).alias("message"), "n_included")
