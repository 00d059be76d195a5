"""Session review: signals from turns, and candidates for knowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evergrain.functions import text as T
from evergrain.functions.ids import stable_id

# Fixed values
APPROVAL = r"(?i)\b(yes|approved|lgtm|go ahead|do it|please do|sounds good|proceed)\b"
TEST_PASS = r"(\d+)\s+passed"
TEST_FAIL = r"FAILED|AssertionError|✕|\b\d+\s+failed\b"
DEPLOY_OK = r"(?i)(deploy(ment)?\s+(succeeded|successful|complete)|fly deploy.*(success|complete)|CI (passed|green)|✓ Deployed)"
DEPLOY_FAIL = r"(?i)(deploy(ment)?\s+failed|fly deploy.*fail|CI (failed|red)|release_command failed)"
REVERT = r"(?i)(git revert|git reset --hard|rolling back|reverting)"
PASSIVE_WAIT = (
    r"\b(wait|waiting|waits|hold|holding|holds|stand(?:ing)? by|park(?:ed|ing)?|block(?:ed|ing)?|pause[ds]?)\b.{0,80}"
    r"\b(monitor|notif(?:y|ication|ies)|callback|ping|land(?:s|ed|ing)?|complete[sd]?|completion|arriv(?:e|es|al)|resolve[sd]?|finish(?:es|ed)?|come[s]? back|return[s]?)\b",
    r"\bwaiting on the monitor\b",
    r"\bstanding by\b",
    r"\bi'?ll hold here\b",
    r"\bno further action is useful until\b",
    r"\blet the monitor notify me\b",
    r"\bwaiting for the monitor\b",
)


def settled(turns: DataFrame, now: str, minutes: int = 30) -> DataFrame:
    """Turns of sessions that have been idle for `minutes`, with a fingerprint of the session's state."""
    last = turns.groupBy("session_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_turns"))
    done = last.where(F.to_timestamp("last_ts") <= F.to_timestamp(F.lit(now)) - F.expr(f"interval {int(minutes)} minutes"))
    return turns.join(done.withColumn("fingerprint", F.sha2(F.concat_ws("|", "session_id", "n_turns", "last_ts"), 256)), "session_id")


def unseen(sessions: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Sessions whose fingerprint has not been reviewed."""
    return sessions.join(watermarks.select("session_id", "fingerprint"), ["session_id", "fingerprint"], "left_anti")


def turn_signals(turns: DataFrame, threshold: float = 0.6, author_weight: Column | None = None) -> DataFrame:
    """session_id, turn_idx, kind, polarity, weight, signal_id: one row for each rule that a turn fires.

    A user's correction counts where an answer stands within three turns before it; a turn that is none may be thanks. An
    approval follows an answer directly. Test and deployment results are read from tool turns, reverts from any turn. The
    weights of what users say are multiplied by author_weight.
    """
    w = Window.partitionBy("session_id").orderBy("turn_idx")
    answered = F.coalesce(F.max(F.col("role") == "assistant").over(w.rowsBetween(-3, -1)), F.lit(False))
    rows = turns.withColumn("__answered", answered).withColumn("__before", F.lag("role").over(w)).where("text <> ''")
    has = lambda p: F.col("text").rlike(T.java_pattern(p))
    user, tool = F.col("role") == "user", F.col("role") == "tool"
    times = F.lit(1.0) if author_weight is None else author_weight
    struct = lambda kind, polarity, weight: F.struct(F.lit(kind).alias("kind"), F.lit(polarity).alias("polarity"), weight.alias("weight"))
    corrects = user & (T.correction_score(F.col("text")) >= threshold) & F.col("__answered")
    rules = [
        F.when(corrects, struct("user_correction", "bad", 0.8 * times)).when(user & T.is_affirmation(F.col("text")), struct("user_thanks", "good", 0.6 * times)),
        F.when(user & has(APPROVAL) & (F.col("__before") == "assistant"), struct("user_approval", "good", 0.5 * times)),
        F.when(tool & has(TEST_PASS), struct("test_pass", "good", F.lit(0.4))),
        F.when(tool & has(TEST_FAIL), struct("test_fail", "bad", F.lit(0.6))),
        F.when(tool & has(DEPLOY_OK), struct("deploy_success", "good", F.lit(0.6))),
        F.when(tool & has(DEPLOY_FAIL), struct("deploy_failure", "bad", F.lit(0.6))),
        F.when(has(REVERT), struct("revert", "bad", F.lit(0.7))),
    ]
    found = rows.select("session_id", "turn_idx", F.explode(F.array_compact(F.array(*rules))).alias("s")).select("session_id", "turn_idx", "s.*")
    return found.withColumn("signal_id", stable_id("sig", F.col("session_id"), F.col("turn_idx"), F.col("kind")))


def session_outcomes(turns: DataFrame, min_calls: int = 5, corrected: DataFrame | None = None) -> DataFrame:
    """Per session: tool results, whether it recovered from an error, and whether its task closed in success.

    Recovered: a clean result after the first error, and none of the last is one. Success: min_calls clean results, the last result
    clean, no correction by the user. corrected: session_id of sessions with a correction.
    """
    tool = F.col("role") == "tool"
    clean, bad = F.when(tool & ~F.col("tool_error"), F.col("turn_idx")), F.when(tool & F.col("tool_error"), F.col("turn_idx"))
    found = turns.groupBy("session_id").agg(
        F.count(clean).alias("n_clean"), F.count(bad).alias("n_errors"), F.min(bad).alias("first_error"), F.max(bad).alias("last_error"), F.max(clean).alias("last_clean"),
        F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn_idx"))).alias("last_answer"), F.max_by("text", F.when(F.col("role") == "user", -F.col("turn_idx"))).alias("first_request"),
    )
    ends_bad = F.coalesce(F.col("last_error") > F.coalesce("last_clean", F.lit(-1)), F.lit(False))
    recovered = (F.col("n_errors") > 0) & (F.col("n_clean") > 0) & ~ends_bad & (F.col("last_clean") > F.col("first_error"))
    if corrected is None:
        found = found.withColumn("__corrected", F.lit(False))
    else:
        found = found.join(corrected.select("session_id").distinct().withColumn("__corrected", F.lit(True)), "session_id", "left")
    success = (F.col("n_clean") >= min_calls) & ~ends_bad & ~F.coalesce("__corrected", F.lit(False))
    return found.withColumn("recovered", F.coalesce(recovered, F.lit(False))).withColumn("success", success).drop("__corrected")


def outcome_signals(outcomes: DataFrame, known: DataFrame) -> DataFrame:
    """session_id, kind, polarity, weight: recoveries, closeouts in success, and workflows of three clean results in sessions not known before."""
    rows = outcomes.join(known.select("session_id").distinct().withColumn("__known", F.lit(True)), "session_id", "left")
    struct = lambda kind, polarity, weight: F.struct(F.lit(kind).alias("kind"), F.lit(polarity).alias("polarity"), F.lit(weight).alias("weight"))
    rules = F.array_compact(F.array(
        F.when(F.col("recovered"), struct("error_recovery", "good", 0.6)), F.when(F.col("success"), struct("task_closeout_success", "good", 0.7)),
        F.when((F.col("n_clean") >= 3) & F.col("__known").isNull(), struct("novel_workflow", "neutral", 0.2)),
    ))
    return rows.select("session_id", F.explode(rules).alias("s")).select("session_id", "s.*")


def candidates(outcomes: DataFrame, known_keys: DataFrame) -> DataFrame:
    """Closeouts of successful sessions and recoveries as candidates, unless their claim is known."""
    kind = F.when(F.col("recovered"), "recovery").otherwise("closeout")
    rows = outcomes.where("(success or recovered) and last_answer is not null").select("session_id", kind.alias("kind"), T.title_of(F.col("first_request"), F.lit("Session")).alias("title"), T.summary_of(T.redact_secrets(F.col("last_answer"))).alias("body"))
    rows = rows.withColumn("claim_key", T.claim_key(F.col("body"))).join(known_keys.select("claim_key"), "claim_key", "left_anti")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("claim_key").orderBy("session_id"))).where("nth = 1").drop("nth")


def passive_waits(turns: DataFrame) -> DataFrame:
    """Sessions whose last turn is an answer that waits for something."""
    last = turns.groupBy("session_id").agg(F.max_by(F.struct("role", "text", "ts"), "turn_idx").alias("t"))
    waits = F.col("t.text").rlike("(?iU)" + "|".join(PASSIVE_WAIT))
    return last.where((F.col("t.role") == "assistant") & waits).select("session_id", F.col("t.ts").alias("seen_at"))


def pending_calls(records: DataFrame) -> DataFrame:
    """Tool calls without a later result of the same id. records: session_id, pos, kind (use or result), call_id."""
    uses = records.where("kind = 'use'").select("session_id", "call_id", "pos")
    results = records.where("kind = 'result'").groupBy("session_id", "call_id").agg(F.max("pos").alias("answered"))
    return uses.join(results, ["session_id", "call_id"], "left").where("answered is null or answered < pos").select("session_id", "call_id", "pos")


def grade(raw: DataFrame) -> DataFrame:
    """Model grades in their allowed form: scores in 0..1, reasons as text, unreadable answers as errors. raw: id, answer (JSON)."""
    score = F.get_json_object("answer", "$.score").try_cast("double")
    fits = F.coalesce(score.between(0, 1), F.lit(False))
    return raw.select("id", F.when(fits, score).alias("grade_score"), F.when(fits, F.get_json_object("answer", "$.reason")).alias("grade_reason"), F.when(fits, "graded").otherwise("error").alias("grade_state"))


def calibrate(grades: DataFrame, human: DataFrame, cut: float = 0.8, least: float = 0.9) -> DataFrame:
    """One row: agreement of the grader with named labels, and whether it reaches the gate."""
    rows = grades.join(human, "id").select(((F.col("grade_score") >= cut) == F.col("accept")).alias("same"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("same").cast("double")).alias("agreement")).withColumn("passed", F.coalesce(F.col("agreement") >= least, F.lit(False)))
