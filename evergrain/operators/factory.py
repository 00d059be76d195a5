"""The training-data factory over a long table of turns: exchanges, preference pairs, voice, the store gate, packs and exports.

turns: session_id, turn_idx, role, kind, text, ts, tool_error, n_tool_calls, authored_by, sender_verified.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evergrain.functions import text as T

PACK_CLASSES = {"sft": "train_skill", "dpo": "train_judgment", "persona": "train_voice"}
PACK_TARGETS = {"sft": 2000, "dpo": 300, "persona": 500}
FINAL_TARGETS = {"sft": 1000, "dpo": 200, "persona": 300}
SOURCE_PRIORITY = {"correction_event": 0, "authored_doc": 1, "git_commit": 1}
LABEL_RANK = {"bad": 0, "neutral": 1, "good": 2}
HARD_REASONS = ("secret_residue", "managed_block_leak", "envelope_residue", "process_chatter", "privacy_residue", "runtime_wrapper_residue", "dpo_contrast_ambiguous")
COLLAPSED = "session_id string, turn_idx long, role string, kind string, text string, ts string, tool_error boolean, n_tool_calls long, authored_by string, sender_verified boolean"


def _session() -> Window:
    return Window.partitionBy("session_id").orderBy("turn_idx")


def collapse(turns: DataFrame) -> DataFrame:
    """Consecutive turns of a role as one, except between two known authors or two kinds of user turn.

    What a turn is compared with is the merged turn before it, so this is a walk through the session (one session fits a task).
    """
    names = [c.split(" ")[0] for c in COLLAPSED.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for turn in group.sort_values("turn_idx")[names].to_dict("records"):
            last = out[-1] if out else None
            split = last is None or last["role"] != turn["role"]
            if not split and last["authored_by"] and turn["authored_by"] and last["authored_by"] != turn["authored_by"]:
                split = True
            if not split and turn["role"] == "user" and last["kind"] != turn["kind"]:
                split = True
            if split:
                out.append(turn)
                continue
            last["text"] = "\n".join(t for t in (last["text"], turn["text"]) if t)
            last["n_tool_calls"] += turn["n_tool_calls"]
            for flag in ("tool_error", "sender_verified"):
                last[flag] = bool(last[flag]) or bool(turn[flag])
            for name in ("kind", "authored_by"):
                last[name] = last[name] or turn[name]
        for k, turn in enumerate(out):
            turn["turn_idx"] = k
        return pd.DataFrame(out, columns=names)

    return turns.select(*names).groupBy("session_id").applyInPandas(run, COLLAPSED)


def exchanges(turns: DataFrame, min_chars: int = 80) -> DataFrame:
    """One row for each user turn that gets an answer of min_chars: the last such answer before the next user turn, and its tool arc."""
    user = F.col("role") == "user"
    clean = F.when(F.col("role").isin("user", "assistant") & ~(user & (F.col("kind") == "injected")), T.sanitize(F.col("text"))).otherwise("")
    rows = turns.withColumn("clean", clean).withColumn("segment", F.sum(user.cast("long")).over(_session())).where("segment > 0")
    good = (F.col("role") == "assistant") & (F.length("clean") >= min_chars)
    whole = Window.partitionBy("session_id", "segment")
    rows = rows.withColumn("target_idx", F.max(F.when(good, F.col("turn_idx"))).over(whole)).withColumn("trigger_idx", F.min("turn_idx").over(whole))
    arc = rows.where("target_idx is not null and turn_idx <= target_idx")
    tool, answer = F.col("role") == "tool", F.col("role") == "assistant"
    calls = F.when(answer, F.col("n_tool_calls")).when(tool, 1).otherwise(0)
    state = F.max_by(F.when(tool, F.col("tool_error")).otherwise(F.lit(False)), F.when(tool | answer, F.col("turn_idx")))
    return arc.groupBy("session_id", "segment").agg(
        F.first("trigger_idx").alias("trigger_idx"), F.first("target_idx").alias("target_idx"),
        F.max(F.when(F.col("turn_idx") == F.col("target_idx"), F.col("clean"))).alias("target_text"),
        F.sum(calls).cast("long").alias("n_tool_calls"), F.max(F.when(tool, F.col("tool_error")).otherwise(F.lit(False))).alias("had_tool_error"), state.alias("trailing_tool_error"),
    )


def context_windows(turns: DataFrame, targets: DataFrame, max_turns: int = 12, max_chars: int = 16000) -> DataFrame:
    """The last turns before each target that the model sees: max_turns at most, the oldest dropped until max_chars hold."""
    seen = turns.where("role in ('user', 'assistant') and not (role = 'user' and kind = 'injected')").withColumn("clean", T.sanitize(F.col("text"))).where("clean <> ''")
    # numbered once per session; a target's context is a range of those numbers, found in one pass over the session
    seen = seen.withColumn("nth", F.row_number().over(_session())).select("session_id", "turn_idx", "role", "clean", "nth")
    marks = targets.select("session_id", F.col("target_idx").alias("turn_idx"), F.lit(None).cast("int").alias("nth"), F.lit(0).alias("__kind"))
    both = marks.unionByName(seen.select("session_id", "turn_idx", "nth", F.lit(1).alias("__kind")))
    before = Window.partitionBy("session_id").orderBy("turn_idx", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = both.withColumn("upto", F.max("nth").over(before)).where("__kind = 0 and upto is not null").select("session_id", F.col("turn_idx").alias("target_idx"), "upto")
    wanted = last.select("session_id", "target_idx", "upto", F.explode(F.sequence(F.greatest(F.lit(1), F.col("upto") - (max_turns - 1)), F.col("upto"))).alias("nth"))
    rows = wanted.join(seen, ["session_id", "nth"])
    back = Window.partitionBy("session_id", "target_idx").orderBy(F.desc("nth"))
    rows = rows.withColumn("chars", F.sum(F.length("clean")).over(back)).where(F.col("chars") <= max_chars)
    messages = F.transform(F.array_sort(F.collect_list(F.struct("nth", "role", "clean"))), lambda m: F.struct(m["role"].alias("role"), m["clean"].alias("content")))
    return rows.groupBy("session_id", "target_idx").agg(F.count(F.lit(1)).alias("n_context"), F.sum(F.length("clean")).alias("context_chars"), messages.alias("context"))


def label_exchanges(found: DataFrame, turns: DataFrame, outcomes: DataFrame, threshold: float = 0.6, min_calls: int = 5) -> DataFrame:
    """label, confidence, reasons by precedence. outcomes: session_id, good, bad (retrieval outcomes of the session)."""
    # the next turn that a person wrote, in one pass from the session's end
    asks = turns.where("role = 'user' and kind <> 'injected'").select("session_id", "turn_idx", T.sanitize(F.col("text")).alias("said"), F.lit(0).alias("__kind"))
    marks = found.select("session_id", F.col("target_idx").alias("turn_idx"), F.lit(None).cast("string").alias("said"), F.lit(1).alias("__kind"))
    after = Window.partitionBy("session_id").orderBy(F.desc("turn_idx"), F.desc("__kind")).rowsBetween(Window.unboundedPreceding, -1)
    follow = asks.unionByName(marks).withColumn("follow", F.last("said", ignorenulls=True).over(after)).where("__kind = 1").select("session_id", F.col("turn_idx").alias("target_idx"), "follow")
    rows = found.join(follow, ["session_id", "target_idx"], "left").join(outcomes, "session_id", "left")
    good, bad = F.coalesce("good", F.lit(False)), F.coalesce("bad", F.lit(False))
    score = T.correction_score(F.col("follow"))
    corrected = F.coalesce((F.col("follow") != "") & (score >= threshold), F.lit(False))
    affirmed = ~corrected & T.is_affirmation(F.col("follow"))
    more = lambda c: F.when(good, F.least(F.lit(0.95), F.lit(c + 0.1))).otherwise(F.lit(c))
    tag = lambda name: F.when(good, F.array(F.lit(name), F.lit("retrieval_good"))).otherwise(F.array(F.lit(name)))
    one = lambda label, conf, why: F.struct(F.lit(label).alias("label"), conf.alias("confidence"), why.alias("reasons"))
    judged = (
        F.when(bad, one("bad", F.lit(0.6), F.array(F.lit("retrieval_bad"))))
        .when(corrected, one("bad", F.least(F.lit(0.9), score), F.array(F.lit("correction_followup"))))
        .when(F.col("target_text").rlike(T.java_pattern(T.REFUSAL)), one("bad", F.lit(0.6), F.array(F.lit("refusal"))))
        .when(F.col("trailing_tool_error"), one("bad", F.lit(0.6), F.array(F.lit("terminal_tool_failure"))))
        .when(affirmed, one("good", more(0.9), tag("affirmation")))
        .when(F.col("had_tool_error"), one("good", more(0.8), tag("error_recovery")))
        .when(F.col("n_tool_calls") >= min_calls, one("good", more(0.7), tag("task_success")))
        .when(good, one("good", F.lit(0.6), F.array(F.lit("retrieval_good"))))
        .otherwise(one("neutral", F.lit(0.5), F.array(F.lit("neutral"))))
    )
    return rows.withColumn("judged", judged).select(*found.columns, "judged.*")


def next_user_turn(turns: DataFrame) -> DataFrame:
    """Each turn with the index of the next user turn that a person wrote."""
    real = F.when((F.col("role") == "user") & (F.col("kind") != "injected"), F.col("turn_idx"))
    return turns.withColumn("next_user", F.min(real).over(_session().rowsBetween(1, Window.unboundedFollowing)))


def previous_assistant(turns: DataFrame, back: int = 4) -> DataFrame:
    """Each turn with the nearest answer within `back` turns before it."""
    real = F.when((F.col("role") == "assistant") & (F.trim("text") != ""), F.col("turn_idx"))
    return turns.withColumn("previous_assistant", F.max(real).over(_session().rowsBetween(-back, -1)))


PAIRS = "session_id string, gate string, request_idx long, rejected_idx long, correction_idx long, chosen_idx long, request string, rejected string, correction string, chosen string"


def preference_pairs(turns: DataFrame, threshold: float = 0.6, back: int = 4, relaxed: bool = True) -> DataFrame:
    """Rejected and chosen answers around corrections, before the text gates.

    strict: a first answer, its correction, and the answer that ends the chain of corrections by praise or the session's end. relaxed: from
    the correction back to an answer within `back` turns; a correction that is the last word is itself the chosen text. Scores
    and texts are Columns; the walk along a session's chain is the only step in Python.
    """
    rows = turns.withColumn("clean", T.sanitize(F.col("text"))).select(
        "session_id", "turn_idx", "role", "kind", "clean", (T.correction_score(F.col("clean")) >= threshold).alias("corrects"), T.is_affirmation(F.col("clean")).alias("affirms")
    )
    names = [c.split(" ")[0] for c in PAIRS.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        t = group.sort_values("turn_idx").to_dict("records")
        people = [k for k, x in enumerate(t) if x["role"] == "user" and x["kind"] != "injected"]
        answers = [k for k, x in enumerate(t) if x["role"] == "assistant" and x["clean"]]
        spoken = set(answers)

        def after(k: int) -> int | None:
            at = bisect_right(people, k)
            return people[at] if at < len(people) else None

        def before(k: int) -> int | None:
            at = bisect_left(people, k)
            return people[at - 1] if at else None

        def accepted(k: int) -> int | None:
            """The answer that the chain of corrections from k on ends in; what each correction of the chain leads to is kept."""
            chain = []
            while k not in ends:
                chain.append(k)
                follow = after(k)
                at = bisect_left(answers, len(t) if follow is None else follow) - 1
                last = answers[at] if at >= 0 and answers[at] > k else None
                if last is not None and follow is not None and t[follow]["corrects"]:
                    k = follow
                    continue
                ends[k] = last if last is None or follow is None or t[follow]["affirms"] else None
            for link in chain:
                ends[link] = ends[k]
            return ends[k]

        ends: dict[int, int | None] = {}
        out, seen = [], set()

        def add(gate: str, ask: int, first: int, fix: int, chosen: int) -> None:
            key = (t[first]["clean"], t[chosen]["clean"])
            if key not in seen:
                seen.add(key)
                at = lambda k: t[k]["turn_idx"]
                out.append((t[0]["session_id"], gate, at(ask), at(first), at(fix), at(chosen), t[ask]["clean"], t[first]["clean"], t[fix]["clean"], t[chosen]["clean"]))

        for a in answers:
            ask, fix = before(a), after(a)
            if ask is None or fix is None or not t[ask]["clean"] or t[ask]["corrects"] or not t[fix]["corrects"]:
                continue
            end = accepted(fix)
            if end is not None:
                add("strict", ask, a, fix, end)
        for fix in people if relaxed else ():
            a = next((k for k in range(fix - 1, max(0, fix - back) - 1, -1) if k in spoken), None)
            ask = None if a is None else before(a)
            if not t[fix]["corrects"] or ask is None or not t[ask]["clean"] or t[ask]["corrects"]:
                continue
            end = accepted(fix)
            end = fix if end is None and after(fix) is None else end
            if end is not None:
                add("relaxed", ask, a, fix, end)
        return pd.DataFrame(out, columns=names)

    return rows.groupBy("session_id").applyInPandas(run, PAIRS)


TOPIC_STOP = ("the", "and", "for", "that", "this", "with", "from", "have", "was", "are", "not", "you", "your", "but")


def topic_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9_./:-]{2,})"), 1)
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[./:-]+|[./:-]+$", ""))
    return F.array_except(F.array_distinct(F.filter(bare, lambda w: F.length(w) >= 3)), F.array(*map(F.lit, TOPIC_STOP)))


def gated_pairs(pairs: DataFrame, low: int = 40, high: int = 8000) -> DataFrame:
    """Pairs with sides of allowed length, clean, about one topic, and different in more than order or punctuation."""
    c, r, q, f = (topic_tokens(F.col(x)) for x in ("chosen", "rejected", "request", "correction"))
    shared, union = F.size(F.array_intersect(c, r)), F.size(F.array_union(c, r))
    differ = (union - shared >= 2) & (shared / F.greatest(union, F.lit(1)) < 0.9)
    grounded = (F.size(q) > 0) & (F.size(F.array_intersect(q, c)) > 0)
    stray = ~T.is_process_chatter(F.col("rejected")) & (F.size(F.array_intersect(q, r)) > 0) & (shared < 2) & (shared / F.greatest(union, F.lit(1)) < 0.08)
    defect = F.col("correction").rlike(r"(?i)\b(?:wrong|incorrect|not right|not correct|not what i (?:asked|wanted)|try again|redo)\b")
    fits = F.length("rejected").between(low, high) & F.length("chosen").between(low, high) & (T.claim_key(F.col("chosen")) != T.claim_key(F.col("rejected")))
    clean = F.lit(True)
    for side in ("chosen", "rejected"):
        clean = clean & (F.size(T.secret_leaks(F.col(side))) == 0) & (F.size(T.injections(F.col(side))) == 0)
    ok = fits & clean & (F.size(c) > 0) & (F.size(r) > 0) & differ & grounded & ~stray & ~T.is_process_chatter(F.col("chosen")) & (defect | (F.size(F.array_intersect(f, c)) > 0))
    most = F.when(F.col("gate") == "strict", 0.9).otherwise(0.8)
    return pairs.where(ok).withColumn("confidence", F.least(most, T.correction_score(F.col("correction"))))


def event_pairs(log: DataFrame) -> DataFrame:
    """Pairs from decisions with an edited body: the proposal's text is rejected, the edit chosen."""
    from .log import body

    proposed = log.where("kind = 'compilation_proposed'").select(F.col("id").alias("proposal_id"), body("body").alias("rejected"), body("belief_id").alias("belief_id"))
    decided = log.where("kind = 'compilation_decided'").select(body("proposal_event_id").alias("proposal_id"), body("edited_body").alias("chosen"), F.col("ts").alias("occurred_at"))
    return decided.where("chosen is not null").join(proposed, "proposal_id").where("chosen <> rejected").withColumn("confidence", F.lit(0.85))


def event_gate(pairs: DataFrame, low: int = 40, high: int = 8000) -> DataFrame:
    """Pairs that an event states (rejected, chosen): cleaned, of allowed length, without leaks and injections, about something, and different
    in more than order or punctuation. Their direction is known, so no wording is looked at."""
    # worked out once below an explode, which the filter does not pass
    clean = F.explode(F.array(F.struct(T.sanitize(F.col("rejected")).alias("rejected"), T.sanitize(F.col("chosen")).alias("chosen")))).alias("clean")
    kept = [c for c in pairs.columns if c not in ("rejected", "chosen")]
    rows = pairs.select(*kept, clean).select(*kept, "clean.rejected", "clean.chosen")
    rows = rows.select("*", F.explode(F.array(F.struct(topic_tokens(F.col("chosen")).alias("c"), topic_tokens(F.col("rejected")).alias("r")))).alias("topics"))
    c, r = F.col("topics.c"), F.col("topics.r")
    shared, union = F.size(F.array_intersect(c, r)), F.size(F.array_union(c, r))
    ok = F.length("rejected").between(low, high) & F.length("chosen").between(low, high) & (T.claim_key(F.col("chosen")) != T.claim_key(F.col("rejected")))
    for side in ("chosen", "rejected"):
        ok = ok & (F.size(T.secret_leaks(F.col(side))) == 0) & (F.size(T.injections(F.col(side))) == 0)
    return rows.where((F.size(c) > 0) & (F.size(r) > 0) & (union - shared >= 2) & (shared / F.greatest(union, F.lit(1)) < 0.9) & ok).select(pairs.columns)


def _about(subject: Column, predicate: Column) -> Column:
    return F.trim(F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(predicate, F.lit(""))))


def correction_pairs(log: DataFrame, knowledge: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs from corrections that state another text for a row that has evidence: what it said is rejected, the correction chosen.

    knowledge: knowledge_id, value_text, title, subject, predicate; links: knowledge_id. Hard corrections count 0.95, others 0.85.
    """
    from .log import body

    fixes = log.where("kind = 'correction_recorded'").where(body("op").isin("edit", "reframe") & (body("target_layer") == "knowledge"))
    fixes = fixes.select(F.col("id").alias("event_id"), body("target_id").alias("knowledge_id"), body("body").alias("chosen"), body("hard").isin("true", "1").alias("hard"), F.col("ts").alias("occurred_at")).where("chosen <> ''")
    rows = fixes.join(knowledge, "knowledge_id").join(links.select("knowledge_id").distinct(), "knowledge_id", "left_semi")
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    about = F.coalesce(F.when(_about(F.col("subject"), F.col("predicate")) != "", _about(F.col("subject"), F.col("predicate"))), given("title"), F.lit("this belief"))
    rows = rows.select("event_id", "knowledge_id", F.concat(F.lit("State the correct value for: "), about).alias("prompt"), F.coalesce(given("value_text"), F.col("title"), F.lit("")).alias("rejected"), "chosen", F.coalesce("hard", F.lit(False)).alias("hard"), "occurred_at")
    return event_gate(rows).withColumn("confidence", F.when(F.col("hard"), 0.95).otherwise(0.85))


def superseded_pairs(knowledge: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs from values that others superseded, where the winner has evidence; they count 0.7.

    knowledge: knowledge_id, type, value_text, subject, predicate, superseded_by.
    """
    values = knowledge.where("type = 'value'")
    losers = values.where("superseded_by is not null").select(F.col("knowledge_id").alias("loser_id"), F.col("superseded_by").alias("knowledge_id"), F.coalesce("value_text", F.lit("")).alias("rejected"), "subject", "predicate")
    rows = losers.join(values.select("knowledge_id", F.coalesce("value_text", F.lit("")).alias("chosen")), "knowledge_id").join(links.select("knowledge_id").distinct(), "knowledge_id", "left_semi")
    about = F.coalesce(F.when(_about(F.col("subject"), F.col("predicate")) != "", _about(F.col("subject"), F.col("predicate"))), F.lit("this belief"))
    rows = rows.select("loser_id", "knowledge_id", F.concat(F.lit("State the current value for: "), about).alias("prompt"), "rejected", "chosen")
    return event_gate(rows).withColumn("confidence", F.lit(0.7))


def persona_pairs(turns: DataFrame, most: int = 4000) -> DataFrame:
    """Turns by verified authors in prose, with the answer before them."""
    said = F.when(F.col("role") == "assistant", F.substring("text", 1, most))
    rows = turns.withColumn("prompt", F.last(said, ignorenulls=True).over(_session().rowsBetween(Window.unboundedPreceding, -1)))
    return rows.where((F.col("role") == "user") & F.col("sender_verified") & T.is_style_admissible(F.col("text"))).select("session_id", "turn_idx", "prompt", T.sanitize(F.col("text")).alias("voice"))


def store_gate(examples: DataFrame) -> DataFrame:
    """examples (dataset, target, example, pos) cleaned, scrubbed and deduplicated: the first of each content in order stays, and of equal
    claim keys the first without a hard reason; later ones are excluded as near_dup."""
    rows = examples.withColumn("target", T.sanitize(F.col("target"))).withColumn("content_hash", F.sha2(F.encode("example", "UTF-8"), 256)).withColumn("dedup_key", T.claim_key(F.col("target")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("dataset", "content_hash").orderBy("pos"))).where("nth = 1").drop("nth")
    rows = rows.withColumn("reasons", T.scrub_reasons(F.col("target"), F.col("example"), F.col("dataset")))
    soft = F.array_except("reasons", F.array(F.lit("injection_flagged")))
    rows = rows.withColumn("fine", F.size(soft) == 0)
    earlier = F.sum(F.col("fine").cast("int")).over(Window.partitionBy("dataset", "dedup_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("near", (F.col("dedup_key") != "") & (F.coalesce(earlier, F.lit(0)) > 0))
    reasons = F.when(F.col("near"), F.array_append("reasons", F.lit("near_dup"))).otherwise(F.col("reasons"))
    return rows.select("dataset", "pos", "target", "content_hash", "dedup_key", reasons.alias("reasons"), F.when(F.col("fine") & ~F.col("near"), "stored").otherwise("excluded").alias("state"))


def classify(examples: DataFrame) -> DataFrame:
    """train_class and why. examples: dataset, source_kind, quality_label, quality_reasons (array), sender_verified, issues (array)."""
    hard = F.arrays_overlap("quality_reasons", F.array(*map(F.lit, HARD_REASONS)))
    pick = lambda c, why: F.struct(F.lit(c).alias("train_class"), (why if isinstance(why, Column) else F.lit(why)).alias("class_reason"))
    chosen = (
        F.when(F.col("quality_label").isin("bad", "excluded"), pick("exclude", F.concat(F.lit("quality_label:"), F.col("quality_label"))))
        .when(hard, pick("exclude", "hard_quality_contamination"))
        .when(F.array_contains("quality_reasons", "injection_flagged"), pick("exclude", "injection_flagged_training_boundary"))
        .when(F.size("issues") > 0, pick("exclude", F.concat(F.lit("current_training_boundary:"), F.try_element_at("issues", F.lit(1)))))
        .when((F.col("dataset") == "persona") & ~F.coalesce("sender_verified", F.lit(False)), pick("exclude", "persona_author_not_verified"))
        .when((F.col("dataset") == "persona") & (F.col("source_kind") == "git_commit"), pick("train_skill", "verified_human_commit_skill"))
        .when(F.col("dataset") == "persona", pick("train_voice", "verified_human_voice"))
        .when(F.col("dataset") == "dpo", pick("train_judgment", "accepted_preference_pair"))
        .when((F.col("dataset") == "sft") & (F.col("quality_label") != "good"), pick("retrieval_only", "sft_not_good"))
        .when(F.col("dataset") == "sft", pick("train_skill", "successful_instruction_exchange"))
        .otherwise(pick("exclude", "unknown_dataset"))
    )
    return examples.withColumn("__c", chosen).select(*examples.columns, "__c.*")


def seeded_hash(seed: str, *parts: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), "UTF-8"), 256)


def select_pack(examples: DataFrame, seed: str, targets: dict[str, int] | None = None, min_grade: float | None = None) -> DataFrame:
    """The pack of each dataset: by source priority, then by seeded hash, up to its target. With min_grade only graded rows that reach it."""
    wanted = PACK_TARGETS | (targets or {})
    priority = F.lit(3)
    for name, rank in {**SOURCE_PRIORITY, "session": 2}.items():
        priority = F.when(F.col("source_kind").endswith("_session") if name == "session" else F.col("source_kind") == name, rank).otherwise(priority)
    rows = examples.where("privacy_scope <> 'private'")
    if min_grade is not None:
        rows = rows.where(F.col("grade_score") >= min_grade)
    w = Window.partitionBy("dataset").orderBy(priority, seeded_hash(seed, F.col("dataset"), F.col("id")))
    target = F.lit(0)
    for name, n in wanted.items():
        target = F.when(F.col("dataset") == name, n).otherwise(target)
    return rows.withColumn("selection_rank", F.row_number().over(w)).where(F.col("selection_rank") <= target)


def finalise_pack(examples: DataFrame, seed: str, targets: dict[str, int] | None = None, min_grade: float = 0.8) -> DataFrame:
    """The final pack; fails before anything is written when a dataset falls short."""
    wanted = FINAL_TARGETS | (targets or {})
    chosen = select_pack(examples, seed, wanted, min_grade)
    have = {r["dataset"]: r["n"] for r in chosen.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a dataset
    short = {d: n - have.get(d, 0) for d, n in wanted.items() if have.get(d, 0) < n}
    if short:
        raise ValueError(f"pack falls short: {short}")
    return chosen


def split_validation(examples: DataFrame, seed: str, by: str = "dataset", most: int = 50) -> DataFrame:
    """The first min(most, a tenth) rows of each dataset by seeded hash are for validation."""
    w = Window.partitionBy(by)
    nth = F.row_number().over(w.orderBy(seeded_hash(seed, F.col("id")), "id"))
    held = F.least(F.lit(most), F.floor(F.count(F.lit(1)).over(w) / 10))
    return examples.withColumn("split", F.when(nth <= held, "valid").otherwise("train"))


def blind_side(eval_id: Column, seed: str) -> Column:
    """a or b by the parity of a seeded hash."""
    return F.when(F.conv(F.substring(seeded_hash(seed, eval_id), -1, 1), 16, 10).cast("int") % 2 == 0, "a").otherwise("b")


def blind_scores(ratings: DataFrame, key: DataFrame) -> DataFrame:
    """One row: wins, losses, ties and the win rate over decided ratings. ratings: eval_id, winner; key: eval_id, candidate_side."""
    rows = ratings.join(key, "eval_id")
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    won = (F.col("winner") != "tie") & (F.col("winner") == F.col("candidate_side"))
    lost = (F.col("winner") != "tie") & (F.col("winner") != F.col("candidate_side"))
    found = rows.agg(n(won, "wins"), n(lost, "losses"), n(F.col("winner") == "tie", "ties"))
    return found.withColumn("win_rate", F.round(F.col("wins") / F.when(F.col("wins") + F.col("losses") > 0, F.col("wins") + F.col("losses")), 6))


def blind_dimensions(ratings: DataFrame, key: DataFrame) -> DataFrame:
    """dimension, role, mean (3 digits) of scores from 1 to 5. ratings: eval_id, side, dimension, score; key: eval_id, candidate_side."""
    role = F.when(F.col("side") == F.col("candidate_side"), "candidate").otherwise("reference")
    rows = ratings.join(key, "eval_id").where(F.col("score").between(1, 5) & F.col("side").isin("a", "b"))
    return rows.groupBy("dimension", role.alias("role")).agg(F.round(F.avg("score"), 3).alias("mean"))


def blind_order(answers: DataFrame, seed: str) -> DataFrame:
    """answers (eval_id, source) with the label, a, b, ..., under which each is shown: the order of a seeded hash."""
    nth = F.row_number().over(Window.partitionBy("eval_id").orderBy(seeded_hash(seed, F.col("eval_id"), F.col("source"))))
    return answers.withColumn("label", F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), nth, F.lit(1)))


def ranking_dimensions(scores: DataFrame, shown: DataFrame) -> DataFrame:
    """source, dimension, mean (4 digits). scores: eval_id, label, dimension, score; shown: blind_order()."""
    rows = scores.join(shown.select("eval_id", "label", "source"), ["eval_id", "label"])
    return rows.groupBy("source", "dimension").agg(F.round(F.avg("score"), 4).alias("mean"))


def ranking_scores(rankings: DataFrame) -> DataFrame:
    """candidate, first places, mean rank. rankings: eval_id, ranking (array of candidates, best first)."""
    rows = rankings.select("eval_id", F.posexplode("ranking").alias("pos", "candidate"))
    return rows.groupBy("candidate").agg(F.sum((F.col("pos") == 0).cast("long")).alias("first_places"), F.round(F.avg(F.col("pos") + 1), 6).alias("mean_rank"))


def id_set_differences(**tables: DataFrame) -> DataFrame:
    """eval ids that some table lacks, with the tables that have them."""
    rows = None
    for name, df in tables.items():
        part = df.select("eval_id", F.lit(name).alias("have")).distinct()
        rows = part if rows is None else rows.unionByName(part)
    found = rows.groupBy("eval_id").agg(F.sort_array(F.collect_set("have")).alias("have"))
    return found.where(F.size("have") < len(tables))


def exportable(examples: DataFrame, min_scope: str = "workspace", min_label: str = "good", min_grade: float | None = None, verified_only: bool = True) -> DataFrame:
    """Rows that may be exported, in export order (time, id). Private rows never are; persona rows need a verified sender."""
    from evergrain.functions.scope import PRIVACY_RANK, privacy_rank

    rank = F.lit(-1)
    for name, r in LABEL_RANK.items():
        rank = F.when(F.col("quality_label") == name, r).otherwise(rank)
    ok = (rank >= LABEL_RANK[min_label]) & (F.col("privacy_scope") != "private") & (privacy_rank(F.col("privacy_scope")) >= PRIVACY_RANK[min_scope])
    if min_grade is not None:
        ok = ok & F.coalesce(F.col("grade_score") >= min_grade, F.lit(False))
    if verified_only:
        ok = ok & ((F.col("dataset") != "persona") | F.coalesce(F.get_json_object("example_json", "$.metadata.sender_verified") == "true", F.lit(False)))
    return examples.where(ok).orderBy(F.coalesce("occurred_at", F.lit("")), "id")


def growth_report(examples: DataFrame) -> DataFrame:
    """Counts by dataset, label, scope and ISO week (grouping sets), with grades."""
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.to_timestamp("occurred_at")), F.lit("-W"), F.lpad(F.weekofyear(F.to_timestamp("occurred_at")).cast("string"), 2, "0"))
    rows = examples.withColumn("week", week)
    sets = [["dataset", "quality_label"], ["dataset", "privacy_scope"], ["dataset", "week"], ["dataset"]]
    cols = [F.col(c) for c in ("dataset", "quality_label", "privacy_scope", "week")]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.count(F.lit(1)).alias("n"), F.avg("grade_score").alias("grade_avg"), F.min("grade_score").alias("grade_min"), F.max("grade_score").alias("grade_max"))


def apply_model(rows: DataFrame, call, schema: str) -> DataFrame:
    """The hook for graders, judges, raters and embedders: call(frame) -> frame, on Arrow batches on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield call(batch)

    return rows.mapInPandas(run, schema)


def mine_all(turns: DataFrame) -> dict[str, DataFrame]:
    """Exchanges, preference pairs and voice of the same turns, each under its dataset's name. Persist turns before, where parsing them is dear."""
    return {"sft": exchanges(turns), "dpo": gated_pairs(preference_pairs(turns)), "persona": persona_pairs(turns)}


def founder_sessions(lines: DataFrame, turns: DataFrame, names: list[str]) -> DataFrame:
    """Turns of sessions to mine again, whatever their watermark: those in which one of the named people writes.

    lines (session_id, line) are raw transcript lines: the cheap look that goes before the authors of parsed turns. names is the operator's short list.
    """
    named = F.lit(False)
    for name in names:
        named = named | F.col("line").contains(name)
    maybe = lines.where(named).select("session_id").distinct()
    sure = turns.join(maybe, "session_id", "left_semi").where(F.col("authored_by").isin(*names)).select("session_id").distinct()
    return turns.join(sure, "session_id", "left_semi")


def held_out(examples: DataFrame, n: int, seed: str) -> DataFrame:
    """The n examples kept for evaluation: those that no pack selected first, then by seeded hash of the id. examples: id, content_hash, train_selected."""
    order = [F.coalesce("train_selected", F.lit(False)).cast("int"), seeded_hash(seed, F.col("id")), F.col("id")]
    return examples.orderBy(*order).limit(n)


def without_held_out(examples: DataFrame, held: DataFrame) -> DataFrame:
    """Examples none of whose content is held out, under whatever id."""
    return examples.join(held.select("content_hash").distinct(), "content_hash", "left_anti")


def trimmed_chats(messages: DataFrame, most: int = 1600, least_answer: int = 80) -> DataFrame:
    """id, n_kept, prompt_chars, trimmed, usable: prompts that drop their oldest messages until `most` characters hold, one message at least.

    messages: id, pos, role, content. A chat is usable when it ends in an answer of least_answer characters, has a prompt, and that fits.
    """
    last = Window.partitionBy("id").orderBy(F.desc("pos"))
    rows = messages.withColumn("back", F.row_number().over(last)).withColumn("n", F.length(F.coalesce("content", F.lit(""))))
    prompt = rows.where("back > 1").withColumn("used", F.sum("n").over(last.rowsBetween(Window.unboundedPreceding, 0)))
    kept = prompt.where((F.col("used") <= most) | (F.col("back") == 2))
    sums = kept.groupBy("id").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("n").alias("prompt_chars"))
    ends = rows.where("back = 1").select("id", ((F.col("role") == "assistant") & (F.length(F.trim("content")) >= least_answer)).alias("ends_well"))
    sizes = messages.groupBy("id").agg(F.count(F.lit(1)).alias("n_all"))
    joined = sizes.join(ends, "id").join(sums, "id", "left").na.fill(0, ["n_kept", "prompt_chars"])
    usable = F.col("ends_well") & (F.col("n_all") >= 2) & (F.col("prompt_chars") <= most)
    return joined.select("id", "n_kept", "prompt_chars", (F.col("n_kept") < F.col("n_all") - 1).alias("trimmed"), F.coalesce(usable, F.lit(False)).alias("usable"))


def training_result(metrics: DataFrame, pack: DataFrame, model: str, ts: str) -> DataFrame:
    """One row that records a training run: its pack's rows and digest, and the last of each metric. metrics: step, name, value."""
    last = metrics.groupBy("name").agg(F.max_by("value", "step").alias("value"))
    shown = last.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metrics"))  # a row a metric
    packed = pack.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64("content_hash")).alias("pack_digest"))
    return packed.crossJoin(F.broadcast(shown)).withColumn("model", F.lit(model)).withColumn("ts", F.lit(ts))  # one row each
