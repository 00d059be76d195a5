"""Folds, chains, labels, pairs and streams on small tables."""

import json
import random

from pyspark.sql import functions as F

from evergrain.functions.scope import ScopeContext
from evergrain.operators import factory, feedback, fold, log, ops, retrieval
from evergrain.sources import files, transcripts
from evergrain.streaming import streams

LOG = "event_seq long, id string, ts string, kind string, writer string, session_id string, body_json string, body_hash string, prev_hash string, event_hash string"


def make_log(spark, events):
    rows = log.append((0, None), [{"ts": f"2026-01-01T00:00:{k:02d}", "writer": "w", "session_id": None, "kind": kind, "body": body(k) if callable(body) else body} for k, (kind, body) in enumerate(events)])
    names = [c.split(" ")[0] for c in LOG.split(", ")]
    return rows, spark.createDataFrame([tuple(r[n] for n in names) for r in rows], LOG)


def proposal(belief="b1", text="v1", conf=0.8):
    return ("compilation_proposed", {"belief_id": belief, "body": text, "confidence": conf, "evidence_ids": ["e1"], "scope": {"scope_type": "global", "scope_id": "global:doctrine", "visibility": "internal", "egress_policy": "hosted_ok"}})


def test_chain_verifies_and_detects_tampering(spark):
    rows, df = make_log(spark, [("evidence_recorded", {"evidence_id": f"e{k}", "body": f"é{k}"}) for k in range(6)])
    assert log.verify_chain(df).count() == 0
    bad = df.withColumn("body_json", F.when(F.col("event_seq") == 3, F.lit('{"x":1}')).otherwise(F.col("body_json")))
    assert [(r["event_seq"], r["reason"]) for r in log.verify_chain(bad).collect()] == [(3, "body_hash_mismatch")]
    cut = df.where("event_seq <> 4")
    assert [r["reason"] for r in log.verify_chain(cut).collect()] == ["missing_predecessor"]


def decided(rows, k, **more):
    return ("compilation_decided", {"proposal_event_id": rows[k]["id"], "decision": "approve"} | more)


def test_fold_semantics(spark):
    rows, _ = make_log(spark, [proposal(conf=0.0)])
    events = [proposal(conf=0.0), decided(rows, 0), ("correction_recorded", {"target_layer": "belief", "target_id": "b1", "op": "demote"}), ("correction_recorded", {"target_layer": "belief", "target_id": "b1", "op": "pin"})]
    _, df = make_log(spark, events)
    got = fold.fold(df).first()
    assert (got["confidence"], got["pinned"], got["status"], got["serve"]) == (0.4, True, "current", True)  # 0 counts as unset
    late = [events[0], ("tombstone_recorded", {"target": "b1", "mode": "shred"}), events[1]]
    _, df = make_log(spark, late)
    got = fold.fold(df).first()
    assert (got["status"], got["body"], got["evidence_ids"]) == ("tombstoned", "[shredded by tombstone]", [])
    assert fold.fold(df, replay=False).first()["status"] == "current"
    soft = [("correction_recorded", {"target_layer": "belief", "target_id": "b1", "op": "mark_wrong"}), events[0]]
    r2, _ = make_log(spark, soft)
    _, df = make_log(spark, [*soft, decided(r2, 1)])
    assert fold.fold(df).first()["status"] == "current"  # a soft correction from before the proposal does not last


def test_native_fold_equals_the_step_by_step_fold(spark):
    rnd = random.Random(7)
    rows, proposals = [], {}
    scope = lambda k: {"scope_type": "project", "scope_id": f"project:{k}", "visibility": "internal", "egress_policy": "local_only"}
    for seq in range(700):
        b = f"b{rnd.randrange(30)}"
        kind = rnd.choice(["compilation_proposed", "compilation_decided", "correction_recorded", "tombstone_recorded", "scope_promoted", "evidence_recorded"])
        if kind == "compilation_proposed":
            proposals.setdefault(b, []).append(f"e{seq}")
            body = {"belief_id": b, "body": rnd.choice(["", f"t{seq}"]), "confidence": rnd.choice([None, 0.0, 0.3, 0.9]), "evidence_ids": rnd.choice([None, [], ["x", "y"]]), "belief_type": rnd.choice([None, "rule"]), "scope": rnd.choice([None, scope(seq)])}
        elif kind == "compilation_decided":
            body = {"proposal_event_id": rnd.choice(proposals.get(b) or ["none"]), "decision": rnd.choice(["approve", "approve", "edit", "reject", "shadow"]), "edited_body": rnd.choice([None, "", f"edited {seq}"])}
        elif kind == "correction_recorded":
            body = {"target_layer": rnd.choice(["belief", "knowledge", "evidence"]), "target_id": b, "op": rnd.choice(["edit", "reframe", "pin", "demote", "mark_wrong", "retract", "other"]), "body": rnd.choice([None, "", f"c{seq}"]), "hard": rnd.choice([True, False, None])}
        elif kind == "tombstone_recorded":
            if rnd.random() < 0.7:
                continue
            body = {"target": b, "mode": rnd.choice(["hide", "shred"])}
        elif kind == "scope_promoted":
            body = {"belief_id": b, "approved_by": rnd.choice([None, "", "me"]), "scope": scope(seq)}
        else:
            body = {"evidence_id": "x", "body": "y"}
        rows.append((seq, f"e{seq}", f"t{seq:04d}", kind, "w", None, json.dumps(body), None, None, f"h{seq}"))
    df = spark.createDataFrame(rows, LOG)
    for replay in (True, False):
        groups = {}
        for r in fold.routed(df).collect():
            groups.setdefault(r["canonical"], []).append(r.asDict())
        want = {b: fold.fold_events(b, g, replay=replay) for b, g in groups.items() if b is not None}
        want = {b: w for b, w in want.items() if w is not None}
        got = {r["belief_id"]: r.asDict() for r in fold.fold(df, replay=replay).collect()}
        assert got == want and len(want) > 15
    at = df.where("event_seq <= 350")
    for cursor in ((350, "h350"), (350, "other"), None):
        stored = fold.fold(at)
        row = at.orderBy(F.desc("event_seq")).first()
        cursor = cursor and ((row["event_seq"], row["event_hash"]) if cursor[1] == "h350" else cursor)
        assert {r["belief_id"]: r for r in fold.advance(df, stored, cursor).collect()} == {r["belief_id"]: r for r in fold.fold(df).collect()}


def test_streamed_fold_saves_touched_beliefs(spark):
    first, _ = make_log(spark, [proposal("b1", "v1"), proposal("b2", "v2")])
    events = [proposal("b1", "v1"), proposal("b2", "v2"), decided(first, 0), decided(first, 1), ("correction_recorded", {"target_layer": "belief", "target_id": "b1", "op": "pin"})]
    _, df = make_log(spark, events)
    saved = []
    step = streams.fold_batches(lambda: df, lambda rows: saved.append({r["belief_id"]: (r["body"], r["pinned"]) for r in rows.collect()}))
    step(df.where("event_seq = 5"), 0)
    step(df.where("event_seq = 4"), 1)
    assert saved == [{"b1": ("v1", True)}, {"b2": ("v2", False)}]


def test_imports_become_beliefs(spark):
    notes = spark.createDataFrame([("a.md", "first note"), ("b.md", "second note")], "path string, body string")
    made = sorted(files.import_events(notes).collect(), key=lambda r: (r["path"], r["step"]))
    rows = log.append((0, None), [{"ts": "t", "writer": "w", "kind": r["kind"], "body": json.loads(r["body_json"])} for r in made])
    names = [c.split(" ")[0] for c in LOG.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], LOG)
    assert log.verify_chain(df).count() == 0
    assert sorted(r["body"] for r in fold.fold(df).collect()) == ["first note", "second note"]


def test_signals_without_an_object_stay_apart(spark):
    got = feedback.violation_signals(spark.createDataFrame([(1,), (2,), (2,)], "violation_id long")).collect()
    assert len(got) == 2 and all(r["signal_id"] and r["weight"] == 0.7 for r in got)


def test_promotion_budget_spares_pinned_rows(spark):
    cols = "knowledge_id long, body string, status string, quarantine_reason string, quality_label string, quality_confidence double, confidence double, prescriptive boolean, type string, risk string, updated_at string, privacy_scope string, origin string"
    rows = [(k, "x" * 40, "current", None, "good", 0.6 + k / 100, 0.5, False, "doc", "low", "2026-01-01", "public", "human" if k == 0 else None) for k in range(6)]
    empty = lambda schema: spark.createDataFrame([], schema)
    found = ops.promote(spark.createDataFrame(rows, cols), empty("knowledge_id long, outcome string"), empty("knowledge_id long, evidence_id long"), empty("evidence_id long, claim string, verifier_status string, source_type string, injection_scan_status string"),
                        empty("knowledge_id long, kind string, polarity string"), F.to_timestamp(F.lit("2026-01-01")), ops.OpsRules(max_chars=125))
    assert sorted(r["knowledge_id"] for r in found.where("inject").collect()) == [0, 4, 5]


def test_incremental_fold_equals_full_fold():
    rnd = random.Random(1337)
    for _ in range(40):
        events = []
        for seq in range(30):
            kind = rnd.choice(["compilation_decided", "correction_recorded", "tombstone_recorded", "scope_promoted"])
            payload = {"compilation_decided": {"decision": rnd.choice(["approve", "reject"])}, "correction_recorded": {"target_layer": "belief", "op": rnd.choice(["edit", "pin", "demote", "mark_wrong"]), "body": "e", "hard": rnd.random() < 0.5},
                       "tombstone_recorded": {"mode": "hide"}, "scope_promoted": {"approved_by": "x", "scope": {"scope_type": "global"}}}[kind]
            events.append({"event_seq": seq, "id": f"e{seq}", "ts": "t", "kind": kind, "payload": json.dumps(payload), "proposal": json.dumps({"body": "b", "confidence": 0.9}), "proposal_seq": max(0, seq - 3)})
        cut = rnd.randrange(30)
        state = fold.fold_events("b", events[:cut], replay=False)
        assert fold.fold_events("b", events[cut:], state, replay=False) == fold.fold_events("b", events, replay=False)


def test_label_fold(spark):
    rows = [("a", "good", 0.8, "2026-01-01"), ("a", "good", 0.8, "2026-01-01"), ("b", "bad", 1.0, "2020-01-01"), ("c", "good", 0.2, "2026-01-01"), ("d", "good", 0.9, "2026-01-01"), ("d", "bad", 0.85, "2026-01-01")]
    got = {r["knowledge_id"]: (r["label"], round(r["confidence"], 6)) for r in feedback.fold_labels(spark.createDataFrame(rows, "knowledge_id string, polarity string, weight double, occurred_at string"), F.to_timestamp(F.lit("2026-01-01"))).collect()}
    assert got == {"a": ("good", round(2 / 3, 6)), "b": ("bad", 0.95), "c": ("neutral", 0.5), "d": ("neutral", round(0.05 / 1.75 * 2 / 3, 6))}


TURNS = "session_id string, turn_idx long, role string, kind string, text string, ts string, tool_error boolean, n_tool_calls long, authored_by string, sender_verified boolean"


def turns(spark, *said):
    return spark.createDataFrame([("s", k, r, "bare" if r == "user" else "", t, None, False, 0, None, False) for k, (r, t) in enumerate(said)], TURNS)


def test_preference_pairs(spark):
    bad, good = "The deploy uses port 8080 on the gateway host today.", "The deploy uses port 9090 on the internal worker host."
    df = turns(spark, ("user", "Which port does the deploy use?"), ("assistant", bad), ("user", "that's wrong, the deploy worker port is not right"), ("assistant", good), ("user", "thanks, perfect"))
    pairs = factory.preference_pairs(df)
    assert [(r["gate"], r["rejected"], r["chosen"]) for r in pairs.collect()] == [("strict", bad, good)]
    kept = factory.gated_pairs(pairs).collect()
    assert len(kept) == 1 and round(kept[0]["confidence"], 6) == 0.6
    last = turns(spark, ("user", "Which port does the deploy use?"), ("assistant", bad), ("user", "that's wrong, it is not correct: the deploy uses port 9090"))
    assert [r["gate"] for r in factory.preference_pairs(last).collect()] == ["relaxed"]
    assert factory.preference_pairs(last, relaxed=False).count() == 0


def test_collapse_keeps_authors_apart(spark):
    rows = [("s", 0, "user", "bare", "a", None, False, 0, "x", True), ("s", 1, "user", "bare", "b", None, False, 0, "y", False), ("s", 2, "user", "bare", "c", None, False, 0, None, False), ("s", 3, "assistant", "", "d", None, False, 2, None, False), ("s", 4, "assistant", "", "e", None, True, 1, None, False)]
    got = [(r["text"], r["authored_by"], r["n_tool_calls"], r["tool_error"]) for r in factory.collapse(spark.createDataFrame(rows, TURNS)).orderBy("turn_idx").collect()]
    assert got == [("a", "x", 0, False), ("b\nc", "y", 0, False), ("d\ne", None, 3, True)]


def test_context_window_drops_oldest(spark):
    df = turns(spark, *[("user" if k % 2 == 0 else "assistant", f"text {k} " + "x" * 90) for k in range(8)])
    targets = df.where("turn_idx = 7").select("session_id", F.col("turn_idx").alias("target_idx"))
    got = factory.context_windows(df, targets, max_turns=5, max_chars=300).first()
    assert got["n_context"] == 3 and [m["content"][:6] for m in got["context"]] == ["text 4", "text 5", "text 6"]


def test_retrieval_pieces(spark):
    beliefs = spark.createDataFrame([("b1", "k", "t", "alpha beta gamma", 0.9, False, "2026-01-01", "{}"), ("b2", "k", "t", "Alpha, beta gamma!", 0.5, False, "2026-01-01", "{}"), ("b3", "k", "t", "delta epsilon", 0.9, True, "2026-01-01", "{}")],
                                    "belief_id string, kind string, title string, body string, confidence double, pinned boolean, last_compiled_at string, attributes string")
    for c, v in (("scope_type", "global"), ("scope_id", "global:doctrine"), ("visibility", "internal"), ("egress_policy", "hosted_ok"), ("status", "current")):
        beliefs = beliefs.withColumn(c, F.lit(v))
    beliefs = beliefs.withColumn("serve", F.lit(True))
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "nothing here")], "query_id long, query string")
    got = retrieval.hybrid(beliefs, queries, None, ScopeContext(), F.to_timestamp(F.lit("2026-01-01"))).collect()
    assert [(r["query_id"], r["belief_id"], r["rank"]) for r in got] == [(1, "b1", 1)]  # b2 has the same content
    bodies = spark.createDataFrame([("a", 1, 1.0, 0.8, "The worker never uses port nine"), ("b", 2, 1.0, 0.5, "The worker uses port nine")], "belief_id string, pos long, scope_weight double, confidence double, body string")
    found = retrieval.contradictions(bodies, spark.createDataFrame([(1, "worker port")], "query_id long, query string")).first()
    assert (found["belief_id"], found["other_belief_id"], found["n_shared"]) == ("a", "b", 3)


def test_contradictions_by_brute_force(spark):
    bodies = ["The worker never uses port nine", "The worker uses port nine", "Nightly backups cannot skip the worker port", "Backups skip the worker port", "Blue fox runs nine miles", "Blue fox never runs nine miles", ""]
    rows = [(f"b{k}", 10 - k, 1.0 - k / 20, None if k == 2 else 0.9 - k / 10, t) for k, t in enumerate(bodies)]
    asked = [(1, "worker port"), (2, "zebra quartz"), (3, "is it the"), (4, ""), (5, "fox")]  # 2 to 4 share no term with any row
    cut = lambda t: [w for w in t.lower().split()]
    words = lambda t: set(cut(t)) - {"the", "uses", "never", "cannot", "is", "it"}
    for most in (3, 5, 200):
        want = {}
        for q, text in asked:
            seen = sorted(rows, key=lambda r: r[1])
            seen = ([r for r in seen if words(r[4]) & words(text)] or seen)[:most]
            for i, a in enumerate(seen):
                for b in seen[i + 1 :]:
                    wa, wb = words(a[4]), words(b[4])
                    if len(wa & wb) >= 2 and bool({"never", "cannot"} & set(cut(a[4]))) != bool({"never", "cannot"} & set(cut(b[4]))):
                        value = 1 + len(words(text) & (wa | wb)) / max(1, len(words(text))) + len(wa & wb) / min(len(wa), len(wb))
                        want[q, a[0], b[0]] = round(value * min(a[2], b[2]) * min(0.5 if r is None else r for r in (a[3], b[3])), 5)
        df = spark.createDataFrame(rows, "belief_id string, pos long, scope_weight double, confidence double, body string")
        got = retrieval.contradictions(df, spark.createDataFrame(asked, "query_id long, query string"), limit=99, most=most).collect()
        assert {(r["query_id"], r["belief_id"], r["other_belief_id"]): round(r["score"], 5) for r in got} == want
        assert {2, 3, 4} <= {q for q, _, _ in want}


def test_ops(spark):
    runs = spark.createDataFrame([("x", k, k in (3, 4)) for k in range(5)] + [("y", 0, True), ("y", 1, False)], "job string, at long, failed boolean")
    assert {r["job"]: r["streak"] for r in ops.failure_streaks(runs, "job", F.col("at"), F.col("failed")).collect()} == {"x": 2, "y": 0}
    live = spark.createDataFrame([("a", "2026-01-01T00:00:00", "2025-12-31T00:00:00", "2026-01-01T01:00:00", None), ("b", "soon", None, None, None), ("c", "2030-01-01T00:00:00", None, None, None)], "loop_id string, due_at string, last_heartbeat_at string, last_ledger_at string, running_since string")
    assert {r["loop_id"]: r["kinds"] for r in ops.overdue(live, F.to_timestamp(F.lit("2026-02-01"))).collect()} == {"a": ["heartbeat_starved"], "b": ["invalid_deadman_due"]}
    rows = spark.createDataFrame([("a", "t1"), ("b", "t1"), ("c", "t2")], "id string, ts string")
    assert sorted(r["id"] for r in ops.after_cursor(rows, "ts", "id", "t1", "a").collect()) == ["b", "c"]


def test_sources(spark, tmp_path):
    session = tmp_path / "s1.jsonl"
    session.write_text("\n".join([json.dumps({"type": "session", "id": "abc"}), "broken {", json.dumps({"type": "message", "timestamp": "t1", "message": {"role": "user", "content": "hello there"}}),
                                  json.dumps({"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "toolCall"}]}}), json.dumps({"type": "message", "message": {"role": "toolResult", "content": "Error: failed with code"}})]))
    got = [(r["session_id"], r["role"], r["kind"], r["text"], r["n_tool_calls"], r["tool_error"]) for r in transcripts.read_turns(spark, str(tmp_path)).orderBy("turn_idx").collect()]
    assert got == [("abc", "user", "bare", "hello there", 0, False), ("abc", "assistant", "", "hi", 1, False), ("abc", "tool", "", "Error: failed with code", 0, True)]
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "a.md").write_text("# Title\npassword = abc123")
    (notes / ".hidden.md").write_text("x")
    assert [(r["title"], r["body"]) for r in files.note_files(spark, str(notes)).collect()] == [("Title", "# Title\npassword = [REDACTED]")]
    text = spark.createDataFrame([("a" * 50,)], "t string").select(files.history_window(F.col("t"), 20).alias("w")).first()["w"]
    assert text == "a" * 10 + "\n[... 30 bytes omitted ...]\n" + "a" * 10


def test_repo_documents(spark, tmp_path):
    for name, text in {"README.md": "readme", "docs/a/b.md": "deep", "docs/c.txt": "no", "src/x.py": "code", "src/y.md": "no", "other/README.md": "no", "LICENSE": "x" * 600_000}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    got = {r["path"]: len(r["text"]) for r in files.repo_documents(spark, str(tmp_path)).collect()}
    assert got == {"README.md": 6, "docs/a/b.md": 4, "src/x.py": 4, "LICENSE": 512_000}
