from pyspark.sql import functions as F

from evergrain.operators import packet, review
from evergrain.plans.stages import run_stages

TURNS = "session_id string, turn_idx long, role string, kind string, text string, ts string, tool_error boolean, n_tool_calls long"


def test_review(spark):
    rows = [("a", 0, "user", "bare", "please deploy", "t", False, 0), ("a", 1, "assistant", "", "doing", "t", False, 6), ("a", 2, "tool", "", "FAILED: exit", "t", True, 0), ("a", 3, "tool", "", "deployment succeeded, 12 passed", "t", False, 0),
            ("a", 4, "assistant", "", "Deployed; I am reverting nothing", "t", False, 0), ("a", 5, "user", "bare", "yes, thanks", "t", False, 0), ("a", 6, "user", "bare", "that's wrong", "t", False, 0), ("a", 7, "user", "bare", "go ahead", "t", False, 0)]
    df = spark.createDataFrame(rows, TURNS)
    got = sorted((r["turn_idx"], r["kind"], r["weight"]) for r in review.turn_signals(df).collect())
    assert got == [(2, "test_fail", 0.6), (3, "deploy_success", 0.6), (3, "test_pass", 0.4), (4, "revert", 0.7), (5, "user_approval", 0.5), (5, "user_thanks", 0.6), (6, "user_correction", 0.8)]  # no approval right after a user
    out = review.session_outcomes(df, min_calls=1)
    row = out.first()
    assert (row["recovered"], row["success"], row["n_clean"], row["first_request"]) == (True, True, 1, "please deploy")
    corrected = review.turn_signals(df).where("kind = 'user_correction'")
    assert not review.session_outcomes(df, 1, corrected).first()["success"]
    assert [r["kind"] for r in review.outcome_signals(out, df.where("false").select("session_id")).collect()] == ["error_recovery", "task_closeout_success"]
    known = spark.createDataFrame([("nothing",)], "claim_key string")
    assert [(r["kind"], r["title"]) for r in review.candidates(out, known).collect()] == [("recovery", "please deploy")]


def test_packet(spark):
    df = spark.createDataFrame([(1, k, f"b{k}", "x" * 1500, 1.0) for k in range(1, 40)], "query_id long, rank long, belief_id string, body string, score double")
    got = packet.context_packet(df)
    counts = packet.packet_accounting(got).first()
    assert counts["bytes"] <= 31488 and counts["n_items"] == 20
    receipts, items = packet.record_retrieval(got, "2026-01-01", "s")
    assert len(receipts.first()["served_ids"]) == 20 and items.count() == 20
    status = lambda *s: spark.createDataFrame([(list(s),)], "s array<string>").select(packet.verification_status(F.col("s")).alias("x")).first()["x"]
    assert (status("passed", "passed"), status("passed", "failed"), status("passed", "unknown"), status()) == ("verified", "failed", "agent_reported", "agent_reported")


def test_stage_machine():
    def boom():
        raise ValueError("x")

    done = run_stages({"snapshot": dict, "harvest": boom, "promote": dict})
    assert done.status == "partial" and [s["state"] for s in done.stages] == ["done", "failed", "done"]
    assert run_stages({"snapshot": boom, "promote": dict}).status == "aborted"
