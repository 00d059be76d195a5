"""Grading under caps, curated facts and loop results: nothing twice, all or nothing."""

import hashlib

import pytest
from pyspark.sql import functions as F

from evergrain.operators.curated import CuratedFacts, Rejected, source_verdicts
from evergrain.operators.grading import Caps, GradeLedger, request_hash
from evergrain.sources import files
from evergrain.streaming.ingest import TABLES, LoopTables


def test_admission_under_caps_and_reruns(spark, tmp_path):
    rows = [(f"e{k:02d}", k % 3, (k * 7) % 5 + 1, f"text {k % 30}") for k in range(40)]
    df = spark.createDataFrame(rows, "example_id string, priority int, cost int, text string").repartition(3).withColumn("request_hash", request_hash("m", "v", F.lit("r"), F.col("text")))
    ledger = GradeLedger(spark, f"{tmp_path}/g")
    asked, days = [], {"d1": Caps(6, 10, 14, 1000), "d2": Caps(100, 100, 1000, 30), "d3": Caps(100, 100, 1000, 1000)}
    first = {}
    for e, p, c, t in sorted(rows, key=lambda r: (r[1], r[0])):
        first.setdefault(t, (p, e, c, t))
    for day, caps in days.items():
        for _ in range(3):
            items, cost = ledger.spent(day)
            left, want = sorted(r for r in first.values() if r[3] not in asked), []
            used = 0
            for p, e, c, t in left:
                if len(want) == min(caps.run_items, caps.day_items - items) or used + c > min(caps.run_cost, caps.day_cost - cost):
                    break
                used += c
                want.append((len(want) + 1, e, c))
            got = ledger.admit(df, day, caps)
            assert sorted((r["nth"], r["example_id"], r["cost"]) for r in got.collect()) == want
            ledger.record(got.withColumn("score", F.lit(1.0)), day)
            asked += [r[3] for r in left if r[1] in {e for _, e, _ in want}]
    assert sorted(asked) == sorted(first)
    answers = ledger.answers()
    assert answers.count() == answers.select("request_hash").distinct().count() == 30
    assert ledger.record(answers, "d4") == 0


def manifest(spark, tmp_path):
    out = []
    for ref in ("a", "b"):
        path = f"{tmp_path}/{ref}.md"
        with open(path, "w") as f:
            f.write(f"source {ref}")
        out.append((ref, path, hashlib.sha256(f"source {ref}".encode()).hexdigest()))
    return spark.createDataFrame(out, "ref string, path string, sha256 string")


FACT = "id string, body string, source_refs array<string>, visibility string, egress_policy string, confidence double"


def test_curated_facts_all_or_nothing(spark, tmp_path):
    sources = manifest(spark, tmp_path)
    kept = CuratedFacts(spark, f"{tmp_path}/facts", "p")
    good = [("1", "one", ["a"], None, None, None), ("2", "two", ["b", "a"], "internal", "hosted_ok", 0.4)]
    state = lambda df: {r["belief_id"]: r["state"] for r in df.collect()}
    with pytest.raises(Rejected, match="2: hosted_not_acknowledged"):
        kept.apply(spark.createDataFrame(good, FACT), sources)
    assert kept.store.current() is None
    assert state(kept.apply(spark.createDataFrame(good, FACT), sources, True)) == {"curated:p:1": "applied", "curated:p:2": "applied"}
    version = kept.store.current()["version"]
    bad = [("1", "other", ["a"], None, None, None), ("3", "three", ["zzz"], None, None, None), ("4", " ", [], None, None, None), ("4", "x", ["a"], "secret", "hosted_ok", None)]
    with pytest.raises(Rejected) as e:
        kept.apply(spark.createDataFrame(bad, FACT), sources, True)
    assert str(e.value) == "3: unknown_source; 4: no_body, duplicate_id, no_source; 4: duplicate_id, hosted_but_closed" or "4: duplicate_id, hosted_but_closed" in str(e.value)
    assert kept.store.current()["version"] == version
    again = [("1", "one", ["a"], None, None, None), ("2", "two!", ["b", "a"], "internal", "hosted_ok", 0.4)]
    assert state(kept.apply(spark.createDataFrame(again, FACT), sources, True)) == {"curated:p:1": "unchanged", "curated:p:2": "applied"}
    rows = {r["belief_id"]: r for r in kept.current().collect()}
    assert rows["curated:p:2"]["body"] == "two!" and rows["curated:p:1"]["confidence"] == 0.9 and [x["ref"] for x in rows["curated:p:2"]["attestations"]] == ["b", "a"]
    with open(f"{tmp_path}/a.md", "w") as f:
        f.write("changed")
    more = sources.unionByName(spark.createDataFrame([("c", f"{tmp_path}/none.md", "0")], sources.schema))
    assert {r["ref"]: r["verdict"] for r in source_verdicts(spark, more).collect()} == {"a": "changed", "b": "ok", "c": "missing"}
    with pytest.raises(Rejected, match="a: changed"):
        kept.apply(spark.createDataFrame(good, FACT), sources, True)
    with pytest.raises(Rejected):
        kept.apply(spark.createDataFrame([], FACT), sources.where("ref = 'b'"))


def test_same_batch_twice_leaves_equal_tables(spark, tmp_path):
    text = ('{"schema_version":"1","loop_id":"l","run_id":"r","item_id":"%s","decision":"kept","experiment_family":"f","eval":{"metric_name":"m","direction":"higher_is_better","result_value":"2","passed":true},'
            '"verifier":{"passed":%s},"lesson_candidates":[{"target":"memory","body":"same lesson"}],"guardrails":[{"name":"g","passed":false}]}')  # fmt: skip
    rows = spark.createDataFrame([("/1", text % ("i1", "true"), []), ("/2", text % ("i2", "false"), ["kept_without_verifier"]), ("/3", text % ("i3", "true"), [])], "path string, t string, errors array<string>")
    rows = rows.select("path", F.from_json("t", files.ENVELOPE).alias("data"), "errors")
    kept = LoopTables(spark, f"{tmp_path}/l")
    kept.step(rows, 0)
    state = lambda: {n: sorted(map(str, kept.table(n).collect())) for n in TABLES}
    before, version = state(), kept.store.current()["version"]
    kept.step(rows, 0)
    assert kept.store.current()["version"] == version
    kept.step(rows, 1)
    assert state() == before
    assert {n: len(v) for n, v in before.items()} == {"evidence": 2, "metrics": 2, "lessons": 1, "tripwires": 3, "results": 2}
    family = kept.families().first()
    assert (family["loop_id"], family["family"], family["attempts"], family["kept"], family["guardrail_failures"]) == ("l", "f", 2, 2, 2)
