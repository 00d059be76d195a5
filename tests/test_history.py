"""The store of beliefs with bucketed histories, and its versions."""

import uuid

import pytest
from pyspark.sql import functions as F

from evergrain.operators import history, log
from evergrain.operators.fold import fold
from evergrain.operators.history import BeliefStore
from evergrain.sources.store import Conflict, Store

LOG = "event_seq long, id string, ts string, kind string, writer string, session_id string, body_json string, body_hash string, prev_hash string, event_hash string"


def events(n, start=0):
    """n rounds of events on 40 beliefs; each round proposes, decides the round before's proposal and corrects."""
    out = []
    for k in range(start, start + n):
        b = f"bel_{k % 40}"
        out.append({"kind": "compilation_proposed", "body": {"belief_id": b, "body": f"text {k}", "confidence": 0.5, "evidence_ids": [f"e{k}"]}})
        out.append({"kind": "compilation_decided", "body": {"proposal_of": b, "decision": "reject" if k % 7 == 0 else "approve"}})
        if k % 3 == 0:
            out.append({"kind": "correction_recorded", "body": {"target_layer": "belief", "target_id": f"bel_{(k * 5) % 40}", "op": ("edit", "pin", "retract")[k % 9 // 3], "body": f"edit {k}", "hard": k % 2 == 0}})
        if k % 11 == 0:
            out.append({"kind": "tombstone_recorded", "body": {"target": f"bel_{(k * 3) % 40}", "mode": "hide"}})
    return [e | {"ts": f"2024-01-01T00:00:{i % 60:02d}", "writer": "w"} for i, e in enumerate(out)]


def frame(spark, rows):
    names = [c.split(" ")[0] for c in LOG.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], LOG)


def contents(df):
    return sorted(map(str, (tuple(r) for r in df.select(sorted(df.columns)).collect())))


@pytest.fixture
def root(tmp_path):
    return f"{tmp_path}/store-{uuid.uuid4().hex}"


def test_folds_on_to_the_same_beliefs(spark, root, monkeypatch):
    monkeypatch.setattr(history, "MERGE_AFTER", 2)
    rows = log.append((0, None), events(90))
    # a decision whose proposal stands in an earlier batch
    late = next(r for r in rows if r["kind"] == "compilation_proposed")
    store = BeliefStore(spark, root, buckets=8)
    assert store.advance(frame(spark, rows[:60])) == "rebuilt"
    cuts = [60, 61, 90, 150, len(rows)]
    for upto in cuts[1:]:
        whole = frame(spark, rows[:upto])
        assert store.advance(whole) == "advanced"
        assert contents(store.beliefs()) == contents(fold(whole))
    assert store.advance(frame(spark, rows)) == "unchanged"
    more = log.append((rows[-1]["event_seq"], rows[-1]["event_hash"]), [{"kind": "compilation_decided", "body": {"proposal_event_id": late["id"], "decision": "approve"}, "ts": "2024-02-01T00:00:00", "writer": "w"}])
    whole = frame(spark, rows + more)
    assert store.advance(whole) == "advanced"
    assert contents(store.beliefs()) == contents(fold(whole))
    assert store.of(["bel_0"]).first()["approved_event_id"] == more[0]["id"]


def test_broken_hash_rebuilds(spark, root):
    rows = log.append((0, None), events(20))
    store = BeliefStore(spark, root, buckets=4)
    store.advance(frame(spark, rows))
    changed = log.append((0, None), events(20, start=1) + events(4, start=50))
    assert store.advance(frame(spark, changed)) == "rebuilt"
    assert contents(store.beliefs()) == contents(fold(frame(spark, changed)))
    more = log.append((changed[-1]["event_seq"], "not the hash before"), events(3, start=60))
    assert store.advance(frame(spark, changed + more)) == "rebuilt"


def test_only_touched_buckets_are_read(spark, root):
    rows = log.append((0, None), events(80))
    store = BeliefStore(spark, root, buckets=16)
    store.advance(frame(spark, rows))
    before = store.store.current()
    more = log.append((rows[-1]["event_seq"], rows[-1]["event_hash"]), [{"kind": "correction_recorded", "body": {"target_layer": "belief", "target_id": "bel_5", "op": "edit", "body": "new"}, "ts": "2024-02-01T00:00:00", "writer": "w"}])
    assert store.advance(frame(spark, rows + more)) == "advanced"
    after = store.store.current()
    (bucket,) = after["beliefs"][-1]["buckets"]
    assert before["beliefs"][0]["path"] == after["beliefs"][0]["path"] and bucket not in after["beliefs"][0]["buckets"]
    plan = store.history([bucket])._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(bucket" in plan and f"= {bucket})" in plan
    files = store.history([bucket]).select(F.input_file_name().alias("f")).distinct().collect()
    assert all(f"/bucket={bucket}/" in r["f"] for r in files)
    assert store.of(["bel_5"]).first()["body"] == "new"


def test_stream_step_is_idempotent(spark, root, tmp_path):
    rows = log.append((0, None), events(40))
    store = BeliefStore(spark, root, buckets=4)
    store.advance(frame(spark, rows[:20]))
    source = f"{tmp_path}/in"
    frame(spark, rows[20:40]).coalesce(1).write.parquet(f"{source}/a")
    frame(spark, rows[40:]).coalesce(1).write.parquet(f"{source}/b")
    batch = spark.read.schema(LOG).parquet(f"{source}/a")
    store.step(batch, 0)
    version = store.store.current()["version"]
    store.step(batch, 0)
    assert store.store.current()["version"] == version
    stream = spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(source)
    query = stream.writeStream.foreachBatch(lambda df, i: store.step(df.orderBy("event_seq"), i)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert contents(store.beliefs()) == contents(fold(frame(spark, rows)))
    with pytest.raises(ValueError, match="chain"):
        store.step(frame(spark, log.append((rows[-1]["event_seq"], "wrong"), events(1))), 9)


def test_versions_are_published_once_and_swept(spark, root):
    store = Store(spark, root)
    assert store.current() is None
    path = store.stage(spark.range(5), "numbers")
    first = store.publish({"data": path}, None)
    lost = store.stage(spark.range(6), "numbers")
    with pytest.raises(Conflict):
        store.publish({"data": lost}, None)
    assert store.current() == {"data": path, "version": 1} == first
    assert store.sweep() == 1
    assert store.read(path, "id long").count() == 5
