"""The kept index against bm25() on the same documents, before and after changes."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from evergrain.operators import index as I
from evergrain.operators import retrieval

DOCS = "doc_id long, title string, body string, open boolean"
FIELDS = {"title": 5.0, "body": 1.0}


def make(ids, seed):
    rnd = random.Random(seed)
    words = [f"w{min(int(rnd.paretovariate(0.6)), 400)}" for _ in range(4000)]
    return [(d, rnd.choice(words), None if d % 41 == 0 else " ".join(rnd.choices(words, k=rnd.randrange(0, 60))), d % 3 != 0) for d in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture
def queries(spark):
    rnd = random.Random(4)
    return spark.createDataFrame([(q, " ".join(f"w{min(int(rnd.paretovariate(0.6)), 420)}" for _ in range(1 + q % 6))) for q in range(25)] + [(99, "nothing here"), (98, "")], "query_id long, query string")


def best(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())


def plain(spark, rows, queries, k, gate=None):
    docs = frame(spark, rows)
    found = retrieval.bm25(docs, queries, FIELDS, "doc_id", gate).withColumn("score", F.round("score", 6))
    return best(retrieval.top(found, k, F.desc("score"), F.asc("doc_id")))


@pytest.mark.parametrize(("block", "k", "gated"), [(4, 3, False), (4, 1, True), (128, 10, False)])
def test_equals_bm25(spark, tmp_path, queries, monkeypatch, block, k, gated):
    monkeypatch.setattr(I, "BLOCK", block)
    monkeypatch.setattr(I, "SHARD_DOCS", 80)
    monkeypatch.setattr(I, "SLICE_QUERIES", 10)
    rows = make(range(300), 1)
    kept = I.SearchIndex(spark, f"{tmp_path}/i{uuid.uuid4().hex}", FIELDS, keep=("open",), buckets=8)
    kept.build(frame(spark, rows))
    gate = F.col("open") if gated else None
    assert best(kept.search(queries, k, gate, digits=6)) == plain(spark, rows, queries, k, gate)


def test_changes_and_merges(spark, tmp_path, queries, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 4)
    monkeypatch.setattr(I, "MERGE_AFTER", 2)
    rows = {r[0]: r for r in make(range(150), 1)}
    kept = I.SearchIndex(spark, f"{tmp_path}/i", FIELDS, keep=("open",), buckets=4)
    kept.build(frame(spark, list(rows.values())), source="a")
    for n, (ids, gone) in enumerate([(range(140, 170), [3, 5, 1000]), (range(145, 150), [])]):
        new = make(ids, 10 + n)
        rows |= {r[0]: r for r in new}
        rows = {d: r for d, r in rows.items() if d not in gone}
        made = kept.update(frame(spark, new), spark.createDataFrame([(d,) for d in gone], "doc_id long"))
        assert made["n_docs"] == len(rows) and made["source"] == "a"
        assert best(kept.search(queries, 4, digits=6)) == plain(spark, list(rows.values()), queries, 4)
    assert len(made["segments"]) == 1


def test_a_query_reads_its_terms_buckets_only(spark, tmp_path):
    kept = I.SearchIndex(spark, f"{tmp_path}/i", FIELDS, keep=("open",), buckets=16)
    kept.build(frame(spark, make(range(60), 1)))
    asked = spark.createDataFrame([(1, "w1")], "query_id long, query string")
    plan = kept.search(asked, 3)._jdf.queryExecution().executedPlan().toString()
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("w1")), F.lit(16))).first()[0]
    assert f"= {bucket})" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    files = kept.blocks(kept.store.current(), [bucket]).select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all(f"/bucket={bucket}/" in r["f"] for r in files)


def test_empty(spark, tmp_path, queries):
    kept = I.SearchIndex(spark, f"{tmp_path}/i", FIELDS, buckets=2)
    kept.build(frame(spark, []))
    assert kept.search(queries, 3).count() == 0


def shuffled_rows(spark, act):
    """Rows that the stages of act() write for other tasks."""

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = written()
    act()
    return sum(n for k, n in written().items() if k not in before)


def test_texts_move_and_not_their_postings(spark, tmp_path):
    kept = I.SearchIndex(spark, f"{tmp_path}/i", FIELDS, keep=("open",), buckets=4)
    docs = frame(spark, make(range(2000), 1)).cache()
    n_postings = docs.count() * 10
    # each document goes to its shard once; the other rows are counts of tasks
    assert shuffled_rows(spark, lambda: kept.build(docs)) < 2000 + 100 < n_postings
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for ids in (range(10), range(5, 15)):  # the second one with marks of the first
        changed = frame(spark, make(ids, 2)).cache()
        changed.count()
        # documents that the change does not name stay where they are
        assert shuffled_rows(spark, lambda rows=changed: kept.update(rows)) < 1000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_rows_of_wanted_keys(spark):
    rows = spark.createDataFrame([(k, str(k)) for k in range(5000)] + [(None, "none")], "doc long, word string").repartition(3)
    for key, wanted in (("doc", [7, 63, 64, 4999, -1, None]), ("word", ["7", "63", "64", "4999", "other", None])):
        found = I._sifted(rows, key, spark.createDataFrame([(w,) for w in wanted], rows.select(key).schema))
        assert found.columns == ["doc", "word"] and {7, 63, 64, 4999} <= (got := {r["doc"] for r in found.collect()}) and len(got) < 10


def test_chunks_and_tasks(spark, tmp_path, queries, monkeypatch):
    """Terms whose blocks come from several chunks and tasks, in a build, in changes of few and many shards, and in a merge."""
    for name, n in (("BLOCK", 4), ("CHUNK_BYTES", 800), ("CHUNK_POSTINGS", 200), ("STEP", 7), ("SHARD_DOCS", 60), ("TASK_DOCS", 40), ("LEAST_TASK_DOCS", 20), ("MERGE_AFTER", 3)):
        monkeypatch.setattr(I, name, n)
    rows = {r[0]: r for r in make(range(300), 1)}
    kept = I.SearchIndex(spark, f"{tmp_path}/i", FIELDS, keep=("open",), buckets=4)
    kept.build(frame(spark, list(rows.values())))
    for n, ids in enumerate([range(3), range(1, 200), range(250, 260)]):
        new = make(ids, 20 + n)
        rows |= {r[0]: r for r in new}
        made = kept.update(frame(spark, new))
        assert best(kept.search(queries, 5, digits=6)) == plain(spark, list(rows.values()), queries, 5)
    assert len(made["segments"]) == 1 and made["shards"] == 5
