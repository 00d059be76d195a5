"""Rows that come back when they change, over restarts of a stream, and runs that end early."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evergrain.streaming.reentry import Watermarks, reentering

SCHEMA = "stream string, id string, updated_at timestamp, note string"
START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def put(spark, folder, name, rows):
    spark.createDataFrame([(s, i, at(m), n) for s, i, m, n in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, source, out, checkpoint, **options):
    rows = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(source)
    found = reentering(rows, ["stream", "id"], "updated_at", **options)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(180)
    return sorted((r["stream"], r["id"], r["updated_at"], r["note"]) for r in spark.read.schema(SCHEMA).parquet(out).collect())


def test_changed_rows_come_back(spark, tmp_path):
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    put(spark, source, "a", [("k", "1", 0, "first"), ("k", "2", 1, "only"), ("x", "1", 5, "other stream"), ("k", "2", 1, "only")])
    first = run(spark, source, out, checkpoint)
    assert first == [("k", "1", at(0), "first"), ("k", "2", at(1), "only"), ("x", "1", at(5), "other stream")]
    put(spark, source, "b", [("k", "1", 7, "changed"), ("k", "2", 1, "only"), ("k", "3", 2, "older"), ("k", "3", 3, "newer")])
    put(spark, source, "c", [("k", "1", 6, "late and older"), ("x", "1", 5, "repeated")])
    second = run(spark, source, out, checkpoint)
    assert sorted(set(second) - set(first)) == [("k", "1", at(7), "changed"), ("k", "3", at(3), "newer")] and len(second) == 5


def test_rows_settle(spark, tmp_path):
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    put(spark, source, "a", [("k", "1", 0, "draft"), ("k", "2", 0, "quiet")])
    put(spark, source, "b", [("k", "1", 5, "final"), ("k", "9", 60, "moves the clock")])
    run(spark, source, out, checkpoint, settle="10 minutes", late="1 minute")
    put(spark, source, "c", [("k", "9", 200, "moves the clock on")])
    put(spark, source, "d", [("k", "8", 201, "last")])
    got = run(spark, source, out, checkpoint, settle="10 minutes", late="1 minute")
    assert [r for r in got if r[1] in ("1", "2")] == [("k", "1", at(5), "final"), ("k", "2", at(0), "quiet")]
    assert "draft" not in {r[3] for r in got}


def test_a_run_that_ends_early_advances_past_what_it_did(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{k // 4:02d}", f"id{k:02d}") for k in range(20)], "updated_at string, id string")
    marks, seen = Watermarks(spark, f"{tmp_path}/marks"), []
    for most, done in ((6, 6), (6, 3), (6, 0), (50, 50)):
        part = marks.next_slice(rows, "tripwires", "updated_at", "id", most)
        handled = part.orderBy("updated_at", "id").limit(done)
        seen += [r["id"] for r in handled.collect()]
        marks.commit(handled, handled.select("id", F.lit(True).alias("ok")), "tripwires", "updated_at", "id")
    assert sorted(seen) == [f"id{k:02d}" for k in range(20)]
    assert sorted(r["id"] for r in marks.outcomes("tripwires", spark.createDataFrame([], "id string, ok boolean").schema).collect()) == sorted(seen)
    changed = rows.withColumn("updated_at", F.when(F.col("id") == "id03", "t99").otherwise(F.col("updated_at")))
    assert [r["id"] for r in marks.next_slice(changed, "tripwires", "updated_at", "id", 5).collect()] == ["id03"]
