"""One pass to many tables: result envelopes become evidence, metrics, lessons, tripwires and family scores.

A batch is staged once and read once for each table. Rows are keyed by the content of what they say, only keys that a table does
not have are added, and all tables are shown by one manifest together with the batch's number: a batch that comes again, as
the same batch or among others, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrain.functions.ids import stable_id
from evergrain.operators.ops import family_summary
from evergrain.sources.store import Store

EVIDENCE = "evidence_id string, loop_id string, run_id string, item_id string, claim string, source_uri string, verifier_status string"
METRICS = "metric_id string, loop_id string, run_id string, item_id string, metric_name string, direction string, baseline double, result double, passed boolean"
LESSONS = "lesson_id string, loop_id string, target string, body string, decision string"
TRIPWIRES = "tripwire_id string, loop_id string, run_id string, item_id string, kind string, message string"
RESULTS = "result_id string, loop_id string, experiment_family string, decision string, failure_class string, forced boolean, direction string, passed boolean, delta_value string, guardrail_failures long"
TABLES = {"evidence": EVIDENCE, "metrics": METRICS, "lessons": LESSONS, "tripwires": TRIPWIRES, "results": RESULTS}
#: As many folders of a table are read together before they are merged.
MERGE_AFTER = 16
#: Envelopes of a batch whose rows of a table are sorted in a task.
PART_ROWS = 100_000


def rows_of(envelopes: DataFrame) -> dict[str, DataFrame]:
    """The rows of each table, by key. envelopes: path, data (an envelope), errors (what is wrong with it, none where it is valid)."""
    flat = envelopes.select("path", "errors", "data.*")
    ids = [F.col(c) for c in ("loop_id", "run_id", "item_id")]
    valid = flat.where("size(errors) = 0")
    names = ("loop_id", "run_id", "item_id")
    claim = F.concat(F.col("item_id"), F.lit(" "), F.coalesce("decision", F.lit("unknown")), F.lit(" "), F.coalesce("eval.metric_name", F.lit("")), F.lit("="), F.coalesce("eval.result_value", F.lit("")))
    evidence = valid.select(stable_id("evd", *ids, claim).alias("evidence_id"), *names, claim.alias("claim"), F.col("path").alias("source_uri"), F.when(F.col("verifier.passed"), "passed").otherwise("failed").alias("verifier_status"))
    number = lambda c: F.col(c).try_cast("double")
    metric = valid.where("eval.metric_name is not null")
    metrics = metric.select(stable_id("met", *ids, F.col("eval.metric_name")).alias("metric_id"), *names, F.col("eval.metric_name").alias("metric_name"), F.col("eval.direction").alias("direction"), number("eval.baseline_value").alias("baseline"), number("eval.result_value").alias("result"), F.col("eval.passed").alias("passed"))
    lesson = valid.select("loop_id", "decision", F.explode("lesson_candidates").alias("l"))
    lessons = lesson.select(stable_id("les", F.col("loop_id"), F.col("l.target"), F.col("l.body")).alias("lesson_id"), "loop_id", F.col("l.target").alias("target"), F.col("l.body").alias("body"), "decision")
    # an invalid envelope leaves a tripwire for each fault of verification, a valid one for each guardrail that failed
    faults = flat.where("size(errors) > 0").select(*names, F.explode("errors").alias("kind")).where("kind in ('kept_without_verifier', 'kept_without_eval')").select(*names, "kind", F.concat(F.lit("Loop item "), "item_id", F.lit(" is kept unverified")).alias("message"))
    guards = valid.select(*names, F.explode("guardrails").alias("g")).where("not g.passed").select(*names, F.lit("guardrail_failed").alias("kind"), F.concat(F.lit("Loop item "), "item_id", F.lit(" failed "), "g.name").alias("message"))
    wires = faults.unionByName(guards)
    tripwires = wires.select(stable_id("trip", *ids, F.col("kind"), F.col("message")).alias("tripwire_id"), *names, "kind", "message")
    results = valid.select(
        stable_id("res", *ids).alias("result_id"), "loop_id", "experiment_family", "decision", "failure_class", F.coalesce("forced_exploration", F.lit(False)).alias("forced"), F.col("eval.direction").alias("direction"),
        F.col("eval.passed").alias("passed"), F.col("eval.delta_value").alias("delta_value"), F.size(F.filter(F.coalesce("guardrails", F.array().cast("array<struct<name:string,passed:boolean>>")), lambda g: ~g["passed"])).cast("long").alias("guardrail_failures"),
    )
    return {"evidence": evidence, "metrics": metrics, "lessons": lessons, "tripwires": tripwires, "results": results}


class LoopTables:
    """The tables of loop results below a folder, filled by batches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def table(self, name: str) -> DataFrame:
        paths = ((self.store.current() or {}).get("tables") or {}).get(name, [])
        return self._read(name, paths)

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(TABLES[name])
        return reader.parquet(*[f"{self.store.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], TABLES[name])

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """A foreachBatch step; batch: path, data, errors (files.result_envelopes)."""
        now = self.store.current()
        if now is not None and batch_id <= now["batch"]:
            return
        staged = batch.select("path", "data", "errors")
        staged = self.store.read(self.store.stage(staged, "batch"), staged.schema)
        tables = (now or {}).get("tables") or {}
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-staged.count() // PART_ROWS))
        for name, rows in rows_of(staged).items():
            key = TABLES[name].split(" ")[0]
            # dealt by key before they are sorted, so a task sorts its part only
            once = rows.repartition(parts, key).groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("r")).select(key, "r.*")
            paths = tables.get(name, [])
            new = once.join(self._read(name, paths).select(key), key, "left_anti").select([c.split(" ")[0] for c in TABLES[name].split(", ")])
            tables = tables | {name: paths + [self.store.stage(new, name)]}
            if len(tables[name]) > MERGE_AFTER:
                tables = tables | {name: [self.store.stage(self._read(name, tables[name]), name)]}
        self.store.publish({"batch": batch_id, "tables": tables}, now)

    def families(self) -> DataFrame:
        """Family scores of each loop over all results so far."""
        keyed = self.table("results").withColumn("experiment_family", F.concat_ws("\x1f", "loop_id", F.coalesce(F.when(F.col("experiment_family") != "", F.col("experiment_family")), F.lit("unknown"))))
        found = family_summary(keyed)
        return found.withColumn("loop_id", F.split("family", "\x1f")[0]).withColumn("family", F.split("family", "\x1f")[1])
