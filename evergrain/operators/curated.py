"""Curated facts: checked as one, applied as one. A manifest with one bad fact or changed source changes nothing.

Sources are read and hashed by Spark in one job, facts are judged in one plan, and what is applied is staged and then shown by
one rename. Facts that stand as they are already are left unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrain.sources.store import Store

#: The schema's name in attributes, and what a fact takes where it says nothing.
MANIFEST_SCHEMA = "curated-memory.v1"
CONFIDENCE, SOURCE_QUALITY, LIFECYCLE = 0.9, 0.95, "durable"
FACTS = (
    "belief_id string, body string, confidence double, visibility string, egress_policy string, title string, source_quality double, lifecycle string, "
    "attestations array<struct<ref:string,sha256:string>>, content_sha256 string, curation_sha256 string, status string"
)
#: Sources that one manifest may name; more are an error.
MAX_SOURCES = 10_000


class Rejected(ValueError):
    """The manifest may not be applied; carries what is wrong, a few of each kind."""


def source_verdicts(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """ref, verdict (ok, changed, missing, duplicate_ref) of the sources (ref, path, sha256) that a manifest names."""
    named = sources.select("ref", "path", "sha256").collect() if sources.count() <= MAX_SOURCES else None
    if named is None:
        raise ValueError(f"a manifest may name {MAX_SOURCES} sources")
    held = []
    for path in {r["path"] for r in named}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            held.append(path)
    found = spark.createDataFrame([], "path string, found string")
    if held:
        found = spark.read.format("binaryFile").load(held).select(F.col("path"), F.sha2("content", 256).alias("found"))
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    joined = sources.select("ref", bare(F.col("path")).alias("path"), "sha256").join(found.select(bare(F.col("path")).alias("path"), "found"), "path", "left")
    return joined.groupBy("ref").agg(
        F.when(F.count(F.lit(1)) > 1, "duplicate_ref").when(F.first("found").isNull(), "missing").when(F.first("found") != F.first("sha256"), "changed").otherwise("ok").alias("verdict"), F.first("sha256").alias("sha256")
    )


def fact_verdicts(facts: DataFrame, sources: DataFrame, allow_hosted: bool = False) -> DataFrame:
    """id, verdicts: what is wrong with each fact, in a fixed order; an empty list where nothing is.

    facts: id, body, source_refs (array), visibility, egress_policy and what prepared() takes; sources: ref, verdict.
    """
    known = sources.where("verdict = 'ok'").select("ref").distinct()
    refs = facts.select("id", F.explode("source_refs").alias("ref")).join(known, "ref", "left_anti").groupBy("id").agg(F.lit(True).alias("unknown"))
    times = facts.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    rows = facts.join(times, facts["id"].eqNullSafe(times["id"])).drop(times["id"]).join(refs, "id", "left")
    hosted = F.coalesce(F.col("egress_policy") == "hosted_ok", F.lit(False))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    checks = (
        ("no_id", blank("id")), ("no_body", blank("body")), ("duplicate_id", F.col("times") > 1),
        ("no_source", F.coalesce(F.size("source_refs"), F.lit(0)) <= 0), ("unknown_source", F.coalesce("unknown", F.lit(False))),
        ("hosted_but_closed", hosted & F.coalesce(F.col("visibility").isin("confidential", "secret"), F.lit(False))),
        ("hosted_not_acknowledged", hosted & F.lit(not allow_hosted)),
    )
    return rows.select("id", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks])).alias("verdicts"))


def prepared(facts: DataFrame, sources: DataFrame, project: str) -> DataFrame:
    """Facts as rows of the curated table, each with the hash of all that it says."""
    shas = facts.select("id", F.posexplode("source_refs").alias("nth", "ref")).join(sources.select("ref", "sha256"), "ref").groupBy("id")
    shas = shas.agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "ref", "sha256"))), lambda x: F.struct(x["ref"].alias("ref"), x["sha256"].alias("sha256"))).alias("attestations"))
    given = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in facts.columns else F.lit(default)
    rows = facts.join(shas, "id").select(
        F.concat(F.lit(f"curated:{project}:"), "id").alias("belief_id"), "body", given("confidence", CONFIDENCE).cast("double").alias("confidence"), given("visibility", "internal").alias("visibility"),
        given("egress_policy", "local_only").alias("egress_policy"), (F.coalesce("title", "id") if "title" in facts.columns else F.col("id")).alias("title"),
        given("source_quality", SOURCE_QUALITY).cast("double").alias("source_quality"), given("lifecycle", LIFECYCLE).alias("lifecycle"), "attestations", F.sha2("body", 256).alias("content_sha256"),
    )
    return rows.withColumn("curation_sha256", F.sha2(F.to_json(F.struct(*rows.columns)), 256)).withColumn("status", F.lit("current"))


class CuratedFacts:
    """The table of curated facts of a project below a folder."""

    def __init__(self, spark: SparkSession, root: str, project: str):
        self.spark, self.store, self.project = spark, Store(spark, root), project

    def current(self) -> DataFrame:
        m = self.store.current()
        return self.spark.createDataFrame([], FACTS) if m is None else self.store.read(m["facts"], FACTS)

    def apply(self, facts: DataFrame, sources: DataFrame, allow_hosted: bool = False) -> DataFrame:
        """belief_id, state (applied, unchanged) of the manifest's facts, after all of them stand; Rejected, and nothing changed, where one may not."""
        checked = source_verdicts(self.spark, sources)
        bad = checked.where("verdict <> 'ok'").select(F.col("ref").alias("name"), F.array("verdict").alias("why")).unionByName(fact_verdicts(facts, checked, allow_hosted).where("size(verdicts) > 0").select(F.col("id").alias("name"), F.col("verdicts").alias("why")))
        wrong = [f"{r['name']}: {', '.join(r['why'])}" for r in bad.orderBy("name").limit(20).collect()]
        if wrong or facts.isEmpty():
            raise Rejected("; ".join(wrong) or "no facts")
        now = self.store.current()
        new = prepared(facts, checked, self.project)
        old = self.current()
        same = old.where("status = 'current'").select("belief_id", "curation_sha256")
        states = new.join(same, ["belief_id", "curation_sha256"], "left_semi").select("belief_id", F.lit("unchanged").alias("state")).unionByName(new.join(same, ["belief_id", "curation_sha256"], "left_anti").select("belief_id", F.lit("applied").alias("state")))
        stated = self.store.stage(states, "states")
        states = self.store.read(stated, states.schema)
        if not states.where("state = 'applied'").isEmpty():
            whole = old.join(new.select("belief_id"), "belief_id", "left_anti").select(new.columns).unionByName(new)
            self.store.publish({"facts": self.store.stage(whole, "facts"), "states": stated}, now)
        return states
