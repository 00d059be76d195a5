"""Files as evidence: memory notes, history windows, result envelopes, bundles, manifests; and the sinks that mirror them."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrain.functions import text as T
from evergrain.functions.ids import content_hash, stable_id

#: File names that hold credentials.
SENSITIVE = r"(?i)(^|/)(\.env[^/]*|id_(rsa|ed25519|ecdsa)[^/]*|[^/]*\.(pem|key|p12|pfx)|credentials[^/]*|\.netrc|\.npmrc)$"
BUNDLE_KEYS = ("schema", "exported_at", "items", "payload_sha256")
ITEM_KEYS = ("body", "evidence_id", "kind", "scope", "sha256", "ts")
MAX_ITEMS, MAX_BYTES = 10_000, 20_000_000


def note_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".md", ".txt"), max_bytes: int = 32_000) -> DataFrame:
    """Text files below root, without hidden and sensitive ones: path, title, redacted body of the first max_bytes bytes, content hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.col("path")
    wanted = path.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    files = files.where(wanted & ~path.rlike(r"/\.[^/]+(/|$)") & ~path.rlike(SENSITIVE)).dropDuplicates(["path"])
    # the cut is made on redacted text, so no secret is left in two halves; an unfinished last character is dropped
    whole = T.redact_secrets(F.decode("content", "UTF-8"))
    head = F.regexp_replace(F.decode(F.substring(F.encode(whole, "UTF-8"), 1, max_bytes), "UTF-8"), "�+$", "")
    rows = files.select("path", F.col("length").alias("n_bytes"), head.alias("body"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return rows.select("path", T.title_of(F.col("body"), name).alias("title"), "body", content_hash(F.col("body")).alias("content_hash"), "n_bytes")


def history_window(text: Column, most: int) -> Column:
    """Head and tail of a text in `most` bytes, with a mark for what is left out."""
    raw = F.encode(text, "UTF-8")
    n, half = F.octet_length(raw), most // 2
    cut = F.concat(F.decode(F.substring(raw, 1, half), "UTF-8"), F.lit("\n[... "), (n - 2 * half).cast("string"), F.lit(" bytes omitted ...]\n"), F.decode(F.substring(raw, -half, half), "UTF-8"))
    return F.when(n <= most, text).otherwise(F.regexp_replace(cut, "�", ""))


def dry_run(files: DataFrame) -> DataFrame:
    """path, names of leaks on any line, and whether any stays after redaction. files: path, body."""
    lines = files.select("path", F.explode(F.split("body", "\n")).alias("line")).withColumn("leaks", T.secret_leaks(F.col("line"))).withColumn("left", T.secret_leaks(T.redact_secrets(F.col("line"))))
    return lines.groupBy("path").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("leaks")))).alias("leaks"), (F.max(F.size("left")) > 0).alias("residue"))


def changed_sources(files: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Files whose content the current beliefs do not have; beliefs: source_path, content_hash."""
    return files.join(beliefs.select(F.col("source_path").alias("path"), "content_hash"), ["path", "content_hash"], "left_anti")


def import_events(files: DataFrame) -> DataFrame:
    """The three events of each import (evidence, proposal, approval) as unsequenced rows: path, step, kind, body_json.

    The approval names its proposal by belief (proposal_of), since a proposal has no id before it stands in the log; log.append()
    puts the id there.
    """
    evidence_id, belief_id = stable_id("evd", F.col("body")), stable_id("bel", F.col("path"))
    body = lambda *cols: F.to_json(F.struct(*cols))
    made = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("evidence_recorded").alias("kind"), body(F.col("body"), evidence_id.alias("evidence_id"), F.lit("file").alias("kind")).alias("body_json")),
        F.struct(F.lit(1).alias("step"), F.lit("compilation_proposed").alias("kind"), body(belief_id.alias("belief_id"), F.col("body"), F.array(evidence_id).alias("evidence_ids")).alias("body_json")),
        F.struct(F.lit(2).alias("step"), F.lit("compilation_decided").alias("kind"), body(belief_id.alias("proposal_of"), F.lit("approve").alias("decision")).alias("body_json")),
    )
    return files.select("path", F.explode(made).alias("e")).select("path", "e.*")


ENVELOPE = (
    "schema_version string, loop_id string, run_id string, item_id string, decision string, failure_class string, experiment_family string, forced_exploration boolean, "
    "eval struct<metric_name: string, direction: string, baseline_value: string, result_value: string, delta_value: string, passed: boolean, command: string>, "
    "verifier struct<command: string, passed: boolean, evidence_uri: string>, lesson_candidates array<struct<target: string, body: string>>, "
    "artifact_uris array<string>, guardrails array<struct<name: string, passed: boolean>>"
)
DECISIONS = ("kept", "reverted", "failed", "needs_review", "skipped")
DIRECTIONS = ("higher_is_better", "lower_is_better", "target", "boolean")


def result_envelopes(spark: SparkSession, root: str) -> DataFrame:
    """One row for each result.json below root, with the list of what is wrong with it."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "result.json").text(root)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", ENVELOPE).alias("data"))
    missing = [F.when(F.col(f"data.{c}").isNull(), F.lit(f"missing:{c}")) for c in ("schema_version", "loop_id", "run_id", "item_id", "eval", "verifier")]
    wrong = [
        F.when(~F.col("data.decision").isin(*DECISIONS), F.lit("bad_decision")),
        F.when(~F.col("data.eval.direction").isin(*DIRECTIONS), F.lit("bad_direction")),
        F.when((F.col("data.decision") == "kept") & ~F.coalesce("data.verifier.passed", F.lit(False)), F.lit("kept_without_verifier")),
        F.when((F.col("data.decision") == "kept") & ~F.coalesce("data.eval.passed", F.lit(False)), F.lit("kept_without_eval")),
        F.when((F.col("data.decision") == "failed") & F.col("data.failure_class").isNull(), F.lit("failed_without_class")),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*missing, *wrong)))


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines: curation, calibration, ratings, benchmark cases. A broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def state_records(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A state file (a list, a mapping by id, or either under one key) as rows. State files are small and read by the driver."""
    data = json.loads(text)
    if isinstance(data, dict) and len(data) == 1 and isinstance(next(iter(data.values())), (list, dict)):
        data = next(iter(data.values()))
    rows = data if isinstance(data, list) else [{"id": k} | v for k, v in data.items() if isinstance(v, dict)]
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows if isinstance(r, dict)]))


def export_bundle(evidence: DataFrame, ids: list[str], exported_at: str) -> str:
    """A bundle of explicitly named evidence that may be exported; any refusal refuses all. Bounded by MAX_ITEMS."""
    if len(ids) > MAX_ITEMS:
        raise ValueError("too many items")
    rows = evidence.where(F.col("evidence_id").isin(*ids)).collect()  # at most MAX_ITEMS rows, each named by the caller
    refused = sorted(set(ids) - {r["evidence_id"] for r in rows} | {r["evidence_id"] for r in rows if r["egress_policy"] not in ("hosted_ok", "approval_required") or r["visibility"] in ("confidential", "secret")})
    if refused:
        raise PermissionError(f"refused: {', '.join(refused)}")
    items = [{"evidence_id": r["evidence_id"], "kind": r["evidence_kind"], "body": r["body"], "ts": r["recorded_at"], "scope": r["scope_id"], "sha256": hashlib.sha256(r["body"].encode()).hexdigest()} for r in sorted(rows, key=lambda r: r["evidence_id"])]
    payload = json.dumps(items, sort_keys=True, separators=(",", ":"))
    return json.dumps({"schema": 1, "exported_at": exported_at, "items": items, "payload_sha256": hashlib.sha256(payload.encode()).hexdigest()}, sort_keys=True)


def load_bundle(text: str) -> list[dict]:
    """Items of a bundle: exact keys, no repeated keys, matching hashes, bounded size."""
    if len(text.encode()) > MAX_BYTES:
        raise ValueError("bundle too large")

    def once(pairs):
        names = [k for k, _ in pairs]
        if len(names) != len(set(names)):
            raise ValueError("repeated key")
        return dict(pairs)

    data = json.loads(text, object_pairs_hook=once)
    if sorted(data) != sorted(BUNDLE_KEYS) or any(sorted(i) != sorted(ITEM_KEYS) for i in data["items"]) or len(data["items"]) > MAX_ITEMS:
        raise ValueError("unexpected keys or too many items")
    payload = json.dumps(data["items"], sort_keys=True, separators=(",", ":"))
    if hashlib.sha256(payload.encode()).hexdigest() != data["payload_sha256"] or any(hashlib.sha256(i["body"].encode()).hexdigest() != i["sha256"] for i in data["items"]):
        raise ValueError("hash mismatch")
    return data["items"]


def import_bundle(spark: SparkSession, items: list[dict], log: DataFrame) -> DataFrame:
    """Items that neither repeat inside the bundle nor stand in the log: evidence_id, body, kind, ts."""
    rows = spark.createDataFrame([(i["evidence_id"], i["body"], i["kind"], i["ts"]) for i in items], "evidence_id string, body string, kind string, ts string").dropDuplicates(["evidence_id"])
    known = log.where("kind = 'evidence_recorded'").select(F.get_json_object("body_json", "$.evidence_id").alias("evidence_id"))
    return rows.join(known, "evidence_id", "left_anti")


def verify_manifest(spark: SparkSession, manifest: dict) -> None:
    """Every source of a curated manifest has the SHA-256 that it states, or nothing is applied."""
    for source in manifest["sources"]:
        rows = spark.read.format("binaryFile").load(source["path"]).select(F.sha2("content", 256).alias("h")).collect()
        if [r["h"] for r in rows] != [source["sha256"]]:
            raise ValueError(f"source changed: {source['path']}")


def write_jsonl(examples: DataFrame, path: str, column: str = "example_json") -> None:
    """Lines in the order of the frame, which is globally sorted, in as many files as it has partitions; file names keep the order."""
    examples.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def backup(df: DataFrame, path: str) -> dict:
    """A copy with its count and hash, verified after writing."""
    from evergrain.operators.log import table_digest

    want = table_digest(df).first().asDict()
    df.write.mode("errorifexists").parquet(path)
    got = table_digest(df.sparkSession.read.schema(df.schema).parquet(path)).first().asDict()
    if got != want:
        raise OSError(f"copy differs: {want} {got}")
    return want


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """current with changes applied: the last change of a key wins; columns in `keep` stay at the old value where the new one is null."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), order).alias("new"))
    joined = current.join(last, key, "full_outer")
    cols = [F.col(key)]
    for c in current.columns:
        if c != key:
            new = F.col(f"new.{c}")
            cols.append((F.coalesce(new, c) if c in keep else F.when(F.col("new").isNotNull(), new).otherwise(F.col(c))).alias(c))
    return joined.select(*cols)


#: Files of a repository that are read as documents, how many, and how many bytes of each.
REPO_FILES = ("README.md", "CHANGELOG.md", "NOTICE", "LICENSE")
REPO_DOCUMENTS, REPO_BYTES = 1000, 512_000


def repo_documents(spark: SparkSession, root: str, code: str = "src") -> DataFrame:
    """path, text, content_hash of a repository's documents: its head files, the Markdown below docs, the Python files below `code`.

    The first 1,000 by path, and of each the first 512,000 bytes.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace("path", "^.*?" + re.escape(base.removeprefix("file:")), "")
    wanted = relative.isin(*REPO_FILES) | (relative.startswith("docs/") & relative.endswith(".md")) | (relative.startswith(code + "/") & relative.endswith(".py"))
    head = raw.select(relative.alias("path"), "content").where(wanted).orderBy("path").limit(REPO_DOCUMENTS)
    text = F.decode(F.substring("content", 1, REPO_BYTES), "UTF-8")
    return head.select("path", text.alias("text")).withColumn("content_hash", F.sha2(F.encode("text", "UTF-8"), 256))
