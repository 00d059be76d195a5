"""Transcript files as turns: format detection, tolerant JSON lines, and one parser for each of three shapes.

Lines are read by Spark's text source with their file path; records are parsed by from_json with a schema, and lines that are blank,
broken or no objects are skipped. Turn numbers follow the order of lines in a file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evergrain.functions import text as T

TURNS = (
    "session_id string, source_uri string, format string, turn_idx long, role string, kind string, text string, ts string, tool_name string, "
    "tool_error boolean, n_tool_calls long, authored_by string, sender_verified boolean"
)
SIDECARS = r"(\.trajectory\.jsonl|\.trajectory-path\.json|app-server\.json)$|(^|/)(sessions\.json|session_index\.jsonl|history\.jsonl)$|\.tmp/"
#: Beginnings of user turns that a runtime wrote, not a person.
INJECTED = (
    "[Boot]", "[Boot Check]", "[Bootstrap]", "[Cron]", "[Cron Tick]", "[Scheduled Task]", "[Compaction]", "[Compaction Flush]", "[Context Compaction]", "[Auto]", "[Automated]",
    "[Reminder]", "Caveat: The messages below", "This session is being continued from a previous", "[Continued Session]", "[Resumed Session]", "System (untrusted):", "<goal_context",
    "<task-notification", "<environment_context", "Pre-compaction memory flush.", "Read HEARTBEAT.md if it exists", "You are running a boot check", "[cron:",
    "Warning: apply_patch was requested", "Warning: The maximum number of unified exec processes", "A scheduled reminder has been triggered", "A new session was started via /new or /reset.",
)
RUNTIME = r"(?is)^\s*(?:warning:\s*you have \d+ weighted tokens left\b|you have \d+ weighted tokens left\b|system:\s*\[[^\]]+\]\s*reminder\b)"
STAMP = r"^\s*\[[A-Z][a-z]{2} \d{4}-\d{2}-\d{2} \d{2}:\d{2}[^\]]*\]\s*"
AUTHOR_MARK = r"(?:Conversation info|Sender) \(untrusted metadata\):"
TOOL_TEXT = 500


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of transcript files below root, without sidecars and indexes: path, length, modified, fingerprint."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    stamp = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return files.select("path", "length", "modificationTime", F.sha2(stamp, 256).alias("fingerprint")).where(~F.col("path").rlike(SIDECARS)).dropDuplicates(["path"])


def unmined(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose fingerprint the ledger does not hold."""
    return files.join(ledger.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_uri, line_no, line of every line that looks like an object."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_uri"), F.col("_metadata.file_block_start").alias("block"))
    # monotonic ids order the lines of a split; splits of a file are ordered by where they begin
    order = F.struct("block", F.monotonically_increasing_id().alias("nth"))
    return raw.where(F.trim("line").startswith("{")).withColumn("line_no", order)


def detect_format(path: Column, first: Column) -> Column:
    """a: session header and messages; b: user/assistant lines; c: response items."""
    kind = F.get_json_object(first, "$.type")
    return F.when(kind == "session", "a").when(kind.isin("session_meta", "response_item"), "c").when(kind.isin("user", "assistant", "summary"), "b").when(path.contains("rollout-"), "c").otherwise("a")


def classify_user(text: Column) -> Column:
    """struct(kind, text): envelope, injected, media or bare; stamps and envelopes are cut off."""
    bare = T.strip(F.regexp_replace(F.coalesce(text, F.lit("")), STAMP, ""))
    message = T.strip(F.regexp_replace(bare, r"(?s)\A.*?(?:(?:Conversation info|Sender) \(untrusted metadata\):|Replied message \(untrusted, for context\):)\s*```json\s*.*?\s*```(?:\s*(?:(?:Conversation info|Sender) \(untrusted metadata\):|Replied message \(untrusted, for context\):)\s*```json\s*.*?\s*```)*", ""))
    low = F.lower(bare)
    injected = F.lit(False)
    for start in INJECTED:
        injected = injected | low.startswith(start.lower())
    made = lambda k, t: F.struct(F.lit(k).alias("kind"), t.alias("text"))
    return (
        F.when(bare.rlike(AUTHOR_MARK) & message.rlike(T.java_pattern(T.MEDIA_ONLY)), made("media", message))
        .when(bare.rlike(AUTHOR_MARK), made("envelope", message))
        .when(injected | bare.rlike(RUNTIME), made("injected", bare))
        .when((bare == "") | bare.rlike(T.java_pattern(T.MEDIA_ONLY)), made("media", bare))
        .otherwise(made("bare", bare))
    )


def _blocks(content: Any) -> tuple[str, int, list[dict]]:
    """Text, number of tool calls and tool results of a message's content (a string or blocks)."""
    if isinstance(content, str):
        return content, 0, []
    texts, calls, results = [], 0, []
    for b in content if isinstance(content, list) else []:
        if not isinstance(b, dict) or b.get("type") in ("thinking", "reasoning", "redacted_thinking"):
            continue
        if b.get("type") in ("tool_use", "toolCall", "function_call"):
            calls += 1
        elif b.get("type") in ("tool_result", "toolResult"):
            results.append(b)
        elif isinstance(b.get("text"), str):
            texts.append(b["text"])
    return "\n".join(texts), calls, results


def _tool_text(block: dict) -> str:
    return _blocks(block.get("content") or block.get("output") or "")[0][:TOOL_TEXT]


def _turn(record: dict, form: str) -> list[dict]:
    """Raw turns of one record."""
    out = []
    if form == "c":
        item = record.get("payload") or {}
        kind = item.get("type") if isinstance(item, dict) else None
        if not isinstance(item, dict) or record.get("type") != "response_item" or kind == "reasoning":
            return out
        if kind in ("function_call_output", "custom_tool_call_output"):
            return [{"role": "tool", "text": str(item.get("output") or "")[:TOOL_TEXT], "error": None, "calls": 0}]
        if kind in ("function_call", "custom_tool_call", "local_shell_call"):
            return [{"role": "assistant", "text": "", "error": None, "calls": 1}]
        text, calls, _ = _blocks(item.get("content"))
        role = item.get("role")
        forced = role in ("developer", "system")
        return [{"role": "user" if forced else role, "text": text, "error": None, "calls": calls, "injected": forced}] if role in ("user", "assistant", "developer", "system") else out
    message = record.get("message") or {}
    if not isinstance(message, dict):
        return out
    if form == "a" and record.get("type") not in ("message", None):
        return out
    role = message.get("role") or (record.get("type") if form == "b" else None)
    text, calls, results = _blocks(message.get("content"))
    for r in results:
        out.append({"role": "tool", "text": _tool_text(r), "error": bool(r.get("is_error")), "calls": 0})
    if role in ("toolResult", "tool"):
        out.append({"role": "tool", "text": text[:TOOL_TEXT], "error": message.get("isError"), "calls": 0, "name": message.get("toolName")})
    elif role in ("user", "assistant", "system") and (text or calls or not results):
        out.append({"role": role, "text": text, "error": None, "calls": calls})
    return out


_RAW = "array<struct<role:string,text:string,name:string,error:boolean,calls:bigint,forced:boolean>>"
_PARSED = f"source_uri string, block long, nth long, kind string, session string, ts string, a {_RAW}, b {_RAW}, c {_RAW}"


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each line by itself: its record's type, the session it may name, and the turns that it is in each of the forms. Lines that are no objects are left out."""
    for f in frames:
        out = []
        for uri, block, nth, line in zip(f["source_uri"], f["block"], f["nth"], f["line"]):
            try:
                record = json.loads(line)
            except ValueError:
                continue
            if not isinstance(record, dict):
                continue
            kind, payload = record.get("type"), record.get("payload")
            session = (record.get("id") if kind == "session" else None) or record.get("sessionId") or (payload.get("id") if kind == "session_meta" and isinstance(payload, dict) else None)
            turns = {form: [(t["role"], t["text"], t.get("name"), None if t["error"] is None else bool(t["error"]), t["calls"], bool(t.get("injected"))) for t in _turn(record, form)] for form in "abc"}
            stamp = record.get("timestamp")
            out.append((uri, block, nth, kind if isinstance(kind, str) else None, None if session is None else str(session), None if stamp is None else str(stamp), turns["a"], turns["b"], turns["c"]))
        yield pd.DataFrame(out, columns=["source_uri", "block", "nth", "kind", "session", "ts", "a", "b", "c"])


def read_turns(spark: SparkSession, path: str, author_ids: tuple[str, ...] = ()) -> DataFrame:
    """Turns of all transcripts below path. A session is a file; its id is the first that a line names, else the file's name.

    Lines are parsed each by itself, wherever they are; the form of a file (its first record's) and its id are aggregates, and turns are numbered in order.
    """
    lines = json_lines(spark, path).select("source_uri", F.col("line_no.block").alias("block"), F.col("line_no.nth").alias("nth"), "line")
    parsed = lines.mapInPandas(_parsed, _PARSED)
    at = F.struct("block", "nth")
    heads = parsed.groupBy("source_uri").agg(F.min_by(F.struct("kind"), at).alias("first"), F.min_by("session", F.when(F.col("session").isNotNull(), at)).alias("session"))
    kind = F.col("first.kind")
    form = F.when(kind.isin("session_meta", "response_item"), "c").when(kind.isin("user", "assistant", "summary"), "b").otherwise("a")
    named = F.coalesce(F.when(F.col("session") != "", F.col("session")), F.regexp_replace(F.element_at(F.split("source_uri", "/"), -1), r"\.jsonl$", ""))
    heads = heads.select("source_uri", form.alias("format"), named.alias("session_id"))
    rows = parsed.join(heads, "source_uri")
    rows = rows.select("session_id", "source_uri", "format", "block", "nth", "ts", F.posexplode(F.when(F.col("format") == "c", F.col("c")).when(F.col("format") == "b", F.col("b")).otherwise(F.col("a"))).alias("k", "t"))
    turn_idx = F.row_number().over(Window.partitionBy("source_uri").orderBy("block", "nth", "k")).cast("long") - 1
    raw = rows.select(
        "session_id", "source_uri", "format", turn_idx.alias("turn_idx"), "t.role", "t.text", "ts", F.col("t.name").alias("tool_name"), "t.error", F.col("t.calls").alias("n_tool_calls"), "t.forced"
    )
    user = F.col("role") == "user"
    said = classify_user(F.col("text"))
    sender = F.regexp_extract("text", r"\"(?:sender_id|id)\"\s*:\s*\"?([^\",}\s]+)", 1)
    known = F.when(user & sender.isin(*author_ids), sender) if author_ids else F.lit(None).cast("string")
    return raw.select(
        "session_id", "source_uri", "format", "turn_idx", "role", F.when(user & F.col("forced"), "injected").when(user, said["kind"]).otherwise("").alias("kind"),
        F.when(user & ~F.col("forced"), said["text"]).otherwise(F.col("text")).alias("text"), "ts", "tool_name",
        F.when(F.col("role") == "tool", F.coalesce("error", T.is_tool_error(F.col("text")))).otherwise(F.lit(False)).alias("tool_error"), "n_tool_calls",
        known.alias("authored_by"), known.isNotNull().alias("sender_verified"),
    )


def evidence_of_sources(evidence: DataFrame) -> DataFrame:
    """The newest evidence of each source."""
    return evidence.groupBy("source_uri").agg(F.max_by("evidence_id", F.struct("recorded_at", "evidence_id")).alias("evidence_id"))


def line_offsets(lines: DataFrame) -> DataFrame:
    return lines.withColumn("nth", F.row_number().over(Window.partitionBy("source_uri").orderBy("line_no")))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """New transcript lines as a stream; the checkpoint is the ledger of files that were read."""
    return spark.readStream.format("text").option("recursiveFileLookup", "true").load(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_uri"))

