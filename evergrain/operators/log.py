"""The event log: chain verification, digests, health, proposals and their decisions.

A log has event_seq, id, ts, kind, writer, session_id, body_json, body_hash, prev_hash, event_hash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evergrain.functions.ids import canonical_json, content_hash, event_hash, event_id


def scan(log: DataFrame, after_seq: int | None = None, at_ts: str | None = None) -> DataFrame:
    """Events in (after_seq, ...) and up to at_ts, compared as strings; both filters reach the scan."""
    if after_seq is not None:
        log = log.where(F.col("event_seq") > after_seq)
    return log if at_ts is None else log.where(F.col("ts") <= at_ts)


def body(path: str) -> Column:
    return F.get_json_object("body_json", f"$.{path}")


def verify_chain(log: DataFrame, first_prev: str | None = None) -> DataFrame:
    """event_seq and the reason of each event that fails; empty for a sound log.

    Each event meets its predecessor by a join on its number, so no window runs over the whole log; sequence numbers are
    without gaps.
    """
    previous = log.select((F.col("event_seq") + 1).alias("event_seq"), F.col("event_hash").alias("before"))
    first = log.agg(F.min("event_seq").alias("first"))
    joined = log.join(previous, "event_seq", "left").crossJoin(F.broadcast(first))  # one row
    expected = F.when(F.col("event_seq") == F.col("first"), F.lit(first_prev)).otherwise(F.col("before"))
    computed = event_hash(F.col("ts"), F.col("kind"), F.col("writer"), F.col("session_id"), F.col("body_hash"), F.col("prev_hash"))
    reason = (
        F.when((F.col("event_seq") > F.col("first")) & F.col("before").isNull(), "missing_predecessor")
        .when(~F.col("prev_hash").eqNullSafe(expected), "prev_hash_mismatch")
        .when(F.col("body_hash") != content_hash(canonical_json("body_json")), "body_hash_mismatch")
        .when(F.col("event_hash") != computed, "event_hash_mismatch")
        .when(F.col("id") != event_id(F.col("kind"), F.col("event_hash")), "id_mismatch")
    )
    return joined.select("event_seq", reason.alias("reason")).where("reason is not null")


def append(log_head: tuple[int, str | None], events: list[dict]) -> list[dict]:
    """Rows of new events after the head (event_seq, event_hash). Sequential by nature: each hash needs the one before.

    A decision whose body has proposal_of (a belief) instead of proposal_event_id decides that belief's last proposal among
    the new events. A batch of writes, so the caller bounds it.
    """
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    canon = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    seq, prev = log_head
    rows, proposed = [], {}
    for e in events:
        seq += 1
        made = dict(e["body"])
        if e["kind"] == "compilation_decided" and "proposal_of" in made:
            made["proposal_event_id"] = proposed[made.pop("proposal_of")]
        text = canon(made)
        head = {"ts": e["ts"], "kind": e["kind"], "writer": e["writer"], "session_id": e.get("session_id"), "body_hash": sha(text), "prev_hash": prev}
        hashed = sha(canon(head))
        named = "evt_" + sha(e["kind"] + "\0" + hashed + "\0")[:16]
        if e["kind"] == "compilation_proposed":
            proposed[made.get("belief_id")] = named
        rows.append(head | {"event_seq": seq, "id": named, "body_json": text, "event_hash": hashed})
        prev = hashed
    return rows


def digest(log: DataFrame, since: str | None = None) -> DataFrame:
    """kind, n_events, first_ts, last_ts since a time."""
    rows = log if since is None else log.where(F.col("ts") >= since)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def writer_health(log: DataFrame, useful: list[str]) -> DataFrame:
    """Per writer: last write, last useful write and its kind, distinct sessions, events."""
    good = F.col("kind").isin(*useful)
    last = F.struct("ts", "event_seq")
    return log.groupBy("writer").agg(
        F.max("ts").alias("last_write"),
        F.max(F.when(good, F.col("ts"))).alias("last_useful_write"),
        F.max_by(F.when(good, F.col("kind")), F.when(good, last)).alias("last_useful_kind"),
        F.count_distinct("session_id").alias("n_sessions"),
        F.count(F.lit(1)).alias("n_events"),
        F.sum(good.cast("long")).alias("n_useful"),
    )


def proposals(log: DataFrame) -> DataFrame:
    """Each proposal with its last decision, if any: proposal_id, belief_id, proposed_at, decision, decided_at, state."""
    proposed = log.where("kind = 'compilation_proposed'").select(F.col("id").alias("proposal_id"), "event_seq", body("belief_id").alias("belief_id"), F.col("ts").alias("proposed_at"))
    decided = log.where("kind = 'compilation_decided'").select(
        body("proposal_event_id").alias("proposal_id"), body("decision").alias("decision"), F.col("ts").alias("decided_at"), F.col("event_seq").alias("decided_seq")
    )
    last = decided.groupBy("proposal_id").agg(F.max_by(F.struct("decision", "decided_at"), "decided_seq").alias("last"))
    return proposed.join(last, "proposal_id", "left").select(
        "proposal_id", "belief_id", "event_seq", "proposed_at", F.col("last.decision").alias("decision"), F.col("last.decided_at").alias("decided_at"),
        F.when(F.col("last").isNull(), "pending").otherwise("decided").alias("state"),
    )


def hard_blocked(log: DataFrame) -> DataFrame:
    """target_id of every object with a hard correction that restricts it."""
    rows = log.where("kind = 'correction_recorded'").select(body("target_id").alias("target_id"), body("op").alias("op"), body("hard").alias("hard"))
    return rows.where("hard in ('true', '1') and op in ('mark_wrong', 'retract', 'demote')").select("target_id").distinct()


def block_reasons(log: DataFrame) -> DataFrame:
    """proposal_id, reason for proposals that may not be decided: tombstoned > corrected since > hard-corrected > not pending."""
    props = proposals(log)
    tomb = log.where("kind = 'tombstone_recorded'").select(body("target").alias("belief_id")).distinct().withColumn("tomb", F.lit(True))
    fixes = log.where("kind = 'correction_recorded'").select(
        body("target_id").alias("belief_id"), F.col("event_seq").alias("fix_seq"), body("target_layer").alias("layer"),
        (body("hard").isin("true", "1") & body("op").isin("mark_wrong", "retract", "demote")).alias("strict"),
    ).where("layer in ('knowledge', 'belief')").groupBy("belief_id").agg(F.max("fix_seq").alias("last_fix"), F.max("strict").alias("strict"))
    joined = props.join(tomb, "belief_id", "left").join(fixes, "belief_id", "left")
    reason = (
        F.when(F.col("tomb"), "tombstoned")
        .when(F.col("last_fix") > F.col("event_seq"), "corrected_after_proposal")
        .when(F.col("strict"), "hard_corrected")
        .when(F.col("state") != "pending", F.concat(F.lit("already_"), F.col("decision")))
    )
    return joined.select("proposal_id", "belief_id", reason.alias("reason")).where("reason is not null")


def table_digest(df: DataFrame) -> DataFrame:
    """One row: count and an order-free hash of all rows, for comparing copies."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("row_hash"))


def chain_lag(log: DataFrame, bucket: Column, order: str, value: str) -> DataFrame:
    """Each row's value beside its predecessor's within a bucket."""
    w = Window.partitionBy(bucket).orderBy(order)
    return log.withColumn("previous", F.lag(value).over(w))
