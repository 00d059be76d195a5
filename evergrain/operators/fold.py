"""Folding the log into current beliefs, in event order per belief: approvals reset, constraints are replayed.

Every event that can touch a belief is routed to its canonical id. A full or point-in-time fold is a pair of aggregations;
fold_events() is the same rule as a step from one state to the next, for folds that go on from stored beliefs.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .log import body, scan

STRICT = ("mark_wrong", "retract", "demote")
SHREDDED = "[shredded by tombstone]"


def routed(log: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Events by the belief they touch: canonical, event_seq, id, ts, kind, payload, proposal (and its sequence number)."""
    proposed = log.where("kind = 'compilation_proposed'").select(
        F.col("id").alias("proposal_id"), F.col("event_seq").alias("proposal_seq"), F.col("body_json").alias("proposal"), body("belief_id").alias("proposed_belief")
    )
    # other decisions change nothing, and a decision before its proposal has none
    decided = log.where(F.col("kind") == "compilation_decided").where(body("decision").isin("approve", "edit")).withColumn("proposal_id", body("proposal_event_id"))
    decided = decided.join(proposed, "proposal_id").where("proposal_seq < event_seq")
    decided = decided.select(F.col("proposed_belief").alias("target"), "event_seq", "id", "ts", "kind", F.col("body_json").alias("payload"), "proposal", "proposal_seq")
    targets = F.when(F.col("kind") == "correction_recorded", body("target_id")).when(F.col("kind") == "tombstone_recorded", body("target")).otherwise(body("belief_id"))
    others = log.where("kind in ('correction_recorded', 'tombstone_recorded', 'scope_promoted')").select(
        targets.alias("target"), "event_seq", "id", "ts", "kind", F.col("body_json").alias("payload"), F.lit(None).cast("string").alias("proposal"), F.lit(None).cast("long").alias("proposal_seq")
    )
    events = decided.unionByName(others)
    if aliases is None:
        return events.withColumn("canonical", F.col("target"))
    return events.join(aliases.select(F.col("alias_id").alias("target"), "canonical_id"), "target", "left").withColumn("canonical", F.coalesce("canonical_id", "target")).drop("canonical_id")


def _correct(state: dict, event: dict, payload: dict) -> None:
    op = payload.get("op")
    if payload.get("target_layer") not in ("knowledge", "belief"):
        return
    if op in ("edit", "reframe") and payload.get("body"):
        state["body"] = str(payload["body"])
    elif op == "pin":
        state["pinned"] = True
    elif op == "demote":
        state["confidence"] = min(float(state["confidence"] or 0.5), 0.4)  # 0 counts as unset
    elif op in ("mark_wrong", "retract"):
        state |= {"status": "retracted", "serve": False}
    state["last_event_id"] = event["id"]


def _bury(state: dict, event: dict, payload: dict) -> None:
    state |= {"status": "tombstoned", "serve": False, "last_event_id": event["id"]}
    if payload.get("mode") == "shred":
        state |= {"body": SHREDDED, "evidence_ids": []}


def fold_events(belief_id: str, events: Iterable[dict], state: dict | None = None, replay: bool = True) -> dict | None:
    """The belief after its events in order of event_seq. replay: earlier constraints hold again after a late approval."""
    past: list[tuple[dict, dict]] = []
    for event in sorted(events, key=lambda e: e["event_seq"]):
        payload, kind = json.loads(event["payload"]), event["kind"]
        if kind == "compilation_decided":
            if payload.get("decision") not in ("approve", "edit"):
                continue
            proposal = json.loads(event["proposal"])
            scope = proposal.get("scope") or {}
            state = {
                "belief_id": belief_id, "body": str(payload.get("edited_body") or proposal.get("body") or ""), "status": "current", "serve": True,
                "pinned": False, "confidence": proposal.get("confidence"), "evidence_ids": [str(x) for x in proposal.get("evidence_ids") or []],
                "belief_type": proposal.get("belief_type"), "attributes": json.dumps(proposal["attributes"], separators=(",", ":")) if proposal.get("attributes") is not None else None, "approved_event_id": event["id"], "last_event_id": event["id"], "last_compiled_at": event["ts"],
            } | {k: scope.get(k) for k in ("scope_type", "scope_id", "visibility", "egress_policy")}
            for before, held in past if replay else ():
                if before["kind"] == "tombstone_recorded":
                    _bury(state, before, held)
                elif before["event_seq"] > event["proposal_seq"] or (held.get("hard") and held.get("op") in STRICT):
                    _correct(state, before, held)
            continue
        if kind in ("correction_recorded", "tombstone_recorded"):
            past.append((event, payload))
        if state is None:
            continue
        if kind == "correction_recorded":
            _correct(state, event, payload)
        elif kind == "tombstone_recorded":
            _bury(state, event, payload)
        elif kind == "scope_promoted" and payload.get("approved_by"):
            state |= {k: (payload.get("scope") or {}).get(k) for k in ("scope_type", "scope_id", "visibility", "egress_policy")} | {"last_event_id": event["id"]}
    return state


SCOPE = "scope_type string, scope_id string, visibility string, egress_policy string"
PAYLOAD = f"decision string, edited_body string, target_layer string, op string, body string, hard string, mode string, approved_by string, scope struct<{SCOPE.replace(' string', ': string')}>"
PROPOSAL = f"body string, confidence double, evidence_ids array<string>, belief_type string, attributes string, scope struct<{SCOPE.replace(' string', ': string')}>"


def fold(log: DataFrame, at_ts: str | None = None, aliases: DataFrame | None = None, replay: bool = True) -> DataFrame:
    """Current beliefs after all events (or those up to at_ts).

    An approval resets the belief, so its last one settles what it holds, and of the other events only those count that come
    after it or, with replay, restrict it from before. What they do is the latest of its kind in order of event_seq:
    aggregates by belief, which combine on the map side, so a belief with very many events is no single task.
    """
    return fold_routed(routed(scan(log, at_ts=at_ts), aliases), replay)


def advance(log: DataFrame, stored: DataFrame, cursor: tuple[int, str] | None, aliases: DataFrame | None = None) -> DataFrame:
    """Current beliefs from stored ones and the events after the cursor (event_seq, event_hash) that they were folded up to.

    Only beliefs that a later event touches are folded anew, from their own histories. Where there is no cursor, or the log no longer has that
    event with that hash, everything is.
    """
    if cursor is None or log.where((F.col("event_seq") == cursor[0]) & (F.col("event_hash") == cursor[1])).isEmpty():
        return fold(log, aliases=aliases)
    events = routed(log, aliases)
    touched = events.where((F.col("event_seq") > cursor[0]) & F.col("canonical").isNotNull()).select("canonical").distinct()
    again = fold_routed(events.join(touched, "canonical", "left_semi"))
    rest = stored.join(touched, stored["belief_id"] == touched["canonical"], "left_anti")
    return rest.select(again.columns).unionByName(again)


def fold_routed(events: DataFrame, replay: bool = True) -> DataFrame:
    """fold() of events that routed() has brought to their beliefs."""
    events = events.where("canonical is not null").withColumn("p", F.from_json("payload", PAYLOAD))
    approved = events.where("kind = 'compilation_decided' and p.decision in ('approve', 'edit')")
    last = approved.groupBy("canonical").agg(F.max_by(F.struct("event_seq", "id", "ts", "proposal", "proposal_seq", "p.edited_body"), "event_seq").alias("a"))

    held = events.where("kind <> 'compilation_decided'").join(last.select("canonical", F.col("a.event_seq").alias("at"), F.col("a.proposal_seq").alias("since")), "canonical")
    after, op, kind = F.col("event_seq") > F.col("at"), F.col("p.op"), F.col("kind")
    strict = F.coalesce(F.col("p.hard").isin("true", "1"), F.lit(False)) & op.isin(*STRICT)
    before = (F.col("event_seq") > F.col("since")) | strict if replay else F.lit(False)
    fixes = (kind == "correction_recorded") & F.col("p.target_layer").isin("knowledge", "belief") & (after | before)
    buries = (kind == "tombstone_recorded") & (after | F.lit(replay))
    moves = (kind == "scope_promoted") & after & (F.coalesce("p.approved_by", F.lit("")) != "")
    held = held.select("canonical", "id", "p", "event_seq", *[F.coalesce(c, F.lit(False)).alias(n) for c, n in ((fixes, "fixes"), (buries, "buries"), (moves, "moves"))])
    held = held.where("fixes or buries or moves")
    shreds = F.col("buries") & (F.col("p.mode") == "shred")
    edits = F.col("fixes") & F.col("p.op").isin("edit", "reframe") & (F.coalesce("p.body", F.lit("")) != "")
    ends = F.when(F.col("buries"), "tombstoned").when(F.col("fixes") & F.col("p.op").isin("mark_wrong", "retract"), "retracted")
    latest = lambda value, when: F.max_by(value, F.when(when, F.col("event_seq")))
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)))
    state = held.groupBy("canonical").agg(
        latest(ends, ends.isNotNull()).alias("ended"), latest(F.when(shreds, SHREDDED).otherwise(F.col("p.body")), shreds | edits).alias("text"),
        any_(F.col("fixes") & (F.col("p.op") == "pin")).alias("pinned"), any_(F.col("fixes") & (F.col("p.op") == "demote")).alias("demoted"),
        any_(shreds).alias("shredded"), latest(F.struct("p.scope"), F.col("moves")).alias("moved"), F.max_by("id", "event_seq").alias("last_id"),
    )
    rows = last.join(state, "canonical", "left").withColumn("q", F.from_json("a.proposal", PROPOSAL))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    unset = F.coalesce(F.when(F.col("q.confidence") != 0, F.col("q.confidence")), F.lit(0.5))  # 0 counts as unset
    scope = lambda c: F.when(F.col("moved").isNotNull(), F.col(f"moved.scope.{c}")).otherwise(F.col(f"q.scope.{c}")).alias(c)
    return rows.select(
        F.col("canonical").alias("belief_id"), F.coalesce("text", given("a.edited_body"), given("q.body"), F.lit("")).alias("body"),
        F.coalesce("ended", F.lit("current")).alias("status"), F.col("ended").isNull().alias("serve"), F.coalesce("pinned", F.lit(False)).alias("pinned"),
        F.when(F.col("demoted"), F.least(unset, F.lit(0.4))).otherwise(F.col("q.confidence")).alias("confidence"), *[scope(c.split(" ")[0]) for c in SCOPE.split(", ")],
        F.when(F.col("shredded") | F.col("q.evidence_ids").isNull(), F.array().cast("array<string>")).otherwise(F.col("q.evidence_ids")).alias("evidence_ids"), F.col("q.belief_type").alias("belief_type"), F.col("q.attributes").alias("attributes"),
        F.col("a.id").alias("approved_event_id"), F.coalesce("last_id", "a.id").alias("last_event_id"), F.col("a.ts").alias("last_compiled_at"),
    )


def fold_evidence(log: DataFrame) -> DataFrame:
    """Evidence objects: body, kind and time of the first record, sources and scope of the last that has them."""
    rows = log.where("kind = 'evidence_recorded'").select(
        "event_seq", "ts", "id", "writer", body("evidence_id").alias("evidence_id"), body("body").alias("body"), body("kind").alias("evidence_kind"),
        body("artifact_ref").alias("artifact_ref"), body("scope").alias("scope"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("event_seq"))).alias(c)
    return rows.groupBy("evidence_id").agg(
        F.min_by("body", "event_seq").alias("body"), F.min_by("evidence_kind", "event_seq").alias("evidence_kind"), F.min("ts").alias("occurred_at"),
        F.max("ts").alias("recorded_at"), last("artifact_ref"), last("scope"), F.max_by("writer", "event_seq").alias("source_runtime"),
        (F.count_distinct("body") > 1).alias("conflicting"),
    )


def support_edges(beliefs: DataFrame) -> DataFrame:
    """belief_id, evidence_id, relation of the current support sets."""
    return beliefs.select("belief_id", F.explode("evidence_ids").alias("evidence_id"), F.lit("supports").alias("relation"))


def search_rows(beliefs: DataFrame) -> DataFrame:
    """The search documents: only what is served and current. The title is the attributes' title or subject, where there are attributes with one, else the id."""
    said = lambda name: F.when(F.get_json_object("attributes", f"$.{name}") != "", F.get_json_object("attributes", f"$.{name}"))
    title = F.coalesce(said("title"), said("subject"), "belief_id") if "attributes" in beliefs.columns else F.col("belief_id")
    return beliefs.where("serve and status = 'current'").select(
        F.col("belief_id").alias("doc_id"), F.concat(F.lit("belief:"), F.coalesce("belief_type", F.lit("compiled"))).alias("kind"), title.alias("title"), "body"
    )


def confidence_band(c: str = "confidence"):
    return F.when(F.col(c).isNull(), "unknown").when(F.col(c) >= 0.75, "strong").when(F.col(c) >= 0.45, "moderate").otherwise("weak")


def resolve_aliases(ids: DataFrame, objects: DataFrame, aliases: DataFrame) -> DataFrame:
    """id -> canonical_id: an object's own id, else its alias, else the id under its old prefix, else the id itself."""
    own = objects.select(F.col("object_id").alias("id"), F.col("object_id").alias("own"))
    named = aliases.select(F.col("alias_id").alias("id"), F.col("canonical_id").alias("named"))
    old = objects.select(F.expr("substring(object_id, 8)").alias("id"), F.col("object_id").alias("old")).where("old like 'legacy:%'")
    joined = ids.join(own, "id", "left").join(named, "id", "left").join(old, "id", "left")
    return joined.select("id", F.coalesce("own", "named", F.when(F.col("id").startswith("know_"), F.col("old")), "id").alias("canonical_id"))


#: How far a status restricts a belief; statuses that an imported row may have.
RESTRICTIVENESS = {"current": 0, "candidate": 1, "superseded": 2, "stale": 3, "archived": 4, "retracted": 5, "tombstoned": 6}
IMPORTED = ("candidate", "current", "superseded", "stale", "archived")


def merge_imports(beliefs: DataFrame, imports: DataFrame, corrections: DataFrame) -> DataFrame:
    """belief_id, body, status, serve, pinned, confidence, evidence_ids of beliefs and imported old rows together.

    imports: belief_id, body, status, confidence, origin, inject, evidence_ids. An old row under the id of a belief keeps the belief's body, pin and
    confidence (its own where there is none), takes the more restrictive status, and adds its evidence; any other becomes a belief of its own. Imported
    rows are never served. corrections (target_id, op: mark_wrong, retract, demote, pin or tombstone) that were
    recorded before the import hold on imported rows.
    """
    allowed = F.col("status").isin(*IMPORTED)
    rows = imports.select(
        "belief_id", F.coalesce("body", F.lit("")).alias("new_body"), F.when(allowed, F.col("status")).otherwise("candidate").alias("new_status"), F.col("confidence").alias("new_confidence"),
        F.coalesce((F.col("origin") == "human") & F.col("inject"), F.lit(False)).alias("new_pinned"), F.col("evidence_ids").alias("new_evidence"), F.lit(True).alias("imported"),
    )
    held = corrections.groupBy("target_id").agg(F.collect_set("op").alias("ops"))  # a handful of operations
    both = beliefs.select("belief_id", "body", "status", "serve", "pinned", "confidence", "evidence_ids").join(rows, "belief_id", "full_outer")
    both = both.join(held.withColumnRenamed("target_id", "belief_id"), "belief_id", "left")
    rank = lambda c: F.coalesce(F.create_map(*[F.lit(x) for pair in RESTRICTIVENESS.items() for x in pair])[F.col(c)], F.lit(1))
    merged = F.when(F.col("new_status").isNull() | (rank("status") >= rank("new_status")), F.col("status")).otherwise(F.col("new_status"))
    status = F.coalesce(F.when(F.col("status").isNull(), F.col("new_status")).otherwise(merged), F.lit("candidate"))
    has = lambda *names: F.coalesce(F.col("imported"), F.lit(False)) & F.coalesce(F.arrays_overlap("ops", F.array(*map(F.lit, names))), F.lit(False))
    status = F.when(has("tombstone"), "tombstoned").when(has("mark_wrong", "retract"), "retracted").otherwise(status)
    sure = F.coalesce("confidence", "new_confidence")
    none = F.array().cast("array<string>")
    return both.select(
        "belief_id", F.coalesce("body", "new_body").alias("body"), status.alias("status"), (F.coalesce("serve", F.lit(False)) & F.col("imported").isNull()).alias("serve"),
        (F.coalesce("pinned", "new_pinned", F.lit(False)) | has("pin")).alias("pinned"), F.when(has("demote"), F.least(F.coalesce(F.when(sure != 0, sure), F.lit(0.5)), F.lit(0.4))).otherwise(sure).alias("confidence"),
        F.array_distinct(F.concat(F.coalesce("evidence_ids", none), F.coalesce("new_evidence", none))).alias("evidence_ids"),
    )
