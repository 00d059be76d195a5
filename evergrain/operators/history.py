"""Beliefs kept beside the histories that they are folded from, so that a fold goes on at a cost that follows the change.

Every event that touches a belief is stored once it has been brought to that belief (fold.routed), in the bucket of the belief's
id; proposals are stored by the bucket of theirs, where later decisions find them. A batch of new events is routed with the
proposals of the buckets that its decisions name, appended, and the beliefs it touches are folded anew from the histories of
their buckets; other buckets are neither read nor written. Cursor and hash stand in the same manifest as the data, so both
change together or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrain.sources.store import Store

from .fold import fold_routed, routed
from .log import body, verify_chain

#: As many folders of batches are read together before they are merged into one.
MERGE_AFTER = 16
EVENTS = "canonical string, event_seq long, id string, ts string, kind string, payload string, proposal string, proposal_seq long, bucket int"
PROPOSALS = "id string, event_seq long, ts string, kind string, body_json string, bucket int"
BELIEFS = (
    "belief_id string, body string, status string, serve boolean, pinned boolean, confidence double, scope_type string, scope_id string, visibility string, "
    "egress_policy string, evidence_ids array<string>, belief_type string, attributes string, approved_event_id string, last_event_id string, last_compiled_at string, bucket int"
)


class BeliefStore:
    """Current beliefs of a log, folded on from where the last run ended.

    aliases (alias_id, canonical_id) hold for the store's life; where they change, or the number of buckets does, rebuild() it.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, aliases: DataFrame | None = None):
        self.spark, self.store, self.buckets, self.aliases = spark, Store(spark, root), buckets, aliases

    def _bucket(self, of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(self.buckets)).cast("int").alias("bucket")

    def _among(self, buckets: list[int] | None) -> Column:
        return F.lit(True) if buckets is None else F.col("bucket").isin(buckets)

    def _all(self, paths: list[str], schema: str, buckets: list[int] | None) -> DataFrame:
        out = self.store.read(paths[0], schema).where(self._among(buckets))
        for p in paths[1:]:
            out = out.unionByName(self.store.read(p, schema).where(self._among(buckets)))
        return out

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # no more than buckets

    def history(self, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """Routed events of some buckets, or of all; only their folders are read."""
        return self._all((manifest or self.store.current())["history"], EVENTS, buckets)

    def beliefs(self, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """Current beliefs of some buckets, or of all."""
        manifest = manifest or self.store.current()
        out = None
        for part in manifest["beliefs"]:
            held = [b for b in part["buckets"] if buckets is None or b in buckets]
            if held or out is None:
                rows = self.store.read(part["path"], BELIEFS).where(F.col("bucket").isin(held))
                out = rows if out is None else out.unionByName(rows)
        return out.drop("bucket")

    def of(self, ids: list[str]) -> DataFrame:
        """Some beliefs, read from their buckets."""
        named = self.spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("belief_id")).select(self._bucket("belief_id"))
        return self.beliefs(self._touched(named)).where(F.col("belief_id").isin(ids))

    def _routed(self, log: DataFrame) -> DataFrame:
        return routed(log, self.aliases).where("canonical is not null").select("canonical", "event_seq", "id", "ts", "kind", "payload", "proposal", "proposal_seq", self._bucket("canonical"))

    def _proposals(self, log: DataFrame) -> DataFrame:
        return log.where("kind = 'compilation_proposed'").select("id", "event_seq", "ts", "kind", "body_json", self._bucket("id"))

    def _head(self, log: DataFrame) -> tuple[int, str] | None:
        found = log.agg(F.max_by(F.struct("event_seq", "event_hash"), "event_seq").alias("h")).first()["h"]
        return None if found is None else (found["event_seq"], found["event_hash"])

    def rebuild(self, log: DataFrame) -> str:
        """Everything anew from the whole log."""
        before = self.store.current()
        head = self._head(log)
        history = self.store.stage(self._routed(log), "history", "bucket")
        made = {"seq": head[0] if head else None, "hash": head[1] if head else None, "history": [history], "proposals": [self.store.stage(self._proposals(log), "proposals", "bucket")]}
        folded = fold_routed(self.store.read(history, EVENTS).drop("bucket"))
        path = self.store.stage(folded.select("*", self._bucket("belief_id")), "beliefs", "bucket")
        made["beliefs"] = [{"path": path, "buckets": list(range(self.buckets))}]
        self.store.publish(made, before)
        return "rebuilt"

    def advance(self, log: DataFrame) -> str:
        """Folds on: "unchanged", "advanced", or "rebuilt" where there is no cursor or the log does not go on from it.

        The log must still hold the cursor's event with its hash, and where it has prev_hash, its later events must chain on.
        """
        now = self.store.current()
        if now is None or now["seq"] is None or log.where((F.col("event_seq") == now["seq"]) & (F.col("event_hash") == now["hash"])).isEmpty():
            return self.rebuild(log)
        new = log.where(F.col("event_seq") > now["seq"])
        if "prev_hash" in log.columns and not verify_chain(new, first_prev=now["hash"]).isEmpty():
            return self.rebuild(log)
        return self._append(new, now)

    def step(self, batch: DataFrame, _: int = 0) -> None:
        """A foreachBatch step of a stream of events, whose store was built before. Events up to the cursor are skipped, so a batch that comes again changes nothing."""
        now = self.store.current()
        new = batch.where(F.col("event_seq") > now["seq"])
        if "prev_hash" in batch.columns and not verify_chain(new, first_prev=now["hash"]).isEmpty():
            raise ValueError(f"events after {now['seq']} do not chain on")
        self._append(new, now)

    def _append(self, new: DataFrame, now: dict) -> str:
        head = self._head(new)
        if head is None:
            return "unchanged"
        columns = ["id", "event_seq", "ts", "kind", "body_json"]
        named = new.where("kind = 'compilation_decided'").select(body("proposal_event_id").alias("id")).where("id is not null").distinct().select("id", self._bucket("id"))
        old = self._all(now["proposals"], PROPOSALS, self._touched(named)).join(named.select("id"), "id", "left_semi")
        history = self.store.stage(self._routed(new.select(columns).unionByName(old.select(columns))), "history", "bucket")
        touched = self.store.read(history, EVENTS).select("canonical", "bucket").distinct()
        buckets = self._touched(touched)
        made = {"seq": head[0], "hash": head[1], "history": now["history"] + [history], "proposals": now["proposals"] + [self.store.stage(self._proposals(new), "proposals", "bucket")]}
        made["beliefs"] = [{"path": p["path"], "buckets": left} for p in now["beliefs"] if (left := [b for b in p["buckets"] if b not in buckets])]
        if buckets:
            again = fold_routed(self.history(buckets, made).join(touched.select("canonical"), "canonical", "left_semi").drop("bucket"))
            rest = self.beliefs(buckets, now).join(touched.select(F.col("canonical").alias("belief_id")), "belief_id", "left_anti")
            path = self.store.stage(rest.unionByName(again).select("*", self._bucket("belief_id")), "beliefs", "bucket")
            made["beliefs"].append({"path": path, "buckets": buckets})
        self.store.publish(self._merged(made), now)
        return "advanced"

    def _merged(self, made: dict) -> dict:
        """Folders of many batches become one."""
        for name, schema in (("history", EVENTS), ("proposals", PROPOSALS)):
            if len(made[name]) > MERGE_AFTER:
                made[name] = [self.store.stage(self._all(made[name], schema, None), name, "bucket")]
        if len(made["beliefs"]) > MERGE_AFTER:
            path = self.store.stage(self.beliefs(None, made).select("*", self._bucket("belief_id")), "beliefs", "bucket")
            made["beliefs"] = [{"path": path, "buckets": list(range(self.buckets))}]
        return made
