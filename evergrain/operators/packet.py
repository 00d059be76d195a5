"""Bounded result packets, receipts and closeouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evergrain.functions import text as T
from evergrain.functions.ids import content_hash, stable_id

#: Bytes of a packet and what its frame takes of them; characters of an excerpt.
PACKET_BYTES, FRAME_BYTES, EXCERPT = 32_000, 512, 1600
FAILED = ("failed", "error")
IMPACTS = ("changed_decision", "prevented_error", "confirmed_decision")


def anchored_excerpt(body: Column, anchor: Column, most: int = EXCERPT) -> Column:
    """A window of `most` characters around the first place of the anchor, from the start where it does not occur."""
    at = F.coalesce(F.instr(F.lower(body), F.lower(anchor)), F.lit(0))
    begin = F.greatest(F.lit(1), at - F.lit(most // 4))
    return F.substring(body, begin, F.lit(most))


def context_packet(ranked: DataFrame) -> DataFrame:
    """Items of each query in rank order while the packet's bytes allow; the tail is dropped. ranked: query_id, rank, belief_id, body, score."""
    rows = ranked.withColumn("excerpt", F.substring(T.redact_secrets(F.col("body")), 1, EXCERPT))
    size = F.octet_length(F.encode(F.to_json(F.struct("belief_id", "excerpt", "score")), "UTF-8")) + 1
    used = F.sum(size).over(Window.partitionBy("query_id").orderBy("rank"))
    return rows.withColumn("used_bytes", used).where(F.col("used_bytes") <= PACKET_BYTES - FRAME_BYTES)


def packet_accounting(packet: DataFrame) -> DataFrame:
    """One row a query: items, bytes, tokens (a quarter of the bytes, rounded up)."""
    return packet.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_items"), F.max("used_bytes").alias("bytes"), F.ceil(F.max("used_bytes") / 4).alias("tokens"))


def record_retrieval(packet: DataFrame, served_at: str, session_id: str | None) -> tuple[DataFrame, DataFrame]:
    """The receipt of each query and its ranked items, to append."""
    rid = stable_id("ret", F.col("query_id"), F.lit(served_at), F.lit(session_id or ""))
    receipts = packet.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "belief_id"))), lambda x: x["belief_id"].cast("string")).alias("served_ids"))
    receipts = receipts.select(rid.alias("retrieval_id"), "query_id", F.lit(served_at).alias("served_at"), F.lit(session_id).alias("session_id"), "served_ids", F.lit("served").alias("outcome"))
    return receipts, packet.select(rid.alias("retrieval_id"), F.col("belief_id").alias("object_id"), "rank")


def current_outcomes(uses: DataFrame, feedback: DataFrame) -> DataFrame:
    """Receipts with their latest feedback; later rows replace earlier ones, receipts themselves are never changed."""
    last = feedback.groupBy("retrieval_id").agg(F.max_by(F.struct("outcome", "feedback_source"), "feedback_at").alias("f"))
    joined = uses.drop("feedback_source").join(last, "retrieval_id", "left")
    return joined.withColumn("outcome", F.coalesce("f.outcome", "outcome")).withColumn("feedback_source", F.col("f.feedback_source")).drop("f")


def verification_status(statuses: Column) -> Column:
    """failed with any failure; verified when all passed (and there are some); else agent_reported."""
    return F.when(F.exists(statuses, lambda s: s.isin(*FAILED)), "failed").when((F.size(statuses) > 0) & F.forall(statuses, lambda s: s == "passed"), "verified").otherwise("agent_reported")


def affected_decision(impacts: Column) -> Column:
    return F.exists(impacts, lambda i: i.isin(*IMPACTS))


def closeouts(receipts: DataFrame, uses: DataFrame) -> DataFrame:
    """Closeout receipts with status, impact, and whether every retrieval they cite exists. receipts: closeout_id, retrieval_ids, statuses, impacts."""
    cited = receipts.select("closeout_id", F.explode("retrieval_ids").alias("retrieval_id")).join(uses.select("retrieval_id", F.lit(1).alias("known")), "retrieval_id", "left")
    unknown = cited.where("known is null").groupBy("closeout_id").agg(F.count(F.lit(1)).alias("n_unknown"))
    joined = receipts.join(unknown, "closeout_id", "left")
    return joined.select("closeout_id", verification_status(F.col("statuses")).alias("status"), affected_decision(F.col("impacts")).alias("affected_decision"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))


def gated_get(beliefs: DataFrame, ids: list[str], gate: Column) -> DataFrame:
    """Beliefs by id that the gate admits and that are served; anything else is as absent as an unknown id."""
    return beliefs.where(F.col("belief_id").isin(*ids) & gate & F.col("serve") & (F.col("status") == "current"))


def hosted_projection(rows: DataFrame, columns: tuple[str, ...], attributes: tuple[str, ...]) -> DataFrame:
    """Only whitelisted columns, and of the attribute map only whitelisted keys."""
    kept = F.map_filter("attributes", lambda k, _: k.isin(*attributes))
    return rows.select(*[c for c in columns if c in rows.columns and c != "attributes"], kept.alias("attributes"))


def managed_excerpt(rows: DataFrame, most: int) -> DataFrame:
    """One row: the lines of the injected rows by score within `most` characters, the first always kept, and their hash."""
    head = rows.where("inject").orderBy(F.desc("promote_score"), "knowledge_id").limit(200)  # the budget holds far fewer
    w = Window.orderBy(F.desc("promote_score"), "knowledge_id")
    line = F.concat(F.lit("- "), T.summary_of(F.col("body"), 240))
    run = head.withColumn("line", line).withColumn("nth", F.row_number().over(w)).withColumn("used", F.sum(F.length("line") + 1).over(w))
    kept = run.where((F.col("used") <= most) | (F.col("nth") == 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n")
    return kept.agg(text.alias("excerpt")).withColumn("content_hash", content_hash(F.col("excerpt")))


def digest_lists(beliefs: DataFrame, k: int = 10) -> DataFrame:
    """The newest k beliefs of each status, pinned ones first."""
    w = Window.partitionBy("status").orderBy(F.desc("pinned"), F.desc("last_compiled_at"), "belief_id")
    return beliefs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def teacher_request(evidence: DataFrame, most: int = 20) -> DataFrame:
    """A package of redacted, hosted-allowed evidence for a teacher, never sent from here."""
    from evergrain.functions.scope import hosted_ok

    rows = evidence.where(hosted_ok()).orderBy("evidence_id").limit(most)
    return rows.select("evidence_id", T.redact_secrets(F.col("body")).alias("body")).withColumn("payload_hash", content_hash(F.col("body")))


def egress_audit(included: DataFrame, rejected: DataFrame, target: str, context_json: str, query: str, ts: str) -> DataFrame:
    """The audit row of a delivery: counts and hashes of what was included (belief_id, payload_hash) and rejected (belief_id, reason), and its id.

    The payload hash is over the included rows' hashes in order of their ids, folded from an order-free digest of each, so no task holds them all.
    """
    sums = lambda rows, *cols: rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.conv(F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 15), 16, 10).cast("long")).alias("x"))
    a = sums(included, F.col("belief_id").cast("string"), F.col("payload_hash")).select(F.col("n").alias("n_included"), F.coalesce("x", F.lit(0)).alias("included_digest"))
    b = sums(rejected, F.col("belief_id").cast("string"), F.col("reason")).select(F.col("n").alias("n_rejected"), F.coalesce("x", F.lit(0)).alias("rejected_digest"))
    row = a.crossJoin(F.broadcast(b))  # one row each
    payload = F.sha2(F.concat_ws("|", F.col("included_digest").cast("string"), F.col("n_included").cast("string")), 256)
    row = row.withColumn("payload_hash", payload).withColumn("target", F.lit(target)).withColumn("context_json", F.lit(context_json)).withColumn("query", F.lit(query)).withColumn("ts", F.lit(ts))
    return row.withColumn("audit_id", stable_id("egress", F.col("target"), F.col("context_json"), F.col("query"), F.col("payload_hash"), F.col("ts")))


def handles_by_id(handles: DataFrame) -> DataFrame:
    """Handles of a packet once each: at the place where an id came first, with what it said last. handles: query_id, pos, id and more."""
    rest = [c for c in handles.columns if c not in ("query_id", "id", "pos")]
    found = handles.groupBy("query_id", "id").agg(F.min("pos").alias("pos"), F.max_by(F.struct(*rest), "pos").alias("last"))
    return found.select("query_id", "id", "pos", "last.*")
