"""Admission, quarantine, renderings, backfill and safety checks of knowledge rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evergrain.functions import text as T

from evergrain.functions.scope import conservative_scope

from .patterns import distinct_hits

#: File names that may not be tracked.
FORBIDDEN_PATH = r"(?i)(^|/)(\.env[^/]*|[^/]*\.(sqlite3?|db|pem|key|p12|jsonl)|id_(?:rsa|ed25519)[^/]*)$"


def admit(knowledge: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates that have evidence become current; rows that would be injected without approval are not injected."""
    backed = links.select("knowledge_id").distinct().withColumn("backed", F.lit(True))
    rows = knowledge.join(backed, "knowledge_id", "left")
    status = F.when((F.col("status") == "candidate") & F.coalesce("backed", F.lit(False)), "current").otherwise(F.col("status"))
    inject = F.col("inject") & (F.col("approved_by").isNotNull() | ~F.coalesce("prescriptive", F.lit(False)))
    return rows.withColumn("status", status).withColumn("inject", F.coalesce(inject, F.lit(False))).drop("backed")


#: Fixed value: scopes that a listing shows.
PUBLIC_SCOPES = ("workspace", "project", "public")


def filtered(rows: DataFrame, project: str | None = None, path: str | None = None, kind: str | None = None, status: str | None = None, tags: dict[str, str] | None = None) -> DataFrame:
    """Search rows under the caller's filters: project, path prefix, type, status, and values in the JSON of loop_tags."""
    for column, value in (("project", project), ("type", kind), ("status", status)):
        if value:
            rows = rows.where(F.col(column) == value)
    if path:
        rows = rows.where(F.col("path").startswith(path))
    for name, value in (tags or {}).items():
        rows = rows.where(F.get_json_object("loop_tags", f"$.{name}") == value)
    return rows


def current_knowledge(knowledge: DataFrame, project: str | None = None, scopes: tuple[str, ...] = PUBLIC_SCOPES, kind: str | None = None, inject_only: bool = False, limit: int = 20) -> DataFrame:
    """The listing of current rows that are not quarantined, of a project or of none: injected first, then by score, confidence, time and id."""
    rows = knowledge.where((F.col("status") == "current") & F.col("quarantine_reason").isNull())
    rows = rows.where(F.col("privacy_scope").isin(*scopes)) if scopes else rows
    rows = rows.where((F.col("project") == project) | F.col("project").isNull()) if project else rows
    rows = rows.where(F.col("type") == kind) if kind else rows
    rows = rows.where("inject") if inject_only else rows
    return rows.orderBy(F.desc("inject"), F.desc(F.coalesce("promote_score", F.lit(-1.0))), F.desc(F.coalesce("confidence", F.lit(0.0))), F.desc("updated_at"), F.asc("knowledge_id")).limit(limit)


SUMMARY = ("type", "status", "gate", "risk", "confidence", "inject", "project", "privacy_scope", "updated_at")


def knowledge_summary(knowledge: DataFrame) -> DataFrame:
    """knowledge_id and a summary as JSON: what all types have, then subject, predicate and value of values, or slug, title and kind of the others."""
    common = [F.col(c) for c in SUMMARY if c in knowledge.columns]
    value = F.coalesce(F.col("value_text"), F.col("value_numeric").cast("string"), F.col("value_bool").cast("string")).alias("value")
    typed = F.when(F.col("type") == "value", F.to_json(F.struct(*common, "subject", "predicate", value, "target_value"))).otherwise(F.to_json(F.struct(*common, "slug", "title", "body_uri", "doc_kind")))
    return knowledge.select("knowledge_id", typed.alias("summary"))


def set_status(knowledge: DataFrame, ids: list[str], status: str, reason: str) -> DataFrame:
    """Reject or mark stale: named rows get the status and its reason, and are no longer injected."""
    named = F.col("knowledge_id").isin(*ids)
    return (
        knowledge.withColumn("status", F.when(named, status).otherwise(F.col("status")))
        .withColumn("invalidation_reason", F.when(named, reason).otherwise(F.col("invalidation_reason")))
        .withColumn("inject", F.when(named, F.lit(False)).otherwise(F.col("inject")))
    )


def release_quarantine(knowledge: DataFrame, ids: list[str], actor_kind: str) -> DataFrame:
    """Only a human releases; the reason is cleared, injection stays off until the next promotion."""
    if actor_kind != "human":
        raise PermissionError("only a human releases quarantine")
    return knowledge.withColumn("quarantine_reason", F.when(F.col("knowledge_id").isin(*ids), F.lit(None)).otherwise(F.col("quarantine_reason")))


def guarded_update(current: DataFrame, changes: DataFrame, key: str = "knowledge_id") -> DataFrame:
    """Changes that may be applied: rows of human origin are changed by humans only. changes has origin and key."""
    held = current.where("origin = 'human'").select(key).withColumn("held", F.lit(True))
    return changes.join(held, key, "left").where("held is null or origin = 'human'").drop("held")


def markdown(docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """knowledge_id, page: title, body and the list of evidence. evidence: knowledge_id, claim, source_uri."""
    line = F.concat(F.lit("- "), F.col("claim"), F.when(F.col("source_uri").isNotNull(), F.concat(F.lit(" ("), "source_uri", F.lit(")"))).otherwise(""))
    lists = evidence.groupBy("knowledge_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    return docs.join(lists, "knowledge_id", "left").select("knowledge_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "body", F.coalesce(F.concat(F.lit("\n\n## Evidence\n"), "lines"), F.lit(""))).alias("page"))


def approval_lines(proposals: DataFrame, limit: int = 20) -> DataFrame:
    """Pending proposals as numbered lines, oldest first."""
    head = proposals.where("state = 'pending'").orderBy("event_seq").limit(limit)
    nth = F.row_number().over(Window.orderBy("event_seq"))
    return head.select("proposal_id", F.concat(nth.cast("string"), F.lit(". "), "belief_id", F.lit(" ("), "proposed_at", F.lit(")")).alias("line"))


def backfill(legacy: DataFrame, beliefs: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Current old rows that no belief has yet, newest first, with a scope: the first keyword rule that matches, else a careful default.

    legacy: id, body, status, project, path, updated_at. rules: (pattern, project)."""
    todo = legacy.where("status = 'current'").join(beliefs.select(F.expr("substring(belief_id, 8)").alias("id")), "id", "left_anti")
    project: Column = F.col("project")
    for pattern, name in reversed(rules):
        project = F.when(F.col("body").rlike("(?i)" + pattern), name).otherwise(project)
    return todo.select(F.concat(F.lit("legacy:"), "id").alias("belief_id"), "body", "updated_at", conservative_scope(project, F.col("path")).alias("scope")).orderBy(F.desc("updated_at"), "belief_id")


def snippet(body: Column, terms: Column, words: int = 12) -> Column:
    """About `words` words around the first of the terms, which stands in brackets."""
    parts = F.split(T.compact_space(body), " ")
    first = F.coalesce(F.try_element_at(F.filter(F.transform(parts, lambda w, k: F.when(F.array_contains(terms, F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}_-]", "")), k)), lambda k: k.isNotNull()), F.lit(1)), F.lit(0))
    begin = F.greatest(F.lit(0), first - words // 2)
    cut = F.slice(F.transform(parts, lambda w, k: F.when(k == first, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), (begin + 1).cast("int"), words)
    return F.concat(F.when(begin > 0, "…").otherwise(""), F.array_join(cut, " "), F.when(begin + words < F.size(parts), "…").otherwise(""))


def best_snippet(body: Column, terms: Column, words: int = 12) -> Column:
    """The first of the windows of `words` words that hold most different terms; every term in it stands in brackets."""
    parts = F.split(T.compact_space(body), " ")
    bare = F.transform(parts, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}_-]", ""))

    def cut(x: Column) -> Column:
        at = F.filter(F.transform(x["bare"], lambda w, k: F.when(F.array_contains(terms, w), k)), lambda k: k.isNotNull())
        scored = F.transform(at, lambda k: F.struct(F.size(F.array_intersect(F.slice(x["bare"], k + 1, words), terms)).alias("n"), (-k).alias("back")))
        return F.element_at(F.transform(F.array(F.coalesce(-F.array_max(scored)["back"], F.lit(0))), lambda begin: window(x, begin)), 1)

    def window(x: Column, begin: Column) -> Column:
        shown = F.transform(F.arrays_zip(F.slice(x["parts"], begin + 1, words).alias("w"), F.slice(x["bare"], begin + 1, words).alias("b")), lambda p: F.when(F.array_contains(terms, p["b"]), F.concat(F.lit("["), p["w"], F.lit("]"))).otherwise(p["w"]))
        return F.concat(F.when(begin > 0, "…").otherwise(""), F.array_join(shown, " "), F.when(begin + words < F.size(x["parts"]), "…").otherwise(""))

    return F.element_at(F.transform(F.array(F.struct(parts.alias("parts"), bare.alias("bare"))), cut), 1)


def denied_counts(texts: DataFrame, id_col: str, text_col: str, denied: DataFrame) -> DataFrame:
    """id, n_patterns: how many entries of a denylist (pattern) occur in each text, in any case; all entries in one pass."""
    return distinct_hits(texts, id_col, text_col, denied)


def public_findings(lines: DataFrame, denied: list[str]) -> DataFrame:
    """path, line_no, finding for tracked lines: forbidden names, leaks, high-entropy runs that are no digests, links or names, and denied words.

    denied is the operator's own short list; denied_counts() is for long ones."""
    runs = F.filter(T.entropy_spans(F.col("line")), lambda s: ~s.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$") & ~s.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & ~F.col("line").contains(F.concat(F.lit("/"), s)))
    hits = [F.when(F.lower("line").contains(w.lower()), F.lit("denied_word")) for w in denied]
    found = F.array_compact(F.array(F.when(F.col("path").rlike(FORBIDDEN_PATH), F.lit("forbidden_path")), F.when(F.size(T.secret_leaks(F.col("line"))) > 0, F.lit("secret_leak")), F.when(F.size(runs) > 0, F.lit("entropy_blob")), *hits))
    return lines.select("path", "line_no", F.explode(F.array_distinct(found)).alias("finding"))


def fallback_reasons(states: DataFrame) -> DataFrame:
    """state_id, reason: why a vector index is not used for a query and the lexical ranking stands alone; null where it is used.

    states: has_path, has_index, schema_version and wanted_schema, event_seq and event_hash of the index and head_seq and head_hash of the log (null for an empty
    one), model and wanted_model, dimensions and wanted_dimensions (text), instruction_hash and wanted_instruction_hash, installed_digest and model_digest,
    query_dimensions (null: the query has no embedding), odd_rows (vectors of another length), error (name of what was raised).
    """
    dims, wanted = F.col("dimensions").try_cast("int"), F.col("wanted_dimensions").try_cast("int")
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    stale = differ("event_seq", "head_seq") | differ("event_hash", "head_hash")
    reason = (
        F.when(~F.col("has_path"), "core_path_unavailable")
        .when(~F.col("has_index"), "vector_sidecar_missing")
        .when(differ("schema_version", "wanted_schema"), "vector_schema_mismatch")
        .when(stale, "vector_sidecar_stale")
        .when(differ("model", "wanted_model"), "vector_model_config_mismatch")
        .when(dims.isNull() | wanted.isNull(), "vector_dimension_metadata_invalid")
        .when((dims <= 0) | (dims != wanted), "vector_dimension_config_mismatch")
        .when(differ("instruction_hash", "wanted_instruction_hash"), "vector_query_instruction_mismatch")
        .when(F.coalesce("installed_digest", F.lit("")).isin("", "unknown"), "vector_model_identity_unavailable")
        .when(differ("model_digest", "installed_digest"), "vector_model_digest_mismatch")
        .when(F.col("error").isNotNull(), F.concat(F.lit("local_embedding_unavailable:"), "error"))
        .when(F.col("query_dimensions").isNull(), "empty_query_embedding")
        .when(F.col("query_dimensions") != dims, "vector_query_dimension_mismatch")
        .when(F.col("odd_rows") > 0, "vector_row_dimension_mismatch")
    )
    return states.select("state_id", reason.alias("reason"))


def search_scopes(hits: DataFrame, knowledge: DataFrame, evidence: DataFrame) -> DataFrame:
    """Search hits (doc_id, rank) with the scope of the knowledge or evidence behind them, in listing order.

    Hits on history files, and on documents that no person, harvest or loop put there and that are not injected, come last. knowledge: doc_id, type, origin,
    inject, privacy_scope; evidence: doc_id, source_type, privacy_scope.
    """
    k = knowledge.select("doc_id", "type", "origin", "inject", F.col("privacy_scope").alias("k_scope"))
    e = evidence.select("doc_id", "source_type", F.col("privacy_scope").alias("e_scope"))
    rows = hits.join(k, "doc_id", "left").join(e, "doc_id", "left")
    plain = (F.col("type") == "doc") & ~F.coalesce("origin", F.lit("")).isin("human", "harvest", "loop") & ~F.coalesce("inject", F.lit(False))
    later = F.coalesce(F.col("source_type").endswith("_history_file"), F.lit(False)) | F.coalesce(plain, F.lit(False))
    return rows.select("doc_id", "rank", F.coalesce("k_scope", "e_scope").alias("scope"), later.cast("int").alias("tier"))


def linked_rows(knowledge: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """knowledge and evidence rows that an edge joins and that both pass their own filters, which are applied before."""
    return edges.join(knowledge, "knowledge_id").join(evidence, "evidence_id")


def migration_rows(knowledge: DataFrame, links: DataFrame) -> DataFrame:
    """Old rows with their links gathered in order: knowledge_id, links (evidence_id, relation), and a digest of both, to be compared with the new store's."""
    gathered = links.groupBy("knowledge_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "relation"))).alias("links"))
    rows = knowledge.join(gathered, "knowledge_id", "left")
    none = F.from_json(F.lit("[]"), gathered.schema["links"].dataType)
    rows = rows.withColumn("links", F.coalesce("links", none))
    return rows.withColumn("row_digest", F.sha2(F.to_json(F.struct(*[F.col(c) for c in knowledge.columns], "links")), 256))
