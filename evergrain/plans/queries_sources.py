"""Registered queries of sources and sinks (files are written from the tables, then read), listings and renderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from evergrain.functions import scope as S
from evergrain.functions import text as T
from evergrain.operators import admin, factory, packet, retrieval
from evergrain.session import table
from evergrain.sources import files, transcripts

from . import views as V
from .queries_store import _fresh_root
from .registry import CONTEXT, IDS, query, sql_names

# ---- transcripts ----------------------------------------------------------------------------------------------------


def _write_transcripts(spark, sf_dir) -> str:
    """conversations as fifty transcripts in the three forms, with blank and broken lines between."""
    c, s = table(spark, sf_dir, "conversations"), F.pmod("conv_id", F.lit(50))
    form, name = s % 3, F.concat(F.lit("s"), s.cast("string"))
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    line_a = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", block.alias("content")).alias("message")))
    line_b = F.to_json(F.struct(F.col("role").alias("type"), name.alias("sessionId"), F.struct("role", F.col("text").alias("content")).alias("message")))
    line_c = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", block.alias("content")).alias("payload")))
    lines = c.select(s.alias("session"), "conv_id", "turn", F.when(form == 0, line_a).when(form == 1, line_b).otherwise(line_c).alias("value"))
    head_a = F.to_json(F.struct(F.lit("session").alias("type"), name.alias("id")))
    head_b = F.to_json(F.struct(F.lit("summary").alias("type"), name.alias("sessionId")))
    head_c = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(name.alias("id")).alias("payload")))
    heads = c.select(s.alias("session"), F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.when(form == 0, head_a).when(form == 1, head_b).otherwise(head_c).alias("value")).distinct()
    broken = c.where("turn = 1").select(s.alias("session"), "conv_id", "turn", F.explode(F.array(F.lit(""), F.lit('{"type": "message", "mess'), F.lit("[1, 2]"))).alias("value"))
    root = _fresh_root(spark, "transcripts")
    every = lines.unionByName(heads).unionByName(broken)
    every.repartition("session").sortWithinPartitions("session", "conv_id", "turn", "value").select("session", "value").write.partitionBy("session").text(root)
    return root


@query("transcript_turns", """WITH s AS (SELECT conv_id % 50 AS s, conv_id, turn, role, text FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY conv_id, turn) - 1 AS turn_idx FROM s)
    SELECT 's'||s AS session_id, CASE s % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS format, turn_idx, CASE WHEN s % 3 = 2 AND role = 'system' THEN 'user' ELSE role END AS role,
        CASE WHEN s % 3 = 2 AND role = 'system' THEN 'injected' WHEN role = 'user' THEN 'bare' ELSE '' END AS kind, sha256(CASE WHEN role = 'user' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE text END) AS text_sha256 FROM r""")
def transcript_turns(spark, sf_dir):
    found = transcripts.read_turns(spark, _write_transcripts(spark, sf_dir))
    return found.select("session_id", "format", "turn_idx", "role", "kind", F.sha2("text", 256).alias("text_sha256"))


@query("newest_evidence_of_sources", "SELECT props AS source_uri, arg_max('evd_'||event_id, event_id) AS evidence_id FROM events GROUP BY 1")
def newest_evidence_of_sources(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("props").alias("source_uri"), F.concat(F.lit("evd_"), F.col("event_id").cast("string")).alias("evidence_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("recorded_at"))
    return transcripts.evidence_of_sources(e)


# ---- notes, state, mirrors ------------------------------------------------------------------------------------------


@query("note_files_read", """WITH f AS (SELECT p_brand, string_agg(p_name, chr(10) ORDER BY p_partkey) || chr(10) AS t, arg_min(p_name, p_partkey) AS title FROM part GROUP BY 1)
    SELECT p_brand AS brand, trim(title) AS title, sha256(left(t, 32000)) AS body_sha256, strlen(t) AS n_bytes FROM f""")
def note_files_read(spark, sf_dir):
    """The names of each brand's parts as a note."""
    root = _fresh_root(spark, "notes")
    table(spark, sf_dir, "part").repartition("p_brand").sortWithinPartitions("p_brand", "p_partkey").select("p_brand", F.col("p_name").alias("value")).write.partitionBy("p_brand").text(root)
    found = files.note_files(spark, root, suffixes=(".txt",))
    return found.select(F.url_decode(F.regexp_extract("path", "p_brand=([^/]+)/", 1)).alias("brand"), "title", F.sha2("body", 256).alias("body_sha256"), "n_bytes")


@query("dry_run_of_imports", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, {sql_names('line', T.LEAKS)} AS leaks FROM l)
    SELECT doc_id::VARCHAR AS path, array_to_string(list_sort(list_distinct(flatten(list(leaks)))), ',') AS leaks FROM n GROUP BY doc_id""")
def dry_run_of_imports(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("body"))
    return files.dry_run(d).select("path", F.array_join("leaks", ",").alias("leaks"))


@query("curation_lines", "SELECT event_id AS id, event_type AS prompt, value FROM events")
def curation_lines(spark, sf_dir):
    """Events as JSON lines, written and read strictly."""
    root = _fresh_root(spark, "lines")
    e = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("prompt"), "value")).alias("example_json"))
    files.write_jsonl(e, root)
    return files.json_table(spark, root, "id long, prompt string, value double")


@query("last_writes_win", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 8 = 0 THEN 9.5 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -o_orderkey, 'new', NULL FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0""")
def last_writes_win(spark, sf_dir):
    """Updates and inserts by key, the last of a key, with a column that null does not overwrite."""
    o, k = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    price = F.when(k % 8 == 0, F.lit(9.5))
    some = o.where(k % 4 == 0)
    changes = some.select("o_orderkey", F.lit("old").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice"), F.lit(1).alias("at")).where(k % 8 == 0)
    changes = changes.unionByName(some.select("o_orderkey", F.lit("new").alias("o_orderstatus"), price.alias("o_totalprice"), F.lit(2).alias("at")))
    changes = changes.unionByName(some.where(k % 8 != 0).select((-k).alias("o_orderkey"), F.lit("new").alias("o_orderstatus"), price.alias("o_totalprice"), F.lit(3).alias("at")))
    return files.upsert(o, changes, "o_orderkey", "at", keep=("o_totalprice",)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("verified_copy", "SELECT count(*) AS n_rows, true AS same FROM lineitem")
def verified_copy(spark, sf_dir):
    """A copy of lineitem whose count and hash are compared after it is written."""
    root = _fresh_root(spark, "copy")
    made = files.backup(table(spark, sf_dir, "lineitem"), root)
    return spark.read.parquet(root).agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", (F.col("n_rows") == made["n_rows"]).alias("same"))


# ---- scopes and deliveries ------------------------------------------------------------------------------------------


@query("conservative_scopes", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'project:'||source WHEN doc_id % 3 = 1 THEN 'project:path-'||substring(sha256('/x/'||doc_id), 1, 16) ELSE 'legacy:unscoped' END AS scope_id, CASE WHEN doc_id % 3 = 2 THEN 'legacy_unscoped' ELSE 'project' END AS scope_type FROM documents""")
def conservative_scopes(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    found = S.conservative_scope(F.when(k % 3 == 0, F.concat(F.lit(" "), "source")).otherwise(" "), F.when(k % 3 == 1, F.concat(F.lit("/x/"), k.cast("string"))))
    return d.select("doc_id", found["scope_id"].alias("scope_id"), found["scope_type"].alias("scope_type"))


@query("privacy_of_beliefs", f"""WITH {V.BELIEFS_SQL} SELECT belief_id, CASE WHEN egress_policy='hosted_ok' AND visibility NOT IN ('confidential','secret') AND scope_type<>'client' THEN 'workspace' ELSE 'private' END AS privacy_scope FROM beliefs""")
def privacy_of_beliefs(spark, sf_dir):
    return V.beliefs(spark, sf_dir).select("belief_id", S.privacy_of_scope().alias("privacy_scope"))


@query("hosted_projection", """SELECT doc_id AS belief_id, 'kept '||source AS kept, 1 AS n_attributes FROM documents""")
def hosted_projection(spark, sf_dir):
    b = V.beliefs(spark, sf_dir).withColumn("attributes", F.create_map(F.lit("title"), F.concat(F.lit("kept "), "source"), F.lit("path"), F.lit("/secret")))
    found = packet.hosted_projection(b, ("belief_id", "attributes"), ("title",))
    return found.select("belief_id", F.col("attributes")["title"].alias("kept"), F.size("attributes").alias("n_attributes"))


@query("gated_get", f"""WITH {V.BELIEFS_SQL} SELECT belief_id FROM beliefs WHERE belief_id IN (3, 5, 10, 11, 12, 20, 25) AND (scope_type='global' OR scope_id IN {IDS})""")
def gated_get(spark, sf_dir):
    beliefs = V.beliefs(spark, sf_dir)
    return packet.gated_get(beliefs, ["3", "5", "10", "11", "12", "20", "25", "999999999"], S.scope_gate(CONTEXT)).select("belief_id")


@query("teacher_package", f"""WITH {V.BELIEFS_SQL} SELECT belief_id AS evidence_id FROM beliefs WHERE egress_policy='hosted_ok' AND visibility NOT IN ('confidential','secret') AND scope_type<>'client' ORDER BY belief_id LIMIT 20""")
def teacher_package(spark, sf_dir):
    return packet.teacher_request(V.beliefs(spark, sf_dir).withColumnRenamed("belief_id", "evidence_id")).select("evidence_id")


@query("anchored_excerpts", """WITH t AS (SELECT doc_id, text, instr(lower(text), 'the ') AS place FROM documents) SELECT doc_id, sha256(substring(text, greatest(1, place - 50)::BIGINT, 200)) AS excerpt_sha256 FROM t""")
def anchored_excerpts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(packet.anchored_excerpt(F.col("text"), F.lit("THE "), 200), 256).alias("excerpt_sha256"))


@query("digest_of_beliefs", f"""WITH {V.BELIEFS_SQL}, r AS (SELECT belief_id, CASE belief_id % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'stale' ELSE 'archived' END AS status, pinned FROM beliefs)
    SELECT belief_id, status, row_number() OVER (PARTITION BY status ORDER BY pinned DESC, lpad((belief_id % 50)::VARCHAR, 3, '0') DESC, belief_id) AS rank FROM r QUALIFY rank <= 10""")
def digest_of_beliefs(spark, sf_dir):
    k = F.col("belief_id")
    b = V.beliefs(spark, sf_dir).withColumn("status", V.pick(k % 3, "current", "stale", "archived")).withColumn("last_compiled_at", F.lpad((k % 50).cast("string"), 3, "0"))
    return packet.digest_lists(b).select("belief_id", "status", F.col("rank").cast("long").alias("rank"))


@query("managed_excerpt", """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 97 AS score, '- '||o_orderpriority AS line FROM orders WHERE o_orderkey % 5 = 0), h AS (SELECT * FROM r ORDER BY score DESC, id LIMIT 200),
    u AS (SELECT *, row_number() OVER w AS nth, sum(length(line) + 1) OVER w AS used FROM h WINDOW w AS (ORDER BY score DESC, id)) SELECT string_agg(line, chr(10) ORDER BY nth) AS excerpt FROM u WHERE used <= 1200 OR nth = 1""")
def managed_excerpt(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(k.alias("knowledge_id"), (k % 97).alias("promote_score"), F.col("o_orderpriority").alias("body"), (k % 5 == 0).alias("inject"))
    return packet.managed_excerpt(rows, 1200).select("excerpt")


# ---- knowledge pages and upkeep -------------------------------------------------------------------------------------


@query("knowledge_pages", """WITH e AS (SELECT user_id AS k, string_agg('- '||event_type||CASE WHEN event_id % 2 = 0 THEN ' (/e/'||event_id||')' ELSE '' END, chr(10) ORDER BY '- '||event_type||CASE WHEN event_id % 2 = 0 THEN ' (/e/'||event_id||')' ELSE '' END) AS l FROM events WHERE event_id % 20 = 0 OR event_type = 'signup' GROUP BY 1)
    SELECT doc_id AS knowledge_id, sha256('# '||source||chr(10)||chr(10)||text||coalesce(chr(10)||chr(10)||'## Evidence'||chr(10)||l, '')) AS page_sha256 FROM documents LEFT JOIN e ON k = doc_id""")
def knowledge_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("knowledge_id"), F.col("source").alias("title"), F.col("text").alias("body"))
    e = table(spark, sf_dir, "events").where("event_id % 20 = 0 or event_type = 'signup'")
    e = e.select(F.col("user_id").alias("knowledge_id"), F.col("event_type").alias("claim"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/e/"), F.col("event_id").cast("string"))).alias("source_uri"))
    return admin.markdown(d, e).select("knowledge_id", F.sha2("page", 256).alias("page_sha256"))


@query("approval_packet", """WITH p AS (SELECT event_id AS s, 'evt_'||event_id AS proposal_id, 'bel_'||user_id AS b, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS written, user_id FROM events WHERE event_type='view'),
    d AS (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type='view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS prop FROM events),
    n AS (SELECT *, row_number() OVER (ORDER BY s) AS nth FROM p WHERE s NOT IN (SELECT prop FROM d WHERE event_type='purchase' AND prop IS NOT NULL)) SELECT proposal_id, nth||'. '||b||' ('||written||')' AS line FROM n WHERE nth <= 20""")
def approval_packet(spark, sf_dir):
    from evergrain.operators import log

    return admin.approval_lines(log.proposals(V.event_log(spark, sf_dir)))


@query("quarantine_released", "SELECT o_orderkey AS knowledge_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey NOT IN (3, 6, 32) THEN 'spike' END AS quarantine_reason FROM orders")
def quarantine_released(spark, sf_dir):
    k = F.col("knowledge_id")
    rows = V.knowledge(spark, sf_dir).withColumn("quarantine_reason", F.when(k % 3 == 0, "spike"))
    return admin.release_quarantine(rows, ["3", "6", "32"], "human").select("knowledge_id", "quarantine_reason")


@query("public_findings", """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'a/.env' ELSE 'a/b.md' END AS path, CASE WHEN doc_id % 4 = 0 THEN 'ask Wombat about it' WHEN doc_id % 7 = 0 THEN 'token: abcdefgh' ELSE 'plain line' END AS line FROM documents)
    SELECT doc_id AS line_no, unnest(list_filter([CASE WHEN path = 'a/.env' THEN 'forbidden_path' END, CASE WHEN line LIKE 'token:%' THEN 'secret_leak' END, CASE WHEN line LIKE '%Wombat%' THEN 'denied_word' END], lambda x: x IS NOT NULL)) AS finding FROM l""")
def public_findings(spark, sf_dir):
    k = F.col("doc_id")
    lines = table(spark, sf_dir, "documents").select(k.alias("line_no"), F.when(k % 10 == 0, "a/.env").otherwise("a/b.md").alias("path"), F.when(k % 4 == 0, "ask Wombat about it").when(k % 7 == 0, "token: abcdefgh").otherwise("plain line").alias("line"))
    return admin.public_findings(lines, ["wombat", "numbat"]).select("line_no", "finding")


@query("backfilled_rows", """SELECT 'legacy:know_'||o_orderkey AS belief_id, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'project:fast' WHEN o_orderkey % 2 = 0 THEN 'project:own' ELSE 'legacy:unscoped' END AS scope_id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0""")
def backfilled_rows(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    ident = F.concat(F.lit("know_"), k.cast("string"))
    legacy = o.select(ident.alias("id"), F.col("o_orderpriority").alias("body"), V.pick(k % 3, "current", "stale", "candidate").alias("status"), F.when(k % 2 == 0, "own").alias("project"), F.lit(None).cast("string").alias("path"), F.col("o_orderdate").alias("updated_at"))
    beliefs = o.where(k % 4 == 0).select(F.concat(F.lit("legacy:"), ident).alias("belief_id"))
    return admin.backfill(legacy, beliefs, [("urgent", "fast")]).select("belief_id", F.col("scope.scope_id").alias("scope_id"))


@query("short_vectors", """WITH v AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v) SELECT vec_id, round(e[1] / norm, 6) AS first, round(e[16] / norm, 6) AS last, 16 AS dims FROM n""")
def short_vectors(spark, sf_dir):
    """The first 16 numbers of each vector, scaled to length 1."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", retrieval.normalised(F.col("embedding"), 16).alias("v"))
    return e.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", 16), 6).alias("last"), F.size("v").alias("dims"))


@query("user_turn_kinds", """WITH t AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS b, conv_id % 5 AS k FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, CASE k WHEN 0 THEN 'injected' WHEN 1 THEN 'envelope' WHEN 2 THEN 'media' ELSE 'bare' END AS kind, CASE k WHEN 0 THEN sha256('[Cron] '||b) WHEN 2 THEN sha256('[image]') ELSE sha256(b) END AS text_sha256 FROM t""")
def user_turn_kinds(spark, sf_dir):
    c, k = table(spark, sf_dir, "conversations").where("role = 'user'"), F.col("conv_id") % 5
    head = 'Sender (untrusted metadata):\n```json\n{"id": "7"}\n```\n'
    said = F.when(k == 0, F.concat(F.lit("[Cron] "), "text")).when(k == 1, F.concat(F.lit(head), "text")).when(k == 2, F.lit(" [image] ")).when(k == 3, F.concat(F.lit("[Mon 2024-01-01 10:00 UTC] "), "text")).otherwise(F.col("text"))
    found = transcripts.classify_user(said)
    return c.select("conv_id", "turn", F.explode(F.array(found)).alias("x")).select("conv_id", "turn", "x.kind", F.sha2("x.text", 256).alias("text_sha256"))


@query("topic_words", r"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_./:-]{2,}'), lambda w: regexp_replace(w, '^[./:-]+|[./:-]+$', '', 'g')) AS w FROM documents)
    SELECT doc_id, len(list_filter(list_distinct(w), lambda x: length(x) >= 3 AND x NOT IN ('the','and','for','that','this','with','from','have','was','are','not','you','your','but'))) AS n_topics FROM t""")
def topic_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(factory.topic_tokens(F.col("text"))).cast("long").alias("n_topics"))
