"""Queries op1 to op13 over the driver's tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, licenses, media, merkle, mixing, ngram_join, quality, repair, sharding, substring_dedup, suffix_array


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated_words(_documents(spark, sf_dir))
    return found.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths of their own: source, thousand and hundred of the id stand for directories, and the first
    document of each hundred of ids (id divisible by 100) stands for its directory's licence file."""
    docs = _documents(spark, sf_dir)
    return licenses.scan_licenses(docs, licenses.document_path(docs), is_licence_file=F.col("doc_id") % 100 == 0)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_media(_documents(spark, sf_dir))
    return stored.select(
        "doc_id",
        F.col("n_bytes").cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(_documents(spark, sf_dir))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array.remove_repeated_bytes(_documents(spark, sf_dir))
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and one more, numbered -7, whose texts are marks of the template."""
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    more = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), said) for k, role in enumerate(("user", "assistant"))]
    more = spark.range(1).select(F.explode(F.array(*more)).alias("t")).select("t.*")
    turns = _conversations(spark, sf_dir).select("conv_id", "turn", "role", "text").unionByName(more)
    read = chat.read_back(chat.format_chats(turns))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(_documents(spark, sf_dir)))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table; one that the damage leaves without rows has zeros, an empty audit and the hash of nothing."""
    turns = _conversations(spark, sf_dir)
    found, edited = repair.repair(repair.damage(turns))
    hashes = repair.digests(edited)
    whole = turns.select("conv_id").distinct().withColumnRenamed("conv_id", "id")
    out = whole.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("id").cast("string").eqNullSafe(F.col("key")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_license_scan": op3_license_scan,
    "op4_bpe": op4_bpe,
    "op5_media": op5_media,
    "op6_mix": op6_mix,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_shards": op9_shards,
    "op10_suffix_array": op10_suffix_array,
    "op11_chat": op11_chat,
    "op12_merkle": op12_merkle,
    "op13_repair": op13_repair,
}

ORACLES = {
    "op8_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t
    """,
    "op11_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), r AS (
            SELECT *, lag(role) OVER w IS DISTINCT FROM role OR lag(role) OVER w IS NULL AS opens,
                   length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*(?:/?INST|/?SYS|/?ROLE|TEXT|TURN)\]')) AS chars
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), m AS (
            SELECT *, chars + CASE WHEN NOT opens THEN 6 WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 4
                                   ELSE 19 + length(role) END AS shown
            FROM r
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(shown) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id
    """,
    "op12_merkle": r"""
        WITH RECURSIVE fields AS (
            SELECT doc_id, source, text, {doc_id} || {source} || {lang} || {n_chars} AS head, {text} AS tail, {bare} AS altered_tail,
                   list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(str_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END) AS crc
            FROM documents
        ), hashed AS (
            SELECT doc_id, source, sha256(head || tail) AS leaf, sha256(head || CASE WHEN crc % 2 = 1 THEN altered_tail ELSE tail END) AS altered FROM fields
        ), leaves AS (
            SELECT *, coalesce('+' || source, '') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
            FROM hashed
        ), nodes AS (
            SELECT grp, 0 AS lvl, pos, n, leaf AS node FROM leaves
            UNION ALL
            SELECT grp, lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY grp, lvl, pos // 3
        ), subs AS (
            SELECT grp, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
        ), over_nodes AS (
            SELECT 0 AS lvl, pos, n, subroot AS node FROM subs
            UNION ALL
            SELECT lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM over_nodes WHERE n > 1 GROUP BY lvl, pos // 3
        ), every AS (
            SELECT 'below ' || grp AS tree, lvl, pos, n, node FROM nodes UNION ALL SELECT 'over', lvl, pos, n, node FROM over_nodes
        ), steps AS (
            SELECT tree, lvl, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM every WHERE n > 1 WINDOW w AS (PARTITION BY tree, lvl, pos // 3 ORDER BY pos)
        ), found AS (
            SELECT a.grp, a.pos, a.doc_id, a.leaf, a.altered, s.subroot,
                   list(p.l || '|' || p.r ORDER BY p.tree <> 'over' DESC, p.lvl) FILTER (WHERE p.tree IS NOT NULL) AS proof
            FROM leaves a JOIN subs s USING (grp)
            LEFT JOIN steps p ON p.tree = 'below ' || a.grp AND p.pos = a.pos // CAST(3 ** p.lvl AS BIGINT) OR p.tree = 'over' AND p.pos = s.pos // CAST(3 ** p.lvl AS BIGINT)
            GROUP BY a.grp, a.pos, a.doc_id, a.leaf, a.altered, s.subroot
        ), back AS (
            SELECT *, sha256(replace(coalesce(array_to_string(proof, ''), ''), '|', '')) AS proof_sha256,
                   list_reduce(list_prepend(altered, coalesce(proof, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
            FROM found
        )
        SELECT doc_id, leaf, subroot, node AS root, proof_sha256, folded_root, folded_root = node AS verified FROM back, (SELECT node FROM over_nodes WHERE n = 1)
    """,
}

ORACLES["op12_merkle"] = ORACLES["op12_merkle"].format(
    **{c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", "text")},
    bare="CASE WHEN text IS NULL THEN '-' ELSE strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') END",
)
