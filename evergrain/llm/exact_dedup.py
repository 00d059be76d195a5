"""Exact deduplication by a log-structured merge index of text digests.

Memtables are the map-side partial aggregates of each task; they flush to runs, Parquet files sorted by digest. Compaction merges
runs into a level, keeping the smallest identifier and the count of each digest; levels are merged in the same way, so a
later batch costs its own size. A level's filter is a bitmap of its digests, sized by their number and at most 64 MB: rows
that miss it are no hits and go no further. Texts of hits are compared byte by byte. Should two different texts ever
share a digest, the rows of that digest are grouped again by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, text_of, written

#: A filter's piece of bits, bits for each digest, and most pieces (of 4 KB); beyond, more rows pass, and no result changes.
PIECE = 32768
BITS_EACH = 16
MOST_PIECES = 16384


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def digest_of(text: Column, nibbles: int = 64) -> Column:
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, nibbles)


def filter_of(level: DataFrame) -> tuple[DataFrame, int]:
    """The bitmap of a level's digests, a row for each piece of it that has a digest, and its number of pieces."""
    pieces = max(1, min(MOST_PIECES, -(-level.count() * BITS_EACH // PIECE)))
    slot = F.pmod(F.xxhash64("digest"), F.lit(pieces * PIECE))
    bits = level.groupBy((slot / PIECE).cast("int").alias("piece")).agg(F.bitmap_construct_agg((slot % PIECE).cast("long")).alias("bits"))
    return written(bits, "filter"), pieces


def probe(rows: DataFrame, found: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose digest may be in the level of the filter. The side that is broadcast is the bitmap, 64 MB at most."""
    bits, pieces = found
    slot = F.pmod(F.xxhash64("digest"), F.lit(pieces * PIECE))
    at = slot % PIECE
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    near = rows.withColumn("piece", (slot / PIECE).cast("int")).join(F.broadcast(bits), "piece")
    return near.where(F.floor(byte / F.pow(F.lit(2.0), at % 8)) % 2 == 1).drop("piece", "bits")


def flush(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_nibbles: int = 64) -> DataFrame:
    """Runs of docs: doc_id, text_sha256, row_no and digest, sorted by digest in each file."""
    text = F.encode(normalised(text_of(text_col)), "UTF-8")
    memtable = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row_no"))
    memtable = memtable.withColumn("digest", F.substring("text_sha256", 1, digest_nibbles))
    return written(memtable.sortWithinPartitions("digest"), "runs", compression="zstd")


def compact(*parts: DataFrame) -> DataFrame:
    """A level (digest, first, group_size) of runs and older levels: of each digest the smallest identifier and the count.

    Ids compare as values and a null id comes last; of levels that both hold the smallest id the first one's row is it.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("age"), "row_no")
    levels = []
    for age, part in enumerate(parts):
        if "first" in part.columns:
            one = F.struct("first.no_id", "first.doc_id", F.lit(age).alias("age"), "first.row_no").alias("first")
            levels.append(part.select("digest", one, "group_size"))
        else:
            aged = part.withColumn("age", F.lit(age))
            levels.append(aged.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size")))
    level = levels[0]
    for other in levels[1:]:
        level = level.unionByName(other)
    if len(levels) > 1:
        level = level.groupBy("digest").agg(F.min("first").alias("first"), F.sum("group_size").alias("group_size"))
    return written(level.sortWithinPartitions("digest"), "level", compression="zstd")


def add_batch(level: DataFrame, kept: DataFrame, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """A later batch against the index: (batch without texts that kept or the batch itself has before, the merged level).

    level: compact() of what came before; kept: the documents that stayed then. Of kept only rows that pass the filter of the batch's
    digests are read on, and their texts are compared with those of the batch. A document of kept is never replaced by one
    of the batch with a smaller id. Columns of batch stay.
    """
    runs = flush(batch, id_col, text_col)
    new = compact(runs)
    asked = probe(new, filter_of(level)).select("digest")
    hits = written(level.join(asked, "digest", "left_semi").select("digest"), "hits")
    old = probe(kept.select(normalised(text_of(text_col)).alias("norm")).withColumn("digest", digest_of(F.col("norm"))), filter_of(hits))
    old = old.select(F.col("digest").alias("__of"), F.col("norm").alias("__text")).distinct()
    once = drop_duplicates(batch, id_col, text_col)
    norm = normalised(text_of(text_col))
    left = once.join(old, (digest_of(norm) == F.col("__of")) & (norm == F.col("__text")), "left_anti")
    return left.select(batch.columns), compact(level, new)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_nibbles: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Texts are equal when identical after each run of ASCII white space becomes
    one space. The smallest id of a group stays, ids compare as values and a null id comes last; of rows
    that repeat the staying id one stays. An empty table gives an empty result, other columns are ignored.
    digest_nibbles shortens the digest for tests of the collision path; text_sha256 is always the full one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_of(text_col)).alias("norm"))
    runs = flush(docs, id_col, text_col, digest_nibbles)
    level = compact(runs)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.lit(0).alias("age"), "row_no")

    hits = level.where("group_size > 1").select("digest")
    probed = probe(rows.withColumn("digest", digest_of(F.col("norm"), digest_nibbles)), filter_of(hits))
    compared = probed.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    clashing = written(compared.where("low <> high").select("digest"), "clashes")

    found = runs.join(level, "digest")
    if not clashing.isEmpty():  # two texts share a digest: the rows of that digest are grouped by the text itself
        again = rows.withColumn("digest", digest_of(F.col("norm"), digest_nibbles)).join(clashing, "digest", "left_semi")
        again = written(again.withColumn("row_no", F.monotonically_increasing_id()), "again")
        by_text = again.groupBy("norm").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
        again = again.join(by_text, "norm").withColumn("text_sha256", F.sha2(F.encode("norm", "UTF-8"), 256))
        found = found.join(clashing, "digest", "left_anti").select(again.drop("norm").columns).unionByName(again.drop("norm"))
    return found.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("first.row_no") == F.col("row_no")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates() drops; every column stays. Rows that repeat both the
    staying id and its text are one row afterwards."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"))
    rows = docs.withColumn("__of", digest_of(normalised(text_of(text_col))))
    rows = rows.join(kept, (F.col("__of") == F.col("__digest")) & F.col(id_col).eqNullSafe(F.col("__id")))
    nth = F.row_number().over(Window.partitionBy("__digest", "__id").orderBy(F.lit(0)))
    return rows.withColumn("__nth", nth).where("__nth = 1").select(docs.columns)
