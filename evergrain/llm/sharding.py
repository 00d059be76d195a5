"""Contiguous shards of near-equal bytes from global prefix sums.

Texts whose copies take up a good part of a shard come first: each such group is placed in the shard with most room, largest
first, and stays whole. All other rows are in the order of their text's digest, then id, so that equal texts lie side by
side, and this order is cut at the room that each shard has left. It falls into segments that never depend on where a task ran: the leading
digits of the digest, and for a large group a segment for each slice of its ids. One small table of segment totals gives
every segment the bytes and rows before it; the running sums inside a segment are window functions of that segment only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

#: Segments by leading digits: 16 ** 4. Slices of a large group.
LEAD = 4
SLICES = 64


def _homes(groups: list[tuple[str, int]], n_shards: int, bytes_all: int) -> tuple[dict[str, int | None], list[float]]:
    """The shard of each large group (None: larger than a shard's share, so it is cut), and where the other rows' order is cut.

    The largest goes first, each to the shard with least in it. What is left of all bytes is poured over the shards to one level.
    """
    share = bytes_all / n_shards
    load = [0] * n_shards
    home: dict[str, int | None] = {}
    for digest, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        home[digest] = None
        if size <= share:
            home[digest] = min(range(n_shards), key=lambda s: (load[s], s))
            load[home[digest]] += size
    rest = bytes_all - sum(load)
    heights = sorted(load)
    level = next(x for k in range(n_shards, 0, -1) if (x := (rest + sum(heights[:k])) / k) >= heights[k - 1])
    cuts = [0.0]
    for s in range(n_shards):
        cuts.append(cuts[-1] + max(0.0, level - load[s]))
    return home, cuts[1:-1]


def byte_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", large_share: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, text_sha256 for every row.

    size is the UTF-8 bytes of the text plus 1 (null text: 1, crc32 of no bytes). Law `bytes`: sizes are near equal. Rows of
    equal texts share a shard: groups of over large_share of a shard's share of all bytes are placed first, the others go where
    the middle of their group lies. Only a group that is larger than that share is cut, for no shard can hold it in
    balance. slot counts from 0 without gaps in each shard. grown_shard is null, as only the law `key` has it. Ties in
    text and id are ordered by nothing else: such rows are equal in every column but slot. Null ids come first in their
    group. An empty table gives an empty result; with fewer rows than shards some shards stay empty.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"),
    )
    rows = written(rows, "shard-rows", compression="zstd")
    bytes_all = max(1, int(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]))

    groups = rows.groupBy("text_sha256").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * n_shards > F.lit(large_share) * bytes_all)
    large = [(r["text_sha256"], r["bytes"]) for r in groups.collect()]  # fewer than n_shards / large_share rows
    homes, cuts = _homes(large, n_shards, bytes_all)
    homes_of = spark.createDataFrame([(d, True, h) for d, h in homes.items()], "text_sha256 string, large boolean, home int")
    slice_ = F.lpad(F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("string"), 3, "0")
    lead = F.substring("text_sha256", 1, LEAD)
    placed = rows.join(F.broadcast(homes_of), "text_sha256", "left").withColumn(
        "segment", F.when(F.col("large"), F.concat_ws("/", lead, "text_sha256", slice_)).otherwise(lead)
    )

    totals = placed.groupBy("segment", "home").agg(F.sum("size").alias("seg_bytes"), F.count(F.lit(1)).alias("seg_rows"))
    totals = written(totals, "shard-segments")  # at most 16 ** LEAD + SLICES * n_shards / large_share rows
    before = Window.partitionBy("home").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "segment",
        F.coalesce(F.sum("seg_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("seg_rows").over(before), F.lit(0)).alias("rows_before"),
    )
    inside = Window.partitionBy("segment").orderBy("text_sha256", "doc_id")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alike = Window.partitionBy("segment", "text_sha256")
    summed = placed.select(
        "*",
        F.sum("size").over(running).alias("through"),
        (F.row_number().over(inside) - 1).alias("nth"),
        F.sum("size").over(alike).alias("group_bytes"),
    ).withColumn("group_start", F.min(F.col("through") - F.col("size")).over(alike))
    middle = F.when(F.col("large"), F.col("through") - F.col("size") / 2).otherwise(F.col("group_start") + F.col("group_bytes") / 2)
    passed = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= F.col("bytes_before") + middle)) if cuts else F.lit(0)
    cut = summed.join(F.broadcast(starts), "segment").select(
        "doc_id", "size", "text_crc32", "text_sha256", "home", F.coalesce("home", passed).cast("int").alias("shard"), (F.col("rows_before") + F.col("nth")).alias("at")
    )
    cut = written(cut, "shard-cut", compression="zstd")
    firsts = cut.groupBy("shard").agg(  # one row a shard
        F.min(F.when(F.col("home").isNull(), F.col("at"))).alias("first"), F.count("home").alias("ahead")
    )
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.when(F.col("home").isNull(), F.col("at") - F.col("first") + F.col("ahead")).otherwise(F.col("at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "text_sha256",
    )
