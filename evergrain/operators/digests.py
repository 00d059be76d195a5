"""Digests of tables in key order: a hash tree over key ranges, and the place where two copies differ.

A table is cut into ranges of its key, whose bounds one copy gives and the other is cut at too. A range's digest is over the
number of its rows and sums of their hashes, so it combines on the map side and no range, however many rows it has, is
sorted or collected; nodes above hash their children in order. Copies are compared from the root down: only children of
nodes that differ are looked at, and only rows of ranges that differ meet each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of a table (a driver holds their bounds), and children of a node.
RANGES, FANOUT = 1024, 16


def row_hash(columns: list[str]) -> Column:
    """SHA-256 (hex) of a row's columns by name; null is unlike any value."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def bounds(df: DataFrame, key: str, ranges: int = RANGES) -> list:
    """The least key of each range but the first; about equal numbers of rows lie between them."""
    dealt = df.select(key).where(F.col(key).isNotNull()).repartitionByRange(ranges, key)
    found = dealt.groupBy(F.spark_partition_id().alias("range")).agg(F.min(key).alias("least")).collect()  # a row a range
    return sorted(r["least"] for r in found)[1:]


def _range_of(key: str, cuts: list) -> Column:
    """Number of the range that a key lies in; a null key lies in the first."""
    if not cuts:
        return F.lit(0)
    edges = np.array(cuts)

    @F.pandas_udf("int")  # type: ignore[call-overload]
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(dtype=edges.dtype), side="right").astype("int32"))

    return F.when(F.col(key).isNull(), 0).otherwise(number(F.coalesce(F.col(key), F.lit(cuts[0]))))


def _sums(df: DataFrame, key: str, cuts: list) -> DataFrame:
    h = F.col("__h")
    part = lambda k: F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    rows = df.select(F.col(key), row_hash(df.columns).alias("__h")).withColumn("node", _range_of(key, cuts))
    sums = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(part(k)).alias(f"s{k}") for k in range(4)])
    text = F.concat_ws(":", F.col("n_rows").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(4)])
    return sums.select(F.lit(0).alias("level"), "node", "n_rows", F.sha2(text, 256).alias("digest"))


def tree(df: DataFrame, key: str, cuts: list) -> DataFrame:
    """level (0: ranges), node, n_rows, digest of every node; the last level is the root. No more than 17 rows for 16 ranges."""
    level = _sums(df, key, cuts)
    out, n, depth = level, len(cuts) + 1, 0
    while n > 1:
        depth += 1
        up = level.groupBy(F.floor(F.col("node") / FANOUT).cast("int").alias("node")).agg(F.sum("n_rows").alias("n_rows"), F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("kids"))
        level = up.select(F.lit(depth).alias("level"), "node", "n_rows", F.sha2(F.array_join(F.transform("kids", lambda k: F.concat(k["node"].cast("string"), F.lit("="), k["digest"])), ","), 256).alias("digest"))
        out, n = out.unionByName(level), -(-n // FANOUT)
    return out


def table_root(df: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """One row: n_rows and digest of the whole table, equal for equal tables cut at the same bounds (of an empty table: none)."""
    cuts = bounds(df, key, ranges)
    found = tree(df, key, cuts)
    return found.orderBy(F.desc("level")).limit(1).select("n_rows", "digest")


def differing_ranges(a: DataFrame, b: DataFrame, key: str, cuts: list) -> DataFrame:
    """Numbers of the ranges in which two copies differ, found from their roots down."""
    left, right = tree(a, key, cuts), tree(b, key, cuts)
    both = left.select("level", "node", F.col("digest").alias("x")).join(right.select("level", "node", F.col("digest").alias("y")), ["level", "node"], "full_outer")
    unlike = both.where(~F.col("x").eqNullSafe(F.col("y"))).select("level", "node")
    depth, n = 0, len(cuts) + 1
    while n > 1:
        depth, n = depth + 1, -(-n // FANOUT)
    reached = unlike.where(F.col("level") == depth).select("node")
    for k in range(depth - 1, -1, -1):
        below = unlike.where(F.col("level") == k).select("node", F.floor(F.col("node") / FANOUT).cast("int").alias("up"))
        reached = below.join(reached.select(F.col("node").alias("up")), "up", "left_semi").select("node")
    return reached


def differences(a: DataFrame, b: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """key and state of rows in which copy b differs from a: missing, added or changed. A key, null too, occurs once in a table."""
    cuts = bounds(a, key, ranges)
    found = differing_ranges(a, b, key, cuts)

    def rows(df: DataFrame, name: str) -> DataFrame:
        hashed = df.select(F.col(key), row_hash(df.columns).alias(name)).withColumn("node", _range_of(key, cuts))
        return hashed.join(F.broadcast(found), "node", "left_semi").drop("node")  # a row a range at most

    other = rows(b, "y").withColumnRenamed(key, "__key")
    both = rows(a, "x").join(other, F.col(key).eqNullSafe(F.col("__key")), "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select(F.coalesce(key, "__key").alias(key), F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "added").otherwise("changed").alias("state"))
