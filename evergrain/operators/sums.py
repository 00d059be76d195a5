"""Sums of the rows before, over a whole table: no window runs over more than a range of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evergrain.sources.store import Store


def sums_before(store: Store, df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of sums: its sum over the rows before, in the order given (ascending), which tells all rows apart.

    The rows are dealt to ranges of the order and staged with their range's number; the totals of the ranges, a row each, are
    summed first and give each range its start.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select("*", *[c.alias(f"__{k}") for k, c in sums.items()]).repartitionByRange(width, *order).withColumn("__range", F.spark_partition_id())
    dealt = store.read(store.stage(dealt, "dealt"), dealt.schema)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = dealt.groupBy("__range").agg(*[F.sum(f"__{k}").alias(k) for k in sums])
    starts = totals.select("__range", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__upto_{k}") for k in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = [(F.col(f"__upto_{k}") + F.coalesce(F.sum(f"__{k}").over(inside), F.lit(0))).alias(k) for k in sums]
    return dealt.join(F.broadcast(starts), "__range").select(*df.columns, *out)
