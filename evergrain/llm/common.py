"""Shared folder, written tables and text units used by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of ASCII white space, and of everything else, as Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset a local master gets a temporary folder of its own; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="evergrain-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evergrain/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path  # type: ignore[attr-defined]
    return table


def discard(table: DataFrame) -> None:
    """Deletes what written() stored, once later tables hold all that is wanted of it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """df with a column for each of sums: its sum over the rows before, in the order given, which tells all rows apart.

    The rows are dealt to ranges of the order and written with their range's number; the totals of the ranges, a row each,
    are summed in one task, and the rows of a range by a window of that range only.
    """
    width = shuffle_width(df.sparkSession)
    dealt = df.select("*", *[c.alias(f"__{k}") for k, c in sums.items()]).repartitionByRange(width, *order)
    dealt = written(dealt.withColumn("__range", F.spark_partition_id()), name, compression="zstd")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__range").agg(*[F.sum(f"__{k}").alias(k) for k in sums])
    starts = totals.select("__range", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__upto_{k}") for k in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.join(F.broadcast(starts), "__range")  # a row a shuffle partition
    out = [(F.col(f"__upto_{k}") + F.coalesce(F.sum(f"__{k}").over(inside), F.lit(0))).alias(k) for k in sums]
    return summed.select(*df.columns, *out)
