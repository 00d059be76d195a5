"""Scans of texts that are kept: each distinct text meets the leak and injection patterns once, whatever asks for it later.

A text is known by the SHA-256 of its bytes. learn() looks for texts whose hash is not known yet, scans those and publishes
their hashes, and apart from them the few that something was found in. Flags of any table are then a join with the few.
What is kept holds for one state of the patterns; another state is another store.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrain.functions import text as T
from evergrain.sources.store import Store

#: As many folders of later texts are read together before they are merged.
MERGE_AFTER = 16
FOUND = "hash binary, leaks array<string>, injections array<string>"


def rules_version() -> str:
    """What tells these patterns from others."""
    return hashlib.sha256(repr((T.LEAKS, T.INJECTIONS, T._WORD, T._SPACE)).encode()).hexdigest()[:16]


def hash_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class ScanStore:
    """Hashes of texts that have been scanned, and what was found in which."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, f"{root}/{rules_version()}")

    def _all(self, m: dict | None, name: str, schema: str) -> DataFrame:
        out = self.spark.range(0).selectExpr(*[f"cast(null as {c.split(' ', 1)[1]}) as {c.split(' ', 1)[0]}" for c in schema.split(", ")]) if m is None else self.store.read(m[name][0], schema)
        for path in m[name][1:] if m else []:
            out = out.unionByName(self.store.read(path, schema))
        return out

    def learn(self, *texts: tuple[DataFrame, Column]) -> int:
        """Scans what is not known yet among texts (frame, column); how many distinct texts that was."""
        m = self.store.current()
        rows = None
        for df, column in texts:
            part = df.select(F.coalesce(column, F.lit("")).alias("text")).select(hash_of(F.col("text")).alias("hash"), "text")
            rows = part if rows is None else rows.unionByName(part)
        new = rows.select("hash").distinct().join(self._all(m, "known", "hash binary"), "hash", "left_anti")
        path = self.store.stage(new, "known")
        new = self.store.read(path, "hash binary")
        n = new.count()
        if not n:
            return 0
        once = rows.join(new, "hash", "left_semi").groupBy("hash").agg(F.first("text").alias("text"))
        found = once.select("hash", T.secret_leaks(F.col("text")).alias("leaks"), T.injections(F.col("text")).alias("injections")).where("size(leaks) > 0 or size(injections) > 0")
        made = {"known": (m["known"] if m else []) + [path], "found": (m["found"] if m else []) + [self.store.stage(found, "found")]}
        if len(made["known"]) > MERGE_AFTER:
            made = {"known": [self.store.stage(self._all(made, "known", "hash binary"), "known")], "found": [self.store.stage(self._all(made, "found", FOUND), "found")]}
        self.store.publish(made, m)
        return n

    def flags(self, df: DataFrame, text: Column) -> DataFrame:
        """df with leaks and injections, the names found in the text; all of df's texts have been learned."""
        none = F.array().cast("array<string>")
        found = self._all(self.store.current(), "found", FOUND).withColumnRenamed("hash", "__hash")
        rows = df.withColumn("__hash", hash_of(text)).join(found, "__hash", "left").drop("__hash")
        return rows.withColumn("leaks", F.coalesce("leaks", none)).withColumn("injections", F.coalesce("injections", none))
