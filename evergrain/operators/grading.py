"""Grading under caps: what is asked is told by a hash, what was answered is not asked again, and a run admits what its budgets hold.

Requests are admitted in order while the sums of their items and costs stay within the caps of the run and what the day has
left; nothing after the first that does not fit is. The sums are made over ranges, so no task sees all requests. Answers
go to a ledger, whose newest version holds them and the day's spending together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrain.sources.store import Store

from .sums import sums_before

ANSWERS = "request_hash string, example_id string, score double, cost long, day string"


@dataclass(frozen=True)
class Caps:
    run_items: int = 200
    day_items: int = 1000
    run_cost: int = 2_000_000
    day_cost: int = 10_000_000


def request_hash(model: str, prompt_version: str, rubric: Column, text: Column) -> Column:
    """What a request asks: model, version of the prompt, rubric and text, each with its length."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(*[part(c) for c in (F.lit(model), F.lit(prompt_version), rubric, F.coalesce(text, F.lit("")))]), 256)


class GradeLedger:
    """Answers below a folder, by request."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def answers(self) -> DataFrame:
        m = self.store.current()
        if m is None:
            return self.spark.createDataFrame([], ANSWERS)
        return self.spark.read.schema(ANSWERS).parquet(*[f"{self.store.root}/{p}" for p in m["answers"]])

    def spent(self, day: str) -> tuple[int, int]:
        """Items and cost of a day."""
        m = self.store.current()
        items, cost = ((m or {}).get("spent") or {}).get(day, (0, 0))
        return items, cost

    def admit(self, candidates: DataFrame, day: str, caps: Caps = Caps(), order: tuple[str, ...] = ("priority", "example_id")) -> DataFrame:  # noqa: B008
        """request_hash, example_id, cost and nth (from 1) of the requests that a run may send now.

        candidates: example_id, request_hash, cost and the columns of the order, which tells rows apart. Of equal requests the first is
        sent for all. The order is ascending, nulls first.
        """
        done_items, done_cost = self.spent(day)
        items = max(0, min(caps.run_items, caps.day_items - done_items))
        cost = max(0, min(caps.run_cost, caps.day_cost - done_cost))
        new = candidates.join(self.answers().select("request_hash").distinct(), "request_hash", "left_anti")
        shown = list(dict.fromkeys([*order, "cost", "example_id"]))
        new = new.groupBy("request_hash").agg(F.min(F.struct(*shown)).alias("r")).select("request_hash", *[F.col(f"r.{c}").alias(c) for c in shown])
        summed = sums_before(self.store, new, list(order), {"__items": F.lit(1), "__cost": F.col("cost")})
        # sums grow with the order where costs are not negative, so what fits is a beginning of it
        fits = summed.where((F.col("__items") < items) & (F.col("__cost") + F.col("cost") <= cost))
        return fits.select("request_hash", "example_id", "cost", (F.col("__items") + 1).cast("long").alias("nth"))

    def record(self, answers: DataFrame, day: str) -> int:
        """Adds answers (request_hash, example_id, score, cost) that are not in the ledger; how many those were."""
        now = self.store.current()
        new = answers.dropDuplicates(["request_hash"]).join(self.answers().select("request_hash"), "request_hash", "left_anti")
        path = self.store.stage(new.select("request_hash", F.col("example_id").cast("string").alias("example_id"), F.col("score").cast("double").alias("score"), F.col("cost").cast("long").alias("cost"), F.lit(day).alias("day")), "answers")
        n, cost = self.store.read(path, ANSWERS).agg(F.count(F.lit(1)), F.coalesce(F.sum("cost"), F.lit(0))).first()
        if not n:
            return 0
        items, spent = self.spent(day)
        made = {"answers": (now["answers"] if now else []) + [path], "spent": ((now or {}).get("spent") or {}) | {day: [items + n, spent + cost]}}
        self.store.publish(made, now)
        return n
