"""Connected components of links between whole numbers, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _towards_least(edges: DataFrame) -> DataFrame:
    """Each neighbour v of u joined to the least of u and its neighbours."""
    return edges.join(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "u")


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, root) for every node of a link that is not the least of its component; root is the least.

    links has two columns of longs; a link of a node to itself, repeated links and their direction do not matter. Nothing
    is collected: each round is two aggregations and joins over the remaining links, written to the shared folder, until
    a round changes nothing. The tables of a round go when the next one is written.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = written(pairs, name)
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), f"{name}-large")
        small = _towards_least(large)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select("e.*")
        discard(pairs)
        pairs = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        discard(large)
        seen = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("u")).first()
        if seen == state or seen[0] == 0:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
