"""A kept snapshot of vectors in cells, and exact neighbours that skip cells.

Every vector, scaled to length 1, lies in the cell of its nearest pivot and knows its distance to it. For a query at distance d
from a pivot, no vector of the cell can be nearer than d less the cell's radius, nor than |d - its own distance to the pivot|
(triangle inequality). A search looks into each query's nearest cells until they hold k vectors, which bounds the distance of
its k-th neighbour, and then only into cells, and at vectors of them, that can be within that. The answer is that of a scan.

Pivots are the vectors whose ids hash lowest, about the square root of the number of vectors and MAX_PIVOTS at most; they and a
row for each cell travel with the tasks. A cell of many vectors is searched in blocks. Vectors of length 0 are similar to
nothing (0) and lie in a cell of their own, which every search looks into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrain.sources.store import Store

from .retrieval import BLOCK_ROWS, top

MAX_PIVOTS = 2048
NO_LENGTH = -1
SLACK = 1e-9


def _units(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), float).reshape(len(rows), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (units @ pivots.T), 0.0))


class VectorStore:
    """Vectors by cell below a folder; the newest manifest names the snapshot that searches read."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.store, self.buckets = spark, Store(spark, root), buckets

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", n_pivots: int | None = None, **note) -> dict:
        """Publishes a snapshot of all vectors. note: what the caller wants to find in the manifest again."""
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        n = rows.count()
        wanted = n_pivots or min(MAX_PIVOTS, max(1, round(n**0.5)))
        long = rows.where(F.exists("v", lambda x: x != 0))
        found = long.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()  # no more than MAX_PIVOTS
        pivots = _units(pd.Series([r["v"] for r in found])) if found else np.zeros((0, 1))
        id_type = rows.schema["id"].dataType.simpleString()

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    u = _units(f["v"])
                    short = ~u.any(axis=1)
                    d = _distances(u, pivots) if len(pivots) else np.zeros((len(f), 1))
                    cell = np.where(short, NO_LENGTH, d.argmin(axis=1))
                    yield pd.DataFrame({"id": f["id"], "u": list(u), "cell": cell.astype("int32"), "distance": np.where(short, 0.0, d.min(axis=1))})

        celled = rows.mapInPandas(assign, f"id {id_type}, u array<double>, cell int, distance double")
        path = self.store.stage(celled.withColumn("bucket", F.pmod("cell", F.lit(self.buckets))), "vectors", "bucket")
        made = {"vectors": path, "schema": f"id {id_type}, u array<double>, cell int, distance double, bucket int", "pivots": pivots.tolist(), "n": n}
        return self.store.publish(made | note, self.store.current())

    def _held(self, m: dict, eligible: DataFrame | None) -> DataFrame:
        rows = self.store.read(m["vectors"], m["schema"])
        return rows if eligible is None else rows.join(eligible.select(F.col(eligible.columns[0]).alias("id")), "id", "left_semi")

    def _cells(self, held: DataFrame) -> pd.DataFrame:
        """cell, n, radius: a row for each pivot at most."""
        return held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).toPandas()

    def _planned(self, m: dict, cells: pd.DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """query_id, q, first (cells to look into first), others (other cells, with distance and the least distance of a vector there)."""
        pivots, order = np.array(m["pivots"], float), cells["cell"].to_numpy()
        real = order[order >= 0]
        counts, radius = cells.set_index("cell")["n"], cells.set_index("cell")["radius"]
        zero = [NO_LENGTH] if NO_LENGTH in set(order) else []
        query_type = queries.schema["query_id"].dataType.simpleString()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                units = _units(f["q"]) if len(f) else []
                for qid, u in zip(f["query_id"], units):
                    if not u.any():  # as similar to all: every cell
                        out.append((qid, u, [(int(c), 0.0) for c in order], []))
                        continue
                    d = _distances(u[None], pivots[real])[0] if len(real) else np.zeros(0)
                    least = np.maximum(d - radius.loc[real].to_numpy(), 0.0)
                    at = np.argsort(least, kind="stable")
                    upto = int(np.searchsorted(np.cumsum(counts.loc[real[at]].to_numpy()), k)) + 1
                    head, tail = at[:upto], at[upto:]
                    out.append((qid, u, [(int(real[i]), float(d[i])) for i in head] + [(c, 0.0) for c in zero], [(int(real[i]), float(d[i]), float(least[i])) for i in tail]))
                yield pd.DataFrame(out, columns=["query_id", "q", "first", "others"])

        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("q"))
        return asked.mapInPandas(run, f"query_id {query_type}, q array<double>, first array<struct<cell:int,d:double>>, others array<struct<cell:int,d:double,least:double>>")

    def _looked(self, held: DataFrame, cells: pd.DataFrame, pairs: DataFrame, n_asked: int, k: int, digits: int | None, block: int) -> DataFrame:
        """query_id, id, similarity: the best k of each block for pairs (query_id, q, cell, d, bar: the least similarity that counts)."""
        parts = {int(c): max(1, -(-int(n) // block)) for c, n in zip(cells["cell"], cells["n"])}
        q_parts = max(1, -(-n_asked // block))
        of_cell = F.create_map(*[F.lit(x) for c, p in parts.items() if p > 1 for x in (c, p)]) if any(p > 1 for p in parts.values()) else None
        n_parts = F.coalesce(of_cell[F.col("cell")], F.lit(1)) if of_cell is not None else F.lit(1)
        left = held.select("cell", "id", "u", "distance", F.pmod(F.xxhash64("id"), n_parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("q_part"))
        right = pairs.select("cell", "query_id", "q", "d", "bar", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(q_parts)).cast("int").alias("q_part"))
        left = left.join(right.select("cell", "part", "q_part").distinct(), ["cell", "part", "q_part"], "left_semi")

        def run(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(vectors) and len(asked):
                vectors = vectors.sort_values("id", kind="stable")
                ids, units, own = vectors["id"].to_numpy(), np.array(vectors["u"].tolist(), float), vectors["distance"].to_numpy()
                for at in range(0, len(asked), 256):
                    part = asked.iloc[at : at + 256]
                    near = np.array(part["q"].tolist(), float) @ units.T
                    near = near if digits is None else np.round(near, digits)
                    gap = np.abs(part["d"].to_numpy()[:, None] - own[None, :])
                    possible = (1.0 - gap**2 / 2.0 + SLACK >= part["bar"].to_numpy()[:, None]) | (vectors["cell"].to_numpy() < 0)[None, :]
                    near = np.where(possible, near, -np.inf)
                    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
                    some = pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), best.shape[1]), "id": ids[best].ravel(), "similarity": np.take_along_axis(near, best, 1).ravel()})
                    out.append(some[some["similarity"] > -np.inf])
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "similarity": []})

        keys = ["cell", "part", "q_part"]
        types = pairs.schema["query_id"].dataType.simpleString(), held.schema["id"].dataType.simpleString()
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"query_id {types[0]}, id {types[1]}, similarity double")

    def neighbours(self, queries: DataFrame, k: int, eligible: DataFrame | None = None, id_col: str = "vec_id", digits: int | None = None, block: int = BLOCK_ROWS) -> DataFrame:
        """query_id, id, similarity, rank: the k most similar vectors of each query (query_id, vector), of those that are eligible (ids; all by default).

        Equal similarities (after rounding to `digits`, where given) go by id.
        """
        return self._search(queries, k, eligible, digits, block)[0].withColumnRenamed("id", id_col)

    def probes(self, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
        """One row: pairs of queries and cells, how many a search looks into, and the share of vectors that it looks at."""
        m = self.store.current()
        first, second, cells = self._search(queries, k, None, digits, BLOCK_ROWS)[1:]
        sizes = self.spark.createDataFrame(cells[["cell", "n"]])
        looked = first.select("query_id", "cell").unionByName(second.select("query_id", "cell")).join(F.broadcast(sizes), "cell")  # a row a pivot
        n_queries = queries.count()
        return looked.agg(F.lit(n_queries * len(cells)).alias("n_pairs"), F.count(F.lit(1)).alias("n_looked"), (F.sum("n") / (n_queries * m["n"])).alias("share_of_vectors"))

    def _search(self, queries, k, eligible, digits, block):
        m = self.store.current()
        held = self._held(m, eligible)
        cells = self._cells(held)
        n_asked = queries.count()
        planned = self._planned(m, cells, queries, k)
        path = self.store.stage(planned, "probes")
        planned = self.store.read(path, planned.schema)
        first = planned.select("query_id", "q", F.explode("first").alias("c")).select("query_id", "q", "c.cell", "c.d", F.lit(-2.0).alias("bar"))
        near = self._looked(held, cells, first, n_asked, k, digits, block)
        found = self.store.stage(near, "found")
        near = self.store.read(found, near.schema)
        room = 10.0**-digits if digits is not None else 0.0
        kth = top(near, k, F.desc("similarity"), F.asc("id"), name="__nth").groupBy("query_id").agg(F.min("similarity").alias("kth"), F.count(F.lit(1)).alias("n"))
        bars = kth.select("query_id", F.when(F.col("n") >= k, F.col("kth") - room).otherwise(-2.0).alias("bar"))
        second = planned.select("query_id", "q", F.explode("others").alias("c")).select("query_id", "q", "c.cell", "c.d", "c.least").join(bars, "query_id", "left")
        second = second.withColumn("bar", F.coalesce("bar", F.lit(-2.0))).where(1.0 - F.col("least") * F.col("least") / 2.0 + SLACK >= F.col("bar")).drop("least")
        more = self._looked(held, cells, second, n_asked, k, digits, block)
        answer = top(near.unionByName(more), k, F.desc("similarity"), F.asc("id"))
        return answer, first, second, cells
