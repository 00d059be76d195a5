"""Exact neighbours from cells against a scan."""

import uuid

import numpy as np
import pytest

from evergrain.operators import retrieval
from evergrain.operators.vectors import VectorStore

SCHEMA = "vec_id long, embedding array<double>"


def clustered(n, seed=3, dims=6):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(8, dims))
    rows = [(int(i), (centres[i % 8] + rnd.normal(size=dims) * 0.05).tolist()) for i in range(n)]
    rows += [(n, [0.0] * dims), (n + 1, [0.0] * dims)] + [(n + 2 + j, rows[5][1]) for j in range(30)]
    return rows


@pytest.mark.parametrize(("k", "block"), [(5, 20_000), (40, 25)])
def test_equals_a_scan(spark, tmp_path, k, block):
    rows = spark.createDataFrame(clustered(400), SCHEMA).repartition(3)
    kept = VectorStore(spark, f"{tmp_path}/v{uuid.uuid4().hex}", buckets=4)
    kept.build(rows)
    asked = rows.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as vector")
    key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "vec_id", "similarity").collect()))
    assert key(kept.neighbours(asked, k, digits=6, block=block)) == key(retrieval.cosine_topk(rows, asked, k, digits=6))


def test_eligible_ids_and_skipped_cells(spark, tmp_path):
    rows = spark.createDataFrame(clustered(600), SCHEMA).repartition(3)
    kept = VectorStore(spark, f"{tmp_path}/v", buckets=4)
    kept.build(rows, n_pivots=24)
    asked = rows.where("vec_id in (1, 2, 600)").selectExpr("vec_id as query_id", "embedding as vector")
    some = rows.where("vec_id % 3 = 0").select("vec_id")
    key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "vec_id", "similarity").collect()))
    assert key(kept.neighbours(asked, 4, some, digits=6)) == key(retrieval.cosine_topk(rows.join(some, "vec_id"), asked, 4, digits=6))
    probes = kept.probes(asked.where("query_id < 600"), 4, digits=6).first()
    assert probes["n_looked"] < probes["n_pairs"] / 2
    assert kept.neighbours(asked, 4, some.where("false")).count() == 0


def test_no_vectors(spark, tmp_path):
    kept = VectorStore(spark, f"{tmp_path}/v", buckets=2)
    kept.build(spark.createDataFrame([], SCHEMA))
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>")
    assert kept.neighbours(asked, 3).count() == 0
