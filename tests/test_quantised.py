"""The first pass in eight bits loses nothing, and leaves few pairs to compare by their own numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import quantised, retrieval

CHUNK = "chunk_id string, knowledge_base_id string, embedding array<float>"
QUERY = "query_id long, knowledge_base_id string, embedding array<float>"


def frames(spark, seed, n=1500, d=48, asked=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    v = centres[rng.integers(12, size=n)] + 0.6 * rng.normal(size=(n, d))
    v[: n // 3] = v[0]  # a third are copies
    v[n // 3 : n // 3 + 40] = v[0] + 1e-6 * rng.normal(size=(40, d))  # ties after rounding
    v[-1] = 0
    c = [(f"c{i}", f"kb{i % 2}", v[i].tolist()) for i in range(n)]
    odd = [("n", "kb0", None), ("e", "kb0", [None] * d), ("f", "kb1", [float("nan")] * d), ("g", "kb1", [float("inf")] * d)]
    q = [(i, f"kb{i % 3}", v[int(rng.integers(n))].tolist()) for i in range(asked)] + [(100, "kb0", v[0].tolist()), (101, "kb1", [0.0] * d), (102, "kb1", None)]
    return spark.createDataFrame(q, QUERY), spark.createDataFrame(c, CHUNK), spark.createDataFrame(odd, CHUNK)


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "similarity", "rank").collect())


@pytest.mark.parametrize("seed,k,copies", [(1, 10, 10), (2, 1, 3), (3, 60, 100)])
def test_same_rows_as_a_whole_comparison(spark, seed, k, copies):
    q, c, odd = frames(spark, seed)
    want = rows(retrieval.dense_topk(q, c, k))
    assert rows(quantised.pruned_dense_topk(q, c.union(odd).withColumn("low", F.lit(1)), k, copies=copies)) == want and want
    assert rows(quantised.pruned_dense_topk(q, c.union(odd), k, copies=copies, block=4)) == want  # beyond the block


def test_written_index_and_few_exact_products(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    c = e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.lit("all").alias("knowledge_base_id"), "embedding")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("all").alias("knowledge_base_id"), "embedding")
    quantised.quantised(c).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert rows(quantised.pruned_dense_topk(q, c, 10, index)) == rows(retrieval.dense_topk(q, c, 10))
    left = quantised.candidates(quantised._asked(q, 4096), index, "bigint", 10, 6).count()
    assert left < 0.2 * q.count() * c.count()


def test_bounds_hold(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_t(2, size=(300, 1024))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)

    class Row:
        def __init__(self, i):
            self.query_id, self.embedding = i, v[i]

    near, off = quantised._Asked([Row(i) for i in range(30)]).bounds(*quantised._codes(unit))
    assert (np.abs(near - unit[:30] @ unit.T) <= off).all() and off.max() < 0.2


def test_empty_tables_and_too_many_rows(spark):
    q, c, _ = frames(spark, 1, 90)
    assert rows(quantised.pruned_dense_topk(q.limit(0), c, 3)) == []
    assert rows(quantised.pruned_dense_topk(q, c.limit(0), 3)) == []
    with pytest.raises(ValueError):
        quantised.pruned_dense_topk(q, c, 101)
