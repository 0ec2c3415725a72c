"""The inverted index finds what a scan of all texts finds, and reads less."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import inverted, retrieval


def frames(spark, seed=1, chunks=400, queries=25):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)] + ["数据", "数据库", "检索", "模型"] * 60
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    c = [(f"c{i}", f"kb{i % 2}", text(rng.randrange(0, 60)) or None) for i in range(chunks)]
    q = [(i, f"kb{i % 3}", text(rng.randrange(1, 9))) for i in range(queries)] + [(100, "kb0", "w1 w1 w2"), (101, "kb1", "检索数据库"), (102, "kb0", ""), (103, "kb0", None), (104, "kb0", "nothing-like-it")]
    return spark.createDataFrame(q, "query_id long, knowledge_base_id string, question string"), spark.createDataFrame(c, "chunk_id string, knowledge_base_id string, content string")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "sparse_coverage", "sparse_score", "rank").collect())


@pytest.mark.parametrize("k,seeds,block", [(5, 40, 50), (1, 10_000, 4096), (20, 1, 7)])
def test_same_rows_as_a_scan(spark, tmp_path, k, seeds, block):
    q, c = frames(spark, k)
    want = rows(retrieval.sparse_topk(q, c, k))
    index = inverted.build_index(c, block).write(str(tmp_path / "index"))
    assert rows(inverted.topk(q, index, k, seeds)) == want and want
    assert rows(inverted.topk(q, index, k, seeds, broadcast_terms=0)) == want


def test_common_terms_are_looked_up_only_for_what_others_found(spark, tmp_path):
    """Chunks that hold the common words alone are never scored once rarer words have given the bound."""
    c = [(i, "kb", "the of " * 3 + ("rare words here" if i < 30 else f"x{i}")) for i in range(600)]
    chunks = spark.createDataFrame(c, "chunk_id long, knowledge_base_id string, content string")
    q = spark.createDataFrame([(1, "kb", "the rare words of")], "query_id long, knowledge_base_id string, question string")
    index = inverted.build_index(chunks, 50).write(str(tmp_path / "index"))
    scored = []
    real = inverted._measures
    try:
        inverted._measures = lambda df: scored.append(real(df).count()) or real(df)
        assert rows(inverted.topk(q, index, 5)) == rows(retrieval.sparse_topk(q, chunks, 5))
    finally:
        inverted._measures = real
    assert max(scored[1:]) == 30
    assert index.postings.agg(F.max("n")).first()[0] <= 90


def test_empty_tables(spark, tmp_path):
    q, c = frames(spark)
    assert inverted.topk(q, inverted.build_index(c.limit(0)).write(str(tmp_path / "index")), 3).collect() == []
    assert inverted.topk(q.limit(0), inverted.build_index(c), 3).collect() == []
