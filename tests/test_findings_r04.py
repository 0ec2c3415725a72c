"""Findings of the review of round 4."""

import hashlib
import random
import re

import pytest

import __spark_entry__
from corpusloom.operators import inverted, retrieval


def documents(spark, folder, texts):
    rows = [(i, t, "src1") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_documents_without_blocks_are_rows_like_others(spark, tmp_path):
    """Even ids are Markdown, odd ones text; both kinds come null, empty, blank and with control characters alone."""
    texts = [t for t in (None, "", " \n\t\n ", "\u200b\x01") for _ in range(2)] + ["head\nbody", "one\ntwo"]
    got = {r.document_id: r for r in __spark_entry__.queries()["parse_documents"](spark, documents(spark, tmp_path, texts)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(texts) and got["8"][1:] == (2, "head", sha("head|body"), None) and got["9"][1:] == (2, "", sha("one|two"), None)
    assert {got[str(i)][1:] for i in (0, 1, 3, 5, 7)} == {(0, None, sha(""), "EMPTY_DOCUMENT")}
    assert (got["2"].n_blocks, got["6"].n_blocks) == (1, 1)  # a first line of Markdown has its mark


@pytest.fixture(scope="module")
def searched(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)] + ["数据", "数据库", "检", "索"] * 90
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    c = [(f"c{i % 450}", ("a", "b", None)[i % 3], text(rng.randrange(0, 50)) or None) for i in range(500)] + [(f"copy{i}", "a", "w1 w1 w2 数") for i in range(30)] + [("long", "a", "w1 " * 40_000), (None, "a", "w1 w3")]
    q = [(i, ("a", "b", "none")[i % 3], text(rng.randrange(1, 9))) for i in range(30)] + [(100, "a", "w1"), (101, "a", "数据"), (102, "b", ""), (103, None, "w1"), (104, "a", None)]
    return spark.createDataFrame(q, "query_id int, knowledge_base_id string, question string"), spark.createDataFrame(c, "chunk_id string, knowledge_base_id string, content string").repartition(5)


@pytest.mark.parametrize("k,block,terms", [(1, 40, 100_000), (20, 4096, 30)])
def test_the_index_finds_repeated_and_null_ids_of_chunks_as_joins_do(searched, monkeypatch, k, block, terms):
    """c0 to c49 come twice each; many questions are measured in slices of their terms."""
    monkeypatch.setattr(inverted, "STREAMED_TERMS", terms)
    q, c = searched
    columns = ["query_id", "chunk_id", "sparse_coverage", "sparse_score", "rank"]
    want = retrieval.sparse_topk(q, c, k, broadcast_terms=0).select(columns).collect()
    got = inverted.topk(q, inverted.build_index(c, block), k).select(columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and want


def test_the_index_shuffles_texts_and_no_words(searched):
    """A row for each chunk and word was shuffled twice and kept in the memory's format: 13 times the texts on disk."""
    plan = inverted.build_index(searched[1].coalesce(1)).postings._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("hashpartitioning(") == 1


def test_no_row_for_a_query_and_a_chunk_is_shuffled(searched):
    """Only what its block's best and the query's bound leave goes on."""
    q, c = searched
    plan = inverted.topk(q, inverted.build_index(c), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and re.search(r"hashpartitioning\(query_id#\d+,", plan) and not re.search(r"hashpartitioning\(query_id#\d+, chunk_id#", plan)
