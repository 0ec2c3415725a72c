"""Cases of the review of round 3."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chains, chunking, embedding, limits, parsing, retrieval, uploads


def test_words_that_begin_like_signatures_are_text(spark):
    texts = [b"Raram verba", b"GIF pictures", b"%!PS is no file", b"%PDF", b"PK of the table", b"Rar!\x1a\x07\x00", b"GIF89a,", b"%!PS-Adobe-3.0", b"%PDF-1.4", b"PK\x03\x04", b"\xff\xd8\xff\xe0"]
    df = spark.createDataFrame([(i, "a.txt", "text/plain", t) for i, t in enumerate(texts)], "id int, filename string, declared_mime string, content binary")
    got = {r.id: r.reject_code for r in uploads.validate_uploads(df).collect()}
    assert [got[i] for i in range(len(texts))] == [None] * 5 + ["INVALID_FILE_CONTENT"] * 6


@pytest.fixture
def searched(spark):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)] + ["数据", "数据库", "检", "索"] * 90
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    c = [(f"c{i}", ("a", "b", None)[i % 3], text(rng.randrange(0, 50)) or None) for i in range(500)] + [(f"copy{i}", "a", "w1 w1 w2 数") for i in range(30)] + [("long", "a", "w1 " * 40_000), ("longer", "a", "w1 " * 40_001), (None, "a", "w1")]
    q = [(i, ("a", "b", "none")[i % 3], text(rng.randrange(1, 9))) for i in range(30)] + [(100, "a", "w1"), (101, "a", "数据"), (102, "b", ""), (103, None, "w1"), (104, "a", None)]
    return spark.createDataFrame(q, "query_id int, knowledge_base_id string, question string"), spark.createDataFrame(c, "chunk_id string, knowledge_base_id string, content string").repartition(5)


@pytest.mark.parametrize("k,cells", [(1, 1), (7, 400), (20, 400_000)])
def test_streamed_terms_find_what_joined_terms_find(searched, monkeypatch, k, cells):
    monkeypatch.setattr(retrieval, "SPARSE_CELLS", cells)
    q, c = searched
    want = retrieval.sparse_topk(q, c.filter("chunk_id is not null"), k, broadcast_terms=0).collect()
    assert sorted(map(repr, retrieval.sparse_topk(q, c, k).collect())) == sorted(map(repr, want)) and want


def test_pairs_of_queries_and_chunks_are_not_shuffled(searched):
    """One row for each query and chunk that share a word went through an aggregation before, whose memory grew with the chunks."""
    plan = retrieval.sparse_topk(*searched, 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"Aggregate\(keys=\[[^\]]*chunk_id", plan)


def test_blocks_are_bounded_in_rows_and_small_keys_stay_in_them(spark, monkeypatch):
    monkeypatch.setattr(chains, "BLOCK_ROWS", 50)
    e = spark.range(4000).select(F.when(F.col("id") % 4 == 0, 7).otherwise(F.col("id") % 1000).alias("key"), F.timestamp_seconds(F.col("id") * 3).alias("ts"), (F.hash("id") % 5 == 0).alias("success"), "id")
    placed = chains.spread(e.withColumns({"_k": F.col("key").cast("string"), "_t": F.unix_micros("ts"), "_ok": F.col("success")}), "_k", ["_t", "id"])
    sizes = [r[1] for r in placed.groupBy("_pid").count().collect()]
    assert max(sizes) <= 150
    assert len(chains._summaries(placed)) <= 2 * len(sizes) < e.select("key").distinct().count()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(limits.login_lock_replay(e, limit=3, window_s=2000, hot_rows=0)) == rows(limits.login_lock_replay(e, limit=3, window_s=2000))
    assert rows(limits.rate_limit_replay(e, "key", "ts", 3, 2000, hot_rows=0)) == rows(limits.rate_limit_replay(e, "key", "ts", 3, 2000))


def test_few_documents_are_objects_at_a_time():
    batch = pa.RecordBatch.from_pylist([{"document_id": str(i), "content": f"# T{i}\n\ntext" if i % 9 else None} for i in range(300)])
    out = list(parsing._helper(parsing.markdown_blocks)(iter([batch])))
    assert [len(b) for b in out] == [128, 128, 44]
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["document_id"] for r in rows] == [str(i) for i in range(300)]
    assert rows[0] == {"document_id": "0", "blocks": [], "error_code": "EMPTY_DOCUMENT"} and rows[1]["blocks"][1]["metadata"] == [("paragraph_start", "2"), ("paragraph_end", "2"), ("source_type", "markdown")]


def test_broken_and_empty_files_keep_their_codes(spark):
    rows = [("1", "a.docx", b"junk"), ("2", "a.md", b""), ("3", "a.md", b"# A\n\nb"), ("4", "a.exe", b"x"), ("5", "a.txt", None)]
    got = {r.document_id: r for r in chunking.chunk_documents(parsing.parse_documents(spark.createDataFrame(rows, "document_id string, filename string, content binary"))).collect()}
    assert {k: r.error_code for k, r in got.items()} == {"1": "DOCUMENT_PARSE_FAILED", "2": "EMPTY_DOCUMENT", "3": None, "4": "UNSUPPORTED_DOCUMENT_TYPE", "5": "EMPTY_DOCUMENT"}
    assert got["3"].content == "A\n\nb" and got["3"].metadata == {"source_block_start": "0", "source_block_end": "1", "paragraph_start": "1", "paragraph_end": "2"} and got["1"].metadata is None


def test_vectors_by_a_grid_are_the_same(monkeypatch):
    monkeypatch.setattr(embedding, "CHARACTERS", 40)
    rng, grid, known = random.Random(1), embedding.Grid(), {}
    texts = ["", " ", "a", "Az az AZ", "数据 data_base", "\U0001f600 x", "\ud800y", "İß ſ", "\x00\x00", *("".join(rng.choice("abcdefg hij.,_1\nÄ数") for _ in range(rng.randrange(1, 200))) for _ in range(50)), "".join(map(chr, range(33, 300)))]
    for t in texts:
        for d in (64, 1024):
            assert (embedding.hashed_vector(t, d, known, grid) == embedding.hashed_vector(t, d, {})).all()
    assert 10 < len(grid.codes) <= 40


def test_rows_dealt_to_all_cores_are_not_sorted(spark):
    """Rows dealt in turn were sorted first, and so one task held all rows of a file; missing and repeated ids are dealt as well."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, 7).alias("chunk_id"), F.concat(F.lit("text "), F.col("id")).alias("content")).coalesce(1)
    dealt = retrieval.over_all_cores(df)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and "RoundRobin" not in plan
    sizes = [r[1] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 2 * 3000 / len(sizes)
    rows = lambda x: sorted(map(repr, x.collect()))
    assert rows(dealt) == rows(df)
