import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chat, chunking, embedding, evaluation, lifecycle, limits, parsing, providers, retrieval, uploads


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_uploads(spark):
    good = docx("<w:p><w:r><w:t>x</w:t></w:r></w:p>")
    rows = [
        ("a.txt", "text/plain", b"hello", None),
        ("a.md", "text/markdown; charset=utf-8", b"# hi", None),
        ("../x.txt", None, b"x", "INVALID_FILENAME"),
        ("..\\x.txt", None, b"x", "INVALID_FILENAME"),
        ("", None, b"x", "INVALID_FILENAME"),
        ("a.exe", None, b"x", "UNSUPPORTED_FILE_EXTENSION"),
        ("a.txt", "application/pdf", b"x", "INVALID_FILE_MIME"),
        ("a.txt", None, b"x" * 101, "FILE_TOO_LARGE"),
        ("a.txt", None, b"", "EMPTY_FILE"),
        ("a.pdf", None, b"text", "INVALID_FILE_CONTENT"),
        ("a.pdf", None, b"%PDF-1.7", None),
        ("a.txt", None, b"<!DOCTYPE html><p>", "INVALID_FILE_CONTENT"),
        ("a.docx", None, b"PK junk", "INVALID_FILE_CONTENT"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "id int, filename string, declared_mime string, content binary")
    got = {r.id: r.reject_code for r in uploads.validate_uploads(df, 100).collect()}
    assert got == {i: r[3] for i, r in enumerate(rows)}
    big = spark.createDataFrame([(1, "a.docx", None, good)], df.schema)
    assert uploads.validate_uploads(big).first().reject_code is None


def test_markdown_and_docx():
    blocks = parsing.markdown_blocks("# A\n\ntext\nmore\n## B\nlast")
    assert [(b["content"], b["heading_path"], b["para_from"]) for b in blocks] == [("A", "A", 1), ("text\nmore", "A", 2), ("B", "A > B", 3), ("last", "A > B", 4)]
    assert parsing.markdown_blocks("## X\ny")[1]["heading_path"] == " > X" and parsing.markdown_blocks("## X\ny")[0]["heading_path"] == "X"
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    found = parsing.docx_blocks(docx(body))
    assert [b["content"] for b in found] == ["Top", "body", "a b"] and found[1]["heading_path"] == "Top" and found[2]["metadata"]["content_type"] == "table"
    with pytest.raises(ValueError):
        parsing.docx_blocks(b"junk")


def test_parse_dispatch(spark):
    rows = [("1", "a.txt", b"one\n\ntwo"), ("2", "b.md", b"# t\n\nx"), ("3", "c.docx", b"junk"), ("4", "d.bin", b"x"), ("5", "e.txt", b"\x00\n\t"), ("6", "f.txt", None)]
    out = {r.document_id: r for r in parsing.parse_documents(spark.createDataFrame(rows, "document_id string, filename string, content binary")).collect()}
    assert {k: r.error_code for k, r in out.items()} == {"1": None, "2": None, "3": "DOCUMENT_PARSE_FAILED", "4": "UNSUPPORTED_DOCUMENT_TYPE", "5": "EMPTY_DOCUMENT", "6": "EMPTY_DOCUMENT"}
    assert [b.content for b in out["1"].blocks] == ["one", "two"]


@pytest.mark.parametrize("size,overlap", [(80, 15), (20, 0), (7, 6)])
def test_chunks_cover_and_overlap(size, overlap):
    text = "First sentence here. Second one, longer; and more!\n\nThird paragraph. " * 9
    spans = chunking.cuts(text, size, overlap)
    assert all(0 < b - a <= size and not text[a].isspace() for a, b in spans)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(c.isspace() or i in covered for i, c in enumerate(text))
    assert all(b[0] > a[0] and (b[0] >= a[1] - overlap) for a, b in zip(spans, spans[1:], strict=False))


def test_chunk_metadata(spark):
    rows = [("d", [("one", 1, 1, None, None, "H", None), ("two", 2, 2, None, None, "", None)]), ("e", [])]
    out = {r.document_id: r for r in chunking.chunk_documents(spark.createDataFrame(rows, f"document_id string, blocks array<{parsing.BLOCK}>")).collect()}
    assert (out["d"].content, out["d"].page_start, out["d"].page_end, out["d"].heading_path) == ("one\n\ntwo", 1, 2, "H")
    assert out["e"].error_code == "EMPTY_DOCUMENT"
    with pytest.raises(ValueError):
        chunking.chunk_documents(spark.createDataFrame(rows, f"document_id string, blocks array<{parsing.BLOCK}>"), 10, 10)


def test_rrf_prefers_both_sides(spark):
    dense = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 2)], "query_id string, chunk_id string, similarity double, rank int")
    sparse = spark.createDataFrame([("q", "b", 0.5, 0.8, 1), ("q", "c", 0.4, 0.8, 2)], "query_id string, chunk_id string, sparse_score double, sparse_coverage double, rank int")
    rows = retrieval.rrf(dense, sparse).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["b", "a", "c"] and rows[0].similarity == 0.8 and rows[0].sparse_score == 0.5
    weak = sparse.withColumn("sparse_coverage", F.lit(0.05)).filter("chunk_id = 'c'")
    assert [r.chunk_id for r in retrieval.rrf(dense, weak).orderBy("rank").collect()] == ["a", "b", "c"]


def test_dense_in_blocks_is_the_same(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("knowledge_base_id", F.col("label").cast("string"))
    q = e.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "knowledge_base_id", "embedding")
    c = e.select(F.col("vec_id").alias("chunk_id"), "knowledge_base_id", "embedding")
    assert set(retrieval.dense_topk(q, c, 5).collect()) == set(retrieval.dense_topk(q, c, 5, block=3, chunk_block=7).collect())


def test_sparse_paths_agree(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.lit("k").alias("knowledge_base_id"), F.col("text").alias("content"))
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.lit("k").alias("knowledge_base_id"), F.col("text").alias("question"))
    assert set(retrieval.sparse_topk(q, d, 5).collect()) == set(retrieval.sparse_topk(q, d, 5, broadcast_terms=0).collect())
    assert "CartesianProduct" not in retrieval.sparse_topk(q, d, 5)._jdf.queryExecution().executedPlan().toString()


def test_plug_in_reranker(spark):
    c = spark.createDataFrame([("q", i, "x", "y" * i, i + 1) for i in range(5)], "query_id string, chunk_id int, question string, content string, rank int")
    scores = providers.rerank_scores(c, lambda q, docs: [len(d) for d in docs], batch=2)
    got = retrieval.rerank_with_fallback(c.withColumn("score", F.lit(0.0)), scores.filter("chunk_id < 3"), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 1, 0, 3, 4] and not got[0].rerank_fallback


def test_retries():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise providers.TransientError
        return x

    waits = []
    assert providers.with_retry(flaky, sleep=waits.append)(7) == 7 and waits == [0.1, 0.2]
    with pytest.raises(ValueError):
        providers.with_retry(lambda: (_ for _ in ()).throw(ValueError()))()


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "red green"), (2, "red green"), (3, "red blue"), (4, "日本"), (5, None)], "id int, t string")
    e = {r.id: r.v for r in df.select("id", embedding.embed_text(F.col("t"), 128).alias("v")).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(e[a], e[b], strict=True))
    assert e[1] == e[2] and dot(1, 3) > dot(1, 4) and all(len(v) == 128 and abs(sum(x * x for x in v) - 1) < 1e-5 for v in e.values())
    own = df.select(embedding.embed_with(F.col("t"), lambda texts: [[float(len(t)), 1.0] for t in texts], 2).alias("v")).collect()
    assert [list(r.v) for r in own][0] == [9.0, 1.0]


def test_context_budget_is_a_prefix(spark):
    df = spark.createDataFrame([("q", 1, "x", 9000), ("q", 2, "y", 1), ("r", 1, "x", 5), ("r", 2, "y", 9000), ("r", 3, "z", 1)], "query_id string, rank int, content string, token_count int")
    assert {(r.query_id, r["rank"]) for r in chat.limit_context(df).collect()} == {("q", 1), ("r", 1)}


def test_rewriting(spark):
    history = [("user", "completed", "what is rain"), ("assistant", "completed", "water")]
    df = spark.createDataFrame([("does it fall", history), ("what is snow", history)], "question string, history array<struct<role:string,status:string,content:string>>")
    rows = chat.rewrite_queries(df).collect()
    assert rows[0].rewrite_applied and rows[0].query.startswith("what is rain") and rows[1].query == "what is snow"

    def broken(history, question):
        raise RuntimeError

    assert all(r.rewrite_fallback and r.query == r.question for r in chat.rewrite_queries(df, broken).collect())


def test_metrics(spark):
    cases = spark.createDataFrame([("s", "1", 1, True, 1.0, 1.0, 2, 0.1, ""), ("s", "2", 6, False, 3.0, 3.0, 4, 0.3, "")], "strategy string, id string, first_relevant_rank int, citation_hit boolean, retrieval_latency_ms double, end_to_end_latency_ms double, tokens int, estimated_cost_usd double, error string")
    m = evaluation.retrieval_metrics(cases).first()
    assert (m.recall_at_1, m.recall_at_5, m.recall_at_10, m.citation_hit_rate, m.p95_retrieval_latency_ms) == (0.5, 0.5, 1, 0.5, 3) and abs(m.mrr - (1 + 1 / 6) / 2) < 1e-12


def seconds(*values):
    return [datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=v) for v in values]


def test_rate_limit_windows_are_anchored(spark):
    df = spark.createDataFrame([("a", t) for t in seconds(0, 10, 59, 60, 70, 200)], "k string, ts timestamp")
    out = limits.rate_limit_replay(df, "k", "ts", 2, 60).orderBy("ts").collect()
    assert [(r.hit_no, r.allowed, r.retry_after_ms) for r in out] == [(1, True, 60000), (2, True, 50000), (3, False, 1000), (1, True, 60000), (2, True, 50000), (1, True, 60000)]


def test_login_lock(spark):
    df = spark.createDataFrame(list(zip(["a"] * 7, seconds(0, 1, 2, 3, 901, 902, 903), [False, False, True, False, False, True, False], strict=True)), "key string, ts timestamp, success boolean")
    out = limits.login_lock_replay(df, limit=2).orderBy("ts").collect()
    assert [(r.failures, r.blocked) for r in out] == [(0, False), (1, False), (2, True), (2, True), (0, False), (1, False), (0, False)]


def test_deletes_change_nothing_twice(spark):
    docs = spark.createDataFrame([("d1", "k", "ready", 3, None), ("d2", "k", "ready", 2, None)], "id string, knowledge_base_id string, status string, chunk_count int, deleted_at timestamp")
    kbs = spark.createDataFrame([("k", "o")], "id string, owner_id string")
    chunks = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    jobs = spark.createDataFrame([("j", "d1", "running", "parsing", None)], "id string, document_id string, status string, stage string, error_code string")
    msgs = spark.createDataFrame([("document.delete", "d1", "o", None), ("document.delete", "d2", "other", None)], "type string, document_id string, owner_id string, knowledge_base_id string")
    now = F.timestamp_seconds(F.lit(5))
    a = lifecycle.apply_document_deletes(msgs, docs, kbs, chunks, jobs, now)
    b = lifecycle.apply_document_deletes(msgs, a["documents"], kbs, a["chunks"], a["jobs"], F.timestamp_seconds(F.lit(9)))
    for name in a:
        assert sorted(a[name].collect()) == sorted(b[name].collect())
    assert [r.document_id for r in a["chunks"].collect()] == ["d2"] and a["jobs"].first().error_code == "DOCUMENT_DELETED"
