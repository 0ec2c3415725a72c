import dataclasses
import datetime
import json

from pyspark.sql import functions as F

from corpusloom.operators import limits
from corpusloom.plans import queries
from corpusloom.functions.costs import Pricing
from corpusloom.sources import append_usage, load_questions, read_chunks, read_files, read_messages, report_markdown, write_chunks
from corpusloom.streaming import IndexTables, counter_table, outcome_table, rate_limit_stream, start_index_stream, start_usage_stream
from corpusloom.streaming.jobs import index_batch


def test_chunk_writes_replace_by_key(spark, tmp_path):
    path = str(tmp_path / "chunks")
    make = lambda rows: spark.createDataFrame(rows, "document_id string, index_version int, content string")
    write_chunks(make([("a", 1, "x"), ("b", 1, "y")]), path)
    for _ in range(2):
        write_chunks(make([("a", 1, "new"), ("a", 2, "z")]), path)
    got = {(r.document_id, r.index_version, r.content) for r in read_chunks(spark, path).collect()}
    assert got == {("a", 1, "new"), ("a", 2, "z"), ("b", 1, "y")}


def test_files_messages_and_questions(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.txt").write_bytes(b"abc")
    assert [(r.filename, r.length) for r in read_files(spark, str(tmp_path / "in")).collect()] == [("a.txt", 3)]
    rows = [json.dumps({"type": "document.index", "job_id": "1"}), "{}", "broken"]
    assert [r.error_code for r in read_messages(spark.createDataFrame([(r,) for r in rows], "value string")).collect()] == [None, "INVALID_MESSAGE", "INVALID_MESSAGE"]
    (tmp_path / "q.jsonl").write_text(json.dumps({"id": "1", "question": "q", "tags": ["a"]}) + "\n")
    assert load_questions(spark, str(tmp_path / "q.jsonl")).first().tags == ["a"]
    usage = spark.createDataFrame([(1, datetime.datetime(2024, 1, 2))], "id int, created_at timestamp")
    append_usage(usage, str(tmp_path / "usage"))
    append_usage(usage, str(tmp_path / "usage"))
    assert spark.read.parquet(str(tmp_path / "usage")).count() == 2


def test_report(spark):
    names = "ord strategy recall_at_1 recall_at_5 recall_at_10 mrr citation_hit_rate avg_retrieval_latency_ms p95_retrieval_latency_ms avg_end_to_end_latency_ms p95_end_to_end_latency_ms avg_tokens avg_estimated_cost_usd".split()
    metrics = spark.createDataFrame([(0, "dense", *[0.5] * 7, 2.0, 3.0, *[0.5] * 2), (1, "sparse", *[0.25] * 11)], names)
    configs = spark.createDataFrame([(0, "dense", 20, 0, 60, True, 10, 10)], "ord int, strategy string, dense_top_k int, sparse_top_k int, rrf_k int, rerank_enabled boolean, rerank_top_k int, final_top_k int")
    failures = spark.createDataFrame([(0, "dense", f"q{i}", i % 2, i == 1, "a|b") for i in range(9)], "ord int, strategy string, id string, first_relevant_rank int, citation_hit boolean, error string")
    lines = [r.line for r in report_markdown(configs, metrics, failures, Pricing(0.15, 0.6, 0.02, 0.05)).orderBy("line_no").collect()]
    assert lines[0].startswith("# ") and any("0.1500" in x and "0.0500" in x for x in lines) and "| dense | 20 | 0 | 60 | yes | 10 | 10 |" in lines
    assert any("0.500 / 0.500 | 2.000 / 3.000" in x for x in lines) and lines[-1].startswith("Best: dense")
    assert sum(x.startswith("| dense | q") for x in lines) == 5 and "| dense | q1 | 1 | yes | a/b |" in lines


def stream(spark, df, folder):
    df.coalesce(1).write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def test_index_stream_is_idempotent(spark, tmp_path):
    message = json.dumps({"type": "document.index", "job_id": "j", "document_id": "d", "owner_id": "o", "index_version": 1})
    source = stream(spark, spark.createDataFrame([(message,), (message,), ("broken",)], "value string"), str(tmp_path / "queue"))
    tables = IndexTables(
        jobs=lambda s: s.createDataFrame([("j", "d", 1, "pending")], "id string, document_id string, index_version int, status string"),
        documents=lambda s: s.createDataFrame([("d", "k", 1, "queued", None)], "id string, knowledge_base_id string, index_version int, status string, deleted_at timestamp"),
        knowledge_bases=lambda s: s.createDataFrame([("k", "o", None)], "id string, owner_id string, deleted_at timestamp"),
        files=lambda s: s.createDataFrame([("d", "k", "a.txt", b"some text", 1)], "document_id string, knowledge_base_id string, filename string, content binary, index_version int"),
        chunks_path=str(tmp_path / "chunks"),
        outcomes_path=str(tmp_path / "outcomes"),
    )
    for n in range(2):  # a second stream replays everything
        start_index_stream(source, tables, str(tmp_path / f"checkpoint{n}"), available_now=True).awaitTermination(60)
    assert read_chunks(spark, tables.chunks_path).count() == 1
    assert {(r.document_id, r.status, r.chunk_count) for r in outcome_table(spark, tables.outcomes_path).read().collect()} == {("d", "ready", 1)}


def test_index_stream_routes_deletes(spark, tmp_path):
    ids = {n: f"00000000-0000-0000-0000-00000000000{i}" for i, n in enumerate("dekxo")}
    say = lambda kind, **m: (json.dumps({"type": kind, "owner_id": ids["o"]} | m),)
    index = say("document.index", job_id="j", document_id="new", index_version=1)
    deletes = [say("document.delete", document_id=ids["d"]), say("knowledge_base.delete", knowledge_base_id=ids["x"]), say("document.delete", document_id="malformed"), say("other")]
    source = stream(spark, spark.createDataFrame([*deletes, index], "value string"), str(tmp_path / "queue"))
    docs = [(ids["d"], ids["k"], 1, "ready", None, 1), (ids["e"], ids["k"], 1, "ready", None, 1), ("in-x", ids["x"], 1, "ready", None, 1), ("new", ids["k"], 1, "queued", None, 0)]
    seen, requeued = {}, []
    tables = IndexTables(
        jobs=lambda s: s.createDataFrame([("j", "new", 1, "pending", "queued", None), ("r", ids["d"], 1, "running", "parsing", None)], "id string, document_id string, index_version int, status string, stage string, error_code string"),
        documents=lambda s: s.createDataFrame(docs, "id string, knowledge_base_id string, index_version int, status string, deleted_at timestamp, chunk_count int"),
        knowledge_bases=lambda s: s.createDataFrame([(ids["k"], ids["o"], None), (ids["x"], ids["o"], None)], "id string, owner_id string, deleted_at timestamp"),
        files=lambda s: s.createDataFrame([("new", ids["k"], "a.txt", b"some text", 1)], "document_id string, knowledge_base_id string, filename string, content binary, index_version int"),
        chunks_path=str(tmp_path / "chunks"),
        outcomes_path=str(tmp_path / "outcomes"),
        deleted=lambda out: seen.update({k: v.collect() for k, v in out.items()} | {"gone": seen.get("gone", set()) | {r.id for r in out["documents"].collect() if r.status == "deleting"}}),
        requeued=lambda df: requeued.extend(df.collect()),
    )
    write_chunks(spark.createDataFrame([(d[0], 1, "x") for d in docs[:3]], "document_id string, index_version int, content string"), tables.chunks_path)
    for n in range(2):
        start_index_stream(source, tables, str(tmp_path / f"checkpoint{n}"), available_now=True).awaitTermination(60)
        assert {r.document_id for r in read_chunks(spark, tables.chunks_path).collect()} == {ids["e"], "new"}
    assert seen["gone"] == {ids["d"], "in-x"} and not requeued
    assert {r.id for r in seen["knowledge_bases"] if r.deleted_at} == {ids["x"]}

    def down(s):
        raise ConnectionError("down")

    index_batch(spark.createDataFrame(deletes, "value string"), dataclasses.replace(tables, knowledge_bases=lambda s, calls=iter([tables.knowledge_bases]): next(calls, down)(s)), 7)
    assert {json.loads(r.value)["type"] for r in requeued} == {"document.delete", "knowledge_base.delete"} and len(requeued) == 2


def test_index_stream_applies_claims(spark, tmp_path):
    """A message that comes again finds its job running and isn't indexed a second time."""
    message = json.dumps({"type": "document.index", "owner_id": "o", "job_id": "j", "document_id": "d", "index_version": 1})
    source = stream(spark, spark.createDataFrame([(message,)], "value string"), str(tmp_path / "queue"))
    schema = "id string, document_id string, index_version int, status string, stage string, progress int, attempts int, started_at timestamp"
    state, contents = [("j", "d", 1, "pending", "queued", 0, 0, None)], [b"first"]
    tables = IndexTables(
        jobs=lambda s: s.createDataFrame(state, schema),
        documents=lambda s: s.createDataFrame([("d", "k", 1, "queued", None)], "id string, knowledge_base_id string, index_version int, status string, deleted_at timestamp"),
        knowledge_bases=lambda s: s.createDataFrame([("k", "o", None)], "id string, owner_id string, deleted_at timestamp"),
        files=lambda s: s.createDataFrame([("d", "k", "a.txt", contents[-1], 1)], "document_id string, knowledge_base_id string, filename string, content binary, index_version int"),
        chunks_path=str(tmp_path / "chunks"),
        outcomes_path=str(tmp_path / "outcomes"),
        claimed=lambda jobs: state.__setitem__(slice(None), [tuple(r) for r in jobs.select(*(c.split()[0] for c in schema.split(", "))).collect()]),
    )
    for n in range(2):
        start_index_stream(source, tables, str(tmp_path / f"checkpoint{n}"), available_now=True).awaitTermination(60)
        assert [r[3:7] for r in state] == [("running", "parsing", 10, 1)]
        assert [r.content for r in read_chunks(spark, tables.chunks_path).collect()] == ["first"]
        contents.append(b"second")
    assert not list((tmp_path / "chunks" / "aside").iterdir())


def test_usage_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("chat", "m", "succeeded", 5, 0.5), ("chat", "m", "failed", 1, 0.0)], "request_type string, model string, status string, prompt_tokens int, estimated_cost_usd double")
    q = start_usage_stream(stream(spark, df, str(tmp_path / "u")), str(tmp_path / "counts"), str(tmp_path / "c"), available_now=True)
    q.awaitTermination(60)
    assert [tuple(r) for r in counter_table(spark, str(tmp_path / "counts")).read().drop("counter_key").collect()] == [("chat", "m", 2, 1, 6, 0.5)]


def test_rate_limit_stream_equals_replay(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a" if i % 3 else "b", start + datetime.timedelta(seconds=i * 7)) for i in range(40)], "k string, ts timestamp")
    want = {(r.k, r.ts, r.hit_no, r.allowed) for r in limits.rate_limit_replay(df, "k", "ts", 3, 60).collect()}
    out = rate_limit_stream(stream(spark, df, str(tmp_path / "e")), "k", "ts", 3, 60)
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {tuple(r) for r in spark.table("limited").collect()} == want


def test_every_oracle_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) > 60


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.queries()["retrieval_metrics"](spark, sf_dir).agg(F.count("*")).first()[0] == 4
