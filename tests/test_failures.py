"""An index stream whose batches fail at each step and run again ends with the tables of one run."""

import datetime
import itertools
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import read_chunks, write_chunks
from corpusloom.sources.snapshots import SnapshotTable
from corpusloom.streaming import ClaimLedger, IndexTables, RetryTable, count_usage, counter_table, jobs, outcome_table
from corpusloom.streaming.jobs import index_batch

JOBS = "id string, document_id string, index_version int, status string, stage string, progress int, attempts int, started_at timestamp, error_code string"
DOCS = "id string, knowledge_base_id string, index_version int, status string, deleted_at timestamp, chunk_count int, object_key string"
KBS = "id string, owner_id string, deleted_at timestamp"
ID = {n: f"00000000-0000-0000-0000-00000000000{i}" for i, n in enumerate("abkxo")}


class Service:
    """Tables kept by the service, and a queue batch that indexes one document, deletes a document and a knowledge base."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)
        self.jobs = [("j", "new", 1, "pending", "queued", 0, 0, None, None), ("r", ID["a"], 1, "running", "parsing", 10, 1, None, None)]
        self.docs = [(ID["a"], ID["k"], 1, "ready", None, 1, "raw/a"), (ID["b"], ID["k"], 1, "ready", None, 1, "raw/b"), ("in-x", ID["x"], 1, "ready", None, 1, "raw/x"), ("new", ID["k"], 1, "queued", None, 0, "raw/new")]
        self.kbs = [(ID["k"], ID["o"], None), (ID["x"], ID["o"], None)]
        self.removed, self.broken, self.clock = [], set(), datetime.datetime(2024, 1, 1)
        say = lambda kind, **m: (json.dumps({"type": kind, "owner_id": ID["o"]} | m),)
        self.index = say("document.index", job_id="j", document_id="new", index_version=1)
        self.messages = [self.index, self.index, say("document.delete", document_id=ID["a"]), say("knowledge_base.delete", knowledge_base_id=ID["x"]), say("document.delete", document_id="malformed"), ("broken",)]
        self.tables = IndexTables(
            jobs=lambda s: s.createDataFrame(self.jobs, JOBS),
            documents=lambda s: s.createDataFrame(self.docs, DOCS),
            knowledge_bases=lambda s: s.createDataFrame(self.kbs, KBS),
            files=lambda s: s.createDataFrame([("new", ID["k"], "a.txt", b"some text", 1)], "document_id string, knowledge_base_id string, filename string, content binary, index_version int"),
            chunks_path=self.folder + "/chunks",
            outcomes_path=self.folder + "/outcomes",
            claimed=lambda df: setattr(self, "jobs", [(*tuple(r)[:7], None, r.error_code) for r in df.select(*self.columns(JOBS)).collect()]),
            deleted=self.deleted,
            remove_objects=self.remove,
            now=lambda: self.clock,
        )
        write_chunks(spark.createDataFrame([(d[0], 1, "x") for d in self.docs[:3]], "document_id string, index_version int, content string"), self.tables.chunks_path)

    @staticmethod
    def columns(schema):
        return [c.split()[0] for c in schema.split(", ")]

    def remove(self, objects):
        rows = objects.collect()
        self.removed += [r.object_key for r in rows if r.id not in self.broken]
        return self.spark.createDataFrame([(r.id, "OBJECT_STORE_DOWN") for r in rows if r.id in self.broken], "id string, error_code string")

    def deleted(self, out):
        rows = {k: [tuple(r) for r in v.select(*self.columns(s)).collect()] for k, v, s in ((k, out.get(k), s) for k, s in (("documents", DOCS), ("jobs", JOBS), ("knowledge_bases", KBS))) if v is not None}
        self.docs, self.jobs, self.kbs = rows["documents"], rows["jobs"], rows.get("knowledge_bases", self.kbs)

    def run(self, epoch=0, messages=None):
        index_batch(self.spark.createDataFrame(self.messages if messages is None else messages, "value string"), self.tables, epoch)

    def end(self):
        """Everything that a run leaves, without times."""
        plain = lambda rows: sorted(tuple(bool(x) if isinstance(x, datetime.datetime) else x for x in r) for r in rows)
        return {
            "chunks": sorted((r.document_id, r.content) for r in read_chunks(self.spark, self.tables.chunks_path).collect()),
            "outcomes": sorted((r.document_id, r.status, r.chunk_count) for r in outcome_table(self.spark, self.tables.outcomes_path).read().collect()),
            "jobs": plain(self.jobs),
            "docs": plain(self.docs),
            "kbs": plain(self.kbs),
            "removed": sorted(set(self.removed)),
            "retries": sorted((r.document_id or r.knowledge_base_id, r.attempts, r.state) for r in RetryTable(self.spark, self.tables.retries_path).read().collect()),
        }


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    service = Service(spark, tmp_path_factory.mktemp("whole"))
    service.run()
    out = service.end()
    assert out["chunks"] == [(ID["b"], "x"), ("new", "some text")] and out["outcomes"] == [("new", "ready", 1)]
    assert [j[3:7] for j in out["jobs"] if j[0] == "j"] == [("running", "parsing", 10, 1)]
    assert out["removed"] == ["raw/a", "raw/x"] and not out["retries"]
    service.run()  # the same batch again
    service.run(1, [service.index])  # and its message in a later one
    assert service.end() == out
    return out


def failing(times, function, after=False):
    """function that fails `times` times, before or after its work."""
    count = itertools.count()

    def run(*args, **options):
        n = next(count)
        out = function(*args, **options) if after or n >= times else None
        if n < times:
            raise RuntimeError("down")
        return out

    return run


@pytest.mark.parametrize("step,after", [("take", True), ("claimed", False), ("claimed", True), ("index_corpus", False), ("write_chunks", True), ("outcomes", True), ("settle", False)])
def test_a_batch_that_fails_runs_again(spark, tmp_path, monkeypatch, whole, step, after):
    service = Service(spark, tmp_path)
    if step == "take":
        monkeypatch.setattr(ClaimLedger, "take", failing(1, ClaimLedger.take, after))
    elif step == "settle":
        monkeypatch.setattr(RetryTable, "settle", failing(1, RetryTable.settle, after))
    elif step == "claimed":
        service.tables.claimed = failing(1, service.tables.claimed, after)
    elif step == "outcomes":
        real = SnapshotTable.replace
        broken = failing(1, real, after)
        monkeypatch.setattr(SnapshotTable, "replace", lambda self, *a, **b: (broken if self.path.endswith("outcomes") else real)(self, *a, **b))
    else:
        monkeypatch.setattr(jobs, step, failing(1, getattr(jobs, step), after))
    with pytest.raises(RuntimeError):
        service.run()
    service.run()
    assert service.end() == whole


def test_one_bad_delete_goes_back_alone(spark, tmp_path):
    service = Service(spark, tmp_path)
    service.broken = {ID["a"]}
    service.run()
    out = service.end()
    assert out["chunks"] == [(ID["a"], "x"), (ID["b"], "x"), ("new", "some text")]  # the knowledge base is gone, the document isn't finished
    assert out["removed"] == ["raw/x"] and out["retries"] == [(ID["a"], 1, "waiting")]
    assert [d[3] for d in out["docs"] if d[0] == ID["a"]] == ["ready"]
    service.run(1, [("broken",)])  # not due yet
    assert service.end() == out
    service.clock += datetime.timedelta(seconds=31)
    service.run(2, [("broken",)])
    assert service.end()["retries"] == [(ID["a"], 2, "waiting")]
    service.broken, service.clock = set(), service.clock + datetime.timedelta(seconds=61)
    service.run(3, [("broken",)])
    assert service.end()["retries"] == [] and service.end()["chunks"] == [(ID["b"], "x"), ("new", "some text")]


def test_deletes_are_given_up_after_some_attempts_or_at_once(spark, tmp_path, monkeypatch):
    service = Service(spark, tmp_path)
    service.broken = {ID["a"]}
    deletes = [m for m in service.messages if "document.delete" in m[0]]
    for epoch in range(6):
        service.run(epoch, deletes[:1] if epoch == 0 else [("broken",)])
        service.clock += datetime.timedelta(days=1)
    assert service.end_retries() == [(5, "dead", "OBJECT_STORE_DOWN")]
    # a fault of the tables' shape isn't tried again, one of the network is
    service = Service(spark, tmp_path / "second")
    service.tables.deleted = lambda out: out["documents"].select("no such column")
    service.run(0, deletes[:1])
    assert [(a, s) for a, s, _ in service.end_retries()] == [(1, "dead")]
    service = Service(spark, tmp_path / "third")
    service.tables.remove_objects = lambda df: (_ for _ in ()).throw(ConnectionError("down"))
    service.run(0, deletes[:1])
    assert service.end_retries() == [(1, "waiting", "DELETION_FAILED")]
    # a queue that takes messages back gets those that may succeed later, and no others
    back = []
    service = Service(spark, tmp_path / "fourth")
    service.broken, service.tables.requeued = {ID["a"]}, lambda df: back.extend(json.loads(r.value) for r in df.collect())
    service.run()
    assert [(m["type"], m["document_id"]) for m in back] == [("document.delete", ID["a"])] and service.end_retries() == []


Service.end_retries = lambda self: [(r.attempts, r.state, r.error_code) for r in RetryTable(self.spark, self.tables.retries_path).read().collect()]


def test_a_retried_job_is_claimed_again(spark, tmp_path):
    service = Service(spark, tmp_path)
    service.run(0, [service.index])
    service.jobs = [(*j[:3], "pending", "queued", 0, *j[6:]) if j[0] == "j" else j for j in service.jobs]  # failed, and prepared for another try
    service.run(1, [service.index])
    assert [j[3:7] for j in service.end()["jobs"] if j[0] == "j"] == [("running", "parsing", 10, 2)]
    ledger = ClaimLedger(spark, service.tables.ledger_path)
    assert [(r.job_id, r.attempt, r.batch) for r in ledger.table.read().collect()] == [("j", 1, 1)]
    ledger.forget(spark.createDataFrame([("j", 1)], "id string, index_version int"))
    assert ledger.table.read().isEmpty()


def test_counters_take_a_batch_once(spark, tmp_path):
    path, schema = str(tmp_path / "counts"), "request_type string, model string, status string, prompt_tokens int, estimated_cost_usd decimal(18,8)"
    batches = [spark.createDataFrame([("chat", "m", "succeeded", i, None), ("embedding", None, "failed", 1, None)][: 1 + i % 2], schema) for i in range(3)]
    for epoch, batch in enumerate(batches):
        for _ in range(2):
            count_usage(batch, path, epoch)
    got = {(r.request_type, r.model): (r.calls, r.failed, r.prompt_tokens) for r in counter_table(spark, path).read().collect()}
    every = batches[0].union(batches[1]).union(batches[2])
    assert got == {(r.request_type, r.model): (r.calls, r.failed, r.prompt_tokens) for r in jobs.usage_counters(every).collect()}
    assert counter_table(spark, path).read().agg(F.sum("calls")).first()[0] == 4
