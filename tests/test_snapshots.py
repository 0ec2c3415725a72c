"""Tables that change from one whole state to the next."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from corpusloom.sources.snapshots import Conflict, SnapshotTable

SCHEMA = "document_id string, index_version int, content string"


def table(spark, path, **options):
    return SnapshotTable(spark, str(path), ["document_id", "index_version"], **options)


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def content(t):
    return sorted(tuple(r) for r in t.read().collect())


def test_replaces_by_key_in_growing_buckets(spark, tmp_path):
    rng, t, want = random.Random(1), table(spark, tmp_path / "t", bucket_rows=50), {}
    assert t.read() is None and t.state() is None
    for step in range(5):
        keys = [(f"d{rng.randrange(200)}", 1) for _ in range(60)] + [("d0", 2)]
        batch = {k: [(*k, f"{step}-{i}") for i in range(rng.randrange(1, 5))] for k in keys}
        t.replace(rows(spark, [r for v in batch.values() for r in v]))
        want |= batch
        assert content(t) == sorted(r for v in want.values() for r in v)
    manifest = t._manifest(t.state())
    assert manifest.select("depth", "bits").distinct().count() > 4
    assert manifest.groupBy("depth", "bits").agg(F.sum("rows").alias("n")).agg(F.max("n")).first()[0] <= 100
    # every hash has one bucket
    places = {(r.depth, r.bits) for r in manifest.collect()}
    deepest = max(d for d, _ in places)
    assert all(sum((h & ((1 << d) - 1)) == b for d, b in places) == 1 for h in range(1 << deepest))


def test_a_write_reads_and_rewrites_its_own_buckets(spark, tmp_path):
    t = table(spark, tmp_path / "t", bucket_rows=100)
    t.replace(rows(spark, [(f"d{i}", 1, "x") for i in range(5000)]))
    before = {r.file for r in t._manifest(t.state()).filter("file is not null").collect()}
    t.replace(rows(spark, [("d7", 1, "new")]))
    after = {r.file for r in t._manifest(t.state()).filter("file is not null").collect()}
    assert len(before - after) <= 4 and t.state()["rows_written"] <= 200
    assert t.read().filter("content = 'new'").count() == 1 and t.read().count() == 5000


def test_removes_keys_and_empties_buckets(spark, tmp_path):
    t = table(spark, tmp_path / "t", bucket_rows=10)
    t.replace(None, rows(spark, [("d1", 1, "")]))
    assert t.read() is None
    t.replace(rows(spark, [(f"d{i}", v, "x") for i in range(60) for v in (1, 2)]))
    t.replace(None, rows(spark, [(f"d{i}", 1, "") for i in range(60)]).select("document_id"))
    assert content(t) == []
    t.replace(rows(spark, [("d3", 1, "again")]))
    assert content(t) == [("d3", 1, "again")]
    t.replace(rows(spark, []))
    assert content(t) == [("d3", 1, "again")]


def test_a_key_with_most_rows_is_not_split_for_ever(spark, tmp_path):
    t = table(spark, tmp_path / "t", bucket_rows=20)
    for _ in range(4):
        t.replace(rows(spark, [("hot", 1, f"c{i}") for i in range(500)] + [(f"d{i}", 1, "x") for i in range(10)]))
    assert t.read().count() == 510 and t._manifest(t.state()).agg(F.max("depth")).first()[0] < 12


def test_reader_sees_one_state_while_others_write(spark, tmp_path):
    t = table(spark, tmp_path / "t", bucket_rows=50)
    t.replace(rows(spark, [(f"d{i}", 1, "0") for i in range(200)]))
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append({tuple(r) for r in t.read().groupBy("content").count().collect()})

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 4):
        t.replace(rows(spark, [(f"d{i}", 1, str(n)) for i in range(200)]))
    stop.set()
    reader.join()
    assert len(seen) > 1 and all(len(s) == 1 and next(iter(s))[1] == 200 for s in seen)


def test_of_two_writers_one_starts_again(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.replace(rows(spark, [("a", 1, "0")]))
    threads = [threading.Thread(target=lambda n=n: table(spark, tmp_path / "t").replace(rows(spark, [(f"w{n}", 1, "x")]))) for n in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert [r[0] for r in content(t)] == ["a", "w0", "w1", "w2"] and t.versions() == [0, 1, 2, 3]
    with pytest.raises(Conflict):
        t._put(3, {})
    assert not [n for n in t._names("pointers") if not n.isdigit() and not n.startswith(".")]


@pytest.mark.parametrize("at", ["_dealt", "_put"])
def test_a_write_that_fails_changes_nothing(spark, tmp_path, monkeypatch, at):
    t = table(spark, tmp_path / "t")
    t.replace(rows(spark, [("a", 1, "0"), ("b", 1, "0")]), writer="w", batch=0)

    def down(*_):
        raise ConnectionError("down")

    monkeypatch.setattr(SnapshotTable, at, down)
    with pytest.raises(ConnectionError):
        t.replace(rows(spark, [("a", 1, "1")]), writer="w", batch=1)
    monkeypatch.undo()
    assert content(t) == [("a", 1, "0"), ("b", 1, "0")] and not t.done("w", 1)
    assert t.replace(rows(spark, [("a", 1, "1")]), writer="w", batch=1) and not t.replace(rows(spark, [("a", 1, "2")]), writer="w", batch=1)
    assert content(t) == [("a", 1, "1"), ("b", 1, "0")]
    assert t.vacuum(1) >= 2 and content(t) == [("a", 1, "1"), ("b", 1, "0")] and t.versions() == [1]
    assert t.read(1).count() == 2


def test_update_merges_with_what_is_there(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ["k"], bucket_rows=3)
    for n in range(3):
        new = spark.createDataFrame([(f"k{i}", 1) for i in range(n, 10)], "k string, n int")
        t.update(new, lambda old, new=new: (new if old is None else new.unionByName(old.join(new, "k", "left_semi"))).groupBy("k").agg(F.sum("n").cast("int").alias("n")), "counter", n)
    assert {r.k: r.n for r in t.read().collect()} == {f"k{i}": min(i, 2) + 1 for i in range(10)}
