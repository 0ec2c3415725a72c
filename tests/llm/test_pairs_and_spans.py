"""Operators on repeats and near duplicates against plain Python versions."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from corpusloom.llm import decontaminate, nearjoin, substrings, suffixes  # noqa: E402

WORDS = "alpha beta gamma delta one two three é ß".split()


def corpus(seed, n=60, words=90):
    """Copies, near copies, shared passages, short, empty and null texts."""
    rng = random.Random(seed)
    vocabulary = WORDS + [f"w{i}" for i in range(400)]
    base = [rng.choices(vocabulary, k=rng.randint(0, words)) for _ in range(8)]
    docs = []
    for i in range(n):
        t = list(rng.choice(base))
        kind = rng.random()
        if kind < 0.4:
            for _ in range(rng.randint(1, 4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(vocabulary)
        elif kind < 0.6:
            t = t[: rng.randint(0, len(t))] + rng.choice(base)
        elif kind < 0.7:
            t = t[:4]
        docs.append((i, None if rng.random() < 0.05 else rng.choice([" ", "\n", "\t  "]).join(t)))
    return docs


def frame(spark, docs):
    """With extra columns of names that operators use themselves."""
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, key string, n long")
    return df.repartition(4)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    docs = corpus(seed)
    got = {r[0]: tuple(r[1:]) for r in nearjoin.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute.near_duplicates(docs)


@pytest.mark.parametrize("few,block", [(32, 100_000), (2, 600)])
def test_groups_just_below_the_threshold(spark, monkeypatch, few, block):
    """Hundreds of near copies of one text, most pairs just below 75 %, some above: every link is found, whatever blocks they fall into."""
    monkeypatch.setattr(nearjoin, "FEW", few)
    monkeypatch.setattr(nearjoin, "BLOCK", block)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(400):
        t = list(base)
        for p in rng.sample(range(120), rng.choice([2, 4, 5])):
            t[p] = f"x{rng.randrange(10**6)}"
        docs.append((i * 7 % 400, " ".join(t)))
    docs += [(1000 + i, t) for i, t in corpus(8, n=40)]
    want = brute.near_duplicates(docs)
    groups = {c for i, (_, c) in want.items() if i < 1000}
    assert 20 < len(groups) < 380  # neither all linked nor all apart
    assert {r[0]: tuple(r[1:]) for r in nearjoin.near_duplicates(frame(spark, docs)).collect()} == want


def test_shared_counts_and_joining_links():
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = ([np.unique(rng.integers(0, 10 ** rng.integers(1, 4), 40)) for _ in range(n)] for n in (30, 50))
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert (nearjoin._shared_counts(x, y) == want).all()
    assert (nearjoin._shared_counts(x[:1], [np.array([10**9])]) == 0).all()
    links = np.argwhere(rng.random((30, 50)) < 0.03)
    left, right = np.arange(30), np.arange(30, 80)
    from collections import defaultdict

    def classes(edges):
        near = defaultdict(set)
        for i, j in edges:
            near[i].add(30 + j)
            near[30 + j].add(i)
        out = {}
        for v in range(80):
            todo = [v]
            while todo:
                u = todo.pop()
                if u not in out:
                    out[u] = v
                    todo += near[u]
        return out

    few = list(nearjoin._joining(links, left.copy(), right.copy()))
    assert classes(few) == classes(links.tolist()) and len(few) < 80


def test_near_duplicate_groups_keep_the_smallest(spark):
    docs = corpus(3)
    want = brute.near_duplicates(docs)
    kept = nearjoin.keep_first_of_group(frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "key", "n"]
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_near_duplicates_chain_links_of_links(spark):
    words = [f"t{i}" for i in range(200)]
    docs = [(i, " ".join([f"x{i}a{j}" for j in range(i * 4)] + words[i * 4 :])) for i in range(12)]
    got = {r[0]: tuple(r[1:]) for r in nearjoin.near_duplicates(frame(spark, docs)).collect()}
    want = brute.near_duplicates(docs)
    assert got == want and len({c for _, c in want.values()}) < len(docs)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (7, None), (None, "")], "doc_id long, text string")
    near = {(r.doc_id, r.component_id) for r in nearjoin.near_duplicates(df).collect()}
    assert near == {(None, None), (5, None), (7, 7)}
    left = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substrings.drop_repeated_windows(df).collect())
    assert left == [("5", 40, 40), ("5", 40, 40), ("7", 0, 0), ("None", 0, 0), ("None", 40, 0)]
    sizes = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffixes.drop_repeated_bytes(df, length=40).collect())
    n = len(text)
    assert sizes == [("5", n, n), ("5", n, n), ("7", 0, 0), ("None", 0, 0), ("None", n, n)]


@pytest.mark.parametrize("window", [20, 7, 1])
def test_repeated_windows(spark, window):
    docs = corpus(window)
    out = substrings.drop_repeated_windows(frame(spark, docs), window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute.drop_windows(docs, window)
    assert all(brute.sha(bytes(r.kept)) == r.kept_sha256 for r in out)


@pytest.mark.parametrize("length", [16, 60])
def test_repeated_bytes(spark, length, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 3000)  # many buckets, so that matches cross boundaries
    monkeypatch.setattr(suffixes, "OFTEN", 3)
    docs = corpus(length)
    out = suffixes.drop_repeated_bytes(frame(spark, docs), length=length).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute.drop_byte_spans(docs, length)


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_contamination(spark, rows):
    docs, items = corpus(11), [(i, t) for i, t in corpus(11, n=9, words=40)] + [(100, "two three"), (101, "one"), (102, ""), (103, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.mark_contamination(frame(spark, docs), bench, broadcast_rows=rows).collect()
    want = brute.contamination(docs, items)
    for r in out:
        c = r.contamination
        n_words, n_hit, n_items, items_sha, _ = want[r.doc_id]
        assert (c.n_words, c.n_hit, len(c["items"]), brute.sha(",".join(c["items"]))) == (n_words, n_hit, n_items, items_sha)
        assert sum(t - f for f, t in zip(c.hit_from, c.hit_to, strict=True)) == n_hit
    kept = decontaminate.drop_contaminated(frame(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert nearjoin.near_duplicates(docs).collect() == []
    assert substrings.drop_repeated_windows(docs).collect() == []
    assert suffixes.drop_repeated_bytes(docs).collect() == []
    assert decontaminate.contamination_report(docs, bench).collect() == []
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontaminate.contamination_report(some, bench).select(F.sum("n_hit")).first()[0] == 0


def test_delegates_across_slices_and_tasks(monkeypatch):
    """Anchors and windows over many small slices in three tasks: each repeat is found, and a hot one sends few rows to its common group."""
    from collections import Counter, defaultdict

    import pyarrow as pa

    monkeypatch.setattr(substrings, "SLICE", 300)
    docs = corpus(4, n=200, words=50)
    docs = [(i, "hot " * 25 + (t or "") if i % 3 else t) for i, t in docs]
    random.Random(3).shuffle(docs)
    tasks = [docs[:80], docs[80:150], docs[150:]]

    def rows(function, parts):
        out = []
        for part in parts:
            for b in function(iter([part])):
                out += [tuple(r.values()) for r in b.to_pylist()]
        return out

    batch = lambda part, **more: pa.RecordBatch.from_pydict({"key": pa.array([i for i, _ in part], pa.int64()), "text": pa.array([t for _, t in part], pa.string()), **more})
    met = rows(substrings._anchor_rows(7), [batch(p) for p in tasks])
    total = Counter()
    for anchor, salt, _, n in met:
        total[anchor, salt] += n
    live = defaultdict(set)
    for anchor, salt, key, _ in met:
        if total[anchor, salt] > 1:
            live[key].add(anchor)
    hot = [batch(p, anchors=pa.array([sorted(live[i]) for i, _ in p], pa.list_(pa.int64()))) for p in ([d for d in p if d[0] in live] for p in tasks)]
    found = rows(substrings._window_rows(7), hot)
    first = {}
    for window, salt, key, place, _ in found:
        first[window, salt] = min(first.get((window, salt), (key, place)), (key, place))
    repeats = {(key, place) for window, salt, key, place, repeat in found if repeat or first[window, salt] != (key, place)}
    seen, want = set(), set()
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = brute.NON_SPACE.findall(t or "")
        for s in range(len(w) - 6):
            if tuple(w[s : s + 7]) in seen:
                want.add((i, s))
            seen.add(tuple(w[s : s + 7]))
    assert repeats == want
    common = Counter(anchor for anchor, salt, _, _ in met if salt == 0)
    assert max(common.values()) < max(Counter(anchor for anchor, *_ in met).values()) / 4


def test_repeated_bytes_at_the_length_of_the_query(spark, monkeypatch):
    """Strings of 400 bytes: one passage in every document, long ones in some (their contexts fill several buckets), one that is a byte too short."""
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 20_000)
    rng = random.Random(9)
    some = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    everywhere, longs, short = some(430), [some(rng.randint(700, 3000)) for _ in range(6)], "x" + "".join(rng.choices("stuvw", k=398))
    docs = []
    for i in range(90):
        parts = [some(rng.randint(50, 600)), everywhere, some(rng.randint(1, 200))]
        if i % 4 == 0:
            parts.insert(rng.randint(0, 3), rng.choice(longs))
        if i % 5 == 0:
            parts.append(chr(65 + i // 5) + short + chr(65 + i // 5))
        docs.append((i, "".join(parts)))
    out = suffixes.drop_repeated_bytes(frame(spark, docs)).collect()
    want = brute.drop_byte_spans(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == want
    assert all(w[1] >= len(everywhere.encode()) for w in want.values()) and sum(w[2] > 1 for w in want.values()) > 5
    assert all(short.encode() in bytes(r.kept) for r in out if r.doc_id % 5 == 0)
