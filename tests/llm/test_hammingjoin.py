"""The multi-index Hamming join against all pairs, and what pigeonholing promises."""

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from corpusloom.llm import hammingjoin, nearjoin  # noqa: E402


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4)


def found(df):
    rows = hammingjoin.near_duplicates(df).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_every_pair_within_the_threshold_shares_a_key():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 2**16, hammingjoin.VALUES).astype("<u2")
        b = a.copy()
        at = rng.choice(hammingjoin.VALUES, hammingjoin.THRESHOLD, replace=False)
        b[at] ^= rng.integers(1, 2**16, len(at)).astype("<u2")
        assert set(hammingjoin.keys_of(a[None])[0]) & set(hammingjoin.keys_of(b[None])[0])
    # the worst case: one error fewer than two in every chunk
    b = a.copy()
    b[: hammingjoin.VALUES : hammingjoin.CHUNK] ^= 1
    b[1 : hammingjoin.VALUES - hammingjoin.CHUNK : hammingjoin.CHUNK] ^= 1
    assert (a != b).sum() == hammingjoin.THRESHOLD
    assert len(set(hammingjoin.keys_of(a[None])[0]) & set(hammingjoin.keys_of(b[None])[0])) == 1
    b[hammingjoin.VALUES - 1] ^= 1
    assert not set(hammingjoin.keys_of(a[None])[0]) & set(hammingjoin.keys_of(b[None])[0])


def test_distance_follows_the_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        shared, own = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64), rng.integers(0, 2**63, 2000 - int(2000 * share), dtype=np.uint64)
        half = len(own) // 2
        a, b = np.concatenate((shared, own[:half])), np.concatenate((shared, own[half:]))
        same = (hammingjoin.signature(a) == hammingjoin.signature(b)).mean()
        assert abs(same - share) < 0.2


def near_copies(rng, n, words, changes):
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for p in rng.sample(range(words), rng.randrange(0, changes)):
            w[p] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


def test_groups_around_the_threshold(spark):
    rng = random.Random(3)
    texts = [t for words, changes in ((40, 3), (60, 4), (120, 8), (300, 14), (20, 2), (6, 2), (5, 2)) for _ in range(4) for t in near_copies(rng, 12, words, changes)]
    texts += ["one two three"] * 5 + ["One TWO three", "", None, "a b c d", "a b c d e", "\t\n"]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 30))) for _ in range(80)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    assert found(frame(spark, docs)) == brute.near_duplicates(docs, 4, 80)


def test_one_large_group_in_blocks(spark, monkeypatch):
    """Many sets under a key, some linked and some not, with small blocks and hubs."""
    monkeypatch.setattr(nearjoin, "FEW", 4)
    monkeypatch.setattr(nearjoin, "BLOCK", 2000)
    monkeypatch.setattr(nearjoin, "PARTNERS", 8)
    rng = random.Random(4)
    docs = list(enumerate(t for _ in range(3) for t in near_copies(rng, 60, 80, 9)))
    assert found(frame(spark, docs)) == brute.near_duplicates(docs, 4, 80)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (5, text), (7, text + " more"), (9, None), (11, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hammingjoin.near_duplicates(frame(spark, rows)).collect()}
    assert got == {None: (47, None), 5: (47, None), 7: (48, None), 9: (0, 9), 11: (0, 11)}
    again = hammingjoin.near_duplicates(frame(spark, [(2, text), (2, text), (3, text)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in again) == [(2, 2, True), (2, 2, True), (3, 2, False)]
    assert hammingjoin.near_duplicates(frame(spark, [])).collect() == []
    clash = spark.createDataFrame([(1, text, 1, "x"), (2, text, 1, "x")], "doc_id long, text string, rep int, shingle string")
    assert {r.component_id for r in hammingjoin.near_duplicates(clash).collect()} == {1}
    with pytest.raises(ValueError):
        hammingjoin.near_duplicates(frame(spark, rows), percent=60)


def test_long_texts(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(50_000)}" for _ in range(180_000)]
    other = list(words)
    for p in rng.sample(range(len(words)), 2000):
        other[p] = "other"
    docs = [(1, " ".join(words)), (2, " ".join(other)), (3, "a b c"), (4, " ".join(words[:100]))]
    assert found(frame(spark, docs)) == brute.near_duplicates(docs, 4, 80)


def test_repeated_keys_are_found_across_batches():
    rows = sorted((k, i) for k in range(200) for i in range(1 + k % 3))
    table = pa.table({"shingle": [r[0] for r in rows], "rep": [r[1] for r in rows], "n": [1] * len(rows)})
    for size in (1, 2, 3, 7, 1000):
        out = pa.Table.from_batches(list(hammingjoin._repeated(iter(table.to_batches(max_chunksize=size)))))
        got = list(zip(out.column("shingle").to_pylist(), out.column("rep").to_pylist()))
        assert got == [r for i, r in enumerate(rows) if r[0] % 3 or i in (0, len(rows) - 1)]
