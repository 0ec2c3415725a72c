"""Whitening of embeddings and the trie of conversations, against plain versions."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from corpusloom.llm import prefixtrie, whitening  # noqa: E402


def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + more).repartition(3)


def checked(spark, rows):
    """Compares whiten() with a full eigendecomposition."""
    out = whitening.whiten(vectors(spark, rows)).toPandas()
    kept = [(i, np.floor(256 * np.float32(v).astype(float))) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    d = max(len(x) for _, x in kept)
    kept = [(i, x) for i, x in kept if len(x) == d]
    fit = np.unique(np.stack([x for _, x in kept]), axis=0)
    n, centred = len(fit), fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(4, int((values > 1e-9 * max(values[0], 1)).sum()))
    assert len(out) == k * len(kept) and (out.n == n).all() and (out.identity_error < 1e-8).all()
    sums = fit.sum(axis=0)
    for j in range(k):
        part = out[out.component == j + 1].sort_values(["vec_id", "deviation"])
        assert part.explained.to_numpy() == pytest.approx(values[j] / values.sum(), rel=1e-9)
    by_id = {}
    for r in out.itertuples():
        by_id.setdefault(r.vec_id, []).append(r)
    for i, x in kept:
        assert {r.deviation for r in by_id[i]} == {int(((n * x - sums) ** 2).sum())}
    return out, kept, fit, values, axes


def test_whitening_is_the_eigendecomposition(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(12) * np.arange(1, 13) / 10).tolist()) for i in range(300)]
    out, kept, fit, values, axes = checked(spark, rows)
    x = np.stack([v for _, v in kept])
    want = (x - fit.mean(axis=0)) @ axes[:, :4] / np.sqrt(values[:4])
    got = out.sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(-1, 4)
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-9)
    assert len(np.unique(np.round(got / want), axis=0)) == 1  # one sign for all rows


def test_whitening_of_the_given_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    checked(spark, rows)


def test_whitening_of_equal_eigenvalues_and_few_directions(spark):
    corners = [(4 * a + 2 * b + c, [float(a), float(b), float(c)]) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    checked(spark, corners)  # three equal eigenvalues
    checked(spark, [(i, [float(i), 2.0 * i, 0.0, 5.0]) for i in range(9)])  # one direction
    checked(spark, [(i, [float(i * i)]) for i in range(9)])  # one dimension


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, []), (8, [1.0]), (9, [-0.0, 0.001]), (9, [-0.0, 0.001])]
    rows += [(100 + i, [1.0, 2.0]) for i in range(40)]  # a group of copies is fitted once
    out, *_ = checked(spark, rows)
    assert set(out.vec_id) == {1, 2, 9, *range(100, 140)} and (out.n == 3).all()
    assert whitening.whiten(vectors(spark, [(None, [0.0, 1.0]), (2, [1.0, 5.0])])).filter("vec_id is null").count() == 1
    big = whitening.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    assert {r.deviation for r in big} == {None}
    for none in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, None)]):
        assert whitening.whiten(vectors(spark, none)).collect() == []
    clash = vectors(spark, [(i, [float(i), 1.0], 7, 8) for i in range(5)], ", n int, component int")
    assert whitening.whiten(clash).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_partial_sums_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "GATHERED", 1)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    checked(spark, [(i, rng.standard_normal(5).tolist()) for i in range(200)])


def turns(spark, rows, more=""):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string" + more).repartition(3)


def nodes(df, **options):
    return sorted(tuple(r) for r in prefixtrie.prefix_nodes(df, **options).collect())


@pytest.mark.parametrize("shard_turns", [1, 5, 40, 16_384])
def test_trie_in_shards_of_all_sizes(spark, shard_turns):
    rng = random.Random(shard_turns)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d  e\tf"])) for c in range(150) for t in range(rng.randrange(0, 6))]
    rows += [(1000 + c, t, "user", "same") for c in range(60) for t in range(3)]  # a group of copies
    rows += [(2000 + c, t, "user", "long" if t < 20 else f"x{c}") for c in range(12) for t in range(23)]  # a long shared path
    assert nodes(turns(spark, rows), shard_turns=shard_turns) == sorted(brute.prefix_nodes(rows))


def test_trie_of_odd_rows(spark):
    rows = [(0, None, None, "x"), (0, 1, "user", None), (0, 1, "user", None), (0, 1, "a", "b"), (3, 5, "", ""), (21, 2, "u", "t"), (21, None, "u", "t"), (-7, 1, "u", "t"), (None, 1, "u", "t"), (45, 1, None, None)]
    rows += [(7, i, "user", "word " * 3) for i in range(300)] + [(8, 0, "user", "w" * 200_000)]
    assert nodes(turns(spark, rows)) == sorted(brute.prefix_nodes(rows))
    assert nodes(turns(spark, [])) == []
    clash = turns(spark, [(*r, 1, "s") for r in rows], ", n int, steps string")
    assert nodes(clash) == sorted(brute.prefix_nodes(rows))


def test_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 7)
    rows = [(c, 0, "user", "hello") for c in range(1, 500)]
    assert nodes(turns(spark, rows)) == sorted(brute.prefix_nodes(rows))


def test_double_array_holds_each_step_once():
    rng = np.random.default_rng(5)
    seqs = [rng.integers(1, 30, rng.integers(0, 9)) for _ in range(400)]
    first = np.concatenate(([0], np.cumsum([len(s) for s in seqs])))
    trie = prefixtrie.build(np.concatenate(seqs), first)
    ends = {}
    for s in seqs:
        at = np.zeros(1, np.int64)
        for t in s:
            at = trie.step(at, np.array([t]))
            assert at[0] > 0
        assert ends.setdefault(int(at[0]), tuple(s)) == tuple(s)
    assert len(ends) == len({tuple(s) for s in seqs})
    assert trie.step(np.zeros(1, np.int64), np.array([99]))[0] == -1
