"""Tokens and packing against the library, and the language model on held-out texts."""

import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from corpusloom.llm import lmscore, packing, tokens  # noqa: E402
from corpusloom.llm.recurrent import Classes, Model, deal  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Hello World's café it'll <|endoftext|> x<|startoftext|>y ½ 12", "", "   ", None, "日本語 и русский ΣΑΣ İx", "a" * 300, "!!''s CAN'T", "\x1c a\x1fb \x85 c", "zero​width 👩‍👧", "ǅ ﬁ ẞ \x00"]


def library(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_are_the_librarys(spark, sf_dir):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choices("abcdeABC 'éß12½!?.,\n«–’Жœ́漢\xa0", k=rng.randint(1, 50))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.token_report(df, PATH).collect()}
    want = library(texts)
    assert [got[i].n_tokens for i in range(len(texts))] == [len(x) for x in want]
    assert all(got[i].over_limit == (len(x) > 2048) and got[i].n_bytes == len((texts[i] or "").encode()) for i, x in enumerate(want))


def test_merging_is_rank_synchronous_and_exact():
    model = tokens.pair_merges(PATH)
    ids, sizes = model.merged(["hello", "aaaaaaa", "é", "", "thethe"])
    assert sizes.tolist()[3] == 0 and ids.tolist() == sum(library(["hello", "aaaaaaa", "é", "", "thethe"]), [])


def packed(spark, texts, **options):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length long")
    return packing.pack(df, PATH, **options).collect()


def test_packing_covers_every_token_once(spark):
    texts = ODD + [" ".join(["word"] * n) for n in (1, 10, 63, 64, 65, 300)] * 20 + ["same", "same"]
    rows = packed(spark, texts, length=64, group=40)
    want = library(texts)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, ids in enumerate(want):
        ids = [*ids, 1]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 64)) and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    for own in by_sequence.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 64
    assert len(by_sequence) <= 1.1 * math.ceil(sum(len(x) + 1 for x in want) / 64)


def test_local_search_empties_bins():
    sizes, start = np.array([7, 2, 8, 3]), np.array([0, 0, 1, 2])
    out = packing.local_search(sizes, start, 10)  # 3 for 2, then 2 into the other gap
    fill = np.bincount(out, sizes)
    assert fill.max() <= 10 and (fill > 0).sum() == 2 and (fill**2).sum() > (np.bincount(start, sizes) ** 2).sum()
    sizes = np.array([6, 3, 9, 2, 2, 5])  # nothing fits; two for one fills the first bin
    out = packing.local_search(sizes, np.array([0, 0, 1, 2, 2, 3]), 10)
    assert (np.bincount(out, sizes) <= 10).all() and len(out) == 6


def test_packing_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_gradients():
    rng = np.random.default_rng(0)
    layout = Classes((0, 2, 5), 2)
    model = Model.fresh(layout, 3, np.array([5, 4, 3, 2]), np.arange(5)[::-1] + 1)
    model.values = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in model.values.items()}
    ids, sizes = rng.integers(0, 7, 40), np.array([9, 12, 3, 16])
    lanes = deal(ids, sizes, 2)
    inputs, outputs, keep, live, _ = next(model._windows(lanes))
    h = np.zeros((inputs.shape[1], 3))

    def loss():
        _, after, _ = model._states(inputs, keep, h)
        x, y = after.reshape(-1, 3), outputs.ravel()
        c = layout.class_of(y)
        from corpusloom.llm.recurrent import _log_softmax

        logs = _log_softmax(x @ model.values["class_out"] + model.values["class_bias"])[np.arange(len(y)), c]
        for k, rows in model._by_class(c):
            a, b = layout.bounds[k], layout.bounds[k + 1]
            logs[rows] += _log_softmax(x[rows] @ model.values["word_out"][a:b].T + model.values["word_bias"][a:b])[np.arange(len(rows)), y[rows] - a]
        mask = live.ravel()
        return -logs[mask].sum() * 16 / mask.sum()

    model_states = model._states
    import corpusloom.llm.recurrent as recurrent

    float32, recurrent.np.float32 = np.float32, np.float64
    try:
        trace, after, _ = model_states(inputs, keep, h)
        grads = model._gradients(trace, after, inputs, outputs, keep, live)
        for name in ("state", "class_out", "word_out", "word_bias"):
            at = tuple(rng.integers(0, s) for s in model.values[name].shape)
            step = 1e-5
            model.values[name][at] += step
            up = loss()
            model.values[name][at] -= 2 * step
            down = loss()
            model.values[name][at] += step
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-4, name
    finally:
        recurrent.np.float32 = float32


def test_scores(spark):
    """Base scores as in plain Python; the model beats them on held-out texts."""
    rng = random.Random(1)
    texts = []
    for _ in range(300):
        words = ["red green blue", "uno dos tres"][rng.random() < 0.5].split()
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))))
    texts += [None, "", "NEW Unseen words", "red"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "red green")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id long")
    out = lmscore.score_documents(df).collect()
    assert len(out) == len(rows)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    coded = [(i, [*word.findall(brute.lower(t)), None]) for i, t in rows]
    counts = Counter(w for i, ws in coded if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in coded)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    test = [r for r in out if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test) and all(r.score < 0 for r in out)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_the_model_beats_the_base_on_the_given_documents(spark, table):
    """One small partition, a single copy of the model: the case in which too wide lanes once left it below the base."""
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet").coalesce(1)
    out = lmscore.score_documents(docs).groupBy("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).collect()
    for r in out:
        assert r.score / r.n > r.base / r.n + 0.1 and r.better > 0.75, r


def test_scores_of_an_empty_table(spark):
    assert lmscore.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_model_learns_every_word_of_the_head():
    """A vocabulary that grows with the counts; trained rows differ for words that aren't among the most frequent."""
    counts = np.sort(np.random.default_rng(3).integers(1, 50, 3000))[::-1]
    hashes = np.arange(1, 3001).astype(np.uint64)
    head = lmscore.Head.of(hashes, counts, int(counts.sum()), 3000)
    assert head.layout.words == 3000 and sorted(head.ids) == list(range(3000)) and head.layout.learned > 16
    model = Model.fresh(head.layout, 4, head.class_counts, head.word_counts)
    pairs = np.tile(np.arange(2000, 3000), 40)  # rare words, always in the same order
    before = model.scores(deal(pairs, np.full(40, 1000), 8), 40).sum()
    model.train(deal(pairs, np.full(40, 1000), 8))
    assert (model.values["word_out"][2000:] != 0).any(axis=1).all()
    assert model.scores(deal(pairs, np.full(40, 1000), 8), 40).sum() > before
    x = np.random.default_rng(4).normal(0, 1, 4).astype(np.float32)
    ids = np.arange(head.layout.words + lmscore.TAILS)
    assert abs(np.exp(model._logs(np.tile(x, (len(ids), 1)), ids)).sum() - 1) < 1e-3


def test_every_round_trains_on_all_training_documents(spark):
    rows = [(i, f"w{i} common w{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5, "id")
    counts = df.mapInArrow(lmscore._count_rows, "word long, n long").groupBy("word").sum("n").toPandas().sort_values("sum(n)", ascending=False)
    known = lmscore.Head.of(counts["word"].to_numpy(np.int64).view(np.uint64), counts["sum(n)"].to_numpy(np.int64), int(counts["sum(n)"].sum()), len(counts))
    head = spark.sparkContext.broadcast(known)
    model, flat = Model.fresh(known.layout, lmscore.HIDDEN, known.class_counts, known.word_counts), None
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    for _ in range(2):
        seen = sum(np.frombuffer(r.n, np.float32)[0] for r in df.mapInArrow(lmscore._train_rows(head, flat), "block long, at binary, n binary, delta binary").collect() if r.block >> 32 == sorted(model.values).index("state"))
        assert seen == 4 * len(train)
        after = lmscore.averaged(df, head, model, flat)
        moved = (after.values["inputs"] != model.values["inputs"]).any(axis=1)
        model, flat = after, spark.sparkContext.broadcast(after.flat())
    # outputs start at zero, so inputs move from the second update on: each word but the end token, however few tasks met it
    assert moved[: known.layout.words].sum() == known.layout.words - 1


def test_local_search_goes_on_after_bins_that_stay():
    sizes = np.array([51] * 30 + [10] * 40)  # thirty bins that nothing empties come first
    start = np.concatenate((np.arange(30), 30 + np.arange(40) // 8))
    out = packing.local_search(sizes, start, 100)
    assert np.bincount(out, sizes).max() <= 100 and len(np.unique(out)) <= 34


def test_scores_equal_a_plain_forward_pass():
    """Word by word, with the state carried through whole documents that are longer than a window."""
    rng = np.random.default_rng(6)
    layout = Classes((0, 2, 5), 2)
    model = Model.fresh(layout, 3, np.array([5, 4, 3, 2]), np.arange(5)[::-1] + 1)
    model.values = v = {k: (x + rng.normal(0, 0.4, x.shape)).astype(np.float32) for k, x in model.values.items()}
    ids, sizes = rng.integers(0, 7, 130), np.array([70, 1, 40, 19])
    want, at = [], 0
    soft = lambda x, i: float(x[i] - np.log(np.exp(x).sum()))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for n in sizes:
        h, before, total = np.zeros(3), layout.start, 0.0
        for w in ids[at : at + n].tolist():
            g, own = v["inputs"][before], h @ v["state"]
            z, r = sigmoid(g[:3] + own[:3]), sigmoid(g[3:6] + own[3:6])
            new = np.tanh(g[6:] + r * own[6:])
            h = new + z * (h - new)
            c = 0 if w < 2 else 1 if w < 5 else 2 + w - 5
            total += soft(h @ v["class_out"] + v["class_bias"], c)
            if c < 2:
                a, b = layout.bounds[c : c + 2]
                total += soft(v["word_out"][a:b] @ h + v["word_bias"][a:b], w - a)
            before = w
        want.append(total)
        at += n
    for lanes in (1, 2, 4):
        assert np.allclose(model.scores(deal(ids, sizes, lanes), 4), want, rtol=1e-4)


def test_lanes_hold_every_word_once_whatever_the_longest_text():
    sizes = np.array([100_000, *[3] * 511])
    ids = np.arange(sizes.sum())
    lanes = deal(ids, sizes, 512)
    assert sum(x.nbytes for x in (lanes.ids, lanes.begins, lanes.owner)) < 10 * len(ids)
    seen = [(i, o) for _, i, _, live, owner in lanes.windows(7) for i, o in zip(i[live].tolist(), owner[live].tolist(), strict=True)]
    assert sorted(seen) == list(zip(ids.tolist(), np.repeat(np.arange(512), sizes).tolist(), strict=True))


def test_the_head_is_found_by_a_histogram(spark):
    rows = [(w, n) for w, n in enumerate([1000, 1000, 500, 7, 7, 7, 1, 1])]
    df = spark.createDataFrame(rows, "word long, n long")
    for most, want in ((8, 8), (7, 6), (6, 6), (5, 3), (2, 2), (1, 0)):
        assert lmscore.frequent(df, most).count() == want
    assert lmscore.frequent(df.limit(0), 3).count() == 0


def test_groups_of_classes():
    """Many classes are factored into groups: chances of all words sum to one, the fresh model is the unigram model, and gradients are those of the loss."""
    rng = np.random.default_rng(8)
    counts = np.sort(rng.zipf(1.3, 4000).clip(1, 10**5))[::-1].astype(np.int64)
    head = lmscore.Head.of(np.arange(1, 4001).astype(np.uint64), counts, int(counts.sum()) + 50, 4010)
    model = Model.fresh(head.layout, 3, head.class_counts, head.word_counts)
    assert len(head.layout.groups) > 3
    ids = np.arange(head.layout.words + lmscore.TAILS)
    x = np.tile(rng.normal(0, 1, 3).astype(np.float32), (len(ids), 1))
    learned = np.diff(head.layout.bounds)
    classes = np.append(head.class_counts + 1, []) / (head.class_counts + 1).sum()
    within = (counts + 1) / np.repeat(np.add.reduceat(counts + 1.0, head.layout.bounds[:-1]), learned)
    assert np.allclose(np.exp(model._logs(x, ids)), np.append(np.repeat(classes[:-1], learned) * within, classes[-1]), rtol=1e-3)
    model.values = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in model.values.items()}
    assert abs(np.exp(model._logs(x, ids)).sum() - 1) < 1e-3
    import corpusloom.llm.recurrent as recurrent

    float32, recurrent.np.float32 = np.float32, np.float64
    try:
        model.values = {k: v.astype(np.float64) for k, v in model.values.items()}
        sizes = np.array([9, 12, 3, 16])
        inputs, outputs, keep, live, _ = next(model._windows(deal(rng.integers(0, len(ids), 40) // rng.integers(1, 30, 40), sizes, 2)))
        h = np.zeros((inputs.shape[1], 3))

        def loss():
            logs = model._logs(model._states(inputs, keep, h)[1].reshape(-1, 3), outputs.ravel())
            return -logs[live.ravel()].sum() * 16 / live.sum()

        trace, after, _ = model._states(inputs, keep, h)
        grads = model._gradients(trace, after, inputs, outputs, keep, live)
        assert set(grads) == set(model.values)
        for name, g in grads.items():
            for at in zip(*np.unravel_index(np.argsort(-abs(g).ravel())[[0, 1, 5, 40]] if g.size > 40 else [0], g.shape), strict=True):
                step = 1e-5
                model.values[name][at] += step
                up = loss()
                model.values[name][at] -= 2 * step
                down = loss()
                model.values[name][at] += step
                assert abs((up - down) / (2 * step) - g[at]) < 1e-4, name
    finally:
        recurrent.np.float32 = float32


def test_a_window_trains_few_words_of_a_large_head():
    """The work of a window goes with its words: once it moved nearly every word of the head."""
    counts = (2e6 / np.arange(5, 60005)).astype(np.int64)
    head = lmscore.Head.of(np.arange(1, 60001).astype(np.uint64), counts, int(counts.sum()), 60000)
    model = Model.fresh(head.layout, 4, head.class_counts, head.word_counts)
    words = np.random.default_rng(9).choice(60000, 4096, p=counts / counts.sum())
    model.train(deal(words, np.full(256, 16), 256))
    assert (model.values["word_bias"] != Model.fresh(head.layout, 4, head.class_counts, head.word_counts).values["word_bias"]).mean() < 0.4
