"""Cases that every operator has to take: very long texts, empty tables, columns with clashing names."""

import random
import sys
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from corpusloom.llm import decontaminate, linededup, lmscore, nearjoin, packing, quality, substrings, suffixes, tokens  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def long_docs():
    """A text of more than a slice (1 MB), a copy of it with some other words, a short part of it, and small ones."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(50_000)}" for _ in range(180_000)]
    other = list(words)
    for p in rng.sample(range(len(words)), 2000):
        other[p] = "other"
    docs = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[90_000:90_100])), (4, ""), (5, None), (6, "a b c")]
    assert len(docs[0][1]) > 1 << 20
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(2)


def test_long_texts_near_duplicates(spark, long_docs):
    got = {r[0]: tuple(r[1:]) for r in nearjoin.near_duplicates(frame(spark, long_docs)).collect()}
    assert got == brute.near_duplicates(long_docs) and got[2][1] == 1


def test_long_texts_windows_and_bytes(spark, long_docs):
    out = substrings.drop_repeated_windows(frame(spark, long_docs), texts=False).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute.drop_windows(long_docs)
    out = suffixes.drop_repeated_bytes(frame(spark, long_docs), texts=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute.drop_byte_spans(long_docs)


def test_long_texts_contamination(spark, long_docs):
    items = [(7, " ".join(long_docs[0][1].split()[150_000:150_030])), (8, "b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination_report(frame(spark, long_docs), bench).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out} == brute.contamination(long_docs, items)


def test_long_texts_tokens_and_packing(spark, long_docs):
    sizes = {i: len(e.ids) for (i, _), e in zip(long_docs, Tokenizer.from_file(PATH).encode_batch([t or "" for _, t in long_docs], add_special_tokens=False), strict=True)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_report(frame(spark, long_docs), PATH).collect()} == sizes
    packed = packing.pack(frame(spark, long_docs), PATH).toPandas()
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: n + 1 for i, n in sizes.items()}
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


def test_long_texts_lines_and_rules(spark, long_docs):
    docs = [(i, t and t.replace(" w1", "\nw1"), "s", "en", 1) for i, t in long_docs]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long")
    assert linededup.drop_boilerplate(df).count() == len(docs)
    assert {r.doc_id: r.n_words for r in quality.judge(df).collect()} == {i: len(brute.NON_SPACE.findall(t or "")) for i, t, *_ in docs}


def test_long_texts_scores(spark):
    docs = [(1, "a b c d " * 5000), (2, "a b c d"), (3, None), (4, ""), (16, "d c b a " * 5000)]
    out = {r.doc_id: r for r in lmscore.score_documents(frame(spark, docs)).collect()}
    assert out[1].n_tokens == 20_001 and out[3].n_tokens == 1 and all(r.score < 0 for r in out.values())


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == [], name
        assert name == "best-fit packing" or out.columns == docs.columns


def test_clashing_names(spark):
    names = ["n_tokens", "n_words", "kept", "n_bytes", "contamination", "_block0", "_digest", "_text", "_key", "_gone", "component", "rep", "place", "piece", "length", "bin", "offset", "final", "group", "_row", "key", "salt", "item", "size", "hash"]
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, text, "src", *["own"] * len(names)) for i in range(4)], ["doc_id", "text", "source", *names])
    bench = spark.createDataFrame([(1, text[:100], "x")], "item_id long, text string, item string")
    assert [r.n_tokens for r in tokens.token_report(df, PATH).collect()] == [len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)] * 4
    marked = decontaminate.mark_contamination(df, bench)
    assert marked.columns.count("contamination") == 1 and marked.select("contamination.n_hit", "_block0").distinct().collect()[0]["_block0"] == "own"
    assert decontaminate.drop_contaminated(df, bench).columns == df.columns and decontaminate.drop_contaminated(df, bench).count() == 0
    assert nearjoin.keep_first_of_group(df).columns == df.columns and nearjoin.keep_first_of_group(df).count() == 1
    assert linededup.drop_boilerplate(df).columns == df.columns
    assert quality.keep_good(df).columns == df.columns
    assert packing.pack(df, PATH).count() == 4
    assert substrings.drop_repeated_windows(df).count() == 4 and suffixes.drop_repeated_bytes(df, length=40).count() == 4
    assert lmscore.score_documents(df).count() == 4


def test_equal_rows_are_packed_in_several_groups(spark):
    df = spark.createDataFrame([(None, "")] * 50, "doc_id long, text string")
    out = packing.pack(df, PATH, length=16, group=8).collect()
    assert len(out) == 50 and 4 <= len({r.sequence_id for r in out}) <= 8 and len({(r.sequence_id, r.offset) for r in out}) == 50
