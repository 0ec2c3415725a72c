"""Each stage on what the one before kept, against plain versions."""

import sys
from pathlib import Path

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from corpusloom.llm import linededup, quality  # noqa: E402
from corpusloom.llm.storage import written  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = [f for _, f in corpus_pipeline.STAGES]
    for number, stage in enumerate(stages):
        before = docs.toPandas()
        docs = written(stage(spark, docs, sf_dir), "test")
        after = docs.toPandas()
        db = duckdb.connect()
        db.register("stage_input", before)
        texts = list(zip(before.doc_id.tolist(), before.text.tolist(), strict=True))
        if number < 4:
            assert docs.columns == COLUMNS
        got = dict(zip(after.doc_id.tolist(), after.text.tolist(), strict=True)) if number < 4 else None
        if number == 0:
            want = db.sql("with " + quality.COUNTS_SQL.format(docs="stage_input") + " select doc_id, text from judged where kept").fetchall()
            assert got == dict(want)
        elif number == 1:
            assert got == dict(db.sql("with " + linededup.CLEAN_SQL.format(docs="stage_input") + " select doc_id, text from clean").fetchall())
        elif number == 2:
            assert set(got) == {i for i, (_, c) in brute.near_duplicates(texts).items() if i == c}
        elif number == 3:
            assert set(got) == {i for i, w in brute.contamination(texts, items).items() if not w[4]}
        else:
            sizes = [len(e.ids) + 1 for e in Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch([t for _, t in texts], add_special_tokens=False)]
            assert after.groupby("doc_id").length.sum().to_dict() == dict(zip([i for i, _ in texts], sizes, strict=True))
            assert after.groupby("sequence_id").length.sum().max() <= 4096
            assert after.sequence_id.nunique() <= 1.05 * -(-sum(sizes) // 4096) + 1


def test_queries_and_sql_agree_on_names():
    from corpusloom.llm import queries

    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 10
