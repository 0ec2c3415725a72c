"""From raw documents to packed training sequences, in five stages.

Each stage gets what its predecessor kept as `docs` (with the columns of
documents) and returns what it keeps; the last returns the packed pieces.

Defined cases, for every stage: an empty table gives an empty table with the same
columns (the last stage: with those of pieces).  Null and empty texts fail the quality rules; stages
that meet them elsewhere let them pass, unlinked, clean, and packed as one end token.  Of rows
that repeat a text one document stays, the one with the smallest id; rows that repeat a doc_id stay or go
together.  A null source is a site of its own.  Further columns pass through up to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, linededup, nearjoin, packing, quality
from corpusloom.llm.storage import table, written

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their site's boilerplate; n_chars follows the text."""
    return linededup.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearjoin.keep_first_of_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs


#: SQL can't say which best-fit packing the local search ends in; the stages are tested one by one instead.
ORACLE_SQL = None
