"""Many evidences against many texts: one automaton for a block of evidences, and texts that stream past it.

Evidences of a source are dealt over blocks of a bounded number of characters; a block meets the
chunks of its source in order, where an automaton over all of its evidences reads each chunk once
and goes on from one chunk to the next, so that an evidence may lie across them. No text is put together, and none is read
once for each evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_evidence

#: Characters of the evidences in one automaton, about: some hundred bytes each.
BLOCK_CHARS = 200_000


def in_blocks(patterns: DataFrame, most: int = BLOCK_CHARS) -> DataFrame:
    """patterns (source, pattern) + block: a pattern's share of its source by hash, so that a block has some `most` characters."""
    sizes = patterns.groupBy("source").agg(F.ceil(F.sum(F.length("pattern")) / most).cast("int").alias("_blocks"))
    return patterns.join(sizes, "source").withColumn("block", F.pmod(F.xxhash64("pattern"), F.greatest("_blocks", F.lit(1))).cast("int")).drop("_blocks")


class _Reader:
    """The patterns of a block that occur in texts read as one."""

    def __init__(self, patterns: list[str]):
        machine = ahocorasick.Automaton()
        for p in patterns:
            machine.add_word(p, p)
        machine.make_automaton()
        self.at, self.found, self.n = machine.iter(""), set(), len(patterns)

    def read(self, text: str) -> None:
        if len(self.found) < self.n:
            self.at.set(text)  # the state stays
            self.found.update(p for _, p in self.at)


def occurring(patterns: list[str], texts) -> set[str]:
    reader = _Reader(patterns)
    for text in texts:
        reader.read(text)
    return reader.found


#: What normalize_evidence takes out.
SPACE = str.maketrans("", "", " \n\r\t`")


def found_evidence(patterns: DataFrame, chunks: DataFrame, most: int = BLOCK_CHARS) -> DataFrame:
    """patterns (source, pattern), distinct, not null or empty; chunks (source, chunk_index, content) -> (source, pattern) that occur in the source's contents in order, one after the other and normalised.

    Equal chunk_index: by content. Null contents are empty. A task holds one block of evidences and a batch of chunks.
    """
    dealt = in_blocks(patterns, most)
    asked = dealt.select("source", "block").distinct()
    texts = chunks.filter("content <> ''").select("source", "chunk_index", "content").join(asked, "source")
    rows = dealt.select("source", "block", F.lit(None).cast("long").alias("chunk_index"), F.col("pattern").alias("content"))
    rows = rows.union(texts.select("source", "block", F.col("chunk_index").cast("long"), "content"))
    rows = rows.repartition("source", "block").sortWithinPartitions("source", "block", F.asc_nulls_first("chunk_index"), "content")

    def scan(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own, reader = None, [], None
        for pdf in pdfs:
            hits: list = []
            is_text = pdf["chunk_index"].notna()
            for source, block, text, content in zip(pdf["source"], pdf["block"], is_text, pdf["content"]):
                if (source, block) != key:
                    hits += [(key[0], p) for p in reader.found] if reader else []
                    key, own, reader = (source, block), [], None
                if not text:
                    own.append(content)
                    continue
                reader = reader or _Reader(own)
                reader.read(content.translate(SPACE))
            yield pd.DataFrame(hits, columns=["source", "pattern"], dtype=object)
        if reader:
            yield pd.DataFrame([(key[0], p) for p in reader.found], columns=["source", "pattern"], dtype=object)

    return rows.mapInPandas(scan, f"source {dict(patterns.dtypes)['source']}, pattern string")


def missing_evidence(questions: DataFrame, chunks: DataFrame, most_chunks: int = 100, most: int = BLOCK_CHARS) -> DataFrame:
    """(query_id, evidence), distinct, that is in none of the expected sources' texts, white space and backticks aside. chunks: (source, chunk_index, content); a source counts with its first most_chunks.

    questions (query_id, expected_sources, expected_evidence). An evidence that is null, or whose question expects no source, is missing; one of white space alone is in every source that has a chunk.
    """
    wanted = questions.select("query_id", "expected_sources", F.explode("expected_evidence").alias("evidence"))
    pairs = wanted.select("query_id", "evidence", F.explode_outer("expected_sources").alias("source"), normalize_evidence(F.col("evidence")).alias("pattern"))
    first = chunks.filter((F.col("chunk_index") < most_chunks) & F.col("source").isNotNull())
    patterns = pairs.filter("pattern <> ''").select("source", "pattern").distinct().filter("source is not null")
    hits = found_evidence(patterns, first, most)
    blank = first.select("source").distinct().withColumn("pattern", F.lit(""))
    hits = hits.union(blank).withColumn("hit", F.lit(True))
    seen = pairs.join(hits, ["source", "pattern"], "left").groupBy("query_id", "evidence").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("found"))
    return seen.filter(~F.col("found")).select("query_id", "evidence")
