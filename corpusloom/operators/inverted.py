"""An inverted index of chunks and exact lexical top-k by score bounds.

Postings are rows (knowledge_base_id, term, block, n, top, hits): the chunks of a block that hold the
term with their counts, how many, and the largest count.  A block is a fixed share of all chunks by
their hash, so a term that most chunks hold is many rows and no row is longer than a block.  Written
in ranges of terms, a search reads the parts of its own terms, and no text at all.

A search splits the terms of each query: scores of what its rarest terms find give the k-th best as a bound
that the result can't fall below.  The most common terms whose best possible scores together stay under the bound
find nothing new; they are looked up only for chunks that other terms found and that may still pass it.
Postings of the queries' terms meet by block, where chunks are measured whole, and only the best of each block
go on: no row is made for a query and a chunk before.  The rows are those of retrieval.sparse_topk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import search_terms
from ..sources.checkpoints import checkpointed
from .retrieval import BROADCAST_TERMS, FALLBACK_WEIGHT, STREAMED_TERMS, query_terms, ranked

#: Chunks of a block, about.
BLOCK_CHUNKS = 4096
#: Postings that the rarest terms of a query may have to find its bound.
SEEDS = 4096
#: Chunks whose words are counted at a time, and postings that are handed on at a time.
COUNTED, POSTINGS = 256, 50_000
#: A score that is rounded to nine digits is less than this away.
ROUNDED = 1e-8


@dataclass(frozen=True)
class InvertedIndex:
    postings: DataFrame
    blocks: int

    def block_of(self, chunk_id: str | Column) -> Column:
        return F.pmod(F.xxhash64(chunk_id), F.lit(self.blocks)).cast("int")

    def write(self, path: str) -> InvertedIndex:
        """Writes the index in ranges of terms, and gives it as read from there."""
        spark = self.postings.sparkSession
        rows = self.postings.repartitionByRange("knowledge_base_id", "term", "block").sortWithinPartitions("knowledge_base_id", "term", "block")
        rows.withColumn("blocks", F.lit(self.blocks)).write.mode("overwrite").parquet(path)
        return InvertedIndex.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> InvertedIndex:
        rows = spark.read.parquet(path)
        first = rows.select("blocks").first()
        return InvertedIndex(rows.drop("blocks"), 1 if first is None else first.blocks)


def build_index(chunks: DataFrame, block_chunks: int = BLOCK_CHUNKS) -> InvertedIndex:
    """The index of chunks (chunk_id, knowledge_base_id, content). Texts are dealt by block and make whole postings there, so no word is shuffled by itself."""
    blocks = max(1, -(-chunks.count() // block_chunks))
    index, kinds = InvertedIndex(chunks, blocks), dict(chunks.dtypes)
    dealt = chunks.filter("content is not null").select("chunk_id", "knowledge_base_id", "content", index.block_of("chunk_id").alias("block")).repartition("block").sortWithinPartitions("block")
    words = dealt.select("chunk_id", "knowledge_base_id", "block", search_terms(F.col("content")).alias("terms"))
    hits = f"array<struct<chunk_id: {kinds['chunk_id']}, tf: int>>"
    rows = words.mapInArrow(_postings, f"knowledge_base_id {kinds['knowledge_base_id']}, term string, block int, n int, top int, hits {hits}")
    return InvertedIndex(rows, blocks)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of chunks that come in the order of their blocks."""
    block, parts = None, []
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(batch)] if len(batch) else []
        for a, b in pairwise(cuts):
            if parts and blocks[a] != block:
                yield from _block_rows(parts, block)
                parts = []
            block = int(blocks[a])
            parts += (_counted(batch.slice(i, min(COUNTED, b - i))) for i in range(a, b, COUNTED))
    if parts:
        yield from _block_rows(parts, block)


def _counted(batch: pa.RecordBatch) -> tuple:
    """(chunk ids, their knowledge bases, places of chunks, terms, counts), one of the last three for each term of a chunk."""
    lists = batch.column("terms")
    terms = lists.flatten().dictionary_encode()
    many = max(1, len(terms.dictionary))
    chunk = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
    cell, tf = np.unique(chunk * many + terms.indices.to_numpy(), return_counts=True)
    found = pa.DictionaryArray.from_arrays(pa.array(cell % many, pa.int32()), terms.dictionary)
    return batch.column("chunk_id"), batch.column("knowledge_base_id"), (cell // many).astype(np.int32), found, tf.astype(np.int32)


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Places of values among the distinct ones, and these in order; null is a value."""
    encoded = values.dictionary_encode("encode")
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[encoded.indices.to_numpy()], encoded.dictionary.take(order)


def _block_rows(parts: list[tuple], block: int) -> Iterator[pa.RecordBatch]:
    ids, id_names = _codes(pa.concat_arrays([p[0] for p in parts]))
    kbs, kb_names = _codes(pa.concat_arrays([p[1] for p in parts]))
    before = np.cumsum([0, *(len(p[0]) for p in parts)])
    chunk = np.concatenate([p[2] + n for p, n in zip(parts, before, strict=False)])
    terms = pa.chunked_array([p[3] for p in parts]).unify_dictionaries().combine_chunks()
    order = pc.sort_indices(terms.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    term_names = terms.dictionary.take(order)
    n_ids, n_terms = len(id_names), max(1, len(term_names))
    cell = (kbs[chunk] * n_terms + place[terms.indices.to_numpy()]) * n_ids + ids[chunk]
    if not len(cell):
        return
    order = np.argsort(cell)
    cell, tf = cell[order], np.concatenate([p[4] for p in parts])[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # rows that repeat a chunk's id are one chunk
    cell, tf = cell[first], np.add.reduceat(tf, first)
    key = cell // n_ids
    first = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(first, len(key))
    key = key[first]
    hits = pa.StructArray.from_arrays([id_names.take(pa.array(cell % n_ids)), pa.array(tf, pa.int32())], ["chunk_id", "tf"])
    rows = pa.RecordBatch.from_arrays(
        [
            kb_names.take(pa.array(key // n_terms)),
            term_names.take(pa.array(key % n_terms)),
            pa.array(np.full(len(key), block), pa.int32()),
            pa.array(np.diff(ends), pa.int32()),
            pa.array(np.maximum.reduceat(tf, first), pa.int32()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits),
        ],
        ["knowledge_base_id", "term", "block", "n", "top", "hits"],
    )
    for a in range(0, len(rows), POSTINGS):
        yield rows.slice(a, POSTINGS)


def _measures(met: DataFrame) -> DataFrame:
    """(query_id, chunk_id, hits, s) of postings that met their queries.

    A block's postings come together, so its chunks are measured whole in one task. Those stay that reach
    the query's bound and the k best of their block; equal ones all stay.
    """
    query = met.schema["askers"].dataType.elementType["query_id"].dataType.simpleString()
    chunk = met.schema["chunk_ids"].dataType.elementType.simpleString()
    return met.groupBy("knowledge_base_id", "block", "slice").applyInArrow(_measured_block, f"query_id {query}, chunk_id {chunk}, hits long, s double")


def _measured_block(met: pa.Table) -> pa.Table:
    lists, tfs, askers = (met.column(c).combine_chunks() for c in ("chunk_ids", "tfs", "askers"))
    ids, id_names = _codes(lists.flatten())
    tf = tfs.flatten().to_numpy()
    ends = np.cumsum(np.append(0, lists.value_lengths().to_numpy()))
    row = np.repeat(np.arange(len(met)), askers.value_lengths().to_numpy())
    asks = askers.flatten()
    queries, query_names = _codes(asks.field("query_id"))
    number = lambda c, unset: pc.fill_null(asks.field(c), unset).to_numpy(zero_copy_only=False)
    primary, idle = number("is_primary", False), number("idle", False)
    bounds = [number(c, unset) for c, unset in (("least_hits", 0), ("least_score", -1.0), ("rest_hits", 0), ("rest_s", 0.0))]
    order = np.argsort(queries, kind="stable")
    k, m, out = met.column("k")[0].as_py(), len(id_names), []

    def measures(own):
        """hits and s of all chunks of the block by some of a query's terms."""
        at = np.concatenate([ids[ends[r] : ends[r + 1]] for r in row[own]])
        first = np.repeat(primary[own], np.diff(ends)[row[own]])
        own_tf = np.concatenate([tf[ends[r] : ends[r + 1]] for r in row[own]])
        strong, weak = np.bincount(at, own_tf * first, m), np.bincount(at, own_tf * ~first, m)
        return np.bincount(at, first, m), strong + weak * FALLBACK_WEIGHT

    for own in np.split(order, np.flatnonzero(np.diff(queries[order])) + 1):
        least_hits, least_score, rest_hits, rest_s = (b[own[0]] for b in bounds)
        reaches = lambda h, s: (h > least_hits) | ((h == least_hits) & (s / (s + 1) >= least_score - ROUNDED))  # noqa: B023, E731
        new, rest = own[~idle[own]], own[idle[own]]
        if not len(new):
            continue
        hits, s = measures(new)
        may = (s > 0) & reaches(hits + rest_hits, s + rest_s)
        if len(rest) and may.any():
            more_hits, more_s = measures(rest)
            hits, s = hits + more_hits, s + more_s
        at = np.flatnonzero(may & reaches(hits, s))
        if len(at) > k:
            last = at[np.lexsort((-s[at], -hits[at]))[k - 1]]
            at = at[(hits[at] > hits[last]) | ((hits[at] == hits[last]) & (s[at] / (s[at] + 1) >= s[last] / (s[last] + 1) - ROUNDED))]
        out.append((np.full(len(at), queries[own[0]]), at, hits[at], s[at]))
    q, c, h, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int),) * 4
    return pa.table({"query_id": query_names.take(pa.array(q)), "chunk_id": id_names.take(pa.array(c)), "hits": pa.array(h, pa.int64()), "s": pa.array(s, pa.float64())})


def _score(s: Column) -> Column:
    return F.round(s / (s + 1), 9)


def topk(queries: DataFrame, index: InvertedIndex, k: int, seeds: int = SEEDS, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """queries (query_id, knowledge_base_id, question) -> (query_id, chunk_id, sparse_coverage, sparse_score, rank), as retrieval.sparse_topk of the index's chunks."""
    asked = checkpointed(query_terms(queries))
    total = asked.groupBy("query_id").agg(F.count_if("is_primary").alias("n_primary"))
    n_asked = asked.count()
    hint = F.broadcast if n_asked <= broadcast_terms else (lambda df: df)
    keys = ["knowledge_base_id", "term"]
    own = index.postings.join(hint(asked.select(keys).distinct()), keys, "left_semi")
    sizes = own.groupBy(*keys).agg(F.sum("n").alias("df"), F.max("top").alias("top"))  # the lists themselves aren't read here
    # a query has a few dozen terms: its windows are small
    rare = Window.partitionBy("query_id").orderBy("df", "term", "is_primary")
    common = Window.partitionBy("query_id").orderBy(F.desc("df"), F.desc("term"), F.desc("is_primary")).rowsBetween(Window.unboundedPreceding, 0)
    weight = F.when(F.col("is_primary"), 1.0).otherwise(FALLBACK_WEIGHT)
    terms = asked.join(sizes, keys).withColumns(
        {
            "before": F.sum("df").over(rare),
            "at": F.row_number().over(rare),
            "most_hits": F.sum(F.col("is_primary").cast("long")).over(common),
            "most_s": F.sum(F.col("top") * weight).over(common),
        }
    )
    terms = checkpointed(terms)

    keep = ["query_id", "is_primary", "idle", "least_hits", "least_score", "rest_hits", "rest_s"]
    slices = max(1, -(-n_asked // STREAMED_TERMS))

    def found(part: DataFrame) -> DataFrame:
        """The postings of some of the queries' terms beside those who ask for them."""
        by = part.groupBy(*keys, F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("slice")).agg(F.collect_list(F.struct(*keep)).alias("askers"))
        return index.postings.join(hint(by), keys).select("knowledge_base_id", "block", "slice", F.col("hits.chunk_id").alias("chunk_ids"), F.col("hits.tf").alias("tfs"), "askers", F.lit(k).alias("k"))

    unbound = {"idle": F.lit(False), "least_hits": F.lit(0).cast("long"), "least_score": F.lit(-1.0), "rest_hits": F.lit(0).cast("long"), "rest_s": F.lit(0.0)}
    first = _measures(found(terms.filter((F.col("at") == 1) | (F.col("before") <= seeds)).withColumns(unbound)))
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), F.desc(_score(F.col("s"))))
    bound = first.withColumn("place", F.row_number().over(order)).filter(F.col("place") == k).select("query_id", F.col("hits").alias("least_hits"), _score(F.col("s")).alias("least_score"))
    under = lambda hits, s: (hits < F.col("least_hits")) | ((hits == F.col("least_hits")) & (_score(s) < F.col("least_score")))
    split = terms.join(bound, "query_id", "left").withColumn("idle", F.coalesce(under(F.col("most_hits"), F.col("most_s")), F.lit(False)))
    # what the idle terms could add at most decides whether a chunk may still pass the bound
    whole = Window.partitionBy("query_id")
    split = checkpointed(split.withColumns({"rest_hits": F.max(F.when(F.col("idle"), F.col("most_hits"))).over(whole), "rest_s": F.max(F.when(F.col("idle"), F.col("most_s"))).over(whole)}))
    scored = _measures(found(split)).join(hint(total), "query_id")
    coverage = F.when(F.col("n_primary") > 0, F.col("hits") / F.col("n_primary")).otherwise(0.0)
    scored = scored.select("query_id", "chunk_id", F.round(coverage, 9).alias("sparse_coverage"), _score(F.col("s")).alias("sparse_score"))
    return ranked(scored, "sparse").filter(F.col("rank") <= k)
