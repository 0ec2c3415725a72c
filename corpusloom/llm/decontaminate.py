"""Benchmark decontamination by winnowed fingerprints.

An item's windows are its runs of `length` words (an item with fewer words, but
some, is one window).  Winnowing keeps the smallest k-gram hash of every w
neighbouring k-grams, with w + k - 1 equal to the window's length, so every
shared window holds at least one fingerprint that both sides keep, at the same
place in the window.

1. Fingerprints of the documents are joined with the distinct ones of the benchmark.  Before
   that, a task drops those whose low bits no benchmark fingerprint has; the table of these
   bits has a fixed size at any size of the benchmark and can lose no hit.
2. Each hit is extended to the windows around it, in the texts with a hit alone,
   and these windows are joined with the benchmark's: a window counts when all its words agree.
3. Hit words and items are united per text and go back to the rows.

Both joins are between tables; a side is broadcast only when it is counted small.  The benchmark's
side is unique in its join keys, so a passage in many documents costs a row for each.
Texts are known by their MD5, so rows with the same text share their marks.

Defined cases: null or empty texts have no words and are clean; repeated items
count once per item_id; repeated document rows each get their marks; a null
item_id is not reported among the items but its words are hit; an empty
benchmark hits nothing; a column of docs that is named like the result gives way to it.
A very long text is held whole by a task, some 60 bytes for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import BROADCAST_ROWS, exclude, small, with_marks, written
from .textbytes import ALNUM, Words, covered, signed, slices, words_of

#: Low bits of fingerprints in the table that every task has: at most 4 million numbers.
BITS = 22


def winnow_sizes(length: int) -> tuple[int, int]:
    """(k, w): k-grams in windows of w of them; any run of `length` words keeps a fingerprint."""
    w = max(1, length // 2)
    return length - w + 1, w


def winnowed(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints of all texts of a slice, by position."""
    k, w = winnow_sizes(length)
    at, grams = words.grams(k)
    text = words.text_of()[at] if len(at) else at
    windows = np.arange(max(0, len(at) - w + 1))
    windows = windows[text[windows] == text[windows + w - 1]] if len(windows) else windows
    best = windows.copy()
    for i in range(1, w):  # the rightmost smallest, as in the published scheme
        best = np.where(grams[windows + i] <= grams[best], windows + i, best)
    best = np.unique(best)
    return at[best], grams[best]


def _item_rows(length: int, windows: bool):
    """(size, hash, item): the windows of the items, or their fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts = words_of(part.column("text"), ALNUM, lower=True).counts
                for size in np.unique(np.minimum(counts[counts > 0], length)).tolist():
                    some = part.filter(pa.array(np.minimum(counts, length) == size))
                    words = words_of(some.column("text"), ALNUM, lower=True)
                    at, hashes = words.grams(size) if windows else winnowed(words, size)
                    item = some.column("item").take(pa.array(words.text_of()[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), signed(hashes), item], names=["size", "hash", "item"])

    return run


def _fingerprint_rows(sizes: list[int], low):
    """(digest, size, hash, place) of the documents' fingerprints that may be some of the benchmark's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(1 << BITS, bool)
        there[low.value] = True
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), ALNUM, lower=True)
                for size in sizes:
                    at, hashes = winnowed(words, size)
                    keep = there[(hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)]
                    at, hashes = at[keep], hashes[keep]
                    if len(at):
                        text = words.text_of()[at]
                        yield pa.RecordBatch.from_arrays([part.column("digest").take(pa.array(text)), pa.array(np.full(len(at), size, np.int32)), signed(hashes), pa.array((at - words.first[text]).astype(np.int32))], names=["digest", "size", "hash", "place"])

    return run


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, size, hash, start): the windows around the hits (size, place) of each text."""
    for batch in batches:
        for part in slices(batch, "text"):
            words, hits = words_of(part.column("text"), ALNUM, lower=True), part.column("hits")
            text = np.repeat(np.arange(part.num_rows), np.diff(hits.offsets.to_numpy()))
            flat = hits.flatten()
            sizes, places = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("size", "place"))
            for size in np.unique(sizes).tolist():
                k, _ = winnow_sizes(size)
                own = sizes == size
                at, owner = words.first[text[own]] + places[own], np.repeat(text[own], size - k + 1)
                starts = (at[:, None] - np.arange(size - k + 1)).ravel()  # windows that hold the fingerprint
                fits = (starts >= words.first[owner]) & (starts + size <= words.first[owner + 1])
                starts, first = np.unique(starts[fits], return_index=True)
                owner = owner[fits][first]
                yield pa.RecordBatch.from_arrays([part.column("digest").take(pa.array(owner)), pa.array(np.full(len(starts), size, np.int32)), signed(words.runs(starts, starts + size)), pa.array((starts - words.first[owner]).astype(np.int32))], names=["digest", "size", "hash", "start"])


def shared_windows(texts: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", length: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """texts (digest, text) -> (digest, starts array<struct<start, size>>, items): windows that benchmark items hold too, and the sorted ids of these. Written to the shared folder."""
    spark = texts.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    windows = written(items.mapInArrow(_item_rows(length, True), "size int, hash long, item string").distinct(), "windows")
    prints = written(items.mapInArrow(_item_rows(length, False), "size int, hash long, item string").select("size", "hash").distinct(), "prints")
    sizes = sorted(r.size_ for r in prints.select(F.col("size").alias("size_")).distinct().collect())  # at most `length`
    low = prints.select(F.col("hash").bitwiseAND((1 << BITS) - 1).alias("low")).distinct().toPandas()["low"].to_numpy(np.int64)  # at most 2^BITS
    known = spark.sparkContext.broadcast(low)

    def side(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= broadcast_rows else df

    found = texts.mapInArrow(_fingerprint_rows(sizes, known), "digest string, size int, hash long, place int").join(side(prints, prints.count()), ["size", "hash"])
    hits = written(found.groupBy("digest").agg(F.collect_set(F.struct("size", "place")).alias("hits")), "hits")
    n_hits = hits.count()
    # texts with a hit, each once
    some = texts.join(small(hits.select("digest"), n_hits), "digest", "left_semi").dropDuplicates(["digest"]).join(hits, "digest")
    around = written(some.mapInArrow(_window_rows, "digest string, size int, hash long, start int"), "around")
    distinct = windows.select("size", "hash").distinct()
    n_windows = windows.count()
    real = written(around.join(side(distinct, n_windows), ["size", "hash"]), "real")
    starts = real.groupBy("digest").agg(F.collect_set(F.struct("start", "size")).alias("starts"))
    named = real.select("digest", "size", "hash").distinct().join(side(windows.filter("item is not null"), n_windows), ["size", "hash"])
    ids = named.groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return written(starts.join(ids, "digest", "left"), "shared")


_KIND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit_from", T.ArrayType(T.IntegerType())), T.StructField("hit_to", T.ArrayType(T.IntegerType()))])


def _mark_rows(text_col: str, carry: list[str], out: str):
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hit_from", pa.list_(pa.int32())), ("hit_to", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                counts = words_of(part.column(text_col), ALNUM, lower=True).counts
                starts, rows = part.column("_starts"), []
                items = part.column("_items").to_pylist()
                for i, n in enumerate(counts.tolist()):
                    if not starts[i].is_valid:
                        rows.append((n, 0, [], [], []))
                        continue
                    own = starts[i].values
                    start, size = (own.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "size"))
                    marks = covered(start, size, n)
                    edge = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
                    rows.append((n, int(marks.sum()), items[i] or [], np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()))
                fields = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kind, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.StructArray.from_arrays(fields, fields=list(kind))], names=[*carry, out])

    return run


def _digest(text_col: str):
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 10, carry: list[str] | None = None, out: str = "contamination", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs (its columns `carry`, all by default) with a struct column `out`: n_words, n_hit, items (sorted ids) and the hit word spans [hit_from, hit_to)."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != out]
    texts = docs.select(_digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    marks = shared_windows(texts, benchmark, item_col, item_text_col, length, broadcast_rows).select(F.col("digest").alias("_digest"), F.col("starts").alias("_starts"), F.col("items").alias("_items"))
    names = {c: f"_own_{i}" for i, c in enumerate(carry)}
    named = docs.select(*(F.col(c).alias(n) for c, n in names.items()), _digest(text_col).alias("_digest"), F.col(text_col).cast("string").alias("_text"))
    marked = with_marks(named, marks, "_digest", marks.count())
    schema = T.StructType([*(T.StructField(n, docs.schema[c].dataType) for c, n in names.items()), T.StructField("_out", _KIND)])
    rows = marked.mapInArrow(_mark_rows("_text", list(names.values()), "_out"), schema)
    return rows.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("_out").alias(out))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = mark_contamination(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), carry=["doc_id"])
    c = F.col("contamination")
    return hits.select(
        "doc_id",
        c.n_words.alias("n_words"),
        c.n_hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        (c.n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no window with the benchmark; columns as given."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    texts = docs.select(_digest("text").alias("digest"), F.col("text").cast("string").alias("text"))
    gone = shared_windows(texts, benchmark).select(F.col("digest").alias("_digest"))
    named = docs.withColumnsRenamed(names).withColumn("_digest", _digest(names["text"]))
    kept = exclude(named, gone, "_digest", gone.count())
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))
