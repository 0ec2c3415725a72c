"""Removal of repeated word windows, found by difference-cover anchors.

A difference cover D of the numbers modulo v holds, for every d, two members
that differ by d.  So whatever two places a repeated window starts at, one of
its first v places is a cover position in both texts, and the k = window - v + 1
words from there (an anchor) agree.  Only anchors at cover positions are hashed
and counted, a small share of all windows.  Anchors met twice are then extended
to the full windows around them, and of each window all occurrences but the
first (by document id, then place) are repeats.

Hot anchors and windows are met by delegates of tasks (see meetings.py).
A very long text is held whole by a task, some 60 bytes for each of its own.

Defined cases: null and empty texts have no words; a null doc_id comes before
all others; rows that repeat a doc_id are one document, in which a place
counts once; the hash of no words is that of the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .meetings import SCHEMA, Earliest, Meetings, live_hashes, salts, shared_anchors
from .storage import keyed, restrict, unkeyed, with_marks, written
from .textbytes import NON_SPACE, Words, covered, slices, words_of

#: A task remembers what repeats over its slices, so their size decides about memory alone: some 60 bytes for each of theirs.
SLICE = 2 << 20
#: Smallest known difference covers (perfect difference sets) by their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period v, cover, anchor words k) for windows of so many words: v + k - 1 = window."""
    v = max(v for v in COVERS if v == 1 or window - v + 1 > v // 2)
    return v, COVERS[v], window - v + 1


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors at cover positions of texts that hold a window."""
    v, cover, k = cover_for(window)
    at, hashes = words.grams(k)
    text = words.text_of()[at] if len(at) else at
    keep = np.isin((at - words.first[text]) % v, cover) & (words.counts[text] >= window) if len(at) else np.empty(0, bool)
    return at[keep], hashes[keep]


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meetings = Meetings()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = words_of(part.column("text"), NON_SPACE)
                at, hashes = _anchors(words, window)
                if not len(at):
                    continue
                yield meetings.rows(hashes, part.column("key").to_numpy(zero_copy_only=False)[words.text_of()[at]])

    return run


def _window_rows(window: int):
    v, _, _ = cover_for(window)
    names = ["window", "salt", "key", "place", "repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Earliest()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = words_of(part.column("text"), NON_SPACE)
                at, hashes = _anchors(words, window)
                at = at[np.isin(hashes, live_hashes(part))]
                starts = np.zeros(len(words.hashes) + 1, bool)
                for d in range(v):
                    starts[np.maximum(at - d, 0)] = True
                starts = np.flatnonzero(starts[:-1])
                text = words.text_of()[starts] if len(starts) else starts
                fits = starts + window <= words.first[text + 1]
                starts, text = starts[fits], text[fits]
                if not len(starts):
                    continue
                hashes = words.runs(starts, starts + window)
                keys = part.column("key").to_numpy(zero_copy_only=False)[text]
                places = starts - words.first[text]
                order = np.lexsort((places, keys, hashes))
                hashes, keys, places = hashes[order], keys[order], places[order]
                earliest = np.concatenate(([True], hashes[1:] != hashes[:-1]))
                group = np.cumsum(earliest) - 1
                first = np.flatnonzero(earliest)
                later = met.later(hashes[first], keys[first], places[first], np.bincount(group) > 1)[group]
                first = first[group]
                repeat = later | (keys != keys[first]) | (places != places[first])
                columns = hashes.view(np.int64), salts(repeat, earliest & ~later, keys), keys, places.astype(np.int32), repeat
                text_order = np.argsort(order)  # neighbours in a text compress well together
                yield pa.RecordBatch.from_arrays([pa.array(c[text_order]) for c in columns], names=names)

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(key, places): for each document with repeats, where windows start that also start earlier. Written to the shared folder."""
    if window < 1:
        raise ValueError("a window has at least one word")
    texts = keyed(docs, id_col, text_col)
    live = shared_anchors(texts.mapInArrow(_anchor_rows(window), SCHEMA))
    hot = restrict(texts, live.select("key"), "key", live.count()).join(live, "key")
    rows = hot.mapInArrow(_window_rows(window), "window long, salt long, key long, place int, repeat boolean")
    first = F.min(F.struct("key", "place")).over(Window.partitionBy("window", "salt"))
    repeats = rows.withColumn("first", first).filter(F.col("repeat") | (F.struct("key", "place") != F.col("first")))
    return written(repeats.groupBy("key").agg(F.array_sort(F.collect_set("place")).alias("places")), "repeats")


def _digest_rows(window: int, texts: bool):
    names = ["key", "n_words", "n_removed", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = words_of(part.column("text"), NON_SPACE)
                n, marks = words.counts, part.column("places")
                sizes = np.diff(marks.offsets.to_numpy()) if len(marks) else np.empty(0, int)
                sizes = np.where(marks.is_null().to_numpy(zero_copy_only=False), 0, sizes)
                text = np.repeat(np.arange(len(sizes)), sizes)
                places = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                fits = places + window <= n[text]  # rows that repeat a doc_id may be shorter
                gone = covered(words.first[text[fits]] + places[fits], window, len(words.hashes))
                data, removed, kept = words.data.tobytes(), [], []
                for i in range(part.num_rows):
                    a, b = words.first[i], words.first[i + 1]
                    own = slice(a, b) if not sizes[i] else a + np.flatnonzero(~gone[a:b])
                    kept.append(b" ".join([data[s:e] for s, e in zip(words.starts[own].tolist(), words.ends[own].tolist(), strict=True)]))
                    removed.append(int(gone[a:b].sum()))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept if texts else [None] * len(kept), pa.binary())], names=names)

    return run


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): the words left of each document, joined by one space (UTF-8); null without `texts`."""
    marks = repeated_windows(docs, id_col, text_col, window)
    rows = with_marks(keyed(docs, id_col, text_col), marks, "key", marks.count())
    out = rows.mapInArrow(_digest_rows(window, texts), "key long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.select(unkeyed().alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")
