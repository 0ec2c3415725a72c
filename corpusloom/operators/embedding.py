"""Deterministic offline embeddings, vector checks and cosine similarity."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .providers import with_retry

_WORD = re.compile(r"[^\W_]+")
#: Feature buckets that a worker remembers.
REMEMBERED = 500_000
#: Characters whose pairs a worker keeps in an array.
CHARACTERS = 1024


def feature_counts(text: str) -> tuple[list, np.ndarray]:
    """The distinct features of a text and how often each occurs: words as text, a character as its code, a bigram as both codes in one number."""
    text = text.strip().lower()
    if not text:
        return ["empty"], np.ones(1, np.int64)
    words = Counter(_WORD.findall(text))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    one, n = np.unique(codes, return_counts=True)
    two, m = np.unique((codes[:-1] + 1) << 32 | codes[1:], return_counts=True)
    return [*words, *one.tolist(), *two.tolist()], np.concatenate((np.fromiter(words.values(), np.int64, len(words)), n, m))


def _bucket(feature: str | int) -> int:
    """The first 16 bits of the feature's SHA-256."""
    if isinstance(feature, int):
        feature = chr(feature) if feature < 1 << 32 else chr((feature >> 32) - 1) + chr(feature & 0xFFFFFFFF)
    return int.from_bytes(hashlib.sha256(feature.encode("utf-8", "surrogatepass")).digest()[:2], "big")


class Grid:
    """The buckets of characters and of their pairs as arrays, for the first CHARACTERS different characters below 65,536 that a worker meets."""

    def __init__(self):
        self.place = np.full(1 << 16, -1, np.int32)
        self.codes = np.empty(0, np.int64)
        self.one = np.empty(0, np.int64)
        self.two = np.full(CHARACTERS * CHARACTERS, -1, np.int32)

    def buckets(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Of each character and of each pair of neighbours; None where the text has characters outside the grid."""
        if not len(codes) or codes.max() >= len(self.place):
            return None
        at = self.place[codes]
        if at.min() < 0:
            new = np.unique(codes[at < 0])
            if len(self.codes) + len(new) > CHARACTERS:
                return None
            self.place[new] = len(self.codes) + np.arange(len(new), dtype=np.int32)
            self.codes = np.concatenate((self.codes, new))
            self.one = np.concatenate((self.one, np.array([_bucket(c) for c in new.tolist()], np.int64)))
            at = self.place[codes]
        pairs = at[:-1] * CHARACTERS + at[1:]
        two = self.two[pairs]
        if (two < 0).any():
            for p in np.unique(pairs[two < 0]).tolist():
                a, b = self.codes[p // CHARACTERS], self.codes[p % CHARACTERS]
                self.two[p] = _bucket(int((a + 1) << 32 | b))
            two = self.two[pairs]
        return self.one[at], two


def hashed_vector(text: str, dimension: int, known: dict[str | int, int], grid: Grid | None = None) -> np.ndarray:
    """Counts of features (words, characters and character bigrams) by their hash, scaled to length 1; with a grid the same sooner."""
    if grid is not None:
        low = text.strip().lower()
        found = grid.buckets(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
        if found is not None:
            if len(known) > REMEMBERED:
                known.clear()
            words = _WORD.findall(low)
            for f in set(words).difference(known):
                known[f] = _bucket(f)
            v = np.bincount(np.concatenate((np.fromiter(map(known.__getitem__, words), np.int64, len(words)), *found)) % dimension, minlength=dimension).astype(np.float64)
            return (v / np.linalg.norm(v)).astype(np.float32)
    if len(known) > REMEMBERED:
        known.clear()
    names, counts = feature_counts(text)
    for f in set(names).difference(known):
        known[f] = _bucket(f)
    v = np.bincount(np.fromiter(map(known.__getitem__, names), np.int64, len(names)) % dimension, counts, dimension)
    return (v / np.linalg.norm(v)).astype(np.float32)


def embed_text(c: Column, dimension: int = 1024) -> Column:
    """array<float> of length 1 for each text; null counts as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, grid = {}, Grid()
        for texts in batches:
            yield pd.Series([hashed_vector(t or "", dimension, known, grid) for t in texts])

    return run(c)


def embed_with(c: Column, embedder: Callable[[list[str]], list[list[float]]], batch_size: int = 32) -> Column:
    """array<float> from a user's embedder, called with retries for batches of texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = with_retry(embedder)
        for texts in batches:
            texts = ["" if t is None else t for t in texts]
            yield pd.Series([np.asarray(v, np.float32) for a in range(0, len(texts), batch_size) for v in call(texts[a : a + batch_size])])

    return run(c)


def with_embeddings(df: DataFrame, text_col: str, dimension: int = 1024, embedder=None, batch_size: int = 32) -> DataFrame:
    vector = embed_text(F.col(text_col), dimension) if embedder is None else embed_with(F.col(text_col), embedder, batch_size)
    return df.withColumn("embedding", vector)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if a length is 0 or the sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def validate_vectors(df: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """+ error_code: EMBEDDING_INVALID_RESPONSE for a missing vector, a wrong dimension or a value that isn't finite."""
    v = F.col(column)
    bad = v.isNull() | (F.size(v) != dimension) | F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    return df.withColumn("error_code", F.when(bad, "EMBEDDING_INVALID_RESPONSE"))


def embedding_progress(chunks: DataFrame, batch_size: int = 32) -> DataFrame:
    """+ batch, progress: the batch of each chunk of a document, and the job's progress (55..90) when that batch is done."""
    n = F.count("*").over(Window.partitionBy("document_id"))
    end = F.least((F.floor(F.col("chunk_index") / batch_size) + 1) * batch_size, n)
    return chunks.withColumn("batch", F.floor(F.col("chunk_index") / batch_size).cast("int")).withColumn("progress", (55 + F.floor(end * 35 / n)).cast("int"))
