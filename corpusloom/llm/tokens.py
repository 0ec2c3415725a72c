"""Token counts by rank-synchronous merging.

The pre-tokens of a slice of documents that aren't known yet are held as one
ragged numpy array of symbols.  Each round looks up the merge rank of every
neighbouring pair, finds each sequence's lowest, and applies that pair at
all its places in all sequences at once; sequences without a pair are done.
The symbols that survive are the tokens.  Pre-tokens repeat a lot, so a worker
remembers a bounded number of them.

Texts of common Latin characters are split by a pattern over explicit
ranges; any other text goes through the tokenizer file's own normalizer and
pre-tokenizer, so both give the library's pre-tokens.

Defined cases: a very long text is taken whole, as one row of a task; a null or empty text has 0 tokens; the strings of special tokens
inside a text are found as the library finds them, and count one each; repeated
rows are counted row by row; other columns pass through.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import slices

#: Pre-tokens that a worker remembers; when full it starts anew.
REMEMBERED = 200_000
NO_RANK = np.int64(2**62)

# Fixed values of the file word_bpe_49k.json: its normalizers and its split pattern.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose classes are the same everywhere: ASCII, Latin-1, Latin Extended-A, general punctuation without spaces.
_COMMON = re.compile(r"[\x00-\x1b\x20-\x84\x86-ſ‐-‧‰-⁞€]*\Z")
_SPACE = r"\t-\r \x85\xa0"
_LETTER = r"a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ẛ"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_FAST = re.compile(f"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def _byte_characters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable ones stand for themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class PairMerges:
    """A byte-level BPE file: pre-tokens of texts, and batched merging of pre-tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        stand_in = _byte_characters()
        self.byte_of = {c: b for b, c in stand_in.items()}
        self.inner = np.array([vocab[stand_in[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[stand_in[b] + self.end] for b in range(256)], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = np.int64(len(vocab))
        keys = np.array([vocab[a] * len(vocab) + vocab[b] for a, b in merges], np.int64)
        self._fill_table(keys)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.fast = kinds == _NORMALIZERS and split.get("pattern", {}).get("Regex") == _PATTERN

    def pieces(self, text: str) -> list[str]:
        """The library's pre-tokens of a text without special strings, as plain strings."""
        if self.fast and _COMMON.match(text) and "İ" not in text:
            return _FAST.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        found = self.library.pre_tokenizer.pre_tokenize_str(normal) if self.library.pre_tokenizer else [(normal, None)]
        return [bytes(self.byte_of[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in found]

    def split(self, text: str | None) -> tuple[list[str], int]:
        """(pre-tokens, special strings met)."""
        if not text:
            return [], 0
        if self._special is None or not self._special.search(text):
            return self.pieces(text), 0
        parts = self._special.split(text)
        return list(chain.from_iterable(self.pieces(p) for p in parts[::2] if p)), len(parts) // 2

    def ranks_of(self, keys: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, or NO_RANK, from a hash table with linear probing."""
        out = np.full(len(keys), NO_RANK)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            there = self._table[slot]
            hit = there == keys[left]
            out[left[hit]] = self._table_ranks[slot[hit]]
            go_on = ~hit & (there >= 0)
            left, slot = left[go_on], (slot[go_on] + 1) & (len(self._table) - 1)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 19)).astype(np.int64)

    def _fill_table(self, keys: np.ndarray) -> None:
        self._table, self._table_ranks = np.full(1 << 19, -1, np.int64), np.zeros(1 << 19, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self._table[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self._table[slot[put]], self._table_ranks[slot[put]] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & (len(self._table) - 1)

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens one after another, the number of tokens of each)."""
        coded = [p.encode("utf-8", "surrogateescape") for p in pieces]
        sizes = np.array([len(c) for c in coded], np.int64)
        data = np.frombuffer(b"".join(coded), np.uint8)
        symbols, owner = self.inner[data], np.repeat(np.arange(len(pieces)), sizes)
        last = np.cumsum(sizes)[sizes > 0] - 1
        symbols[last] = self.last[data[last]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK)
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            rank[inside] = self.ranks_of(symbols[inside] * self.size + symbols[inside + 1])
            begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(owner))))
            over = lowest == NO_RANK
            done.append((owner[over], symbols[over]))
            hit = (rank == lowest) & ~over
            # of overlapping places of one pair every other one, from the left
            at = np.arange(len(hit))
            hit &= (at - np.maximum.accumulate(np.where(hit, 0, at + 1))) % 2 == 0
            where = np.flatnonzero(hit)
            symbols[where] = self.made[rank[where]]
            keep = ~over
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, np.int64),) * 2
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(pieces))


@lru_cache(maxsize=2)
def pair_merges(path: str) -> PairMerges:
    return PairMerges(path)


@lru_cache(maxsize=2)
def _remembered(path: str) -> dict[str, int]:
    return {}


def token_counts(texts: list[str | None], path: str) -> list[int]:
    model, known = pair_merges(path), _remembered(path)
    split = [model.split(t) for t in texts]
    if len(known) > REMEMBERED:
        known.clear()
    new = list(set(chain.from_iterable(p for p, _ in split)).difference(known))
    if new:
        known.update(zip(new, model.merged(new)[1].tolist(), strict=True))
    return [sum(map(known.__getitem__, p)) + special for p, special in split]


def with_token_counts(docs: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens", carry: list[str] | None = None) -> DataFrame:
    """docs (its columns `carry`, all by default) with the number of tokens of each text under the file at `path`, which every executor has."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != out]
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                counts = token_counts(part.column(text_col).to_pylist(), path)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(counts, pa.int64())], names=[*carry, out])

    return docs.mapInArrow(run, schema)


def token_report(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = with_token_counts(sized, path, carry=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
