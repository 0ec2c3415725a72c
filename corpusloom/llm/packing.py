"""Packing of tokenised documents into sequences of a fixed length by swap-based local search.

Documents become token ids in one pass; what flows on are rows of a few numbers
for each piece (only documents longer than a sequence are cut).  Pieces are dealt
into groups of a bounded size.  A group is packed by best fit, largest first, and
improved by local search: a bin is emptied by moving a document into another bin,
or exchanging one or two of its documents for a smaller one there, each step moving
tokens from the emptier to the fuller bin, which raises the sum of squared fills.
Bins that stay underfull are opened and dealt into new, fewer groups, until one group is left or a level saves no bin.

Defined cases: a very long text is taken whole, as one row of a task; null and empty texts are one piece with the end token alone; repeated
rows are packed row by row; a null doc_id stays null; all pieces of a document may be in different sequences.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written
from .textbytes import slices
from .tokens import REMEMBERED, pair_merges

#: Pieces of one group; packed in one task in bounded memory.
GROUP = 20_000
#: Bins filled to this share are final.
FULL = 0.999


@lru_cache(maxsize=2)
def _coded(path: str) -> dict[str, bytes]:
    return {}


def _ids(texts: list[str | None], path: str) -> list[bytes]:
    """The library's ids of each text as little-endian unsigned 32-bit numbers; repeated pre-tokens are merged once."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    model, known = pair_merges(path), _coded(path)
    special = {i for i, t in enumerate(texts) if t and any(s in t for s in model.specials)}
    split = [[] if i in special else model.split(t)[0] for i, t in enumerate(texts)]
    if len(known) > REMEMBERED:
        known.clear()
    new = list(set(chain.from_iterable(split)).difference(known))
    if new:
        ids, sizes = model.merged(new)
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        known.update((w, raw[a:b]) for w, a, b in zip(new, [0, *ends], ends, strict=False))
    out = [b"".join(map(known.__getitem__, p)) for p in split]
    for i in special:
        out[i] = np.array(model.library.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
    return out


def tokenised_pieces(docs: DataFrame, path: str, length: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), one row for each piece of each row of docs."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                owner, rows = [], []
                for i, ids in enumerate(_ids(part.column(text_col).to_pylist(), path)):
                    ids += end
                    for p, a in enumerate(range(0, len(ids), 4 * length)):
                        own = ids[a : a + 4 * length]
                        owner.append(i)
                        rows.append((p, a // 4, len(own) // 4, zlib.crc32(own)))
                p, a, n, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(owner)), pa.array(p, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """The bin of each piece: largest first, each into the fullest bin that has room."""
    bins = np.empty(len(sizes), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(length + 1)]
    gaps, made = 0, 0  # gaps: bit g is set if a bin has a gap of g
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room = gaps >> size
        if room:
            gap = size + (room & -room).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, b, made = length, made, made + 1
        bins[i] = b
        if gap > size:
            by_gap[gap - size].append(b)
            gaps |= 1 << (gap - size)
    return bins


def local_search(sizes: np.ndarray, bins: np.ndarray, length: int) -> np.ndarray:
    """Empties bins by moves and exchanges that raise the sum of squared fills.

    The emptiest bin gives away, step by step, the most tokens that one step can: a document into a gap, or one or two
    documents for a smaller one of a fuller bin.  A bin that can't be emptied keeps what raised the sum.
    """
    bins = bins.copy()
    fill = np.bincount(bins, sizes).astype(np.int64)
    target, tried = -(-int(sizes.sum()) // length), set()
    while int((fill > 0).sum()) > target:
        v = next((b for b in np.argsort(fill, kind="stable").tolist() if 0 < fill[b] < length and b not in tried), None)
        if v is None:
            break
        own = np.flatnonzero(bins == v).tolist()
        others = np.flatnonzero((fill[bins] < length) & (bins != v))  # documents of other underfull bins
        while own:  # each step takes tokens from the bin
            gap = length - fill
            # what the bin can give: one or two documents, by size
            gives = [(int(sizes[i]), (i,)) for i in own]
            few = sorted(own, key=lambda i: -sizes[i])[:48]
            gives += [(int(sizes[i] + sizes[j]), (i, j)) for x, i in enumerate(few) for j in few[x + 1 :]]
            gives.sort()
            amounts = np.array([g[0] for g in gives])
            taken, to, moved = -1, -1, 0
            room = np.where((fill > 0) & (fill >= fill[v]) & (np.arange(len(fill)) != v), gap, 0)
            b = int(np.argmax(room))
            fits = int(np.searchsorted(amounts, room[b], "right")) - 1
            if fits >= 0:
                given, to, moved = gives[fits][1], b, int(amounts[fits])
            if len(others):
                e, g = sizes[others], room[bins[others]]
                at = np.searchsorted(amounts, e + g, "right") - 1
                gain = np.where((at >= 0) & (g > 0), amounts[at] - e, 0)
                j = int(np.argmax(gain))
                if gain[j] > moved:
                    given, taken, to, moved = gives[at[j]][1], int(others[j]), int(bins[others[j]]), int(gain[j])
            if moved <= 0:
                break
            bins[list(given)] = to
            own = [i for i in own if i not in given]
            if taken >= 0:
                bins[taken] = v
                own.append(taken)
            others = np.concatenate((others[others != taken], given))
            others = others[bins[others] != v]
            fill[to] += moved
            fill[v] -= moved
        if own:
            tried.add(v)
    return bins


def _pack_group(length: int, final: bool):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["length"].to_numpy(np.int64)
        bins = local_search(sizes, best_fit(sizes, length), length)
        bins = np.unique(bins, return_inverse=True)[1]
        order = np.argsort(bins, kind="stable")
        before = np.concatenate(([0], np.cumsum(sizes[order])[:-1]))
        begins = np.concatenate(([True], np.diff(bins[order]) > 0))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - before[begins][np.cumsum(begins) - 1]
        full = np.bincount(bins, sizes) >= FULL * length
        return pdf.assign(bin=bins.astype(np.int64), offset=offset, final=full[bins] | final)

    return run


def pack(docs: DataFrame, path: str, length: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece's sequence and place in it."""
    # a number of its own for each row, so that equal rows are dealt apart; written, so it stays when a task runs again
    pieces = tokenised_pieces(docs, path, length, end_id, id_col, text_col)
    columns = pieces.columns
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    left, out, level, opened = pieces, None, 0, None
    while True:
        n = left.count()
        groups = max(1, -(-n // group))
        last = groups == 1 or level == 31  # sequence_id has room for so many
        dealt = left.withColumn("group", F.pmod(F.xxhash64(*columns, "_row", F.lit(level)), F.lit(groups)))
        schema = T.StructType([*dealt.schema.fields, T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("final", T.BooleanType())])
        packed = written(dealt.groupBy("group").applyInPandas(_pack_group(length, last), schema), "packed")
        number = F.lit(level).cast("long") * F.lit(2**58) + F.col("group") * F.lit(2**24) + F.col("bin")
        bins = packed.select("group", "bin", "final").distinct().groupBy("final").count().collect()
        if opened is not None and sum(r["count"] for r in bins) >= opened:
            last, packed = True, packed.withColumn("final", F.lit(True))
        opened = sum(r["count"] for r in bins if not r["final"])
        done = packed.filter("final").select(*columns, number.alias("sequence_id"), "offset")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        left, level = packed.filter("not final").select(*columns, "_row"), level + 1
