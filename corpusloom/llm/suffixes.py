"""Removal of repeated byte strings by a sparse, range-partitioned suffix array.

A byte goes if it lies in a string of `length` bytes that starts at two or more
places of the corpus.  Suffixes are kept only at sampled places: of every
`spread` neighbouring places the one whose 8-byte gram has the least hash.  The
choice depends on the bytes of the window alone, so equal windows choose the
place at the same distance from their start, and sorting the sampled
suffixes with some bytes to their left finds every repeat.

1. Suffixes whose leading length - spread bytes occur once are dropped (by hash).
2. The others become contexts: the suffix up to the last byte that its windows
   need, and the bytes to the left. Equal contexts are one row with a count.
3. Sampled splitters range-partition the contexts by the leading bytes of their
   suffixes (ties by digest, so a hot lead takes several buckets).  A bucket is
   sorted by multikey quicksort, vectorised over 8-byte keys, and neighbours are
   compared.  The window l bytes left of a suffix repeats if within a run of
   common prefixes of at least length - l bytes another context (or copy) has
   the same l bytes to its left.
4. Runs that touch a bucket's first or last lead may go on in the next bucket.
   They are compared across boundaries by shuffles on hashes: first for steps of 32
   distances, and window by window only where that leaves it open.
5. Repeated windows return to the places of their contexts and are united per document.

A very long text is held whole by a task, some 60 bytes for each of its own.

Defined cases: null and empty texts have no bytes; texts shorter than `length`
lose nothing; repeated rows and rows that repeat a doc_id are separate
occurrences, and rows of one doc_id lose what any of them loses at that place; a
null doc_id is allowed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .meetings import SCHEMA, Meetings, live_hashes, shared_anchors
from .storage import BROADCAST_ROWS, keyed, restrict, unkeyed, with_marks, written
from .textbytes import BYTE_CODES, RunHashes, bytes_of, mix, run_hashes, slices

SLICE, LEAD, GRAM = 1 << 20, 48, 8
#: Bytes of contexts in a bucket of the suffix array.
BUCKET_BYTES = 4 << 20
#: Distances that one hash at a bucket's edge stands for; places of a context that meet it by broadcast.
STEP, OFTEN = 32, 1000


def spread_for(length: int) -> int:
    """Neighbouring places of which one is sampled; leaves room for the gram and a telling lead."""
    if length < 2 * GRAM:
        raise ValueError(f"strings have at least {2 * GRAM} bytes")
    return max(1, min(length * 5 // 8, length - GRAM))


def lead_for(length: int) -> int:
    """Leading bytes that buckets are cut by; all contexts that can share a window share them."""
    return min(LEAD, length - spread_for(length))


def sampled(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, least distance, greatest distance, text): a sampled place and how far left of it its windows start."""
    w, n = spread_for(length), len(data)
    room = np.maximum(0, np.diff(offsets) - length + 1)  # window starts of each text
    if not room.sum():
        return (np.empty(0, np.int64),) * 4
    grams = np.ndarray((n - GRAM + 1,), "<u8", np.ascontiguousarray(data), strides=(1,))
    ranks = (mix(grams) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    blocks = np.full((-(-len(ranks) // w) + 1) * w, ~np.uint64(0))
    blocks[: len(ranks)] = ranks
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    text = np.repeat(np.arange(len(room)), room)
    starts = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + offsets[text]
    place = (np.minimum(back[starts], ahead[starts + w - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(new[1:], len(place)) - 1
    return place[new], place[new] - starts[last], place[new] - starts[new], text[new]


def _lead_hashes(data: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    return run_hashes(BYTE_CODES[data], place, place + length - spread_for(length)) if len(place) else np.empty(0, np.uint64)


def _lead_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meetings = Meetings()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = bytes_of(part.column("text"))
                place, _, _, text = sampled(data, offsets, length)
                if len(place):
                    yield meetings.rows(_lead_hashes(data, place, length), part.column("key").to_numpy(zero_copy_only=False)[text])

    return run


def _context_rows(length: int, contents: bool):
    """Contexts of the shared suffixes: with contents once for a slice and counted, or the places of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = bytes_of(part.column("text"))
                place, least, most, text = sampled(data, offsets, length)
                keep = np.isin(_lead_hashes(data, place, length), live_hashes(part))
                place, least, most, text = place[keep], least[keep], most[keep], text[keep]
                if not len(place):
                    continue
                raw, seen, ids = data.tobytes(), {}, []
                for a, p, b, lo, hi in zip((place - most).tolist(), place.tolist(), (place - least + length).tolist(), least.tolist(), most.tolist(), strict=True):
                    content = raw[a:b]
                    d = hashlib.blake2b(content, digest_size=16, salt=hi.to_bytes(4, "little") + lo.to_bytes(4, "little")).digest()
                    ids.append(d)
                    if contents:
                        seen[d] = (content, lo, hi, seen[d][3] + 1 if d in seen else 1)
                digests = np.frombuffer(b"".join(seen if contents else ids), "<i8").reshape(-1, 2)
                names, columns = ["c1", "c2"], [pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())]
                if contents:
                    content, lo, hi, m = zip(*seen.values(), strict=True)
                    names += ["content", "least", "most", "m"]
                    columns += [pa.array(content, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(m, pa.int64())]
                else:
                    names += ["key", "place"]
                    columns += [part.column("key").take(pa.array(text)), pa.array(place - offsets[text])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def multikey_sort(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of unsigned keys: partition by the first key, then equal parts by the next, and so on."""
    rank, active = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for column in range(keys.shape[1]):
        if not len(active):
            break
        key = keys[active, column]
        order = np.lexsort((key, rank[active]))
        active, key = active[order], key[order]
        old = rank[active]
        group = np.concatenate(([True], old[1:] != old[:-1]))
        part = group | np.concatenate(([True], key[1:] != key[:-1]))
        at = np.arange(len(active))
        within = at - at[group][np.cumsum(group) - 1]
        number = np.cumsum(part) - 1
        rank[active] = old + within[part][number]
        active = active[np.bincount(number)[number] > 1]
    return np.argsort(rank, kind="stable")


def _common(suffixes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes that each row of a sorted byte matrix shares with the row before; 0 for the first."""
    out = np.zeros(len(suffixes), np.int64)
    if len(suffixes) > 1:
        differ = suffixes[1:] != suffixes[:-1]
        first = np.where(differ.any(1), differ.argmax(1), suffixes.shape[1])
        out[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def _bucket(pieces: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """Sorts a bucket; rows of repeated distances (lo..hi) per context, and the windows of runs that may go on elsewhere."""
    c1, c2, content, least, most, m = (np.concatenate(x) if isinstance(x[0], np.ndarray) else [z for y in x for z in y] for x in zip(*pieces, strict=True))
    n, shared = len(content), length - spread_for(length)
    ends = np.cumsum([len(x) for x in content])
    data, begins = np.frombuffer(b"".join(content), np.uint8), np.concatenate(([0], ends[:-1]))
    place, sizes = begins + most, length - least
    width = -(-length // 8) * 8
    suffixes = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(width, np.uint8))), width)[place]
    suffixes[np.arange(width) >= sizes[:, None]] = 0
    order = multikey_sort(suffixes.view(">u8"))
    suffixes, place, sizes, least, most, m, c1, c2 = (x[order] for x in (suffixes, place, sizes, least, most, m, c1, c2))
    common = _common(suffixes, sizes)
    run = np.cumsum(common < shared)
    lead = suffixes[:, : lead_for(length)]
    edge = (lead == lead[0]).all(1) | (lead == lead[-1]).all(1)

    def batch(rows, lo, hi, core=None, span=None):
        none = np.zeros(len(rows), np.int64)
        columns = [c1[rows], c2[rows], lo.astype(np.int32), hi.astype(np.int32), m[rows], none if core is None else core, none if span is None else span, np.full(len(rows), core is not None)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["c1", "c2", "lo", "hi", "m", "core", "span", "open"])

    alone = ~edge & (np.bincount(run)[run] == 1)
    whole = np.flatnonzero(alone & (m > 1))
    yield batch(whole, least[whole], most[whole])
    some = np.flatnonzero(~edge & ~alone)
    if len(some):
        near, p, lo, hi, weight = common[some], place[some], least[some], most[some], m[some]
        left = np.zeros(len(some), np.uint64)
        repeated = np.zeros((int(hi.max()) + 2, len(some)), bool)
        for l in range(int(hi.max()) + 1):
            if l:
                left = left * np.uint64(0x9E3779B97F4A7C15) + BYTE_CODES[data[np.maximum(p - l, 0)]]
            fits = np.flatnonzero((lo <= l) & (l <= hi))
            key = mix(np.cumsum(near < length - l).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ mix(left))[fits]
            _, inverse = np.unique(key, return_inverse=True)
            repeated[l, fits] = np.bincount(inverse, weight[fits])[inverse] > 1
        step = np.diff(repeated.astype(np.int8), axis=0, prepend=0)
        rows, from_ = np.nonzero(step.T > 0)
        _, to = np.nonzero(step.T < 0)
        del repeated, step
        yield batch(some[rows], from_, to - 1)
    # distances in steps: the bytes that all windows of a step share, and those that any of them has
    rows, hashes, wide = np.flatnonzero(edge), RunHashes(BYTE_CODES[data]), min(STEP, spread_for(length))
    steps = most[rows] // wide - least[rows] // wide + 1
    step = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + np.repeat(least[rows] // wide, steps)
    rows, step = np.repeat(rows, steps), step * wide
    lo, hi, p = np.maximum(least[rows], step), np.minimum(most[rows], step + wide - 1), place[rows]
    core = hashes(p - step, p + length - step - wide + 1)
    span = mix(hashes(p - hi, p + length - lo) ^ mix(((hi - lo) * 2**20 + lo).astype(np.uint64)))
    yield batch(rows, lo, hi, core.view(np.int64), span.view(np.int64))


def _window_rows(length: int):
    """The windows of some distances of contexts, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content", 1 << 18):
                data, offsets = bytes_of(part.column("content"))
                lo, hi, most = (part.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "most"))
                many = hi - lo + 1
                rows = np.repeat(np.arange(part.num_rows), many)
                distance = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + lo[rows]
                start = offsets[rows] + most[rows] - distance
                window = run_hashes(BYTE_CODES[data], start, start + length).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows)) for c in ("c1", "c2", "m")), pa.array(distance.astype(np.int32)), pa.array(window)], names=["c1", "c2", "m", "distance", "window"])

    return run


def _bucket_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = [], 0
        for b in batches:
            pieces.append((*(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) if c != "content" else b.column(c).to_pylist() for c in ("c1", "c2", "content", "least", "most", "m")),))
            held += b.num_rows
        if held:
            yield from _bucket(pieces, length)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(key, spans): for each document with repeats the byte ranges [start, end) of repeated strings; they may overlap. Written to the shared folder."""
    texts = keyed(docs, id_col, text_col)
    live = shared_anchors(texts.mapInArrow(_lead_rows(length), SCHEMA))
    hot = restrict(texts, live.select("key"), "key", live.count()).join(live, "key")
    contexts = hot.mapInArrow(_context_rows(length, True), "c1 long, c2 long, content binary, least int, most int, m long")
    contexts = contexts.groupBy("c1", "c2").agg(F.first("content").alias("content"), F.first("least").alias("least"), F.first("most").alias("most"), F.sum("m").alias("m"))
    contexts = written(contexts.withColumn("lead", F.expr(f"substring(content, most + 1, {lead_for(length)})")), "contexts")
    size = contexts.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    found = contexts.repartitionByRange(buckets, "lead", "c1").drop("lead").mapInArrow(_bucket_rows(length), "c1 long, c2 long, lo int, hi int, m long, core long, span long, open boolean")
    found = written(found, "suffixes")
    # across boundaries: equal spans repeat as a whole; where only the cores are equal, one context of each span gives its windows
    edges = found.filter("open").withColumn("all", F.sum("m").over(Window.partitionBy("core", "span")))
    spans = found.filter("open").groupBy("core", "span").agg(F.min(F.struct("c1", "c2", "lo", "hi")).alias("one"), F.sum("m").alias("m"))
    mixed = spans.join(spans.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1"), "core").select("one.*", "m")
    windows = mixed.join(contexts.select("c1", "c2", "content", "most"), ["c1", "c2"]).mapInArrow(_window_rows(length), "c1 long, c2 long, m long, distance int, window long")
    across = windows.withColumn("all", F.sum("m").over(Window.partitionBy("window"))).filter("all > 1")
    ranges = found.filter("not open").select("c1", "c2", "lo", "hi").union(edges.filter("all > 1").select("c1", "c2", "lo", "hi")).union(across.select("c1", "c2", "distance", "distance"))
    ranges = written(ranges.groupBy("c1", "c2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")
    places = hot.mapInArrow(_context_rows(length, False), "c1 long, c2 long, key long, place long")
    # contexts with very many places meet them by a broadcast, a checked number; the others by a shuffle
    often = contexts.filter(F.col("m") >= OFTEN).select("c1", "c2")
    n_often = often.count()
    spans = F.transform("ranges", lambda r: F.struct((F.col("place") - r["hi"]).alias("start"), (F.col("place") - r["lo"] + length).alias("end"))).alias("spans")
    if 0 < n_often <= BROADCAST_ROWS // 10:
        hot_ranges = ranges.join(F.broadcast(often), ["c1", "c2"], "left_semi")
        out = places.join(F.broadcast(hot_ranges), ["c1", "c2"]).select("key", spans)
        out = out.unionByName(places.join(F.broadcast(often), ["c1", "c2"], "left_anti").join(ranges, ["c1", "c2"]).select("key", spans))
    else:
        out = places.join(ranges, ["c1", "c2"]).select("key", spans)
    return written(out.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


def _digest_rows(texts: bool):
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = bytes_of(part.column("text"))
                raw, marks, rows = data.tobytes(), part.column("spans"), []
                for i in range(part.num_rows):
                    own, n = raw[offsets[i] : offsets[i + 1]], int(offsets[i + 1] - offsets[i])
                    spans = marks[i].values if marks[i].is_valid else None
                    if spans is None or not n:
                        rows.append((n, 0, 0, hashlib.sha256(own).hexdigest(), own if texts else None))
                        continue
                    start, end = (np.minimum(spans.field(f).to_numpy(), n) for f in ("start", "end"))
                    gone = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0
                    kept = data[offsets[i] : offsets[i + 1]][~gone].tobytes()
                    rows.append((n, int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept if texts else None))
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return run


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): the bytes left of each document; kept is null without `texts`."""
    marks = repeated_spans(docs, id_col, text_col, length)
    rows = with_marks(keyed(docs, id_col, text_col), marks, "key", marks.count())
    out = rows.mapInArrow(_digest_rows(texts), "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(unkeyed().alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
