"""Windows anchored at events, for keys with so many events that one task shouldn't fold them.

A window opens at an attempt that counts (a "hit"); it closes when a success comes before `limit` hits, or else
after its time.  The next window opens at the first hit after that.  So each hit has one successor, whatever
came before it: the hit that would open the next window if this one opened a window.  Which hits do is the path of successors
from the key's first hit, and is found without a fold:

1. Rows are sorted by ranges of (key, time), so a key spreads over blocks, one a partition.
2. A few numbers of each block (hits, last hit, first success) and of its first and last key, as others lie in it alone, tell every block in which other block a
   successor lies.
3. In a block all successors are found at once by binary search, and by pointer doubling the last hit of the path
   through the block from any of its hits, its exit.  Exits whose successor lies in another block are sent there and come
   back as edges from exit to exit.
4. Edges are doubled (exit to exit after 2, 4, 8 ... blocks) while the exits on the path are marked, from
   the first on; after log2(blocks) rounds all are.
5. Each block gets the window that is open when it begins, walks from window to window, and numbers its rows.

Tasks hold a block of some BLOCK_ROWS rows; the driver and tasks hold the numbers of step 2 and a window, for two keys of each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import checkpointed

NEVER = 2**62
#: Rows of a block, on average: what a task holds.
BLOCK_ROWS = 100_000


@dataclass
class KeyBlocks:
    """What is known of a key's blocks, in order: arrays over blocks."""

    pids: list[int] = field(default_factory=list)
    hits: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)  # time of the last hit
    success: list[int] = field(default_factory=list)  # time of the first success, or NEVER
    before: list[int] = field(default_factory=list)  # hits of the block before it

    def settle(self) -> KeyBlocks:
        """Adds where each block's hits begin, and the next success after each block: its time, the rank of the first hit after it, and its block."""
        n = np.array(self.hits, np.int64)
        self.begin = np.cumsum(n) - n
        self.total = int(n.sum())
        self.full = np.flatnonzero(n > 0)  # blocks with hits
        self.last_of_full = np.array(self.last, np.int64)[self.full]
        self.next_time, self.next_rank, self.next_block = (np.full(len(n), NEVER) for _ in range(3))
        for b in range(len(n) - 2, -1, -1):
            here = self.success[b + 1] < NEVER
            self.next_time[b] = self.success[b + 1] if here else self.next_time[b + 1]
            self.next_rank[b] = self.begin[b + 1] + self.before[b + 1] if here else self.next_rank[b + 1]
            self.next_block[b] = b + 1 if here else self.next_block[b + 1]
        self.place = {p: i for i, p in enumerate(self.pids)}
        return self

    def block_of_rank(self, ranks: np.ndarray) -> np.ndarray:
        return self.full[np.minimum(np.searchsorted(self.begin[self.full], ranks, "right") - 1, len(self.full) - 1)]

    def block_of_time(self, times: np.ndarray) -> np.ndarray:
        """The first block with a hit at or after a time; len(pids) where there is none."""
        at = np.searchsorted(self.last_of_full, times)
        return np.where(at < len(self.full), np.append(self.full, 0)[np.minimum(at, len(self.full))], len(self.pids))


@dataclass(frozen=True)
class Rule:
    limit: int
    window: int

    def successors(self, t: np.ndarray, rank: np.ndarray, next_time: np.ndarray, next_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether a success closes the window of each hit, the rank of its successor then, the earliest time of it else)."""
        closed = (next_rank - rank < self.limit) & (next_time < t + self.window)
        return closed, next_rank, t + self.window


class Block:
    """The hits of a key in a block, with their successors: a local number, or one of another block."""

    def __init__(self, t: np.ndarray, ok: np.ndarray, blocks: KeyBlocks, pid: int, rule: Rule):
        self.blocks, self.b = blocks, blocks.place[pid]
        self.rows = np.flatnonzero(~ok)  # places of the hits
        self.t, self.begin = t[self.rows], int(blocks.begin[self.b])
        rank = self.begin + np.arange(len(self.t))
        good = np.flatnonzero(ok)
        at = np.searchsorted(good, self.rows)
        inside = at < len(good)
        own = good[np.minimum(at, len(good) - 1)] if len(good) else np.zeros(len(at), int)
        self.next_time = np.where(inside, t[own] if len(t) else 0, blocks.next_time[self.b])
        self.next_rank = np.where(inside, self.begin + np.searchsorted(self.rows, own), blocks.next_rank[self.b])
        self.next_block = np.where(inside, self.b, blocks.next_block[self.b])
        self.success_at = np.where(inside, own, len(t))
        self.closed, ranks, times = rule.successors(self.t, rank, self.next_time, self.next_rank)
        self.rank = rank
        by_time = np.searchsorted(self.t, times)
        local = np.where(self.closed, ranks - self.begin, by_time)
        self.value = np.where(self.closed, ranks, times)
        self.inside = local < len(self.t)
        self.next = np.where(self.inside, local, np.arange(len(self.t)))

    def exits(self) -> np.ndarray:
        """For each hit the last one of the path from it that lies in this block."""
        to = self.next.copy()
        while True:
            further = to[to]
            if (further == to).all():
                return to
            to = further

    def entry(self, by_rank: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The local number of the hit that is sought by rank or time; the number of hits where it lies behind."""
        return np.where(by_rank, value - self.begin, np.searchsorted(self.t, value)).astype(np.int64)

    def target(self, i: np.ndarray) -> np.ndarray:
        """The block of the successor of exits i; the number of blocks where there is none."""
        if not len(self.blocks.full):
            return np.full(len(i), len(self.blocks.pids))
        v = self.value[i]
        by_rank = np.where(v < self.blocks.total, self.blocks.block_of_rank(v), len(self.blocks.pids))
        return np.where(self.closed[i], by_rank, self.blocks.block_of_time(v))


def _parts(pdf: pd.DataFrame) -> Iterator[tuple[object, slice]]:
    """The runs of equal keys of sorted rows."""
    keys = pdf["_k"].to_numpy()
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield keys[a], slice(a, b)


def _whole(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """All rows of a task: a block."""
    all_ = list(pdfs)
    return pd.concat(all_, ignore_index=True) if all_ else None


def spread(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows sorted by ranges of (key, order), kept as they are now: + _pid, the block of a row.

    There are as many blocks as keep them at BLOCK_ROWS, and two for each core at least; sizes in bytes, by which Spark would merge them, say little of rows.
    """
    rows = checkpointed(rows)  # counted, sampled and dealt
    blocks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // BLOCK_ROWS))
    return checkpointed(rows.repartitionByRange(blocks, key, *order).sortWithinPartitions(key, *order).withColumn("_pid", F.spark_partition_id()))


def _summary(k, pid: int, t: np.ndarray, ok: np.ndarray) -> tuple:
    hits, good = np.flatnonzero(~ok), np.flatnonzero(ok)
    return str(k), pid, len(hits), int(t[hits[-1]]) if len(hits) else -NEVER, int(t[good[0]]) if len(good) else NEVER, int(good[0]) if len(good) else len(hits)


def _joined(found) -> dict[object, KeyBlocks]:
    out: dict[object, KeyBlocks] = {}
    for k, *values in found:
        own = out.setdefault(k, KeyBlocks())
        for name, value in zip(("pids", "hits", "last", "success", "before"), values, strict=True):
            getattr(own, name).append(value)
    return {k: v.settle() for k, v in out.items()}


def _summaries(rows: DataFrame) -> dict[object, KeyBlocks]:
    """Of the first and the last key of each block: only these can lie in others too."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = _whole(pdfs)
        parts = list(_parts(pdf)) if pdf is not None else []
        out = [_summary(k, int(pdf["_pid"].iloc[0]), pdf["_t"].to_numpy()[part], pdf["_ok"].to_numpy()[part]) for k, part in parts[:1] + parts[1:][-1:]]
        yield pd.DataFrame(out, columns=["k", "pid", "hits", "last", "success", "before"])

    found = rows.select("_k", "_t", "_ok", "_pid").mapInPandas(run, "k string, pid int, hits long, last long, success long, before long").collect()  # two for each block
    return _joined(sorted(found, key=lambda r: r.pid))


def open_windows(rows: DataFrame, known, rule: Rule) -> dict[object, dict[int, tuple]]:
    """For each key that may lie in several blocks the exits on its path, at most one for each block: rank -> (time, pid, whether the successor goes by rank, its rank or time, block of the next success).

    rows: _k, _t, _ok, _pid as made by spread(); known: broadcast _summaries.
    """

    def leave(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf, out = _whole(pdfs), []
        for k, part in _parts(pdf) if pdf is not None else ():
            if str(k) not in known.value:
                continue
            blocks, pid = known.value[str(k)], int(pdf["_pid"].iloc[0])
            block = Block(pdf["_t"].to_numpy()[part], pdf["_ok"].to_numpy()[part], blocks, pid, rule)
            if not len(block.t):
                continue
            x = np.flatnonzero(~block.inside)
            to = block.target(x)
            pids = np.append(np.array(blocks.pids), -1)[to]
            root = block.exits()[0] if block.b == blocks.full[0] else -1
            out.append(pd.DataFrame({"k": str(k), "rank": block.rank[x], "t": block.t[x], "pid": pid, "to": pids, "by_rank": block.closed[x], "value": block.value[x], "closed_in": block.next_block[x], "root": x == root}))
        if out:
            yield pd.concat(out)

    schema = "k string, rank long, t long, pid int, to int, by_rank boolean, value long, closed_in long, root boolean"
    exits = checkpointed(rows.select("_k", "_t", "_ok", "_pid").mapInPandas(leave, schema))

    def arrive(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"k": pd.Series([], dtype=object), "rank": pd.Series([], dtype="int64"), "next": pd.Series([], dtype="int64")})]
        right = right.sort_values(["_k", "_at"], kind="stable").reset_index(drop=True)
        wanted = dict(list(left.groupby("k")))
        for k, part in _parts(right):
            asked = wanted.get(str(k), left.iloc[:0])
            if len(asked):
                block = Block(right["_t"].to_numpy()[part], right["_ok"].to_numpy()[part], known.value[str(k)], int(right["_pid"].iloc[0]), rule)
                to = block.exits()[block.entry(asked["by_rank"].to_numpy(bool), asked["value"].to_numpy())]
                out.append(pd.DataFrame({"k": str(k), "rank": asked["rank"].to_numpy(), "next": block.rank[to]}))
        return pd.concat(out)

    placed = rows.select("_k", "_t", "_ok", "_pid", F.monotonically_increasing_id().alias("_at"))
    jumps = checkpointed(exits.filter("to >= 0").groupBy("to").cogroup(placed.groupBy("_pid")).applyInPandas(arrive, "k string, rank long, next long"))
    marked = checkpointed(exits.filter("root").select("k", "rank"))
    n = marked.count()
    while True:
        on = marked.join(jumps, ["k", "rank"]).select("k", F.col("next").alias("rank"))
        marked = checkpointed(marked.union(on).distinct())
        more = marked.count()
        if more == n:
            break
        n = more
        further = jumps.select("k", F.col("rank").alias("next"), F.col("next").alias("after"))
        jumps = checkpointed(jumps.join(further, ["k", "next"]).select("k", "rank", F.col("after").alias("next")))
    out: dict[object, dict[int, tuple]] = {}
    for r in marked.join(exits, ["k", "rank"]).collect():  # one for each block and key
        out.setdefault(r.k, {})[r.rank] = (r.t, r.pid, r.by_rank, r.value, r.closed_in)
    return out


class Numbered:
    """The rows of a key in a block beside the window that each falls into: when it opened, and how many hits it had before the row."""

    def __init__(self, t: np.ndarray, ok: np.ndarray, blocks: KeyBlocks, pid: int, rule: Rule, paths: dict[int, tuple]):
        block = Block(t, ok, blocks, pid, rule)
        before = [r for r, x in paths.items() if blocks.place[x[1]] < block.b]
        opened, first, at_row, closed_at = [], [], [], []  # of each window: time and rank of its hit, its row, the row of the success that closes it
        at = 0
        if before:  # the window that is open when the block begins
            rank = max(before)
            time, _, by_rank, value, closed_in = paths[rank]
            good = np.flatnonzero(ok)
            end = len(t) if not by_rank or closed_in > block.b else -1 if closed_in < block.b else int(good[0])
            opened.append(time), first.append(rank), at_row.append(-1), closed_at.append(end)
            at = int(block.entry(np.array([by_rank]), np.array([value]))[0])
        while at < len(block.t):
            opened.append(int(block.t[at])), first.append(int(block.rank[at])), at_row.append(int(block.rows[at]))
            closed_at.append(int(block.success_at[at]) if block.closed[at] else len(t))
            if not block.inside[at]:
                break
            at = int(block.next[at])
        place = np.arange(len(t))
        window = np.searchsorted(np.array(at_row, np.int64), place, "right") - 1
        some, w = window >= 0, np.maximum(window, 0)
        take = lambda x: np.array(x, np.int64)[w] if x else np.zeros(len(t), np.int64)
        self.opened = take(opened)
        hits = block.begin + np.searchsorted(block.rows, place)  # of the key before the row
        live = some & (t < self.opened + rule.window) & (place <= take(closed_at))
        self.hits_before = np.where(live, hits - take(first), 0)


def replay(rows: DataFrame, key: str, t: str, ok: str | None, order: list[str], limit: int, window: int, outputs, schema: str) -> DataFrame:
    """rows + outputs(t, Numbered) as columns, for keys of any number of rows; `t` in microseconds, `ok` the column of successes (none: all are hits)."""
    names = [c for c in rows.columns if c != t]
    placed = spread(rows.withColumns({"_k": F.col(key).cast("string"), "_t": F.col(t), "_ok": F.coalesce(F.col(ok), F.lit(False)) if ok else F.lit(False)}), "_k", ["_t", *order])
    rule, context = Rule(limit, window), rows.sparkSession.sparkContext
    known = context.broadcast(_summaries(placed))
    paths = context.broadcast(open_windows(placed, known, rule))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = _whole(pdfs)
        if pdf is None or not len(pdf):
            return
        parts = []
        for k, part in _parts(pdf):
            times, ok, pid = pdf["_t"].to_numpy()[part], pdf["_ok"].to_numpy()[part], int(pdf["_pid"].iloc[0])
            blocks = known.value.get(str(k)) or _joined([_summary(k, pid, times, ok)])[str(k)]
            numbered = Numbered(times, ok, blocks, pid, rule, paths.value.get(str(k), {}))
            parts.append(pdf.iloc[part][names].assign(**outputs(times, numbered)))
        yield pd.concat(parts)

    return placed.mapInPandas(run, schema)
