"""Exact Jaccard self-join of shingle sets with adaptive multi-match prefixes.

All sets are ordered by one order of the shingles, rare ones first.  With a
required overlap of t, two linked sets share at least m shingles within their
first n - t + m (the m-prefix), for any m <= t; so a pair whose sides chose
m and m' need only be looked at if their prefixes share min(m, m').  Each set
chooses its own m, from a twelfth of its size up, by estimated cost: the postings
its prefix meets plus the pairs that m shared shingles would leave to verify.
A set whose prefix shares too few shingles with all others together can have
no link and is dropped before any pair is made.

Rarity comes from a table of counts over all documents: shingles hashed to a
fixed number of cells, a bounded size at any corpus size.  It steers the order
and m only and cannot lose a link.

Equal sets are one class, found by a 128-bit digest, and only one of them
takes part.  Classes that share a prefix shingle are first compared with one of
them (a star), which joins groups of near copies around their first member.
What is left are shingles that still meet in different components:

* of at most FEW sets: their pairs are rows, at most (FEW - 1) / 2 for each posting;
* of more sets: the sets are dealt into blocks of bounded size, near copies
  (those whose most frequent open shingle is the same, or few and near such ones) side by side, and
  each pair of blocks that shares such a shingle is one group.  It intersects its
  sets by a matrix product and gives back only links that join components.

A block travels once for each block it meets: rows are sets times blocks, and a component that fills blocks
of its own meets only the blocks of others, so they grow with the square of what stays
unlinked under one shingle, over the size of a block.  No pair that could join two components is left
out.  The comparisons inside a group of near copies that stay unlinked are still
quadratic in that group, at the cost of a product of two numbers each.

Defined cases: null or empty texts have the empty set and link with nothing;
texts shorter than a shingle have their whole word sequence as one shingle;
a null doc_id takes part like a document before all others; rows that repeat
a doc_id and a text share its links (of different texts under one doc_id those of one count).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import exclude, few, keyed, restrict, small, unkeyed, written
from .textbytes import NON_SPACE, mix, slices, words_of

#: Cells of the count table: 1 MB at any corpus size.
CELLS, BLOCKS = 1 << 18, 16
#: A set takes m >= n / LEAST_SHARE matches at least; what verifying a pair costs in postings.
LEAST_SHARE, VERIFY_COST = 12, 8.0
#: Open shingles of at most so many sets make pairs as rows; shingles that a block holds for the sets of other shingles.
FEW, BLOCK = 32, 100_000
#: What a set adds to its block besides its shingles, so that a block has at most BLOCK / SET sets.
SET = 32
#: Pairs of a hub for which its set travels once.
PARTNERS = 512
#: Shared shingles that a task remembers, so that it sends a delegate for each only once.
REMEMBERED = 1 << 18


def _sets(part: pa.RecordBatch, words_in: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = words_of(part.column("text"), NON_SPACE, lower=True)
    at, hashes = words.grams(words_in)
    first = np.searchsorted(at, words.first)
    short = np.flatnonzero((words.counts > 0) & (words.counts < words_in))
    whole = dict(zip(short.tolist(), words.runs(words.first[short], words.first[short + 1]), strict=True))
    for i in range(part.num_rows):
        own = np.sort(hashes[first[i] : first[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif i in whole:
            own = np.array([whole[i]], np.uint64)
        yield own


def _digest(own: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(CELLS)).astype(np.int64)


def _set_rows(words_in: int):
    names = ["key", "n", "d1", "d2", "block", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, any_rows = np.zeros(CELLS, np.int64), False
        for batch in batches:
            for part in slices(batch, "text"):
                any_rows, rows, seen = True, [], []
                for own in _sets(part, words_in):
                    rows.append((len(own), *_digest(own)))
                    seen.append(own)
                cells += np.bincount(_cell(np.concatenate(seen)), minlength=CELLS)
                n, d1, d2 = zip(*rows, strict=True)
                m = len(rows)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if any_rows:
            own = [x.astype("<u4").tobytes() for x in np.split(np.minimum(cells, 2**32 - 1), BLOCKS)]
            none = pa.nulls(BLOCKS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(BLOCKS), pa.int32()), pa.array(own, pa.binary())], names=names)

    return run


def _sum_cells(pdfs):
    import pandas as pd

    total, block = None, None
    for pdf in pdfs:
        for b, cells in zip(pdf["block"], pdf["cells"], strict=True):
            x = np.frombuffer(cells, "<u4").astype(np.uint64)
            total, block = x if total is None else total + x, b
    if total is not None:
        yield pd.DataFrame({"block": [block], "cells": [np.minimum(total, 2**63 - 1).astype("<i8").tobytes()]})


def fewest_matches(n):
    """The least m that a set of n shingles takes; a number or a Column."""
    return n // LEAST_SHARE if isinstance(n, int) else F.floor(n / LEAST_SHARE)


class Prefixes:
    """Order and prefix length of a set under given counts."""

    def __init__(self, counts: np.ndarray, percent: int):
        self.counts, self.percent = counts, percent

    def __call__(self, own: np.ndarray) -> tuple[np.ndarray, int, int]:
        """(the set in the global order, m, prefix length)."""
        n, often = len(own), self.counts[_cell(own)]
        order = np.lexsort((own, often))
        t = -(-self.percent * n // 100)
        met = np.cumsum(often[order])
        m = np.arange(max(1, fewest_matches(n)), t + 1)
        scanned = met[n - t + m - 1]
        best = int(m[np.argmin(scanned + VERIFY_COST * scanned / m)])
        return own[order], best, n - t + best


def _posting_rows(words_in: int, prefixes):
    """(shingle, salt, key, pos, known): postings that find a partner in their task are known to be shared and dealt at random; one delegate of each shingle meets the rest of the corpus."""
    names = ["shingle", "salt", "key", "pos", "known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, sent = prefixes.value, np.empty(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                keys = part.column("key").to_numpy(zero_copy_only=False)
                first: dict[bytes, int] = {}
                heads, owners, places = [], [], []
                for key, own in zip(keys.tolist(), _sets(part, words_in), strict=True):
                    # a slice sends each set once: its copies are found by their digests
                    if len(own) and first.setdefault(own.tobytes() if len(own) < 3 else hashlib.blake2b(own.tobytes(), digest_size=16).digest(), key) == key:
                        own, _, p = cut(own)
                        heads.append(own[:p])
                        owners.append(np.full(p, key, np.int64))
                        places.append(np.arange(p, dtype=np.int32))
                if not heads:
                    continue
                shingles, keys, pos = np.concatenate(heads), np.concatenate(owners), np.concatenate(places)
                order = np.lexsort((keys, shingles))
                shingles, keys, pos = shingles[order], keys[order], pos[order]
                new = np.concatenate(([True], shingles[1:] != shingles[:-1]))
                before = np.isin(shingles[new], sent)
                group = np.cumsum(new) - 1
                many = np.bincount(group) > 1
                known = (many | before)[group]
                salt = np.where(known & ~(new & ~before[group]), (mix(keys.view(np.uint64)) | np.uint64(1)).view(np.int64), 0)
                if len(sent) > REMEMBERED:
                    sent = np.empty(0, np.uint64)
                sent = np.union1d(sent, shingles[new][many])
                columns = shingles.view(np.int64), salt, keys, pos, known
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return run


def _node_rows(words_in: int, prefixes):
    names = ["key", "d1", "d2", "n", "m", "head", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = prefixes.value
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for own in _sets(part, words_in):
                    d1, d2 = _digest(own)
                    own, m, p = cut(own) if len(own) else (own, 0, 0)
                    own = own.view(np.int64)
                    rows.append((d1, d2, len(own), m, own[:p], own[p:]))
                d1, d2, n, m, head, tail = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int32()), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=names)

    return run


def _may_link(x, y, percent: int):
    """Whether two postings of a shingle leave room for a link: at most the shared shingles of the set with fewer of them come before it, and the rest of the set with less rest after it.

    x and y give a column by name.
    """
    most = F.least(x("before"), y("before")) + F.least(x("n") - x("pos"), y("n") - y("pos"))
    return (100 + percent) * F.least(most, x("n"), y("n")) >= percent * (x("n") + y("n"))


def _passing(pairs: DataFrame, nodes: DataFrame, columns: list[str], test) -> DataFrame:
    """The pairs (a, b) of which `test` holds, given the nodes' columns by name with an a or b behind.

    What belongs to b travels once a pair, what belongs to a once for PARTNERS pairs: of an a with more, the partners are dealt
    over salts, so that a hub of any size takes many tasks.
    """
    heavy = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("salts")).filter("salts > 1"), "hubs")
    salted = pairs.join(small(heavy, heavy.count()), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).alias("salt"))
    side = lambda x: nodes.select(F.col("key").alias(x), *(F.col(c).alias(c + x) for c in columns))
    hubs = salted.select("a", "salt").distinct().join(side("a"), "a")
    return salted.join(side("b"), "b").join(hubs, ["a", "salt"]).filter(test).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose heads share enough and whose sets are similar enough; whole sets travel only for pairs that the heads let pass."""
    close = _passing(pairs, nodes, ["m", "head"], F.size(F.array_intersect("heada", "headb")) >= F.least("ma", "mb"))
    shared = F.size(F.array_intersect("seta", "setb"))
    return _passing(written(close, "close"), nodes, ["n", "set"], 100 * shared >= percent * (F.col("na") + F.col("nb") - shared))


def _shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of x shares with each set of y (sets are arrays without repeats)."""
    xs, ys = np.concatenate(x), np.concatenate(y)
    xi, yi = np.repeat(np.arange(len(x)), [len(a) for a in x]), np.repeat(np.arange(len(y)), [len(a) for a in y])
    both = np.intersect1d(xs, ys)
    xc, yc = np.minimum(np.searchsorted(both, xs), max(0, len(both) - 1)), np.minimum(np.searchsorted(both, ys), max(0, len(both) - 1))
    out = np.zeros((len(x), len(y)), np.float32)
    if not len(both):
        return out
    keep, kept = both[xc] == xs, both[yc] == ys
    (xi, xc), (yi, yc) = (xi[keep], xc[keep]), (yi[kept], yc[kept])
    nx, ny = np.bincount(xc, minlength=len(both)), np.bincount(yc, minlength=len(both))
    # what most sets hold goes into matrices, some columns at a time; for the others their pairs are counted one by one
    dense = np.flatnonzero(nx * ny > 0.01 * len(x) * len(y))
    column = np.full(len(both), -1)
    column[dense] = np.arange(len(dense))
    for a in range(0, len(dense), 4096):
        left, right = (np.zeros((n, min(4096, len(dense) - a)), np.float32) for n in (len(x), len(y)))
        for m, i, c in ((left, xi, column[xc] - a), (right, yi, column[yc] - a)):
            own = (c >= 0) & (c < m.shape[1])
            m[i[own], c[own]] = 1
        out += left @ right.T
    own, other = np.flatnonzero(column[xc] < 0), np.flatnonzero(column[yc] < 0)
    own = own[np.argsort(xc[own], kind="stable")]
    other = other[np.argsort(yc[other], kind="stable")]
    begin = np.searchsorted(yc[other], xc[own])
    many = ny[xc[own]]
    at = np.repeat(np.arange(len(own)), many)
    partner = other[begin[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
    return out + np.bincount(xi[own[at]] * len(y) + yi[partner], minlength=out.size).reshape(out.shape)


def _joining(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Few of the links (i, j) that join the same components as all of them; left and right: the components of i and j."""
    while True:
        links = links[left[links[:, 0]] != right[links[:, 1]]]
        if not len(links):
            return
        a, b = left[links[:, 0]], right[links[:, 1]]
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))  # each component joins the least one it is linked with
        one = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
        yield from links[one].tolist()
        to = dict(zip(high[one].tolist(), low[one].tolist(), strict=True))
        for labels in (left, right):
            for i, c in enumerate(labels.tolist()):
                while c in to:
                    c = to[c]
                labels[i] = c


def _block_links(percent: int):
    """The links (a, b) between the sets of two blocks, or within one, that join components."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side, reps, components = (group.column(c).to_numpy() for c in ("side", "rep", "component"))
        sets = [x.values.to_numpy() for x in group.column("set")]
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if (side == 0).all() else 1))
        n = np.array([len(s) for s in sets], np.float64)
        shared = _shared_counts([sets[i] for i in x], [sets[i] for i in y])
        links = np.argwhere((components[x][:, None] != components[y][None, :]) & ((100 + percent) * shared >= percent * (n[x][:, None] + n[y][None, :])))
        found = [(int(reps[x[i]]), int(reps[y[j]])) for i, j in _joining(links, components[x].copy(), components[y].copy())]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _blocks(hot: DataFrame, nodes: DataFrame, percent: int, n_live: int) -> DataFrame:
    """Links (a, b) between sets of different components that share a posting of hot (shingle, rep, n, component, all)."""
    home = F.max(F.struct("all", "shingle")).over(Window.partitionBy("rep"))
    held = written(few(hot.select("shingle", "rep", "n", "component", home.alias("home")), n_live * 64), "held")
    homes = written(few(held.select("rep", "n", "component", "home").distinct(), n_live), "homes")
    # a home of few sets joins the most frequent one that its sets' shingles lead to, so that blocks are full
    full = homes.groupBy("home").agg((F.sum(F.col("n") + SET) >= BLOCK // 2).alias("full"))
    led = held.groupBy("shingle").agg(F.max("home").alias("led"))
    led = held.select("shingle", "rep").join(led, "shingle").groupBy("rep").agg(F.max("led").alias("led"))
    homes = homes.join(small(full, n_live), "home").join(small(led, n_live), "rep").select("rep", (F.col("n") + SET).alias("n"), "component", F.when(F.col("full"), F.col("home")).otherwise(F.col("led"))["shingle"].alias("home"))
    homes = written(few(homes, n_live), "homes")
    # a component that fills blocks of its own need not be compared with itself
    sizes = homes.groupBy("home", "component").agg(F.sum("n").alias("size")).withColumn("own", F.when(F.col("size") >= BLOCK // 4, F.col("component")))
    chunks = sizes.groupBy("home", "own").agg(F.ceil(F.sum("size") / BLOCK).alias("chunks"))
    own = sizes.select("home", "component", "own").join(chunks.withColumnRenamed("home", "h").withColumnRenamed("own", "o"), F.col("home").eqNullSafe(F.col("h")) & F.col("own").eqNullSafe(F.col("o"))).select("home", "component", "own", "chunks")
    block = F.xxhash64("home", "own", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    members = written(few(homes.join(small(own, n_live), ["home", "component"]).select("rep", "component", "own", block.alias("block")), n_live), "members")
    holds = written(few(hot.select("shingle", "rep").join(small(members.select("rep", "block", "own"), n_live), "rep").select("shingle", "block", "own").distinct(), n_live * 64), "holds")
    x, y = holds.alias("x"), holds.alias("y")
    meet = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.block") <= F.col("y.block")) & ~F.coalesce(F.col("x.own") == F.col("y.own"), F.lit(False)))
    meet = written(meet.select(F.col("x.block").alias("a"), F.col("y.block").alias("b")).distinct(), "meet")
    sides = meet.select("a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).union(meet.filter("a <> b").select("a", "b", F.col("b").alias("block"), F.lit(1).alias("side")))
    sets = members.join(nodes.select(F.col("key").alias("rep"), "set"), "rep")
    pairs = sets.join(small(sides, 2 * meet.count()), "block").select("a", "b", "side", "rep", "component", "set")
    return pairs.groupBy("a", "b").applyInArrow(_block_links(percent), "a long, b long")


def linked_components(postings: DataFrame, nodes: DataFrame, percent: int, may_link, n_postings: int, n_live: int) -> DataFrame:
    """(node, component) of the sets that link with others, each pair of sets that share a shingle in postings being compared unless links join it already.

    postings (shingle, rep, n, ...), shingles of two sets at least; may_link(x, y) says of two postings of a
    shingle, given by their columns, whether their sets may link.  nodes (key, n, m, head, set): sets link only
    if their heads share the smaller m.
    """

    def ordered(a, b):
        return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")

    def of_hub(c):
        return F.col(f"hub.{c}")

    fields = [c for c in postings.columns if c != "shingle"]

    hubs = postings.join(postings.groupBy("shingle").agg(F.min(F.struct(*fields)).alias("hub")), "shingle").filter("rep <> hub.rep").filter(may_link(F.col, of_hub))
    tested = written(few(hubs.select(*ordered(F.col("rep"), F.col("hub.rep"))).distinct(), n_postings), "pairs")
    links = written(few(_verified(tested, nodes, percent), n_postings), "links")
    labels = components(links)
    # postings whose shingle still meets in different components
    marked = postings.join(small(labels.withColumnRenamed("node", "rep"), n_live), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    groups = marked.groupBy("shingle").agg(F.count("*").alias("all"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("shingle", "all")
    open_ = written(few(marked.join(groups, "shingle"), n_postings), "open")
    x, y = (open_.filter(F.col("all") <= FEW).alias(side) for side in "xy")
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & may_link(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")))
    pairs = written(few(pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), n_postings), "pairs")
    more = written(few(_verified(pairs, nodes, percent).union(_blocks(open_.filter(F.col("all") > FEW), nodes, percent, n_live)), n_postings), "links")
    return labels if more.isEmpty() else components(links.union(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id): two texts link when 100 * |intersection| >= percent * |union|.

    component_id is the smallest doc_id that links reach.  Runs Spark jobs and keeps intermediate tables in the shared folder.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    spark, texts = docs.sparkSession, keyed(docs, id_col, text_col)
    rows = written(texts.mapInArrow(_set_rows(words), "key long, n long, d1 long, d2 long, block int, cells binary"), "sets")
    counts = np.zeros(CELLS)
    for r in rows.filter("cells is not null").select("block", "cells").groupBy("block").applyInPandas(lambda pdf: next(_sum_cells([pdf])), "block int, cells binary").collect():  # 16 rows
        counts[r.block * (CELLS // BLOCKS) :][: CELLS // BLOCKS] = np.frombuffer(r.cells, "<i8")
    prefixes = spark.sparkContext.broadcast(Prefixes(counts, percent))

    sets = rows.filter("cells is null")
    first = sets.filter("n > 0").groupBy("d1", "d2").agg(F.min("key").alias("rep"))
    classes = written(sets.join(first, ["d1", "d2"], "left").select("key", "n", "rep", "d1", "d2"), "classes")
    reps = classes.filter("key = rep").select("key", "d1", "d2").distinct()

    bucket = Window.partitionBy("shingle", "salt")
    met = texts.mapInArrow(_posting_rows(words, prefixes), "shingle long, salt long, key long, pos int, known boolean")
    met = met.withColumn("first", F.min("key").over(bucket)).withColumn("last", F.max("key").over(bucket)).filter("known or first <> last").select("shingle", "key", "pos")
    postings = met.join(classes.filter("rep is not null").select("key", "rep", "n").distinct(), "key").select("shingle", "rep", "n", "pos").distinct()
    enough = F.greatest(F.lit(1), fewest_matches(F.ceil(F.col("n") * percent / 100)))
    for _ in range(2):  # what can't have a link goes: sets that share too little, then shingles of one set
        postings = written(postings, "postings")
        sharing = postings.groupBy("rep", "n").agg(F.count("*").alias("k")).filter(F.col("k") >= enough).select("rep")
        postings = postings.drop("k").join(sharing, "rep", "left_semi")
        postings = postings.join(postings.groupBy("shingle").agg(F.count("*").alias("k")).filter("k > 1"), "shingle")
    # linked sets share at least `enough` of these, so one of them is left when each set drops enough - 1 of its most common
    own = Window.partitionBy("rep")
    postings = postings.withColumn("at", F.row_number().over(own.orderBy("k", "shingle"))).withColumn("all", F.count("*").over(own)).withColumn("before", F.row_number().over(own.orderBy("pos")) - 1)
    postings = written(postings.filter(F.col("at") <= F.col("all") - enough + 1).select("shingle", "rep", "n", "pos", "before"), "postings")
    n_postings = postings.count()
    live = written(few(postings.select(F.col("rep").alias("key")).distinct(), n_postings), "live")
    n_live = live.count()

    nodes = restrict(texts, live, "key", n_live).mapInArrow(_node_rows(words, prefixes), "key long, d1 long, d2 long, n long, m int, head array<long>, tail array<long>")
    nodes = written(nodes.join(reps.join(live, "key", "left_semi"), ["key", "d1", "d2"], "left_semi").dropDuplicates(["key"]).drop("d1", "d2"), "nodes")

    nodes = nodes.withColumn("set", F.concat("head", "tail")).drop("tail")
    labels = linked_components(postings, nodes, percent, lambda x, y: _may_link(x, y, percent), n_postings, n_live)
    out = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("key_out", F.coalesce("component", "rep", "key"))
    return out.select(unkeyed().alias(id_col), F.col("n").alias("n_shingles"), unkeyed("key_out").alias("component_id"))


def keep_first_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; columns as given. Rows that repeat a doc_id stay or go together."""
    found = near_duplicates(docs, id_col, text_col, words, percent).filter(F.col(id_col) != F.col("component_id"))
    name = "_gone"
    while name in docs.columns:
        name += "_"
    gone = written(found.select(F.col(id_col).alias(name)).distinct(), "gone")
    return exclude(docs, gone, F.col(id_col).cast("long") == F.col(name), gone.count())
