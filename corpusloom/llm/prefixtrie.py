"""A trie of conversations: double-array tries of prefix shards, merged where shards share nodes.

A turn is a 128-bit digest of (role, text) and a count of words; texts are not gathered.
Equal conversations become one sequence with a count first, so that groups of copies of any size are one row.
Sequences are sharded by a prefix: of one turn, or of 2, 4, 8 ... where a prefix is shared by
more turns than a shard should have.  A node at least as deep as its shard's prefix lies in one shard
with its whole subtree; the nodes above ("upper" ones) may lie in many.

In a shard the turns get dense ids, and the sequences' nodes are packed into a
double array: the child of node s by turn t is at BASE[s] + t if CHECK says that its parent is s.
All sequences then walk the arrays together, a turn at a time, and leave their counts, their
smallest ids and their words at the nodes they pass; leaves and saved tokens are
summed from the deepest nodes up.  Whole subtrees leave the shard finished.  Upper nodes leave
it with what lies below them there, are added up by their prefix digest, and then hand
their own share to the upper nodes above them.

The ids that end at a node are sorted by ranges, joined to pieces of text within a range, and the pieces of
a node hashed one after the other; a piece is all that is held.

Memory of a task: the digests of a shard (about SHARD_TURNS turns, one sequence at least).  A conversation
is one row of 20 bytes a turn.

Defined cases: a null role or text is empty; rows without a conv_id belong to no conversation and are left
out; turns with the same number (null first) are ordered by their digest, and repeated rows are
turns of their own; a conversation whose turns all give way to an absent one's is turnless and ends at the
root; an empty table has no nodes.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small, written

#: Turns that a shard should have; ids of a piece of text to hash.
SHARD_TURNS, PIECE = 16_384, 8192
#: Conversations that share their first turns with the first of them; how many turns they share at most, plus one.
FAMILY, HEADS = 20, 4

_EMPTY = hashlib.sha256(b"").hexdigest()
_STEPS = "array<struct<h1:bigint,h2:bigint,words:int>>"


def digest_of(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def _half(hex_digest: str, at: int) -> Column:
    """16 hex digits as a long: two of 8, as a long is signed."""
    part = [F.conv(F.substring(hex_digest, at + i, 8), 16, 10).cast("long") for i in (0, 8)]
    return F.shiftleft(part[0], 32).bitwiseOR(part[1])


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, steps): the turns of each conversation in order."""
    digest = digest_of(F.col("role"), F.col("text"))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"), digest.alias("digest"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).alias("t")
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    step = F.transform("ts", lambda t: F.struct(_half(t["digest"], 1).alias("h1"), _half(t["digest"], 17).alias("h2"), t["words"].cast("int").alias("words")))
    return ordered.select("conv_id", step.alias("steps"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, steps): the first h turns of the family's first conversation, then the own ones after the first h; h = crc32(conv_id) % HEADS."""
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = convs.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("steps", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.array().cast(_STEPS)
    own = F.slice("steps", h + 1, F.greatest(F.size("steps") - h, F.lit(0)))
    first = F.when(h > 0, F.slice(F.coalesce("head", none), 1, h)).otherwise(none)
    return convs.withColumn("family", family).join(heads, "family", "left").select("conv_id", F.concat(first, own).alias("steps"))


def _prefix(k) -> Column:
    """A digest of the first k steps."""
    part = F.transform(F.slice("steps", 1, k), lambda s: F.concat_ws(",", s["h1"].cast("string"), s["h2"].cast("string")))
    return F.md5(F.array_join(part, ";"))


def _sharded(seqs: DataFrame, shard_turns: int) -> DataFrame:
    """seqs (seq, n, low, steps) with k, the length of its shard's prefix, and the shard."""
    seqs = seqs.withColumn("size", F.size("steps"))
    total = seqs.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // shard_turns))
    open_, done, k = seqs, [], 1
    while True:
        open_ = open_.withColumn("prefix", _prefix(k))
        full = written(open_.groupBy("prefix").agg(F.sum("size").alias("turns"), F.count("*").alias("own")).filter((F.col("turns") > 2 * shard_turns) & (F.col("own") > 1)).select("prefix"), "prefixes")
        many = full.count()  # at most total / shard_turns
        if not many:
            done.append(open_.withColumn("k", F.lit(k)))
            break
        done.append(open_.join(small(full, many), "prefix", "left_anti").withColumn("k", F.lit(k)))
        open_ = open_.join(small(full, many), "prefix", "left_semi")
        k *= 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("shard", F.pmod(F.xxhash64("prefix"), F.lit(buckets))).drop("prefix", "size")


class DoubleArray:
    """A trie over dense turn ids in two arrays; slot 0 is the root."""

    def __init__(self, capacity: int):
        self.base, self.check = np.zeros(capacity + 1, np.int64), np.full(capacity + 1, -1, np.int64)
        self.check[0] = 0
        self.free = 1  # no slot before it is free

    def _room(self, top: int) -> None:
        if top >= len(self.check):
            more = max(top + 1, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, np.int64)))
            self.check = np.concatenate((self.check, np.full(more, -1, np.int64)))

    def put(self, node: int, ids: np.ndarray) -> None:
        """Gives a node its children (sorted ids): the first of a few places where all their slots are free, else the end."""
        span = int(ids[-1] - ids[0])
        self._room(self.free)
        while self.check[self.free] != -1:
            self.free += 1
            self._room(self.free)
        at = self.free
        if len(ids) > 1:
            offsets = ids - ids[0]
            for place in self.free + np.flatnonzero(self.check[self.free : self.free + 64] == -1):
                self._room(int(place) + span)
                if (self.check[place + offsets] == -1).all():
                    at = int(place)
                    break
            else:
                at = int(np.flatnonzero(self.check != -1)[-1]) + 1
        self._room(at + span)
        self.base[node] = at - ids[0]
        self.check[self.base[node] + ids] = node

    def step(self, nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children of nodes by ids, -1 where there is none."""
        at = self.base[nodes] + ids
        inside = (at > 0) & (at < len(self.check))
        found = self.check[np.where(inside, at, 0)] == nodes
        return np.where(inside & found, at, -1)


def build(ids: np.ndarray, first: np.ndarray) -> DoubleArray:
    """The double array of the sequences ids[first[i]:first[i + 1]], level by level."""
    trie, sizes = DoubleArray(len(ids)), np.diff(first)
    at = np.zeros(len(sizes), np.int64)
    for d in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > d)
        own = ids[first[rows] + d]
        order = np.lexsort((own, at[rows]))
        nodes, turns = at[rows][order], own[order]
        new = np.concatenate(([True], (nodes[1:] != nodes[:-1]) | (turns[1:] != turns[:-1])))
        nodes, turns = nodes[new], turns[new]
        cuts = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
        for node, children in zip(nodes[cuts].tolist(), np.split(turns, cuts[1:]), strict=True):
            trie.put(node, children)
        at[rows] = trie.step(at[rows], own)
    return trie


_NODES = "upper boolean, key binary, path array<binary>, above binary, conv_id long, depth int, parent_conv_id long, n_convs long, words long, n_children long, n_leaves long, saved long, ends string"


def _nodes_of_shard(group: pa.Table) -> pa.Table:
    """Rows of _NODES: finished ones, whose parent may be upper (`above`), and upper ones with what is below them here."""
    group = group.combine_chunks()
    steps = group.column("steps").combine_chunks()
    n, low, k = (group.column(c).to_numpy() for c in ("n", "low", "k"))
    first = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(steps).to_numpy()))).astype(np.int64)
    flat = steps.flatten()
    digests = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2")], axis=1)
    words = flat.field("words").to_numpy(zero_copy_only=False).astype(np.int64)
    _, ids = np.unique(digests, axis=0, return_inverse=True)
    ids = ids.reshape(-1).astype(np.int64) + 1
    trie = build(ids, first)

    slots = len(trie.check)
    count, least, word, depth = np.zeros(slots, np.int64), np.full(slots, 2**63 - 1), np.zeros(slots, np.int64), np.full(slots, -1)
    upper, parent, ends, holder = np.zeros(slots, bool), np.full(slots, -1), np.full(slots, -1), np.full(slots, -1)
    at, sizes = np.zeros(len(n), np.int64), np.diff(first)
    for d in range(int(sizes.max(initial=0)) + 1):
        rows = np.flatnonzero(sizes >= d)
        if d:
            before = at[rows]
            at[rows] = trie.step(before, ids[first[rows] + d - 1])
            parent[at[rows]], word[at[rows]] = before, words[first[rows] + d - 1]
        here = at[rows]
        np.add.at(count, here, n[rows])
        np.minimum.at(least, here, low[rows])
        depth[here], holder[here] = d, rows
        upper[here[d < k[rows]]] = True
        ends[at[sizes == d]] = np.flatnonzero(sizes == d)
    live = np.flatnonzero(depth >= 0)
    live = live[np.argsort(depth[live], kind="stable")]
    # sums from the deepest level up; an upper node's own share is not known here
    children, leaves = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    saved = np.where(upper, 0, (count - 1) * word)
    cuts = np.searchsorted(depth[live], np.arange(int(depth.max()) + 2))
    for d in range(len(cuts) - 2, -1, -1):
        here = live[cuts[d] : cuts[d + 1]]
        leaves[here] += (~upper[here]) & (children[here] == 0)
        if d:
            up = parent[here]
            np.add.at(children, up, (~upper[here]).astype(np.int64))
            np.add.at(leaves, up, np.where(upper[here] & upper[up], 0, leaves[here]))
            np.add.at(saved, up, np.where(upper[here] & upper[up], 0, saved[here]))
    keys, paths, above = [], [], []
    for s in live.tolist():
        key = path = over = None
        if upper[s]:
            i, d = int(holder[s]), int(depth[s])
            own, path = hashlib.md5(), []
            for j in range(d):
                path.append(own.digest())
                own = own.copy()
                own.update(digests[first[i] + j].tobytes())
            key = own.digest()
        elif upper[parent[s]]:
            i = int(holder[s])
            over = hashlib.md5(digests[first[i] : first[i] + int(depth[s]) - 1].tobytes()).digest()
        keys.append(key)
        paths.append(path)
        above.append(over)
    mine, top = ~upper[live], parent[live]
    known = mine & (top >= 0) & ~upper[top]
    names = group.column("seq").to_pylist()
    columns = [
        pa.array(~mine),
        pa.array(keys, pa.binary()),
        pa.array(paths, pa.list_(pa.binary())),
        pa.array(above, pa.binary()),
        pa.array(least[live]),
        pa.array(depth[live].astype(np.int32)),
        pa.array(least[top], mask=~known),
        pa.array(count[live]),
        pa.array(word[live]),
        pa.array(children[live]),
        pa.array(leaves[live]),
        pa.array(saved[live]),
        pa.array([names[i] if i >= 0 else None for i in ends[live].tolist()], pa.string()),
    ]
    return pa.table(columns, names=["upper", "key", "path", "above", "conv_id", "depth", "parent_conv_id", "n_convs", "words", "n_children", "n_leaves", "saved", "ends"])


def _upper_nodes(parts: DataFrame) -> DataFrame:
    """The upper nodes of all shards added up: as finished nodes, with their key."""
    sums = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")}
    nodes = written(parts.groupBy("key").agg(F.first("path").alias("path"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.max("ends").alias("ends"), *sums.values()), "upper")
    direct = nodes.filter("depth > 0").groupBy(F.element_at("path", -1).alias("key")).agg(F.count("*").alias("more"))
    nodes = nodes.join(direct, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("words"))
    # each upper node gives what it has to itself and to all above it
    whole = nodes.select(F.explode(F.concat("path", F.array("key"))).alias("key"), "n_leaves", "saved").groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    names = nodes.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return written(nodes.drop("n_leaves", "saved").join(whole, "key").withColumn("above", F.element_at(F.when(F.size("path") > 0, F.col("path")), -1)).join(names, "above", "left").drop("path", "above", "words"), "upper")


def _hashes(ends: DataFrame) -> DataFrame:
    """(seq, sha): SHA-256 of the ids (seq, conv_id) of each seq, ascending as numbers, comma-joined."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids = None, []

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["seq", "first", "ids"])

        for batch in batches:
            for seq, i in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (seq != name or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                name = seq
                ids.append(i)
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha = None, None
        for batch in batches:
            seqs, shas = [], []
            for seq, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if seq != name:
                    if name is not None:
                        seqs.append(name)
                        shas.append(sha.hexdigest())
                    name, sha = seq, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if seqs:
                yield pa.RecordBatch.from_arrays([pa.array(seqs), pa.array(shas)], names=["seq", "sha"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sha.hexdigest()])], names=["seq", "sha"])

    cut = ends.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(pieces, "seq string, first long, ids string")
    return cut.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(hashed, "seq string, sha string")


def prefix_nodes(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Runs Spark jobs and keeps intermediate tables in the shared folder.
    """
    convs = written(conversations_of(turns), "conversations")
    members = written(rebuilt(convs).withColumn("seq", _prefix(F.size("steps"))), "members")
    seqs = written(members.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.first("steps").alias("steps")), "sequences")
    nodes = written(_sharded(seqs, shard_turns).groupBy("shard").applyInArrow(_nodes_of_shard, _NODES), "nodes")
    upper = _upper_nodes(nodes.filter("upper"))
    names = upper.select(F.col("key").alias("above"), F.col("conv_id").alias("over"))
    own = nodes.filter("not upper")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    hung = own.filter("above is not null").join(small(names, upper.count()), "above").withColumn("parent_conv_id", F.col("over"))
    every = own.filter("above is null").select(columns).unionByName(hung.select(columns)).unionByName(upper.select(columns))
    done = every.join(_hashes(members.select("seq", "conv_id")), every.ends == F.col("seq"), "left")
    return done.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"))
