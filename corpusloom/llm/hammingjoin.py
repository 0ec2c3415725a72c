"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A set's signature holds the low BITS bits of VALUES minimum hashes; two sets' values at a place are equal
with the probability of their Jaccard similarity.  The signature is cut into CHUNKS chunks of CHUNK values.  If two
signatures differ in at most THRESHOLD = (ERRORS + 1) * CHUNKS - 1 values, one of the chunks
differs in at most ERRORS of its values (pigeonhole); every set is filed under each chunk with each
choice of ERRORS of its values left open, so such a pair shares a key, whatever the values are.  Pairs over the
threshold may meet as well.  Pairs of a key are confirmed on the full sets after a test of the
signatures; a pair of 80 % that isn't filed together would have to differ twice in every chunk
(once in 10**11 pairs), and one that the signatures' test turns away in more than FAR values (as rare).

Equal sets are one class, found by a 128-bit digest, and only one of them is filed.
Keys are sorted by ranges of (key, set), so that a key with many sets, a third of all, is spread over tasks,
and what only one set has goes at once.  From there on it is the join of nearjoin.linked_components: a star
for each key, then what still meets in different components.

Defined cases: null or empty texts have the empty set and link with nothing; texts shorter than
a shingle have their whole word sequence as one; a null doc_id takes part like a document before all
others; rows that repeat a doc_id and a text share its links and are kept or not together (of different texts under one doc_id the links of one count); a class is kept once by the smallest id; other columns are not
read.  A very long text is one row of a task; its signature is as short as any.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nearjoin import _digest, _sets, linked_components
from .storage import few, keyed, restrict, unkeyed, written
from .textbytes import mix, signed, slices

CHUNKS, CHUNK, ERRORS, BITS = 20, 5, 1, 16
VALUES = CHUNKS * CHUNK
#: Pairs at this distance or nearer are filed under a common key.
THRESHOLD = (ERRORS + 1) * CHUNKS - 1
#: Signatures that differ in more values aren't looked at further.
FAR = 55

_rng = np.random.Generator(np.random.PCG64(20240313))
_FACTORS = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The places of a chunk that a key reads, and a number of each chunk and choice.
_CHOICES = np.array([[CHUNK * c + p for p in kept] for c in range(CHUNKS) for kept in combinations(range(CHUNK), CHUNK - ERRORS)])
_MARKS = _rng.integers(0, 2**63, len(_CHOICES), dtype=np.uint64)


def signature(own: np.ndarray) -> np.ndarray:
    """VALUES numbers of BITS bits of a set of 64-bit hashes that isn't empty."""
    own, least = mix(own), np.full(VALUES, 2**64 - 1, np.uint64)
    for a in range(0, len(own), 4096):
        np.minimum(least, (own[a : a + 4096, None] * _FACTORS).min(axis=0), out=least)
    return (mix(least) >> np.uint64(64 - BITS)).astype("<u2")


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """The keys of each signature (rows), one for each chunk and choice of values left open."""
    out = np.broadcast_to(_MARKS, (len(signatures), len(_CHOICES))).copy()
    for j in range(_CHOICES.shape[1]):
        out = mix(out ^ signatures[:, _CHOICES[:, j]].astype(np.uint64))
    return out


def _signature_rows(words_in: int):
    names = ["key", "n", "d1", "d2", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                known: dict[tuple[int, int], bytes] = {}
                rows = []
                for own in _sets(part, words_in):
                    d = _digest(own)
                    if len(own) and d not in known:
                        known[d] = signature(own).tobytes()
                    rows.append((len(own), *d, known.get(d)))
                n, d1, d2, sig = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], names=names)

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, VALUES)


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            keys = keys_of(_signatures(part.column("sig")))
            again = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([signed(keys.ravel()), *(part.column(c).take(again) for c in ("rep", "n"))], names=["shingle", "rep", "n"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle those whose shingle has a neighbour, and the first and last of the task, whose neighbours may be in another."""
    held, keep_held = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        s = rows.column("shingle").to_numpy()
        same = s[1:] == s[:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([keep_held], same))
        yield from rows.slice(0, len(s) - 1).filter(pa.array(keep[:-1])).to_batches()
        held, keep_held = batch.slice(batch.num_rows - 1), bool(keep[-1])
    if held is not None:
        yield held


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): two texts link when 100 * |intersection| >= percent * |union| of their shingle sets.

    component_id is the smallest doc_id that links reach, kept whether it is the row's own.  The signature is made for
    similarities of 80 % and more; lower ones are refused.  Runs Spark jobs and keeps intermediate tables in the shared folder.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent is from 80 to 100")
    texts = keyed(docs, id_col, text_col)
    sets = written(texts.mapInArrow(_signature_rows(words), "key long, n long, d1 long, d2 long, sig binary"), "signatures")
    first = sets.filter("n > 0").groupBy("d1", "d2").agg(F.min("key").alias("rep"))
    classes = written(sets.join(first, ["d1", "d2"], "left").select("key", "n", "rep", "d1", "d2", "sig"), "classes")
    # a repeated doc_id may stand for several sets
    reps = classes.filter("key = rep").select("rep", "n", "d1", "d2", "sig").dropDuplicates(["rep", "d1", "d2"])

    filed = reps.mapInArrow(_filed, "shingle long, rep long, n long")
    near = filed.repartitionByRange("shingle", "rep").sortWithinPartitions("shingle", "rep").mapInArrow(_repeated, "shingle long, rep long, n long")
    near = written(near, "filed")
    several = near.groupBy("shingle").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("shingle")
    postings = written(near.join(several, "shingle").dropDuplicates(["shingle", "rep"]), "postings")
    n_postings = postings.count()
    live = written(few(postings.select(F.col("rep").alias("key")).distinct(), n_postings), "live")
    n_live = live.count()

    nodes = restrict(texts, live, "key", n_live).mapInArrow(_node_rows(words), "key long, d1 long, d2 long, n long, m int, head array<long>, set array<long>")
    chosen = reps.select(F.col("rep").alias("key"), "d1", "d2")
    nodes = written(nodes.join(chosen, ["key", "d1", "d2"], "left_semi").dropDuplicates(["key"]).drop("d1", "d2"), "nodes")
    close = lambda x, y: 100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))
    labels = linked_components(postings, nodes, percent, close, n_postings, n_live)
    out = classes.select("key", "n", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("key_out", F.coalesce("component", "rep", "key"))
    return out.select(unkeyed().alias(id_col), F.col("n").alias("n_shingles"), unkeyed("key_out").alias("component_id"), (F.col("key") == F.col("key_out")).alias("kept"))


def _node_rows(words_in: int):
    """head: the signature as distinct numbers of place and value, of which linked sets share at least m."""
    names = ["key", "d1", "d2", "n", "m", "head", "set"]
    places = np.arange(VALUES, dtype=np.int64) << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for own in _sets(part, words_in):
                    head = places | signature(own).astype(np.int64) if len(own) else places[:0]
                    rows.append((*_digest(own), len(own), VALUES - FAR, head, own.view(np.int64)))
                d1, d2, n, m, head, own = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int32()), pa.array(head, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))], names=names)

    return run
