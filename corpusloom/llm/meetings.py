"""Which documents hold a hash that occurs at least twice in the corpus.

Hot hashes are met in nearly every slice of the input.  Rows that find their
partner within a task are known to be shared at once and are dealt at random;
one delegate for each task goes to the hash's common group, so that group
grows with the tasks and not with the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .textbytes import mix, signed

SCHEMA = "anchor long, salt long, key long, n int"
SALTS = 1024


def salts(known: np.ndarray, delegate: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """0 for what must meet the whole corpus, else one of SALTS numbers."""
    return np.where(known & ~delegate, 1 + (mix(keys.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)


#: Hashes that a task remembers; beyond that it forgets them and sends delegates anew.
REMEMBERED = 1 << 18


class Meetings:
    """Turns the slices of a task into rows (anchor, salt, key, n), one for each distinct pair of a slice; n is 2 where the hash is already known to repeat."""

    def __init__(self):
        self.sent = np.empty(0, np.uint64)

    def rows(self, hashes: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((keys, hashes))
        hashes, keys = hashes[order], keys[order]
        new_hash = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        new_pair = new_hash | np.concatenate(([True], keys[1:] != keys[:-1]))
        unique, group = hashes[new_hash], np.cumsum(new_hash) - 1
        many, before = np.bincount(group) > 1, np.isin(unique, self.sent)
        if len(self.sent) > REMEMBERED:
            self.sent = np.empty(0, np.uint64)
        self.sent = np.union1d(self.sent, unique[many])
        group = group[new_pair]
        hashes, keys, delegate = hashes[new_pair], keys[new_pair], new_hash[new_pair] & ~before[group]
        known = (many | before)[group]
        return pa.RecordBatch.from_arrays([signed(hashes), pa.array(salts(known, delegate, keys)), pa.array(keys), pa.array(np.where(known, 2, 1).astype(np.int32))], names=["anchor", "salt", "key", "n"])


class Earliest:
    """The earliest (key, place) of repeated hashes that a task has met so far."""

    def __init__(self):
        self.hashes, self.keys, self.places = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)

    def later(self, hashes: np.ndarray, keys: np.ndarray, places: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Which of the distinct hashes have an earlier place than (key, place) in a former slice; remembers those that repeat (`many`)."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        found = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        at = at[found]
        out = np.zeros(len(hashes), bool)
        out[found] = (self.keys[at] < keys[found]) | ((self.keys[at] == keys[found]) & (self.places[at] < places[found]))
        sooner = found & ~out
        self.keys[at[~out[found]]], self.places[at[~out[found]]] = keys[sooner], places[sooner]
        fresh = many & ~found
        if len(self.hashes) > REMEMBERED:
            self.__init__()
        both = [np.concatenate((old, new[fresh])) for old, new in ((self.hashes, hashes), (self.keys, keys), (self.places, places))]
        order = np.argsort(both[0], kind="stable")
        self.hashes, self.keys, self.places = (x[order] for x in both)
        return out


def shared_anchors(met: DataFrame) -> DataFrame:
    """(key, anchors): for each document its hashes that occur twice or more. Written to the shared folder."""
    group = Window.partitionBy("anchor", "salt")
    live = met.withColumn("n", F.sum("n").over(group)).filter("n > 1")
    return written(live.groupBy("key").agg(F.collect_set("anchor").alias("anchors")), "anchors")


def live_hashes(part: pa.RecordBatch) -> np.ndarray:
    """The shared hashes of the documents of a slice (a hash shared by one is shared by all that hold it)."""
    return np.unique(part.column("anchors").flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
