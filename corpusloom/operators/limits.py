"""Rate limits and login locks: windows anchored at a key's first hit, replayed over a log or kept in a stream.

Such a window is neither aligned to the clock (window()) nor extended by hits
(session_window()), so keys are folded in time order.  A fold keeps two numbers for
each key.  Keys with more than HOT_ROWS rows are counted first and not folded: they are spread over
tasks, and their windows found by pointers (chains.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chains

#: Rows of a key that one task folds.
HOT_ROWS = 1_000_000
EXEMPT_PATHS = ("/health", "/ready", "/metrics")


def _fold(key: str, limit: int, window_s: float):
    window = round(window_s * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows of a partition come sorted by key and time; the state of one key is carried over batches, and a step takes all hits of a window
        last, opened, n = object(), 0, 0
        for pdf in batches:
            t, keys = pdf["_s"].to_numpy(np.int64), pdf[key]
            hits, opens = np.empty(len(t), np.int32), np.empty(len(t), np.int64)
            starts = np.flatnonzero((keys != keys.shift()).to_numpy()) if len(t) else np.empty(0, int)
            for a, b in zip(starts, np.append(starts[1:], len(t)), strict=False):
                if keys.iloc[a] != last:
                    last, opened, n = keys.iloc[a], t[a], 0
                while a < b:
                    if t[a] >= opened + window:
                        opened, n = t[a], 0
                    to = a + np.searchsorted(t[a:b], opened + window)
                    hits[a:to], opens[a:to] = np.arange(n + 1, n + 1 + to - a), opened
                    n, a = n + to - a, to
            yield pdf.drop(columns="_s").assign(hit_no=hits, allowed=hits <= limit, retry_after_ms=(opens + window - t) // 1000)

    return run


def _split(df: DataFrame, key: str, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys that a task folds, rows of keys with more than hot_rows; None where there is no such key)."""
    hot = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(key)
    n = hot.count()  # at most all rows / hot_rows
    if not n:
        return df, None
    mark = F.broadcast(hot) if n <= 100_000 else hot
    return df.join(mark, key, "left_anti"), df.join(mark, key, "left_semi")


def rate_limit_replay(events: DataFrame, key: str, ts: str, limit: int, window_s: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """events + hit_no, allowed, retry_after_ms (till the window ends). Denied hits count; equal times are taken in the order of all columns.

    Keys are hash-partitioned and sorted by Spark, and a task streams over its rows; keys of more than hot_rows rows are spread over tasks.
    Null keys are not limited and left out.
    """
    names = events.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", hit_no int, allowed boolean, retry_after_ms long"
    df = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_s", F.unix_micros(ts))
    rest = [c for c in names if c not in (key, ts)]
    cold, hot = _split(df, key, hot_rows)
    out = cold.repartition(key).sortWithinPartitions(key, "_s", *rest).mapInPandas(_fold(key, limit, window_s), schema)
    if hot is None:
        return out
    window = round(window_s * 1_000_000)

    def outputs(t: np.ndarray, n: chains.Numbered) -> dict:
        return {"hit_no": (n.hits_before + 1).astype(np.int32), "allowed": n.hits_before < limit, "retry_after_ms": (np.where(n.hits_before > 0, n.opened, t) + window - t) // 1000}

    return out.unionByName(chains.replay(hot, key, "_s", None, rest, limit, window, outputs, schema))


def login_key(ip, email):
    """Who a login failure counts for."""
    return F.substring(F.sha2(F.concat_ws("\0", ip, F.lower(F.trim(email))), 256), 1, 24)


def login_lock_replay(attempts: DataFrame, key: str = "key", ts: str = "ts", success: str = "success", limit: int = 5, window_s: float = 900, hot_rows: int = HOT_ROWS) -> DataFrame:
    """attempts + failures (in the window, before this attempt), blocked. Blocked attempts aren't recorded; a success that isn't blocked resets.

    Keys are folded as in rate_limit_replay, those of more than hot_rows rows spread over tasks.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in attempts.schema) + ", failures int, blocked boolean"
    window = round(window_s * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, opened, n = object(), 0, 0
        for pdf in batches:
            before, blocked = [], []
            for k, t, ok in zip(pdf[key], pdf["_s"], pdf[success], strict=True):
                if k != last or (n and t >= opened + window):
                    last, n = k, 0
                before.append(n)
                blocked.append(n >= limit)
                if n >= limit:
                    continue
                if ok:
                    n = 0
                else:
                    opened, n = (t if not n else opened), n + 1
            yield pdf.drop(columns="_s").assign(failures=pd.array(before, "int32"), blocked=blocked)

    rest = [c for c in attempts.columns if c not in (key, ts)]
    df = attempts.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_s", F.unix_micros(ts))
    cold, hot = _split(df, key, hot_rows)
    out = cold.repartition(key).sortWithinPartitions(key, "_s", *rest).mapInPandas(run, schema)
    if hot is None:
        return out

    def outputs(t: np.ndarray, n: chains.Numbered) -> dict:
        failures = np.minimum(n.hits_before, limit).astype(np.int32)
        return {"failures": failures, "blocked": failures >= limit}

    return out.unionByName(chains.replay(hot, key, "_s", success, rest, limit, window, outputs, schema))


def denied_keys(events: DataFrame, key: str, limit: int) -> DataFrame:
    """(key) with more than `limit` hits in all: only these can ever be denied."""
    return events.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(key)


def limited(events: DataFrame, path_col: str) -> DataFrame:
    """Events that limits apply to: not those of health and metrics paths."""
    return events.filter(~F.col(path_col).isin(*EXEMPT_PATHS))
