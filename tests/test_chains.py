"""Limits of hot keys, spread over tasks, against a fold of each key in one task."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chains, limits

START = datetime.datetime(2024, 1, 1)


def events(spark, seed, n=3000, keys=3, step=7, ok=0.2):
    rng, t = random.Random(seed), 0
    rows = []
    for i in range(n):
        t += rng.choice([0, 0, 1, step, step, 3 * step]) + (2000 if rng.random() < 0.002 else 0)
        rows.append((i, "hot" if rng.random() < 0.9 else f"k{rng.randrange(keys)}", START + datetime.timedelta(seconds=t), rng.random() < ok))
    return spark.createDataFrame(rows, "id long, key string, ts timestamp, success boolean").repartition(5)


@pytest.fixture
def many_blocks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def same(a, b):
    a, b = (sorted(tuple(r) for r in x.collect()) for x in (a, b))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert x == y


@pytest.mark.parametrize("window", [1, 60, 900, 100_000])
def test_rate_limits_of_a_hot_key(spark, many_blocks, window):
    e = events(spark, window)
    same(limits.rate_limit_replay(e, "key", "ts", 3, window, hot_rows=500), limits.rate_limit_replay(e, "key", "ts", 3, window))


@pytest.mark.parametrize("window,limit,ok", [(60, 3, 0.3), (900, 5, 0.05), (5000, 2, 0.5), (100_000, 4, 0.01), (10, 1, 0.5), (900, 5, 0.0), (900, 5, 1.0), (900, 50, 0.02)])
def test_login_locks_of_a_hot_key(spark, many_blocks, window, limit, ok):
    e = events(spark, window + limit, n=1500, ok=ok)
    same(limits.login_lock_replay(e, limit=limit, window_s=window, hot_rows=300), limits.login_lock_replay(e, limit=limit, window_s=window))


def test_a_hot_key_takes_many_tasks(spark, many_blocks):
    e = events(spark, 1).filter("key = 'hot'")
    placed = chains.spread(e.withColumns({"_k": F.col("key"), "_t": F.unix_micros("ts"), "_ok": F.lit(False)}), "_k", ["_t", "id"])
    sizes = [r[1] for r in placed.groupBy("_pid").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 0.3 * sum(sizes)


def test_no_rows_and_null_keys(spark):
    e = events(spark, 2, n=20)
    assert limits.rate_limit_replay(e.limit(0), "key", "ts", 3, 60, hot_rows=0).collect() == []
    assert limits.login_lock_replay(e.withColumn("key", F.lit(None).cast("string")), hot_rows=0).collect() == []
