"""Places in an order, without one task that holds all rows: row numbers of a whole table, and exact ranks of groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import checkpointed

#: Bins of a pass; groups whose intervals may be broadcast.
BINS, BROADCAST_GROUPS = 4096, 100_000


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df + its row numbers from 1 in an order (columns or their names): sorted by ranges, a count of each range, and places within them."""
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    placed = placed.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes, begin, rows = placed.groupBy("_part").count().collect(), 0, []  # one for each partition
    for r in sorted(sizes, key=lambda r: r["_part"]):
        rows.append((r["_part"], begin))
        begin += r["count"]
    starts = df.sparkSession.createDataFrame(rows, "_part int, _begin long")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_begin") + F.col("_at") + 1).drop("_part", "_at", "_begin")


def nearest_ranks(df: DataFrame, by: list[str], columns: list[str], p: float) -> DataFrame:
    """by + columns: of each group the value at place ceil(p * n) of each column's n sorted numbers (null where n is 0), exactly, as doubles.

    An interval that holds the place is narrowed to one of its BINS bins in each pass, by their counts; its ends are values that
    occur, so it ends as one value. A group takes BINS rows at most, whatever its size and values, and each pass is a
    partial aggregation. NaN counts as the largest number.
    """
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))] + ["_c"]
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns))))
    flat = df.select(*keys, pairs.alias("_p")).select(*names[:-1], F.col("_p.c").alias("_c"), F.col("_p.v").alias("_v"))
    some = flat.filter("_v is not null")
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in names))
    top = some.groupBy(*names).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    at = checkpointed(top.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("n") * p))).drop("n"))
    while True:
        open_ = at.filter("low < high")
        groups = open_.count()
        if not groups:
            break
        mark = F.broadcast(open_) if groups <= BROADCAST_GROUPS else open_
        inside = some.alias("s").join(mark.alias("o"), same(some, open_)).filter("_v between low and high")
        # of an interval beyond all numbers its upper end has a bin of its own
        share = F.when(F.col("_v") >= F.col("high"), F.lit(BINS - 1)).otherwise(F.least(F.lit(BINS - 1), F.floor(F.coalesce(F.try_divide(F.col("_v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2), F.lit(0.0)) * (BINS - 1))))
        share = F.when(F.col("_v") <= F.col("low"), F.lit(0)).otherwise(share)
        counted = inside.select(*(F.col(f"s.{c}").alias(c) for c in names), "rank", "_v", share.cast("int").alias("bin")).groupBy(*names, "rank", "bin").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        bins = counted.groupBy(*names, "rank").agg(F.sort_array(F.collect_list(F.struct("bin", "n", "low", "high"))).alias("bins"))  # BINS at most
        run = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("rank")),
            lambda s, b: F.when(s["low"].isNotNull(), s).when(s["before"] + b["n"] >= F.col("rank"), F.struct(s["before"].alias("before"), b["low"].alias("low"), b["high"].alias("high"), (F.col("rank") - s["before"]).alias("rank"))).otherwise(F.struct((s["before"] + b["n"]).alias("before"), s["low"].alias("low"), s["high"].alias("high"), s["rank"].alias("rank"))),
        )
        closer = bins.select(*names, run.alias("r")).select(*names, "r.low", "r.high", "r.rank")
        at = checkpointed(at.filter("low = high").unionByName(closer.select(at.columns)))
    groups = flat.select(names[:-1]).distinct()
    value = lambda i: F.max(F.when(F.col("_c") == i, F.col("low")))
    wide = at.groupBy(*names[:-1]).agg(*(value(i).alias(c) for i, c in enumerate(columns))) if by else at.agg(*(value(i).alias(c) for i, c in enumerate(columns)))
    if not by:
        return wide
    on = reduce(lambda x, y: x & y, (groups[c].eqNullSafe(wide[c]) for c in names[:-1]))
    return groups.join(wide, on, "left").select(*(groups[f"_g{i}"].alias(c) for i, c in enumerate(by)), *columns)

