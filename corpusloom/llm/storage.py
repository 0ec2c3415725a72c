"""Intermediate tables in the folder that all executors share, and joins that mind sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows of a few numbers each (under 100 MB) may be broadcast.
BROADCAST_ROWS = 2_000_000
#: Stands for a null id inside operators; it sorts before all others.
NO_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a new local folder is set in local mode (tests), and a cluster is an error. Tables stay there for its owner to clear."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows (of a few numbers)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in fewer partitions where `rows` (an upper bound) are too few for all of them."""
    return df.coalesce(max(8, rows // 200_000)) if rows <= 50_000_000 else df


def restrict(df: DataFrame, keys: DataFrame, on: str, rows: int) -> DataFrame:
    """Rows of df whose `on` is in keys (unique, `rows` many): by broadcast while that is small, else by a shuffle join."""
    return df.join(small(keys, rows), on, "left_semi")


def exclude(df: DataFrame, keys: DataFrame, on, rows: int) -> DataFrame:
    """Rows of df without a partner in keys (`rows` many); broadcast as in restrict()."""
    return df.join(small(keys, rows), on, "left_anti")


def with_marks(df: DataFrame, marks: DataFrame, on: str, rows: int) -> DataFrame:
    """df left-joined with marks (unique by `on`, `rows` many).

    While the keys are few enough for a checked broadcast, only the rows they select are shuffled;
    the rest passes by with null marks.  Beyond that size all rows take one shuffle join.
    """
    if rows > BROADCAST_ROWS:
        return df.join(marks, on, "left")
    keys = F.broadcast(marks.select(on))
    rest = df.join(keys, on, "left_anti")
    for field in marks.schema:
        if field.name != on:
            rest = rest.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.join(keys, on, "left_semi").join(marks, on, "left").unionByName(rest)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text): ids as long with NO_ID for null."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.col(text_col).cast("string").alias("text"))


def unkeyed(col: str = "key"):
    return F.when(F.col(col) != NO_ID, F.col(col))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
