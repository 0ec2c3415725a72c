"""Rows that are computed once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The session's checkpoint folder (spark.checkpoint.dir; where that is unset, a new local one in local mode, as in tests, and an error on a cluster)."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the session's checkpoint folder, as rows of the memory's format: for small tables."""
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """df computed once and kept in the session's checkpoint folder as Parquet, of which later steps read their columns alone. It stays for the folder's owner to clear."""
    path = f"{_folder(df)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
