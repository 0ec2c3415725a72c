"""Questions, raw files, queue messages, the chunk index and the usage log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import validate_messages
from ..schemas import ANSWER_QUESTIONS, QUESTIONS, QUEUE_MESSAGE
from .snapshots import SnapshotTable


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval questions, JSON lines; see operators.evaluation.question_errors for the checks."""
    return spark.read.schema(QUESTIONS).json(path)


def load_answer_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWER_QUESTIONS).json(path).withColumn("unanswerable", F.coalesce("unanswerable", F.lit(False)))


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, filename, length, content) of the files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")


def read_messages(df: DataFrame, column: str = "value") -> DataFrame:
    """Queue messages of a batch or stream of JSON strings, + error_code (INVALID_MESSAGE for what isn't one)."""
    return validate_messages(df.select(F.from_json(F.col(column).cast("string"), QUEUE_MESSAGE).alias("m")).select("m.*"))


def chunk_table(spark: SparkSession, path: str) -> SnapshotTable:
    """The chunk index at a path: replaced by (document_id, index_version), a whole state at a time."""
    return SnapshotTable(spark, path, ["document_id", "index_version"])


def read_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """The chunks of the newest state, None where none were written; a write that goes on meanwhile isn't seen."""
    return chunk_table(spark, path).read()


def write_chunks(chunks: DataFrame, path: str, writer: str | None = None, batch: int | None = None) -> bool:
    """Replaces the chunks of every (document_id, index_version) in `chunks` at once; writing the same twice changes nothing.

    Only the buckets of these documents are rewritten. False if this batch of this writer was written before.
    """
    return chunk_table(chunks.sparkSession, path).replace(chunks, writer=writer, batch=batch)


def drop_chunks(documents: DataFrame, path: str, writer: str | None = None, batch: int | None = None) -> bool:
    """Removes the chunks of documents (document_id), all versions; a second run changes nothing."""
    return chunk_table(documents.sparkSession, path).replace(None, documents.select("document_id"), writer, batch)


def append_usage(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """Appends to the usage log, one folder a day."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)
