"""What a stream remembers besides its checkpoint: which batch claimed which job, and which deletes wait for another try."""

from __future__ import annotations

import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import SnapshotTable

#: A failed delete is tried so many times, each time after twice the wait.
MAX_ATTEMPTS, FIRST_WAIT_S = 5, 30
RETRIES = "message_key string, type string, document_id string, knowledge_base_id string, owner_id string, attempts int, next_at timestamp, state string, error_code string"


class ClaimLedger:
    """Claims (job_id, document_id, index_version, attempt) by the batch that made them, written before anything is done about them.

    A batch that runs again takes up the claims that it wrote; no other batch gets a job's attempt that one has. A job
    that goes back to pending with its attempts counted can be claimed again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.table = SnapshotTable(spark, path, ["job_id", "index_version"])

    def take(self, claims: DataFrame, writer: str, batch: int) -> DataFrame:
        """The claims of this batch: those it has, or else those of `claims` that no batch has, which become its own."""
        if not self.table.done(writer, batch):
            fresh, held = claims.dropDuplicates(["job_id", "index_version"]), self.table.read()
            if held is not None:
                held = held.select("job_id", "index_version", F.col("attempt").alias("had"))
                fresh = fresh.join(held, ["job_id", "index_version"], "left").filter("had is null or attempt > had").drop("had")
            self.table.replace(fresh.select("job_id", "document_id", "index_version", "attempt", F.lit(writer).alias("writer"), F.lit(batch).cast("long").alias("batch")), writer=writer, batch=batch)
        return self.table.read().filter((F.col("writer") == writer) & (F.col("batch") == batch)).drop("writer", "batch")

    def forget(self, jobs: DataFrame) -> None:
        """Drops the claims of jobs (id, index_version) that can't be asked for again, so that the ledger keeps the size of what is open."""
        self.table.replace(None, jobs.select(F.col("id").alias("job_id"), "index_version"))


def is_transient(error: BaseException) -> bool:
    """Whether another try may end otherwise: what comes from files, sockets and time, but not what is wrong with plans, types or values."""
    if isinstance(error, Py4JJavaError):
        cause, names = error.java_exception, []
        while cause is not None:
            names.append(cause.getClass().getName())
            cause = cause.getCause()
        return any(n.startswith("java.net.") or n.endswith(("IOException", "TimeoutException", "SparkOutOfMemoryError")) for n in names)
    if isinstance(error, (AnalysisException, PySparkException)):
        return False
    return isinstance(error, (ConnectionError, TimeoutError, OSError))


def with_message_key(messages: DataFrame) -> DataFrame:
    return messages.withColumn("message_key", F.sha2(F.concat_ws("\0", *(F.coalesce(c, F.lit("")) for c in ("type", "owner_id", "document_id", "knowledge_base_id"))), 256))


class RetryTable:
    """Delete messages that failed, one row each: attempts, when the next is due, and whether it waits or is dead (given up)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, SnapshotTable(spark, path, ["message_key"])

    def read(self) -> DataFrame:
        rows = self.table.read()
        return self.spark.createDataFrame([], RETRIES) if rows is None else rows

    def due(self, now: datetime.datetime) -> DataFrame:
        return self.read().filter((F.col("state") == "waiting") & (F.col("next_at") <= F.lit(now)))

    def settle(self, tried: DataFrame, failed: DataFrame, now: datetime.datetime, writer: str, batch: int) -> None:
        """After a batch: of the tried messages those in failed (message_key, error_code, transient) wait for another try or are dead, the others are gone."""
        had = self.read().select("message_key", F.col("attempts").alias("had"))
        attempts = F.coalesce("had", F.lit(0)) + 1
        alive = F.col("transient") & (attempts < MAX_ATTEMPTS)
        wait = F.make_dt_interval(secs=(FIRST_WAIT_S * F.pow(F.lit(2.0), attempts - 1)).cast("decimal(18,6)"))
        rows = tried.join(failed, "message_key").join(had, "message_key", "left")
        rows = rows.select("message_key", "type", "document_id", "knowledge_base_id", "owner_id", attempts.cast("int").alias("attempts"), (F.lit(now) + wait).alias("next_at"), F.when(alive, "waiting").otherwise("dead").alias("state"), "error_code")
        self.table.replace(rows, tried.select("message_key"), writer, batch)
