"""Keyed tables that change from one whole state to the next.

A table is a folder of data files that are never changed, of manifests that say
which files make a state, and of pointers, one small file a version, that name a manifest.  A write makes
its data files first, then a manifest, then the pointer; the pointer appears under its name by one rename that fails if
the version is taken, so readers see the state before or after, and of two writers one has to start again from
the other's state.  Files of a write that ended before its pointer belong to no state; vacuum() removes them.

Rows are dealt into buckets by bits of a hash of the key (extendible hashing): a bucket over
`bucket_rows` rows is split, alone, by as many further bits as it needs.  A write reads and
rewrites the buckets of its keys and nothing else, so its bytes grow with the batch and not with the table.

A write may name its writer and batch number: the state then remembers them, and a batch that runs again after its
pointer was made changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_ROWS = 20_000
#: Manifest rows (a few hundred bytes) of which so many may be broadcast.
BROADCAST_BUCKETS = 200_000
#: How often a write starts again when others came first.
ATTEMPTS = 20
_MANIFEST = "depth int, bits long, file string, rows long"
#: Names of the columns that a data file has besides the table's.
_DEPTH, _BITS = "snapshot_depth", "snapshot_bits"


class Conflict(RuntimeError):
    """Another writer took the version."""


class SnapshotTable:
    """A table of rows with a key; `keys` are the columns that a replacement goes by, `bucket_key` the one of them that is hashed."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bucket_key: str | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.keys, self.bucket_key, self.bucket_rows = spark, path.rstrip("/"), keys, bucket_key or keys[0], bucket_rows

    # files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        there = self._path(folder)
        return [f.getPath().getName() for f in self._fs().listStatus(there)] if self._fs().exists(there) else []

    def _read_text(self, *parts: str) -> str:
        stream = self._fs().open(self._path(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, version: int, state: dict) -> None:
        """Makes the pointer of a version, or raises Conflict."""
        aside = f"{uuid.uuid4().hex}.tmp"
        stream = self._fs().create(self._path("pointers", aside))
        try:
            stream.write(json.dumps(state).encode())
        finally:
            stream.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._path("pointers", aside), self._path("pointers", f"{version:012d}"), no_options)
        except Py4JJavaError as e:
            self._fs().delete(self._path("pointers", aside), False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} of {self.path} is taken") from e
            raise

    # states

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("pointers") if n.isdigit())

    def state(self, version: int | None = None) -> dict | None:
        """The newest state, or the one of a version: version, manifest, schema (DDL as JSON), rows, writers."""
        if version is None:
            there = self.versions()
            if not there:
                return None
            version = there[-1]
        return json.loads(self._read_text("pointers", f"{version:012d}")) | {"version": version}

    def _manifest(self, state: dict) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/{state['manifest']}")

    def _schema(self, state: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(state["schema"]))

    def _rows(self, state: dict, manifest: DataFrame) -> DataFrame:
        """The rows of the files that a manifest names."""
        files = [f"{self.path}/{r.file}" for r in manifest.filter("file is not null").select("file").collect()]  # paths of files, as the scan itself holds them
        schema = self._schema(state)
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of the newest state (or of a version that is still kept); None where nothing was written yet."""
        state = self.state(version)
        return None if state is None else self._rows(state, self._manifest(state))

    def done(self, writer: str, batch: int) -> bool:
        """Whether the state has this batch of this writer."""
        state = self.state()
        return state is not None and state["writers"].get(writer, -1) >= batch

    # writes

    def _hash(self) -> Column:
        return F.xxhash64(F.col(self.bucket_key).cast("string"))

    def _in_bucket(self, df: DataFrame, manifest: DataFrame | None) -> DataFrame:
        """df + depth and bits of the bucket that its key belongs to; depth 0 where there is no table yet."""
        if manifest is None:
            return df.withColumns({_DEPTH: F.lit(0), _BITS: F.lit(0).cast("long")})
        buckets = manifest.select("depth", "bits").distinct()
        depths = sorted(r.depth for r in buckets.select("depth").distinct().collect())  # at most 63
        own = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), self._hash().bitwiseAND(F.lit((1 << d) - 1)).alias("bits")) for d in depths)))
        few = buckets.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS
        buckets = buckets.select(F.col("depth").alias(_DEPTH), F.col("bits").alias(_BITS))
        spread = df.withColumn("__b", own).withColumns({_DEPTH: F.col("__b.depth"), _BITS: F.col("__b.bits")}).drop("__b")
        return spread.join(F.broadcast(buckets) if few else buckets, [_DEPTH, _BITS], "left_semi")

    def replace(self, rows: DataFrame | None, gone: DataFrame | None = None, writer: str | None = None, batch: int | None = None) -> bool:
        """Puts `rows` in place of all rows with one of their keys, and removes those with a key of `gone` (whose columns are some or all of the key columns, the hashed one among them).

        False if this batch of this writer was written before.
        """
        return self._write(lambda _: (rows, gone), writer, batch)

    def update(self, rows: DataFrame, merge: Callable[[DataFrame | None], DataFrame], writer: str | None = None, batch: int | None = None) -> bool:
        """As replace() by merge(old), old being the present rows of the buckets of `rows` (None at first); merge returns the new rows of the keys of `rows`."""
        return self._write(lambda old: (merge(old), None), writer, batch, rows)

    def _write(self, make, writer: str | None, batch: int | None, asked: DataFrame | None = None) -> bool:
        for _ in range(ATTEMPTS):
            state = self.state()
            if writer is not None and state is not None and state["writers"].get(writer, -1) >= batch:
                return False
            try:
                self._commit(state, make, asked, {} if writer is None else {writer: batch})
                return True
            except Conflict:
                continue
        raise Conflict(f"{self.path}: others came first {ATTEMPTS} times")

    def _commit(self, state: dict | None, make, asked: DataFrame | None, writers: dict) -> None:
        run = uuid.uuid4().hex
        manifest = None if state is None else self._manifest(state)

        def settled(df: DataFrame, name: str) -> DataFrame:
            """df computed once, in a folder of this run, so that it stays what it was while the table changes."""
            df.write.parquet(f"{self.path}/aside/{run}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{self.path}/aside/{run}/{name}")

        rows, gone = (asked, None) if asked is not None else make(None)
        out = [settled(self._in_bucket(df.select(*(c for c in self.keys if c in df.columns)).distinct(), manifest), name) for name, df in (("rows", rows), ("gone", gone)) if df is not None]
        touched = out[0].select(_DEPTH, _BITS)
        for keys in out[1:]:
            touched = touched.union(keys.select(_DEPTH, _BITS))
        if manifest is None:  # the first bucket holds all keys, also where there are no rows yet
            touched = touched.union(self.spark.createDataFrame([(0, 0)], f"{_DEPTH} int, {_BITS} long"))
        touched = settled(touched.distinct(), "touched")
        many = touched.count()
        in_touched = (F.col("depth") == F.col(_DEPTH)) & (F.col("bits") == F.col(_BITS))
        mark = F.broadcast(touched) if many <= BROADCAST_BUCKETS else touched
        left = old = None if state is None else self._rows(state, manifest.join(mark, in_touched, "left_semi"))
        for keys in out if old is not None else []:
            left = left.join(keys.drop(_DEPTH, _BITS), [c for c in self.keys if c in keys.columns], "left_anti")
        if asked is not None:
            rows, _ = make(old)
        if left is None and rows is None:
            return  # nothing to remove from
        both = left if rows is None else rows if left is None else left.unionByName(rows, allowMissingColumns=True)
        schema = both.schema
        both = settled(self._in_bucket(both, manifest), "new")
        made, children = self._dealt(both, touched, run)
        if manifest is not None:
            children = manifest.join(mark, in_touched, "left_anti").unionByName(children)
        name = f"manifests/{run}"
        children.write.parquet(f"{self.path}/{name}")
        known = {} if state is None else state["writers"]
        self._put(0 if state is None else state["version"] + 1, {"manifest": name, "schema": schema.json(), "writers": known | writers, "rows_written": made})
        self._fs().delete(self._path("aside", run), True)

    def _dealt(self, both: DataFrame, touched: DataFrame, run: str) -> tuple[int, DataFrame]:
        """Writes the rows of the touched buckets, splitting those that are full; (rows, manifest of the buckets that come in their place)."""
        sizes = both.groupBy(_DEPTH, _BITS, self.bucket_key).agg(F.count("*").alias("n")).groupBy(_DEPTH, _BITS).agg(F.sum("n").alias("n"), F.count("*").alias("own"))
        # a key is never split by its own hash, so more bits than keys have are of no use
        more = F.ceil(F.log2(F.least(F.col("n") / self.bucket_rows, F.col("own")))).cast("int")
        full = sizes.filter((F.col("n") > self.bucket_rows) & (F.col("own") > 1)).select(_DEPTH, _BITS, F.least(F.greatest(more, F.lit(1)), 62 - F.col(_DEPTH)).alias("more"))
        places = touched.join(full, [_DEPTH, _BITS], "left").withColumn("more", F.coalesce("more", F.lit(0)))
        few = places.count() <= BROADCAST_BUCKETS
        deeper = both.join(F.broadcast(places) if few else places, [_DEPTH, _BITS]).withColumn(_DEPTH, F.col(_DEPTH) + F.col("more")).drop("more")
        deeper = deeper.withColumn(_BITS, self._hash().bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(_DEPTH)) - 1))
        # rows of a key with more than a bucket's are dealt over several files, by what tells them apart
        plain = [c for c in both.columns if both.schema[c].dataType.typeName() in ("string", "integer", "long", "double", "timestamp")]
        dealt = deeper.repartition(_DEPTH, _BITS, F.pmod(F.xxhash64(*plain), F.when(F.lit(len(self.keys) > 1), F.lit(4)).otherwise(1)))
        dealt.write.option("maxRecordsPerFile", 4 * self.bucket_rows).partitionBy(_DEPTH, _BITS).parquet(f"{self.path}/data/{run}")
        files = self.spark.read.schema(deeper.schema).parquet(f"{self.path}/data/{run}").select(_DEPTH, _BITS, F.regexp_extract("_metadata.file_path", f"(data/{run}/.*)$", 1).alias("file"))
        files = files.groupBy(_DEPTH, _BITS, "file").agg(F.count("*").alias("rows"))
        # a bucket without rows stays a place of the table, without a file
        child = F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("more")) - 1))
        places = places.select(F.col(_DEPTH).alias("d"), F.col(_BITS).alias("b"), "more", child.alias("i"))
        places = places.select((F.col("d") + F.col("more")).alias(_DEPTH), F.col("b").bitwiseOR(F.call_function("shiftleft", F.col("i"), F.col("d"))).alias(_BITS))
        manifest = places.join(files, [_DEPTH, _BITS], "left").select(F.col(_DEPTH).cast("int").alias("depth"), F.col(_BITS).alias("bits"), "file", F.coalesce("rows", F.lit(0)).alias("rows"))
        return both.count(), manifest

    def vacuum(self, versions: int = 2) -> int:
        """Removes the files that the newest `versions` states don't name, and those of writes that never came to an end; the number of folders gone.

        Not beside a running write, whose files no state names yet.
        """
        there = self.versions()
        for old in there[:-versions]:
            self._fs().delete(self._path("pointers", f"{old:012d}"), False)
        manifests, runs = set(), set()
        for version in there[-versions:]:
            state = self.state(version)
            manifests.add(state["manifest"].split("/")[1])
            runs |= {r.run for r in self._manifest(state).select(F.regexp_extract("file", "data/([0-9a-f]+)/", 1).alias("run")).distinct().collect()}  # one for each write that left files
        gone = [("manifests", n) for n in self._names("manifests") if n not in manifests] + [("data", n) for n in self._names("data") if n not in runs] + [("aside", n) for n in self._names("aside")]
        for folder, name in gone:
            self._fs().delete(self._path(folder, name), True)
        return len(gone)
