"""Dense top-k over vectors of eight bits, with an error bound, and exact values for what may still be among the first.

An index row holds a unit vector as a step and whole numbers from -127 to 127, and the length of what rounding took away.
The product of two such vectors is exact in whole numbers; what both lost bounds how far the true similarity lies
from it.  Each task keeps the k-th best lower bound of a query and gives the chunks whose upper bound reaches it;
the k-th best of all tasks cuts these once more, and only what is left is compared by its own numbers.
The rows are those of retrieval.dense_topk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, ByteType, StructType

from ..sources.checkpoints import checkpointed
from .retrieval import QUERY_BLOCK, _unit, dense_topk, ranked

#: Of equal vectors in a knowledge base the index keeps so many, the first by id: more can't be in a result of so many rows.
COPIES = 100
#: Whole-number products of so many dimensions are exact in single precision: 1040 * 127 * 127 < 2 ** 24.
SINGLE = 1040
#: Chunk vectors that are compared at a time.
ROWS = 4096
#: Added to each bound for the rounding of double precision.
SLACK = 1e-9


def _codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as whole numbers, steps, and the lengths of the rounding errors."""
    step = np.abs(v).max(axis=1, initial=0.0) / 127
    whole = np.rint(v / np.where(step > 0, step, 1.0)[:, None])
    return whole.astype(np.int8), step, np.linalg.norm(v - whole * step[:, None], axis=1)


def _finite(c: str):
    return F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def quantised(chunks: DataFrame, copies: int = COPIES) -> DataFrame:
    """chunks (chunk_id, knowledge_base_id, embedding) -> the index: (chunk_id, knowledge_base_id, code array<tinyint>, step, error).

    Vectors that are null or hold null or non-finite entries are left out. Searches of k <= copies rows are exact: equal vectors are
    equally similar and ties go by id, so of a group of them only the first `copies` stay (cut before the shuffle too, so a large group of copies
    stays small). Vectors of a knowledge base have one length. Worth writing: a row takes a quarter of its floats.
    """
    whole = chunks.filter(_finite("embedding")).select("chunk_id", "knowledge_base_id", "embedding")
    # 128 bits stand for the vector, which would travel twice as a key
    alike = Window.partitionBy("knowledge_base_id", "_same", "_also").orderBy("chunk_id")
    whole = whole.withColumns({"_same": F.xxhash64("embedding"), "_also": F.xxhash64(F.lit(1), "embedding")}).withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= copies).drop("_n", "_same", "_also")
    schema = StructType([whole.schema["chunk_id"], whole.schema["knowledge_base_id"]]).add("code", ArrayType(ByteType())).add("step", "double").add("error", "double")
    arrow = to_arrow_schema(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("embedding")
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            code, step, error = np.empty(len(flat), np.int8), np.empty(b.num_rows), np.empty(b.num_rows)
            at = np.concatenate(([0], np.cumsum(sizes)))
            for d in np.unique(sizes):  # one length, but for knowledge bases that differ
                rows = np.flatnonzero(sizes == d)
                where = at[rows][:, None] + np.arange(d)
                v = flat[where]
                whole_numbers, step[rows], error[rows] = _codes(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300))
                code[where] = whole_numbers
            codes = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(code))
            parts = [b.column("chunk_id"), b.column("knowledge_base_id"), codes, pa.array(step), pa.array(error)]
            yield pa.RecordBatch.from_arrays([p.cast(f.type) for p, f in zip(parts, arrow)], schema=arrow)

    return whole.mapInArrow(encode, schema)


class _Asked:
    """The queries of a knowledge base, as they are and in eight bits."""

    def __init__(self, rows: list):
        self.ids = [r.query_id for r in rows]
        self.unit = _unit([r.embedding for r in rows])
        code, self.step, self.error = _codes(self.unit)
        self.code = code.astype(np.float32 if code.shape[1] <= SINGLE else np.float64)

    def bounds(self, code: np.ndarray, step: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of the coded vectors, and how far similarities may lie from them.

        q.x - q'.x' = q.(x - x') + (q - q').x', and no |q| is above 1 nor |x'| above 1 + error.
        """
        near = (self.code @ code.astype(self.code.dtype).T).astype(np.float64) * self.step[:, None] * step
        return near, error + self.error[:, None] * (1 + error) + SLACK


def _asked(queries: DataFrame, block: int) -> list:
    return queries.filter(_finite("embedding")).select("query_id", "knowledge_base_id", "embedding").limit(block + 1).collect()


def candidates(asked: list, index: DataFrame, query_id: str, k: int, digits: int) -> DataFrame:
    """(query_id, knowledge_base_id, chunk_id) of all pairs that may be among a query's first k, by quantised() rows and the collected queries.

    Nothing is dropped that could round to a tie with the k-th: `digits` decides how much room that needs.
    """
    groups: dict = {}
    for r in asked:
        groups.setdefault(r.knowledge_base_id, []).append(r)
    sent = index.sparkSession.sparkContext.broadcast({kb: _Asked(rows) for kb, rows in groups.items()})
    room = 10.0**-digits
    kinds = dict(index.dtypes)

    def first_pass(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lowest: dict = {}  # knowledge base -> the k best lower bounds of each query so far
        for pdf in pdfs:
            for kb, whole in pdf.groupby("knowledge_base_id"):
                q = sent.value.get(kb)
                for a in range(0, len(whole) if q is not None else 0, ROWS):
                    part = whole.iloc[a : a + ROWS]
                    near, off = q.bounds(np.stack(part["code"].to_numpy()), part["step"].to_numpy(), part["error"].to_numpy())
                    low = near - off
                    both = np.concatenate((lowest.get(kb, np.full((len(q.ids), k), -np.inf)), low), axis=1)
                    lowest[kb] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                    i, j = np.nonzero(near + off >= lowest[kb].min(axis=1)[:, None] - room)
                    yield pd.DataFrame({"query_id": [q.ids[x] for x in i], "knowledge_base_id": kb, "chunk_id": part["chunk_id"].to_numpy()[j], "low": low[i, j], "high": (near + off)[i, j]})

    schema = f"query_id {query_id}, knowledge_base_id {kinds['knowledge_base_id']}, chunk_id {kinds['chunk_id']}, low double, high double"
    found = checkpointed(index.filter(F.col("knowledge_base_id").isin(list(groups))).mapInPandas(first_pass, schema))
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))).filter(F.col("_n") <= k)
    # a row for each query, of which there are a block at most; fewer than k chunks cut nothing
    bound = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("low")).otherwise(float("-inf")).alias("bound"))
    kept = found.join(F.broadcast(bound), "query_id").filter(F.col("high") >= F.col("bound") - room)
    return kept.select("query_id", "knowledge_base_id", "chunk_id")


def pruned_dense_topk(queries: DataFrame, chunks: DataFrame, k: int, index: DataFrame | None = None, copies: int = COPIES, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """dense_topk's rows (query_id, chunk_id, similarity, rank) by a first pass over quantised(chunks, copies).

    index: that table where it was written before. Needs query ids that are set and differ, and ids that name one vector in their knowledge base. Rows of chunks that are no
    candidate of any query are read for their id alone. More than `block` queries go by dense_topk, as far as vectors are finite.
    """
    if k > copies:
        raise ValueError(f"the index is exact for at most {copies} rows a query")
    asked = _asked(queries, block)
    usable = chunks.filter(_finite("embedding"))
    if len(asked) > block:
        return dense_topk(queries.filter(_finite("embedding")), usable, k, digits, block)
    kinds = dict(queries.dtypes), dict(chunks.dtypes)
    pairs = candidates(asked, index if index is not None else quantised(chunks, copies), kinds[0]["query_id"], k, digits)
    wanted = pairs.groupBy("knowledge_base_id", "chunk_id").agg(F.collect_set("query_id").alias("queries"))  # a block of ids at most
    rows = usable.select("chunk_id", "knowledge_base_id", "embedding").join(wanted, ["knowledge_base_id", "chunk_id"])
    sent = queries.sparkSession.sparkContext.broadcast(dict(zip([r.query_id for r in asked], _unit([r.embedding for r in asked])))) if asked else None

    def exact(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                n = np.array([len(q) for q in pdf["queries"]])
                row, ids = np.repeat(np.arange(len(pdf)), n), np.concatenate([list(q) for q in pdf["queries"]])
                x = _unit(pdf["embedding"])
                sims = np.concatenate([np.einsum("ij,ij->i", x[row[a : a + ROWS]], np.array([sent.value[q] for q in ids[a : a + ROWS]])) for a in range(0, len(ids), ROWS)])
                yield pd.DataFrame({"query_id": ids, "chunk_id": pdf["chunk_id"].to_numpy()[row], "similarity": np.round(sims, digits)})

    scored = rows.mapInPandas(exact, f"query_id {kinds[0]['query_id']}, chunk_id {kinds[1]['chunk_id']}, similarity double")
    return ranked(scored, "dense").filter(F.col("rank") <= k)
