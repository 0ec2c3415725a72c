"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

An entry c becomes the whole number floor(256 * c).  The fit list holds each
distinct vector once, packed into blocks of rows; its matrix C has a row
x - S / n for each of its n vectors x, S being their sum.  Each step of the bidiagonalisation is one
pass over the blocks: a task makes its part of u = C w (first product), and from it of
z = C'u (second product) and of u.u, d + 2 numbers a task, summed by Spark.

The left vectors are kept as u_i = C w_i by their d coefficients w_i alone, so that full
reorthogonalisation needs no table of them: u_i.u = w_i.z.  Where taking away
what is left of former vectors changes a length by more than rounding, the pass is made
again.  Right vectors are orthogonalised twice.  An exhausted start goes on with a new
direction, so that equal eigenvalues are all found.  The steps end when the last row of the small SVD has
vanished for the wanted components and what no step has captured of the total variance is
less than the least of them, or when the directions are exhausted; at most d steps.

Memory: d x d numbers on the driver, one block in a task.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are left out, as are vectors
shorter than the longest (their other entries are missing); entries beyond +-2**32 (x beyond +-2**40) count
as that; a null id stays null, repeated ids stay; copies of a vector are fitted once and all returned;
components without variance are not returned, so a table with fewer than two different vectors, an empty
one too, gives no rows; deviation is null where it leaves the range of a long.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Steps for each unit of an entry.
SCALE = 256.0
LIMIT = 2**40
#: Vectors of a block; partial sums that the driver adds up, beyond that tasks add them first.
BLOCK_ROWS, GATHERED = 4096, 256
#: A singular value below this share of the largest is nothing but rounding.
ROUNDING = 1e-12
COMPONENTS = 4


def whole_numbers(vector: Column) -> Column:
    """The vector in whole numbers; null where it has no value or an entry without one."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _packed(d: int):
    """(rows, kind, block, sums): blocks of vectors in the narrowest whole numbers that hold them."""

    def pack(x: np.ndarray) -> pa.RecordBatch:
        most = int(np.abs(x).max())
        kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
        return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([kind]), pa.array([x.astype(kind).tobytes()], pa.binary()), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))], names=["rows", "kind", "block", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(_matrix(batch.column("x"), d))
            while sum(map(len, held)) >= BLOCK_ROWS:
                x = np.concatenate(held)
                yield pack(x[:BLOCK_ROWS])
                held = [x[BLOCK_ROWS:]]
        x = np.concatenate(held) if held else np.empty((0, d), np.int64)
        if len(x):
            yield pack(x)

    return run


def _summed(blocks: DataFrame, many: bool, d: int, centre: np.ndarray, width: int, of_block) -> np.ndarray:
    """The sum of of_block(C) over all blocks, an array of `width` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(width), False
        for batch in batches:
            for kind, block in zip(batch.column("kind").to_pylist(), batch.column("block"), strict=True):
                total += of_block(np.frombuffer(block.as_buffer(), kind).reshape(-1, d) - centre)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for v in batch.column("v"):
                total += np.frombuffer(v.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    sums = blocks.select("kind", "block").mapInArrow(run, "v binary")
    if many:  # one row a task
        sums = sums.repartition(GATHERED).mapInArrow(added, "v binary")
    return sum((np.frombuffer(r.v) for r in sums.collect()), np.zeros(width))


def bidiagonalise(product, d: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(singular values, right vectors as columns, sum of squares of C), largest first.

    product(w) gives (C'Cw, |Cw|^2, sum of squares of C) for a direction w.
    """
    rng = np.random.default_rng(seed)
    rights, lefts, images = np.zeros((d, d)), np.zeros((d, d)), np.zeros((d, d))
    small = np.zeros((d, d))

    def orthogonal(r: np.ndarray, k: int) -> np.ndarray:
        for _ in range(2):
            r = r - rights[:k].T @ (rights[:k] @ r)
        return r

    start = rng.standard_normal(d)
    rights[0], beta, total, captured = start / np.linalg.norm(start), 0.0, 0.0, 0.0
    for k in range(d):
        w = rights[k] - (beta * lefts[k - 1] if k else 0)
        for _ in range(3):
            z, uu, total = product(w)
            g = lefts[:k] @ z
            w, z, after = w - g @ lefts[:k], z - g @ images[:k], uu - g @ g
            if after > 0.5 * uu:
                break
        scale = np.sqrt(max(total, 0.0))
        alpha = np.sqrt(max(after, 0.0))
        if alpha > ROUNDING * scale:
            lefts[k], images[k] = w / alpha, z / alpha
        else:
            alpha = 0.0
        small[k, k] = alpha
        captured += alpha**2 + beta**2
        r = orthogonal(images[k] - alpha * rights[k], k + 1)
        beta = np.linalg.norm(r)
        left, sigma, right = np.linalg.svd(small[: k + 1, : k + 1])
        few = min(wanted, k + 1)
        if k + 1 == d or total == 0:
            break
        if k + 1 >= wanted and (beta * np.abs(left[-1, :few]) <= 1e-15 * sigma[0]).all() and (total - captured < 0.5 * sigma[few - 1] ** 2 or total - captured <= d * 1e-15 * total):
            break
        if beta <= ROUNDING * scale:
            beta, r = 0.0, orthogonal(rng.standard_normal(d), k + 1)
        else:
            small[k, k + 1] = beta
        rights[k + 1] = r / np.linalg.norm(r)
    return sigma, rights[: k + 1].T @ right.T, total


class Whitening:
    """What the fit list gives: n, sums S, components as columns, eigenvalues, their share of the trace, and how far the whitened fit list is from uncorrelated."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, explained: np.ndarray, identity_error: float):
        self.n, self.sums, self.vectors, self.values, self.explained, self.identity_error = n, sums, vectors, values, explained, identity_error

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array([s / self.n for s in self.sums])) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list:
        """The exact sums of (n * x - S)^2."""
        most = max([abs(s) for s in self.sums] + [self.n * int(np.abs(x).max(initial=0))])
        if 4 * len(self.sums) * most**2 < 2**63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        out = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [y if y < 2**63 else None for y in out]


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Fits over the distinct x of vectors (x array<long> of length d); None where nothing varies. One Spark job a step."""
    blocks = written(vectors.select("x").distinct().mapInArrow(_packed(d), "rows long, kind string, block binary, sums array<long>"), "vectors")
    n = blocks.agg(F.sum("rows")).first()[0]
    if not n:
        return None
    sums = [0] * d
    for r in blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # d rows
        sums[r.i] = int(r.s)
    centre, many = np.array([s / n for s in sums]), blocks.rdd.getNumPartitions() > GATHERED

    def product(w: np.ndarray):
        def of_block(c: np.ndarray) -> np.ndarray:
            u = c @ w
            return np.concatenate((u @ c, [u @ u, np.vdot(c, c)]))

        out = _summed(blocks, many, d, centre, d + 2, of_block)
        return out[:d], out[d], out[d + 1]

    sigma, right, total = bidiagonalise(product, d, components)
    k = int((sigma[:components] > ROUNDING * max(np.sqrt(total), 1.0)).sum())
    if not k:
        return None
    values, right = sigma[:k] ** 2 / n, right[:, :k]

    def moments(c: np.ndarray) -> np.ndarray:
        y = c @ right / np.sqrt(values)
        return np.concatenate(((y.T @ y).ravel(), y.sum(axis=0)))

    out = _summed(blocks, many, d, centre, k * k + k, moments)
    mean = out[k * k :] / n
    error = np.abs(out[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max()
    return Whitening(n, sums, right, values, values * n / total, float(error))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each remaining vector and component."""
    out_schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = rows.select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col)).alias("x")).filter("x is not null")
    d = kept.agg(F.max(F.size("x"))).first()[0]
    model = fit(kept.filter(F.size("x") == d), d, components) if d else None
    id_type = kept.schema["id"].dataType.simpleString()
    if model is None:
        return rows.sparkSession.createDataFrame([], f"id {id_type}, {out_schema}").withColumnRenamed("id", id_col)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # d x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            if not len(x):
                continue
            again = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                batch.column("id").take(again),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, m.n, np.int64)),
                pa.array(m.deviations(x), pa.int64()).take(again),
                pa.array(m.whitened(x).ravel()),
                pa.array(np.tile(m.explained, len(x))),
                pa.array(np.full(len(x) * k, m.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.filter(F.size("x") == d).mapInArrow(run, f"id {id_type}, {out_schema}").withColumnRenamed("id", id_col)
