"""Whitening of embeddings by a covariance of two passes.

The first pass adds the vectors, quantised to integers, in exact integer arithmetic, so
that the mean doesn't depend on the order of rows. The second subtracts the mean and adds
outer products, one matrix product for each block of rows; a task gives one matrix, and a
tree of merges adds them. The driver holds one matrix of dimensions times dimensions,
whatever the number of rows, and takes its eigenvectors with LAPACK; the leading ones are
broadcast, and every row is projected where it lies. No row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.plans import discard, map_arrow, shared_table

#: Quantised entries are kept within this, so that differences of two fit 64 bits.
MAX_ENTRY = 2**61
#: Entries of a block: vectors are worked on in blocks of about 4 MB.
_BLOCK = 1 << 19
#: Sums by length of vector that a task holds before it gives them out.
_LENGTHS = 64


@dataclass(frozen=True)
class Whitening:
    """``count`` vectors of ``dims`` entries, their exact ``sums``, and the leading components."""

    count: int
    dims: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as rows
    trace: float
    scale: float
    offset: int
    identity_error: float = 0.0

    def explained(self) -> list[float]:
        """Share of the trace of each component; 0 where nothing varies."""
        return [float(v) / self.trace if self.trace > 0 else 0.0 for v in self.values]

    def projection(self) -> np.ndarray:
        """Components over the roots of their eigenvalues; a component that doesn't vary gives 0."""
        least = np.finfo(float).eps * self.dims * max(float(self.values[0]), 0.0) if len(self.values) else 0.0
        varies = self.values > least
        return self.vectors * np.where(varies, 1 / np.sqrt(np.where(varies, self.values, 1.0)), 0.0)[:, None]


def complete(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def _blocks(column: pa.Array, scale: float, offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, quantised vectors of one length) of a batch; the vectors hold no nulls."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    begins = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        step = max(1, _BLOCK // max(int(d), 1))
        for k in range(0, len(rows), step):
            at = rows[k : k + step]
            with np.errstate(over="ignore"):
                y = np.floor(scale * flat[begins[at][:, None] + np.arange(d)])
            yield at, np.clip(y, -MAX_ENTRY, MAX_ENTRY).astype(np.int64) + offset


def _exact_sum(x: np.ndarray) -> list[int]:
    """Sums of columns as whole numbers of any size."""
    if not x.size:
        return [0] * x.shape[1]
    safe = float(np.abs(x).max()) * len(x) < 2**62
    return [int(v) for v in (x if safe else x.astype(object)).sum(axis=0)]


def _add(a: list, b: list) -> list:
    return b if not a else a if not b else [p + q for p, q in zip(a, b, strict=True)]


def _sums(vectors: DataFrame, scale: float, offset: int) -> tuple[int, list[int]]:
    """(number, exact sums) of the vectors of the commonest length, merged as a tree."""

    def run(batches):
        held: dict[int, tuple[int, list[int]]] = {}

        def out():
            rows = [(d, n, [str(v) for v in s]) for d, (n, s) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["dims", "n", "sums"])

        for batch in batches:
            for _, x in _blocks(batch.column(0), scale, offset):
                n, s = held.get(x.shape[1], (0, []))
                held[x.shape[1]] = (n + len(x), _add(s, _exact_sum(x)))
                if len(held) > _LENGTHS:
                    yield out()
        if held:
            yield out()

    parts = shared_table(map_arrow(vectors, run, "dims long, n long, sums array<string>"), "vector-sums")
    best = parts.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not best:
        return 0, []
    sums = parts.where(F.col("dims") == best[0]["dims"]).select("sums").rdd.treeAggregate([], lambda a, r: _add(a, [int(v) for v in r[0]]), _add)
    discard(parts)
    return best[0]["n"], sums


def _products(vectors: DataFrame, rows_of, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum, sum of outer products) of the rows that ``rows_of`` makes of a block."""

    def run(batches):
        total, outer = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            for c in rows_of(batch.column(0)):
                total += c.sum(axis=0)
                outer += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([outer.tobytes()], pa.binary())], names=["total", "outer"])

    def add(a, b):
        return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

    parts = map_arrow(vectors, run, "total binary, outer binary").rdd
    found = parts.treeAggregate(None, lambda a, r: add(a, (np.frombuffer(r[0]), np.frombuffer(r[1]))), add)
    return (np.zeros(width), np.zeros((width, width))) if found is None else (found[0], found[1].reshape(width, width))


def _centre(model: Whitening):
    """Quantised vectors less their mean, the whole part of which is taken off exactly."""
    whole = np.array([s // model.count for s in model.sums], np.int64)
    rest = np.array([s % model.count for s in model.sums], object)
    part = np.array([int(r) / model.count for r in rest], float)

    def centred(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at, x in _blocks(column, model.scale, model.offset):
            if x.shape[1] == model.dims:
                d = x - whole
                yield at, d, d - part

    return centred, rest


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = 8, scale: float = 1024.0, offset: int = 100_000) -> Whitening:
    """Fit on all complete vectors of ``df``: present, with finite entries only, of the commonest length.

    An entry c becomes the whole number floor(scale * c) + offset, at most 2**61 in size before the
    offset. Vectors of another length than the commonest (of two as common, the longer) have no
    place in the covariance and are left out, as are empty ones if they aren't the commonest.
    Repeated rows count as often as they occur. An empty table gives a model of no vectors.
    """
    vectors = df.where(complete(F.col(vector_col))).select(F.col(vector_col).alias("v"))
    n, sums = _sums(vectors, scale, offset)
    d = len(sums)
    model = Whitening(n, d, tuple(sums), np.zeros(0), np.zeros((0, d)), 0.0, scale, offset)
    if not d:
        return model
    centred, _ = _centre(model)
    total, outer = _products(vectors, lambda col: (c for _, _, c in centred(col)), d)
    covariance = outer / n - np.outer(total / n, total / n)
    values, columns = np.linalg.eigh((covariance + covariance.T) / 2)
    k = min(components, d)
    vectors_k = columns.T[::-1][:k].copy()
    vectors_k *= np.where(vectors_k[np.arange(k), np.abs(vectors_k).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    model = replace(model, values=values[::-1][:k].copy(), vectors=vectors_k, trace=float(np.trace(covariance)))
    # what the projection really gives, over all rows
    p = model.projection().T
    total, outer = _products(vectors, lambda col: (c @ p for _, _, c in centred(col)), k)
    error = np.abs(outer / n - np.outer(total / n, total / n) - np.eye(k)).max()
    return replace(model, identity_error=float(error))


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened): one row for each row that ``fit_whitening`` would have used.

    ``whitened`` has an entry for each component. ``deviation`` is the exact sum of squares of
    count * x - sum over the dimensions, null if it has more than 38 digits. Null ids are kept and
    repeated rows answered as often as they occur.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, deviation decimal(38,0), whitened array<double>"
    rows = df.where(complete(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    if not model.count or not model.dims:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        centred, rest = _centre(sent.value)
        p, n, k = sent.value.projection().T, sent.value.count, len(sent.value.values)
        for batch in batches:
            for at, d, c in centred(batch.column(1)):
                most = n * (float(np.abs(d).max()) + 1)
                if most * most * len(p) < 2**62:
                    off = n * d - rest.astype(np.int64)
                    deviation = pa.array((off * off).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
                else:
                    off = n * d.astype(object) - rest
                    deviation = pa.array([Decimal(int(v)) if v < 10**38 else None for v in (off * off).sum(axis=1)], pa.decimal128(38, 0))
                white = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), pa.array((c @ p).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), deviation, white], names=["id", "deviation", "whitened"])

    return map_arrow(rows, run, schema).withColumnRenamed("id", id_col)


def whitened_rows(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector and component: id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is null where it doesn't fit a long.
    """
    rows = whiten(df, model, id_col, vector_col).select(id_col, F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(x) for x in model.explained()]) if len(model.values) else F.array().cast("array<double>")
    return rows.select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.count).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
