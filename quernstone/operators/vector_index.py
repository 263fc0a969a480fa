"""A stored vector index: rows in cells around k-means centroids, searches that visit the nearest cells.

Centroids are fitted on a bounded sample by Spark aggregations; then every row is put into the
cell of its nearest centroid and stored there in blocks of up to 1,024 vectors, one Parquet row
each, in a folder by cell. A search deals its queries, in blocks too, to the cells they visit;
blocks of queries meet blocks of rows by a join on the cell and are compared by one matrix
product, of which each query keeps its best. Neither side passes the driver.

How many cells to visit is measured when the index is made: a bounded set of stored vectors is
searched in all cells, and the least number that finds the wanted share of their neighbours is
kept with the index. Visiting all cells is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.plans import discard, map_arrow, shared_table

#: Vectors of a block of rows, and of queries.
BLOCK, QUERY_BLOCK = 1024, 256
#: Most cells; vectors that centroids are fitted on, rounds of that, and vectors that the number of visits is measured on.
MAX_CELLS, FITTED, ROUNDS, MEASURED = 4096, 65_536, 8, 256
_BLOCKS = "cell int, n int, ids array<long>, vectors binary"


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of length 0 stay so."""
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _nearest_cells(v: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest cells of each vector, nearest first, equal ones by number."""
    # rounded, so that a vector is as near to a cell in a block of one size as in another
    return np.argsort(-np.round(_unit(v) @ centroids.T, 9), axis=1, kind="stable")[:, :k]


def _distinct(centroids: np.ndarray) -> np.ndarray:
    """Centroids that lie apart, in their order."""
    _, first = np.unique(np.round(centroids, 6), axis=0, return_index=True)
    return centroids[np.sort(first)]


def _packed(rows: Iterator[tuple[int, int, np.ndarray]], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (cell, id, vector) that come sorted by cell."""
    for cell, own in groupby(rows, key=lambda r: r[0]):
        held = []
        for r in own:
            held.append(r)
            if len(held) == size:
                yield _block(cell, held)
                held = []
        if held:
            yield _block(cell, held)


def _block(cell: int, held: list) -> pa.RecordBatch:
    data = np.stack([r[2] for r in held]).astype(np.float64).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([[r[1] for r in held]], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["cell", "n", "ids", "vectors"])


class VectorIndex:
    """Cosine search of vectors of one dimension; rows with another one, or none, aren't found by any search."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        meta = spark.read.parquet(f"{self.path}/meta").first()
        self.dims, self.visits, self.rows, self.recall = meta["dims"], meta["visits"], meta["n"], meta["recall"]
        self.centroids = np.frombuffer(meta["centroids"]).reshape(-1, self.dims) if self.dims else np.zeros((0, 0))

    @classmethod
    def build(cls, df: DataFrame, row_id: str, vector: str, path: str, cells: int | None = None, recall: float = 0.95, k: int = 10) -> VectorIndex:
        """A new index of ``df`` in ``path``; ``recall`` of the best ``k`` is what a search's visits are measured for.

        The dimension is that of most vectors (of two as common, the larger). Vectors with nulls or
        entries that aren't finite are as good as null ones. Ids that repeat are stored as often.
        """
        spark, path = df.sparkSession, path.rstrip("/")
        whole = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
        rows = df.where(F.col(row_id).isNotNull() & whole).select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        best = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        n, dims = (best["n"], best["d"]) if best else (0, 0)
        rows = rows.where(F.size("v") == dims)
        centroids = cls._fit(rows, n, dims, min(MAX_CELLS, cells or max(1, round(n**0.5)))) if n else np.zeros((0, 0))
        cls._store(rows, centroids, n, f"{path}/blocks")
        visits, found = len(centroids), 1.0
        if n:
            visits, found = cls._measure(spark, path, rows, n, centroids, recall, k)
        meta = [(dims, visits, n, found, bytearray(centroids.tobytes()))]
        spark.createDataFrame(meta, "dims int, visits int, n long, recall double, centroids binary").coalesce(1).write.parquet(f"{path}/meta")
        return cls(spark, path)

    @staticmethod
    def _share(rows: DataFrame, n: int, most: int, seed: int) -> DataFrame:
        """About ``most`` rows at most, the same in every run."""
        return rows if n <= most else rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30)))

    @classmethod
    def _fit(cls, rows: DataFrame, n: int, dims: int, cells: int) -> np.ndarray:
        """Lloyd's rounds on a sample: tasks sum the vectors of each cell, Spark adds the sums."""
        sample = shared_table(cls._share(rows, n, FITTED, 1), "sample")
        start = sample.dropDuplicates(["v"]).orderBy(F.xxhash64("id", F.lit(2)), "id").limit(cells).collect()
        centroids = _distinct(_unit(np.array([r["v"] for r in start], float).reshape(-1, dims)))
        for _ in range(ROUNDS):
            sent = rows.sparkSession.sparkContext.broadcast(centroids)

            def run(batches, sent=sent):
                c = sent.value
                total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
                for batch in batches:
                    v = _unit(_matrix(batch.column(0), dims))
                    at = _nearest_cells(v, c, 1)[:, 0]
                    np.add.at(total, at, v)
                    count += np.bincount(at, minlength=len(c))
                own = np.flatnonzero(count)
                cell, place = np.repeat(own, dims), np.tile(np.arange(dims), len(own))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(place, pa.int32()), pa.array(total[own].reshape(-1))], names=["cell", "place", "total"])

            sums = map_arrow(sample.select("v"), run, "cell int, place int, total double").groupBy("cell", "place").agg(F.sum("total").alias("total"))
            moved = centroids.copy()
            for r in sums.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("place", "total"))).alias("e")).collect():
                moved[r["cell"]] = [e["total"] for e in r["e"]]
            moved = _unit(moved)
            if np.allclose(moved, centroids, atol=1e-9):
                break
            centroids = moved
        discard(sample)
        return _distinct(centroids)

    @staticmethod
    def _dealt(rows: DataFrame, centroids: np.ndarray, visits: int, size: int, spread: int = 1) -> DataFrame:
        """Blocks of rows (id, v), each row in its ``visits`` nearest cells; a cell is filled by ``spread`` tasks."""
        sent = rows.sparkSession.sparkContext.broadcast(centroids)

        def put(batches):
            for batch in batches:
                v = _matrix(batch.column(1), sent.value.shape[1])
                cells = _nearest_cells(v, sent.value, visits)
                again = pa.array(np.repeat(np.arange(len(v)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1), pa.int32()), batch.column(0).take(again), batch.column(1).take(again)], names=["cell", "id", "v"])

        def pack(batches):
            yield from _packed(((c, i, v) for b in batches for c, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _matrix(b.column(2), sent.value.shape[1]), strict=True)), size)

        put_rows = map_arrow(rows, put, "cell int, id long, v array<double>")
        return map_arrow(put_rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(spread))).sortWithinPartitions("cell", "id"), pack, _BLOCKS)

    @classmethod
    def _store(cls, rows: DataFrame, centroids: np.ndarray, n: int, path: str) -> None:
        # equal vectors share a cell, however many they are: a cell is written by as many tasks as there are millions of rows
        blocks = cls._dealt(rows, centroids, 1, BLOCK, 1 + n // (1 << 20)) if n else rows.sparkSession.createDataFrame([], _BLOCKS)
        blocks.write.partitionBy("cell").parquet(path)

    @classmethod
    def _measure(cls, spark: SparkSession, path: str, rows: DataFrame, n: int, centroids: np.ndarray, recall: float, k: int) -> tuple[int, float]:
        """The least number of visits that finds ``recall`` of the best ``k`` of some stored vectors, and what it finds."""
        asked = shared_table(cls._share(rows, n, MEASURED, 3), "measured")
        true = cls._compare(spark, path, asked, centroids, len(centroids), k).join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        sent = spark.sparkContext.broadcast(centroids)

        def run(batches):
            for b in batches:
                order = _nearest_cells(_matrix(b.column(1), sent.value.shape[1]), sent.value, len(sent.value))
                rank = np.argsort(order, axis=1)[np.arange(len(order)), b.column(0).to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(rank.astype(np.int32))], names=["rank"])

        ranks = map_arrow(true.select("cell", "q"), run, "rank int").groupBy("rank").agg(F.count(F.lit(1)).alias("n")).orderBy("rank").collect()
        discard(asked)
        total, seen = sum(r["n"] for r in ranks), 0
        for r in ranks:
            seen += r["n"]
            if seen >= recall * total:
                return r["rank"] + 1, seen / total
        return len(centroids), 1.0

    @classmethod
    def _compare(cls, spark: SparkSession, path: str, queries: DataFrame, centroids: np.ndarray, visits: int, k: int) -> DataFrame:
        """(query_id, id, similarity, cell): the best ``k`` rows in the visited cells, ties by id."""
        asked = cls._dealt(queries, centroids, visits, QUERY_BLOCK).select("cell", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
        stored = spark.read.schema("n int, ids array<long>, vectors binary, cell int").parquet(f"{path}/blocks")
        pairs = stored.join(asked, "cell").select("cell", "ids", "vectors", "query_ids", "queries")

        def run(batches):
            for batch in batches:
                for cell, ids, vectors, query_ids, asked_for in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    ids, query_ids = np.array(ids), np.array(query_ids)
                    v, q = np.frombuffer(vectors).reshape(len(ids), -1), np.frombuffer(asked_for).reshape(len(query_ids), -1)
                    norm = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))
                    dots = q @ v.T
                    sim = np.divide(dots, norm, out=np.zeros_like(dots), where=norm > 0)
                    own = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, own.shape[1])), pa.array(ids[own].reshape(-1)), pa.array(np.take_along_axis(sim, own, axis=1).reshape(-1)), pa.array(np.full(own.size, cell), pa.int32())], names=["query_id", "id", "similarity", "cell"])

        found = map_arrow(pairs, run, "query_id long, id long, similarity double, cell int")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")

    def search(self, queries: DataFrame, row_id: str, vector: str, k: int = 10, visits: int | None = None) -> DataFrame:
        """(query_id, row id, similarity): about the best ``k`` rows of each query, ties by id.

        ``visits`` cells are searched for each query, by default as many as were measured; all of
        them give the exact result. Queries without a vector of the index's dimension find nothing.
        """
        asked = queries.where(F.col(row_id).isNotNull() & (F.size(vector) == self.dims)).select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        if not self.rows:
            return self.spark.createDataFrame([], f"query_id long, `{row_id}` long, similarity double")
        found = self._compare(self.spark, self.path, asked, self.centroids, min(visits or self.visits, len(self.centroids)), k)
        return found.select("query_id", F.col("id").alias(row_id), "similarity")

    def exact(self, queries: DataFrame, row_id: str, vector: str, k: int = 10) -> DataFrame:
        return self.search(queries, row_id, vector, k, max(1, len(self.centroids)))

    def share_read(self, queries: DataFrame, row_id: str, vector: str, visits: int | None = None) -> float:
        """The share of all pairs of a query and a row that a search compares."""
        asked = queries.where(F.col(row_id).isNotNull() & (F.size(vector) == self.dims)).select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        met = self._dealt(asked, self.centroids, min(visits or self.visits, len(self.centroids)), QUERY_BLOCK).groupBy("cell").agg(F.sum("n").alias("q"))
        stored = self.spark.read.schema("n int, cell int").parquet(f"{self.path}/blocks").groupBy("cell").agg(F.sum("n").alias("n"))
        pairs = met.join(stored, "cell").agg(F.sum(F.col("q") * F.col("n"))).first()[0] or 0
        return pairs / max(1, self.rows * asked.count())
