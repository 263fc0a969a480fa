"""Cut lineage through storage that every executor can read.

``localCheckpoint`` keeps one copy on the executor that made it, so a lost
executor loses the data; everything here goes to the folder in
``spark.checkpoint.dir``. A temporary folder is used only where the session
names none, as in local tests.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings of the writes of shared tables, unless the session has its own: Spark deletes a query's shuffle
#: files when the query ends, and Python gets batches of about 9 MB at most, which both sides hold in memory.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "9000000",
}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; also Spark's checkpoint folder afterwards."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quernstone-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The settings of the writes of shared tables, for writes of other kinds."""
    ours = {k: v for k, v in _WRITING.items() if spark.conf.get(k, None) is None}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in ours:
            spark.conf.unset(k)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Parquet rather than ``checkpoint()`` where the result is scanned several
    times: the columns are compressed, prunable and their size is known to AQE.
    What the write shuffled is deleted as soon as it ends, not when the driver
    happens to collect its garbage. ``discard`` deletes the table itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables from ``shared_table`` that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t.shared_path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """One step of an iteration, written to the shared folder; ``discard`` it when the next step is there."""
    return shared_table(df, "step")
