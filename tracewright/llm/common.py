"""Shared helpers of the training-data operators: the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows, and bytes of their columns, that a task turns into Python objects at a time.
SLICE_ROWS = 256
SLICE_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent and the master is local (tests, a laptop) a temporary folder is
    made and remembered as the checkpoint folder, so that later calls find the same one. A cluster
    without the setting is an error, as its executors share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tracewright-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd", instead: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts lineage: an executor lost later costs a reread of files, not a recomputation. Once the
    table is written, that of ``instead``, an earlier result which nothing else reads, is deleted.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    if instead is not None:
        discard(instead)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_path = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows, few at a time, so that what a task makes of them stays small.

    A slice has ``rows`` rows at most, and of long ones as few as stay within ``size`` bytes, or one.
    """
    for batch in batches:
        k = 0
        while k < batch.num_rows:
            n = min(rows, batch.num_rows - k)
            while n > 1 and batch.slice(k, n).nbytes > size:
                n //= 2
            yield batch.slice(k, n)
            k += n
