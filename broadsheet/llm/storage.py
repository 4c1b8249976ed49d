"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from broadsheet.session import short_batches  # noqa: F401


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only in local mode (tests)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            # A folder of one machine would lose what other executors write.
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="scratch-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


@functools.cache
def _system_library():
    return ctypes.CDLL(None)


def give_back() -> None:
    """Return what this worker has freed to the system.

    Workers live on from task to task, and both allocators keep the peak of the longest text.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(_system_library(), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run):
    """``run``, a function over Arrow batches, that gives freed memory back after each."""
    @functools.wraps(run)
    def lean(batches):
        for result in run(batches):
            yield result
            del result
            give_back()
    return lean


def materialize(rows: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``rows`` as Parquet in the shared folder and read them back.

    Cuts the lineage: what follows survives a lost executor without running
    the earlier stages again, and Spark knows the size of what it reads.
    """
    spark = rows.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", codec).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
