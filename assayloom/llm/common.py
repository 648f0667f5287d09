"""What the training-data operators share: table access and tables in the shared scratch folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: executors share no folder for intermediate tables")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="assayloom-"))
    return _FALLBACK[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here, and a lost executor costs nothing before it."""
    path = f"{shared_folder(df.sparkSession)}/assayloom/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    release_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives memory that Arrow and the C library keep for later back to the machine: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def release_driver(spark: SparkSession) -> None:
    """Gives the driver's garbage back to the machine between jobs: its JVM otherwise keeps a heap once grown, and the shuffles and broadcasts of plans that nothing refers to any more."""
    release()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small parts of Arrow batches, so that few texts are Python objects at a time; what they took is released behind the last one."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
    release()
