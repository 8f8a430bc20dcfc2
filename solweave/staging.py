"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is named (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="solweave-")
    spark.sparkContext.setCheckpointDir(made)
    return shared_dir(spark)


def keep(spark: SparkSession, path: str) -> None:
    """Leave a folder to be deleted when the interpreter ends."""
    _staged.append((spark, path))


def stage(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage without tying the rows to one executor: the files survive the loss of any
    executor. They are deleted when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables staged so far. Results that still read them must have been written before."""
    _drop_staged()
    _staged.clear()


@atexit.register
def _drop_staged() -> None:
    for spark, path in _staged:
        try:
            if spark.sparkContext._jsc is None:  # the session ended before
                return
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the gateway is closing
            return
