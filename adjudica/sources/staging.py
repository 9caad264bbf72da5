"""Tables written in the folder that all executors share, to cut lineage, and deleted when their readers are done."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder only where it is unset and everything is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="adjudica-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write *df* once as Parquet in the shared folder and return the reread table with its path.

    This cuts lineage: a lost executor costs a reread, not a recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/adjudica-{label}-{uuid.uuid4().hex}"
    for scope in _OPEN:
        scope.append(path)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dealt(df: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores is dealt out before work in Python; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that :func:`staged` wrote and that no later plan reads."""
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables staged inside are deleted at the end, but for those taken off the list: for a caller who has written what they lead to.

    What an inner scope leaves is deleted by the one around it.
    """
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        discard(spark, *made)
