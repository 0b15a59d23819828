"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local() -> str:
    """A folder for local mode, gone with the process."""
    at = tempfile.mkdtemp(prefix="cinnabar-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder under spark.checkpoint.dir.

    Only local mode, where driver and executors are one process, may leave that setting out; elsewhere a temporary
    folder of the driver's would lose data, so it is refused.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _local()
    return f"{at.rstrip('/')}/cinnabar-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*staged: DataFrame) -> None:
    """Remove tables made by `stage` that nothing is to read again.  The collection frees the shuffle files of ended
    jobs, which else stay until the driver's heap happens to fill."""
    for df in staged:
        _delete(df.sparkSession, df._staged)
    staged[0].sparkSession._jvm.System.gc()


def discard(spark: SparkSession) -> None:
    """Remove every table that this application has staged; frames that are still to be read need theirs."""
    _delete(spark, shared_dir(spark))
