"""Materialising intermediate tables where all executors can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the job that this thread is in.
JOB: ContextVar[str | None] = ContextVar("job", default=None)


def stage_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a temporary one serves a local session; a cluster must name one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="memspark-stage-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def stage_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below it, or below the folder of the job that this thread is in."""
    return f"{JOB.get() or stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; nothing happens if it is gone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """What is staged inside goes to one folder, which is deleted at the end, failures included. Results must be written or collected before."""
    folder = f"{stage_root(spark)}/job-{uuid.uuid4().hex}"
    token = JOB.set(folder)
    try:
        yield folder
    finally:
        JOB.reset(token)
        remove(spark, folder)


def staged(df: DataFrame) -> DataFrame:
    """df as a table there, so later steps neither plan nor compute it again. Outside a job it stays until the folder is cleared or
    Spark's cleaner (spark.cleaner.referenceTracking.cleanCheckpoints) takes it."""
    stage_root(df.sparkSession)
    if JOB.get():
        path = stage_folder(df.sparkSession, "table")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """staged(), in two parts a core: where work on a row is heavy, parts of a size that suits a join would leave most cores idle."""
    return staged(df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism))
