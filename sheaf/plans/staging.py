"""Stage tables in the folder that the whole cluster shares.

A stage table cuts lineage: Spark's writer commits it once, it survives lost executors, and its
readers never repeat the work above it. Tables lie in a folder of their application, and inside it of
their run (``own_stages``), so nobody's clean-up takes away what another job reads. Nothing here touches
a machine-local folder on a cluster: without ``spark.checkpoint.dir`` only a local session gets a folder
of its own, any other is refused.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_RUN: ContextVar[str] = ContextVar("run", default="")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session without one gets a new one."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sheaf-shared-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sheaf-stages/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, label: str) -> str:
    run = f"{_RUN.get()}/" if _RUN.get() else ""
    return f"{application_dir(spark)}/{run}{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table as read back."""
    spark, path = df.sparkSession, stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Run:
    """A folder of its own for the stage tables that are made while the run is entered; ``drop`` deletes it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name, self.tokens = spark, f"run-{uuid.uuid4().hex}", []

    def __enter__(self) -> Run:
        self.tokens.append(_RUN.set(self.name))
        return self

    def __exit__(self, *failure) -> None:
        _RUN.reset(self.tokens.pop())

    def drop(self) -> None:
        _delete(self.spark, f"{application_dir(self.spark)}/{self.name}")


@contextmanager
def own_stages(spark: SparkSession) -> Iterator[Run]:
    """A run that is dropped at the end.

    For callers that write or collect their result inside; a DataFrame carried out can't be read any more.
    """
    run = Run(spark)
    try:
        with run:
            yield run
    finally:
        run.drop()


def drop_stages(spark: SparkSession) -> None:
    """Delete the stage tables of this application. Call when no result is read any more."""
    _delete(spark, application_dir(spark))
