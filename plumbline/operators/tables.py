"""Intermediate tables in the folder that driver and executors share: lineage ends at a table that was written."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, USUAL, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def setting(spark: SparkSession, key: str) -> str | None:
    """A setting, or its default; None where this Spark has no such setting.

    spark.conf.get(key, None) gives None for each setting that the session leaves at its default.
    """
    try:
        return spark.conf.get(key)
    except PySparkException:
        return None


def small_batches(spark: SparkSession) -> None:
    """Where the session leaves the size of Arrow batches at its default, long rows go to Python workers in smaller ones.

    A batch is held by the executor's JVM, twice while it grows, and by the worker; rows with whole texts reach the
    default of 64 MB for each task.
    """
    if setting(spark, BATCH) == USUAL:
        spark.conf.set(BATCH, SMALL)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session without a cluster gets a folder of its own where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/plumbline-{what}-{uuid.uuid4().hex}"


class Tables:
    """The tables of one run of an operator. A table that takes the place of another of its name deletes that one."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.folder, self.paths = spark, scratch(spark, what), {}

    def put(self, frame: DataFrame, name: str) -> DataFrame:
        """The frame, written and read again; what was shuffled for it goes once it is written."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        small_batches(self.spark)
        before = setting(self.spark, CLEANUP)
        if before is not None:
            self.spark.conf.set(CLEANUP, "true")
        try:
            frame.write.parquet(path)
        finally:
            if before is not None:
                self.spark.conf.set(CLEANUP, before)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables of no more use; where pyarrow can't reach the store they stay until the folder is cleared."""
        for name in names:
            path = self.paths.pop(name, None)
            if path:
                with contextlib.suppress(pa.ArrowException, OSError, ValueError):
                    where, inside = fs.FileSystem.from_uri(path)
                    where.delete_dir(inside)
