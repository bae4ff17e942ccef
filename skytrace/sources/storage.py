"""Tables in the shared folder, to cut lineage between the steps of an operator."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is used in local mode only (tests); on a cluster
    a machine-local folder would lose data, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@functools.cache
def _local_folder(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/skytrace-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read back: computed once, safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that is in it; nothing happens if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """The written tables of one run, so that each can be removed once all that reads it is written itself.

    What a lazy result still reads has to stay; ``finish`` removes the rest of a run.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, new_folder(spark, name)
        self.tables: list[tuple[DataFrame, str]] = []
        self.count = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As written(), in the folder of this run."""
        self.count += 1
        path = f"{self.folder}/{self.count:04d}-{name}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more; others are left alone."""
        for table in tables:
            for own, path in self.tables:
                if own is table:
                    remove(self.spark, path)
        self.tables = [(own, path) for own, path in self.tables if not any(own is table for table in tables)]

    def finish(self, *keep: DataFrame) -> None:
        """Remove all tables of the run but those in ``keep``."""
        self.drop(*(own for own, _ in self.tables if not any(own is k for k in keep)))
        if not self.tables:
            remove(self.spark, self.folder)
