"""The cluster's shared folder, and tables kept in it to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; a temporary one only where one machine runs all."""
    if place := spark.conf.get("spark.checkpoint.dir", None):
        return place.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    return tempfile.mkdtemp(prefix="shared-")


def merged(df: DataFrame) -> DataFrame:
    """``df``, to be joined by sorting: texts and files that functions make are taken for a few bytes, and would be sent whole to the driver and to every task."""
    return df.hint("merge")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, place: str) -> None:
    """Deletes a folder, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Frames written as Parquet to a folder in the shared one, and read again."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.place = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, of: str) -> DataFrame:
        df.write.parquet(f"{self.place}/{of}")
        return self.spark.read.schema(df.schema).parquet(f"{self.place}/{of}")

    def drop(self, of: str) -> None:
        removed(self.spark, f"{self.place}/{of}")


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Scratch]:
    """A ``Scratch`` whose files are deleted at the end, also after a failure; what is to last must be checkpointed within."""
    own = Scratch(spark, name)
    try:
        yield own
    finally:
        removed(spark, own.place)
