"""Tables that an operator reads several times: written once in the folder that all machines share, deleted when done."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.TemporaryDirectory(prefix="gaugeworks-")
    atexit.register(folder.cleanup)
    return folder.name


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A session that is one process gets its own where that is unset; a cluster is
    refused, as there is no telling which folders its machines share."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def stored(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """df as Parquet within this block: its lineage ends there, so that lost executors cost no rework."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gaugeworks/{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete(spark, path)
