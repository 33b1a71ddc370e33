"""Ledgers: Parquet folders to which each (run, batch) is appended once.

The rows of an append are written under an attempt of their own; a commit record that names the attempt is created
last, in one step that fails if there is one for the same experiment, run and batch. Readers see rows of committed attempts only: what a
killed job left behind, and what a replayed batch wrote again, is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("experiment", "run", "batch")
COMMIT = "experiment string, run string, batch string, attempt string"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _record(path: str, experiment: str, run: str, batch: str) -> str:
    return f"{path}/commits/{hashlib.sha256(json.dumps([experiment, run, batch]).encode()).hexdigest()}.json"


def is_committed(spark: SparkSession, path: str, experiment: str, run: str, batch: str = "0") -> bool:
    fs, place = _place(spark, _record(path, experiment, run, batch))
    return fs.exists(place)


def append_once(rows: DataFrame, path: str, experiment: str, run: str, batch: str = "0") -> bool:
    """Append rows with columns experiment, run, batch and attempt before their own; False, and nothing happens, if that
    batch of that run is there. Own columns of these names are replaced."""
    spark = rows.sparkSession
    if is_committed(spark, path, experiment, run, batch):
        return False
    attempt = uuid.uuid4().hex
    marks = {"experiment": experiment, "run": run, "batch": batch, "attempt": attempt}
    own = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in marks]
    rows.select(*(F.lit(v).alias(k) for k, v in marks.items()), *own).write.mode("append").parquet(f"{path}/data")
    fs, place = _place(spark, _record(path, experiment, run, batch))
    try:
        out = fs.create(place, False)
    except Exception as e:  # another attempt was first
        if fs.exists(place):
            return False
        raise e
    out.write(json.dumps(marks).encode())
    out.close()
    return True


def committed(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    """The rows of all committed appends, or of those of one experiment."""
    commits = spark.read.schema(COMMIT).json(f"{path}/commits/*.json")
    data = spark.read.option("mergeSchema", True).parquet(f"{path}/data")
    if experiment is not None:
        commits, data = commits.where(F.col("experiment") == experiment), data.where(F.col("experiment") == experiment)
    return data.join(commits.select("attempt"), "attempt", "left_semi").drop("attempt")


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(COMMIT).json(f"{path}/commits/*.json")
        return True
    except AnalysisException:
        return False


def stream_run(batch: DataFrame) -> str:
    """The run that a stream's batch belongs to: its query's id, which its checkpoint keeps and no other one has."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def stream_to_ledger(stream: DataFrame, path: str, checkpoint: str, experiment: str, rows_of=lambda batch: batch, mode: str = "append"):
    """Append what rows_of makes of each batch of a stream, each once, and stop when the source is used up."""

    def append(batch: DataFrame, number: int) -> None:
        append_once(rows_of(batch), path, experiment, stream_run(batch), str(number))

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
