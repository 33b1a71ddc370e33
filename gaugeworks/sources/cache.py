"""A keyed table of answers that were costly to get (embeddings, labels): misses are asked for once and stay.

Each entry carries a check of its answer. Entries whose check or file is damaged count as missing and are asked for
again; of several entries of a key the latest counts, so appends may be repeated. The output of each finished task is in place at once
(committer version 2), and a task asks for few keys: a run that is killed loses what was being asked for, no answer
that a task had finished.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.operators.adapters import Adapter

#: Keys that one task asks for.
PER_TASK = 512

Ask = Callable[[pd.DataFrame], pd.DataFrame]


class Cache:
    """A folder of entries (keys, answer columns). answer: a DDL list of the columns that an answer has."""

    def __init__(self, spark: SparkSession, path: str, keys: str, answer: str):
        self.spark, self.path = spark, path
        self.key_fields, self.answer_fields = T._parse_datatype_string(keys).fields, T._parse_datatype_string(answer).fields
        self.keys, self.answer = [f.name for f in self.key_fields], [f.name for f in self.answer_fields]
        self.schema = T.StructType([*self.key_fields, *self.answer_fields, T.StructField("_check", T.LongType()), T.StructField("_at", T.TimestampType())])

    def _files(self) -> DataFrame:
        """All entries; files that can't be read are passed over."""
        try:
            return self.spark.read.schema(self.schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(self.path)
        except AnalysisException:  # nothing there yet
            return self.spark.createDataFrame([], self.schema)

    def _check(self) -> Column:
        return F.xxhash64(*self.keys, *self.answer)

    def entries(self) -> DataFrame:
        """(keys, answer): the latest intact entry of each key."""
        whole = self._files().where(F.col("_check") == self._check())
        latest = Window.partitionBy(*self.keys).orderBy(F.desc("_at"), "_check")
        return whole.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").select(*self.keys, *self.answer)

    def missing(self, wanted: DataFrame) -> DataFrame:
        """A row of each wanted key without an intact entry; null keys are never asked for."""
        held = self._files().where(F.col("_check") == self._check()).select(*self.keys)
        return wanted.dropna(subset=self.keys).dropDuplicates(self.keys).join(held, self.keys, "left_anti")

    def fill(self, wanted: DataFrame, ask: Ask) -> None:
        """Ask for every missing key of wanted (keys and whatever ask needs): ask gets batches of rows and returns their
        keys and answers. Answers that it leaves out stay missing."""
        names = [*self.keys, *self.answer]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield ask(pdf)[names]

        todo = self.missing(wanted)
        n = todo.count()
        if not n:
            return
        dealt = todo.repartition(-(-n // PER_TASK), *self.keys)
        got = dealt.mapInPandas(run, T.StructType([*self.key_fields, *self.answer_fields]))
        whole = got.withColumns({"_check": self._check(), "_at": F.current_timestamp()})
        whole.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.path}/{uuid.uuid4().hex}")

    def answered(self, wanted: DataFrame, ask: Ask) -> DataFrame:
        """wanted with the answer columns, null where there is none; what the cache lacks is asked for first."""
        self.fill(wanted, ask)
        return wanted.join(self.entries(), self.keys, "left")

    def compact(self) -> None:
        """One set of files in place of many: new ones with the latest entries first, then the old ones go. A run that is killed in between
        leaves entries twice, which is no harm; what others append meanwhile stays."""
        old = [r.f for r in self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(self.path).select(F.col("path").alias("f")).collect()] if not self._files().isEmpty() else []
        if not old:
            return
        kept = self.entries().withColumns({"_check": self._check(), "_at": F.current_timestamp()})
        kept.write.mode("append").parquet(f"{self.path}/{uuid.uuid4().hex}")
        for f in old:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, False)


def embedding_cache(spark: SparkSession, path: str) -> Cache:
    return Cache(spark, path, "encoder string, text_sha256 string", "embedding array<float>")


def embedded(rows: DataFrame, encoder: str, encode: Callable[[list[str]], list[list[float]]], path: str, column: str = "text") -> DataFrame:
    """rows with `embedding`: each distinct text of an encoder is encoded once, ever; null texts have none."""
    wanted = rows.withColumns({"encoder": F.lit(encoder), "text_sha256": F.sha2(F.col(column), 256)})

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(embedding=list(encode(pdf[column].tolist())))

    cache = embedding_cache(rows.sparkSession, path)
    cache.fill(wanted.select(*cache.keys, column), ask)
    return wanted.join(cache.entries(), cache.keys, "left").select(*rows.columns, "embedding")


def classified(rows: DataFrame, name: str, adapter: Adapter, path: str, column: str = "text") -> DataFrame:
    """rows with `probs` from an adapter of this name, each distinct text asked for once; failed ones are asked for next time."""
    wanted = rows.withColumns({"model": F.lit(name), "text_sha256": F.sha2(F.col(column), 256)})
    cache = Cache(rows.sparkSession, path, "model string, text_sha256 string", "probs array<double>")

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        adapter.load()
        got = [adapter.answer(t) for t in pdf[column]]
        keep = [status == "OK" for _, status, _ in got]
        return pdf.assign(probs=[p for p, _, _ in got])[keep]

    cache.fill(wanted.select(*cache.keys, column), ask)
    return wanted.join(cache.entries(), cache.keys, "left").select(*rows.columns, "probs")
