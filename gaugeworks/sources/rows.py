"""Labelled rows, votes, reports and calls from files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.operators.folds import Taxonomy
from gaugeworks.plans.policy import Report
from gaugeworks.sources.ledger import committed

#: Never inferred: a column such as votes may be missing from whole files.
LABELLED = T.StructType([T.StructField(n, t) for n, t in (("text", T.StringType()), ("tier", T.StringType()), ("label", T.StringType()), ("votes", T.ArrayType(T.StringType())), ("source", T.StringType()), ("src", T.StringType()), ("soft_dist", T.ArrayType(T.DoubleType())), ("hard", T.BooleanType()), ("agree", T.BooleanType()), ("margin", T.DoubleType()), ("_bad", T.StringType()))])
CALL = T.StructType([T.StructField(n, t) for n, t in (("request_id", T.StringType()), ("status", T.StringType()), ("latency_ms", T.DoubleType()), ("ts", T.TimestampType()), ("ranked", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))))])


def labelled_rows(spark: SparkSession, paths: list[str], task: Taxonomy | None = None) -> DataFrame:
    """JSON lines of several files as one frame: row_id, text, tier (or label), votes and the rest, with the file's
    name as dataset. Rows of labels outside the task go; broken lines go."""
    raw = spark.read.schema(LABELLED).option("columnNameOfCorruptRecord", "_bad").json(paths)
    rows = raw.where(F.col("_bad").isNull()).drop("_bad").withColumn("dataset", F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.jsonl?)?$", 1))
    rows = rows.withColumn("tier", F.coalesce(F.nullif(F.col("tier"), F.lit("")), "label")).withColumn("source", F.coalesce("source", "src")).drop("label", "src")
    rows = rows.where(F.col("tier").isin(task.labels)) if task else rows
    return rows.withColumn("row_id", F.sha2(F.to_json(F.struct("dataset", "text", "tier", "votes")), 256))


def voted_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    return labelled_rows(spark, paths).where(F.size("votes") > 0)


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


def source_string(rows: DataFrame) -> DataFrame:
    """One row with `source`: name:count of each file, joined by +, in order of names."""
    each = F.array_sort(F.collect_list(F.concat_ws(":", "dataset", "n")))
    return source_counts(rows).agg(F.array_join(each, "+").alias("source"))


def excluding(rows: DataFrame, *tokens: str) -> DataFrame:
    """Rows of files whose names hold none of the tokens."""
    out = rows
    for t in tokens:
        out = out.where(~F.col("dataset").contains(t))
    return out


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, digest, bytes) of whole files, to pin what a report was measured on."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("id"), F.substring(F.sha2("content", 256), 1, 16).alias("digest"), F.col("length").alias("bytes"))


def reports(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Report files, one JSON document each; those that don't parse and trial runs, by their `tag` if the schema has one,
    are left out. The schema stays as it is."""
    own = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(own).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    tag = F.coalesce(F.col("tag"), F.lit("")) if "tag" in schema.names else F.lit("")
    return rows.where(F.col("_bad").isNull() & ~tag.rlike("smoke|probe")).drop("_bad")


def calls(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Classifier calls: status, the best label, its softmax confidence and latency."""
    from gaugeworks.functions.probs import softmax

    raw = (spark.readStream if stream else spark.read).schema(CALL).json(path)
    best = F.array_max(F.transform("ranked", lambda r, i: F.struct(r.score.alias("score"), (-i).alias("i"), r.label.alias("label"))))
    conf = F.array_max(softmax(F.transform("ranked", lambda r: r.score)))
    return raw.select(F.col("request_id").alias("call_id"), "ts", "status", "latency_ms", best.label.alias("pred"), conf.alias("conf"))


def report_rows(spark: SparkSession, path: str) -> list[Report]:
    """Reports of a ledger, read back leniently; a ledger has one for each run."""
    rows = committed(spark, path).where("kind = 'report'").orderBy("at", "run").select("text").collect()
    return [Report.from_dict(json.loads(r.text)) for r in rows]


CHECKPOINT = T.StructType([T.StructField("id2label", T.MapType(T.StringType(), T.StringType())), T.StructField("architectures", T.ArrayType(T.StringType())), T.StructField("_bad", T.StringType())])


def checkpoints(spark: SparkSession, folder: str, labels: list[str], prefix: str = "") -> DataFrame:
    """(tag, labels, architecture) of the model checkpoints in a folder, by their config.json: those whose tag has the
    prefix and that answer in the given labels, in whatever order."""
    raw = spark.read.schema(CHECKPOINT).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(f"{folder}/*/config.json")
    tag = F.element_at(F.split("_metadata.file_path", "/"), -2)
    order = F.array_sort(F.transform(F.map_entries("id2label"), lambda e: F.struct(e.key.cast("int").alias("at"), e.value.alias("label"))))
    rows = raw.where("_bad is null and id2label is not null").select(tag.alias("tag"), F.transform(order, lambda e: e.label).alias("labels"), F.get("architectures", F.lit(0)).alias("architecture"))
    return rows.where(F.col("tag").startswith(prefix) & (F.array_sort("labels") == F.lit(sorted(labels))))


def intact(cache: DataFrame, value: str) -> DataFrame:
    """Entries of a cache whose value is a whole JSON document; the others are asked for again."""
    return cache.where(F.expr(f"try_parse_json({value})").isNotNull())


def missing_from_cache(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests that a keyed table of earlier answers (labels, embeddings) lacks."""
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")
