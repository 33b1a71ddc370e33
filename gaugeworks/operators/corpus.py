"""Labelled-text corpora: harvest, first occurrences, decontamination, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import text


def harvest(turns: DataFrame, low: int = 15, high: int = 2000, most_lines: int = 40) -> DataFrame:
    """The first user turn of each conversation, if it is of a fit length, has a word, and isn't a listing; one row
    for each normal form, that of least conv_id."""
    t = F.trim("text")
    fit = turns.where((F.col("turn") == 0) & (F.col("role") == "user") & F.length(t).between(low, high) & (text.newlines(t) <= most_lines) & t.rlike("[A-Za-z]{3}"))
    return first_of_key(fit.select("conv_id", t.alias("text"), text.key(t).alias("text_key")), "text_key", "conv_id")


def english_and_civil(rows: DataFrame, language: str = "language", toxic: str = "toxic", wanted: str = "English") -> DataFrame:
    """Rows of the wanted language that aren't marked as toxic; an unmarked row isn't."""
    return rows.where((F.col(language) == wanted) & ~F.coalesce(F.col(toxic).cast("boolean"), F.lit(False)))


def prior_ratios(rows: DataFrame, target: DataFrame, label: str = "label") -> DataFrame:
    """(label, have, want, ratio): the share of each label in two frames, and the logarithm of want over have; NULL where
    one lacks the label."""
    share = lambda df, name: df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")
    return share(rows, "have").join(share(target, "want"), label, "full").withColumn("ratio", F.log(F.col("want") / F.col("have")))


def class_weights(rows: DataFrame, labels: list[str], escalate: float = 0.0, label: str = "label") -> DataFrame:
    """(label, weight): the inverse square root of each label's share, raised by its place in the order of labels if
    escalate is over 0, at a mean of 1. Labels that don't occur count as one row."""
    known = rows.sparkSession.createDataFrame([(x, k) for k, x in enumerate(labels)], "label string, at int")
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("all"))
    per = known.join(counts, "label", "left").join(F.broadcast(whole), F.lit(True))
    weight = F.sqrt(F.col("all") / F.coalesce("n", F.lit(1))) * (1 + F.lit(escalate) * F.col("at") / max(1, len(labels) - 1))
    return per.withColumn("w", weight).select("label", (F.col("w") / F.avg("w").over(Window.partitionBy())).alias("weight"))


def first_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least order of each key. Minima combine before the shuffle, so a key of many rows is no hot spot."""
    others = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.min(F.struct(order, *others)).alias("b"))
    return best.select(key, F.col(f"b.{order}").alias(order), *(F.col(f"b.{c}").alias(c) for c in others)).select(*rows.columns)


def decontaminate(candidates: DataFrame, *held: DataFrame, column: str = "text") -> DataFrame:
    """Candidates whose normal form is in none of the held-out frames."""
    keys = held[0].select(text.key(F.col(column)).alias("_key"))
    for other in held[1:]:
        keys = keys.unionByName(other.select(text.key(F.col(column)).alias("_key")))
    return candidates.withColumn("_key", text.key(F.col(column))).join(keys.distinct(), "_key", "left_anti").drop("_key")


def leaks(train: DataFrame, held: DataFrame, column: str = "text") -> DataFrame:
    """Trimmed texts that both frames hold."""
    return train.select(F.trim(column).alias(column)).intersect(held.select(F.trim(column).alias(column)))


def relabelled(rows: DataFrame, names: DataFrame, column: str = "text") -> DataFrame:
    """rows with `tier` of names by text; of repeated texts in names the last by `at` counts."""
    last = names.groupBy(column).agg(F.max_by("tier", "at").alias("tier"))
    return rows.drop("tier").join(last, column, "left")


def changed_labels(before: DataFrame, after: DataFrame, key: str = "row_id") -> DataFrame:
    """(old, new, n) of the rows whose tier changed."""
    both = before.select(key, F.col("tier").alias("old")).join(after.select(key, F.col("tier").alias("new")), key)
    return both.where("old <> new").groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))


def mixes(rows: DataFrame, label: str, source: str) -> DataFrame:
    """(source, label, n, share) of each source's labels."""
    counts = rows.groupBy(source, label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(source).agg(F.sum("n").alias("whole"))
    return counts.join(whole, source).select(source, label, "n", (F.col("n") / F.col("whole")).alias("share"))
