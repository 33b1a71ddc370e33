"""Classifiers as operators: any function of texts, applied batch by batch, with or without telemetry."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.probs import argmax_index, reordered
from gaugeworks.functions.text import segments


class Adapter(ABC):
    """A classifier that a task loads once: load() runs on the executor, predict() for each batch of texts."""

    labels: list[str]

    def load(self) -> None:  # noqa: B027
        """What must not travel with the task, such as a model."""

    @abstractmethod
    def predict(self, texts: list[str]) -> np.ndarray:
        """(texts, labels) probabilities."""

    def answer(self, text: str | None) -> tuple[list[float] | None, str, float | None]:
        """One text's probabilities, status and milliseconds; those of a text that fails are null."""
        began = time.perf_counter()
        try:
            probs = self.predict(["" if text is None else text])[0].tolist()
        except Exception as e:  # noqa: BLE001
            return None, failure(e), None
        return probs, "OK", (time.perf_counter() - began) * 1000


def failure(e: Exception) -> str:
    """The status of a failed call: services name an exhausted resource in the message."""
    return "RESOURCE_EXHAUSTED" if isinstance(e, MemoryError) or "RESOURCE_EXHAUSTED" in str(e).upper().replace(" ", "_") else "ERROR"


class FunctionAdapter(Adapter):
    """A function of a text that returns a label, or a dict of scores."""

    def __init__(self, labels: list[str], function: Callable[[str], str | dict[str, float]]):
        self.labels, self.function = labels, function

    def predict(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.labels)))
        for k, t in enumerate(texts):
            found = self.function(t)
            scores = {found: 1.0} if isinstance(found, str) else found
            row = np.array([float(scores.get(x, 0.0)) for x in self.labels])
            out[k] = row / row.sum() if row.sum() > 0 else 1 / len(self.labels)
        return out


def majority(labelled: DataFrame, labels: list[str], column: str = "truth") -> FunctionAdapter:
    """The baseline that always answers the most common label, the least of equally common ones."""
    top = labelled.groupBy(column).count().orderBy(F.desc("count"), column).first()
    return FunctionAdapter(labels, lambda _, label=top[0] if top else labels[0]: label)


def predict(rows: DataFrame, adapter: Adapter, key: str = "row_id", column: str = "text", batch: int | None = None) -> DataFrame:
    """(row_id, probs, status, latency_ms). Each text is a request of its own and timed by itself; one that fails has no
    probs and no latency, and a status that says why.

    With `batch`, so many texts are sent together, which is faster and has no latency of single requests to
    tell (latency_ms is null). A batch that fails is halved down to the rows that fail by themselves."""

    def together(texts: list[str]) -> list[tuple[list[float] | None, str, float | None]]:
        try:
            return [(p, "OK", None) for p in adapter.predict(texts).tolist()]
        except Exception as e:  # noqa: BLE001
            if len(texts) == 1:
                return [(None, failure(e), None)]
            half = len(texts) // 2
            return together(texts[:half]) + together(texts[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter.load()
        for pdf in batches:
            for k in range(0, len(pdf), batch or 64):
                part = pdf.iloc[k : k + (batch or 64)]
                texts = ["" if t is None else t for t in part[column]]
                got = together(texts) if batch else [adapter.answer(t) for t in texts]
                yield pd.DataFrame({key: part[key], "probs": [p for p, _, _ in got], "status": [s for _, s, _ in got], "latency_ms": pd.array([x for _, _, x in got], "Float64")})

    return rows.select(key, column).mapInPandas(run, f"{key} {dict(rows.select(key).dtypes)[key]}, probs array<double>, status string, latency_ms double")


def with_answers(rows: DataFrame, answers: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that got an answer, with it."""
    return rows.join(answers.where("status = 'OK'").select(key, "probs"), key)


def span_max(rows: DataFrame, adapter: Adapter, labels: list[str], key: str = "row_id", column: str = "text") -> DataFrame:
    """(row_id, label, n_segments): the highest label, in the order of labels, among a text and its quoted or first
    parts. Every segment is a row of the adapter's; a row without an answered segment has no label."""
    parts = rows.select(key, F.posexplode(segments(F.coalesce(column, F.lit("")))).alias("_at", column))
    parts = parts.withColumn("_segment", F.struct(F.col(key).alias("k"), F.col("_at").alias("at")))
    answers = predict(parts, adapter, "_segment", column, batch=64).where("status = 'OK'")
    best = answers.groupBy(F.col("_segment.k").alias(key)).agg(F.max(argmax_index(reordered(F.col("probs"), adapter.labels, labels))).alias("rank"), F.count(F.lit(1)).alias("n_segments"))
    return best.select(key, F.get(F.lit(labels), F.col("rank")).alias("label"), "n_segments")
