"""Medoids of each label's embeddings, and anchors chosen greedily for the accuracy that they give on other rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.probs import unit
from gaugeworks.functions.text import hash_order
from gaugeworks.operators.sampling import stratified
from gaugeworks.stored import stored



def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


#: Of a label's unit vectors: the slot that each row belongs to, and its score there.
Scorer = Callable[[object, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _best(rows: DataFrame, score: Scorer) -> dict[tuple, tuple[int, np.ndarray]]:
    """The row_id and vector of best score in each (label, slot), the least row_id of equal ones. A task sends one row
    for each batch and slot."""
    kind = dict(rows.dtypes)["label"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for label, part in pdf.groupby("label"):
                part = part.sort_values("row_id")
                x = _unit(np.array(part.embedding.tolist(), float))
                slot, value = score(label, x)
                value = np.round(value, 12)
                for s in np.unique(slot):
                    own = np.flatnonzero(slot == s)
                    at = own[value[own].argmax()]
                    yield pd.DataFrame({"label": [label], "slot": [int(s)], "score": [float(value[at])], "row_id": [int(part.row_id.iloc[at])], "v": [x[at]]})

    found = rows.mapInPandas(run, f"label {kind}, slot int, score double, row_id bigint, v array<double>")
    best = found.groupBy("label", "slot").agg(F.max(F.struct("score", F.negative("row_id").alias("id"), "v")).alias("b")).collect()
    return {(r.label, r.slot): (-r.b.id, np.array(r.b.v)) for r in best}


def _means(rows: DataFrame, slot_of: Callable[[object, np.ndarray], np.ndarray]) -> dict[tuple, np.ndarray]:
    """The mean vector, at unit length, of each (label, slot); tasks send sums."""
    kind = dict(rows.dtypes)["label"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for label, part in pdf.groupby("label"):
                x = _unit(np.array(part.embedding.tolist(), float))
                slot = slot_of(label, x)
                for s in np.unique(slot):
                    yield pd.DataFrame({"label": [label], "slot": [int(s)], "v": [x[slot == s].sum(0)]})

    long = rows.mapInPandas(run, f"label {kind}, slot int, v array<double>").select("label", "slot", F.posexplode("v").alias("pos", "x"))
    sums = long.groupBy("label", "slot", "pos").agg(F.sum("x").alias("x")).groupBy("label", "slot").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).collect()
    return {(r.label, r.slot): _unit(np.array([p.x for p in r.v])) for r in sums}


def medoids(rows: DataFrame, k: int, rounds: int = 25) -> DataFrame:
    """(label, row_id) of k medoids of each label, or all of its rows if fewer. They begin with the row nearest the
    label's mean and, one by one, the row farthest from all so far; then rows go to their nearest medoid, and the row
    nearest each group's mean takes its place, until none changes. The driver holds the medoids; each step is an
    aggregation over all rows, to which a task adds a row for each batch and medoid."""
    rows = rows.select("label", F.col("row_id").cast("bigint").alias("row_id"), unit(F.col("embedding").cast("array<double>")).alias("embedding"))
    with stored(rows, "medoid_rows") as kept:
        return _medoids(kept, k, rounds)


def _medoids(rows: DataFrame, k: int, rounds: int) -> DataFrame:
    means = _means(rows, lambda _, x: np.zeros(len(x), int))
    chosen = {label: [got] for (label, _), got in _best(rows, lambda label, x: (np.zeros(len(x), int), x @ means[label, 0])).items()}
    vectors = lambda: {label: np.array([v for _, v in got]) for label, got in chosen.items()}
    for _ in range(k - 1):
        now = vectors()
        for (label, _), got in _best(rows, lambda label, x: (np.zeros(len(x), int), -(x @ now[label].T).max(1))).items():  # noqa: B023
            if got[0] not in [i for i, _ in chosen[label]]:
                chosen[label].append(got)
    for _ in range(rounds):
        now = vectors()
        nearest = lambda label, x: (x @ now[label].T).argmax(1)  # noqa: B023, E731
        means = _means(rows, nearest)

        def inside(label: object, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            slot = nearest(label, x)  # noqa: B023
            return slot, np.array([v @ means[label, int(s)] for v, s in zip(x, slot, strict=True)])  # noqa: B023

        found = _best(rows, inside)
        new = {label: [found.get((label, j), got) for j, got in enumerate(old)] for label, old in chosen.items()}
        if all([i for i, _ in new[label]] == [i for i, _ in chosen[label]] for label in new):
            break
        chosen = new
    kind = dict(rows.dtypes)["label"]
    return rows.sparkSession.createDataFrame([(label, i) for label, got in chosen.items() for i, _ in got], f"label {kind}, row_id bigint")


@dataclass
class _Chosen:
    """Anchors chosen so far, as places in the pool, and the scores that dev rows have by them."""

    labels: np.ndarray
    k: int
    places: list[int]

    def tops(self, cosine: np.ndarray, label: int) -> np.ndarray:
        """Each row's k largest cosines with the chosen anchors of a label, or all of fewer."""
        own = cosine[:, [c for c in self.places if self.labels[c] == label]]
        return np.sort(own, 1)[:, -self.k :]

    def hits(self, cosine: np.ndarray, truth: np.ndarray, n_labels: int) -> np.ndarray:
        """For each candidate, how many rows would have their label's score on top if it were chosen too."""
        tops = [self.tops(cosine, x) for x in range(n_labels)]
        score = np.stack([t.mean(1) if t.shape[1] else np.full(len(truth), -np.inf) for t in tops], 1)
        out = np.zeros(len(self.labels), np.int64)
        row = np.arange(len(truth))
        for x in range(n_labels):
            others = np.delete(np.arange(n_labels), x)
            rival = others[score[:, others].argmax(1)] if len(others) else np.full(len(truth), x)
            best = score[row, rival] if len(others) else np.full(len(truth), -np.inf)
            own = np.flatnonzero(self.labels == x)
            c, top = cosine[:, own], tops[x]
            if top.shape[1] < self.k:
                new = (top.sum(1, keepdims=True) + c) / (top.shape[1] + 1)
            else:  # the least of the top goes if the candidate is larger
                new = (top.sum(1, keepdims=True) + np.maximum(c - top[:, :1], 0)) / self.k
            new = np.round(new, 12)
            wins = np.where((x < rival)[:, None], new >= np.round(best, 12)[:, None], new > np.round(best, 12)[:, None])  # the first of equal ones
            out[own] = np.where((truth == x)[:, None], wins, ~wins & (rival == truth)[:, None]).sum(0)
        return out


#: Candidates of each label, at most, and rows that meet them together.
POOL, STEP = 320, 512


def chosen_anchors(candidates: DataFrame, dev: DataFrame, per_label: int, k: int = 3, pool: int = POOL) -> DataFrame:
    """(step, label, row_id, accuracy): anchors added one by one, each time the candidate with which most rows of `dev`
    have the largest mean of their k largest cosines at their own label; the first of equal ones by label and place in a hash
    order, until every label has per_label anchors or no candidate left.

    Candidates are at most `pool` rows of each label by hash, and held in every task; dev rows may be any number, and
    none of them is a candidate unless it is in both tables. A step is one pass over the stored dev rows, in which a
    task counts hits for all candidates at once."""
    spark = candidates.sparkSession
    kind = dict(candidates.dtypes)
    some = stratified(candidates.where("label is not null and embedding is not null").select("label", "row_id", "embedding"), "label", pool)
    order = some.select("label", "row_id", unit(F.col("embedding").cast("array<double>")).alias("v"), hash_order("s:", F.col("row_id")).alias("h")).orderBy("label", "h", "row_id").collect()
    names = sorted({r.label for r in order})
    schema = f"step int, label {kind['label']}, row_id {kind['row_id']}, accuracy double"
    if not order:
        return spark.createDataFrame([], schema)
    labels, matrix = np.array([names.index(r.label) for r in order]), np.array([r.v for r in order])
    at = F.create_map(*(x for n, name in enumerate(names) for x in (F.lit(name), F.lit(n))))
    rows = dev.where("label is not null and embedding is not null").select(F.coalesce(F.try_element_at(at, F.col("label")), F.lit(-1)).alias("y"), unit(F.col("embedding").cast("array<double>")).alias("v"))
    places: list[int] = []
    found = []
    with stored(rows, "dev_rows") as kept:
        n = kept.count()
        while True:
            chosen = _Chosen(labels, k, list(places))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(len(labels), np.int64)
                for batch in batches:
                    for a in range(0, len(batch), STEP):
                        part = batch.slice(a, STEP)
                        v = np.asarray(part.column("v").flatten(), float).reshape(len(part), -1)
                        total += chosen.hits(np.round(v @ matrix.T, 12), part.column("y").to_numpy(), len(names))  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(labels))), pa.array(total)], ["c", "n"])

            may = [c for c in range(len(labels)) if c not in places and sum(labels[p] == labels[c] for p in places) < per_label]
            if not may:
                break
            hits = {r.c: r.n for r in kept.mapInArrow(run, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect()}
            best = max(may, key=lambda c: (hits.get(c, 0), -c))  # noqa: B023
            places.append(best)
            found.append((len(places), order[best].label, order[best].row_id, hits.get(best, 0) / n if n else None))
    return spark.createDataFrame(found, schema)
