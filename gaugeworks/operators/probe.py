"""Linear probes: class-balanced logistic regression on unit vectors, all folds fitted side by side; separability.

The fit minimises half the squared weights plus `strength` times the weighted log loss; the intercept is free. Each Newton
step is one pass over the stored rows: a task adds up loss, gradient and Hessian for all folds at once, and counts the
hits among each fold's held-out rows, so the last pass gives the accuracy too. Five to eight passes do. Beyond NEWTON unknowns
the Hessian gives way to its fixed bound, the rows' weighted products, with more and cheaper passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.probs import dot, unit
from gaugeworks.functions.text import hash_order
from gaugeworks.operators.sampling import hash_rank, within_quota
from gaugeworks.stored import stored

#: Unknowns of one fold up to which the whole Hessian is added up (8 MB of sums for a fold).
NEWTON = 1000
STEPS, BOUND_STEPS = 30, 300
#: Rows whose products are computed together, bytes of sums in a row, and tasks whose sums meet in one.
ROWS, PART, FAN = 2048, 1 << 20, 32
#: A fold is done when a step can lower its loss by no more than this.
LEAST_GAIN = 1e-15


def with_folds(rows: DataFrame, folds: int, key: str = "row_id", label: str = "label", seed: str = "fold:") -> DataFrame:
    """rows with `fold`: the rows of each label dealt round in the order of a hash, so that folds hold equal parts of every
    label."""
    return hash_rank(rows, [label], key, seed).withColumn("fold", F.pmod(F.col("rank"), F.lit(folds)).cast("int")).drop("rank")


@dataclass
class Probe:
    """A fitted probe: a row of weights and an intercept for each label, or one row for the second of two labels."""

    labels: list
    weights: np.ndarray

    def label(self, embedding: Column) -> Column:
        """The label of an embedding, the first of equal scores."""
        scores = [dot(unit(embedding), F.lit([float(x) for x in w[:-1]])) + float(w[-1]) for w in self.weights]
        names = F.array(*map(F.lit, self.labels))
        if len(scores) == 1:
            return F.when(scores[0] > 0, names[1]).otherwise(names[0])
        best = F.array_max(F.array(*(F.struct(s.alias("s"), F.lit(-k).alias("k"), names[k].alias("label")) for k, s in enumerate(scores))))
        return best["label"]


@dataclass
class _Sums:
    loss: float
    hits: float
    tests: float
    gradient: np.ndarray
    curve: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, shape: tuple[int, int]) -> _Sums:
        size = shape[0] * shape[1]
        side = int(round((len(flat) - 3 - size) ** 0.5))
        return cls(*map(float, flat[:3]), flat[3 : 3 + size].reshape(shape), flat[3 + size :].reshape(side, side))


def _task_sums(x: np.ndarray, y: np.ndarray, held: np.ndarray, weights: np.ndarray, balance: np.ndarray, newton: bool) -> np.ndarray:
    """Loss, hits, held-out rows, gradient and curvature of some rows for one fold; held tells its held-out rows."""
    scores = x @ weights.T
    s = balance[y] * ~held
    if len(weights) == 1:
        z = scores[:, 0]
        found = (z > 0).astype(int)
        loss = np.logaddexp(0, z) - z * y
        p = np.exp(-np.logaddexp(0, -z))[:, None]
        slope = p - y[:, None]
    else:
        found = scores.argmax(1)
        top = scores.max(1, keepdims=True)
        log_p = scores - top - np.log(np.exp(scores - top).sum(1, keepdims=True))
        p = np.exp(log_p)
        loss = -log_p[np.arange(len(y)), y]
        slope = p.copy()
        slope[np.arange(len(y)), y] -= 1
    gradient = (slope * s[:, None]).T @ x
    if newton:
        m, d = weights.shape
        curve = np.zeros((m, d, m, d))
        for j in range(m):
            for k in range(j + 1):
                w = s * p[:, j] * ((1.0 if j == k else 0.0) - p[:, k])
                curve[j, :, k, :] = curve[k, :, j, :] = (x * w[:, None]).T @ x
        curve = curve.reshape(m * d, m * d)
    else:
        curve = (x * s[:, None]).T @ x / (4 if len(weights) == 1 else 2)
    return np.concatenate([[(s * loss).sum(), (held & (found == y)).sum(), held.sum()], gradient.ravel(), curve.ravel()])


def _add_up(packed: DataFrame, tasks: int) -> list:
    """Rows (fold, part, task, sums) with equal fold and part added up, FAN tasks at a time."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.column("sums").to_pylist()
        whole = np.frombuffer(rows[0], float).copy()
        for r in rows[1:]:
            whole += np.frombuffer(r, float)
        return pa.table({"fold": [key[0].as_py()], "part": [key[1].as_py()], "task": [key[2].as_py()], "sums": pa.array([whole.tobytes()], pa.binary())}, schema=pa.schema([("fold", pa.int32()), ("part", pa.int32()), ("task", pa.int32()), ("sums", pa.binary())]))

    while tasks > 1:
        packed = packed.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("fold", "part", "task").applyInArrow(add, packed.schema)
        tasks = -(-tasks // FAN)
    return packed.collect()


def _pass(rows: DataFrame, weights: list[np.ndarray], balance: np.ndarray, which: list[int], newton: bool) -> dict[int, _Sums]:
    """The sums of the folds in `which` over all rows (fold, y, v); balance has a weight for each fold and class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                x = np.asarray(part.column("v").flatten(), float).reshape(len(part), -1)
                x = np.concatenate([x, np.ones((len(x), 1))], 1)
                y, fold = part.column("y").to_numpy(), part.column("fold").to_numpy()
                for f in which:
                    got = _task_sums(x, y, fold == f, weights[f], balance[f], newton)
                    total[f] = total[f] + got if f in total else got
        out = [(f, k, s[a : a + PART // 8].tobytes()) for f, s in total.items() for k, a in enumerate(range(0, len(s), PART // 8))]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _, _ in out], pa.int32()), pa.array([k for _, k, _ in out], pa.int32()), pa.array([task] * len(out), pa.int32()), pa.array([s for _, _, s in out], pa.binary())], ["fold", "part", "task", "sums"])

    packed = rows.mapInArrow(run, "fold int, part int, task int, sums binary")
    parts: dict[int, dict[int, bytes]] = {}
    for r in _add_up(packed, rows.rdd.getNumPartitions()):
        parts.setdefault(r.fold, {})[r.part] = r.sums
    return {f: _Sums.of(np.frombuffer(b"".join(own[k] for k in sorted(own))), weights[f].shape) for f, own in parts.items()}


def _fitted(rows: DataFrame, folds: list[int], balance: np.ndarray, shape: tuple[int, int], strength: float) -> tuple[dict[int, np.ndarray], dict[int, _Sums]]:
    """Weights of each fold's probe, and the sums at those weights. A fold takes no part in passes once it is done."""
    newton = shape[0] * shape[1] <= NEWTON
    weights = [np.zeros(shape) for _ in range(max(folds) + 1)]
    free = np.ones(shape[1])
    free[-1] = 0  # the intercept isn't penalised
    best: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}  # loss, weights and step of each fold's best place
    done: dict[int, _Sums] = {}
    for _ in range(STEPS if newton else BOUND_STEPS):
        left = [f for f in folds if f not in done]
        if not left:
            break
        for f, sums in _pass(rows, weights, balance, left, newton).items():
            w = weights[f]
            loss = strength * sums.loss + 0.5 * (w * w * free).sum()
            if f in best and loss > best[f][0] * (1 + 1e-12):  # too far: half the way
                _, w, step = best[f]
                best[f] = (best[f][0], w, step / 2)
                weights[f] = w - step / 2
                continue
            gradient = strength * sums.gradient + w * free
            if newton:
                curve = strength * sums.curve + np.diag(np.tile(free + (1 - free) * 1e-9, shape[0]))
                step = np.linalg.solve(curve, gradient.ravel()).reshape(shape)
            else:
                step = np.linalg.solve(strength * sums.curve + np.diag(free + (1 - free) * 1e-9), gradient.T).T
            best[f] = (loss, w, step)
            if (gradient * step).sum() <= LEAST_GAIN * max(1.0, loss):
                done[f] = sums
            else:
                weights[f] = w - step
    if len(done) < len(folds):
        raise ValueError(f"the probe's fit did not settle in {STEPS if newton else BOUND_STEPS} steps")
    return {f: best[f][1] for f in folds}, done


def _prepared(rows: DataFrame, folds: int) -> DataFrame:
    usable = rows.where("label is not null and embedding is not null").select("row_id", "label", F.col("embedding").alias("_e"))
    placed = with_folds(usable, folds) if folds > 1 else usable.withColumn("fold", F.lit(-1))
    return placed.select("fold", "label", unit(F.col("_e").cast("array<double>")).alias("v"))


def _fit(rows: DataFrame, folds: int, strength: float, balanced: bool) -> tuple[list, dict[int, np.ndarray], dict[int, _Sums]]:
    with stored(_prepared(rows, folds), "probe_rows") as kept:
        counts = kept.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).collect()
        labels = sorted({r.label for r in counts})
        if len(labels) < 2:
            return labels, {}, {}
        which = list(range(folds)) if folds > 1 else [0]
        n = np.array([[sum(r.n for r in counts if r.label == x and r.fold != f) for x in labels] for f in which], float)
        balance = n.sum(1, keepdims=True) / (len(labels) * np.maximum(n, 1)) if balanced else np.ones_like(n)
        shape = (1 if len(labels) == 2 else len(labels), max(r.d for r in counts) + 1)
        at = F.create_map(*(x for k, name in enumerate(labels) for x in (F.lit(name), F.lit(k))))
        numbered = kept.select("fold", F.element_at(at, F.col("label")).alias("y"), "v")
        return labels, *_fitted(numbered, which, balance, shape, strength)


def fit_probe(rows: DataFrame, strength: float = 1.0, balanced: bool = True) -> Probe:
    """A probe of rows (row_id, label, embedding); strength is the inverse of the penalty."""
    labels, weights, _ = _fit(rows, 1, strength, balanced)
    if not weights:
        raise ValueError("a probe needs rows of two labels at least")
    return Probe(labels, weights[0])


def cross_validated(rows: DataFrame, folds: int = 5, strength: float = 1.0, balanced: bool = True) -> DataFrame:
    """(fold, n, accuracy) of probes fitted on the rows of the other folds; no rows without two labels."""
    _, _, sums = _fit(rows, folds, strength, balanced)
    found = [(f, int(s.tests), s.hits / s.tests if s.tests else None) for f, s in sorted(sums.items())]
    return rows.sparkSession.createDataFrame(found, "fold int, n bigint, accuracy double")


def separability(live: DataFrame, reference: DataFrame, folds: int = 5) -> DataFrame:
    """One row: how well a probe tells two corpora of embeddings apart, on equal numbers of rows; 0.5 is not at all."""
    n = min(live.count(), reference.count())
    quota = live.sparkSession.createDataFrame([(0, n)], "_all int, quota bigint")

    def take(df: DataFrame, y: int) -> DataFrame:
        """n rows by hash, which stay where they are: nothing is sorted in one task."""
        some = within_quota(df.withColumn("_all", F.lit(0)), ["_all"], hash_order("d:", F.col("row_id")), "row_id", quota).where("in_quota")
        return some.select(F.concat(F.lit(f"{y}:"), F.col("row_id").cast("string")).alias("row_id"), F.lit(y).alias("label"), "embedding")

    scores = cross_validated(take(live, 0).unionByName(take(reference, 1)), folds)
    out = scores.agg(F.avg("accuracy").alias("separability"))
    s = F.col("separability")
    return out.withColumn("traffic", F.when(s.isNull(), "UNMEASURED").when(s < 0.70, "ALIGNED").when(s < 0.90, "DRIFTED").otherwise("OFF_DISTRIBUTION"))


def centroid_hits(rows: DataFrame, folds: int = 5) -> DataFrame:
    """One row (n, anchors): how often a row's nearest centroid, of the rows of the other folds, is its label's. Sums of
    each label and fold tell the centroids without any fold, in one pass; a second one compares."""
    with stored(_prepared(rows, folds), "centroid_rows") as kept:
        long = kept.select("label", "fold", F.posexplode("v").alias("pos", "x")).groupBy("label", "fold", "pos").agg(F.sum("x").alias("x"))
        sums = long.groupBy("label", "fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("x")).collect()
        labels = sorted({r.label for r in sums})
        own = {(r.label, r.fold): np.array(r.x) for r in sums}
        unit_of = lambda x: x / max(np.linalg.norm(x), 1e-12)
        rest = {}
        for f in range(folds):
            for x in labels:
                others = [v for (label, fold), v in own.items() if label == x and fold != f]
                rest[f, x] = np.sum(others, axis=0) if others else None
        hit = F.lit(False)
        for f in range(folds):
            scores = [F.struct(F.round(dot(F.col("v"), F.lit([float(a) for a in unit_of(rest[f, x])])), 12).alias("s"), F.lit(-k).alias("k"), F.lit(x).alias("label")) for k, x in enumerate(labels) if rest[f, x] is not None]
            if scores:
                hit = F.when(F.col("fold") == f, F.array_max(F.array(*scores))["label"] == F.col("label")).otherwise(hit)
        return rows.sparkSession.createDataFrame(kept.agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("anchors")).collect(), "n bigint, anchors double")


def bake_off(sets: dict[str, DataFrame], folds: int = 5) -> DataFrame:
    """(encoder, n, probe, anchors) of several encoders' embeddings of the same rows: cross-validated accuracy of a probe,
    and accuracy by the nearest centroid of the rows of other folds."""
    out = None
    for name, rows in sets.items():
        probe = cross_validated(rows, folds).agg((F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("probe"))
        row = centroid_hits(rows, folds).join(probe, F.lit(True)).select(F.lit(name).alias("encoder"), "n", "probe", "anchors")
        out = row if out is None else out.unionByName(row)
    return out


def reproduced(found: DataFrame, published: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(metric, found, published, delta, same): measured metrics against published ones, by name."""
    both = found.select("metric", F.col("value").alias("found")).join(published.select("metric", F.col("value").alias("published")), "metric", "full")
    delta = F.col("found") - F.col("published")
    return both.withColumn("delta", delta).withColumn("same", F.coalesce(F.abs(delta) < tolerance, F.lit(False)))
