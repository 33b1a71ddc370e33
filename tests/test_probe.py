"""Probes against a plain numpy solver, folds, centroids of the other folds."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import probe


def data(n, d, k, seed, spread=0.8):
    r = np.random.default_rng(seed)
    y = r.choice(k, n, p=np.arange(1, k + 1) / sum(range(1, k + 1)))
    return r.normal(0, 1, (k, d))[y] + r.normal(0, 1 / spread, (n, d)), y


def frame(spark, x, y, names=None):
    return spark.createDataFrame([(k, names[v] if names else int(v), e.tolist()) for k, (v, e) in enumerate(zip(y, x, strict=True))], f"row_id bigint, label {'string' if names else 'int'}, embedding array<double>").repartition(7)


def solved(x, y, k, strength=1.0, balanced=True):
    """Gradient descent with an exact line of Newton steps on the whole matrix, in plain numpy."""
    x = np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(len(x))]
    n = np.bincount(y, minlength=k)
    s = (len(y) / (k * n))[y] if balanced else np.ones(len(y))
    m = 1 if k == 2 else k
    w, eye = np.zeros(m * x.shape[1]), np.tile(np.r_[np.ones(x.shape[1] - 1), 0], m)
    for _ in range(60):
        z = x @ w.reshape(m, -1).T
        p = 1 / (1 + np.exp(-z)) if m == 1 else np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
        t = y[:, None] if m == 1 else np.eye(k)[y]
        g = strength * ((p - t) * s[:, None]).T @ x
        blocks = [[strength * (x.T * (s * p[:, i] * ((i == j) - p[:, j]))) @ x for j in range(m)] for i in range(m)]
        w = w - np.linalg.lstsq(np.block(blocks) + np.diag(eye), g.ravel() + eye * w, rcond=1e-12)[0]
    return w.reshape(m, -1)


@pytest.mark.parametrize(("k", "strength", "balanced"), [(2, 1.0, True), (2, 50.0, False), (4, 1.0, True), (3, 10.0, False)])
def test_weights_equal_a_plain_solver(spark, k, strength, balanced):
    x, y = data(400, 6, k, k)
    got = probe.fit_probe(frame(spark, x, y), strength, balanced)
    want = solved(x, y, k, strength, balanced)
    if k > 2:  # only differences of intercepts matter
        want[:, -1] -= want[:, -1].mean()
        got.weights[:, -1] -= got.weights[:, -1].mean()
    assert np.abs(got.weights - want).max() < 1e-6
    own = np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(len(x))] @ want.T
    found = (own[:, 0] > 0).astype(int) if k == 2 else own.argmax(1)
    labelled = frame(spark, x, y).withColumn("found", got.label(F.col("embedding"))).collect()
    assert all(r.found == found[r.row_id] for r in labelled)


def test_the_bound_in_place_of_the_hessian_gives_the_same_weights(spark, monkeypatch):
    x, y = data(120, 4, 3, 9)
    centred = lambda w: w - np.outer(np.ones(3), [0, 0, 0, 0, w[:, -1].mean()])
    want = centred(solved(x, y, 3, 0.2))
    monkeypatch.setattr(probe, "NEWTON", 1)
    monkeypatch.setattr(probe, "LEAST_GAIN", 1e-9)
    assert np.abs(centred(probe.fit_probe(frame(spark, x, y).coalesce(1), 0.2).weights) - want).max() < 1e-3


def fold_of(y, folds):
    out = np.empty(len(y), int)
    for v in set(y.tolist()):
        own = sorted(np.flatnonzero(y == v), key=lambda i: hashlib.md5(f"fold:{i}".encode()).hexdigest())
        out[own] = np.arange(len(own)) % folds
    return out


@pytest.mark.parametrize("k", [2, 3])
def test_cross_validation_equals_a_loop_over_folds(spark, k):
    x, y = data(230, 5, k, 3 + k)
    fold = fold_of(y, 5)
    names = [f"label {v}" for v in range(k)]
    got = {r.fold: r for r in probe.cross_validated(frame(spark, x, y, names)).collect()}
    assert len(got) == 5
    centroid_hits = 0
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for f in range(5):
        train, test = fold != f, fold == f
        w = solved(x[train], y[train], k)
        z = np.c_[unit[test], np.ones(test.sum())] @ w.T
        found = (z[:, 0] > 0).astype(int) if k == 2 else z.argmax(1)
        assert got[f].n == test.sum() and abs(got[f].accuracy - (found == y[test]).mean()) < 1e-9
        assert all(abs((y[test] == v).sum() - (y == v).sum() / 5) < 1 for v in range(k))
        means = np.stack([unit[train & (y == v)].mean(0) for v in range(k)])
        centroid_hits += (((unit[test] @ (means / np.linalg.norm(means, axis=1, keepdims=True)).T).argmax(1)) == y[test]).sum()
    both = probe.bake_off({"own": frame(spark, x, y, names)}).first()
    assert both.n == 230 and abs(both.anchors - centroid_hits / 230) < 1e-9
    assert abs(both.probe - sum(r.accuracy * r.n for r in got.values()) / 230) < 1e-9


def test_a_pass_for_each_step_and_nothing_kept(spark, monkeypatch, tmp_path):
    x, y = data(200, 5, 2, 1)
    passes = []
    own = probe._pass
    monkeypatch.setattr(probe, "_pass", lambda *a: passes.append(1) or own(*a))
    probe.cross_validated(frame(spark, x, y)).collect()
    assert len(passes) <= 9
    monkeypatch.undo()
    monkeypatch.setattr(probe, "FAN", 2)  # sums of tasks meet in several levels
    monkeypatch.setattr(probe, "PART", 64)
    assert probe.cross_validated(frame(spark, x, y)).count() == 5


def test_rows_that_can_not_be_fitted(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.5, 1.0]), (3, None, [1.0, 1.0]), (4, 1, None)], "row_id bigint, label int, embedding array<double>")
    assert probe.cross_validated(df).count() == 0 and probe.cross_validated(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        probe.fit_probe(df)
    assert probe.separability(df.where("row_id < 3"), df.where("false")).first().traffic == "UNMEASURED"
