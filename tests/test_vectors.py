"""Exact top cosines by blocks and bounds against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import vectors


def frames(spark, spread, n_queries=300, n_anchors=900, d=6):
    r = np.random.default_rng(int(spread * 100))
    middles = r.normal(0, 1, (12, d))
    q = middles[r.choice(12, n_queries)] + r.normal(0, spread, (n_queries, d))
    a = middles[r.choice(12, n_anchors)] + r.normal(0, spread, (n_anchors, d))
    y = r.choice(3, n_anchors, p=[0.7, 0.299, 0.001])
    y[:2], q[0] = 2, 0
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "row_id bigint, embedding array<double>").repartition(5)
    anchors = spark.createDataFrame([(k, f"l{b}", v.tolist()) for k, (b, v) in enumerate(zip(y, a, strict=True))], "row_id bigint, label string, embedding array<double>").repartition(5)
    return q, a, y, queries, anchors


@pytest.mark.parametrize("spread", [0.02, 2.0])
def test_blocks_and_bounds_lose_no_top_cosine(spark, spread, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    q, a, y, queries, anchors = frames(spark, spread)
    report = {}
    got = {(r.row_id, r.label): r.score for r in vectors.blocked_scores(queries, anchors.unionByName(anchors.limit(1).withColumn("embedding", F.lit(None))), 3, 40, report).collect()}
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    cosine = unit(q) @ unit(a).T
    assert len(got) == 300 * 3
    for i in range(300):
        for b in range(3):
            assert abs(got[i, f"l{b}"] - np.sort(cosine[i, y == b])[-3:].mean()) < 1e-9
    assert report["met"] < report["all"] * (0.5 if spread < 1 else 1.01)


def test_one_way_or_the_other_the_scores_are_the_same(spark, monkeypatch):
    _, _, _, queries, anchors = frames(spark, 0.5, 40, 60)
    few = {tuple(r)[:2]: r.score for r in vectors.anchor_scores(queries, anchors, 2).collect()}
    monkeypatch.setattr(vectors, "ANCHOR_BYTES", 100)
    many = {tuple(r)[:2]: r.score for r in vectors.anchor_scores(queries, anchors, 2).collect()}
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-9 for k in few)
    assert vectors.blocked_scores(queries, anchors.where("false")).count() == 0 and vectors.blocked_scores(queries.where("false"), anchors).count() == 0


@pytest.mark.parametrize(("k", "keep"), [(3, 0.9), (5, 0.5), (40, 0.9)])
def test_medoid_anchors_are_spread_over_what_is_near_the_centroid(spark, k, keep):
    _, a, y, _, anchors = frames(spark, 0.7, 5, 120)
    got = {}
    for r in vectors.medoid_anchors(anchors, k, keep).collect():
        got.setdefault(r.label, set()).add(r.row_id)
    unit = a / np.linalg.norm(a, axis=1, keepdims=True)
    for b in np.unique(y):
        own = np.flatnonzero(y == b)
        centre = unit[own].mean(0)
        cosine = np.round(unit[own] @ (centre / np.linalg.norm(centre)), 12)
        order = own[np.lexsort((own, -cosine))]
        kept = max(int(len(own) * keep), min(k, len(own)))
        step = max(kept // k, 1)
        assert got[f"l{b}"] == set(order[:kept:step][:k].tolist())


@pytest.mark.parametrize("held", [1, 700, 1 << 20])
def test_cosines_are_held_in_parts(monkeypatch, held):
    import tracemalloc

    monkeypatch.setattr(vectors, "HELD", held)
    r = np.random.default_rng(3)
    q, a = r.normal(size=(90, 5)), r.normal(size=(40, 5))
    for k in (1, 3, 40, 50):
        assert np.allclose(vectors._top_cosines(q, a, k), np.sort(q @ a.T, 1)[:, -k:], atol=1e-12)
    if held > 700:
        q, a = r.normal(size=(10_000, 4)), r.normal(size=(5_000, 4))
        tracemalloc.start()
        vectors._top_cosines(q, a, 3)
        assert tracemalloc.get_traced_memory()[1] < 64 << 20  # of 400 MB for all of them
        tracemalloc.stop()
