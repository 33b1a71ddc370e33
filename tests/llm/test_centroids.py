"""Centroid clustering against brute force, and what cells tell."""

import hashlib
import math
import random

import numpy as np
import pytest

from gaugeworks.llm import centroids


def brute(rows):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept if i is not None)
    c = [v for _, _, v in first[:16]]
    gap = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    nearest = lambda v: min((gap(v, w), k) for k, w in enumerate(c))
    for _ in range(3):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        c = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else w for k, w in enumerate(c)]
    at = [(i, *nearest(v)) for i, v in kept]
    inside = {k: sum(d for _, d, j in at if j == k) for k in range(16)}
    return sorted(((i if i is not None else -1, k, d, inside[k], sum(inside.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, d, k in at))


def found(spark, rows, kind="float", **settings):
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], f"vec_id bigint, embedding array<{kind}>, cluster int, cells string").repartition(3)
    got = centroids.centroid_clusters(df, **settings)
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    return sorted((-1 if r.vec_id is None else r.vec_id, *r[1:]) for r in got.collect())


def vectors(n, seed, spread=0.1):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [[m + r.gauss(0, spread) for m in r.choice(middles)] for _ in range(n)]


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("bits", [2, 6])
@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_awkward_rows(spark, spread, bits):
    v = vectors(300, 1, spread)
    odd = [None, [], [0.5] * 63, [0.5] * 65, [0.5] * 63 + [None], [0.5] * 63 + [float("nan")], [float("inf")] + [0.5] * 63, [0.0] * 64, [-0.0] * 64, [-1e-9] * 64, [1e5] * 64, [-1e5] + [0.0] * 63]
    rows = as_floats([(k % 280, x) for k, x in enumerate(v)] + [(1000 + k, x) for k, x in enumerate(odd)] + [(None, v[0]), (None, v[1]), (7, v[7])] + [(5000 + k, v[3]) for k in range(100)])
    assert found(spark, rows, bits=bits) == brute(rows)


def test_doubles_are_taken_as_doubles(spark):
    rows = [(k, [x + 1e-12 * k for x in v]) for k, v in enumerate(vectors(60, 2))]
    assert found(spark, rows, "double") == brute(rows)


def test_few_equal_and_no_vectors(spark):
    few = as_floats(list(enumerate(vectors(5, 3))))
    assert found(spark, few) == brute(few)
    equal = [(k, [0.25] * 64) for k in range(40)]
    assert found(spark, equal) == brute(equal)
    assert found(spark, []) == found(spark, [(1, None), (2, [1.0])]) == found(spark, [(None, [1.0] * 64)]) == []


def test_components_that_need_more_than_64_bits_fail(spark):
    with pytest.raises(Exception, match="more than 64 bits"):
        found(spark, [(1, [1e30] * 64)])


def test_cells_hold_their_vectors_and_candidates_the_nearest():
    r = np.random.default_rng(4)
    v = np.floor(r.normal(0, 8, (5000, 64))).astype(np.int64)
    cells = centroids.Cells.fitted(len(v), v.sum(0), (v**2).sum(0), v.min(0), v.max(0), 6)
    c = cells.of(v)
    d = np.arange(64)
    assert (cells.low[d, c] <= v).all() and (v <= cells.high[d, c]).all() and len(np.unique(c)) > 50
    middles = v[:16]
    may = centroids.Intervals(cells, middles).candidates(c)
    nearest = ((v[:, None] - middles[None]) ** 2).sum(2).argmin(1)
    assert may[np.arange(len(v)), nearest].all()
    assert may.sum(1).mean() < 3
