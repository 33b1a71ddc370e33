"""Centroid clustering with a VA-file: vectors as few-bit cells, distance intervals by lookup tables, exact distances
only where intervals overlap.

Method. Vectors become integers, floor(64 * x). Each dimension is cut into 2**BITS cells, at the quantiles of a normal
distribution with the dimension's mean and deviation; the outermost cells end at its least and largest value. The cells
of a vector (a byte for each dimension) are stored beside it. For a set of centroids, a table gives each dimension,
cell and centroid the least and largest share in the distance, and a vector's shares are added up to an interval for
each centroid. Centroids whose interval begins after another one's end can't be nearest. One left is the vector's;
otherwise the vector itself is decoded, and its exact distances to those left decide.

Centroids lie near each other in such data, so intervals of whole distances nearly always overlap. What is common to all
centroids is left out therefore: intervals are those of the distance less the distance to the centroids' mean, which
orders centroids alike and is as wide as the centroid is far from the mean, not as the vector is long. On
random vectors of 64 components 6 bits leave 1.7 of 16 centroids, where intervals of whole distances leave 13.

A round is one pass over the stored cells and vectors, without a shuffle of either: the first adds up all vectors of a
cluster, later ones only those that moved, which the cells tell under the centroids before and after. A batch decodes
only the vectors that it needs; Spark can't seek single rows of a file, so the bytes of the others are read all the same.
Tasks send sums; the driver holds the centroids, `clusters` vectors of 64 integers.

Defined results: vectors that are null, of another length, or with a null or non-finite component have no row; a
null vec_id is clustered but starts no centroid; rows of equal vec_id are vectors of their own, and start centroids in
the order of their components; fewer vectors than centroids give as many centroids as there are vectors; without a
vector that has an id nothing starts, and there are no rows; an empty table gives an empty table; other columns aren't kept. A component beyond 2**27 / 64 fails the task, as distances
then need more than 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import discard, materialise

DIMS = 64
BITS = 6
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
LARGEST = 1 << 27
#: Vectors whose intervals are computed together.
STEP = 2048


def usable(column: str = "embedding") -> Column:
    """Whether a vector has DIMS components, all of them finite numbers."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(column) == DIMS) & ~odd, F.lit(False))


def whole_numbers(column: pa.Array) -> np.ndarray:
    """floor(64 * x) of each component, a row for each vector."""
    x = np.floor(np.asarray(column.flatten(), np.float64).reshape(-1, DIMS) * SCALE)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST // SCALE}: distances need more than 64 bits")
    return x.astype(np.int64)


# ---- cells -------------------------------------------------------------------------------------------------------


@dataclass
class Cells:
    """Where each dimension is cut: cell j of dimension d holds low[d, j] to high[d, j], both included."""

    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fitted(cls, n: int, total: np.ndarray, squares: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int) -> Cells:
        mean = total / n
        spread = np.sqrt(np.maximum(squares / n - mean**2, 0))
        z = np.array([NormalDist().inv_cdf(k / (1 << bits)) for k in range(1, 1 << bits)])
        cuts = np.clip(np.floor(mean[:, None] + spread[:, None] * z), least[:, None], most[:, None]).astype(np.int64)
        return cls(np.concatenate([least[:, None], cuts + 1], 1), np.concatenate([cuts, most[:, None]], 1))

    def of(self, v: np.ndarray) -> np.ndarray:
        """The cell of each component, a byte each."""
        out = np.empty(v.shape, np.uint8)
        for d in range(DIMS):
            out[:, d] = np.searchsorted(self.high[d, :-1], v[:, d], "left")
        return out


def fitted_cells(vectors: DataFrame, bits: int = BITS) -> Cells | None:
    """Cells from each dimension's mean, deviation and ends over all vectors; None without vectors. A task sends a row a
    dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(DIMS), np.zeros(DIMS)
        least, most = np.full(DIMS, LARGEST), np.full(DIMS, -LARGEST)
        for batch in batches:
            v = whole_numbers(batch.column("embedding"))
            if len(v):
                n, total, squares = n + len(v), total + v.sum(0), squares + (v.astype(float) ** 2).sum(0)
                least, most = np.minimum(least, v.min(0)), np.maximum(most, v.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(DIMS), np.full(DIMS, n), total, squares, least, most)], ["d", "n", "total", "squares", "least", "most"])

    sent = vectors.select("embedding").mapInArrow(run, "d bigint, n bigint, total double, squares double, least bigint, most bigint")
    rows = sorted(sent.groupBy("d").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most")).collect())
    return Cells.fitted(rows[0].n, *(np.array([r[k] for r in rows]) for k in ("total", "squares", "least", "most")), bits) if rows else None


def stored_vectors(vectors: DataFrame, cells: Cells) -> DataFrame:
    """(vec_id, cells, v): a byte a cell, and the integers packed as little-endian 32-bit ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = whole_numbers(batch.column("embedding"))
            packed = [r.tobytes() for r in v.astype("<i4")]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in cells.of(v)], pa.binary()), pa.array(packed, pa.binary())], ["vec_id", "cells", "v"])

    return materialise(vectors.mapInArrow(run, "vec_id bigint, cells binary, v binary"), "vectors")


# ---- the nearest centroid ----------------------------------------------------------------------------------------


class Intervals:
    """Finds the nearest of some centroids (rows of integers) by cells, and by vectors where cells don't tell."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        self.centroids = centroids
        middle = np.round(centroids.mean(0)).astype(np.int64)
        slope = -2 * (centroids - middle)  # of (x - c)**2 - (x - m)**2 in x
        base = centroids**2 - middle**2
        ends = [x[:, :, None] * slope.T[:, None, :] for x in (cells.low, cells.high)]  # dimension, cell, centroid
        self.least = np.minimum(*ends) + base.T[:, None, :]
        self.most = np.maximum(*ends) + base.T[:, None, :]

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Which centroids may be nearest, for each row of cells."""
        low, high = (np.zeros((len(cells), len(self.centroids)), np.int64) for _ in range(2))
        for d in range(DIMS):
            low += self.least[d][cells[:, d]]
            high += self.most[d][cells[:, d]]
        return low <= high.min(1, keepdims=True)

    def nearest(self, cells: np.ndarray, fetch: _Fetch) -> np.ndarray:
        """The nearest centroid of each row, the smaller number of equally near ones."""
        out = np.empty(len(cells), np.int64)
        for a in range(0, len(cells), STEP):
            may = self.candidates(cells[a : a + STEP])
            out[a : a + STEP] = may.argmax(1)
            open_ = np.flatnonzero(may.sum(1) > 1)
            row, c = np.nonzero(may[open_])
            distance = np.full((len(open_), len(self.centroids)), np.iinfo(np.int64).max)
            distance[row, c] = ((fetch(a + open_)[row] - self.centroids[c]) ** 2).sum(1)
            out[a + open_] = distance.argmin(1)
        return out


class _Fetch:
    """Decodes the vectors of a batch's rows, those asked for only."""

    def __init__(self, column: pa.Array):
        self.column, self.fetched = column, 0

    def __call__(self, rows: np.ndarray | slice) -> np.ndarray:
        some = self.column.to_pylist() if isinstance(rows, slice) else self.column.take(pa.array(rows)).to_pylist()
        self.fetched += len(some)
        return np.frombuffer(b"".join(some), "<i4").astype(np.int64).reshape(-1, DIMS)


def _cells_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(-1, DIMS)


def _cluster_sums(stored: DataFrame, cells: Cells, now: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of each cluster of `now`, and their sum; with `before`, what both are more than in the clusters of
    `before`, from the vectors that moved."""
    k = len(now)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = np.zeros(k, np.int64), np.zeros((k, DIMS), np.int64)
        after, prior = Intervals(cells, now), None if before is None else Intervals(cells, before)
        for batch in batches:
            c, fetch = _cells_of(batch), _Fetch(batch.column("v"))
            to = after.nearest(c, fetch)
            rows, moves = slice(None), [(to, 1)]
            if prior is not None:
                of = prior.nearest(c, fetch)
                rows = np.flatnonzero(of != to)
                moves = [(to[rows], 1), (of[rows], -1)]
            v = fetch(rows)
            for at, sign in moves:
                np.add.at(size, at, sign)
                np.add.at(total, at, sign * v)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), DIMS + 1)), pa.array(np.tile(np.arange(DIMS + 1), k)), pa.array(np.concatenate([size[:, None], total], 1).ravel())], ["cluster", "d", "x"])

    out = np.zeros((k, DIMS + 1), np.int64)
    for r in stored.mapInArrow(run, "cluster bigint, d bigint, x bigint").groupBy("cluster", "d").agg(F.sum("x").alias("x")).collect():
        out[r.cluster, r.d] = r.x
    return out[:, 0], out[:, 1:]


def _assigned(stored: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intervals = Intervals(cells, centroids)
        for batch in batches:
            fetch = _Fetch(batch.column("v"))
            cluster = intervals.nearest(_cells_of(batch), fetch)
            distance = ((fetch(slice(None)) - centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return stored.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def starting_centroids(stored: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose `1:<vec_id>` has the smallest sha256, in ascending order."""
    first = stored.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("hash"), "v").where("hash is not null")
    rows = first.orderBy("hash", F.hex("v")).limit(clusters).collect()
    return np.array([np.frombuffer(r.v, "<i4") for r in rows], np.int64).reshape(-1, DIMS)


def centroid_clusters(df: DataFrame, column: str = "embedding", key: str = "vec_id", clusters: int = CLUSTERS, rounds: int = ROUNDS, bits: int = BITS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector: its cluster after
    `rounds` rounds of assigning and averaging, and the squared distance to its centroid."""
    spark = df.sparkSession
    vectors = df.where(usable(column)).select(F.col(key).cast("bigint").alias("vec_id"), F.col(column).alias("embedding"))
    nothing = spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    cells = fitted_cells(vectors, bits)
    if cells is None:
        return nothing
    stored = stored_vectors(vectors, cells)
    now, before = starting_centroids(stored, clusters), None
    if not len(now):  # all ids are null
        return nothing
    size = total = 0
    for _ in range(rounds):
        more, added = _cluster_sums(stored, cells, now, before)
        size, total = size + more, total + added
        before, now = now, np.where(size[:, None] > 0, total // np.maximum(size, 1)[:, None], now)
    found = materialise(_assigned(stored, cells, now), "clusters")
    discard(stored)
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    about = [(inertia.get(k, 0), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(now.tolist())]
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return found.select("vec_id", "cluster", "distance", of([a for a, _ in about]).cast("bigint").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), of([h for _, h in about]).alias("centroid_sha256"))
