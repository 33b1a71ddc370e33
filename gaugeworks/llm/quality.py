"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Method: a text is a vector of hashed byte trigrams, log(1 + count) times inverse document frequency over all
documents, at unit length, and one more coordinate: the share of its three-word shingles that repeat earlier ones. The
vectors of a bounded sample of labelled rows (SAMPLE of each label at most) give, by singular value decomposition, a
latent space of RANK dimensions. The labelled vectors in that space are broadcast (SAMPLE * 2 * RANK numbers at most).
Every document, block by block, gets its exact cosine with each of them, and the NEIGHBOURS nearest vote with a weight
that grows with their similarity. Vectors are whole multiples of 1 / UNIT, so that sums of products are exact in
doubles and a text's score doesn't depend on the texts beside it; of equally near neighbours the lower doc_id counts.

Defined results: null and empty texts, and texts of under three bytes, have no direction and get the share of label 1
among the training rows; a row labelled both ways is not learnt from; of several texts of a labelled id that of least
hash is learnt; repeated rows get equal scores; with no usable label every score is 0.5; an empty table gives an empty
table; columns named like a result are replaced, all others kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import Words, packed, slices

FEATURES = 4096
RANK = 64
#: The most labelled rows of each label that are learnt from, those of least hash.
SAMPLE = 1024
NEIGHBOURS = 25
#: Rows of one block of cosine products.
BLOCK = 512
#: The greatest value of the coordinate for repetition, beside a unit vector.
REPETITION = 2.0
#: Coordinates are whole multiples of 1 / UNIT: products of two sum exactly in doubles.
UNIT = 1 << 20
#: A neighbour's weight is its cosine to this power.
SHARPNESS = 4


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, FEATURES) counts of hashed byte trigrams."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, FEATURES), np.int64)
    code = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
    feature = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(n), lengths)[:-2]
    inside = np.repeat(offsets[1:], lengths)[:-2] - np.arange(len(doc)) >= 3
    return np.bincount((doc * FEATURES + feature)[inside], minlength=n * FEATURES).reshape(n, FEATURES)


def repetition(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The share of each document's three-word shingles that are not its first of their kind."""
    value, doc = Words(data, offsets).shingles(3)
    n = len(offsets) - 1
    order = np.argsort(value ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    value, doc = value[order], doc[order]
    again = (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[1:][again], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)


_LOGS = np.log1p(np.arange(1 << 16))


def _whole(x: np.ndarray) -> np.ndarray:
    """Rows at length UNIT, rounded to whole numbers; zero rows stay zero. Rows of whole numbers of up to 2 ** 20 have
    exact squared lengths, so a row's result depends on itself alone."""
    return np.rint(x * (UNIT / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1.0))[:, None])


def vectors(counts: np.ndarray, repeated: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(documents, FEATURES + 1) whole numbers, in units of 1 / UNIT."""
    x = np.rint(_LOGS[np.minimum(counts, len(_LOGS) - 1)] * idf * 1024)
    return np.concatenate([_whole(x), np.rint(REPETITION * UNIT * repeated)[:, None]], 1)


def latent(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors (in units of 1 / UNIT) in the space of axes (likewise)."""
    return _whole(np.rint(x @ axes / UNIT))


def blocks_of(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, column):
        for k in range(0, len(part), BLOCK):
            yield part.slice(k, BLOCK)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(offsets) - 1, self.prior)
        products = latent(vectors(trigram_counts(data, offsets), repetition(data, offsets), self.idf), self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        # one number orders neighbours by product, then by their place, which follows doc_id
        order = products * 4096 + np.arange(len(self.labels), 0, -1)
        near = np.argpartition(-order, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(order, near, 1), axis=1), 1)
        votes, weights = np.zeros(len(products)), np.zeros(len(products))
        for j in range(k):  # in order, so that equal rows have equal sums
            weight = np.maximum(products[np.arange(len(products)), near[:, j]] / UNIT**2, 0) ** SHARPNESS
            votes += weight * self.labels[near[:, j]]
            weights += weight
        return (votes + 1e-6 * self.prior) / (weights + 1e-6)


def document_frequencies(df: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, over all of them; FEATURES rows reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for block in blocks_of(batch, column):
                total += (trigram_counts(*packed(block, column)) > 0).sum(0)
                n += len(block)
        yield pa.RecordBatch.from_arrays([pa.array([*range(FEATURES), -1]), pa.array([*total.tolist(), n])], ["feature", "n"])

    rows = df.select(column).mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(FEATURES, np.int64)
    for r in rows:
        if r.feature >= 0:
            found[r.feature] = r.n
    return found, next((r.n for r in rows if r.feature < 0), 0)


def labelled_sample(labels: DataFrame, key: str, label: str) -> DataFrame:
    """At most SAMPLE rows of each label among those that may be learnt from, whatever the table's size."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
    rows = rows.groupBy(key).agg(F.min(label).alias("label"), F.max(label).alias("_most")).where("label = _most").drop("_most")
    parts = [rows.where(F.col("label") == y).orderBy(F.xxhash64(key), key).limit(SAMPLE) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit(df: DataFrame, labels: DataFrame, column: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    found, n = document_frequencies(df, column)
    idf = np.log((1 + n) / (1 + found)) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch, column):
                counts = trigram_counts(*packed(block, column))
                seen = [np.flatnonzero(c) for c in counts]  # most features of a text are 0
                at = pa.array([a.astype("<u2").tobytes() for a in seen], pa.binary())
                n = pa.array([np.minimum(c[a], 65535).astype("<u2").tobytes() for c, a in zip(counts, seen, strict=True)], pa.binary())
                columns = [block.column("label"), block.column(key), at, n, pa.array(repetition(*packed(block, column)))]
                yield pa.RecordBatch.from_arrays(columns, ["label", key, "at", "n", "repeated"])

    sample = F.broadcast(labelled_sample(labels, key, label))
    texts = df.select(key, column).join(sample, key).groupBy(key).agg(F.min("label").alias("label"), F.min_by(column, F.xxhash64(column)).alias(column)).select("label", key, column)
    rows = texts.mapInArrow(run, f"label int, {key} bigint, at binary, n binary, repeated double").orderBy(key).toArrow()  # 2 * SAMPLE rows at most
    y = rows.column("label").to_numpy().astype(float)
    if not len(y):
        return Model(idf, np.zeros((FEATURES + 1, RANK)), np.zeros((0, RANK)), y, 0.5)
    x = np.empty((len(y), FEATURES + 1), np.float32)
    at, n, repeated = rows.column("at"), rows.column("n"), rows.column("repeated").to_numpy()
    for k in range(len(y)):
        counts = np.zeros((1, FEATURES), np.int64)
        counts[0, np.frombuffer(at[k].as_py(), "<u2")] = np.frombuffer(n[k].as_py(), "<u2")
        x[k] = vectors(counts, repeated[k : k + 1], idf)[0] / UNIT
    axes = np.rint(latent_axes(x) * float(UNIT))
    own = np.concatenate([latent(np.rint(x[k : k + 64].astype(float) * UNIT), axes) for k in range(0, len(x), 64)])
    return Model(idf, axes, own, y, float(y.mean()))


def latent_axes(x: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of x, by randomised iteration from a fixed start."""
    rank = min(RANK + 16, *x.shape)
    basis = np.linalg.qr(x @ np.random.default_rng(0).standard_normal((x.shape[1], rank), np.float32))[0]
    for _ in range(6):
        basis = np.linalg.qr(x @ (x.T @ basis))[0]
    return np.ascontiguousarray(np.linalg.svd(basis.T @ x, full_matrices=False)[2][:RANK].T, float)


def score_quality(df: DataFrame, model: Model, column: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
    """Add `out`: 0 to 1, higher where label 1 is likelier."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch, column):
                score = shared.value.scores(*packed(block, column))
                names = [c for c in block.schema.names if c.lower() != out.lower() and (keep_text or c != column)]
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), pa.array(np.clip(score, 0, 1))], [*names, out])

    fields = [f for f in df.schema.fields if f.name.lower() != out.lower() and (keep_text or f.name != column)]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))
