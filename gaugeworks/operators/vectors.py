"""Embeddings: anchors, centroids, medoids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import ExitStack, contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.operators.sampling import stratified
from gaugeworks.functions.probs import unit
from gaugeworks.stored import shared_folder, stored

#: Anchors go to every task up to this many and this many bytes of numbers, after a check; more are joined in blocks.
ANCHORS, ANCHOR_BYTES = 131_072, 64 << 20
#: Rows of a block of queries or of anchors, and pairs of blocks that a task is given at once.
BLOCK, PAIRS = 1024, 16
#: Cosines that a task holds at once.
HELD = 1 << 20


def _matrix(column: pa.ListArray) -> np.ndarray:
    """A row for each vector; the numbers aren't copied."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _top_cosines(q: np.ndarray, a: np.ndarray, k: int) -> np.ndarray:
    """Each query's k largest cosines with the anchors, or all if fewer, ascending; HELD cosines are computed at a time."""
    k = min(k, len(a))
    step = max(1, HELD // len(a))
    return np.concatenate([np.sort(np.partition(q[at : at + step] @ a.T, len(a) - k, axis=1)[:, len(a) - k :], 1) for at in range(0, len(q), step)])


def _scores(queries: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(row_id, label, score) by blocked products in tasks; anchors is a bounded list."""
    rows = anchors.where("embedding is not null").select("label", unit(F.col("embedding")).alias("v")).toArrow().combine_chunks()
    kept, at = rows.column("label"), np.array(rows.column("label").to_pylist(), object)
    vectors = _matrix(rows.column("v").combine_chunks()) if len(rows) else np.zeros((0, 0))
    mats = {x: vectors[at == x] for x in sorted(set(at))}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch.column("v"))
            for x, a in mats.items():
                columns = [batch.column("row_id"), pa.array([x] * len(q), kept.type), pa.array(_top_cosines(q, a, k).mean(1))]
                yield pa.RecordBatch.from_arrays(columns, ["row_id", "label", "score"])

    kind = dict(anchors.dtypes)["label"]
    return queries.where("embedding is not null").select("row_id", unit(F.col("embedding")).alias("v")).mapInArrow(run, f"row_id {dict(queries.dtypes)['row_id']}, label {kind}, score double")


def anchor_scores(queries: DataFrame, anchors: DataFrame, k: int = 3) -> DataFrame:
    """(row_id, label, score): the mean of a query's k largest cosines with each label's anchors, or all if fewer."""
    found = anchors.limit(ANCHORS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).alias("numbers")).first()
    few = found.n <= ANCHORS and 8 * (found.numbers or 0) <= ANCHOR_BYTES
    return _scores(queries, anchors, k) if few else blocked_scores(queries, anchors, k)


#: Pivots that blocks are formed about, of a block's rows at most, and cosines that rounding may hide.
PIVOTS, SLACK = 256, 1e-9


def _blocks(rows: DataFrame, pivots: np.ndarray, kept: list[str], by: list[str]) -> DataFrame:
    """(by, pivot, part, rows): packed unit vectors grouped by their nearest pivot and cut into parts of about BLOCK rows, and
    the cosine of the farthest one to the pivot (`least`)."""
    import pandas as pd

    def nearest(batches):
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf.v.tolist()) @ pivots.T
                yield pdf.assign(pivot=x.argmax(1), near=x.max(1))

    dealt = F.xxhash64("row_id") if "row_id" in rows.columns else F.xxhash64("embedding")
    unit_rows = rows.select(*kept, unit(F.col("embedding").cast("array<double>")).alias("v"), dealt.alias("dealt"))
    placed = unit_rows.mapInPandas(nearest, T.StructType([*unit_rows.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("near", T.DoubleType())]))
    sizes = placed.groupBy(*by, "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    cut = placed.join(F.broadcast(sizes), [*by, "pivot"]).withColumn("part", F.pmod("dealt", "parts").cast("int"))
    return cut.groupBy(*by, "pivot", "part").agg(F.collect_list(F.struct(*kept, "v")).alias("rows"), F.min("near").alias("least"))


def _most(a: DataFrame, b: DataFrame, gram: DataFrame) -> DataFrame:
    """Pairs of blocks (q, a) with `most`, a bound of every cosine between them: by the triangle inequality of angles, no pair is nearer
    than the pivots' angle less both blocks' radii."""
    angle = lambda c: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col(c))))
    met = a.join(F.broadcast(gram), "q_pivot").join(b, "a_pivot")
    gap = F.greatest(F.lit(0.0), angle("between") - angle("q_least") - angle("a_least"))
    return met.withColumn("most", F.cos(gap) + SLACK)


def blocked_scores(queries: DataFrame, anchors: DataFrame, k: int = 3, pivots: int = PIVOTS, report: dict | None = None) -> DataFrame:
    """anchor_scores for anchors of any number, exactly and without all pairs.

    Queries and each label's anchors are grouped by their nearest of a few pivots (rows of the anchors by hash). Each block
    of queries first meets, for each label, the blocks of best bound that hold k anchors between them; the k-th best cosine
    of its worst query is then a threshold, and only those other blocks follow whose bound reaches it. `report` is
    given the numbers of pairs of blocks, `all` and `met`. Blocks, bounds and tops are stored; the driver holds the pivots, and
    a task's Python PAIRS pairs of blocks."""
    spark = queries.sparkSession
    kinds = dict(queries.dtypes)["row_id"], dict(anchors.dtypes)["label"]
    scores = f"row_id {kinds[0]}, label {kinds[1]}, score double"
    chosen = anchors.where("embedding is not null").select(unit(F.col("embedding").cast("array<double>")).alias("v")).orderBy(F.xxhash64("v")).limit(pivots).collect()
    if not chosen:
        return spark.createDataFrame([], scores)
    centres = np.array([r.v for r in chosen])
    cosine = centres @ centres.T
    gram = spark.createDataFrame([(i, j, float(cosine[i, j])) for i in range(len(centres)) for j in range(len(centres))], "q_pivot int, a_pivot int, between double")
    with ExitStack() as held:
        q = held.enter_context(stored(_blocks(queries.where("embedding is not null"), centres, ["row_id"], []).withColumn("q", F.monotonically_increasing_id()), "query_blocks"))
        a = held.enter_context(stored(_blocks(anchors.where("embedding is not null"), centres, ["label"], ["label"]).withColumn("a", F.monotonically_increasing_id()), "anchor_blocks"))
        q_about = q.select("q", F.col("pivot").alias("q_pivot"), F.col("least").alias("q_least"))
        a_about = a.select("a", "label", F.col("pivot").alias("a_pivot"), F.col("least").alias("a_least"), F.size("rows").alias("size"))
        bounds = held.enter_context(stored(_most(q_about, a_about, gram).select("q", "a", "label", "most", "size"), "bounds"))
        by = Window.partitionBy("q", "label").orderBy(F.desc("most"), "a")
        first = bounds.withColumn("_before", F.sum("size").over(by) - F.col("size")).where(F.col("_before") < k).select("q", "a")

        def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    own, other = (batch.column(c).slice(i, 1).flatten() for c in ("q_rows", "a_rows"))
                    top = _top_cosines(_matrix(own.field("v")), _matrix(other.field("v")), k)
                    ends = pa.array(np.arange(len(top) + 1, dtype=np.int32) * top.shape[1])
                    columns = [own.field("row_id"), pa.repeat(batch.column("label")[i], len(top)), pa.ListArray.from_arrays(ends, pa.array(top.ravel()))]
                    yield pa.RecordBatch.from_arrays(columns, ["row_id", "label", "top"])

        def tops(pairs: DataFrame) -> DataFrame:
            both = pairs.join(q.select("q", F.col("rows").alias("q_rows")), "q").join(a.select("a", "label", F.col("rows").alias("a_rows")), "a")
            return both.select("q", "label", "q_rows", "a_rows").mapInArrow(meet, f"row_id {kinds[0]}, label {kinds[1]}, top array<double>")

        merged = lambda rows: rows.groupBy("row_id", "label").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k).alias("top"))
        with _batches_of(spark, PAIRS):
            early = held.enter_context(stored(tops(first), "early_tops"))
        kth = F.when(F.size("top") >= k, F.get("top", F.lit(k - 1))).otherwise(-2.0)
        whose = q.select("q", F.explode("rows.row_id").alias("row_id"))
        limits = merged(early).select("row_id", "label", kth.alias("kth")).join(whose, "row_id").groupBy("q", "label").agg(F.min("kth").alias("limit"))
        more = held.enter_context(stored(bounds.join(limits, ["q", "label"]).where(F.col("most") >= F.col("limit")).select("q", "a").join(first, ["q", "a"], "left_anti"), "more_pairs"))
        if report is not None:
            report |= {"all": bounds.count(), "met": first.count() + more.count()}
        out = merged(early.unionByName(tops(more)))
        mean = F.aggregate("top", F.lit(0.0), lambda s, x: s + x) / F.size("top")
        with _batches_of(spark, PAIRS):
            return _kept(out.select("row_id", "label", mean.alias("score")))


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this block Arrow batches have so many rows, for rows that hold whole blocks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _kept(df: DataFrame) -> DataFrame:
    """df computed now and stored where it stays until Spark's cleaner drops the checkpoint with it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def best_label(scores: DataFrame) -> DataFrame:
    """(row_id, label, score): the least label of equal scores."""
    best = scores.groupBy("row_id").agg(F.min(F.struct((-F.round("score", 12)).alias("score"), "label")).alias("b"))
    return best.select("row_id", F.col("b.label").alias("label"), (-F.col("b.score")).alias("score"))


def centroids(rows: DataFrame) -> DataFrame:
    """(label, embedding): the mean of each label's unit vectors, at unit length."""
    long = rows.select("label", F.posexplode(unit(F.col("embedding"))).alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    mean = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("embedding"))
    return mean.withColumn("embedding", unit(F.col("embedding")))


def nearest_centroid(queries: DataFrame, labelled: DataFrame) -> DataFrame:
    return best_label(anchor_scores(queries, centroids(labelled), 1))


def medoid_anchors(rows: DataFrame, k: int, keep: float = 0.9, sample: int = 1500) -> DataFrame:
    """(label, row_id): k rows of each label spread evenly over those nearest its centroid, outliers trimmed. Anchors
    are chosen among at most `sample` rows of a label by hash, so that no label is sorted whole in one task."""
    from gaugeworks.functions.probs import dot

    rows = stratified(rows, "label", sample)
    centre = centroids(rows).withColumnRenamed("embedding", "c")
    near = rows.join(F.broadcast(centre), "label").select("label", "row_id", F.round(dot(unit(F.col("embedding")), F.col("c")), 12).alias("cos"))
    by = Window.partitionBy("label")
    ranked = near.withColumn("rn", F.row_number().over(by.orderBy(F.desc("cos"), "row_id")) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    kept = F.greatest(F.floor(F.col("n") * keep), F.least(F.lit(k), F.col("n")))
    step = F.greatest(F.floor(kept / k), F.lit(1))
    return ranked.where((F.col("rn") < kept) & (F.col("rn") % step == 0) & (F.col("rn") / step < k)).select("label", "row_id")
