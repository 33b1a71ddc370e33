"""Telemetry of a live classifier: the same aggregations in batch and as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.probe import separability
from gaugeworks.operators.quantiles import quantiles
from gaugeworks.operators.sampling import retained
from gaugeworks.sources.ledger import stream_to_ledger
from gaugeworks.stored import stored
from gaugeworks.streaming.buffers import first_of_windows, first_overall

WINDOW = "1 hour"


#: Confidences below which a call would abstain.
ABSTAIN = (0.5, 0.7, 0.9)
#: Quantiles of each window's confidence and latency.
QUANTILES = {"conf": {0.1: "conf_p10", 0.5: "conf_p50"}, "latency_ms": {0.5: "p50_ms", 0.99: "p99_ms"}}


def _means(thresholds: tuple[float, ...]) -> list[Column]:
    low = lambda t: F.avg((F.col("conf") < t).cast("double")).alias(f"abstain_at_{round(100 * t)}")
    return [F.count(F.lit(1)).alias("n"), F.avg("conf").alias("conf_mean"), *map(low, thresholds)]


def window_metrics(calls: DataFrame, thresholds: tuple[float, ...] = ABSTAIN) -> DataFrame:
    """Exact metrics of each window of calls (ts, conf, latency_ms), in batch."""
    rows = calls.select(F.window("ts", WINDOW)["start"].alias("hour"), "conf", "latency_ms")
    means = _means(thresholds)
    out = rows.groupBy("hour").agg(*means)
    for column, names in QUANTILES.items():
        cuts = quantiles(rows, column, list(names), ["hour"])
        wide = cuts.groupBy("hour").agg(*(F.max(F.when(F.col("k") == k, F.col("cut"))).alias(n) for k, n in enumerate(names.values())))
        out = out.join(wide, "hour", "left")
    return out


def predicted_shares(calls: DataFrame) -> DataFrame:
    """(hour, pred, n, share) of each window's predicted labels."""
    counts = calls.groupBy(F.window("ts", WINDOW)["start"].alias("hour"), "pred").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("hour").agg(F.sum("n").alias("whole"))
    return counts.join(whole, "hour").select("hour", "pred", "n", (F.col("n") / F.col("whole")).alias("share"))


def stream_metrics(calls: DataFrame, labels: Sequence[str] = (), late: str = "10 minutes", thresholds: tuple[float, ...] = ABSTAIN) -> DataFrame:
    """The streaming form: sums, the share of each label and a quantile sketch for each window, closed when the
    watermark passes it."""
    sketched = [F.percentile_approx(c, F.lit(q), 10_000).alias(name) for c, names in QUANTILES.items() for q, name in names.items()]
    shares = [F.avg((F.col("pred") == x).cast("double")).alias(f"share_{x}") for x in labels]
    out = calls.withWatermark("ts", late).groupBy(F.window("ts", WINDOW).alias("w")).agg(*_means(thresholds), *sketched, *shares)
    return out.select(F.col("w.start").alias("hour"), *out.columns[1:])


def stream_retained(calls: DataFrame, rate: float = 0.05) -> DataFrame:
    """A sample of calls for review, richer where confidence is low; each call goes on at once."""
    return retained(calls, rate, "call_id")


def retain_to_ledger(calls: DataFrame, path: str, checkpoint: str, most: int, rate: float = 0.05, experiment: str = "retained", late: str = "10 minutes"):
    """That sample, but of each window the `most` first calls at most, exactly so many if enough qualify, whatever the
    batches: they go to the ledger when the window is over."""
    return stream_to_ledger(first_of_windows(retained(calls, rate, "call_id"), most, "call_id", late, WINDOW), path, checkpoint, experiment, lambda batch: first_overall(batch, most, "call_id", WINDOW))


def stream_drift(calls: DataFrame, reference: DataFrame, path: str, checkpoint: str, most: int = 5000, folds: int = 5, experiment: str = "drift", late: str = "10 minutes"):
    """For each window of calls (call_id, ts, embedding): how well a probe tells the first `most` of their embeddings from the
    reference's (row_id, embedding), as rows (hour, n, separability, traffic) of a ledger. The embeddings wait as state
    until the window is over. Windows without embeddings have no row."""

    def measure(batch: DataFrame) -> DataFrame:
        first = first_overall(batch, most, "call_id", WINDOW).withColumn("hour", F.window("ts", WINDOW)["start"])
        with stored(first, "first_embeddings") as kept:
            out = None
            for r in kept.groupBy("hour").agg(F.count(F.lit(1)).alias("n")).orderBy("hour").collect():  # windows that end in this batch
                live = kept.where(F.col("hour") == r.hour).select(F.col("call_id").alias("row_id"), "embedding")
                one = separability(live, reference, folds).select(F.lit(r.hour).alias("hour"), F.lit(r.n).cast("bigint").alias("n"), "separability", "traffic")
                out = one if out is None else out.unionByName(one)
        return batch.sparkSession.createDataFrame([], "hour timestamp, n bigint, separability double, traffic string") if out is None else out

    return stream_to_ledger(first_of_windows(calls.where("embedding is not null").select("call_id", "ts", "embedding"), most, "call_id", late, WINDOW), path, checkpoint, experiment, measure)


# ---- sketches that add up ------------------------------------------------------------------------------------

#: Size of a sketch: ranks err by about 0.3 %.
SKETCH_SIZE = 1200
SKETCHED = ("conf", "latency_ms")


def window_sketches(calls: DataFrame, late: str | None = None) -> DataFrame:
    """(hour, n, conf_sketch, latency_ms_sketch) of each window, in batch or, with `late`, as a stream. Rows of a ledger from which
    quantiles of any longer time follow without the calls."""
    rows = calls.withWatermark("ts", late) if late else calls
    sketch = [F.call_function("kll_sketch_agg_double", F.col(c), F.lit(SKETCH_SIZE)).alias(f"{c}_sketch") for c in SKETCHED]
    out = rows.groupBy(F.window("ts", WINDOW).alias("w")).agg(F.count(F.lit(1)).alias("n"), *sketch)
    return out.select(F.col("w.start").alias("hour"), *out.columns[1:])


def sketches_to_ledger(calls: DataFrame, path: str, checkpoint: str, experiment: str = "sketches", late: str = "10 minutes"):
    return stream_to_ledger(window_sketches(calls, late), path, checkpoint, experiment)


def merged_quantiles(sketches: DataFrame, length: str, slide: str | None = None, shares: Sequence[float] = (0.1, 0.5, 0.99)) -> DataFrame:
    """(start, n, metric, share, value) over longer windows (`1 day`, or sliding ones), from stored window_sketches. Each
    sketch goes to the few longer windows that hold its hour; merging doesn't depend on the order."""
    longer = sketches.groupBy(F.window("hour", length, slide or length)["start"].alias("start"))
    merged = longer.agg(F.sum("n").alias("n"), *(F.call_function("kll_merge_agg_double", F.col(f"{c}_sketch"), F.lit(SKETCH_SIZE)).alias(c) for c in SKETCHED))
    cuts = [F.struct(F.lit(c).alias("metric"), F.lit(float(q)).alias("share"), F.when(F.call_function("kll_sketch_get_n_double", F.col(c)) > 0, F.call_function("kll_sketch_get_quantile_double", F.col(c), F.lit(float(q)))).alias("value")) for c in SKETCHED for q in shares]
    return merged.select("start", "n", F.inline(F.array(*cuts)))


def run_to_ledger(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Append a stream's rows to a Parquet folder, exactly once, and stop when the source is used up."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
