"""Classification, calibration and gate metrics over a prediction frame: truth, pred, conf, votes and the like.

Undefined ratios are NULL. Each function is one or two aggregations; what grows with the data is aggregated before it
is combined."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import stats
from gaugeworks.operators.folds import Taxonomy
from gaugeworks.operators.quantiles import quantiles
from gaugeworks.operators.votes import contested, unanimous
from gaugeworks.stored import stored

CONTRACT = ("accuracy", "majority_baseline", "lift_over_chance", "minority_share", "n")


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def contract(preds: DataFrame) -> DataFrame:
    """One row: n, accuracy, majority_baseline, minority_share (over labels that occur), lift_over_chance, wilson95."""
    per = preds.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("truth") == F.col("pred")).cast("long")).alias("k"))
    n = F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))
    one = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("k"),
        (F.coalesce(F.sum("k"), F.lit(0)) / n).alias("accuracy"),
        (F.max("n") / n).alias("majority_baseline"),
        (F.min("n") / n).alias("minority_share"),
    )
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return one.select("n", "accuracy", "majority_baseline", "minority_share", (F.col("accuracy") - F.col("majority_baseline")).alias("lift_over_chance"), low.alias("wilson95_lo"), high.alias("wilson95_hi"))


def missing_metrics(metrics: DataFrame, required: tuple[str, ...] = CONTRACT) -> list[str]:
    """Names of the contract that a one-row metric frame lacks."""
    return [m for m in required if m not in metrics.columns]


def confusion(preds: DataFrame, labels: list[str]) -> DataFrame:
    """(truth, pred, n) for each pair of labels, zeros included."""
    cells = preds.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "truth string, pred string")
    counted = preds.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counted, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_label(preds: DataFrame, labels: list[str]) -> DataFrame:
    """(label, support, predicted, recall, precision, f1)."""
    cells = confusion(preds, labels)
    truth = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    predicted = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    both = truth.join(predicted, "label")
    recall, precision = F.try_divide("hit", "support"), F.try_divide("hit", "predicted")
    f1 = F.when(F.col("hit") > 0, 2 * recall * precision / (recall + precision)).when((F.col("support") > 0) & (F.col("predicted") > 0), 0.0)
    return both.select("label", "support", "predicted", recall.alias("recall"), precision.alias("precision"), f1.alias("f1"))


def macro_f1(preds: DataFrame, labels: list[str]) -> DataFrame:
    """macro_f1_defined: over labels with support and prediction. macro_f1_all: undefined counts as 0, over all labels.
    balanced_accuracy: mean recall of the labels that occur."""
    return per_label(preds, labels).agg(F.avg("f1").alias("macro_f1_defined"), (F.sum(F.coalesce("f1", F.lit(0.0))) / len(labels)).alias("macro_f1_all"), F.avg("recall").alias("balanced_accuracy"))


def minor_class_recall(preds: DataFrame, labels: list[str]) -> DataFrame:
    return per_label(preds, labels).where("support > 0").orderBy("support", "label").limit(1).select("label", "support", "recall")


def label_ceiling(preds: DataFrame) -> DataFrame:
    """What the labels' own disagreement allows, over the rows with votes."""
    # null without votes; a filter on it would be pushed below the votes' projection, which then computes them twice
    voted = F.when(F.size("votes") > 0, unanimous(F.col("votes")))
    rows = preds.select((F.col("truth") == F.col("pred")).alias("ok"), voted.alias("same"))
    ok, same = F.col("ok"), F.col("same")
    return rows.agg(
        F.count("same").alias("n"),
        _share(same).alias("jury_agreement"),
        _share(~same).alias("contested_share"),
        F.avg(F.when(same, ok.cast("double"))).alias("accuracy_unanimous"),
        F.avg(F.when(~same, ok.cast("double"))).alias("accuracy_contested"),
        F.avg(F.when(same, (~ok).cast("double"))).alias("error_on_unanimous"),
        F.avg(F.when(same.isNotNull(), (ok | ~same).cast("double"))).alias("ceiling_from_perfect_labels"),
    )


def _by_bin(preds: DataFrame, bins: int) -> DataFrame:
    """(bin, n, known, conf, hits): rows, rows with a confidence, sums of confidences and of hits; bin is NULL for the
    rows that are in none."""
    edges = [k * 0.1 if bins == 10 else k / bins for k in range(bins)]
    place = F.lit(None).cast("int")
    for k, low in reversed(list(enumerate(edges))):
        place = F.coalesce(place, F.when(F.col("conf") > low, k))
    hit = (F.col("truth") == F.col("pred")).cast("double")
    return preds.groupBy(F.when(F.col("conf") <= 1, place).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count("conf").alias("known"), F.sum("conf").alias("conf"), F.sum(hit).alias("hits"))


def calibration_bins(preds: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy): bins are (lo, hi]; a confidence of 0 is in none, empty bins are left out."""
    return _by_bin(preds, bins).where("bin is not null").select("bin", "n", (F.col("conf") / F.col("n")).alias("confidence"), (F.col("hits") / F.col("n")).alias("accuracy"))


def calibration(preds: DataFrame, bins: int = 10) -> DataFrame:
    """One row: ece, mce, overconfidence, bins; all of it from one aggregation by bin."""
    per = _by_bin(preds, bins)
    inside = F.col("bin").isNotNull()
    gap = F.when(inside, F.abs(F.col("conf") - F.col("hits")) / F.col("n"))
    whole = F.sum("n")
    return per.agg((F.coalesce(F.sum(gap * F.col("n")), F.lit(0.0)) / F.greatest(F.coalesce(whole, F.lit(0)), F.lit(1))).alias("ece"), F.coalesce(F.max(gap), F.lit(0.0)).alias("mce"), F.try_divide(F.sum("conf") - F.sum("hits"), F.sum("known")).alias("overconfidence"), F.count("bin").alias("bins"))


def confident_half_spread(preds: DataFrame) -> DataFrame:
    """The range of confidence in the upper half; NULL below four rows."""
    middle = quantiles(preds, "conf", [0.5]).select("n", "cut")
    upper = preds.select("conf").join(F.broadcast(middle), F.col("conf") >= F.col("cut"))
    return upper.agg(F.when(F.max("n") >= 4, F.max("conf") - F.min("conf")).alias("confident_half_spread"))


def gates(preds: DataFrame, task: Taxonomy) -> DataFrame:
    """(gate, containment, over_block, released_to_lowest) of each gate; NULL where a side has no rows."""
    t, p = task.rank(F.col("truth")), task.rank(F.col("pred"))
    ranked = preds.select(t.alias("t"), p.alias("p")).groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))
    rows = []
    for gate in task.gates:
        g = task.labels.index(gate)
        inside, over = F.col("t") >= g, F.col("t") < g
        share = lambda side, hit: F.try_divide(F.sum(F.when(side & hit, F.col("n")).otherwise(0)), F.sum(F.when(side, F.col("n")).otherwise(0)))  # noqa: B023, E731
        rows += [F.lit(gate), share(inside, F.col("p") >= g), share(over, F.col("p") >= g), share(inside, F.col("p") == 0)]
    wide = ranked.agg(*(c.alias(f"c{k}") for k, c in enumerate(rows)))
    return wide.select(F.inline(F.array(*(F.struct(F.col(f"c{k}").alias("gate"), F.col(f"c{k + 1}").alias("containment"), F.col(f"c{k + 2}").alias("over_block"), F.col(f"c{k + 3}").alias("released_to_lowest")) for k in range(0, len(rows), 4)))))


#: Bits that half_word has for each of its two numbers.
WORD_BITS = 60
#: Sums of one aggregation over rows: Spark compiles wide ones only up to 100 columns.
MOST_SUMS = 80
#: Values by which confidences are binned before any is looked at one by one.
BINS = 1000
#: Rows of the bins in which cuts fall, over all repeats, up to which these bins aren't cut finer, by FINER * BINS values.
EDGE_ROWS, FINER = 1 << 22, 4


def half_word(key: str = "row_id") -> Column:
    """An array of two numbers whose bits put a row in a half (0 or 1) of each of 120 repeats, by its key alone."""
    h = F.md5(F.col(key).cast("string"))
    return F.array(*(F.conv(F.substring(h, at, WORD_BITS // 4), 16, 10).cast("bigint") for at in (1, WORD_BITS // 4 + 1)))


def half_of(word: Column, rep: int | Column) -> Column:
    if isinstance(rep, int):
        return F.shiftright(F.get(word, F.lit(rep // WORD_BITS)), rep % WORD_BITS).bitwiseAND(F.lit(1))
    return F.call_function("shiftright", F.get(word, F.floor(rep / WORD_BITS).cast("int")), (rep % WORD_BITS).cast("int")).bitwiseAND(F.lit(1))


def half_sums(rows: DataFrame, by: list[str], measures: list[str], repeats: int, word: str = "word") -> DataFrame:
    """(by, rep, half, measures): sums of whole-number measures over each half of each repeat. Rows aren't repeated:
    each adds to one sum for each repeat, before the shuffle; by makes few groups, and every group has all halves."""
    if repeats > 2 * WORD_BITS:
        raise ValueError(f"at most {2 * WORD_BITS} repeats")
    out, step = None, max(1, MOST_SUMS // len(measures) - 1)
    for low in range(0, repeats, step):
        reps = range(low, min(low + step, repeats))
        sums = [F.sum(m).alias(f"_t_{m}") for m in measures]
        sums += [F.sum(F.when(half_of(F.col(word), r) == 1, F.col(m)).otherwise(0)).alias(f"_s{r}_{m}") for r in reps for m in measures]
        wide = rows.groupBy(*by).agg(*sums)
        half = lambda r, h: F.struct(F.lit(r).alias("rep"), F.lit(h).alias("half"), *((F.col(f"_s{r}_{m}") if h else F.col(f"_t_{m}") - F.col(f"_s{r}_{m}")).alias(m) for m in measures))
        part = wide.select(*by, F.inline(F.array(*(half(r, h) for r in reps for h in (0, 1)))))
        out = part if out is None else out.unionByName(part)
    return out


def half_bins(rows: DataFrame, edges: np.ndarray, repeats: int) -> DataFrame:
    """(rep, half, bin, one, ok): rows (conf, ok, word) and those that are right, in each bin of each half of each repeat.
    One pass: a task counts all repeats side by side and sends a row for each bin that it has seen."""
    n = len(edges) + 1
    if repeats > 2 * WORD_BITS:
        raise ValueError(f"at most {2 * WORD_BITS} repeats")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, repeats, 2 * n), np.int64)
        for batch in batches:
            at = np.searchsorted(edges, batch.column("conf").to_numpy(), "right")
            ok = batch.column("ok").to_numpy(zero_copy_only=False).astype(float)
            word = np.asarray(batch.column("word").flatten(), np.int64).reshape(-1, 2)
            for r in range(repeats):
                place = at + n * ((word[:, r // WORD_BITS] >> (r % WORD_BITS)) & 1)
                total[0, r] += np.bincount(place, minlength=2 * n)
                total[1, r] += np.bincount(place, ok, 2 * n).astype(np.int64)
        rep, place = np.nonzero(total[0])
        columns = [rep.astype(np.int32), (place // n).astype(np.int32), (place % n).astype(np.int32), total[0, rep, place], total[1, rep, place]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "half", "bin", "one", "ok"])

    sent = rows.select("conf", "ok", "word").mapInArrow(run, "rep int, half int, bin int, one bigint, ok bigint")
    return sent.groupBy("rep", "half", "bin").agg(F.sum("one").alias("one"), F.sum("ok").alias("ok"))


def heldout_cuts(rows: DataFrame, coverages: Sequence[float], repeats: int) -> DataFrame:
    """(rep, half, k, cut, n, ok, n_kept, ok_kept) of rows (row_id, conf, ok 0 or 1): the exact quantile 1 - coverages[k]
    of the confidences of one half, and the other half's rows, those that are right, and both among the rows at or
    above the cut. half is the one that the cut is from.

    Confidences are binned by a sketch's quantiles, and bins are summed by half in one pass; the driver gets BINS rows
    of sums, which tell in which bins the cuts fall. Where many rows lie there, those bins are cut finer and their rows
    counted again. Only rows of the bins of cuts are then looked at one by one, each in the repeats whose cuts fall in its
    bin. What the passes read is stored first: three numbers a row."""
    values = rows.select(F.col("conf").cast("double").alias("conf"), F.col("ok").cast("bigint").alias("ok"), half_word().alias("word")).where("conf is not null and not isnan(conf)")
    with stored(values, "halves") as kept:
        return rows.sparkSession.createDataFrame(_cuts_of(kept, coverages, repeats), CUTS)  # a row for each half and coverage


CUTS = "rep int, half int, k int, cut double, n bigint, ok bigint, n_kept bigint, ok_kept bigint"


def _edges(values: DataFrame, bins: int) -> np.ndarray:
    found = values.agg(F.percentile_approx("conf", [k / bins for k in range(1, bins)], 10 * bins)).first()[0]
    return np.array(sorted(set(found or ())))


def _binned(values: DataFrame, edges: np.ndarray) -> DataFrame:
    splits = [-math.inf, *edges.tolist(), math.inf]
    binned = Bucketizer(splits=splits, inputCol="conf", outputCol="bin").transform(values)
    return binned.withColumn("bin", F.col("bin").cast("int"))


def _table(rows: DataFrame, edges: np.ndarray, repeats: int) -> np.ndarray:
    """half_bins on the driver: (one or ok, rep, half, bin)."""
    found = half_bins(rows, edges, repeats).toArrow()  # bins * 2 * repeats rows at most
    rep, half, place, *counts = (found.column(c).to_numpy() for c in ("rep", "half", "bin", "one", "ok"))
    table = np.zeros((2, repeats, 2, len(edges) + 1), np.int64)
    for t, c in zip(table, counts, strict=True):
        t[rep, half, place] = c
    return table


def _targets(table: np.ndarray, coverages: Sequence[float]) -> list[tuple]:
    """For each half and coverage: the place of its cut, the bins and the places within them of the two values about it,
    the other half's rows and those above these bins."""
    targets = []
    for rep in range(table.shape[1]):
        for half in (0, 1):
            upto = np.cumsum(table[0, rep, half])
            other_n, other_ok = table[:, rep, 1 - half]
            for k, coverage in enumerate(coverages if upto[-1] else ()):
                place = (1 - coverage) * float(upto[-1] - 1)
                at = [max(0, min(math.floor(place), int(upto[-1]) - 1)), max(0, min(math.ceil(place), int(upto[-1]) - 1))]
                a, b = (int(np.searchsorted(upto, x, "right")) for x in at)
                inside = [int(x - (upto[y - 1] if y else 0)) for x, y in zip(at, (a, b), strict=True)]
                targets.append((rep, half, k, place, a, inside[0], b, inside[1], int(other_n.sum()), int(other_ok.sum()), int(other_n[b + 1 :].sum()), int(other_ok[b + 1 :].sum())))
    return targets


def _bins_of(targets: list[tuple]) -> dict[int, set[int]]:
    """The bins that cuts fall in, and the repeats that they do so in."""
    found: dict[int, set[int]] = {}
    for rep, _, _, _, a, _, b, *_ in targets:
        for place in range(a, b + 1):
            found.setdefault(place, set()).add(rep)
    return found


def _cuts_of(values: DataFrame, coverages: Sequence[float], repeats: int) -> list:
    spark = values.sparkSession
    edges = _edges(values, BINS)
    if not len(edges):
        return []
    table = _table(values, edges, repeats)
    targets = _targets(table, coverages)
    near = sorted(_bins_of(targets))
    if repeats * int(table[0, 0][:, near].sum()) > EDGE_ROWS:  # cut those bins finer, and count their rows again
        wanted = F.broadcast(spark.createDataFrame([(k,) for k in near], "bin int"))
        with stored(_binned(values, edges).join(wanted, "bin").drop("bin"), "near_rows") as inner:
            finer = np.array(sorted({*edges.tolist(), *_edges(inner, FINER * BINS).tolist()}))
            inside = _table(inner, finer, repeats)
            far = [k for k in range(len(edges) + 1) if k not in set(near)]
            start = [int(np.searchsorted(finer, edges[k - 1], "right")) if k else 0 for k in far]  # no finer edge divides these
            inside[..., start] = table[..., far]
            targets = _targets(inside, coverages)
            return _cuts_among(inner, finer, targets)
    return _cuts_among(values, edges, targets)


def _cuts_among(values: DataFrame, edges: np.ndarray, targets: list[tuple]) -> list:
    """The cuts of all targets, from the rows of the bins that they fall in, each in the repeats that need it."""
    spark = values.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(k, sorted(reps)) for k, reps in sorted(_bins_of(targets).items())], "bin int, reps array<int>"))
    table = spark.createDataFrame(targets, "rep int, half int, k int, place double, a_bin int, a_at bigint, b_bin int, b_at bigint, n bigint, ok bigint, n_above bigint, ok_above bigint")
    edge = _binned(values, edges).join(wanted, "bin").select("bin", "conf", "ok", "word", F.explode("reps").alias("rep"))
    edge = edge.groupBy("rep", half_of(F.col("word"), F.col("rep")).cast("int").alias("half"), "bin", "conf").agg(F.count(F.lit(1)).alias("c"), F.sum("ok").alias("c_ok"))
    with stored(edge, "edge_rows") as kept:
        return _cuts_at(kept, table).collect()


def _cuts_at(edge: DataFrame, table: DataFrame) -> DataFrame:
    """The cuts that table places, and what is kept by them, from the counted confidences of the bins they fall in."""
    upto = F.sum("c").over(Window.partitionBy("rep", "half", "bin").orderBy("conf"))

    def at(side: str) -> DataFrame:
        want = table.select("rep", "half", "k", F.col(f"{side}_bin").alias("bin"), F.col(f"{side}_at").alias("at"))
        found = edge.withColumn("upto", upto).join(F.broadcast(want), ["rep", "half", "bin"]).where("upto > at and upto - c <= at")
        return found.select("rep", "half", "k", F.col("conf").alias(side))

    place = F.col("place")
    between = (F.ceil(place) - place) * F.col("a") + (place - F.floor(place)) * F.col("b")
    cuts = table.join(at("a"), ["rep", "half", "k"]).join(at("b"), ["rep", "half", "k"]).withColumn("cut", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between))
    other = cuts.select("rep", (1 - F.col("half")).alias("half"), "k", "cut", F.explode(F.sequence("a_bin", "b_bin")).alias("bin"))
    kept = edge.join(F.broadcast(other), ["rep", "half", "bin"]).where("conf >= cut").groupBy("rep", (1 - F.col("half")).alias("half"), "k").agg(F.sum("c").alias("c"), F.sum("c_ok").alias("c_ok"))
    both = cuts.join(kept, ["rep", "half", "k"], "left")
    return both.select("rep", "half", "k", "cut", "n", "ok", (F.col("n_above") + F.coalesce("c", F.lit(0))).alias("n_kept"), (F.col("ok_above") + F.coalesce("c_ok", F.lit(0))).alias("ok_kept"))


def right_rows(preds: DataFrame) -> DataFrame:
    return preds.select("row_id", "conf", (F.col("truth") == F.col("pred")).cast("int").alias("ok"))


def risk_coverage(preds: DataFrame, coverages: tuple[float, ...] = (0.95, 0.90, 0.80, 0.70), repeats: int = 40) -> DataFrame:
    """(coverage, accuracy, waste): thresholds are quantiles of one half's confidence and are scored on the other, in
    both directions; waste is the share of dropped rows that were right."""
    each = heldout_cuts(right_rows(preds), coverages, repeats).select("k", F.try_divide("ok_kept", "n_kept").alias("a"), F.try_divide(F.col("ok") - F.col("ok_kept"), F.col("n") - F.col("n_kept")).alias("w"))
    return each.groupBy("k").agg(F.avg("a").alias("accuracy"), F.avg("w").alias("waste")).select(F.get(F.lit(list(coverages)), F.col("k")).alias("coverage"), "accuracy", "waste")


def hard_subset_accuracy(preds: DataFrame) -> DataFrame:
    """(hard, n, accuracy) of rows with a flag for hard ones; a NULL flag is not hard."""
    return preds.groupBy(F.coalesce("hard", F.lit(False)).alias("hard")).agg(F.count(F.lit(1)).alias("n"), _share(F.col("truth") == F.col("pred")).alias("accuracy"))


def top_confusions(preds: DataFrame, most: int = 5) -> DataFrame:
    """(truth, pred, n) of the most frequent errors, by count and then by label."""
    wrong = preds.where("truth <> pred").groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    return wrong.orderBy(F.desc("n"), "truth", "pred").limit(most)


def z_scores(rows: DataFrame, column: str, by: str, out: str = "z") -> DataFrame:
    """Add the distance from the group's mean in its standard deviations (of the population); 0 where all are equal.
    Means are aggregated and joined back, so a large group stays spread over tasks."""
    per = rows.groupBy(by).agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_sd"))
    joined = rows.join(F.broadcast(per), by)
    return joined.withColumn(out, F.when(F.col("_sd") > 0, (F.col(column) - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))).drop("_mean", "_sd")


def spread_by(rows: DataFrame, column: str, by: str) -> DataFrame:
    """(by, n, mean, sd, low, high, median): sd of the population, the exact median."""
    out = rows.groupBy(by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), F.min(column).alias("low"), F.max(column).alias("high"))
    return out.join(quantiles(rows, column, [0.5], [by]).select(by, F.col("cut").alias("median")), by, "left")


def contested_enrichment(preds: DataFrame, coverage: float = 0.90) -> DataFrame:
    """Are contested rows more frequent among those that a confidence threshold drops? NULL without any."""
    return enrichment_of(preds, contested(F.col("votes")), coverage)


def enrichment_of(preds: DataFrame, flag: Column, coverage: float = 0.90) -> DataFrame:
    """The same of any flag: its share of all rows, of the rows below the threshold, and how the two compare. NULL without
    a flagged row or a row below the threshold."""
    cut = quantiles(preds, "conf", [1 - coverage]).select("cut")
    rows = preds.select("conf", flag.cast("double").alias("c")).join(F.broadcast(cut), F.lit(True), "left")
    out = rows.agg(F.avg("c").alias("base_rate"), F.avg(F.when(F.col("conf") < F.col("cut"), F.col("c"))).alias("in_dropped"))
    return out.select("base_rate", "in_dropped", F.try_divide("in_dropped", "base_rate").alias("enrichment"))


def runtime_summary(calls: DataFrame) -> DataFrame:
    """Of calls (status, latency_ms): OK succeeds, ABSTAIN abstains, RESOURCE_EXHAUSTED and all else are errors."""
    ok = F.col("status") == "OK"
    names = ("p50_ms", "p95_ms", "p99_ms")
    cuts = quantiles(calls.where(ok), "latency_ms", [0.5, 0.95, 0.99]).agg(*(F.max(F.when(F.col("k") == k, F.col("cut"))).alias(n) for k, n in enumerate(names)))
    one = calls.agg(F.count(F.lit(1)).alias("attempted"), F.sum(ok.cast("long")).alias("succeeded"), _share(F.col("status") == "RESOURCE_EXHAUSTED").alias("resource_exhausted_rate"), _share(F.col("status") == "ABSTAIN").alias("abstain_rate"), _share(~F.col("status").isin("OK", "ABSTAIN")).alias("error_rate"), F.avg(F.when(ok, F.col("latency_ms"))).alias("mean_ms"))
    return one.join(F.broadcast(cuts), F.lit(True)).select("attempted", "succeeded", (F.col("succeeded") / F.greatest("attempted", F.lit(1))).alias("coverage"), "abstain_rate", "resource_exhausted_rate", "error_rate", *names, "mean_ms")


def seed_summary(scores: DataFrame) -> DataFrame:
    """Of a few scores (config, score): spread, upper median and sigma of each config."""
    rows = scores.groupBy("config").agg(F.count("score").alias("n"), (F.max("score") - F.min("score")).alias("spread"), stats.upper_median(F.collect_list("score")).alias("median"))
    return rows.withColumn("sigma", stats.sigma_from_range(F.col("spread"), F.col("n")))
