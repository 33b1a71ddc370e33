"""Operating curves: thresholds, matched operating points, held-out choices, folds of confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import probs, stats
from gaugeworks.operators.folds import Taxonomy
from gaugeworks.operators.metrics import half_sums, half_word, heldout_cuts, right_rows
from gaugeworks.operators.quantiles import quantiles
from gaugeworks.stored import stored


def flip_bias(logits: Column, gate: int) -> Column:
    """The least bias on the labels at or above the gate with which one of them is the first maximum: at this very
    bias the lower label still wins, as it comes first."""
    n = F.size(logits)
    return F.array_max(F.slice(logits, F.lit(1), F.lit(gate))) - F.array_max(F.slice(logits, F.lit(gate + 1), n - gate))


def bias_sweep(preds: DataFrame, task: Taxonomy, gate: str, low: float = -4.0, high: float = 6.0, step: float = 0.05, probs_column: str = "probs") -> DataFrame:
    """(bias, containment, over_block) on a grid. Each row blocks from its own flip point on, so rows are counted by
    their first grid step and summed along the grid, without a row for each bias."""
    g = task.labels.index(gate)
    steps = round((high - low) / step)
    flip = flip_bias(probs.log_clipped(F.col(probs_column)), g)
    first = F.greatest(F.lit(0), F.floor((flip - low) / step) + 1).cast("int")
    first = F.when(first > 0, F.when(F.lit(low) + (first - 1) * step > flip, first - 1).otherwise(first)).otherwise(first)
    rows = preds.select(first.alias("k"), (task.rank(F.col("truth")) >= g).alias("inside"))
    counts = rows.groupBy("k").agg(F.sum(F.col("inside").cast("long")).alias("i"), F.sum((~F.col("inside")).cast("long")).alias("o"))
    grid = preds.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    filled = grid.join(counts, "k", "full").select("k", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("o", F.lit(0)).alias("o"))
    along = Window.orderBy("k")  # one row for each step of the grid
    whole = Window.partitionBy()
    out = filled.select("k", F.sum("i").over(along).alias("ci"), F.sum("o").over(along).alias("co"), F.sum("i").over(whole).alias("ni"), F.sum("o").over(whole).alias("no"))
    return out.where(F.col("k") <= steps).select((F.lit(low) + F.col("k") * step).alias("bias"), F.try_divide("ci", "ni").alias("containment"), F.try_divide("co", "no").alias("over_block"))


def matched_over_block(curve: DataFrame, targets: tuple[float, ...] = (0.85, 0.90, 0.95)) -> DataFrame:
    """(target, over_block): the least over-block with containment at or over each target; NULL if unreachable."""
    return curve.agg(*(F.min(F.when(F.col("containment") >= t, F.col("over_block"))).alias(f"t{k}") for k, t in enumerate(targets))).select(
        F.inline(F.array(*(F.struct(F.lit(t).alias("target"), F.col(f"t{k}").alias("over_block")) for k, t in enumerate(targets))))
    )


def threshold_curve(scores: DataFrame, thresholds: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """Of scores (score, positive): accuracy, recall, precision and false-fire rate at each threshold, in one pass."""
    pos = F.col("positive")
    parts = []
    for t in thresholds:
        fire = F.col("score") >= t
        tp, fp = F.sum((fire & pos).cast("long")), F.sum((fire & ~pos).cast("long"))
        parts.append(F.struct(F.lit(t).alias("threshold"), F.avg((fire == pos).cast("double")).alias("accuracy"), F.try_divide(tp, F.sum(pos.cast("long"))).alias("recall"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(fp, F.sum((~pos).cast("long"))).alias("false_fire")))
    return scores.agg(F.array(*parts).alias("c")).select(F.inline("c"))


def heldout_threshold(scores: DataFrame, repeats: int = 40, grid: tuple[float, ...] = tuple(k * 0.05 for k in range(1, 20))) -> DataFrame:
    """(threshold, times, accuracy): the threshold of best accuracy on one half (the least of equal ones), how often it
    is chosen, and its mean accuracy on the other half."""
    return _heldout_choices(scores, repeats, grid).groupBy("threshold").agg(F.count(F.lit(1)).alias("times"), F.avg("accuracy").alias("accuracy"))


def threshold_transfer(scores: DataFrame, repeats: int = 40, grid: tuple[float, ...] = tuple(k * 0.05 for k in range(1, 20))) -> DataFrame:
    """One row for the holdout control: the mean accuracy of chosen thresholds where they were fitted, and held out."""
    return _heldout_choices(scores, repeats, grid).agg(F.avg("fitted").alias("threshold/fitted"), F.avg("accuracy").alias("threshold/heldout"))


def _heldout_choices(scores: DataFrame, repeats: int, grid: tuple[float, ...]) -> DataFrame:
    """(rep, half, threshold, fitted, accuracy). Rows are first counted by how many thresholds they reach."""
    reached = sum(((F.col("score") >= t).cast("int") for t in grid), F.lit(0))
    rows = scores.select(reached.alias("bin"), F.lit(1).cast("bigint").alias("n"), F.col("positive").cast("bigint").alias("pos"), half_word().alias("word"))
    sums = half_sums(rows, ["bin"], ["n", "pos"], repeats)
    right = lambda k: F.sum(F.when(F.col("bin") > k, F.col("pos")).otherwise(F.col("n") - F.col("pos"))) / F.sum("n")
    each = sums.groupBy("rep", "half").agg(F.sum("n").alias("n"), F.array(*(F.struct(F.lit(t).alias("t"), right(k).alias("a")) for k, t in enumerate(grid))).alias("curve")).where("n > 0")
    best = each.select("rep", "half", F.array_max(F.transform("curve", lambda s: F.struct(s.a.alias("a"), (-s.t).alias("t")))).alias("best"))
    other = each.select("rep", (1 - F.col("half")).alias("half"), F.col("curve").alias("other"))
    return best.join(other, ["rep", "half"]).select("rep", "half", (-F.col("best.t")).alias("threshold"), F.col("best.a").alias("fitted"), F.filter("other", lambda s: s.t == -F.col("best.t"))[0].a.alias("accuracy"))


def recall_guide(scores: DataFrame, targets: tuple[float, ...] = (0.90, 0.95, 0.99), repeats: int = 40, digits: int = 3) -> DataFrame:
    """(target, achieved, shortfall, false_fire, miss_rate, evaluations): for each target share of positives, the
    largest rounded score that reaches it on one half, measured on the other; halves that none reaches don't count.

    Rows are first counted by rounded score, and by whether they reach it: all else is done on those counts."""
    t = F.round("score", digits)
    rows = scores.select(t.alias("t"), (F.col("score") >= t).alias("at"), F.col("positive").cast("bigint").alias("p"), F.lit(1).cast("bigint").alias("n"), half_word().alias("word"))
    every = half_sums(rows, ["t", "at"], ["p", "n"], repeats)
    some = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    at = F.col("at")
    per = every.groupBy("rep", "half", "t").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), some("p", at).alias("p_at"), some("n", at).alias("n_at"))
    above = Window.partitionBy("rep", "half").orderBy(F.desc("t"))
    whole = Window.partitionBy("rep", "half")
    reach = lambda c: F.sum(c).over(above) - F.col(c) + F.col(f"{c}_at")
    # a candidate is a score of the half itself; on the other half it is counted all the same
    curve = per.select("rep", "half", "t", F.col("n").alias("here"), reach("p").alias("p"), reach("n").alias("n"), F.sum("p").over(whole).alias("all_p"), F.sum("n").over(whole).alias("all_n"))
    wanted = curve.where("here > 0").select("rep", "half", "t", "p", "all_p", F.explode(F.lit(list(targets))).alias("target"))
    chosen = wanted.where("p / all_p >= target").groupBy("rep", "half", "target").agg(F.max("t").alias("t"))
    other = chosen.select("rep", (1 - F.col("half")).alias("half"), "t", "target")
    fired = curve.join(other, ["rep", "half", "t"]).select("target", F.try_divide("p", "all_p").alias("c"), F.try_divide(F.col("n") - F.col("p"), F.col("all_n") - F.col("all_p")).alias("o"))
    out = fired.groupBy("target").agg(F.avg("c").alias("achieved"), F.avg("o").alias("false_fire"), F.avg((F.col("c") < F.col("target")).cast("double")).alias("miss_rate"), F.count(F.lit(1)).alias("evaluations"))
    return out.select("target", "achieved", (F.col("achieved") - F.col("target")).alias("shortfall"), "false_fire", "miss_rate", "evaluations")


def containment_transfer(scores: DataFrame, target: float = 0.95, repeats: int = 60, digits: int = 3) -> DataFrame:
    """The largest rounded score that contains the target share of one half's positives, measured on the other half."""
    return recall_guide(scores, (target,), repeats, digits).select(F.col("achieved").alias("containment"), F.col("false_fire").alias("over_block"), "miss_rate", "evaluations")


def exact_over_block(scores: DataFrame, targets: tuple[float, ...] = (0.85, 0.90, 0.95, 0.99), digits: int = 4) -> DataFrame:
    """(target, over_block): the least over-block, in sample, of a rounded score that contains each target share of the
    positives; NULL if none does."""
    t = F.round("score", digits)
    per = scores.groupBy(t.alias("t")).agg(*(F.sum(c).alias(n) for n, c in (("p", F.col("positive").cast("long")), ("n", F.lit(1)), ("p_at", (F.col("positive") & (F.col("score") >= t)).cast("long")), ("n_at", (F.col("score") >= t).cast("long")))))
    above = Window.orderBy(F.desc("t"))  # one row for each rounded score
    whole = Window.partitionBy()
    reach = lambda c: F.sum(c).over(above) - F.col(c) + F.col(f"{c}_at")
    curve = per.select(reach("p").alias("p"), reach("n").alias("n"), F.sum("p").over(whole).alias("all_p"), F.sum("n").over(whole).alias("all_n"))
    return matched_over_block(curve.select(F.try_divide("p", "all_p").alias("containment"), F.try_divide(F.col("n") - F.col("p"), F.col("all_n") - F.col("all_p")).alias("over_block")), targets)


def matched_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """(target, a, b, won) of two matched over-block tables: won is NULL where a side has none."""
    both = a.select("target", F.col("over_block").alias("a")).join(b.select("target", F.col("over_block").alias("b")), "target", "full")
    return both.withColumn("won", F.col("a") < F.col("b"))


def cells_won(compared: DataFrame) -> DataFrame:
    """One row for the matched operating point control: cells_won and cells, those that both sides reach."""
    return compared.agg(F.count(F.when(F.col("won"), 1)).alias("cells_won"), F.count("won").alias("cells"))


def coverage_curve(preds: DataFrame, coverages: tuple[float, ...]) -> DataFrame:
    """(coverage, accuracy, kept): in-sample accuracy of the most confident share, ties at the threshold kept."""
    cuts = quantiles(preds, "conf", [1 - c for c in coverages]).select("k", "cut")
    rows = preds.select("conf", (F.col("truth") == F.col("pred")).cast("double").alias("ok"))
    both = rows.join(F.broadcast(cuts), F.col("conf") >= F.col("cut"))  # one row for each coverage
    return both.groupBy("k").agg(F.avg("ok").alias("accuracy"), F.count(F.lit(1)).alias("kept")).select(F.get(F.lit(list(coverages)), F.col("k")).alias("coverage"), "accuracy", "kept")


def ordering_audit(preds: DataFrame, coverages: tuple[float, ...] = (1.0, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4), tolerance: float = 0.005) -> DataFrame:
    """The coverage curve with each step's drop of accuracy, and whether it is over the tolerance."""
    curve = coverage_curve(preds, coverages)
    before = F.lag("accuracy").over(Window.orderBy(F.desc("coverage")))  # one row for each coverage
    return curve.withColumn("fall", before - F.col("accuracy")).withColumn("inverted", F.coalesce(F.col("fall") > tolerance, F.lit(False)))


def coverage_for_target(preds: DataFrame, target: float = 0.99, repeats: int = 20, coverages: tuple[float, ...] = tuple(round(0.95 - 0.05 * k, 2) for k in range(16))) -> DataFrame:
    """(target, coverage): the largest coverage whose mean held-out accuracy reaches the target; NULL if none does."""
    each = heldout_cuts(right_rows(preds), coverages, repeats)
    mean = each.groupBy("k").agg(F.avg(F.try_divide("ok_kept", "n_kept")).alias("accuracy"))
    return mean.agg(F.lit(target).alias("target"), F.max(F.when(F.col("accuracy") >= target, F.get(F.lit(list(coverages)), F.col("k")))).alias("coverage"))


def escalation_needed(preds: DataFrame, targets: tuple[float, ...] = (0.97, 0.99), repeats: int = 40, least_kept: int = 20) -> DataFrame:
    """(target, escalation, reached): the mean share of rows that must go elsewhere for the rest of a held-out half to
    reach the target, over the halves that reach it at a coverage of 0.30 or more; NULL unless over half of them do."""
    coverages = tuple(round(1 - 0.01 * k, 2) for k in range(71))
    each = heldout_cuts(right_rows(preds), coverages, repeats).withColumn("accuracy", F.when(F.col("n_kept") >= least_kept, F.try_divide("ok_kept", "n_kept")))
    need = each.select("rep", "half", "accuracy", F.get(F.lit(list(coverages)), F.col("k")).alias("coverage"), F.explode(F.lit(list(targets))).alias("target"))
    first = need.groupBy("rep", "half", "target").agg((1 - F.max(F.when(F.col("accuracy") >= F.col("target"), F.col("coverage")))).alias("need"))
    out = first.groupBy("target").agg(F.avg("need").alias("mean"), F.avg(F.col("need").isNotNull().cast("double")).alias("reached"))
    return out.select("target", F.when(F.col("reached") > 0.5, F.col("mean")).alias("escalation"), "reached")


def prior_shift(preds: DataFrame, ratios: list[float], taus: tuple[float, ...] = (0.0, 0.5, 1.0, 1.5, 2.0), labels: list[str] | None = None) -> DataFrame:
    """(tau, accuracy) of the argmax of log probabilities plus tau times the log ratio of priors."""
    each = [F.avg((probs.argmax_label(probs.shifted(probs.log_clipped(F.col("probs")), [t * r for r in ratios]), labels) == F.col("truth")).cast("double")) for t in taus]
    return preds.agg(F.array(*(F.struct(F.lit(t).alias("tau"), a.alias("accuracy")) for t, a in zip(taus, each, strict=True))).alias("c")).select(F.inline("c"))


def fold_orders(preds: DataFrame, task: Taxonomy, fold: str) -> DataFrame:
    """One row comparing argmax-then-fold with fold-then-argmax: accuracies, disagreement and the exact sign test."""
    groups, table = task.folded(fold).labels, task.folds[fold]
    first = task.group(table, probs.argmax_label(F.col("probs"), task.labels))
    second = probs.argmax_label(probs.folded(F.col("probs"), task.labels, table), groups)
    rows = preds.select(task.group(table, F.col("truth")).alias("t"), first.alias("a"), second.alias("b"))
    a, b = F.col("a") == F.col("t"), F.col("b") == F.col("t")
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(a.cast("double")).alias("argmax_first"), F.avg(b.cast("double")).alias("fold_first"), F.avg((F.col("a") != F.col("b")).cast("double")).alias("disagreement"), F.sum((a & ~b).cast("long")).alias("only_a"), F.sum((b & ~a).cast("long")).alias("only_b"))
    return one.withColumn("p_value", stats.exact_sign_p(F.col("only_a"), F.col("only_b")))


def fold_aware_abstention(preds: DataFrame, task: Taxonomy, fold: str, head: str, head_conf: str, coverages: tuple[float, ...] = (0.98, 0.95, 0.90, 0.85, 0.80)) -> DataFrame:
    """(strategy, coverage, accuracy, waste), in sample, of three ways to abstain from a folded decision: a head of its
    own that was trained on the groups (columns head and head_conf), the folded prediction by the confidence among
    labels, and the same by the confidence among groups. waste: the share of dropped rows that were right."""
    groups, table = task.folded(fold).labels, task.folds[fold]
    summed = probs.folded(F.col("probs"), task.labels, table)
    truth = task.group(table, F.col("truth"))
    ok = (probs.argmax_label(summed, groups) == truth).cast("double")
    arms = (("binary head", (F.col(head) == truth).cast("double"), F.col(head_conf)), ("naive", ok, F.array_max("probs")), ("fold-aware", ok, F.array_max(summed)))
    rows = preds.select(F.inline(F.array(*(F.struct(F.lit(s).alias("strategy"), o.alias("ok"), c.alias("conf")) for s, o, c in arms))))
    cuts = quantiles(rows, "conf", [1 - c for c in coverages], ["strategy"]).select("strategy", "k", "cut")
    both = rows.join(F.broadcast(cuts), "strategy")
    kept = F.col("conf") >= F.col("cut")
    return both.groupBy("strategy", "k").agg(F.avg(F.when(kept, F.col("ok"))).alias("accuracy"), F.avg(F.when(~kept, F.col("ok"))).alias("waste")).select("strategy", F.get(F.lit(list(coverages)), F.col("k")).alias("coverage"), "accuracy", "waste")


def ensemble_search(member_probs: DataFrame, names: list[str], labels: list[str], most: int = 3) -> DataFrame:
    """(members, size, accuracy) of the mean of each combination of members; member_probs has a vector for each name."""
    from itertools import combinations

    combos = [c for k in range(1, most + 1) for c in combinations(names, k)]

    def mean(c: tuple[str, ...]) -> Column:
        out = F.col(c[0])
        for other in c[1:]:
            out = F.zip_with(out, F.col(other), lambda x, y: x + y)
        return out

    each = [F.struct(F.lit("+".join(c)).alias("members"), F.lit(len(c)).alias("size"), F.avg((probs.argmax_label(mean(c), labels) == F.col("truth")).cast("double")).alias("accuracy")) for c in combos]
    return member_probs.agg(F.array(*each).alias("c")).select(F.inline("c"))


def highest_tier(members: DataFrame, names: list[str], task: Taxonomy) -> DataFrame:
    """Add tier: the highest of the members' predictions, the merge that errs on the safe side; NULL and unknown labels
    don't count, unless all are."""
    top = F.greatest(*(task.rank(F.col(n)) for n in names))
    return members.withColumn("tier", F.when(top >= 0, F.get(F.lit(task.labels), top)))


def rescued_by_fold(preds: DataFrame, task: Taxonomy, fold: str, coverage: float = 0.9) -> DataFrame:
    """One row on the rows that confidence among labels drops and confidence among groups keeps: how many, the share
    that is right after folding, and the share whose votes differ."""
    groups, table = task.folded(fold).labels, task.folds[fold]
    summed = probs.folded(F.col("probs"), task.labels, table)
    ok = (probs.argmax_label(summed, groups) == task.group(table, F.col("truth"))).cast("double")
    split = F.coalesce((F.size(F.array_distinct("votes")) > 1).cast("double"), F.lit(0.0))
    rows = preds.select(ok.alias("ok"), split.alias("split"), F.array_max("probs").alias("fine"), F.array_max(summed).alias("coarse"))
    # stored: every pass and filter below would work out both confidences anew
    with stored(rows, "fold_confidences") as kept:
        cut = lambda c: quantiles(kept, c, [1 - coverage]).select(F.col("cut").alias(f"{c}_cut"))
        cuts = cut("fine").join(F.broadcast(cut("coarse")), F.lit(True))  # one row each
        both = kept.join(F.broadcast(cuts), (F.col("fine") < F.col("fine_cut")) & (F.col("coarse") >= F.col("coarse_cut")))
        found = both.agg(F.count(F.lit(1)).alias("rescued"), F.avg("ok").alias("accuracy"), F.avg("split").alias("contested"))
        return preds.sparkSession.createDataFrame(found.collect(), found.schema)  # one row


def offset_ascent(dev: DataFrame, labels: list[str], passes: int = 6, reach: float = 2.0, steps: int = 41) -> list[float]:
    """Per-label offsets to log probabilities, each set in turn to the value of best accuracy on dev, the first of
    equal ones, until a pass changes nothing.

    One aggregation tries all values of one label's offset: a row is right from one offset on (if the label is its
    truth) or up to one (if not), so rows are counted by that step, and the driver gets a count for each. The logarithms
    are stored, a column a label, as each aggregation reads them all."""
    size = len(labels)
    deltas = [-reach + 2 * reach * k / (steps - 1) for k in range(steps)]
    logs = dev.select(F.array_position(F.lit(labels), F.col("truth")).cast("int").alias("t"), probs.log_clipped(F.col("probs")).alias("l"))
    offsets, best = [0.0] * size, -1.0
    with stored(logs.select("t", *(F.get("l", F.lit(j)).alias(f"l{j}") for j in range(size))), "logarithms") as kept:
        for _ in range(passes):
            before = list(offsets)
            for k in range(size):
                counts = {(r.s, r.w): r.n for r in _steps_won(kept, k, offsets, deltas).groupBy("s", "w").agg(F.count(F.lit(1)).alias("n")).collect()}
                whole = sum(counts.values()) or 1
                # the label wins for the w largest offsets
                hits = [sum(n for (s, w), n in counts.items() if (s == 1 and j >= steps - w) or (s == -1 and j < steps - w)) / whole for j in range(steps)]
                top = max(range(steps), key=lambda j: (hits[j], -j))
                if hits[top] > best:
                    best, offsets[k] = hits[top], deltas[top]
            if offsets == before:
                break
    return offsets


def _steps_won(logs: DataFrame, k: int, offsets: list[float], deltas: list[float]) -> DataFrame:
    """(s, w) of rows (t, l0, l1, ...): w, the number of deltas with which label k wins against the others' offsets, and
    what that does: 1 if k is the truth, -1 if the best of the others is, else 0. Winning begins at one of the deltas
    next to the difference, so only these are tried."""
    steps, rest = len(deltas), [F.lit(float("-inf")) if j == k else F.col(f"l{j}") + b for j, b in enumerate(offsets)]
    rival = F.greatest(*rest) if len(rest) > 1 else rest[0]
    rows = logs.select("t", (F.col(f"l{k}") + 0.0).alias("own"), rival.alias("rival"), *(x.alias(f"x{j}") for j, x in enumerate(rest)))
    first = F.coalesce(*(F.when(F.col(f"x{j}") == F.col("rival"), j) for j in range(len(rest))))  # the first of equal ones wins
    place = (F.col("rival") - F.col("own") - deltas[0]) / ((deltas[-1] - deltas[0]) / (steps - 1))
    near = F.floor(F.least(F.greatest(place, F.lit(0.0)), F.lit(float(steps)))).cast("int")
    rows = rows.select("t", "own", "rival", first.alias("first"), near.alias("near"))

    def wins(j: Column) -> Column:
        mine = F.col("own") + F.get(F.lit(deltas), j)
        return (mine > F.col("rival")) | ((mine == F.col("rival")) & (F.lit(k) < F.col("first")))

    least = F.coalesce(*(F.when(wins(F.col("near") + d), F.col("near") + d) for d in (-1, 0, 1, 2)), F.lit(steps))
    right = F.when(F.col("t") == k + 1, F.lit(1)).when(F.col("t") == F.col("first") + 1, F.lit(-1)).otherwise(0)
    return rows.select(right.alias("s"), F.when(F.col("own").isNull(), 0).otherwise(steps - least).alias("w"))


def offset_report(dev: DataFrame, test: DataFrame, labels: list[str], **settings) -> DataFrame:
    """(part, n, before, after): accuracy of dev and test without and with the offsets that were fitted on dev."""
    offsets = offset_ascent(dev, labels, **settings)
    plain, moved = (probs.argmax_label(p, labels) for p in (F.col("probs"), probs.shifted(probs.log_clipped(F.col("probs")), offsets)))
    share = lambda p: F.avg((p == F.col("truth")).cast("double"))
    one = lambda rows, part: rows.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), share(plain).alias("before"), share(moved).alias("after"))
    return one(dev, "dev").unionByName(one(test, "test"))
