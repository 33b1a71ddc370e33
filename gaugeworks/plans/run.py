"""A whole run of a suite: rows and predictions are read once into a narrow stored table, one aggregation of which gives every
metric that counts tell; metrics of confidence are read in the space that decisions are made in.

The cells of that aggregation add up: cells of new rows are added to stored ones, and the metrics follow from the sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import probs as P
from gaugeworks.operators import adapters, metrics
from gaugeworks.operators.folds import Taxonomy
from gaugeworks.operators.votes import contested, unanimous
from gaugeworks.plans import policy
from gaugeworks.plans.specs import Suite
from gaugeworks.sources import sinks
from gaugeworks.stored import stored

BINS = 10
CELL = ("truth", "pred", "group", "decided", "bin", "votes")


def deployed(rows: DataFrame, task: Taxonomy, fold: dict[str, str] | None = None) -> DataFrame:
    """Of rows (row_id, truth, probs, votes if there are any): the prediction and confidence as trained, the same as
    decided (group, decided, decided_conf), where the fold of the deployment sums probabilities, and what the votes say: same,
    mixed, or null without any. Rows of unknown truth go."""
    fold = task.folds[task.deployment_fold] if fold is None and task.deployment_fold else fold
    names = sorted(set(fold.values())) if fold else task.labels
    known = rows.where(task.rank(F.col("truth")) >= 0)
    summed = P.folded(F.col("probs"), task.labels, fold) if fold else F.col("probs")
    group = task.group(fold, F.col("truth")) if fold else F.col("truth")
    held = F.col("votes") if "votes" in rows.columns else F.lit(None).cast("array<string>")
    voted = F.when(F.size(held) > 0, F.when(unanimous(held), "same").otherwise("mixed"))
    wide = known.select("row_id", "truth", "probs", group.alias("group"), summed.alias("_d"), voted.alias("votes"), contested(held).alias("contested"))
    return wide.select(
        "row_id", "truth", P.argmax_label(F.col("probs"), task.labels).alias("pred"), F.array_max("probs").alias("conf"),
        "group", P.argmax_label(F.col("_d"), names).alias("decided"), F.array_max("_d").alias("decided_conf"), "votes", "contested",
    )


def cells(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """(truth, pred, group, decided, bin, votes, n, conf): rows of deployed() counted, and their confidences summed. The
    number of cells depends on the labels alone; bins are (lo, hi], null for a confidence in none."""
    edges = [k * 0.1 if bins == 10 else k / bins for k in range(bins)]
    place = F.lit(None).cast("int")
    for k, low in reversed(list(enumerate(edges))):
        place = F.coalesce(place, F.when(F.col("conf") > low, k))
    at = rows.withColumn("bin", F.when(F.col("conf") <= 1, place))
    return at.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("conf"))


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    """The cells of the rows of both."""
    return a.unionByName(b).groupBy(*CELL).agg(F.sum("n").alias("n"), F.sum("conf").alias("conf"))


@dataclass
class _Counts:
    """Cells on the driver, as numbers by any of their columns."""

    rows: list

    def of(self, where: Callable = lambda r: True) -> int:
        return sum(r.n for r in self.rows if where(r))

    def by(self, key: Callable, where: Callable = lambda r: True) -> dict:
        out: dict = {}
        for r in self.rows:
            if where(r):
                out[key(r)] = out.get(key(r), 0) + r.n
        return out


def _ratio(a: float, b: float) -> float | None:
    return a / b if b else None


def _mean(values: list[float]) -> float | None:
    return sum(values) / len(values) if values else None


def metrics_of_cells(found: DataFrame, task: Taxonomy) -> dict[str, float]:
    """Every metric that counts tell, by name: accuracy and baselines, each label's recall, precision and F1, label ceiling,
    calibration, gates, and the accuracy of decisions. What is undefined is left out."""
    c = _Counts(found.collect())
    n = c.of()
    right = lambda r: r.truth == r.pred
    truths, preds, hits = c.by(lambda r: r.truth), c.by(lambda r: r.pred), c.by(lambda r: r.truth, right)
    k = sum(hits.values())
    m: dict[str, float | None] = {"n": n, "accuracy": k / max(n, 1), "majority_baseline": _ratio(max(truths.values(), default=0), n), "minority_share": _ratio(min(truths.values(), default=0), n)}
    m["lift_over_chance"] = m["accuracy"] - (m["majority_baseline"] or 0.0)
    z, p = 1.96, k / max(n, 1)
    scale, middle, half = 1 + z * z / max(n, 1), p + z * z / (2 * max(n, 1)), z * math.sqrt(p * (1 - p) / max(n, 1) + z * z / (4 * max(n, 1) ** 2))
    m |= {"wilson95_lo": max(0.0, (middle - half) / scale) if n else 0.0, "wilson95_hi": min(1.0, (middle + half) / scale) if n else 0.0}
    f1 = {}
    for x in task.labels:
        recall, precision = _ratio(hits.get(x, 0), truths.get(x, 0)), _ratio(hits.get(x, 0), preds.get(x, 0))
        f1[x] = 2 * recall * precision / (recall + precision) if hits.get(x) else 0.0 if truths.get(x) and preds.get(x) else None
        m |= {f"recall/{x}": recall, f"precision/{x}": precision, f"f1/{x}": f1[x]}
    m |= {"macro_f1": _mean([v for v in f1.values() if v is not None]), "macro_f1_all": sum(v or 0.0 for v in f1.values()) / len(task.labels), "balanced_accuracy": _mean([hits.get(x, 0) / truths[x] for x in task.labels if truths.get(x)])}
    voted = c.of(lambda r: r.votes is not None)
    if voted:
        same, mixed = ((lambda r, v=v: r.votes == v) for v in ("same", "mixed"))
        ok = lambda side: _ratio(c.of(lambda r: side(r) and right(r)), c.of(side))
        m |= {"jury_agreement": c.of(same) / voted, "contested_share": c.of(mixed) / voted, "accuracy_unanimous": ok(same), "accuracy_contested": ok(mixed)}
        m["error_on_unanimous"] = None if ok(same) is None else 1 - ok(same)
        m["ceiling_from_perfect_labels"] = c.of(lambda r: r.votes == "mixed" or (r.votes == "same" and right(r))) / voted
    inside, conf = c.by(lambda r: r.bin, lambda r: r.bin is not None), {}
    for r in c.rows:
        conf[r.bin] = conf.get(r.bin, 0.0) + (r.conf or 0.0)
    binned = c.by(lambda r: r.bin, right)
    gaps = {b: abs(conf[b] - binned.get(b, 0)) / size for b, size in inside.items()}
    m |= {"ece": sum(gaps[b] * size for b, size in inside.items()) / max(n, 1), "mce": max(gaps.values(), default=0.0), "overconfidence": _ratio(sum(conf.values()) - k, n)}
    rank = {x: j for j, x in enumerate(task.labels)}
    for gate in task.gates:
        at = rank[gate]
        share = lambda side, hit: _ratio(c.of(lambda r: side(r) and hit(r)), c.of(side))
        above, below, over = (lambda r: rank[r.truth] >= at), (lambda r: rank[r.truth] < at), (lambda r: rank[r.pred] >= at)  # noqa: B023
        m |= {f"gate/{gate}/containment": share(above, over), f"gate/{gate}/over_block": share(below, over), f"gate/{gate}/released_to_lowest": share(above, lambda r: rank[r.pred] == 0)}
    m["decided/accuracy"] = _ratio(c.of(lambda r: r.group == r.decided), n)
    return {k: float(v) for k, v in m.items() if v is not None}


def decided_rows(rows: DataFrame) -> DataFrame:
    """Rows of deployed() as the metrics of confidence read them: truth, prediction and confidence of the decision."""
    return rows.select("row_id", F.col("group").alias("truth"), F.col("decided").alias("pred"), F.col("decided_conf").alias("conf"), "contested")


def confidence_metrics(rows: DataFrame, coverages: tuple[float, ...] = (0.95, 0.90, 0.80, 0.70), repeats: int = 40) -> dict[str, float]:
    """Half spread, risk at each coverage and enrichment of contested rows, of decisions."""
    own = decided_rows(rows)
    m = policy.bag(metrics.confident_half_spread(own))
    for r in metrics.risk_coverage(own, coverages, repeats).collect():
        m |= {f"selective/{k}@{r.coverage:.2f}": v for k, v in (("accuracy", r.accuracy), ("waste", r.waste)) if v is not None}
    return m | policy.bag(metrics.enrichment_of(own, F.col("contested")))


@dataclass
class Run:
    report: policy.Report
    decision: str
    reasons: list[str]
    exit_code: int


def run_suite(suite: Suite, rows: DataFrame, classifier: dict[str, str], adapter: adapters.Adapter | None = None, context: dict | None = None, champion: dict[str, float] | None = None, ledger: str | None = None, run: str = "run", repeats: int = 40) -> Run:
    """Measure a suite's classifier on rows (row_id, text, truth, votes; or with probs instead of text), check its controls,
    planes and promotion, and append the report to a ledger. context adds what the rows don't tell, such as seed
    scores, traffic or judged answers. Without rows there is no decision (exit code 2)."""
    task = suite.task.taxonomy()
    more = dict(context or {})
    if adapter is not None:
        with stored(adapters.predict(rows, adapter), "answers") as answers:
            return _measured(suite, task, adapters.with_answers(rows, answers).withColumn("probs", P.reordered(F.col("probs"), adapter.labels, task.labels)), classifier, {"runtime": policy.bag(metrics.runtime_summary(answers))} | more, champion, ledger, run, repeats)
    return _measured(suite, task, rows, classifier, more, champion, ledger, run, repeats)


def _measured(suite: Suite, task: Taxonomy, rows: DataFrame, classifier: dict[str, str], context: dict, champion: dict[str, float] | None, ledger: str | None, run: str, repeats: int) -> Run:
    with stored(deployed(rows, task), "scored_rows") as kept:
        counted = cells(kept)
        found = metrics_of_cells(counted, task)
        if found["n"]:
            found |= confidence_metrics(kept, repeats=repeats)
    found |= {f"runtime/{k}": v for k, v in (context.get("runtime") or {}).items()}
    curve = [(float(k.partition("@")[2]), v) for k, v in found.items() if k.startswith("selective/accuracy@")]
    whole = {"metrics": found, "curve": curve, "gates": task.gates, "seed_scores": [found["accuracy"]], "noise_floor": suite.task.noise_floor, "slo": suite.runtime, "identity": classifier, "expected_identity": suite.expected_identity, "dataset_manifest": suite.datasets} | context
    report = policy.qualify(suite.name, suite.task.digest(), classifier, [{"id": d["id"], "digest": d.get("digest", "MISSING")} for d in suite.datasets], whole, suite.required_planes, suite.controls)
    if not found["n"]:
        return Run(report, "NONE", ["no rows"], policy.exit_code(None))
    decision, reasons = policy.promotion(report, suite.promotion, champion)
    if lacks := suite.missing(found):
        decision, reasons = "REJECT", [*reasons, f"metrics missing from the contract: {', '.join(lacks)}"]
    if ledger:
        sinks.append_ledger(rows.sparkSession, report, ledger, run)
    return Run(report, decision, reasons, policy.exit_code(decision))
