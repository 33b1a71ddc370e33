"""A suite's run: metrics of cells against the row-level ones, cells that add up, decisions, ledger; plans of jobs."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import adapters, metrics, sampling
from gaugeworks.plans import policy, run, specs
from gaugeworks.plans.frames import PRIORITY, predictions
from gaugeworks.sources import rows as sources

SF = "/root/testdata/sf0.001"
TASK = {"signal": "priority", "labels": PRIORITY.labels, "ordered": True, "gates": [{"at": g} for g in PRIORITY.gates], "folds": PRIORITY.folds, "deployment_fold": "route"}
PINNED = {"model_revision": "m", "runtime_revision": "r", "code_revision": "c"}


@pytest.fixture(scope="module")
def preds(spark):
    return spark.createDataFrame(predictions(spark, SF).toPandas(), predictions(spark, SF).schema)


def test_cells_tell_what_rows_tell(spark, preds):
    found = run.metrics_of_cells(run.cells(run.deployed(preds, PRIORITY, PRIORITY.folds["route"])), PRIORITY)
    want = policy.bag(metrics.contract(preds)) | policy.bag(metrics.label_ceiling(preds)) | policy.bag(metrics.calibration(preds))
    want |= {f"{k}/{r.label}": r[k] for r in metrics.per_label(preds, PRIORITY.labels).collect() for k in ("recall", "precision", "f1") if r[k] is not None}
    want |= {f"gate/{r.gate}/{k}": r[k] for r in metrics.gates(preds, PRIORITY).collect() for k in ("containment", "over_block", "released_to_lowest")}
    want.pop("bins"), want.pop("n")
    assert all(math.isclose(found[k], v, abs_tol=1e-9) for k, v in want.items()) and found["n"] == preds.count()


def test_cells_of_new_rows_add_to_stored_ones(preds):
    rows = run.deployed(preds, PRIORITY, PRIORITY.folds["route"])
    parts = run.added(run.cells(rows.where("row_id % 3 = 0")), run.cells(rows.where("row_id % 3 > 0")))
    a, b = run.metrics_of_cells(parts, PRIORITY), run.metrics_of_cells(run.cells(rows), PRIORITY)
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_odd_cells(spark):
    none = run.metrics_of_cells(run.cells(run.deployed(spark.createDataFrame([], "row_id int, truth string, probs array<double>"), PRIORITY)), PRIORITY)
    assert none["n"] == 0 and none["accuracy"] == 0 and "majority_baseline" not in none and "jury_agreement" not in none
    rows = spark.createDataFrame([(1, "5-LOW", [0.0] * 4 + [1.0], None), (2, "unknown", [1.0] + [0.0] * 4, ["x"]), (3, "1-URGENT", [0.0] * 5, [])], "row_id int, truth string, probs array<double>, votes array<string>")
    got = run.metrics_of_cells(run.cells(run.deployed(rows, PRIORITY, PRIORITY.folds["route"])), PRIORITY)
    assert got["n"] == 2 and got["accuracy"] == 1 and got["gate/5-LOW/containment"] == 1 and "recall/2-HIGH" not in got


def test_a_suite_runs_from_texts_to_the_ledger(spark, tmp_path, preds):
    class Model(adapters.Adapter):
        labels = PRIORITY.labels[::-1]  # in an order of its own

        def predict(self, texts):
            out = np.full((len(texts), 5), 0.05)
            for k, t in enumerate(texts):
                out[k, self.labels.index(t.split("/")[0])] = 0.8
            return out

    rows = preds.limit(400).select("row_id", "truth", "votes", F.concat_ws("/", "pred", "row_id").alias("text"))
    suite = specs.Suite("s", specs.Task.of(TASK), [{"id": "orders", "digest": "1"}], controls=["baseline_lift", "calibration", "runtime_slo"], runtime={"p99_ms": 10_000.0}, promotion=policy.Promotion(allow_warnings=True))
    got = run.run_suite(suite, rows, PINNED, Model(), ledger=f"{tmp_path}/l", run="one", repeats=3)
    m = got.report.metrics
    assert m["runtime/succeeded"] == m["n"] == 400 and m["runtime/p99_ms"] > 0
    direct = preds.limit(400).agg(F.avg((F.col("truth") == F.col("pred")).cast("double"))).first()[0]
    assert math.isclose(m["accuracy"], direct) and {"selective/accuracy@0.90", "enrichment", "ece", "confident_half_spread", "decided/accuracy"} <= m.keys() | {"enrichment", "confident_half_spread"}
    assert {c.control: c.status for c in got.report.controls}["runtime_slo"] == "PASS" and got.exit_code == policy.exit_code(got.decision)
    assert [r.digest() for r in sources.report_rows(spark, f"{tmp_path}/l")] == [got.report.digest()]
    wants = specs.Suite("s", specs.Task.of(TASK), [{"id": "orders", "digest": "1"}], required_metrics=["accuracy", "latency"], controls=["baseline_lift"])
    assert run.run_suite(wants, preds.limit(100), PINNED, repeats=2).decision == "REJECT"
    empty = run.run_suite(wants, preds.where("false"), PINNED)
    assert (empty.decision, empty.exit_code) == ("NONE", 2)


@pytest.mark.parametrize(("size", "per"), [(100, 3), (7, 5), (6, 2), (4, 2), (0, 2)])
def test_exemplars_are_dealt_evenly(spark, size, per):
    labels = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "label string")
    pool = spark.range(size).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("k"))
    plan = [sampling.exemplar_plan(labels, pool.repartition(n), "k", per).collect() for n in (1, 5)]
    assert sorted(plan[0]) == sorted(plan[1]) and len(plan[0]) == 3 * per * min(6, size)
    jobs, uses = {}, Counter()
    for r in plan[0]:
        jobs.setdefault(r.job, set()).add(r.k)
        uses[r.k] += 1
    assert all(len(v) == min(6, size) for v in jobs.values())
    assert not size or (len(uses) == min(size, 18 * per) and max(uses.values()) - min([*uses.values(), *([0] if len(uses) < size else [])]) <= 1)


def test_plans_over_pairs(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "a string, b string")
    got = sampling.boundary_plan(pairs, ["x", "y", "z"], 6).collect()
    assert len(got) == len({r.job for r in got}) == 12 and Counter((r.a, r.domain) for r in got) == Counter({(p, d): 2 for p in "ab" for d in "xyz"})
    assert sorted(got) == sorted(sampling.boundary_plan(pairs.repartition(3), ["x", "y", "z"], 6).collect())
    anti = sampling.anticue_plan(pairs.toDF("label", "decoy"), ["x", "y"]).collect()
    assert len(anti) == 14 and {r.kind for r in anti} == {"anticue"}
