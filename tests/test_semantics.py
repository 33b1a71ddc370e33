"""Rules that change answers: ties, undefined ratios, bins, medians, folds, votes, controls."""

import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions import probs, stats, tables, text
from gaugeworks.operators import folds, metrics, sampling, votes
from gaugeworks.operators.folds import Taxonomy
from gaugeworks.operators.metrics import CONTRACT
from gaugeworks.plans import policy, specs
from gaugeworks.sources import rows as sources
from gaugeworks.sources import sinks
from gaugeworks.sources.ledger import committed
from gaugeworks.streaming import shadow


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_vectors(spark):
    p = F.array(*(F.lit(x) for x in (0.4, 0.4, 0.2)))
    r = one(spark, probs.argmax_label(p, ["a", "b", "c"]), probs.folded(p, ["a", "b", "c"], {"a": "W", "b": "T", "c": "W"}), probs.margin(p), probs.top_two(p), probs.normalised(F.array(F.lit(0.0), F.lit(0.0))))
    assert r[0] == "a" and r[1] == pytest.approx([0.4, 0.6]) and r[2] == 0 and r[3] == [0, 1] and r[4] == [0.5, 0.5]
    s = one(spark, probs.softmax(F.array(F.lit(3.395), F.lit(-0.251), F.lit(None), F.lit(float("nan")))))[0]
    assert sum(s) == pytest.approx(1) and s[2] == s[3] == 0 and s[0] > s[1]
    t = one(spark, probs.soft_target(F.lit(["a", "a", "z"]), ["a", "b"]), probs.soft_target(F.lit(["z"]), ["a", "b"]), probs.smoothed_ordinal(F.lit(0), 4))
    own = one(spark, probs.smoothed(F.array(*map(F.lit, (0.5, 0.5, 0.0, 0.0))), 4), probs.soft_target(F.lit(["a"]), ["a", "b"], given=F.array(F.lit(0.2), F.lit(0.8))), probs.soft_target(F.lit(["a"]), ["a", "b"], given=F.array(F.lit(1.0))), probs.reordered(F.array(F.lit(0.2), F.lit(0.8)), ["a", "b"], ["b", "z", "a"]), stats.nearest_rank(F.array(*map(F.lit, (3, 1, 2, 4))), 0.5))
    assert own[0] == pytest.approx([0.44 + 0.06 * 0.4, 0.44 + 0.06 * 2 / 3, 0.06 * (1 / 3 + 0.4), 0.06 * 0.2]) and own[1] == [0.2, 0.8] and own[2][0] > 0.9 and own[3] == [0.8, 0.0, 0.2] and own[4] == 3
    assert sum(t[0]) == pytest.approx(1) and t[1] is None and sum(t[2]) == pytest.approx(1)


def test_statistics(spark):
    low, high = stats.wilson(F.lit(374), F.lit(418))
    r = one(spark, low, high, *stats.wilson(F.lit(0), F.lit(0)), stats.exact_sign_p(F.lit(4), F.lit(8)), stats.exact_sign_p(F.lit(1), F.lit(0)), stats.upper_median(F.array(*map(F.lit, (4, 1, 3, 2)))), stats.sigma_from_range(F.lit(0.0085), F.lit(4)))
    assert (r[0], r[1]) == pytest.approx((0.861636, 0.920648), abs=1e-6)
    assert r[2:4] == (0, 0) and r[4] == pytest.approx(0.3877, abs=1e-4) and r[5] == pytest.approx(1) and r[6] == 3 and r[7] == pytest.approx(0.0041, abs=1e-4)


def test_exact_sign_probabilities(spark):
    """Against sums of whole numbers, and at counts that no list of all terms would hold."""
    pairs = [(0, 1), (1, 1), (3, 9), (40, 60), (0, 200), (500, 520), (7, 7)]
    rows = spark.createDataFrame(pairs, "b bigint, c bigint").select("b", "c", stats.exact_sign_p(F.col("b"), F.col("c")).alias("p")).collect()
    for r in rows:
        n, least = r.b + r.c, min(r.b, r.c)
        assert r.p == pytest.approx(min(1.0, 2 * sum(math.comb(n, k) for k in range(least + 1)) / 2**n), rel=1e-9)
    z = one(spark, stats.exact_sign_p(F.lit(5_000_000_000), F.lit(5_000_200_000)))[0]
    assert z == pytest.approx(math.erfc(2.0 / math.sqrt(2)), rel=1e-4)


def test_text(spark):
    t = F.lit(" Ab  C\n\nd. E! f ")
    long = "“" + "q" * 80 + " ” and \"" + "r" * 90 + '"'
    assert one(spark, text.quoted_spans(F.lit(long)))[0] == ["q" * 80, "r" * 90]
    assert list(one(spark, text.scheme_of(F.lit("GRPC://x")), text.scheme_of(F.lit("a/b")), text.level_of(F.lit("selective/accuracy@0.90")), text.level_of(F.lit("accuracy")), text.capped(F.lit("abcdef"), 3))) == ["grpc", "", 0.9, None, "abc"]
    r = one(spark, text.normal(t), text.word_count(F.lit("  a b\tc ")), text.sentences(F.lit("A b. C? d\ne")), text.newlines(t))
    assert r[0] == "ab c d. e! f" and r[1] == 3 and r[2] == ["A b.", "C?", "d", "e"] and r[3] == 2
    assert one(spark, text.key(F.lit("A  b")) == text.key(F.lit(" a\nB ")))[0]


def test_functions_of_sql_give_what_columns_give(spark):
    tables.register_tables(spark)
    quote = '"' + "q" * 90 + '"'
    df = spark.createDataFrame([(1, None), (2, ""), (3, f"One. Two!  {quote} “{'c' * 100}”"), (4, "p" * 90 + "\n \n" + " r" * 50 + "\n\nshort\n\n" + "s" * 80), (5, '"' + " " * 90 + '" then'), (6, "a.b c? d\n\ne")], "id int, t string")
    got = spark.sql("SELECT id, segments_of(t) AS s, sentences_of(t) AS u FROM {df}", df=df)
    want = df.select("id", text.segments(F.col("t")).alias("s"), text.sentences(F.col("t")).alias("u"))
    assert sorted(got.collect()) == sorted(want.collect())
    plan = spark.sql("SELECT id, at, s FROM (SELECT id, segments_of(t) AS p FROM {df}) LATERAL VIEW posexplode(p) x AS at, s", df=df)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_votes(spark):
    df = spark.createDataFrame([(1, ["a", "a", "a"]), (2, ["b", "a", "b"]), (3, ["a", "b", "c"]), (4, ["a", None, "a"]), (5, []), (6, None)], "row_id int, votes array<string>")
    got = {r.row_id: (r.stratum, r.tier) for r in votes.adjudicate(df).collect()}
    assert got == {1: ("gold", "a"), 2: ("contested", "b"), 3: ("unresolved", None), 4: ("unanswered", None), 5: ("unanswered", None), 6: ("unanswered", None)}
    tie = spark.createDataFrame([(1, ["b", "a", "a", "b"]), (2, ["a", "b", "b"])], "row_id int, votes array<string>")
    assert [r.l for r in tie.select(votes.plurality(F.col("votes")).label.alias("l")).collect()] == ["b", "b"]
    assert [(r.row_id, r.tier, r.unstable) for r in votes.self_consistent(tie).collect()] == [(2, "b", True)]
    assert [r.c for r in df.select(votes.contested(F.col("votes")).alias("c")).collect()][4:] == [False, False]


def test_taxonomies(spark):
    for bad in ({"labels": ["a", "a"]}, {"labels": ["a"], "gates": ["a"]}, {"labels": ["a", "b"], "ordered": True, "gates": ["z"]}, {"labels": ["a", "b"], "folds": {"f": {"a": "x"}}}):
        with pytest.raises(ValueError):
            Taxonomy("t", **bad)
    t = Taxonomy("t", ["LOW", "MID", "HIGH"], ordered=True, folds={"f": {"LOW": "z", "MID": "z", "HIGH": "y"}})
    assert t.folded("f").labels == ["y", "z"] and t.folded("f").gates == []
    df = spark.createDataFrame([("LOW", ["MID", "other"]), ("HIGH", ["other"]), ("none", ["LOW"])], "truth string, votes array<string>")
    assert {(r.truth, tuple(r.votes)) for r in folds.fold_rows(df, t, t.folds["f"]).collect()} == {("z", ("z",)), ("y", ("y",))}
    found = {r.name: r for r in folds.fold_search(df.where("truth <> 'none'"), t).collect()}
    assert len(found) == 3 and found["LOW | MID+HIGH"].agreement == 0.5


def test_metrics_of_a_published_confusion(spark):
    """Rows rebuilt so that 374 of 418 are right give the recorded interval."""
    df = spark.createDataFrame([("a", "a")] * 374 + [("a", "b")] * 20 + [("b", "a")] * 24, "truth string, pred string")
    r = metrics.contract(df).first()
    assert r.n == 418 and r.accuracy == pytest.approx(0.894737, abs=1e-6) and r.minority_share == pytest.approx(24 / 418)
    f = metrics.macro_f1(df, ["a", "b", "c"]).first()
    assert f.macro_f1_all == pytest.approx(f.macro_f1_defined * 2 / 3)
    empty = metrics.contract(df.limit(0)).first()
    assert empty.n == 0 and empty.accuracy == 0 and empty.wilson95_lo == 0
    labels = {r.label: r for r in metrics.per_label(df, ["a", "b", "c"]).collect()}
    assert labels["c"].recall is None and labels["c"].precision is None and labels["b"].recall == 0


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, "a"), (0.1, "a"), (0.3, "a"), (0.30000000000000004, "a"), (1.0, "b")], "conf double, pred string").withColumn("truth", F.lit("a"))
    assert {r.bin: r.n for r in metrics.calibration_bins(df).collect()} == {0: 1, 2: 2, 9: 1}
    assert metrics.confident_half_spread(df.limit(3)).first()[0] is None


def test_gates(spark):
    t = Taxonomy("t", ["LOW", "MID", "HIGH"], ordered=True, gates=["MID", "HIGH"])
    df = spark.createDataFrame([("LOW", "LOW"), ("LOW", "MID"), ("MID", "LOW"), ("MID", "HIGH")], "truth string, pred string")
    got = {r.gate: r for r in metrics.gates(df, t).collect()}
    assert (got["MID"].containment, got["MID"].over_block, got["MID"].released_to_lowest) == (0.5, 0.5, 0.5)
    assert got["HIGH"].containment is None and got["HIGH"].over_block == 0.25


def test_balancing(spark):
    df = spark.createDataFrame([(k, "abbcccc"[k]) for k in range(7)], "row_id int, label string")
    got = sampling.balanced(df, "label").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"a": 2, "b": 2, "c": 2}


def context(**more):
    return {"metrics": {"minority_share": 0.2, "lift_over_chance": 0.3, "accuracy": 0.9, "majority_baseline": 0.6, "n": 100.0}} | more


@pytest.mark.parametrize(
    ("name", "more", "status"),
    [
        ("baseline_lift", {}, "PASS"), ("baseline_lift", {"metrics": {"minority_share": 0.05, "lift_over_chance": 0.3}}, "FAIL"), ("baseline_lift", {"metrics": {"minority_share": 0.2, "lift_over_chance": 0.03}}, "WARN"),
        ("baseline_lift", {"metrics": {"minority_share": 0.2, "lift_over_chance": 0.01}}, "FAIL"), ("seed_stability", {}, "FAIL"), ("seed_stability", {"seed_scores": [0.8, 0.801]}, "WARN"),
        ("seed_stability", {"seed_scores": [0.8, 0.801], "noise_floor": 0.004}, "PASS"), ("seed_stability", {"seed_scores": [0.8, 0.9], "noise_floor": 0.004}, "FAIL"), ("holdout_integrity", {}, "NOT_APPLICABLE"),
        ("matched_operating_point", {"gates": ["g"], "champion_comparison": {"cells_won": 5, "cells": 9}}, "PASS"), ("matched_operating_point", {"gates": ["g"], "champion_comparison": {"cells_won": 4, "cells": 9}}, "FAIL"),
        ("calibration", {"metrics": {"ece": 0.11}}, "WARN"), ("calibration", {"metrics": {"ece": 0.05, "enrichment": 1.5}}, "PASS"), ("confidence_ordering", {"curve": [(1.0, 0.8), (0.9, 0.85), (0.8, 0.84)]}, "FAIL"),
        ("confidence_ordering", {"curve": [(1.0, 0.8), (0.9, 0.85), (0.8, 0.848)]}, "PASS"), ("confidence_ordering", {"curve": [(1.0, 0.8)]}, "NOT_APPLICABLE"), ("traffic_alignment", {}, "WARN"),
        ("traffic_alignment", {"traffic": {"separability": 0.95}}, "FAIL"), ("traffic_alignment", {"traffic": {"separability": 0.6}}, "PASS"), ("runtime_slo", {}, "NOT_APPLICABLE"),
        ("runtime_slo", {"runtime": {"coverage": 0.98}}, "FAIL"), ("runtime_slo", {"runtime": {"coverage": 1.0, "p95_ms": 17.0}, "slo": {"p95_ms": 20}}, "WARN"), ("runtime_slo", {"runtime": {"coverage": 1.0, "p95_ms": 21.0}, "slo": {"p95_ms": 20}}, "FAIL"),
        ("corpus_immutability", {}, "FAIL"), ("corpus_immutability", {"dataset_manifest": [{"id": "a", "digest": "0f"}]}, "PASS"), ("judge_integrity", {"judge": {"position_randomised": True, "longer_answer_win_rate": 0.7}}, "FAIL"),
        ("artifact_identity", {"identity": {"model_revision": "abc"}, "expected_identity": {"model_revision": "ab"}}, "PASS"), ("artifact_identity", {"identity": {"model_revision": "abc"}, "expected_identity": {"model_revision": ""}}, "WARN"),
    ],
)
def test_controls(name, more, status):
    assert policy.run_controls(context() | more, [name])[0].status == status


GOOD = context(seed_scores=[0.9, 0.901], noise_floor=0.004, dataset_manifest=[{"id": "a", "digest": "0f"}], traffic={"separability": 0.6})
PINNED = {"model_revision": "a", "runtime_revision": "b", "code_revision": "c"}


def report(context=GOOD, required=(), classifier=PINNED):
    return policy.qualify("s", "t", classifier, [{"id": "a", "digest": "0f"}], context, list(required))


def test_a_floor_is_a_property_of_a_config():
    r = policy.run_controls(context(seed_scores=[0.90, 0.9025], noise_floor=0.002, floor_measured_on="other", config_id="this"), ["seed_stability"])[0]
    assert r.status == "WARN" and "property of a config" in r.detail


def test_planes():
    found = report().planes
    assert found == {"classifier_quality": "PASS", "decision_quality": "NOT_EVALUATED", "runtime_quality": "NOT_EVALUATED", "traffic_validity": "PASS", "outcome_value": "NOT_EVALUATED"}
    measured = GOOD["metrics"] | {"selective/accuracy@0.90": 0.9, "runtime/classification_coverage": 1.0, "ece": 0.2}
    found = report(GOOD | {"metrics": measured, "traffic": {"separability": 0.0}, "outcome": {"delta": 1}}).planes
    assert found == {"classifier_quality": "WARN", "decision_quality": "PASS", "runtime_quality": "PASS", "traffic_validity": "NOT_EVALUATED", "outcome_value": "NOT_EVALUATED"}
    assert report(GOOD | {"metrics": measured | {"outcome/objective_delta": 0.1}, "outcome": {"delta": 1}}).planes["outcome_value"] == "PASS"


def test_verdicts_and_promotion():
    good = report(required=["classifier_quality"])
    assert good.verdict == "QUALIFIED" and good.unpinned() == [] and policy.promotion(good, policy.Promotion()) == ("PROMOTE", ["all conditions are met"])
    assert report(required=["runtime_quality"]).verdict == "INCOMPLETE"
    bad = report(GOOD | {"dataset_manifest": []})
    assert bad.verdict == "REJECTED" and policy.promotion(bad, policy.Promotion())[0] == "REJECT" and policy.summary(bad.controls)[:2] == ("NOT_QUALIFIED", ["corpus_immutability"])
    with pytest.raises(ValueError):
        policy.run_controls(GOOD, ["nothing"])
    warned = report(GOOD | {"traffic": None})
    assert warned.verdict == "QUALIFIED_WITH_WARNINGS" and policy.summary(warned.controls)[0] == "QUALIFIED_WITH_WARNING"
    decide = lambda r, champion=None, **rules: policy.promotion(r, policy.Promotion(**rules), champion)[0]
    assert decide(warned) == "PROMOTE" and decide(warned, allow_warnings=False) == "REJECT"
    unfinished = report(required=["runtime_quality"])
    assert decide(unfinished) == "INCOMPLETE" and decide(report(required=["runtime_quality"], classifier={})) == "REJECT"
    assert decide(report(classifier={})) == "REJECT" and decide(report(classifier={}), require_reproducible=False) == "PROMOTE"
    assert decide(good, require_planes=("outcome_value",)) == "INCOMPLETE" and decide(good, minimum_lift_over_baseline=0.31) == "REJECT" and decide(good, minimum_lift_over_baseline=0.29) == "PROMOTE"
    assert decide(good, {"lift_over_chance": 0.306}) == "REJECT" and decide(good, {"lift_over_chance": 0.304}) == "PROMOTE" and decide(good, {"lift_over_chance": 0.4}, max_regression_vs_champion=None) == "PROMOTE"
    assert [policy.exit_code(d) for d in ("PROMOTE", "PROMOTE_WITH_REVIEW", "INCOMPLETE", "REJECT", None)] == [0, 0, 1, 1, 2]
    assert good.digest() == report(required=["classifier_quality"]).digest() != bad.digest()


def test_comparisons_tell_what_an_average_hides():
    def against(mine, theirs, **rules):
        side = lambda m: report(GOOD | {"metrics": GOOD["metrics"] | m})
        return policy.compare(side(mine), side(theirs), policy.Promotion(**rules))

    same = against({}, {})
    assert same.decision == "PROMOTE" and same.disagreements == [] and [k for k, _ in same.ordered()][0] == "lift_over_chance"
    sign = against({"accuracy": 0.91, "lift_over_chance": 0.299}, {})
    assert sign.decision == "PROMOTE_WITH_REVIEW" and "sign" in sign.disagreements[0]
    leak = against({"accuracy": 0.91, "gate/g/containment": 0.90, "gate/g/released_to_lowest": 0.02}, {"gate/g/containment": 0.95, "gate/g/released_to_lowest": 0.01})
    assert leak.decision == "PROMOTE_WITH_REVIEW" and len(leak.disagreements) == 2 and set(leak.deltas) >= {"gate/g/containment", "accuracy"} and "n" not in leak.deltas
    assert "PROMOTE_WITH_REVIEW" in sinks.comparison_text(leak) and "<- primary" in sinks.comparison_text(leak)


def test_controls_of_ones_own():
    policy.register("even_rows", lambda c: ("PASS" if c["metrics"]["n"] % 2 == 0 else "FAIL", ""), blocking=False)
    try:
        assert policy.run_controls(GOOD, ["even_rows"])[0].status == "PASS"
    finally:
        del policy.CONTROLS["even_rows"]
        policy.ADVISORY.discard("even_rows")


def test_reports_are_read_back_leniently():
    first = report()
    again = policy.Report.from_dict(first.to_dict())
    assert again == first and again.digest() == first.to_dict()["report_digest"]
    old = policy.Report.from_dict({"suite": "s", "controls": {"checks": [{"control": "x", "passed": False}]}, "planes_evaluated": ["a"], "planes": [{"plane": "p", "status": "WARN"}]})
    assert old.controls[0].status == "FAIL" and old.planes == {"p": "WARN"} and old.metrics == {}


def test_tasks_and_suites(tmp_path):
    task = {"signal": "cost", "labels": ["LOW", "MID", "HIGH"], "ordered": True, "gates": [{"at": "HIGH"}], "folds": {"f": {"LOW": "z", "MID": "z", "HIGH": "y"}}, "deployment_fold": "f", "abstention": {"enabled": True, "fallback_class": "HIGH"}}
    (tmp_path / "local").mkdir()
    (tmp_path / "shared").mkdir()
    (tmp_path / "shared" / "cost.json").write_text(json.dumps(task | {"description": "shared"}))
    own = lambda **more: specs.Task.of(task | more)
    assert specs.Task.named("cost", tmp_path / "local", tmp_path / "shared").description == "shared"
    (tmp_path / "local" / "cost.json").write_text(json.dumps(task))
    found = specs.Task.named("cost", tmp_path / "local", tmp_path / "shared")
    assert found.description == "" and found.as_deployed()[0].labels == ["y", "z"] and found.taxonomy().gates == ["HIGH"]
    with pytest.raises(FileNotFoundError, match="cost"):
        specs.Task.named("other", tmp_path / "local")
    for bad in ({"deployment_fold": "g"}, {"ordered": False}, {"abstention": {"fallback_class": "x"}}, {"gates": [{"at": "x"}]}, {"folds": {"f": {"LOW": "z"}}}):
        with pytest.raises(ValueError):
            own(**bad)
    assert own().digest() == own(description="x").digest() != own(labels=["MID", "LOW", "HIGH"]).digest()
    assert own().fold_digest("f") == own(folds=task["folds"] | {"g": task["folds"]["f"]}).fold_digest("g")
    suite = {"apiVersion": specs.API_VERSION, "kind": specs.KIND, "metadata": {"name": "s"}, "spec": {"task": "cost", "datasets": [{"id": "d", "_digest": "0"}], "controls": ["baseline_lift"], "runtime": {"p95_ms": 20}, "requiredPlanes": ["runtime_quality"], "promotion": {"allow_warnings": False}}}
    (tmp_path / "s.json").write_text(json.dumps(suite))
    s = specs.Suite.load(tmp_path / "s.json", tmp_path / "local")
    assert (s.controls, s.runtime, s.required_planes, s.promotion.allow_warnings, s.required_metrics) == (["baseline_lift"], {"p95_ms": 20}, ["runtime_quality"], False, list(CONTRACT))
    assert s.missing({"accuracy": 1.0}) == [m for m in CONTRACT if m != "accuracy"]
    for name in ("t.json", "t.yaml"):
        s.write(tmp_path / name)
        assert specs.Suite.load(tmp_path / name, tmp_path / "local").digest() == s.digest() and "_digest" not in (tmp_path / name).read_text()
    for bad in ({"kind": "Other"}, {"apiVersion": "x/v2"}, {"spec": suite["spec"] | {"controls": ["nothing"]}}):
        (tmp_path / "bad.json").write_text(json.dumps(suite | bad))
        with pytest.raises(ValueError):
            specs.Suite.load(tmp_path / "bad.json", tmp_path / "local")
    assert specs.adapter_reference("grpc://h:1/x") == ("grpc", "h:1/x") and specs.adapter_reference("models/x") == ("file", "models/x")
    (tmp_path / "cost.md").write_text("rules")
    assert specs.rubric("cost", tmp_path) == "rules"


def test_decisions_and_folds(spark):
    assert len(folds.DECISIONS) == 9
    for name in folds.DECISIONS:
        task, table = folds.decision(name)
        assert task.folded(name).labels == sorted(set(table.values()))
    t = Taxonomy("t", ["LOW", "MID", "HIGH"], ordered=True, gates=["HIGH"])
    df = spark.createDataFrame([("HIGH", ["HIGH", "odd"]), ("MID", ["LOW", "MID"]), ("odd", ["LOW"])], "truth string, votes array<string>").withColumn("soft_dist", F.lit(1))
    got = {(r.truth, tuple(r.votes)) for r in folds.threshold_rows(df, t, "HIGH").collect()}
    assert got == {("BLOCK", ("BLOCK", "ALLOW")), ("ALLOW", ("ALLOW", "ALLOW"))}
    assert set(folds.merges(t)) == {"merge LOW+MID", "merge MID+HIGH", "gate MID", "gate HIGH"}
    other = Taxonomy("u", ["LOW", "MID", "HIGH"], ordered=True, folds={"a": folds.threshold_fold(t, "HIGH"), "b": folds.threshold_fold(t, "MID")})
    twice = folds.duplicate_folds(spark, [other, Taxonomy("v", t.labels, folds={"c": folds.threshold_fold(t, "MID")})]).collect()
    assert [r.folds for r in twice] == [["u:b", "v:c"]]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text('{"text": "a", "tier": "X", "votes": ["X"]}\n\n{"text": "b", "label": "Y"}\nnot json\n{"text": "c", "tier": "Z"}\n')
    got = sources.labelled_rows(spark, [str(tmp_path / "gold.jsonl")], Taxonomy("t", ["X", "Y"]))
    assert {(r.text, r.tier, r.dataset) for r in got.collect()} == {("a", "X", "gold"), ("b", "Y", "gold")}
    assert sources.voted_rows(spark, [str(tmp_path / "gold.jsonl")]).count() == 1
    assert sources.manifest(spark, [str(tmp_path / "gold.jsonl")]).first().id == "gold.jsonl"
    path = sinks.write_rows(got, str(tmp_path / "out"), "1")
    assert spark.read.json(path).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_rows(got, str(tmp_path / "out"), "1")
    report = policy.Report("s", "t", {}, [], context()["metrics"] | {"odd": math.inf}, policy.run_controls(context(), ["baseline_lift"]))
    sinks.append_ledger(spark, report, str(tmp_path / "ledger"), "r1", params={"long": "x" * 900}, tags={"by": "me"})
    sinks.append_ledger(spark, report, str(tmp_path / "ledger"), "r2")
    assert not sinks.append_ledger(spark, report, str(tmp_path / "ledger"), "r2")
    ledger = committed(spark, str(tmp_path / "ledger"), report.suite)
    assert {r.id for r in ledger.where("kind = 'control' and parent = run").collect()} == {"r1/baseline_lift", "r2/baseline_lift"}
    assert ledger.where("name = 'long'").first().text == "x" * 500 and ledger.where("name = 'odd'").count() == 0 and ledger.where("name = 'by'").count() == 1
    assert [r.digest() for r in sources.report_rows(spark, str(tmp_path / "ledger"))] == [report.digest()] * 2
    assert "baseline_lift" in ledger.where("kind = 'text'").first().text
    with pytest.raises(ValueError, match="contract"):
        sinks.append_ledger(spark, policy.Report("s", "t", {}, [], {}), str(tmp_path / "ledger"), "r3")
    assert sinks.metric_name("selective/accuracy@0.90") == "selective/accuracy_at_0.90" and sinks.metric_name("a(b),c%[d]:e") == "ab_cpctd_e"
    assert sources.source_string(got).first().source == "gold:2" and sources.excluding(got, "gold").count() == 0 and sources.source_counts(got).first().n == 2
    strata = votes.adjudicate(spark.createDataFrame([("a", ["x"] * 3), ("b", ["x", "x", "y"]), ("c", ["x", "y", "z"])], "text string, votes array<string>"))
    where = sinks.write_strata(strata, str(tmp_path / "strata"), "1")
    assert {r.stratum: r["count"] for r in spark.read.json(where).groupBy("stratum").count().collect()} == {"gold": 1, "contested": 1}
    judged = spark.createDataFrame([("t" * 500, "a", "b", "gold", "w")], "text string, gold string, model string, verdict string, why string")
    assert len(spark.read.json(sinks.write_detail(judged, str(tmp_path / "detail"), "1")).first().text) == 400
    anchors = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c")], "label string, text string")
    assert json.loads(sinks.anchors_json(anchors).first().anchors) == {"x": ["a", "b"], "y": ["c"]}
    for k, (tag, labels) in enumerate((("m1", {"0": "X", "1": "Y"}), ("m2", {"0": "Y", "1": "X"}), ("m3", {"0": "X"}), ("other", {"0": "X", "1": "Y"}))):
        (tmp_path / "models" / tag).mkdir(parents=True)
        (tmp_path / "models" / tag / "config.json").write_text(json.dumps({"id2label": labels, "architectures": [f"A{k}"]}))
    found = {r.tag: (r.labels, r.architecture) for r in sources.checkpoints(spark, str(tmp_path / "models"), ["X", "Y"], "m").collect()}
    assert found == {"m1": (["X", "Y"], "A0"), "m2": (["Y", "X"], "A1")}
    for name, body in (("a", '{"tag": "run", "n": 1}'), ("b", '{"tag": "smoke-1", "n": 2}'), ("c", "{broken")):
        (tmp_path / f"report-{name}.json").write_text(body)
    assert [r.n for r in sources.reports(spark, str(tmp_path / "report-*.json"), T.StructType([T.StructField("tag", T.StringType()), T.StructField("n", T.LongType())])).collect()] == [1]
    schema = T.StructType([T.StructField("n", T.LongType())])
    assert [sources.reports(spark, str(tmp_path / "report-*.json"), schema).orderBy("n").collect() for _ in range(2)] == [[(1,), (2,)]] * 2 and schema.names == ["n"]
    cache = spark.createDataFrame([("k1", '{"a": 1}'), ("k2", '{"a": ')], "key string, answer string")
    wanted = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    assert {r.key for r in sources.missing_from_cache(wanted, sources.intact(cache, "answer"), ["key"]).collect()} == {"k2", "k3"}


def test_stream_equals_batch(spark, tmp_path):
    calls = spark.range(3000).select(F.col("id").alias("call_id"), F.timestamp_seconds(F.lit(1.7e9) + F.col("id") * 10).alias("ts"), (F.col("id") % 100 / 100).alias("conf"), (F.col("id") % 7).cast("double").alias("latency_ms"))
    calls.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    shadow.run_to_ledger(shadow.stream_metrics(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.hour: (r.n, r.conf_mean) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.hour: (r.n, r.conf_mean) for r in shadow.window_metrics(calls).collect()}
    assert got and all(want[h][0] == n and math.isclose(want[h][1], m) for h, (n, m) in got.items())
    shares = shadow.stream_metrics(stream.withColumn("pred", F.when(F.col("call_id") % 4 == 0, "a").otherwise("b")), ["a", "b"])
    sinks.append_shadow(shares, str(tmp_path / "shadow"), str(tmp_path / "ck3"), "live").awaitTermination()
    long = committed(spark, str(tmp_path / "shadow"))
    assert long.where("name = 'shadow/share_a'").agg(F.avg("value")).first()[0] == pytest.approx(0.25) and {r.mode for r in long.select("mode").distinct().collect()} == {"shadow"}
    assert {"shadow/conf_p10", "shadow/abstain_at_90", "shadow/p99_ms", "shadow/p50_ms"} <= {r.name for r in long.select("name").distinct().collect()}
    shadow.run_to_ledger(shadow.stream_retained(stream), str(tmp_path / "kept"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "kept")).count() == sampling.retained(calls, 0.05, "call_id").count() > 0


def test_training_reports_and_cards(spark):
    df = spark.createDataFrame([("a", "a")] * 3 + [("b", "a")], "truth string, pred string")
    calls = spark.createDataFrame([("OK", 1.0), ("OK", 3.0)], "status string, latency_ms double")
    got = json.loads(sinks.training_report({"gold": df}, ["a", "b"], {"tag": "t1", "epochs": 3}, calls).first().report)
    assert got["tag"] == "t1" and got["epochs"] == 3 and got["cpu"]["p50_ms"] == 2.0
    assert (got["gold"]["n"], got["gold"]["accuracy"], got["gold"]["confusion"], got["gold"]["recall"]) == (4, 0.75, {"a": {"a": 3, "b": 0}, "b": {"a": 1, "b": 0}}, {"a": 1.0, "b": 0.0})
    card = sinks.model_card(got)
    assert "# t1" in card and "| gold | 4 | 0.7500 |" in card and "- epochs: 3" in card
    assert metrics.missing_metrics(metrics.contract(df)) == [] and metrics.missing_metrics(df) == list(CONTRACT)
