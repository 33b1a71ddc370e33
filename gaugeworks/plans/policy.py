"""Controls, planes, verdict and promotion: rules over a small bag of metrics, on the driver.

A bag holds tens of numbers whatever the data's size; all that grows with the data has been aggregated by Spark."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

PASS, WARN, FAIL, NOT_APPLICABLE, NOT_EVALUATED = "PASS", "WARN", "FAIL", "NOT_APPLICABLE", "NOT_EVALUATED"


@dataclass(frozen=True)
class Result:
    control: str
    status: str
    detail: str = ""
    blocking: bool = True


def bag(one_row: DataFrame) -> dict[str, float]:
    """A one-row metric frame as numbers by name; NULL and NaN are left out."""
    row = one_row.first()
    return {k: float(v) for k, v in row.asDict().items() if isinstance(v, int | float) and not math.isnan(v)} if row else {}


def graded(value: float, fail: float, warn: float, detail: str) -> tuple[str, str]:
    """FAIL over the one limit, WARN over the other."""
    return (FAIL, detail) if value > fail else (WARN, detail) if value > warn else (PASS, detail)


def baseline_lift(c: dict) -> tuple[str, str]:
    m = c["metrics"]
    minority, lift = m.get("minority_share", 0.0), m.get("lift_over_chance", 0.0)
    if minority < 0.06:
        return FAIL, f"the smallest class has {minority:.3f} of the rows"
    return (FAIL if lift < 0.02 else WARN if lift < 0.04 else PASS), f"lift {lift:.4f}"


def seed_stability(c: dict) -> tuple[str, str]:
    scores, floor = c.get("seed_scores") or [], c.get("noise_floor")
    if len(scores) < 2:
        return FAIL, "one seed tells nothing of the spread"
    spread = max(scores) - min(scores)
    if floor is None:
        return WARN, f"spread {spread:.4f}, no floor to hold it against"
    origin = c.get("floor_measured_on")
    inherited = f"; floor is of {origin}, and a floor is a property of a config" if origin and origin != c.get("config_id") else ""
    return graded(spread, 3 * floor, floor, f"spread {spread:.4f}, floor {floor:.4f}{inherited}")


def holdout_integrity(c: dict) -> tuple[str, str]:
    m = c["metrics"]
    if "threshold/fitted" not in m or "threshold/heldout" not in m:
        return NOT_APPLICABLE, ""
    gap = m["threshold/fitted"] - m["threshold/heldout"]
    return graded(gap, 0.01, 0.005, f"fitted exceeds held out by {gap:.4f}")


def matched_operating_point(c: dict) -> tuple[str, str]:
    against = c.get("champion_comparison")
    if not c.get("gates") or not against:
        return NOT_APPLICABLE, ""
    won = against["cells_won"] > against["cells"] / 2
    return (PASS if won else FAIL), f"{against['cells_won']} of {against['cells']} cells"


def calibration(c: dict) -> tuple[str, str]:
    ece, enrichment = c["metrics"].get("ece"), c["metrics"].get("enrichment")
    if ece is None and enrichment is None:
        return NOT_APPLICABLE, ""
    poor = (ece is not None and ece > 0.10) or (enrichment is not None and enrichment < 1.2)
    return (WARN if poor else PASS), f"ece {ece}, enrichment {enrichment}"


def confidence_ordering(c: dict) -> tuple[str, str]:
    curve = sorted(c.get("curve") or [], reverse=True)  # (coverage, accuracy)
    if len(curve) < 3:
        return NOT_APPLICABLE, "fewer than three points"
    worst = max(a[1] - b[1] for a, b in zip(curve, curve[1:], strict=False))
    return (FAIL if worst > 0.005 else PASS), f"greatest fall {worst:.4f}"


def traffic_alignment(c: dict) -> tuple[str, str]:
    s = (c.get("traffic") or {}).get("separability")
    return (WARN, "UNKNOWN") if s is None else graded(s, 0.90, 0.70, "LOW" if s > 0.90 else "MEDIUM" if s > 0.70 else "HIGH")


def runtime_slo(c: dict) -> tuple[str, str]:
    run, slo = c.get("runtime"), c.get("slo") or {}
    if not run:
        return NOT_APPLICABLE, ""
    if run.get("coverage") is None or run["coverage"] < slo.get("coverage", 0.99):
        return FAIL, f"coverage {run.get('coverage')}"
    if run.get("resource_exhausted_rate", 0) > 0.001:
        return FAIL, "resource exhausted"
    used = max((run[k] / slo[k] for k in ("p95_ms", "p99_ms") if run.get(k) is not None and slo.get(k)), default=0.0)
    return graded(used, 1.0, 0.8, f"{used:.2f} of the latency limit")


def corpus_immutability(c: dict) -> tuple[str, str]:
    manifest = c.get("dataset_manifest") or []
    bad = not manifest or any(str(d.get("digest", "MISSING")).endswith("MISSING") for d in manifest)
    return (FAIL if bad else PASS), f"{len(manifest)} datasets"


def judge_integrity(c: dict) -> tuple[str, str]:
    j = c.get("judge")
    if not j:
        return NOT_APPLICABLE, ""
    faults = [name for name, bad in (("contestant", j.get("judge_is_contestant")), ("fixed positions", not j.get("position_randomised", True)), ("length", j.get("longer_answer_win_rate", 0) > 0.60), ("second judge", not j.get("second_judge_agrees_in_sign", True))) if bad]
    return (FAIL if faults else PASS), ", ".join(faults)


def artifact_identity(c: dict) -> tuple[str, str]:
    found, want = c.get("identity"), c.get("expected_identity") or {}
    if found is None:
        return NOT_APPLICABLE, ""
    if not found.get("model_revision") or found["model_revision"] == "unknown":
        return FAIL, "unknown revision"
    if wrong := [k for k, v in want.items() if v and v not in str(found.get(k, ""))]:
        return FAIL, f"differs in {', '.join(wrong)}"
    return (PASS if any(want.values()) else WARN), "pinned" if any(want.values()) else "nothing pinned"


CONTROLS: dict[str, Callable[[dict], tuple[str, str]]] = {f.__name__: f for f in (baseline_lift, seed_stability, holdout_integrity, matched_operating_point, calibration, confidence_ordering, traffic_alignment, runtime_slo, corpus_immutability, judge_integrity, artifact_identity)}
ADVISORY = {"calibration"}
#: The controls that speak for each plane, and the metrics whose presence means that it was exercised.
PLANES = {
    "classifier_quality": (("baseline_lift", "seed_stability", "calibration"), ("accuracy", "lift_over_chance", "macro_f1")),
    "decision_quality": (("matched_operating_point", "holdout_integrity"), ("selective/accuracy@0.90",)),
    "runtime_quality": (("runtime_slo", "artifact_identity"), ("runtime/classification_coverage",)),
    "traffic_validity": (("traffic_alignment",), ()),
    "outcome_value": ((), ("outcome/objective_delta",)),
}


def register(name: str, control: Callable[[dict], tuple[str, str]], blocking: bool = True) -> None:
    """Add a control of one's own: a function of the context that returns a status and its reason."""
    CONTROLS[name] = control
    (ADVISORY.discard if blocking else ADVISORY.add)(name)


def run_controls(context: dict, names: list[str] | None = None) -> list[Result]:
    wanted = names or list(CONTROLS)
    if unknown := [n for n in wanted if n not in CONTROLS]:
        raise ValueError(f"unknown controls {unknown}; there are {sorted(CONTROLS)}")
    return [Result(n, *CONTROLS[n](context), blocking=n not in ADVISORY) for n in wanted]


def summary(results: list[Result]) -> tuple[str, list[str], list[str]]:
    """(QUALIFIED, QUALIFIED_WITH_WARNING or NOT_QUALIFIED, blocking failures, warnings and advisory failures)."""
    blocking = [r.control for r in results if r.status == FAIL and r.blocking]
    warned = [r.control for r in results if r.status == WARN] + [r.control for r in results if r.status == FAIL and not r.blocking]
    return ("NOT_QUALIFIED" if blocking else "QUALIFIED_WITH_WARNING" if warned else "QUALIFIED"), blocking, warned


def planes(results: list[Result], metrics: dict[str, float], traffic: dict | None = None, outcome: dict | None = None) -> dict[str, str]:
    """FAIL before WARN before PASS of a plane's controls. NOT_EVALUATED where no control applies and no metric shows
    that the plane was exercised, without a measured separability, or without outcome evidence."""
    out = {}
    for plane, (names, evidence) in PLANES.items():
        seen = {r.status for r in results if r.control in names} - {NOT_APPLICABLE}
        unmeasured = (plane == "traffic_validity" and not (traffic or {}).get("separability")) or (plane == "outcome_value" and not outcome)
        if unmeasured or not (seen or any(m in metrics for m in evidence)):
            out[plane] = NOT_EVALUATED
        else:
            out[plane] = next((s for s in (FAIL, WARN) if s in seen), PASS)
    return out


def verdict(results: list[Result], by_plane: dict[str, str], required: list[str]) -> str:
    if any(r.status == FAIL and r.blocking for r in results):
        return "REJECTED"
    if any(by_plane.get(p, NOT_EVALUATED) == NOT_EVALUATED for p in required):
        return "INCOMPLETE"
    if FAIL in by_plane.values():
        return "REJECTED"
    return "QUALIFIED_WITH_WARNINGS" if WARN in by_plane.values() or any(r.status == WARN for r in results) else "QUALIFIED"


@dataclass(frozen=True)
class Promotion:
    """What a deployment accepts. None switches a limit off."""

    primary_metric: str = "lift_over_chance"
    minimum_lift_over_baseline: float | None = None
    max_regression_vs_champion: float | None = 0.005
    allow_warnings: bool = True
    require_planes: tuple[str, ...] = ()
    require_reproducible: bool = True


def promotion(report: Report, policy: Promotion, champion: dict[str, float] | None = None) -> tuple[str, list[str]]:
    """(PROMOTE, INCOMPLETE or REJECT, reasons). Later rules overrule earlier ones: inputs that aren't pinned reject an
    unfinished run too."""
    out, reasons = {"REJECTED": "REJECT", "INCOMPLETE": "INCOMPLETE"}.get(report.verdict, "PROMOTE"), []
    _, blocking, warned = summary(report.controls)
    if out == "REJECT":
        reasons.append(f"rejected: {', '.join(blocking) or 'a plane failed'}")
    elif out == "INCOMPLETE":
        reasons.append("a required plane was not exercised")
    elif report.verdict == "QUALIFIED_WITH_WARNINGS" and not policy.allow_warnings:
        out, reasons = "REJECT", [f"warnings aren't allowed: {', '.join(warned)}"]
    if missing := [p for p in policy.require_planes if report.planes.get(p) == NOT_EVALUATED]:
        out, reasons = ("INCOMPLETE" if out == "PROMOTE" else out), [*reasons, f"planes not evaluated: {', '.join(missing)}"]
    if policy.require_reproducible and (unpinned := report.unpinned()):
        out, reasons = "REJECT", [*reasons, f"unpinned: {', '.join(unpinned)}"]
    lift, least = report.metrics.get("lift_over_chance"), policy.minimum_lift_over_baseline
    if least is not None and lift is not None and lift < least:
        out, reasons = "REJECT", [*reasons, f"lift {lift:+.4f} is below {least:+.4f}"]
    mine, theirs, most = report.metrics.get(policy.primary_metric), (champion or {}).get(policy.primary_metric), policy.max_regression_vs_champion
    if most is not None and mine is not None and theirs is not None:
        if mine - theirs < -most:
            out = "REJECT"
        reasons.append(f"{policy.primary_metric} {mine - theirs:+.4f} against the champion")
    return out, reasons or ["all conditions are met"]


#: Metrics that are compared besides the primary one and those of gates.
COMPARED = ("accuracy", "macro_f1", "calibration/ece", "minority_share")


@dataclass(frozen=True)
class Comparison:
    """A candidate against the champion: what changed, what an average hides, and the decision."""

    primary_metric: str
    deltas: dict[str, float]
    disagreements: list[str]
    decision: str
    reasons: list[str]

    def ordered(self) -> list[tuple[str, float]]:
        """Deltas by name, the primary one first."""
        return sorted(self.deltas.items(), key=lambda kv: (kv[0] != self.primary_metric, kv[0]))


def compare(candidate: Report, champion: Report, policy: Promotion) -> Comparison:
    mine, theirs, primary = candidate.metrics, champion.metrics, policy.primary_metric
    deltas = {k: v - theirs[k] for k, v in mine.items() if k in theirs and (k == primary or k.startswith("gate/") or k in COMPARED)}
    gain, notes = deltas.get("accuracy"), []
    if gain is not None and gain * deltas.get(primary, 0.0) < 0:
        notes.append(f"accuracy {gain:+.4f} and {primary} {deltas[primary]:+.4f} differ in sign")
    notes += [f"accuracy rose, {k} fell by {-v:.4f}" for k, v in deltas.items() if k.endswith("/containment") and v < -0.005 and (gain or 0) > 0]
    notes += [f"{k} rose by {v:.4f}" for k, v in deltas.items() if k.endswith("/released_to_lowest") and v > 0.001]
    decision, reasons = promotion(candidate, policy, theirs)
    if notes and decision == "PROMOTE":
        decision, reasons = "PROMOTE_WITH_REVIEW", [*reasons, "metrics disagree"]
    return Comparison(primary, deltas, notes, decision, reasons)


def exit_code(decision: str | None) -> int:
    """0 for what is promoted, with review or without; 2 for no rows at all; else 1."""
    return 2 if decision is None else 0 if decision.startswith("PROMOTE") else 1


@dataclass(frozen=True)
class Report:
    """What was measured, on what, and what follows."""

    suite: str
    taxonomy: str
    classifier: dict[str, str]
    datasets: list[dict[str, str]]
    metrics: dict[str, float]
    controls: list[Result] = field(default_factory=list)
    planes: dict[str, str] = field(default_factory=dict)
    verdict: str = ""

    def unpinned(self) -> list[str]:
        missing = [k for k in ("model_revision", "runtime_revision", "code_revision") if not self.classifier.get(k) or self.classifier[k].endswith("MISSING")]
        return missing + [d["id"] for d in self.datasets if str(d.get("digest", "MISSING")).endswith("MISSING")]

    def digest(self) -> str:
        body = {"suite": self.suite, "taxonomy": self.taxonomy, "classifier": self.classifier, "datasets": self.datasets, "verdict": self.verdict, "metrics": self.metrics}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]

    def to_dict(self) -> dict:
        """All of it, with the digest and what isn't pinned."""
        state, blocking, warned = summary(self.controls)
        controls = {"verdict": state, "blocking_failures": blocking, "warnings": warned, "controls": [asdict(r) for r in self.controls]}
        return {
            "suite": self.suite, "taxonomy": self.taxonomy, "classifier": self.classifier, "datasets": self.datasets, "metrics": self.metrics, "controls": controls, "planes": self.planes,
            "verdict": self.verdict, "report_digest": self.digest(), "unpinned_inputs": self.unpinned(),
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @classmethod
    def from_dict(cls, found: dict) -> Report:
        """Read back leniently: what this version doesn't know is left out, what it misses is empty. Digests are
        computed anew."""
        controls = found.get("controls") or {}
        rows = controls.get("controls", controls.get("checks", [])) if isinstance(controls, dict) else controls
        status = lambda r: r.get("status") or (PASS if r.get("passed") else FAIL)
        results = [Result(r["control"], status(r), r.get("detail", ""), r.get("blocking", True)) for r in rows]
        by_plane = found.get("planes") or {}
        if isinstance(by_plane, list):
            by_plane = {p["plane"]: p["status"] for p in by_plane}
        return cls(found.get("suite", ""), found.get("taxonomy", ""), found.get("classifier") or {}, found.get("datasets") or [], found.get("metrics") or {}, results, by_plane, found.get("verdict", ""))


def qualify(suite: str, taxonomy: str, classifier: dict[str, str], datasets: list[dict[str, str]], context: dict, required: list[str], names: list[str] | None = None) -> Report:
    results = run_controls(context, names)
    by_plane = planes(results, context["metrics"], context.get("traffic"), context.get("outcome"))
    return Report(suite, taxonomy, classifier, datasets, context["metrics"], results, by_plane, verdict(results, by_plane, required))
