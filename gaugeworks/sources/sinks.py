"""Where rows, ledgers and reports are written."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.judging import adjudicated_detail
from gaugeworks.operators.metrics import CONTRACT, confusion, contract, macro_f1, per_label, runtime_summary
from gaugeworks.plans.policy import Comparison, Report
from gaugeworks.sources.ledger import append_once, stream_to_ledger


def write_rows(rows: DataFrame, folder: str, version: str) -> str:
    """JSON lines in a folder of their own version; an existing version is never overwritten."""
    path = f"{folder}/version={version}"
    rows.write.mode("error").json(path)
    return path


def write_strata(adjudicated: DataFrame, folder: str, version: str) -> str:
    """Gold and contested rows, a folder each, in one pass."""
    path = f"{folder}/version={version}"
    adjudicated.where(F.col("stratum").isin("gold", "contested")).write.mode("error").partitionBy("stratum").json(path)
    return path


def metric_name(name: str) -> str:
    """A name that trackers accept: signs are spelt out, become _ or go."""
    # fixed values: what stands for each sign
    for sign, other in (("@", "_at_"), ("(", ""), (")", ""), (",", "_"), ("%", "pct"), ("[", ""), ("]", ""), (":", "_")):
        name = name.replace(sign, other)
    return name


#: The most characters of a parameter's value that a ledger takes.
MOST_PARAMETER = 500


def append_ledger(spark: SparkSession, report: Report, path: str, run: str, shadow: bool = False, params: dict[str, object] | None = None, tags: dict[str, str] | None = None) -> bool:
    """Rows of one run, appended once: its report, tags and parameters, its finite metrics, and each control as a run
    below it. False if the suite's run is in the ledger. A run that lacks a metric of the contract is refused, but for
    shadow runs."""
    if not shadow and (lacks := [m for m in CONTRACT if m not in report.metrics]):
        raise ValueError(f"metrics missing from the contract: {lacks}")
    tags = {"mode": "shadow" if shadow else "qualification", "verdict": report.verdict, "report_digest": report.digest()} | (tags or {})
    rows = [(run, None, "tag", k, None, str(v)) for k, v in tags.items()]
    rows += [(run, None, "param", k, None, str(v)[:MOST_PARAMETER]) for k, v in (params or {}).items()]
    rows += [(run, None, "metric", metric_name(k), float(v), None) for k, v in report.metrics.items() if math.isfinite(v)]
    rows += [(f"{run}/{r.control}", run, "control", r.control, float(r.status == "PASS"), r.status) for r in report.controls]
    rows += [(run, None, "report", report.digest(), None, report.to_json()), (run, None, "text", report.digest(), None, report_text(report))]
    ledger = spark.createDataFrame(rows, "id string, parent string, kind string, name string, value double, text string")
    return append_once(ledger.withColumn("at", F.current_timestamp()).coalesce(1), path, report.suite, run)


def append_shadow(stream: DataFrame, path: str, checkpoint: str, experiment: str):
    """Window metrics of a stream as rows of a ledger, (hour, name, value) with mode shadow: each batch is appended once,
    and what other experiments or other checkpoints append to the same ledger stays."""

    def long(batch: DataFrame) -> DataFrame:
        names = [c for c, kind in batch.dtypes if kind in ("double", "bigint", "int")]
        rows = batch.select("hour", F.inline(F.array(*(F.struct(F.lit(metric_name(f"shadow/{n}")).alias("name"), F.col(n).cast("double").alias("value")) for n in names))))
        return rows.where("value is not null").withColumn("mode", F.lit("shadow"))

    return stream_to_ledger(stream, path, checkpoint, experiment, long)


def report_text(report: Report) -> str:
    lines = [f"{report.suite}: {report.verdict} ({report.digest()})"]
    lines += [f"  {r.control:<26}{r.status:<16}{r.detail}" for r in report.controls]
    return "\n".join(lines + [f"  {k:<26}{v:.4f}" for k, v in sorted(report.metrics.items())])


def comparison_text(compared: Comparison) -> str:
    lines = [f"{k:<40}{v:+.4f}{'  <- primary' if k == compared.primary_metric else ''}" for k, v in compared.ordered()]
    return "\n".join([*lines, *(f"! {d}" for d in compared.disagreements), f"{compared.decision}: {'; '.join(compared.reasons)}"])


def training_report(sets: dict[str, DataFrame], labels: list[str], about: dict[str, object], latency: DataFrame | None = None) -> DataFrame:
    """One row with `report`, a JSON document: what was trained, and for each evaluation set n, accuracy, macro_f1, the
    Wilson interval, the confusion matrix and recall, and the latency of calls (status, latency_ms) if there are any.
    Each set is one aggregation; the document's size depends on the labels alone."""
    parts = []
    for name, preds in sets.items():
        cells = confusion(preds, labels).groupBy("truth").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pred", "n")))).alias("row"))
        matrix = cells.agg(F.map_from_entries(F.collect_list(F.struct("truth", "row"))).alias("confusion"))
        recall = per_label(preds, labels).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "recall")))).alias("recall"))
        one = contract(preds).join(F.broadcast(macro_f1(preds, labels)), F.lit(True)).join(F.broadcast(matrix), F.lit(True)).join(F.broadcast(recall), F.lit(True))
        parts.append(one.select(F.struct("n", "accuracy", F.col("macro_f1_all").alias("macro_f1"), F.array("wilson95_lo", "wilson95_hi").alias("wilson95"), "confusion", "recall").alias(name)))
    if latency is not None:
        parts.append(runtime_summary(latency).select(F.struct("p50_ms", "p99_ms").alias("cpu")))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part), F.lit(True))  # one row each
    fixed = [F.lit(v).alias(k) for k, v in about.items()]
    return out.select(F.to_json(F.struct(*fixed, *out.columns)).alias("report"))


def model_card(report: dict) -> str:
    """A card for a trained model from its training report (parsed)."""
    about = [f"- {k}: {v}" for k, v in report.items() if not isinstance(v, dict)]
    rows = [f"| {k} | {v['n']} | {v['accuracy']:.4f} | {v['macro_f1']:.4f} | {v['wilson95'][0]:.4f} to {v['wilson95'][1]:.4f} |" for k, v in report.items() if isinstance(v, dict) and "accuracy" in v]
    return "\n".join([f"# {report.get('tag', 'classifier')}", "", *about, "", "| set | n | accuracy | macro F1 | Wilson 95 % |", "|-|-|-|-|-|", *rows, ""])


def anchors_json(anchors: DataFrame, label: str = "label", column: str = "text") -> DataFrame:
    """One row with `anchors`, a JSON object of each label's anchor texts, which are few."""
    per = anchors.groupBy(F.col(label).cast("string").alias("label")).agg(F.array_sort(F.collect_list(column)).alias("texts"))
    return per.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "texts"))))).alias("anchors"))


def write_detail(rows: DataFrame, folder: str, version: str) -> str:
    """Judged disagreements, cut for reading, as JSON lines."""
    return write_rows(adjudicated_detail(rows), folder, version)
