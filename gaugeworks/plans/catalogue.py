"""All queries on the reference's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import probs, tables, text
from gaugeworks.operators import adapters, compress, corpus, curves, folds, judging, medoids, metrics, probe, sampling, vectors, votes
from gaugeworks.plans import frames, policy, run
from gaugeworks.plans.frames import CALLS_SQL, PRIORITY, calls, predictions, preds_sql, rounded, table, u
from gaugeworks.sources import sinks
from gaugeworks.stored import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
P = preds_sql()
LABELS_SQL = "(select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) as label)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- metrics -------------------------------------------------------------------------------------------------


@query(f"""with {P}, per as (select truth, count(*) as n, sum((truth = pred)::int) as k from preds group by truth),
one as (select sum(n)::BIGINT as n, sum(k)::DOUBLE as k, max(n) as most, min(n) as least from per),
w as (select *, k / n as p, 1 + 1.96 * 1.96 / n as s from one)
select n, round(p, 6) as accuracy, round(most / n, 6) as majority_baseline, round(least / n, 6) as minority_share, round(p - most / n, 6) as lift_over_chance,
round(((p + 1.96 * 1.96 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / s, 6) as wilson95_lo,
round(((p + 1.96 * 1.96 / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / s, 6) as wilson95_hi from w""")
def metric_contract(spark, sf):
    return rounded(metrics.contract(predictions(spark, sf)))


@query(f"""with {P} select a.label as truth, b.label as pred, count(p.row_id)::BIGINT as n from {LABELS_SQL} a cross join {LABELS_SQL} b
left join preds p on p.truth = a.label and p.pred = b.label group by 1, 2""")
def confusion_matrix(spark, sf):
    return metrics.confusion(predictions(spark, sf), PRIORITY.labels)


PER_LABEL_SQL = f"""{P}, s as (select truth as label, count(*) as support, sum((truth = pred)::int) as hit from preds group by 1), q as (select pred as label, count(*) as predicted from preds group by 1),
per as (select s.label, s.support::BIGINT as support, q.predicted::BIGINT as predicted, hit / support as recall, hit / predicted as precision, 2.0 * hit / (support + predicted) as f1 from s join q using (label))"""


@query(f"with {PER_LABEL_SQL} select label, support, predicted, round(recall, 6) as recall, round(precision, 6) as precision, round(f1, 6) as f1 from per")
def per_label_metrics(spark, sf):
    return rounded(metrics.per_label(predictions(spark, sf), PRIORITY.labels))


@query(f"with {PER_LABEL_SQL} select round(avg(f1), 6) as macro_f1_defined, round(sum(f1) / 5, 6) as macro_f1_all, round(avg(recall), 6) as balanced_accuracy from per")
def macro_f1(spark, sf):
    return rounded(metrics.macro_f1(predictions(spark, sf), PRIORITY.labels))


@query(f"with {PER_LABEL_SQL} select label, support, round(recall, 6) as recall from per order by support, label limit 1")
def minor_class_recall(spark, sf):
    return rounded(metrics.minor_class_recall(predictions(spark, sf), PRIORITY.labels))


VOTES_SQL = "list_filter(votes, lambda x: x is not null)"


@query(f"""with {P}, v as (select truth = pred as ok, len(list_distinct(votes)) + (len(list_filter(votes, lambda x: x is null)) > 0)::int = 1 as same from preds)
select count(*)::BIGINT as n, round(avg(same::int), 6) as jury_agreement, round(avg((not same)::int), 6) as contested_share, round(avg(ok::int) filter (where same), 6) as accuracy_unanimous,
round(avg(ok::int) filter (where not same), 6) as accuracy_contested, round(avg((not ok)::int) filter (where same), 6) as error_on_unanimous, round(avg((ok or not same)::int), 6) as ceiling_from_perfect_labels from v""")
def label_ceiling(spark, sf):
    return rounded(metrics.label_ceiling(predictions(spark, sf)))


BINS_SQL = f"""{P}, edges as (select k, k * 0.1::DOUBLE as low, (k + 1) * 0.1::DOUBLE as high from range(10) r(k)),
bins as (select k::int as bin, count(*)::BIGINT as n, avg(conf) as confidence, avg((truth = pred)::int) as accuracy from preds join edges on conf > low and (conf <= high or (k = 9 and conf <= 1)) group by 1)"""


@query(f"with {BINS_SQL} select bin, n, round(confidence, 6) as confidence, round(accuracy, 6) as accuracy from bins")
def calibration_bins(spark, sf):
    return rounded(metrics.calibration_bins(predictions(spark, sf)))


@query(f"""with {BINS_SQL}, whole as (select count(*) as n, avg(conf) - avg((truth = pred)::int) as over from preds)
select round(sum(abs(confidence - accuracy) * bins.n) / any_value(whole.n), 6) as ece, round(max(abs(confidence - accuracy)), 6) as mce, round(any_value(over), 6) as overconfidence, count(*)::BIGINT as bins from bins, whole""")
def calibration(spark, sf):
    return rounded(metrics.calibration(predictions(spark, sf)))


@query(f"with {P}, m as (select median(conf) as m from preds) select round(max(conf) - min(conf), 6) as confident_half_spread from preds, m where conf >= m.m")
def confident_half_spread(spark, sf):
    return rounded(metrics.confident_half_spread(predictions(spark, sf)))


@query(f"""with {P}, g as (select unnest([2, 4]) as g, unnest(['3-MEDIUM', '5-LOW']) as gate)
select gate, round(avg((p >= g)::int) filter (where t >= g), 6) as containment, round(avg((p >= g)::int) filter (where t < g), 6) as over_block, round(avg((p = 0)::int) filter (where t >= g), 6) as released_to_lowest
from preds, g group by gate""")
def gate_metrics(spark, sf):
    return rounded(metrics.gates(predictions(spark, sf), PRIORITY))


HALVES_SQL = """halves as (select *, ((('0x' || substr(md5(row_id::VARCHAR), 1, 15))::BIGINT >> rep) & 1)::int as half from scored, range({repeats}) r(rep))"""
RIGHT_SQL = f"{P}, scored as (select row_id, conf, (truth = pred)::int as ok from preds)"


def cuts_sql(repeats: int, coverages, right: str | None = None) -> str:
    """Common table expressions that end in `e`: each half's rows at or above the cuts of the other half."""
    shares, values = ", ".join(repr(1 - c) for c in coverages), ", ".join(map(repr, coverages))
    return f"""{right or RIGHT_SQL}, {HALVES_SQL.format(repeats=repeats)}, cuts as (select rep, half, unnest([{values}])::DOUBLE as coverage, unnest(quantile_cont(conf, [{shares}])) as cut from halves group by 1, 2),
e as (select c.rep, c.half, c.coverage, count(*) filter (where conf >= cut) as kept, avg(ok) filter (where conf >= cut) as a, avg(ok) filter (where conf < cut) as w from cuts c join halves h on h.rep = c.rep and h.half = 1 - c.half group by 1, 2, 3)"""


@query(f"with {cuts_sql(40, (0.95, 0.90, 0.80, 0.70))} select coverage, round(avg(a), 6) as accuracy, round(avg(w), 6) as waste from e group by 1")
def risk_coverage(spark, sf):
    return rounded(metrics.risk_coverage(predictions(spark, sf)))


TWENTIES = tuple(round(0.95 - 0.05 * k, 2) for k in range(16))


@query(f"with {cuts_sql(20, TWENTIES)}, m as (select coverage, avg(a) as a from e group by 1) select 0.85::DOUBLE as target, max(coverage) filter (where a >= 0.85) as coverage from m")
def coverage_for_target(spark, sf):
    return rounded(curves.coverage_for_target(predictions(spark, sf), 0.85))


@query(f"""with {cuts_sql(40, tuple(round(1 - 0.01 * k, 2) for k in range(71)))}, t as (select unnest([0.8, 0.85, 0.99])::DOUBLE as target),
f as (select target, rep, half, 1 - max(coverage) filter (where kept >= 20 and a >= target) as need from e, t group by 1, 2, 3)
select target, round(case when avg((need is not null)::int) > 0.5 then avg(need) end, 6) as escalation, round(avg((need is not null)::int), 6) as reached from f group by 1""")
def escalation_needed(spark, sf):
    return rounded(curves.escalation_needed(predictions(spark, sf), (0.8, 0.85, 0.99)))


@query(f"with {P} select row_id % 7 = 0 as hard, count(*)::BIGINT as n, round(avg((truth = pred)::int), 6) as accuracy from preds group by 1")
def hard_subset_accuracy(spark, sf):
    return rounded(metrics.hard_subset_accuracy(predictions(spark, sf).withColumn("hard", F.col("row_id") % 7 == 0)))


@query(f"with {P} select truth, pred, count(*)::BIGINT as n from preds where truth <> pred group by 1, 2 order by n desc, truth, pred limit 5")
def top_confusions(spark, sf):
    return metrics.top_confusions(predictions(spark, sf))


@query(f"""with {CALLS_SQL} select pred, count(latency_ms)::BIGINT as n, round(avg(latency_ms), 6) as mean, round(stddev_pop(latency_ms), 6) as sd, round(min(latency_ms), 6) as low, round(max(latency_ms), 6) as high, round(quantile_cont(latency_ms, 0.5), 6) as median from calls group by 1""")
def latency_spread(spark, sf):
    return rounded(metrics.spread_by(calls(spark, sf), "latency_ms", "pred"))


@query(f"""with {P}, x as (select conf, (len(list_distinct({VOTES_SQL})) + (len(list_filter(votes, lambda v: v is null)) > 0)::int > 1)::int as c from preds), q as (select quantile_cont(conf, 0.1) as cut from x)
select round(avg(c), 6) as base_rate, round(avg(c) filter (where conf < cut), 6) as in_dropped, round(avg(c) filter (where conf < cut) / avg(c), 6) as enrichment from x, q""")
def contested_enrichment(spark, sf):
    return rounded(metrics.contested_enrichment(predictions(spark, sf)))


@query(f"""with {CALLS_SQL} select count(*)::BIGINT as attempted, count(*) filter (where status = 'OK')::BIGINT as succeeded, round(avg((status = 'OK')::int), 6) as coverage, round(avg((status = 'ABSTAIN')::int), 6) as abstain_rate,
round(avg((status = 'RESOURCE_EXHAUSTED')::int), 6) as resource_exhausted_rate, round(avg((status not in ('OK', 'ABSTAIN'))::int), 6) as error_rate, round(quantile_cont(latency_ms, 0.5) filter (where status = 'OK'), 6) as p50_ms,
round(quantile_cont(latency_ms, 0.95) filter (where status = 'OK'), 6) as p95_ms, round(quantile_cont(latency_ms, 0.99) filter (where status = 'OK'), 6) as p99_ms, round(avg(latency_ms) filter (where status = 'OK'), 6) as mean_ms from calls""")
def runtime_summary(spark, sf):
    return rounded(metrics.runtime_summary(calls(spark, sf)))


@query(f"""with {CALLS_SQL} select date_trunc('hour', ts) as hour, count(*)::BIGINT as n, round(avg(conf), 6) as conf_mean, round(quantile_cont(conf, 0.1), 6) as conf_p10, round(quantile_cont(conf, 0.5), 6) as conf_p50,
round(quantile_cont(latency_ms, 0.5), 6) as p50_ms, round(quantile_cont(latency_ms, 0.99), 6) as p99_ms, round(avg((conf < 0.5)::int), 6) as abstain_at_50, round(avg((conf < 0.7)::int), 6) as abstain_at_70, round(avg((conf < 0.9)::int), 6) as abstain_at_90 from calls group by 1""")
def shadow_metrics(spark, sf):
    from gaugeworks.streaming.shadow import window_metrics

    return rounded(window_metrics(calls(spark, sf)))


@query(f"""with {CALLS_SQL}, n as (select date_trunc('hour', ts) as hour, pred, count(*) as n from calls group by 1, 2) select hour, pred, n::BIGINT as n, round(n / sum(n) over (partition by hour), 6) as share from n""")
def shadow_shares(spark, sf):
    from gaugeworks.streaming.shadow import predicted_shares

    return rounded(predicted_shares(calls(spark, sf)))


@query(f"""with {P}, f as (select greatest(p0 + p1, p2 + p3 + p4) as conf from preds), m as (select median(conf) as m from f) select round(max(conf) - min(conf), 6) as confident_half_spread from f, m where conf >= m.m""")
def deployed_half_spread(spark, sf):
    """The same where decisions are made, in the folded space."""
    summed = probs.folded(F.col("probs"), PRIORITY.labels, PRIORITY.folds["route"])
    return rounded(metrics.confident_half_spread(predictions(spark, sf).select(F.array_max(summed).alias("conf"))))


#: Rows as decided: two groups' probabilities summed, the first of equal ones.
DECIDED_SQL = f"""{P}, decided as (select *, greatest(p0 + p1, p2 + p3 + p4) as d_conf, (p0 + p1 >= p2 + p3 + p4) = (t < 2) as d_ok from preds)"""
ROUTE = PRIORITY.folds["route"]


@query(f"""with {cuts_sql(40, (0.95, 0.90, 0.80, 0.70), DECIDED_SQL + ", scored as (select row_id, d_conf as conf, d_ok::int as ok from decided)")} select coverage, round(avg(a), 6) as accuracy, round(avg(w), 6) as waste from e group by 1""")
def deployed_risk_coverage(spark, sf):
    """Risk at each coverage where decisions are made: thresholds are of folded confidences."""
    return rounded(metrics.risk_coverage(run.decided_rows(run.deployed(predictions(spark, sf), PRIORITY, ROUTE))))


@query(f"""with {DECIDED_SQL}, x as (select d_conf as conf, (len(list_distinct({VOTES_SQL})) + (len(list_filter(votes, lambda v: v is null)) > 0)::int > 1)::int as c from decided), q as (select quantile_cont(conf, 0.1) as cut from x)
select round(avg(c), 6) as base_rate, round(avg(c) filter (where conf < cut), 6) as in_dropped, round(avg(c) filter (where conf < cut) / avg(c), 6) as enrichment from x, q""")
def deployed_enrichment(spark, sf):
    own = run.decided_rows(run.deployed(predictions(spark, sf), PRIORITY, ROUTE))
    return rounded(metrics.enrichment_of(own, F.col("contested")))


def _named_sql(name: str, columns: dict[str, str]) -> str:
    """The columns of another query's one row as rows (metric, value)."""
    return f"select unnest([{', '.join(repr(m) for m in columns)}]) as metric, unnest([{', '.join(f'{c}::DOUBLE' for c in columns.values())}]) as value from ({ORACLE_SQL[name]})"


def _each_sql(name: str, key: str, shape: str, columns: list[str]) -> list[str]:
    """The columns of another query's rows, named by each row's key."""
    return [f"select {shape.format(key=key, column=c)} as metric, {c}::DOUBLE as value from ({ORACLE_SQL[name]})" for c in columns]


def _suite_sql() -> str:
    same = lambda *names: {n: n for n in names}
    parts = [
        _named_sql("metric_contract", same("n", "accuracy", "majority_baseline", "minority_share", "lift_over_chance", "wilson95_lo", "wilson95_hi")),
        _named_sql("macro_f1", {"macro_f1": "macro_f1_defined", "macro_f1_all": "macro_f1_all", "balanced_accuracy": "balanced_accuracy"}),
        _named_sql("label_ceiling", same("jury_agreement", "contested_share", "accuracy_unanimous", "accuracy_contested", "error_on_unanimous", "ceiling_from_perfect_labels")),
        _named_sql("calibration", same("ece", "mce", "overconfidence")),
        _named_sql("deployed_half_spread", same("confident_half_spread")),
        _named_sql("deployed_enrichment", same("base_rate", "in_dropped", "enrichment")),
        f"select 'decided/accuracy', round(avg(d_ok::int), 6) from (with {DECIDED_SQL} select d_ok from decided)",
        *_each_sql("per_label_metrics", "label", "'{column}/' || {key}", ["recall", "precision", "f1"]),
        *_each_sql("gate_metrics", "gate", "'gate/' || {key} || '/{column}'", ["containment", "over_block", "released_to_lowest"]),
        *_each_sql("deployed_risk_coverage", "coverage", "'selective/{column}@' || printf('%.2f', {key})", ["accuracy", "waste"]),
    ]
    return f"select metric, value from ({' union all '.join(parts)}) where value is not null"


@query(_suite_sql())
def suite_metrics(spark, sf):
    """Every metric of a suite's run by name: one narrow stored table, one aggregation for all that counts tell, and
    the metrics of confidence where decisions are made."""
    with stored(run.deployed(predictions(spark, sf), PRIORITY, ROUTE), "scored_rows") as kept:
        found = run.metrics_of_cells(run.cells(kept), PRIORITY) | run.confidence_metrics(kept)
    return rounded(spark.createDataFrame([*found.items()], "metric string, value double"))


@query(f"""with {CALLS_SQL} select call_id, round((latency_ms - avg(latency_ms) over w) / stddev_pop(latency_ms) over w, 6) as z from calls window w as (partition by pred)""")
def latency_z_scores(spark, sf):
    return rounded(metrics.z_scores(calls(spark, sf).select("call_id", "pred", "latency_ms"), "latency_ms", "pred").select("call_id", "z"))


@query(f"""with {P}, e as (select row_id, [exp(3 * p0), exp(3 * p1), exp(3 * p2), exp(3 * p3), exp(3 * p4)] as e from preds) select row_id, round(list_max(e) / list_sum(e), 6) as top, round(e[1] / list_sum(e), 6) as first from e""")
def softmax_scores(spark, sf):
    q = probs.softmax(F.transform("probs", lambda x: 3 * x))
    return rounded(predictions(spark, sf).select("row_id", F.array_max(q).alias("top"), F.get(q, F.lit(0)).alias("first")))


# ---- folds and votes -----------------------------------------------------------------------------------------


FOLDS_SQL = f"""{P}, f as (select b as fold_id, [0, b & 1, (b & 1) + (b >> 1 & 1), (b & 1) + (b >> 1 & 1) + (b >> 2 & 1), (b & 1) + (b >> 1 & 1) + (b >> 2 & 1) + (b >> 3 & 1)] as g from range(1, 16) r(b)),
x as (select fold_id, g[5] + 1 as n_groups, g[t + 1] as own, len(list_distinct(list_transform({VOTES_SQL}, lambda v: g[substr(v, 1, 1)::int]))) = 1 as agree from preds, f),
y as (select fold_id, n_groups, own, count(*) as n, sum(agree::int) as a from x group by 1, 2, 3),
z as (select fold_id::BIGINT as fold_id, n_groups::int as n_groups, sum(a) / sum(n) as agreement, min(n) / sum(n) as minority from y group by 1, 2)"""


@query(f"with {FOLDS_SQL} select fold_id, n_groups, round(agreement, 6) as agreement, round(minority, 6) as minority, minority < 0.06 as degenerate from z")
def fold_search(spark, sf):
    found = folds.fold_search(predictions(spark, sf), PRIORITY)
    named = folds.contiguous_folds(spark, PRIORITY).select("fold_id", "name")
    return rounded(found.join(F.broadcast(named), "name").select("fold_id", "n_groups", "agreement", "minority", "degenerate"))


@query(f"""with {P}, r as (select truth in ('1-URGENT', '2-HIGH') as fast, list_transform({VOTES_SQL}, lambda v: v in ('1-URGENT', '2-HIGH')) as v from preds)
select case when fast then 'FAST' else 'SLOW' end as truth, count(*)::BIGINT as n, sum((len(list_distinct(v)) <= 1)::int)::BIGINT as unanimous from r group by 1""")
def fold_rows(spark, sf):
    rows = folds.fold_rows(predictions(spark, sf), PRIORITY, PRIORITY.folds["route"])
    return rows.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.sum(votes.unanimous(F.col("votes")).cast("long")).alias("unanimous"))


@query(f"""with {P}, q as (select *, len(list_filter(votes, lambda x: x is null)) > 0 as miss from preds), top as (select *, (select struct_pack(n := count(*), at := min(i), l := x) from (select unnest(votes) as x, unnest([1, 2, 3]) as i) z group by x order by count(*) desc, min(i) limit 1) as b from q),
s as (select case when miss then 'unanswered' when b.n = 3 then 'gold' when b.n >= 2 then 'contested' else 'unresolved' end as stratum, b.l as l from top)
select stratum, case when stratum in ('gold', 'contested') then l end as tier, count(*)::BIGINT as n from s group by 1, 2""")
def jury_adjudication(spark, sf):
    return votes.adjudicate(predictions(spark, sf)).groupBy("stratum", "tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {P}, f as (select votes from preds where len({VOTES_SQL}) = 3), p as (select unnest([0, 0, 1]) as a, unnest([1, 2, 2]) as b)
select a::int as a, b::int as b, count(*)::BIGINT as n, round(avg((votes[a + 1] = votes[b + 1])::int), 6) as agreement from f, p group by 1, 2""")
def pairwise_agreement(spark, sf):
    return rounded(votes.pairwise_agreement(predictions(spark, sf), 3))


@query(f"""with {P}, x as (select list_slice(votes, 1, 2) as v from preds where votes[1] is not null and votes[2] is not null) select v[1] as tier, v[1] = v[2] as agree, count(*)::BIGINT as n from x group by 1, 2""")
def two_labellers(spark, sf):
    rows = predictions(spark, sf).withColumn("votes", F.slice("votes", 1, 2))
    return votes.two_labellers(rows).groupBy("tier", "agree").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {P}, x as (select votes[3] as tier from preds where votes[3] is not null and list_contains(list_slice(votes, 1, 2), votes[3])) select tier, count(*)::BIGINT as n from x group by 1""")
def tie_resolution(spark, sf):
    rows = predictions(spark, sf).withColumn("third", F.get("votes", F.lit(2))).withColumn("votes", F.slice("votes", 1, 2))
    return votes.resolve_ties(rows, "third").groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {P}, r as (select row_id, {VOTES_SQL} as v, truth from preds), r2 as (select * from r where len(v) >= 2), u as (select row_id, unnest(list_distinct(list_append(v, truth))) as x, v from r2),
pairs as (select a.row_id, a.x as low, b.x as high, list_contains(a.v, a.x) and list_contains(a.v, b.x) as split from u a join u b on a.row_id = b.row_id and a.x < b.x),
g as (select low, high, sum(split::int) as splits, count(*) as opportunities from pairs group by 1, 2)
select low, high, splits::BIGINT as splits, opportunities::BIGINT as opportunities, round((splits / (select sum(splits) from g)) / (opportunities / (select sum(opportunities) from g)), 6) as over from g where splits >= 3""")
def boundary_shares(spark, sf):
    return rounded(votes.boundary_shares(predictions(spark, sf)))


@query(f"""with {P} select truth as tier_v1, votes[1] as tier, count(*)::BIGINT as n, sum((truth <> votes[1])::int)::BIGINT as changed from preds where len({VOTES_SQL}) = 3 and len(list_distinct(votes)) = 1 group by 1, 2""")
def gold_refinement(spark, sf):
    rows = votes.refined(predictions(spark, sf).withColumn("tier", F.col("truth")))
    return rows.groupBy("tier_v1", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("changed").cast("long")).alias("changed"))


PASSES_SQL = "with " + ", ".join(preds_sql(r, x, f"m{k}") for k, (r, x) in (("a", (0.25, "p")), ("b", (0.3, "q")), ("c", (0.35, "r")))) + ", j as (select row_id, ma.truth, ma.votes, [ma.pred, mb.pred, mc.pred] as passes from ma join mb using (row_id) join mc using (row_id))"


def _passes(spark, sf):
    return _members(spark, sf).join(predictions(spark, sf).select("row_id", "votes"), "row_id").withColumn("passes", F.array("a", "b", "c"))


@query(f"""{PASSES_SQL}, x as (select (len(list_distinct(passes)) = 1)::int as s, len(list_distinct(votes)) + (len({VOTES_SQL}) < 3)::int = 1 as u from j), y as (select 'all' as stratum, s, u from x union all select case when u then 'unanimous' else 'contested' end, s, u from x)
select stratum, count(*)::BIGINT as n, round(avg(s), 6) as self_agreement, round(avg(u::int), 6) as inter_agreement from y group by 1""")
def self_agreement(spark, sf):
    return rounded(votes.self_agreement(_passes(spark, sf), "passes"))


@query(f"{PASSES_SQL} select array_to_string(list_sort(list_distinct(passes)), '/') as labels, count(*)::BIGINT as n from j where len(list_distinct(passes)) > 1 group by 1 order by n desc, labels limit 5")
def self_disagreements(spark, sf):
    return votes.self_disagreements(_passes(spark, sf), "passes")


@query(f"""with {P}, x as (select 'v1' as rubric, votes[1] as a, votes[2] as b from preds union all select 'v2', votes[1], votes[3] from preds) select rubric, count(*)::BIGINT as n, round(avg((a = b)::int), 6) as agreement from x where a is not null and b is not null group by 1""")
def rubric_agreement(spark, sf):
    rows = predictions(spark, sf).select(*(F.get("votes", F.lit(k)).alias(f"v{k}") for k in range(3)))
    return rounded(votes.rubric_agreement(rows, {"v1": ("v0", "v1"), "v2": ("v0", "v2")}))


@query(f"""with {P}, x as (select 'v1' as rubric, votes[1] as a, votes[2] as b from preds union all select 'v2', votes[1], votes[3] from preds), c as (select rubric, least(a, b) || '/' || greatest(a, b) as pair, count(*)::BIGINT as n from x where a <> b group by 1, 2)
select rubric, pair, n, (row_number() over (partition by rubric order by n desc, pair))::int as rank from c qualify rank <= 4""")
def rubric_residuals(spark, sf):
    """What two labellers still disagree in under each wording."""
    rows = predictions(spark, sf).select(*(F.get("votes", F.lit(k)).alias(f"v{k}") for k in range(3)))
    return votes.rubric_residuals(rows, {"v1": ("v0", "v1"), "v2": ("v0", "v2")})


@query(f"""with {CALLS_SQL}, k as (select call_id, ts, conf from calls where {u("'r:' || call_id")} < least(1.0, 0.05 * case when conf < 0.6 then 5 else 1 end)), r as (select *, row_number() over (partition by date_trunc('hour', ts) order by ts, call_id) as rn from k)
select call_id, date_trunc('hour', ts) as hour from r where rn <= 20""")
def retained_of_windows(spark, sf):
    """The sample for review with a cap: the first calls of each hour, as the stream keeps them."""
    from gaugeworks.streaming.buffers import first_overall

    kept = first_overall(sampling.retained(calls(spark, sf), 0.05, "call_id"), 20)
    return kept.select("call_id", F.window("ts", "1 hour")["start"].alias("hour"))


@query(f"""with {CALLS_SQL}, d as (select date_trunc('day', ts) as start, count(*)::BIGINT as n, count(latency_ms) as l from calls group by 1), m as (select unnest(['conf', 'latency_ms']) as metric), s as (select unnest([0.1, 0.5, 0.99])::DOUBLE as share)
select start, n, metric, share, true as within from d, m, s where metric = 'conf' or l > 0""")
def merged_sketches(spark, sf):
    """Quantiles of days from the sketches of their hours: are their ranks within 1 % of what was asked for?"""
    from gaugeworks.streaming.shadow import merged_quantiles, window_sketches

    rows = calls(spark, sf)
    cuts = merged_quantiles(window_sketches(rows), "1 day").where("value is not null")
    days = rows.select(F.window("ts", "1 day")["start"].alias("start"), F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in ("conf", "latency_ms"))))).where("x is not null")
    below, upto = F.avg((F.col("x") < F.col("value")).cast("double")), F.avg((F.col("x") <= F.col("value")).cast("double"))
    ranks = days.join(F.broadcast(cuts), ["start", "metric"]).groupBy("start", "n", "metric", "share").agg(below.alias("low"), upto.alias("high"))  # a row for each day, metric and share
    return ranks.select("start", "n", "metric", "share", ((F.col("low") - 0.01 <= F.col("share")) & (F.col("share") <= F.col("high") + 0.01)).alias("within"))


DOMAINS = ("trade", "law", "health", "travel", "code", "school", "home")
DOMAIN_SQL = """(['trade', 'law', 'health', 'travel', 'code', 'school', 'home'])[((i * {stride} + ('0x' || substr(md5(a || '/' || b), 1, 8))::BIGINT) % 7) + 1]"""


@query(f"""with {P}, p as (select distinct least(truth, pred) as a, greatest(truth, pred) as b from preds where truth <> pred)
select 'pairs/' || a || '/' || b || '/' || i as job, 'pairs' as kind, a, b, {DOMAIN_SQL.format(stride=11)} as domain from p, range(9) r(i)""")
def boundary_plan(spark, sf):
    """Jobs for each boundary that predictions cross."""
    wrong = predictions(spark, sf).where("truth <> pred").select(F.least("truth", "pred").alias("a"), F.greatest("truth", "pred").alias("b"))
    return sampling.boundary_plan(wrong, list(DOMAINS))


@query(f"""with {P}, p as (select truth as a, pred as b from preds where truth <> pred group by 1, 2)
select 'anticue/' || a || '/' || b || '/' || i as job, 'anticue' as kind, a as label, b as decoy, {DOMAIN_SQL.format(stride=13)} as domain from p, range(7) r(i)""")
def anticue_plan(spark, sf):
    """Jobs for texts of one label that are taken for another."""
    return sampling.anticue_plan(predictions(spark, sf).where("truth <> pred").select(F.col("truth").alias("label"), F.col("pred").alias("decoy")), list(DOMAINS))


@query("""with pool as (select c_custkey, row_number() over (order by md5('e:' || c_custkey), c_custkey) - 1 as rank, count(*) over () as size from customer), l as (select *, row_number() over (order by label) - 1 as l from (select distinct o_orderpriority as label from orders)),
j as (select label, i, slot, ((l * 14 + i) * 6 + slot) % (select max(size) from pool) as rank from l, range(14) r(i), range(6) s(slot)) select 'real/' || label || '/' || i as job, label, slot::int as slot, c_custkey from j join pool using (rank)""")
def exemplar_plan(spark, sf):
    """Jobs with six different exemplars each, all exemplars used equally often."""
    labels = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("label"))
    return sampling.exemplar_plan(labels, table(spark, sf, "customer"), "c_custkey")


@query(f"""{PASSES_SQL}, t as (select case when passes[1] = passes[2] or passes[1] = passes[3] then passes[1] when passes[2] = passes[3] then passes[2] end as self, case when votes[1] = votes[2] or votes[1] = votes[3] then votes[1] when votes[2] = votes[3] then votes[2] end as panel, len({VOTES_SQL}) as n from j)
select count(*)::BIGINT as n, round(avg((self = panel)::int), 6) as agreement from t where self is not null and panel is not null and n = 3""")
def gold_agreement(spark, sf):
    """The panel's gold against that of one labeller's repeated passes."""
    rows = _passes(spark, sf)
    return rounded(votes.gold_agreement(votes.adjudicate(rows), votes.self_consistent(rows, "passes")))


@query(f"""with {P}, x as (select case when t >= 2 then 'BLOCK' else 'ALLOW' end as truth, list_transform(votes, lambda v: case when v >= '3' then 'BLOCK' else 'ALLOW' end) as v from preds) select truth, count(*)::BIGINT as n, sum((len(list_distinct(v)) = 1)::int)::BIGINT as unanimous from x group by 1""")
def threshold_fold(spark, sf):
    rows = folds.threshold_rows(predictions(spark, sf), PRIORITY, "3-MEDIUM")
    return rows.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.sum(votes.unanimous(F.col("votes")).cast("long")).alias("unanimous"))


def fold_scores_sql(tables: dict[str, list[str]]) -> str:
    """Of each table (groups by rank): agreement, accuracy and majority over preds."""
    rows = " union all ".join(f"select '{n}' as name, {g} as g" for n, g in tables.items())
    return f"""with {P}, f as ({rows}), x as (select name, g[t + 1] as own, g[p + 1] = g[t + 1] as hit, len(list_distinct(list_transform({VOTES_SQL}, lambda v: g[substr(v, 1, 1)::int]))) = 1 as agree from preds, f),
y as (select name, own, count(*) as n, sum(hit::int) as k, sum(agree::int) as a from x group by 1, 2) select name, sum(n)::BIGINT as n, round(sum(a) / sum(n), 6) as agreement, round(sum(k) / sum(n), 6) as accuracy, round(max(n) / sum(n), 6) as majority from y group by 1"""


#: The named decisions over the priorities: a ladder's labels are those of the same rank, its last one all above.
LADDER_TABLES = {n: [g[min(k, len(g) - 1)] for k in range(5)] for n, (_, g) in folds.DECISIONS.items()}


@query(fold_scores_sql(LADDER_TABLES))
def decision_scores(spark, sf):
    tables = {n: dict(zip(PRIORITY.labels, g, strict=True)) for n, g in LADDER_TABLES.items()}
    return rounded(folds.fold_scores(predictions(spark, sf), PRIORITY, tables))


@query(fold_scores_sql({n: [t[x] for x in PRIORITY.labels] for n, t in folds.merges(PRIORITY).items()}))
def merge_analysis(spark, sf):
    return rounded(folds.fold_scores(predictions(spark, sf), PRIORITY, folds.merges(PRIORITY)))


def _cut(k: int) -> str:
    return f"case when fold_id >> {k} & 1 = 1 then ' | ' else '+' end"


@query(f"""with {FOLDS_SQL} select '1-UR' || {_cut(0)} || '2-HI' || {_cut(1)} || '3-ME' || {_cut(2)} || '4-NO' || {_cut(3)} || '5-LO' as name, n_groups, round(agreement, 6) as agreement, round(minority, 6) as minority, minority < 0.06 as degenerate
from z order by z.agreement desc, z.minority desc, n_groups desc, name desc limit 5""")
def best_folds(spark, sf):
    return rounded(folds.best_folds(folds.fold_search(predictions(spark, sf), PRIORITY), 5))


MEMBERS = {"a": (0.25, "p"), "b": (0.3, "q"), "c": (0.35, "r")}


# ---- curves --------------------------------------------------------------------------------------------------


@query(f"""with {P}, grid as (select k, -4.0::DOUBLE + k * 0.05::DOUBLE as bias from range(201) r(k)), l as (select t, [ln(p0), ln(p1), ln(p2), ln(p3), ln(p4)] as l from preds),
f as (select t >= 2 as inside, greatest(l[1], l[2]) - greatest(l[3], l[4], l[5]) as flip from l)
select round(bias, 6) as bias, round(avg((bias > flip)::int) filter (where inside), 6) as containment, round(avg((bias > flip)::int) filter (where not inside), 6) as over_block from f, grid group by bias""")
def bias_sweep(spark, sf):
    return rounded(curves.bias_sweep(predictions(spark, sf), PRIORITY, "3-MEDIUM"))


@query(f"""with {P}, grid as (select k, -4.0::DOUBLE + k * 0.05::DOUBLE as bias from range(201) r(k)), f as (select t >= 2 as inside, greatest(ln(p0), ln(p1)) - greatest(ln(p2), ln(p3), ln(p4)) as flip from preds),
c as (select bias, avg((bias > flip)::int) filter (where inside) as containment, avg((bias > flip)::int) filter (where not inside) as over_block from f, grid group by bias), x as (select unnest([0.85, 0.90, 0.95])::DOUBLE as target)
select target, round(min(over_block) filter (where containment >= target), 6) as over_block from c, x group by target""")
def matched_over_block(spark, sf):
    return rounded(curves.matched_over_block(curves.bias_sweep(predictions(spark, sf), PRIORITY, "3-MEDIUM")))


SCORES_SQL = f"{P}, scored as (select row_id, p2 + p3 + p4 as score, t >= 2 as positive from preds)"


def _scores(spark, sf):
    p = lambda k: F.get("probs", F.lit(k))
    return predictions(spark, sf).select("row_id", (p(2) + p(3) + p(4)).alias("score"), (PRIORITY.rank(F.col("truth")) >= 2).alias("positive"))


@query(f"""with {SCORES_SQL}, x as (select unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE as threshold)
select threshold, round(avg(((score >= threshold) = positive)::int), 6) as accuracy, round(avg((score >= threshold)::int) filter (where positive), 6) as recall, round(avg(positive::int) filter (where score >= threshold), 6) as precision,
round(avg((score >= threshold)::int) filter (where not positive), 6) as false_fire from scored, x group by 1""")
def threshold_curve(spark, sf):
    return rounded(curves.threshold_curve(_scores(spark, sf)))


CHOICES_SQL = f"""{SCORES_SQL}, {HALVES_SQL.format(repeats=40)}, g as (select k * 0.05::DOUBLE as th from range(1, 20) r(k)),
c as (select rep, half, th, avg(((score >= th) = positive)::int) as a from halves, g group by 1, 2, 3), b as (select rep, half, th, a from c qualify row_number() over (partition by rep, half order by a desc, th) = 1),
o as (select b.th, b.a as fitted, c.a from b join c on c.rep = b.rep and c.half = 1 - b.half and c.th = b.th)"""


@query(f"with {CHOICES_SQL} select round(th, 6) as threshold, count(*)::BIGINT as times, round(avg(a), 6) as accuracy from o group by 1")
def heldout_threshold(spark, sf):
    return rounded(curves.heldout_threshold(_scores(spark, sf)))


@query(f"""with {CHOICES_SQL} select round(avg(fitted), 6) as "threshold/fitted", round(avg(a), 6) as "threshold/heldout" from o""")
def threshold_transfer(spark, sf):
    return rounded(curves.threshold_transfer(_scores(spark, sf)))


def transfer_sql(repeats: int, targets: str) -> str:
    return f"""{SCORES_SQL}, {HALVES_SQL.format(repeats=repeats)}, cand as (select distinct rep, half, round(score, 3) as th from halves), tg as (select unnest([{targets}])::DOUBLE as target),
cc as (select c.rep, c.half, c.th, avg((h.score >= c.th)::int) as con from cand c join halves h on h.rep = c.rep and h.half = c.half and h.positive group by 1, 2, 3),
ch as (select rep, half, target, max(th) as cut from cc, tg where con >= target group by 1, 2, 3), e as (select h.rep, h.half, target, avg((score >= cut)::int) filter (where positive) as c, avg((score >= cut)::int) filter (where not positive) as o
from halves h join ch on ch.rep = h.rep and ch.half = 1 - h.half group by 1, 2, 3)"""


@query(f"with {transfer_sql(60, '0.95')} select round(avg(c), 6) as containment, round(avg(o), 6) as over_block, round(avg((c < 0.95)::int), 6) as miss_rate, count(*)::BIGINT as evaluations from e")
def containment_transfer(spark, sf):
    return rounded(curves.containment_transfer(_scores(spark, sf)))


@query(f"with {transfer_sql(40, '0.90, 0.95, 0.99')} select target, round(avg(c), 6) as achieved, round(avg(c) - target, 6) as shortfall, round(avg(o), 6) as false_fire, round(avg((c < target)::int), 6) as miss_rate, count(*)::BIGINT as evaluations from e group by target")
def recall_guide(spark, sf):
    return rounded(curves.recall_guide(_scores(spark, sf)))


@query(f"""with {SCORES_SQL}, th as (select distinct round(score, 4) as th from scored), c as (select th, avg((score >= th)::int) filter (where positive) as con, avg((score >= th)::int) filter (where not positive) as o from scored, th group by 1),
t as (select unnest([0.85, 0.90, 0.95, 0.99])::DOUBLE as target) select target, round(min(o) filter (where con >= target), 6) as over_block from c, t group by 1""")
def exact_over_block(spark, sf):
    return rounded(curves.exact_over_block(_scores(spark, sf)))


MATCHED_SQL = """, grid as (select k, -4.0::DOUBLE + k * 0.05::DOUBLE as bias from range(241) r(k)), f as (select 'a' as m, t >= 2 as inside, greatest(ln(p0), ln(p1)) - greatest(ln(p2), ln(p3), ln(p4)) as flip from ma
union all select 'b', t >= 2, greatest(ln(p0), ln(p1)) - greatest(ln(p2), ln(p3), ln(p4)) from mb), c as (select m, bias, avg((bias > flip)::int) filter (where inside) as con, avg((bias > flip)::int) filter (where not inside) as o from f, grid group by 1, 2),
x as (select unnest([0.85, 0.90, 0.95])::DOUBLE as target), z as (select target, min(o) filter (where con >= target and m = 'a') as a, min(o) filter (where con >= target and m = 'b') as b from c, x group by 1)"""


def _compared(spark, sf):
    sides = (predictions(spark, sf, *MEMBERS[m]) for m in ("a", "b"))
    return curves.matched_comparison(*(curves.matched_over_block(curves.bias_sweep(rows, PRIORITY, "3-MEDIUM", high=8.0)) for rows in sides))


@query("with " + preds_sql(0.25, "p", "ma") + ", " + preds_sql(0.3, "q", "mb") + MATCHED_SQL + " select target, round(a, 6) as a, round(b, 6) as b, a < b as won from z")
def matched_comparison(spark, sf):
    return rounded(_compared(spark, sf))


@query("with " + preds_sql(0.25, "p", "ma") + ", " + preds_sql(0.3, "q", "mb") + MATCHED_SQL + " select count(*) filter (where a < b)::BIGINT as cells_won, count(a < b)::BIGINT as cells from z")
def cells_won(spark, sf):
    return curves.cells_won(_compared(spark, sf))


COVER = (1.0, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4)
COVER_SQL = f"{P}, cv as (" + " union all ".join(f"select {c}::DOUBLE as coverage, quantile_cont(conf, {1 - c!r}) as cut from preds" for c in COVER) + "), curve as (select coverage, avg((truth = pred)::int) as accuracy, count(*) as kept from preds join cv on conf >= cut group by 1)"


@query(f"""with {COVER_SQL}, d as (select *, lag(accuracy) over (order by coverage desc) - accuracy as fall from curve)
select coverage, round(accuracy, 6) as accuracy, kept::BIGINT as kept, round(fall, 6) as fall, coalesce(fall > 0.005, false) as inverted from d""")
def ordering_audit(spark, sf):
    return rounded(curves.ordering_audit(predictions(spark, sf), COVER))


RATIOS = [0.4, 0.2, 0.0, -0.2, -0.4]


@query(f"""with {P}, tau as (select unnest([0.0, 0.5, 1.0, 1.5, 2.0])::DOUBLE as tau), s as (select tau, t, [ln(p0) + tau * 0.4::DOUBLE, ln(p1) + tau * 0.2::DOUBLE, ln(p2) + tau * 0.0::DOUBLE, ln(p3) + tau * -0.2::DOUBLE, ln(p4) + tau * -0.4::DOUBLE] as l from preds, tau)
select tau, round(avg((list_position(l, list_max(l)) - 1 = t)::int), 6) as accuracy from s group by 1""")
def prior_shift(spark, sf):
    return rounded(curves.prior_shift(predictions(spark, sf), RATIOS, labels=PRIORITY.labels))


@query(f"""with {P}, x as (select t <= 1 as t, p <= 1 as a, p0 + p1 >= p2 + p3 + p4 as b from preds), c as (select count(*)::BIGINT as n, avg((t = a)::int) as af, avg((t = b)::int) as ff, avg((a <> b)::int) as d, sum((t = a and t <> b)::int)::BIGINT as oa, sum((t <> a and t = b)::int)::BIGINT as ob from x)
select n, round(af, 6) as argmax_first, round(ff, 6) as fold_first, round(d, 6) as disagreement, oa as only_a, ob as only_b,
round(case when oa + ob = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(least(oa, ob) + 1), lambda k: exp(lgamma(oa + ob + 1) - lgamma(k + 1) - lgamma(oa + ob - k + 1) - (oa + ob) * ln(2.0))))) end, 6) as p_value from c""")
def fold_orders(spark, sf):
    return rounded(curves.fold_orders(predictions(spark, sf), PRIORITY, "route"))


HEADS = (0.98, 0.95, 0.90, 0.85, 0.80)


@query(f"""with {P}, {preds_sql(0.3, "q", "heads")}, x as (select p.t, (p.p0 + p.p1 >= p.p2 + p.p3 + p.p4) = (p.t <= 1) as ok, greatest(p.p0, p.p1, p.p2, p.p3, p.p4) as f, greatest(p.p0 + p.p1, p.p2 + p.p3 + p.p4) as c, (h.p <= 1) = (p.t <= 1) as hok, h.conf as hc from preds p join heads h using (row_id)),
s as (select ok::int as ok, 'naive' as strategy, f as conf from x union all select ok::int, 'fold-aware', c from x union all select hok::int, 'binary head', hc from x),
q as ({" union all ".join(f"select strategy, {c}::DOUBLE as coverage, quantile_cont(conf, {1 - c!r}) as cut from s group by 1" for c in HEADS)})
select strategy, coverage, round(avg(ok) filter (where conf >= cut), 6) as accuracy, round(avg(ok) filter (where conf < cut), 6) as waste from s join q using (strategy) group by 1, 2""")
def fold_aware_abstention(spark, sf):
    head = predictions(spark, sf, 0.3, "q").select("row_id", PRIORITY.group(PRIORITY.folds["route"], F.col("pred")).alias("head"), F.col("conf").alias("head_conf"))
    return rounded(curves.fold_aware_abstention(predictions(spark, sf).join(head, "row_id"), PRIORITY, "route", "head", "head_conf", HEADS))


@query()
def offset_report(spark, sf):
    """Accuracy before and after offsets fitted on one half by coordinate ascent, which SQL can't express."""
    rows = predictions(spark, sf)
    return rounded(curves.offset_report(rows.where("row_id % 2 = 0"), rows.where("row_id % 2 = 1"), PRIORITY.labels))


@query("with " + ", ".join(preds_sql(r, s, f"m{k}") for k, (r, s) in MEMBERS.items()) + """, j as (select ma.t, [ma.p0, ma.p1, ma.p2, ma.p3, ma.p4] as a, [mb.p0, mb.p1, mb.p2, mb.p3, mb.p4] as b, [mc.p0, mc.p1, mc.p2, mc.p3, mc.p4] as c from ma join mb using (row_id) join mc using (row_id)),
s as (select t, 'a' as members, 1 as size, a as l from j union all select t, 'b', 1, b from j union all select t, 'c', 1, c from j union all select t, 'a+b', 2, [a[i] + b[i] for i in range(1, 6)] from j
union all select t, 'a+c', 2, [a[i] + c[i] for i in range(1, 6)] from j union all select t, 'b+c', 2, [b[i] + c[i] for i in range(1, 6)] from j union all select t, 'a+b+c', 3, [a[i] + b[i] + c[i] for i in range(1, 6)] from j)
select members, size::int as size, round(avg((list_position(l, list_max(l)) - 1 = t)::int), 6) as accuracy from s group by 1, 2""")
def ensemble_search(spark, sf):
    out = predictions(spark, sf, *MEMBERS["a"]).select("row_id", "truth", F.col("probs").alias("a"))
    for name in ("b", "c"):
        out = out.join(predictions(spark, sf, *MEMBERS[name]).select("row_id", F.col("probs").alias(name)), "row_id")
    return rounded(curves.ensemble_search(out, list(MEMBERS), PRIORITY.labels))


# ---- sampling ------------------------------------------------------------------------------------------------


@query(f"""with {P} select row_id, truth from preds qualify row_number() over (partition by truth order by md5('s:' || row_id), row_id) <= 20""")
def stratified_sample(spark, sf):
    return sampling.stratified(predictions(spark, sf), "truth", 20).select("row_id", "truth")


SKEWED_SQL = f"{P}, sk as (select row_id, case when t = 0 then 'rare' when t <= 2 then 'some' else 'many' end as tier from preds)"


def _skewed(spark, sf):
    t = PRIORITY.rank(F.col("truth"))
    return predictions(spark, sf).select("row_id", F.when(t == 0, "rare").when(t <= 2, "some").otherwise("many").alias("tier"))


@query(f"""with {SKEWED_SQL}, n as (select tier, count(*) as n from sk group by 1), tg as (select list_sort(list(n))[(count(*) // 2)::int + 1] as target from n), r as (select *, row_number() over (partition by tier order by md5('b:' || row_id), row_id) as rn from sk)
select row_id, tier, unnest(range(((target - rn) // n)::BIGINT + 1))::int as copy from r join n using (tier), tg where rn <= target""")
def balance_classes(spark, sf):
    return sampling.balanced(_skewed(spark, sf), "tier").select("row_id", "tier", "copy")


@query(f"""with {SKEWED_SQL}, n as (select tier, count(*) as n from sk group by 1), w as (select tier, n, case tier when 'rare' then 0.5 when 'some' then 0.3 else 0.2 end::DOUBLE as w from n), q as (select tier, floor((select min(n / w) from w) * w + 1e-9) as quota from w)
select row_id, tier from sk join q using (tier) qualify row_number() over (partition by tier order by md5('p:' || row_id), row_id) <= any_value(quota) over (partition by tier)""")
def resample_to_prior(spark, sf):
    prior = spark.createDataFrame([("rare", 0.5), ("some", 0.3), ("many", 0.2)], "tier string, share double")
    return sampling.to_prior(_skewed(spark, sf), prior, "tier")


@query(f"""with {SKEWED_SQL}, n as (select tier, count(*) as n from sk group by 1), w as (select tier, n, sqrt(case tier when 'rare' then 0.5 when 'some' then 0.3 else 0.2 end::DOUBLE * n / sum(n) over ()) as w from n), v as (select tier, n, w / sum(w) over () as w from w),
q as (select tier, floor((select min(n / w) from v) * w + 1e-9) as quota from v) select row_id, tier from sk join q using (tier) qualify row_number() over (partition by tier order by md5('p:' || row_id), row_id) <= any_value(quota) over (partition by tier)""")
def resample_to_root_prior(spark, sf):
    prior = spark.createDataFrame([("rare", 0.5), ("some", 0.3), ("many", 0.2)], "tier string, share double")
    return sampling.to_prior(_skewed(spark, sf), prior, "tier", root=True)


@query(f"""with {P}, m as (select row_id, pred, conf - (1 - conf) / 4 as margin from preds), c as (select * from m qualify row_number() over (partition by pred order by margin, row_id) <= 16), u as (select * from c order by margin, row_id limit 80),
r as (select * from m where row_id not in (select row_id from u) order by md5('u:' || row_id), row_id limit 20) select row_id, pred, round(margin, 6) as margin, 'uncertain' as chosen from u union all select row_id, pred, round(margin, 6), 'random' from r""")
def uncertainty_selection(spark, sf):
    rows = predictions(spark, sf).select("row_id", "pred", probs.margin(F.col("probs")).alias("margin"))
    return rounded(sampling.most_uncertain(rows, 100, 5, 0.2))


@query(f"with {P}, r as (select row_id, row_number() over (order by md5('x:' || row_id), row_id) as rn from preds) select row_id from r where rn > 100 and rn <= 250")
def slice_after(spark, sf):
    return sampling.slice_after(predictions(spark, sf).select("row_id"), 100, 250)


@query(f"""with {P}, g as (select row_id, row_id % 2 as pool, [truth, pred, votes[1]] as c from preds) select pool::BIGINT as pool, count(*)::BIGINT as jobs, count(distinct c)::BIGINT as combinations from g group by 1""")
def plan_breadth(spark, sf):
    rows = predictions(spark, sf).select((F.col("row_id") % 2).alias("pool"), F.array("truth", "pred", F.get("votes", F.lit(0))).alias("combination"))
    return sampling.breadth(rows, ["combination"])


@query(f"""with {P}, m as (select row_id, pred, votes[1] as screen, conf - (1 - conf) / 4 as margin from preds), c as (select * from m where margin >= 0.5 and pred <> screen qualify row_number() over (partition by pred order by margin desc, row_id) <= 20)
select row_id, pred, screen from c order by margin desc, row_id limit 100""")
def disagreement_selection(spark, sf):
    rows = predictions(spark, sf).select("row_id", "pred", F.get("votes", F.lit(0)).alias("screen"), probs.margin(F.col("probs")).alias("margin"))
    return sampling.disagreements(rows, 0.5, 100, 5).select("row_id", "pred", "screen")


@query(f"""with {CALLS_SQL} select call_id from calls where (('0x' || substr(md5('r:' || call_id), 1, 8))::BIGINT / 4294967296::DOUBLE) < least(1.0, 0.05 * case when conf < 0.6 then 5.0 else 1.0 end)""")
def retained_calls(spark, sf):
    return sampling.retained(calls(spark, sf), 0.05, "call_id").select("call_id")


# ---- corpora -------------------------------------------------------------------------------------------------

KEY_SQL = r"md5(trim(regexp_replace(lower({0}), '[ \t\n\r\f\v]+', ' ', 'g')))"


@query(rf"""with f as (select conv_id, trim(text) as text from conversations where turn = 0 and role = 'user'), g as (select conv_id, text, {KEY_SQL.format('text')} as text_key from f
where length(text) between 15 and 2000 and length(text) - length(replace(text, chr(10), '')) <= 40 and regexp_matches(text, '[A-Za-z]{{3}}')) select text_key, min(conv_id) as conv_id from g group by 1""")
def harvest_prompts(spark, sf):
    return corpus.harvest(table(spark, sf, "conversations")).select("text_key", "conv_id")


@query(rf"select {KEY_SQL.format('text')} as text_key, min(doc_id) as doc_id, count(*)::BIGINT as copies from documents group by 1")
def first_occurrences(spark, sf):
    rows = table(spark, sf, "documents").select(text.key(F.col("text")).alias("text_key"), "doc_id")
    first = corpus.first_of_key(rows, "text_key", "doc_id")
    return first.join(rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")), "text_key")


@query(rf"with h as (select {KEY_SQL.format('text')} as k from documents where source in ('src0', 'src1')) select doc_id from documents where source not in ('src0', 'src1') and {KEY_SQL.format('text')} not in (select k from h)")
def decontaminated_documents(spark, sf):
    docs = table(spark, sf, "documents")
    held = docs.where(F.col("source").isin("src0", "src1"))
    return corpus.decontaminate(docs.where(~F.col("source").isin("src0", "src1")), held).select("doc_id")


@query("with a as (select trim(text) as text from documents where source = 'src0' intersect select trim(text) from documents where source <> 'src0') select md5(text) as text_md5, length(text)::int as n_chars from a")
def leaked_texts(spark, sf):
    docs = table(spark, sf, "documents").select("text", "source")
    return corpus.leaks(docs.where("source = 'src0'"), docs.where("source <> 'src0'")).select(F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@query("""with a as (select d.doc_id as row_id, case when l.quality = 1 then 'good' else 'bad' end as old, case when d.n_chars >= 500 then 'good' else 'bad' end as new from documents d join labels l using (doc_id)) select old, new, count(*)::BIGINT as n from a where old <> new group by 1, 2""")
def changed_labels(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.when(F.col("n_chars") >= 500, "good").otherwise("bad").alias("tier"))
    gold = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("tier"))
    return corpus.changed_labels(gold, docs)


@query("""with n as (select d.text, arg_max(l.quality, d.doc_id) as q from documents d join labels l using (doc_id) group by 1) select d.doc_id, case n.q when 1 then 'good' when 0 then 'bad' end as tier from documents d left join n using (text)""")
def relabelled_texts(spark, sf):
    """Documents with the label that their text has, the last one of texts that are labelled more than once."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    names = docs.join(table(spark, sf, "labels"), "doc_id").select("text", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("tier"), F.col("doc_id").alias("at"))
    return corpus.relabelled(docs, names).select("doc_id", "tier")


@query("with c as (select source, lang, count(*) as n from documents group by 1, 2) select source, lang, n::BIGINT as n, round(n / sum(n) over (partition by source), 6) as share from c")
def source_mixes(spark, sf):
    return rounded(corpus.mixes(table(spark, sf, "documents"), "lang", "source"))


@query(r"""with s as (select doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) as n_words, length(text) - length(replace(text, chr(10), '')) as n_newlines from documents) select doc_id, n_words::int as n_words, n_newlines::int as n_newlines from s""")
def text_sizes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"), text.newlines(F.col("text")).alias("n_newlines"))


SEGMENTS_SQL = r"""s as (select doc_id, text, list_transform(regexp_extract_all(text, '"[^"]{80,}"|“[^”]{80,}”'), lambda x: regexp_replace(substr(x, 2, length(x) - 2), '^\s+|\s+$', '', 'g')) as q,
list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 80) as p from documents),
seg as (select doc_id, list_prepend(text, list_slice(case when len(q) > 0 then list_filter(q, lambda x: length(x) >= 80) else p end, 1, 6)) as seg from s)"""


@query(rf"""with {SEGMENTS_SQL}, n as (select doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x) <> '')) as k from documents)
select doc_id, n.k::int as n_sentences, len(seg)::int as n_segments from seg join n using (doc_id)""")
def text_segments(spark, sf):
    """Sentences and long segments of each document."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.size(text.sentences(t)).alias("n_sentences"), F.size(text.segments(t)).alias("n_segments"))


@query(f"""with {SEGMENTS_SQL}, u as (select doc_id, unnest(seg) as x from seg) select doc_id as row_id, 'tier' || max(length(x) % 5) as label, count(*)::BIGINT as n_segments from u group by 1""")
def span_max(spark, sf):
    """A rule as a classifier over each text and its parts; the highest label counts."""
    labels = [f"tier{k}" for k in range(5)]
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return adapters.span_max(rows, adapters.FunctionAdapter(labels, lambda t: f"tier{len(t) % 5}"), labels)


@query(f"""with {SEGMENTS_SQL}, u as (select doc_id, unnest(seg) as x from seg) select doc_id as row_id, 'tier' || max(length(x) % 5) as label, count(*)::BIGINT as n_segments from u group by 1""")
def segments_by_sql(spark, sf):
    """The same from SQL: segments_of(text) exploded laterally, in one pass over the documents."""
    tables.register_tables(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return spark.sql("SELECT doc_id AS row_id, concat('tier', max(length(segment) % 5)) AS label, count(*) AS n_segments FROM (SELECT doc_id, segments_of(text) AS parts FROM {docs}) LATERAL VIEW posexplode(parts) s AS at, segment GROUP BY doc_id", docs=docs)


@query("select doc_id, lang from documents d join labels l using (doc_id) where lang = 'en' and coalesce(toxic, 0) = 0")
def english_and_civil(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    return corpus.english_and_civil(rows, "lang", "toxic", "en").select("doc_id", "lang")


@query("""with h as (select lang as label, count(*) / sum(count(*)) over () as have from documents group by 1), w as (select lang as label, count(*) / sum(count(*)) over () as want from documents join labels using (doc_id) where quality = 1 group by 1)
select label, round(have, 6) as have, round(want, 6) as want, round(ln(want / have), 6) as ratio from h full join w using (label)""")
def prior_ratios(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    return rounded(corpus.prior_ratios(docs, docs.join(table(spark, sf, "labels").where("quality = 1"), "doc_id").select("label")))


@query("""with n as (select lang, count(*) as n from documents group by 1), k as (select unnest(['en', 'de', 'fr', 'es', 'xx']) as label, unnest([0, 1, 2, 3, 4]) as place), w as (select label, sqrt((select sum(n) from n) / coalesce(n, 1)) * (1 + 0.5 * place / 4) as w from k left join n on n.lang = k.label)
select label, round(w / avg(w) over (), 6) as weight from w""")
def class_weights(spark, sf):
    return rounded(corpus.class_weights(table(spark, sf, "documents").select(F.col("lang").alias("label")), ["en", "de", "fr", "es", "xx"], 0.5))


@query(f"""with {P}, k as (select row_id, [p0, p1, p2, p3, p4] as q from preds), w as (select unnest(range(5)) as i), z as (select a.i, b.i as j, case abs(a.i - b.i) when 1 then 1.0 when 2 then 0.5 else 0 end as w from w a, w b), t as (select i, sum(w) as s from z group by 1),
m as (select row_id, z.j, sum(q[z.i + 1] * case when z.i = z.j then 0.88 else 0.12 * w / s end) as m from k, z join t using (i) group by 1, 2) select row_id, round(m, 6) as mass, j::int as rank from m where j = 2""")
def smoothed_targets(spark, sf):
    return rounded(predictions(spark, sf).select("row_id", F.get(probs.smoothed(F.col("probs"), 5), F.lit(2)).alias("mass"), F.lit(2).alias("rank")))


@query(f"""with {P}, x as (select row_id, votes, list_filter(votes, lambda v: v is not null and v <> '5-LOW') as v from preds) select row_id, round(case when row_id % 3 = 0 then 0.7 when len(v) > 0 then 0.97 * len(list_filter(v, lambda y: y = '1-URGENT')) / len(v) + 0.03 / 4 end, 6) as mass from x""")
def soft_targets(spark, sf):
    known = PRIORITY.labels[:4]
    given = F.when(F.col("row_id") % 3 == 0, F.array(*map(F.lit, (0.7, 0.1, 0.1, 0.1))))
    return rounded(predictions(spark, sf).select("row_id", F.get(probs.soft_target(F.col("votes"), known, given=given), F.lit(0)).alias("mass")))


# ---- vectors -------------------------------------------------------------------------------------------------

VEC_SQL = """e as (select vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) as v from embeddings), a as (select vec_id as aid, label as alabel, v as av from e where vec_id % 10 = 0), q as (select * from e where vec_id % 10 <> 0)"""


@query(f"""with {VEC_SQL}, s as (select vec_id, alabel, list_cosine_similarity(v, av) as c from q, a), t as (select vec_id, alabel, c from s qualify row_number() over (partition by vec_id, alabel order by c desc) <= 3), m as (select vec_id, alabel, avg(c) as s from t group by 1, 2)
select vec_id as row_id, alabel as label, round(s, 6) as score from m qualify row_number() over (partition by vec_id order by round(s, 12) desc, alabel) = 1""")
def anchor_labels(spark, sf):
    rows = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id")
    return rounded(vectors.best_label(vectors.anchor_scores(rows.where("row_id % 10 <> 0"), rows.where("row_id % 10 = 0"))))


@query(f"""with {VEC_SQL}, un as (select alabel, unnest(av) / sqrt(list_dot_product(av, av)) as x, generate_subscripts(av, 1) as i from a), c as (select alabel, list(x order by i) as c from (select alabel, i, avg(x) as x from un group by 1, 2) group by 1)
select vec_id as row_id, alabel as label, round(list_cosine_similarity(v, c), 6) as score from q, c qualify row_number() over (partition by vec_id order by round(list_cosine_similarity(v, c), 12) desc, alabel) = 1""")
def nearest_centroids(spark, sf):
    rows = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id")
    return rounded(vectors.nearest_centroid(rows.where("row_id % 10 <> 0"), rows.where("row_id % 10 = 0")))


@query(f"""with {VEC_SQL}, s as (select vec_id, chr(97 + alabel) as alabel, list_cosine_similarity(v, av) as c from q, a), t as (select vec_id, alabel, c from s qualify row_number() over (partition by vec_id, alabel order by c desc) <= 3), m as (select vec_id, alabel, avg(c) as s from t group by 1, 2)
select vec_id as row_id, alabel as label, round(s, 6) as score from m qualify row_number() over (partition by vec_id order by round(s, 12) desc, alabel) = 1""")
def named_anchor_labels(spark, sf):
    """The same with labels that are names."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", F.chr(F.col("label") + 97).alias("label"))
    return rounded(vectors.best_label(vectors.anchor_scores(rows.where("row_id % 10 <> 0"), rows.where("row_id % 10 = 0"))))


@query(f"""with {VEC_SQL}, s as (select vec_id, alabel, max(list_cosine_similarity(v, av)) as c from q, a group by 1, 2) select vec_id as row_id, 'l' || alabel as label, round(c, 6) as score from s where alabel < 4 qualify row_number() over (partition by vec_id order by round(c, 12) desc, alabel) = 1""")
def hypothesis_labels(spark, sf):
    """The best of a few hypotheses for each row, by scores that here are cosines."""
    rows = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id")
    scores = vectors.anchor_scores(rows.where("row_id % 10 <> 0"), rows.where("row_id % 10 = 0"), 1)
    named = scores.select("row_id", F.concat(F.lit("l"), F.col("label").cast("string")).alias("label"), F.round("score", 12).alias("score"))
    return rounded(judging.hypothesis_labels(named, ["l0", "l1", "l2", "l3"]))


@query()
def medoid_anchors(spark, sf):
    """Rows at even distances below the centroid; ranks of nearly equal cosines depend on the order of summing."""
    return vectors.medoid_anchors(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id"), 5)


@query()
def encoder_bake_off(spark, sf):
    """Two encoders' embeddings of the same rows by probe and by centroids; here the second keeps half of the numbers."""
    rows = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id")
    return rounded(probe.bake_off({"whole": rows, "half": rows.withColumn("embedding", F.slice("embedding", 1, 32))}), 3)


@query("""with a as (select n.n_nationkey as k, avg(c.c_acctbal) as x, count(*) as n from customer c join nation n on n.n_nationkey = c.c_nationkey group by 1), b as (select s_nationkey as k, avg(s_acctbal) as y from supplier group by 1)
select round(corr(x, y), 6) as r, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, count(*)::BIGINT as n from a join b using (k)""")
def agreement_fit(spark, sf):
    """Correlation and least-squares line of two measures of the same groups."""
    x = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("x"))
    y = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("y"))
    return rounded(x.join(y, "k").agg(F.corr("x", "y").alias("r"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count(F.lit(1)).alias("n")))


# ---- judges, teachers, specialists ---------------------------------------------------------------------------


def _members(spark, sf):
    out = predictions(spark, sf, *MEMBERS["a"]).select("row_id", "truth", F.col("pred").alias("a"), F.col("probs").alias("pa"))
    for name in ("b", "c"):
        out = out.join(predictions(spark, sf, *MEMBERS[name]).select("row_id", F.col("pred").alias(name), F.col("probs").alias(f"p{name}")), "row_id")
    return out


MEMBERS_SQL = ", ".join(preds_sql(r, s, f"m{k}") for k, (r, s) in MEMBERS.items()) + ", j as (select row_id, ma.truth, ma.t, ma.pred as a, mb.pred as b, mc.pred as c, ma.p0 as p0, ma.p1 as p1, ma.p2 as p2, ma.p3 as p3, ma.p4 as p4, [ma.p0 + mb.p0 + mc.p0, ma.p1 + mb.p1 + mc.p1, ma.p2 + mb.p2 + mc.p2, ma.p3 + mb.p3 + mc.p3, ma.p4 + mb.p4 + mc.p4] as s from ma join mb using (row_id) join mc using (row_id))"


@query(f"with {MEMBERS_SQL}, x as (select 'a' as a, 'b' as b, a <> truth as w, b <> truth as v from j union all select 'a', 'c', a <> truth, c <> truth from j union all select 'b', 'c', b <> truth, c <> truth from j) select a, b, count(*) filter (where w and v)::BIGINT as both, count(*) filter (where w or v)::BIGINT as either, round(count(*) filter (where w and v) / count(*) filter (where w or v), 6) as jaccard from x group by 1, 2")
def error_overlap(spark, sf):
    return rounded(judging.error_overlap(_members(spark, sf), ["a", "b", "c"]))


@query(f"with {MEMBERS_SQL} select row_id, truth from j where a <> truth and b <> truth and c <> truth")
def all_members_wrong(spark, sf):
    return judging.all_wrong(_members(spark, sf), ["a", "b", "c"]).select("row_id", "truth")


@query(f"with {MEMBERS_SQL} select (['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[list_position(s, list_max(s))] as tier, count(*)::BIGINT as n, round(avg(list_max(s) / 3), 4) as confidence from j group by 1")
def distilled_labels(spark, sf):
    rows = judging.distilled(_members(spark, sf), ["pa", "pb", "pc"], PRIORITY.labels)
    return rounded(rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_max("soft_dist")).alias("confidence")), 4)


@query(f"""with {P}, j as (select row_id, {frames.u("'f:' || row_id")} < 0.5 as flip, case when {frames.u("'w:' || row_id")} < 0.45 then 'A' when {frames.u("'w:' || row_id")} < 0.9 then 'B' else 'tie' end as verdict from preds where truth <> pred),
w as (select case when verdict = 'tie' then 'neither' when (verdict = 'A') = (not flip) then 'gold' else 'model' end as who from j)
select count(*)::BIGINT as n, count(*) filter (where who = 'gold')::BIGINT as gold, count(*) filter (where who = 'model')::BIGINT as model, count(*) filter (where who = 'neither')::BIGINT as neither, round(1 - count(*) filter (where who = 'gold') / count(*), 6) as ceiling from w""")
def paired_adjudication(spark, sf):
    w = text.hash_unit("w:", F.col("row_id"))
    rows = predictions(spark, sf).where("truth <> pred").select("row_id", judging.flipped(F.col("row_id")).alias("flip"), F.when(w < 0.45, "A").when(w < 0.9, "B").otherwise("tie").alias("verdict"))
    return rounded(judging.paired_tally(rows))


LENGTH_SQL = f"""(with {P}, x as (select row_id, {frames.u("'f:' || row_id")} < 0.5 as flip, case when {frames.u("'w:' || row_id")} < 0.45 then 'A' when {frames.u("'w:' || row_id")} < 0.9 then 'B' else 'tie' end as verdict, row_id % 13 as a, row_id % 17 as b from preds where truth <> pred),
d as (select *, (verdict = 'A') = (not flip) as a_won from x where verdict <> 'tie' and a <> b) select count(*)::BIGINT as decided, round(avg((a_won = (a > b))::int), 6) as longer_wins, median(a)::DOUBLE as median_a, median(b)::DOUBLE as median_b from d)"""


@query(f"select * from {LENGTH_SQL}")
def length_bias(spark, sf):
    w = text.hash_unit("w:", F.col("row_id"))
    rows = predictions(spark, sf).where("truth <> pred").select(judging.flipped(F.col("row_id")).alias("flip"), F.when(w < 0.45, "A").when(w < 0.9, "B").otherwise("tie").alias("verdict"), (F.col("row_id") % 13).alias("words_a"), (F.col("row_id") % 17).alias("words_b"))
    return rounded(judging.length_bias(rows))


@query(f"""with {P}, x as (select truth, pred, votes[1] as s from preds where votes[1] is not null) select truth, count(*)::BIGINT as n, round(avg((pred = s)::int), 6) as agreement from x group by 1""")
def screen_agreement(spark, sf):
    rows = predictions(spark, sf).withColumn("screen", F.get("votes", F.lit(0)))
    return rounded(judging.agreement_by(rows, "truth", "pred", "screen"))


@query(f"""with {MEMBERS_SQL}, f as (select *, (a in ('1-URGENT', '2-HIGH')) as near, b in ('1-URGENT', '2-HIGH') as known from j), r as (select truth, a as pred, case when near and known and least(p0, p1) >= greatest(p2, p3, p4) then b else a end as final, near and known and least(p0, p1) >= greatest(p2, p3, p4) as fired from f)
select sum(fired::int)::BIGINT as fired, sum((final <> pred)::int)::BIGINT as changed, sum((final = truth)::int - (pred = truth)::int)::BIGINT as net_corrected from r""")
def arbiter(spark, sf):
    """All rows; the specialist of a pair has an answer where the second member's label is of the pair."""
    special = F.when(F.col("b").isin("1-URGENT", "2-HIGH"), probs.one_hot(F.col("b"), ["1-URGENT", "2-HIGH"]))
    rows = _members(spark, sf).select("truth", F.col("a").alias("pred"), F.col("pa").alias("probs"), special.alias("special"))
    return judging.arbiter_summary(judging.arbitrated(rows, PRIORITY.labels, {("1-URGENT", "2-HIGH"): "special"}))


@query(f"with {MEMBERS_SQL} select greatest(a, b, c) as tier, count(*)::BIGINT as n from j group by 1")
def highest_tiers(spark, sf):
    return curves.highest_tier(_members(spark, sf), ["a", "b", "c"], PRIORITY).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {P}, x as (select truth as tier, votes[1] as v from preds where votes[1] is not null) select count(*)::BIGINT as n, round(avg((tier = v)::int), 6) as agreement from x")
def verifier_agreement(spark, sf):
    return rounded(judging.verifier_agreement(predictions(spark, sf).select(F.col("truth").alias("tier"), F.get("votes", F.lit(0)).alias("verifier"))))


@query(f"with {P} select truth as tier, votes[1] as verifier, count(*)::BIGINT as n from preds where truth <> votes[1] group by 1, 2 order by n desc, tier, verifier limit 5")
def verifier_disagreements(spark, sf):
    return judging.verifier_disagreements(predictions(spark, sf).select(F.col("truth").alias("tier"), F.get("votes", F.lit(0)).alias("verifier")))


@query(f"with {P} select case when truth = votes[1] then 'kept' else 'contested' end as stratum, count(*)::BIGINT as n from preds group by 1")
def verifier_strata(spark, sf):
    rows = judging.kept_by_verifier(predictions(spark, sf).select(F.col("truth").alias("tier"), F.get("votes", F.lit(0)).alias("verifier")))
    return rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {P} select row_id, votes[1] as small, votes[2] as large from preds where votes[1] is not null and votes[2] is not null")
def answer_pairs(spark, sf):
    answers = predictions(spark, sf).select("row_id", F.inline(F.arrays_zip(F.array(F.lit("s"), F.lit("l"), F.lit("x")).alias("model"), F.col("votes").alias("answer"))))
    return judging.paired_answers(answers.toDF("row_id", "model", "answer"), "s", "l")


@query()
def separability(spark, sf):
    """Two halves of the embeddings by label, told apart by a probe; an iterative fit that SQL can't express."""
    rows = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id")
    return rounded(probe.separability(rows.where("label < 5"), rows.where("label >= 5")), 3)


@query()
def probe_accuracy(spark, sf):
    rows = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id")
    return rounded(probe.cross_validated(rows), 3)


@query("with " + ", ".join(preds_sql(r, x, f"m{k}") for k, (r, x) in MEMBERS.items()) + """, a as (select avg((truth = pred)::int) as s from ma union all select avg((truth = pred)::int) from mb union all select avg((truth = pred)::int) from mc)
select 'priority' as config, 3::BIGINT as n, round(max(s) - min(s), 6) as spread, round(list_sort(list(s))[2], 6) as median, round((max(s) - min(s)) / 1.693, 6) as sigma from a""")
def seed_summary(spark, sf):
    scores = None
    for rate, seed in MEMBERS.values():
        one = predictions(spark, sf, rate, seed).agg(F.lit("priority").alias("config"), F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("score"))
        scores = one if scores is None else scores.unionByName(one)
    return rounded(metrics.seed_summary(scores))


RUNTIME_SLO = {"coverage": 0.85, "p95_ms": 400.0}
CHECKED = ["baseline_lift", "confidence_ordering", "calibration", "traffic_alignment", "holdout_integrity", "matched_operating_point", "runtime_slo", "seed_stability", "judge_integrity"]
CONTROL_SQL = f"""select 'baseline_lift' as control, case when minority_share < 0.06 or lift_over_chance < 0.02 then 'FAIL' when lift_over_chance < 0.04 then 'WARN' else 'PASS' end as status from ({ORACLE_SQL["metric_contract"]})
union all select 'confidence_ordering', case when max(fall) > 0.005 then 'FAIL' else 'PASS' end from ({ORACLE_SQL["ordering_audit"]})
union all select 'calibration', case when ece > 0.10 then 'WARN' else 'PASS' end from ({ORACLE_SQL["calibration"]})
union all select 'traffic_alignment', 'WARN'
union all select 'holdout_integrity', case when gap > 0.01 then 'FAIL' when gap > 0.005 then 'WARN' else 'PASS' end from (select "threshold/fitted" - "threshold/heldout" as gap from ({ORACLE_SQL["threshold_transfer"]}))
union all select 'matched_operating_point', case when cells_won > cells / 2 then 'PASS' else 'FAIL' end from ({ORACLE_SQL["cells_won"]})
union all select 'runtime_slo', case when coverage < {RUNTIME_SLO["coverage"]} or resource_exhausted_rate > 0.001 or p95_ms / {RUNTIME_SLO["p95_ms"]} > 1 then 'FAIL' when p95_ms / {RUNTIME_SLO["p95_ms"]} > 0.8 then 'WARN' else 'PASS' end from ({ORACLE_SQL["runtime_summary"]})
union all select 'seed_stability', case when spread > 3 * 0.004 then 'FAIL' when spread > 0.004 then 'WARN' else 'PASS' end from ({ORACLE_SQL["seed_summary"]})
union all select 'judge_integrity', case when longer_wins > 0.6 then 'FAIL' else 'PASS' end from {LENGTH_SQL}"""
PLANE_SQL = """select plane, case when plane in ('traffic_validity', 'outcome_value') then 'NOT_EVALUATED' when max((status = 'FAIL')::int) = 1 then 'FAIL' when max((status = 'WARN')::int) = 1 then 'WARN' else 'PASS' end as status
from (select unnest(['classifier_quality', 'classifier_quality', 'classifier_quality', 'decision_quality', 'decision_quality', 'runtime_quality', 'traffic_validity', 'outcome_value']) as plane, unnest(['baseline_lift', 'calibration', 'seed_stability', 'matched_operating_point', 'holdout_integrity', 'runtime_slo', 'traffic_alignment', null]) as control) p
left join ({0}) using (control) group by plane""".replace("{0}", CONTROL_SQL)


def _report(spark, sf) -> policy.Report:
    """The report of one classifier by what is measured of it; a few rows for each metric reach the driver."""
    rows = predictions(spark, sf)
    found = policy.bag(metrics.contract(rows)) | policy.bag(metrics.calibration(rows)) | policy.bag(curves.threshold_transfer(_scores(spark, sf)))
    found |= {f"gate/{r.gate}/{n}": r[n] for r in metrics.gates(rows, PRIORITY).collect() for n in ("containment", "over_block", "released_to_lowest") if r[n] is not None}
    curve = [(r.coverage, r.accuracy) for r in curves.coverage_curve(rows, COVER).collect()]  # a row for each coverage
    against = curves.cells_won(_compared(spark, sf)).first().asDict()
    context = {"metrics": found, "curve": curve, "gates": PRIORITY.gates, "champion_comparison": against, "runtime": policy.bag(metrics.runtime_summary(calls(spark, sf))), "slo": RUNTIME_SLO}
    seeds = [predictions(spark, sf, *m).agg(F.avg((F.col("truth") == F.col("pred")).cast("double"))).first()[0] for m in MEMBERS.values()]
    context |= {"seed_scores": seeds, "noise_floor": 0.004, "judge": {"position_randomised": True, "longer_answer_win_rate": length_bias(spark, sf).first().longer_wins}}
    classifier = {"model_revision": "p", "runtime_revision": "r", "code_revision": "c"}
    return policy.qualify("priority", PRIORITY.name, classifier, [{"id": "orders", "digest": "0"}], context, [], CHECKED)


@query(CONTROL_SQL)
def control_results(spark, sf):
    """Controls over the measured metrics of one classifier; a row for each control."""
    return spark.createDataFrame([(r.control, r.status) for r in _report(spark, sf).controls], "control string, status string")


@query(PLANE_SQL)
def plane_results(spark, sf):
    return spark.createDataFrame([*_report(spark, sf).planes.items()], "plane string, status string")


@query(f"""with c as ({CONTROL_SQL}), v as (select max((status = 'FAIL' and control <> 'calibration')::int) as blocked, max((status = 'WARN')::int) as warned from c)
select case when blocked = 1 then 'REJECTED' when warned = 1 then 'QUALIFIED_WITH_WARNINGS' else 'QUALIFIED' end as verdict, case when blocked = 1 then 'NOT_QUALIFIED' when warned = 1 then 'QUALIFIED_WITH_WARNING' else 'QUALIFIED' end as summary,
case when blocked = 1 then 'REJECT' else 'PROMOTE' end as decision, blocked as exit_code from v""")
def qualification(spark, sf):
    """Verdict, summary, promotion decision and exit code of the same report."""
    report = _report(spark, sf)
    decision, _ = policy.promotion(report, policy.Promotion())
    return spark.createDataFrame([(report.verdict, policy.summary(report.controls)[0], decision, policy.exit_code(decision))], "verdict string, summary string, decision string, exit_code int")


@query("with " + preds_sql(0.25, "p", "ma") + ", " + preds_sql(0.3, "q", "mb") + """, x as (select 'a' as m, truth, pred, t, p from ma union all select 'b', truth, pred, t, p from mb), n as (select m, truth, count(*) as n from x group by 1, 2),
s as (select m, max(n) * 1.0 / sum(n) as majority, min(n) * 1.0 / sum(n) as minority from n group by 1), g as (select m, avg((truth = pred)::int) as accuracy, avg((p >= 2)::int) filter (where t >= 2) as c3, avg((p >= 2)::int) filter (where t < 2) as o3, avg((p = 0)::int) filter (where t >= 2) as r3,
avg((p >= 4)::int) filter (where t >= 4) as c5, avg((p >= 4)::int) filter (where t < 4) as o5, avg((p = 0)::int) filter (where t >= 4) as r5 from x group by 1),
w as (select m, unnest(['accuracy', 'lift_over_chance', 'minority_share', 'gate/3-MEDIUM/containment', 'gate/3-MEDIUM/over_block', 'gate/3-MEDIUM/released_to_lowest', 'gate/5-LOW/containment', 'gate/5-LOW/over_block', 'gate/5-LOW/released_to_lowest']) as metric,
unnest([accuracy, accuracy - majority, minority, c3, o3, r3, c5, o5, r5]) as v from g join s using (m)) select metric, round(sum(case when m = 'b' then v else -v end), 6) as delta, metric = 'lift_over_chance' as is_primary from w group by metric""")
def champion_comparison(spark, sf):
    """What changes from a champion to a candidate, by metric."""

    def measured(rate: float, seed: str) -> policy.Report:
        rows = predictions(spark, sf, rate, seed)
        found = {k: v for k, v in policy.bag(metrics.contract(rows)).items() if not k.startswith("wilson")}
        found |= {f"gate/{r.gate}/{n}": r[n] for r in metrics.gates(rows, PRIORITY).collect() for n in ("containment", "over_block", "released_to_lowest") if r[n] is not None}
        return policy.Report("priority", PRIORITY.name, {}, [], found)

    compared = policy.compare(measured(0.3, "q"), measured(0.25, "p"), policy.Promotion())
    return rounded(spark.createDataFrame([(k, v, k == compared.primary_metric) for k, v in compared.ordered()], "metric string, delta double, is_primary boolean"))


@query()
def training_report(spark, sf):
    """The report of a trained classifier as one JSON document; tests hold its numbers against the metric queries."""
    return sinks.training_report({"gold": predictions(spark, sf), "other": predictions(spark, sf, 0.3, "q")}, PRIORITY.labels, {"tag": "priority"}, calls(spark, sf))


@query()
def k_medoids(spark, sf):
    """Medoids of each label of the embeddings, over all rows; tests hold them against plain matrices."""
    return medoids.medoids(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id"), 5)


@query()
def greedy_anchors(spark, sf):
    """Anchors chosen one by one among one half of the rows, for the accuracy that they give on all rows of the other;
    tests hold it against a plain loop."""
    halves = sampling.split(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id"), 0.5)
    return rounded(medoids.chosen_anchors(halves.where("part = 'train'"), halves.where("part = 'dev'"), 3))


@query()
def compressed_documents(spark, sf):
    """The sizes of all documents when cut to 256 words by ranked sentences; tests hold it against plain matrices."""
    short = compress.compress(table(spark, sf, "documents").select("doc_id", "text"))
    return short.select("doc_id", F.length("text").alias("n_chars"), F.length("short").alias("n_short"))


@query(r"""with p as (select doc_id as row_id, case when n_chars < 500 then 'short' when contains(text, '!!') then 'loud' else 'plain' end as pred from documents) select pred, count(*)::BIGINT as n from p group by 1""")
def adapter_predictions(spark, sf):
    """A rule as a classifier, through the adapter that any model goes through."""
    labels = ["loud", "plain", "short"]
    rule = adapters.FunctionAdapter(labels, lambda t: "short" if len(t) < 500 else "loud" if "!!" in t else "plain")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    answers = adapters.predict(rows, rule)
    return answers.where("status = 'OK'").groupBy(probs.argmax_label(F.col("probs"), labels).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {P}, x as (select ((p0 + p1 >= p2 + p3 + p4) = (t <= 1))::int as ok, (len(list_distinct({VOTES_SQL})) + (len(list_filter(votes, lambda v: v is null)) > 0)::int > 1)::int as split, greatest(p0, p1, p2, p3, p4) as f, greatest(p0 + p1, p2 + p3 + p4) as c from preds),
q as (select quantile_cont(f, {1 - 0.9!r}) as fc, quantile_cont(c, {1 - 0.9!r}) as cc from x) select count(*)::BIGINT as rescued, round(avg(ok), 6) as accuracy, round(avg(split), 6) as contested from x, q where f < fc and c >= cc""")
def rescued_by_fold(spark, sf):
    return rounded(curves.rescued_by_fold(predictions(spark, sf), PRIORITY, "route"))
