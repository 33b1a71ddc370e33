"""Frames that the catalogue's queries share, derived from the given tables by rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.text import hash_unit
from gaugeworks.operators.folds import Taxonomy

PRIORITY = Taxonomy(
    "priority",
    ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    ordered=True,
    gates=["3-MEDIUM", "5-LOW"],
    folds={"route": {"1-URGENT": "FAST", "2-HIGH": "FAST", "3-MEDIUM": "SLOW", "4-NOT SPECIFIED": "SLOW", "5-LOW": "SLOW"}},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _near(t: Column, u: Column, rate: float) -> Column:
    """The neighbour below or above in half of the rate each, within the taxonomy."""
    step = F.when(u < rate / 2, -1).when(u < rate, 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(4), t + step))


def predictions(spark: SparkSession, sf_dir: str, rate: float = 0.25, seed: str = "p") -> DataFrame:
    """row_id, truth, pred, conf, probs, votes: orders' priorities with predictions and votes that err by hash."""
    labels = F.lit(PRIORITY.labels)
    key = F.col("o_orderkey")
    t = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    rows = table(spark, sf_dir, "orders").select(key.alias("row_id"), t.alias("t"), _near(t, hash_unit(f"{seed}:", key), rate).alias("p"), hash_unit("c:", key).alias("v"), *(hash_unit(f"j{j}:", key).alias(f"w{j}") for j in (1, 2, 3)))
    conf = F.lit(0.35) + F.lit(0.6) * F.col("v") * F.when(F.col("t") == F.col("p"), 1.0).otherwise(0.6)
    rows = rows.withColumn("conf", conf)
    probs = F.array(*(F.when(F.col("p") == k, F.col("conf")).otherwise((1 - F.col("conf")) / 4) for k in range(5)))
    vote = lambda j: F.when(F.col(f"w{j}") <= 0.98, F.get(labels, _near(F.col("t"), F.col(f"w{j}"), 0.2)))
    return rows.select("row_id", F.get(labels, F.col("t")).alias("truth"), F.get(labels, F.col("p")).alias("pred"), "conf", probs.alias("probs"), F.array(vote(1), vote(2), vote(3)).alias("votes"))


def u(x: str) -> str:
    """hash_unit in DuckDB."""
    return f"(('0x' || substr(md5({x}), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def preds_sql(rate: float = 0.25, seed: str = "p", name: str = "preds") -> str:
    """Common table expressions that end in `name`, with p0 to p4 for probs and t, p for the ranks."""
    near = lambda w, r: f"greatest(0, least(4, t + case when {w} < {r / 2} then -1 when {w} < {r} then 1 else 0 end))"
    label = lambda k: f"(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[{k} + 1]"
    votes = ", ".join(f"case when w{j} <= 0.98 then {label(near(f'w{j}', 0.2))} end" for j in (1, 2, 3))
    return f"""{name}_a as (select o_orderkey as row_id, cast(substr(o_orderpriority, 1, 1) as int) - 1 as t, {u(f"'{seed}:' || o_orderkey")} as u, {u("'c:' || o_orderkey")} as v,
 {u("'j1:' || o_orderkey")} as w1, {u("'j2:' || o_orderkey")} as w2, {u("'j3:' || o_orderkey")} as w3 from orders),
{name}_b as (select *, {near('u', rate)} as p from {name}_a),
{name}_c as (select *, 0.35::DOUBLE + 0.6::DOUBLE * v * (case when t = p then 1.0 else 0.6 end)::DOUBLE as conf from {name}_b),
{name} as (select row_id, t, p, {label('t')} as truth, {label('p')} as pred, conf, [{votes}] as votes,
 {", ".join(f"case when p = {k} then conf else (1 - conf) / 4 end as p{k}" for k in range(5))} from {name}_c)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, ts, status, pred, latency_ms, conf: events as calls of a live classifier."""
    w = hash_unit("st:", F.col("event_id"))
    status = F.when(w < 0.9, "OK").when(w < 0.95, "ABSTAIN").when(w < 0.98, "RESOURCE_EXHAUSTED").otherwise("UNAVAILABLE")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), "ts", status.alias("status"), F.col("event_type").alias("pred"), F.col("value").alias("latency_ms"), hash_unit("cf:", F.col("event_id")).alias("conf"))


CALLS_SQL = f"""calls as (select event_id as call_id, ts, case when {u("'st:' || event_id")} < 0.9 then 'OK' when {u("'st:' || event_id")} < 0.95 then 'ABSTAIN'
 when {u("'st:' || event_id")} < 0.98 then 'RESOURCE_EXHAUSTED' else 'UNAVAILABLE' end as status, event_type as pred, value as latency_ms, {u("'cf:' || event_id")} as conf from events)"""
