"""Streams cut into any batches, stopped and begun again: buffers, capped samples, ledgers, sketches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import sampling
from gaugeworks.sources import ledger, sinks
from gaugeworks.streaming import buffers, shadow
from gaugeworks.operators.probe import separability

HOUR = 3600
#: Calls of each hour: uneven, one hour that hardly has any, and one far later that closes the others.
HOURS = (400, 3, 150, 40, 0, 260)


@pytest.fixture(scope="module")
def calls(spark):
    r = random.Random(4)
    rows = [(k, 1_699_999_200 + h * HOUR + r.random() * (HOUR - 1)) for h, n in enumerate(HOURS) for k in range(h * 1000, h * 1000 + n)]
    df = spark.createDataFrame([*rows, (99_999, 1_699_999_200.0 + 40 * HOUR)], "call_id bigint, at double")
    return df.select("call_id", F.timestamp_seconds("at").alias("ts"), F.when(F.col("call_id") % 11 != 0, F.array(F.sin(F.col("call_id") * 1.0), F.lit(1.0))).alias("embedding"), (F.col("call_id") % 100 / 100).alias("conf"), (F.abs(F.sin(F.col("call_id") * 2.0)) * 90).alias("latency_ms"))


def written(spark, calls, folder, cuts):
    """The calls in time order, a file for each cut, as a source to which more files may be added."""
    edges = [0, *cuts, 10**9]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        part = calls.where((F.col("call_id") >= a) & (F.col("call_id") < b)).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/in")
        yield k
    return


def stream_of(spark, calls, folder):
    return spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def first_by_hand(rows, most):
    by_hour = {}
    for r in rows:
        by_hour.setdefault(int((r.ts.timestamp() - 1_699_999_200) // HOUR), []).append(r)
    return {r.call_id for h, own in by_hour.items() if h < 40 for r in sorted(own, key=lambda r: (r.ts, r.call_id))[:most]}


@pytest.mark.parametrize("cuts", [[], [100, 1001, 2075]])
def test_a_capped_sample_is_exact_however_the_stream_is_cut(spark, calls, tmp_path, cuts):
    """Begun again after each file: the state and the ledger carry on."""
    for _ in written(spark, calls, tmp_path, cuts):
        shadow.retain_to_ledger(stream_of(spark, calls, tmp_path), f"{tmp_path}/out", f"{tmp_path}/ck", 30, 0.9, late="2 hours").awaitTermination()
    got = ledger.committed(spark, f"{tmp_path}/out", "retained").collect()
    kept = sampling.retained(calls, 0.9, "call_id").collect()
    want = first_by_hand(kept, 30)
    assert {r.call_id for r in got} == want and len(got) == len(want)
    per = [len([i for i in want if i // 1000 == h]) for h in range(6)]
    assert per[0] == per[2] == per[3] == per[5] == 30 and per[4] == 0 and 0 < per[1] <= 3


def test_small_and_odd_caps(spark, calls, tmp_path):
    most = 3
    for _ in written(spark, calls, tmp_path, [50, 390, 2100]):
        pass
    shadow.retain_to_ledger(stream_of(spark, calls, tmp_path), f"{tmp_path}/out", f"{tmp_path}/ck", most, 1.0, late="2 hours").awaitTermination()
    assert {r.call_id for r in ledger.committed(spark, f"{tmp_path}/out").collect()} == first_by_hand(calls.collect(), most)


def test_drift_of_the_first_embeddings_of_each_window(spark, calls, tmp_path):
    reference = spark.range(60).select(F.col("id").alias("row_id"), F.array(F.lit(-1.0) - F.col("id") / 1000, F.lit(-2.0)).alias("embedding"))
    calls = calls.where("call_id < 2000 or call_id > 90000")
    for _ in written(spark, calls, tmp_path, [220]):
        shadow.stream_drift(stream_of(spark, calls, tmp_path), reference, f"{tmp_path}/out", f"{tmp_path}/ck", 50, 2, late="2 hours").awaitTermination()
    got = {int((r.hour.timestamp() - 1_699_999_200) // HOUR): r for r in ledger.committed(spark, f"{tmp_path}/out", "drift").collect()}
    assert {h: r.n for h, r in got.items()} == {0: 50, 1: 2} and got[0].traffic == "OFF_DISTRIBUTION"
    rows = calls.where("embedding is not null").collect()
    first = [r for r in rows if r.call_id in first_by_hand(rows, 50) and r.call_id < 1000]
    live = spark.createDataFrame([(r.call_id, r.embedding) for r in first], "row_id bigint, embedding array<double>")
    assert abs(got[0].separability - separability(live, reference, 2).first().separability) < 1e-12


def test_state_goes_when_a_window_is_over(spark, calls, tmp_path):
    for _ in written(spark, calls, tmp_path, []):
        buffers_stream = buffers.first_of_windows(stream_of(spark, calls, tmp_path), 20)
        query = ledger.stream_to_ledger(buffers_stream, f"{tmp_path}/out", f"{tmp_path}/ck", "x")
        query.awaitTermination()
    left = spark.read.format("statestore").option("stateVarName", "rows").load(f"{tmp_path}/ck")
    assert {r.key["_end"] // 1000 for r in left.select("key").collect()} == {1_699_999_200 // HOUR * HOUR + 41 * HOUR}


# ---- ledgers -------------------------------------------------------------------------------------------------


def test_batches_are_appended_once_and_side_by_side(spark, tmp_path):
    path, rows = f"{tmp_path}/l", spark.createDataFrame([(1,), (2,)], "n int")
    assert ledger.append_once(rows, path, "a", "r", "0") and ledger.append_once(rows, path, "b", "r", "0") and ledger.append_once(rows, path, "a", "r2", "0")
    assert not ledger.append_once(rows, path, "a", "r", "0")  # replayed
    rows.withColumns({"experiment": F.lit("a"), "run": F.lit("r"), "batch": F.lit("9"), "attempt": F.lit("killed")}).write.mode("append").parquet(f"{path}/data")
    assert ledger.committed(spark, path).count() == 6 and ledger.committed(spark, path, "b").count() == 2
    odd = "a/b 'c' ü=1"
    assert ledger.append_once(rows.withColumn("attempt", F.lit("own")), path, odd, "", "x") and ledger.committed(spark, path, odd).count() == 2
    assert ledger.append_once(rows.withColumn("more", F.lit(1)), path, "wider", "r")
    assert ledger.committed(spark, path, "wider").first().more == 1 and ledger.committed(spark, path, "a").where("more is null").count() == 4


def test_of_two_attempts_at_once_one_counts(spark, tmp_path, monkeypatch):
    path, rows = f"{tmp_path}/l", spark.createDataFrame([(1,)], "n int")
    monkeypatch.setattr(ledger, "is_committed", lambda *_: False)  # neither sees the other's record before it writes
    assert [ledger.append_once(rows, path, "a", "r"), ledger.append_once(rows, path, "a", "r")] == [True, False]
    assert ledger.committed(spark, path).count() == 1


def test_experiments_replays_and_new_checkpoints_share_a_ledger(spark, calls, tmp_path):
    for _ in written(spark, calls, tmp_path, [1001]):
        for experiment in ("one", "two"):
            sinks.append_shadow(shadow.stream_metrics(stream_of(spark, calls, tmp_path)), f"{tmp_path}/out", f"{tmp_path}/ck-{experiment}", experiment).awaitTermination()
    sinks.append_shadow(shadow.stream_metrics(stream_of(spark, calls, tmp_path)), f"{tmp_path}/out", f"{tmp_path}/ck-new", "one").awaitTermination()
    rows = ledger.committed(spark, f"{tmp_path}/out").where("name = 'shadow/n'").collect()
    want = sorted(float(n) for n in HOURS if n)
    for experiment, runs in (("one", 2), ("two", 1)):
        own = {r.run for r in rows if r.experiment == experiment}
        assert len(own) == runs
        for run in own:
            assert sorted(r.value for r in rows if r.run == run) == want


# ---- sketches ------------------------------------------------------------------------------------------------


def test_sketches_of_windows_merge_into_days_and_sliding_windows(spark, tmp_path):
    r = np.random.default_rng(3)
    sizes = [int(x) for x in r.choice([0, 1, 5, 300, 6000], 60)]
    rows = spark.range(len(sizes)).select(F.col("id").alias("h"), F.get(F.lit(sizes), F.col("id").cast("int")).alias("n")).where("n > 0").select("h", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    calls = rows.select(F.timestamp_seconds(F.lit(1_699_920_000) + F.col("h") * HOUR + F.col("k") % HOUR).alias("ts"), F.pow(F.rand(5), F.lit(3.0)).alias("conf"), F.when(F.col("k") % 3 > 0, -F.log(F.rand(6)) * (1 + F.col("h") % 7)).alias("latency_ms"))
    calls.write.parquet(f"{tmp_path}/in")
    calls = spark.read.parquet(f"{tmp_path}/in")
    shadow.sketches_to_ledger(spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", late="0 seconds").awaitTermination()
    closed = ledger.committed(spark, f"{tmp_path}/out", "sketches")
    batch = shadow.window_sketches(calls)
    last = batch.agg(F.max("hour")).first()[0]
    assert {(x.hour, x.n) for x in closed.collect()} == {(x.hour, x.n) for x in batch.where(F.col("hour") < last).collect()}  # the last window is open
    exact = calls.toPandas()
    for length, slide in (("1 day", None), ("6 hours", "1 hour"), ("1 hour", None)):
        got = shadow.merged_quantiles(batch, length, slide, (0.01, 0.1, 0.5, 0.99)).collect()
        assert got
        for x in got:
            span = {"1 day": 24, "6 hours": 6, "1 hour": 1}[length] * HOUR
            at = x.start.timestamp()
            own = exact[(exact.ts.map(lambda t: t.timestamp()) >= at) & (exact.ts.map(lambda t: t.timestamp()) < at + span)] if len(got) < 40 else None
            if own is None:
                continue
            values = own[x.metric].dropna().to_numpy()
            assert x.n == len(own)
            if not len(values):
                assert x.value is None
                continue
            low, high = (values < x.value).mean(), (values <= x.value).mean()
            assert low - 0.01 <= x.share <= high + 0.01 or len(values) < 100
