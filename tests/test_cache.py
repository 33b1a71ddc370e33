"""A cache that fills its misses: each key asked for once, whatever is damaged or killed."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import adapters, metrics
from gaugeworks.sources import cache


def asked(folder):
    return sorted(x for f in os.listdir(folder) for x in open(f"{folder}/{f}").read().split())


def asking(folder, fails=()):
    """Notes what it is asked for, a file for each worker, and answers the key's length."""

    def ask(pdf):
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.writelines(f"{k}\n" for k in pdf.key)
        if set(pdf.key) & set(fails):
            time.sleep(2)  # the other tasks are done
            raise RuntimeError("killed")
        return pdf.assign(answer=[len(k) for k in pdf.key])

    return ask


@pytest.fixture
def notes(tmp_path):
    (tmp_path / "asked").mkdir()
    return str(tmp_path / "asked")


def test_a_second_run_asks_nothing(spark, tmp_path, notes):
    c = cache.Cache(spark, f"{tmp_path}/c", "key string", "answer int")
    wanted = spark.createDataFrame([("a", 1), ("bb", 2), ("a", 3), (None, 4)], "key string, n int")
    got = {(r.key, r.n): r.answer for r in c.answered(wanted, asking(notes)).collect()}
    assert got == {("a", 1): 1, ("a", 3): 1, ("bb", 2): 2, (None, 4): None} and asked(notes) == ["a", "bb"]
    c.answered(wanted.union(spark.createDataFrame([("ccc", 5)], wanted.schema)), asking(notes)).collect()
    c.answered(wanted, asking(notes)).collect()
    assert asked(notes) == ["a", "bb", "ccc"]


def test_damaged_entries_and_files_are_replaced(spark, tmp_path, notes):
    c = cache.Cache(spark, f"{tmp_path}/c", "key string", "answer int")
    wanted = spark.createDataFrame([(f"k{i}",) for i in range(40)], "key string")
    c.fill(wanted, asking(notes))
    damaged = spark.createDataFrame([("k1", 77, 5), ("new", 1, None)], "key string, answer int, _check bigint").withColumn("_at", F.current_timestamp())
    damaged.write.mode("append").parquet(f"{tmp_path}/c/more")
    assert {r.key: r.answer for r in c.entries().collect()}["k1"] == 2 and c.missing(spark.createDataFrame([("k1",), ("new",)], "key string")).count() == 1
    files = [os.path.join(d, f) for d, _, names in os.walk(f"{tmp_path}/c") for f in names if f.endswith(".parquet") and "more" not in d]
    with open(files[0], "wb") as f:
        f.write(b"PAR1 damaged")
    before = len(asked(notes))
    assert {r.answer for r in c.answered(wanted, asking(notes)).collect()} == {2, 3}
    again = len(asked(notes)) - before
    assert 0 < again <= 40 and c.missing(wanted).count() == 0


def test_a_killed_run_keeps_what_its_tasks_finished(spark, tmp_path, notes, monkeypatch):
    monkeypatch.setattr(cache, "PER_TASK", 5)
    c = cache.Cache(spark, f"{tmp_path}/c", "key string", "answer int")
    wanted = spark.createDataFrame([(f"key{i}",) for i in range(60)], "key string")
    with pytest.raises(Exception, match="killed"):
        c.fill(wanted, asking(notes, fails=["key7"]))
    held = {r.key for r in c.entries().collect()}
    assert len(held) > 10 and "key7" not in held
    before = set(asked(notes))
    c.fill(wanted, asking(notes))
    counts = {k: asked(notes).count(k) for k in before}
    assert all(counts[k] == 1 for k in held) and {r.key for r in c.entries().collect()} == {f"key{i}" for i in range(60)}


def test_compaction_keeps_the_latest_of_each_key(spark, tmp_path, notes):
    c = cache.Cache(spark, f"{tmp_path}/c", "key string", "answer int")
    c.compact()
    for k in range(5):
        c.fill(spark.createDataFrame([(f"k{k}",), (f"x{k}",)], "key string"), asking(notes))
    before = sorted(map(tuple, c.entries().collect()))
    c.compact()
    c.compact()
    files = [f for _, _, names in os.walk(f"{tmp_path}/c") for f in names if f.endswith(".parquet")]
    assert sorted(map(tuple, c.entries().collect())) == before and len(files) <= 4 and c._files().count() == 10


def test_embeddings_and_labels_of_distinct_texts(spark, tmp_path, notes):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb"), (4, None), (5, "bad")], "row_id int, text string")

    def encode(texts):
        with open(f"{notes}/{os.getpid()}", "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    for _ in range(2):
        got = {r.row_id: r.embedding for r in cache.embedded(df, "small", encode, f"{tmp_path}/e").collect()}
        assert got == {1: [1, 1], 2: [1, 1], 3: [2, 1], 4: None, 5: [3, 1]} and asked(notes) == ["a", "bad", "bb"]
    cache.embedded(df, "other", encode, f"{tmp_path}/e").collect()
    assert len(asked(notes)) == 6

    class Model(adapters.Adapter):
        labels = ["x", "y"]

        def predict(self, texts):
            if texts == ["bad"]:
                raise RuntimeError
            return np.array([[0.25, 0.75]] * len(texts))

    got = {r.row_id: r.probs for r in cache.classified(df, "m", Model(), f"{tmp_path}/p").collect()}
    assert got == {1: [0.25, 0.75], 2: [0.25, 0.75], 3: [0.25, 0.75], 4: None, 5: None}


def test_each_request_has_its_own_latency(spark):
    """Two slow texts of 200 show in p99 and not in p50; failures and their retries have no latency."""

    class Slow(adapters.Adapter):
        labels = ["x", "y"]

        def predict(self, texts):
            if "full" in texts:
                raise RuntimeError("429 Resource exhausted: try later")
            if "bad" in texts:
                raise ValueError("no")
            time.sleep(0.15 * sum(t == "slow" for t in texts))
            return np.array([[0.5, 0.5]] * len(texts))

    kinds = {3: "slow", 77: "slow", 120: "slow", 5: "bad", 6: "full"}
    df = spark.createDataFrame([(k, kinds.get(k, "x")) for k in range(200)], "row_id int, text string").coalesce(1)
    answers = adapters.predict(df, Slow())
    got = {r.row_id: r for r in answers.collect()}
    assert all((got[k].latency_ms >= 150) == (k in (3, 77, 120)) for k in got if k not in (5, 6))
    assert (got[5].status, got[5].latency_ms, got[6].status, got[6].latency_ms) == ("ERROR", None, "RESOURCE_EXHAUSTED", None)
    s = metrics.runtime_summary(answers).first()
    assert s.p99_ms >= 150 > 20 > s.p50_ms and s.succeeded == 198 and s.resource_exhausted_rate == 1 / 200
    together = adapters.predict(df, Slow(), batch=32).collect()
    assert {r.latency_ms for r in together} == {None} and {r.row_id: r.status for r in together} == {k: r.status for k, r in got.items()}
