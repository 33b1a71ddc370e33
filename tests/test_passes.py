"""What several passes read is worked out once: no pass repeats the hashes of the rows it is given."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import curves, metrics
from gaugeworks.operators.folds import Taxonomy

LABELS = ["a", "b", "c"]
TASK = Taxonomy("t", LABELS, folds={"two": {"a": "X", "b": "X", "c": "Y"}})


def counted(spark, n=3000):
    """Predictions, and an accumulator of the rows whose probabilities were worked out."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    h = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1000)) / 1000
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.get(F.lit(LABELS), F.pmod(F.xxhash64("id"), F.lit(3)).cast("int")).alias("truth"), h(1).alias("p"), h(2).alias("q"), F.array(F.lit("a"), F.get(F.lit(LABELS), F.pmod("id", F.lit(3)).cast("int"))).alias("votes"))
    rows = rows.mapInArrow(run, rows.schema)
    return rows.select("row_id", "truth", "votes", F.array(F.col("p") * F.col("q"), F.col("p") * (1 - F.col("q")), 1 - F.col("p")).alias("probs")), seen


def test_rescued_rows_are_read_once(spark):
    df, seen = counted(spark)
    got = curves.rescued_by_fold(df, TASK, "two").collect()[0]
    assert seen.value == 3000
    rows = df.collect()
    p = np.array([r.probs for r in rows])
    fine, coarse = p.max(1), np.maximum(p[:, 0] + p[:, 1] + 0.0, p[:, 2])
    ok = np.array([(p[k, 0] + p[k, 1] >= p[k, 2]) == (r.truth != "c") for k, r in enumerate(rows)])
    split = np.array([len(set(r.votes)) > 1 for r in rows])
    saved = (fine < np.quantile(fine, 1 - 0.9)) & (coarse >= np.quantile(coarse, 1 - 0.9))
    assert got.rescued == saved.sum() > 0 and got.accuracy == pytest.approx(ok[saved].mean()) and got.contested == pytest.approx(split[saved].mean())


@pytest.mark.parametrize("labels", [LABELS, ["a"]])
def test_offsets_are_those_of_a_plain_ascent_and_rows_are_read_once(spark, labels):
    df, seen = counted(spark, 500)
    if len(labels) == 1:
        df = df.withColumn("probs", F.slice("probs", 1, 1))
    # equal probabilities, missing ones and a truth that isn't known
    odd = spark.createDataFrame([("a", [0.25, 0.25, 0.5]), ("c", [1.0, 0.0, None]), ("b", None), (None, [0.2, 0.3, 0.5]), ("z", [0.0, 0.0, 0.0])], "truth string, probs array<double>")
    got = curves.offset_ascent(df.select("truth", "probs").unionByName(odd), labels, 3, 2.0, 21)
    assert seen.value == 500
    rows = [(r.truth, r.probs) for r in df.collect()] + [tuple(r) for r in odd.collect()]
    deltas, offsets, best = [-2.0 + 4.0 * j / 20 for j in range(21)], [0.0] * len(labels), -1.0
    logs = [(t, None if p is None else np.log(np.clip([1e-9 if x is None else x for x in p[: len(labels)]], 1e-9, 1))) for t, p in rows]

    def accuracy(k, d):
        hit = 0
        for t, x in logs:
            if x is not None:
                y = x + np.array(offsets)
                y[k] = x[k] + 0.0 + d
                hit += labels[int(y.argmax())] == t
            else:  # without probabilities a label wins with no offset, so its own rows are wrong
                hit += 0
        return hit / len(logs)

    for _ in range(3):
        before = list(offsets)
        for k in range(len(labels)):
            hits = [accuracy(k, d) for d in deltas]
            top = max(range(21), key=lambda j: (hits[j], -j))
            if hits[top] > best:
                best, offsets[k] = hits[top], deltas[top]
        if offsets == before:
            break
    assert got == offsets


@pytest.mark.parametrize("edge_rows", [0, 1 << 22])
def test_cuts_in_finer_bins_and_few_rows_looked_at(spark, monkeypatch, edge_rows):
    import hashlib

    r = np.random.default_rng(8)
    conf, ok = np.round(r.random(1500) ** 2, 3), r.integers(0, 2, 1500)
    conf[:200] = 0.25
    df = spark.createDataFrame([(k, float(c), int(o)) for k, (c, o) in enumerate(zip(conf, ok, strict=True))], "row_id bigint, conf double, ok int").repartition(3)
    looked, plain = [], metrics._cuts_at
    monkeypatch.setattr(metrics, "BINS", 20)
    monkeypatch.setattr(metrics, "EDGE_ROWS", edge_rows)
    monkeypatch.setattr(metrics, "_cuts_at", lambda edge, table: looked.append(edge.agg(F.sum("c")).first()[0]) or plain(edge, table))
    got = {(c.rep, c.half, c.k): c for c in metrics.heldout_cuts(df, (1.0, 0.9, 0.62, 0.3), 4).collect()}
    word = [int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) for k in range(1500)]
    assert len(got) == 4 * 2 * 4
    for (rep, half, k), c in got.items():
        side = np.array([w >> rep & 1 for w in word])
        cut, other = np.quantile(conf[side == half], 1 - (1.0, 0.9, 0.62, 0.3)[k]), side != half
        assert c.cut == pytest.approx(cut, abs=1e-12)
        assert (c.n, c.ok, c.n_kept, c.ok_kept) == (other.sum(), ok[other].sum(), (conf[other] >= c.cut).sum(), ok[other][conf[other] >= c.cut].sum())
    if not edge_rows:
        assert looked[0] < 4 * 1500 / 4  # 20 bins have 75 rows each, and 200 rows are equal
