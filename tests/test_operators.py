"""Operators that SQL can't express, against what they must satisfy."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import adapters, compress, curves, judging, medoids, probe, sampling
from gaugeworks.operators.folds import Taxonomy


def test_adapter_answers_all_but_the_rows_that_fail(spark):
    class Picky(adapters.Adapter):
        labels = ["a", "b"]

        def predict(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError
            return np.array([[len(t) % 2, 1 - len(t) % 2] for t in texts], float)

    df = spark.createDataFrame([(k, "bad" if k in (3, 70) else "x" * k) for k in range(100)] + [(100, None)], "row_id bigint, text string")
    got = {r.row_id: r for r in adapters.predict(df, Picky()).collect()}
    assert len(got) == 101 and [k for k, r in got.items() if r.status == "ERROR"] == [3, 70] and got[3].probs is None and got[5].probs == [1, 0]
    assert adapters.with_answers(df, adapters.predict(df, Picky())).count() == 99
    assert adapters.FunctionAdapter(["a", "b"], lambda _: {}).predict(["x"]).tolist() == [[0.5, 0.5]]
    assert adapters.majority(spark.createDataFrame([("b",), ("a",), ("b",)], "truth string"), ["a", "b"]).predict(["?"]).tolist() == [[0, 1]]


def _scores_by_matrix(sentences):
    """The same four scores by the full matrix of cosines."""
    words = [[w for w in re.findall(r"\b\w\w+\b", s.lower())] for s in sentences]
    vocabulary = sorted({w for ws in words for w in ws})
    count = np.array([[ws.count(w) for w in vocabulary] for ws in words], float)
    x = count * (np.log((1 + len(words)) / (1 + (count > 0).sum(0))) + 1)
    x /= np.where(np.linalg.norm(x, axis=1) > 0, np.linalg.norm(x, axis=1), 1)[:, None]
    cosine = x @ x.T
    graph = cosine - np.diag(np.diag(cosine))
    step = graph / np.where(graph.sum(1) > 1e-12, graph.sum(1), 1)[:, None]
    n, rank = len(words), np.full(len(words), 1 / len(words))
    for _ in range(30):
        rank = 0.15 / n + 0.85 * step.T @ rank
    mean, z = cosine.mean(1), lambda v: (v - v.mean()) / (v.std() or 1.0)
    novelty = 1 - (mean - mean.min()) / (np.ptp(mean) or 1.0)
    return 0.2 * z(rank) + 0.4 * z(0.5 + 2 * (np.arange(n) / (n - 1) - 0.5) ** 2) + 0.35 * z(x.sum(1)) + 0.05 * z(novelty)


@pytest.mark.parametrize("n", [5, 40, 400])
def test_sentences_are_scored_as_by_the_whole_matrix(n):
    r = np.random.default_rng(n)
    sentences = [" ".join(f"w{int(k)}" for k in r.zipf(1.5, r.integers(1, 15)) % 400) if j % 50 else f"alone{j}" for j in range(n)]
    want = _scores_by_matrix(sentences)
    assert np.allclose(compress.sentence_scores(sentences, frozenset()), want, atol=1e-9)
    text, kept, used = "\n".join(sentences), [], 0
    for k in np.argsort(-want, kind="stable"):
        size = len(sentences[k].split())
        if not kept or used + size <= 60:
            kept.append(k)
            used += size
            if used >= 60:
                break
    whole = text if len(text.split()) <= 60 else " ".join(sentences[k] for k in sorted(kept))
    assert compress.shortened(text, 60, compress.words_of, frozenset()) == whole


def test_compression_leaves_short_texts_alone(spark):
    text = "The cat sat on the mat. Dogs bark at night often! Birds sing in the early morning light? Fish swim. The cat likes the mat and the birds."
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (4, "a b. c d"), (5, text), (6, "the. and. of.")], "row_id int, text string")
    got = {r.row_id: r.short for r in compress.compress(df, 12).collect()}
    assert [got[k] for k in (1, 2, 3, 4, 6)] == [None, "", "one two three", "a b. c d", "the. and. of."]
    assert len(got[5].split()) <= 12 and all(s in text for s in got[5].split(". "))
    assert {r.short for r in compress.compress(df, 3, count=lambda _: 1).collect()} == {r.text for r in df.collect()} - {text} | {compress.shortened(text, 3, lambda _: 1, frozenset(("the", "on", "at", "in", "and")))}


def test_medoids_and_greedy_anchors(spark):
    r = np.random.default_rng(0)
    centres = np.eye(4)[:3]
    x = np.concatenate([c + r.normal(0, 0.05, (20, 4)) for c in centres])
    y = np.repeat([0, 1, 2], 20)
    df = spark.createDataFrame([(k, int(y[k]), x[k].tolist()) for k in range(60)], "row_id bigint, label int, embedding array<double>")
    got = {}
    for m in medoids.medoids(df.repartition(5), 2).collect():
        got.setdefault(m.label, []).append(m.row_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for label, ids in got.items():  # each is the row nearest the mean of those that are nearest to it
        own = np.flatnonzero(y == label)
        near = (unit[own] @ unit[ids].T).argmax(1)
        for j, i in enumerate(ids):
            group = own[near == j]
            assert i == group[(unit[group] @ unit[group].mean(0)).argmax()]
    assert sorted(map(len, got.values())) == [2, 2, 2]
    one = medoids.medoids(df.withColumn("label", F.lit("all")), 3).collect()
    assert {m.row_id // 20 for m in one} == {0, 1, 2} and medoids.medoids(df.limit(2).withColumn("label", F.lit("x")), 5).count() == 2


def test_greedy_anchors_equal_a_plain_loop(spark):
    """Every candidate tried at every step by all of its cosines, as plain sorting and counting."""
    r = np.random.default_rng(1)
    names, k, per_label = ["a", "b", "c"], 3, [4, 4, 4]
    x = r.normal(0, 1, (3, 5))[r.choice(3, 150)] + r.normal(0, 1.2, (150, 5))
    y = r.choice(3, 150)
    rows = [(i, names[y[i]], x[i].tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "row_id bigint, label string, embedding array<double>").repartition(5)
    extra = spark.createDataFrame([(900, "not a candidate's", x[3].tolist()), (901, None, x[4].tolist()), (902, "a", None)], df.schema)
    got = medoids.chosen_anchors(df.where("row_id < 40"), df.where("row_id >= 40").unionByName(extra), 4).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = sorted(range(40), key=lambda i: (y[i], hashlib.md5(f"s:{i}".encode()).hexdigest()))
    dev = range(40, 150)

    def right(chosen):
        hits = 0
        for i in dev:
            score = [np.sort([unit[i] @ unit[c] for c in chosen if y[c] == v])[-k:].mean() if any(y[c] == v for c in chosen) else -np.inf for v in range(3)]
            hits += int(np.argmax(score)) == y[i]
        return hits

    chosen = []
    for step in range(12):
        best = (-1, None)
        for c in order:
            if c not in chosen and sum(y[d] == y[c] for d in chosen) < per_label[y[c]] and (h := right([*chosen, c])) > best[0]:
                best = (h, c)
        chosen.append(best[1])
        assert (got[step].step, got[step].row_id, got[step].label) == (step + 1, best[1], names[y[best[1]]])
        assert abs(got[step].accuracy - best[0] / 111) < 1e-12  # the row of another label never counts as right
    assert len(got) == 12
    assert medoids.chosen_anchors(df.where("row_id < 5"), df, 9).count() == 5 and medoids.chosen_anchors(df.where("false"), df, 2).count() == 0
    assert {r.accuracy for r in medoids.chosen_anchors(df.where("row_id < 5"), df.where("false"), 1).collect()} == {None}


def test_specialists_decide_their_pairs(spark):
    df = spark.createDataFrame([([0.5, 0.4, 0.1], [0.2, 0.8], "b", "a"), ([0.5, 0.1, 0.4], [0.2, 0.8], "a", "a"), ([0.4, 0.5, 0.1], None, "b", "b")], "probs array<double>, ab array<double>, truth string, pred string")
    got = judging.arbitrated(df, ["a", "b", "c"], {("a", "b"): "ab"})
    assert [(r.final, r.fired) for r in got.collect()] == [("b", True), ("a", False), ("b", False)]
    s = judging.arbiter_summary(got).first()
    assert (s.fired, s.changed, s.net_corrected) == (1, 1, 1)


def test_judged_pairs(spark):
    df = spark.createDataFrame([("A", False, 10, 5), ("A", True, 10, 5), ("B", True, 3, 9), ("tie", False, 1, 2)], "verdict string, flip boolean, words_a int, words_b int")
    t = judging.paired_tally(df).first()
    assert (t.n, t.gold, t.model, t.neither) == (4, 2, 1, 1) and t.ceiling == 0.5
    b = judging.length_bias(df).first()
    assert b.decided == 3 and b.longer_wins == pytest.approx(1 / 3)


def test_bias_curve_equals_the_plain_grid(spark):
    task = Taxonomy("t", ["a", "b", "c"], ordered=True, gates=["b"])
    r = np.random.default_rng(3)
    p = r.dirichlet(np.ones(3), 200)
    truth = r.integers(0, 3, 200)
    df = spark.createDataFrame([(task.labels[t], q.tolist()) for t, q in zip(truth, p, strict=True)], "truth string, probs array<double>")
    got = {round(c.bias, 6): (c.containment, c.over_block) for c in curves.bias_sweep(df, task, "b", -1.0, 1.0, 0.1).collect()}
    assert len(got) == 21
    for k in range(21):
        b = -1.0 + k * 0.1
        logits = np.log(np.clip(p, 1e-9, 1)) + np.array([0, b, b])
        blocked = logits.argmax(1) >= 1
        assert got[round(b, 6)] == pytest.approx((blocked[truth >= 1].mean(), blocked[truth < 1].mean()))
    assert curves.matched_over_block(curves.bias_sweep(df.where("truth = 'a'"), task, "b"), (0.9,)).first().over_block is None


def test_selection_caps(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.when(F.col("id") < 90, "a").otherwise("b").alias("pred"), (F.col("id") / 100).alias("margin"))
    assert sampling.most_uncertain(df, 1, 2).count() == 1  # a budget below the number of labels
    assert {r.chosen: r.n for r in sampling.most_uncertain(df, 10, 2, 0.3).groupBy("chosen").agg(F.count("*").alias("n")).collect()} == {"uncertain": 6, "random": 3}
    got = sampling.most_uncertain(df, 20, 2)
    assert got.groupBy("pred").count().orderBy("pred").collect()[0]["count"] == 10
    jobs = sampling.planned_jobs(spark, 6, ["x", "y"], ["s", "t", "u", "v"]).collect()
    assert [(j.role, j.setting) for j in jobs] == [("x", "s"), ("y", "v"), ("x", "u"), ("y", "t"), ("x", "s"), ("y", "v")]
    parts = sampling.split(df, 0.9).groupBy("part").count().collect()
    assert sum(p["count"] for p in parts) == 100


def test_offsets_undo_a_shift(spark):
    r = np.random.default_rng(4)
    p = r.dirichlet(np.ones(2), 300)
    truth = p[:, 0] * 0.3 > p[:, 1] * 0.7
    df = spark.createDataFrame([("a" if t else "b", q.tolist()) for t, q in zip(truth, p, strict=True)], "truth string, probs array<double>")
    a, b = curves.offset_ascent(df, ["a", "b"], passes=2)
    moved = (np.log(p) + np.array([a, b])).argmax(1) == 0
    assert (moved == truth).mean() > 0.97


def test_quantiles_equal_percentiles(spark, monkeypatch):
    from gaugeworks.operators import quantiles

    df = spark.range(30_000, numPartitions=4).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(5000)) / 7).alias("x"))
    df = df.unionByName(spark.range(20_000).select(F.lit(1).alias("g"), F.lit(42.0).alias("x")))  # most of a group is one value
    shares = [0.0, 0.05, 0.5, 0.99, 1.0]
    want = {(r.g, k): v for r in df.groupBy("g").agg(F.percentile("x", F.lit(shares)).alias("p")).collect() for k, v in enumerate(r.p)}
    for small in (quantiles.SMALL, 1000):  # without and with bounds
        monkeypatch.setattr(quantiles, "SMALL", small)
        assert {(r.g, r.k): r.cut for r in quantiles.quantiles(df, "x", shares, ["g"]).collect()} == want
    assert quantiles.quantiles(df.where("g > 5"), "x", shares).count() == 0


def test_blocks_of_anchors_score_as_broadcast_ones(spark, monkeypatch):
    from gaugeworks.operators import vectors

    r = np.random.default_rng(1)
    df = spark.createDataFrame([(k, k % 3, r.normal(size=4).tolist()) for k in range(90)], "row_id bigint, label int, embedding array<double>")
    queries, anchors = df.where("row_id >= 40"), df.where("row_id < 40")
    scores = lambda: {(x.row_id, x.label): round(x.score, 9) for x in vectors.anchor_scores(queries, anchors).collect()}
    want = scores()
    monkeypatch.setattr(vectors, "ANCHORS", 10)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    assert scores() == want and len(want) == 150


def test_held_out_cuts_equal_plain_quantiles(spark, monkeypatch):
    """Against numpy on every half, with many equal confidences, few bins and a NULL."""
    import hashlib

    from gaugeworks.operators import metrics

    r = np.random.default_rng(5)
    conf = np.round(r.random(700), 2)
    conf[:150], ok = 0.5, r.integers(0, 2, 700)
    df = spark.createDataFrame([(k, float(c), int(o)) for k, (c, o) in enumerate(zip(conf, ok, strict=True))] + [(999, None, 1)], "row_id bigint, conf double, ok int").repartition(3)
    word = [int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) for k in range(700)]
    coverages = (1.0, 0.95, 0.9, 0.5, 0.3)
    for bins in (1000, 7):
        monkeypatch.setattr(metrics, "BINS", bins)
        got = {(c.rep, c.half, c.k): c for c in metrics.heldout_cuts(df, coverages, 3).collect()}
        assert len(got) == 3 * 2 * 5
        for (rep, half, k), c in got.items():
            side = np.array([w >> rep & 1 for w in word])
            cut = np.quantile(conf[side == half], 1 - coverages[k])
            assert c.cut == pytest.approx(cut)
            kept = conf[side != half] >= c.cut
            assert (c.n, c.ok, c.n_kept, c.ok_kept) == ((side != half).sum(), ok[side != half].sum(), kept.sum(), ok[side != half][kept].sum())
    assert metrics.heldout_cuts(df.limit(0), coverages, 3).count() == 0
    assert metrics.half_sums(df.select(F.lit(1).alias("one"), metrics.half_word().alias("word")), [], ["one"], 100).count() == 200


def test_offset_ascent_equals_trying_all(spark):
    r = np.random.default_rng(6)
    p = r.dirichlet(np.ones(3), 120)
    truth = ((p * [0.2, 1, 3]).argmax(1) + (r.random(120) < 0.2)) % 3
    logs, offsets, best, deltas = np.log(np.clip(p, 1e-9, 1)), [0.0] * 3, -1.0, [-2 + 0.4 * k for k in range(11)]
    for _ in range(3):
        before = list(offsets)
        for k in range(3):
            tried = [(((logs + [*offsets[:k], d, *offsets[k + 1 :]]).argmax(1) == truth).mean(), -j) for j, d in enumerate(deltas)]
            top = max(tried)
            if top[0] > best:
                best, offsets[k] = top[0], deltas[-top[1]]
        if offsets == before:
            break
    df = spark.createDataFrame([("abc"[t], q.tolist()) for t, q in zip(truth, p, strict=True)], "truth string, probs array<double>")
    assert curves.offset_ascent(df, ["a", "b", "c"], 3, 2.0, 11) == pytest.approx(offsets)
    report = {x.part: x for x in curves.offset_report(df, df, ["a", "b", "c"], passes=3, steps=11).collect()}
    assert report["dev"].after == report["test"].after == pytest.approx(best)


def test_spans_take_the_highest_label(spark):
    labels = ["low", "mid", "high"]
    rule = adapters.FunctionAdapter(labels, lambda t: "high" if t.startswith("SECRET") else "mid" if "?" in t else "low")
    quote = "SECRET " + "x" * 90
    rows = [(1, f'said "{quote}" twice'), (2, f"a?\n\n{'y' * 100}\n \n{quote}"), (3, f"“{'z' * 85}” and\n\n{quote}"), (4, None), (5, "plain")]
    got = {r.row_id: (r.label, r.n_segments) for r in adapters.span_max(spark.createDataFrame(rows, "row_id int, text string"), rule, labels).collect()}
    assert got == {1: ("high", 2), 2: ("high", 3), 3: ("low", 2), 4: ("low", 1), 5: ("low", 1)}


def test_pairs_hypotheses_and_encoders(spark):
    answers = spark.createDataFrame([(1, "s", "x"), (1, "l", "y"), (2, "s", "x"), (3, "l", "y"), (4, "s", None), (4, "l", "z"), (1, "s", "w")], "row_id int, model string, answer string")
    assert [tuple(r) for r in judging.paired_answers(answers, "s", "l").collect()] == [(1, "w", "y")]
    scores = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "z", 0.9), (2, "b", 0.7)], "row_id int, label string, score double")
    assert {tuple(r) for r in judging.hypothesis_labels(scores, ["b", "a"]).collect()} == {(1, "b", 0.5), (2, "b", 0.7)}
    detail = judging.adjudicated_detail(spark.createDataFrame([("t" * 500, "a", "b", "gold", "w", 1)], "text string, gold string, model string, verdict string, why string, more int"))
    assert len(detail.first().text) == 400 and len(detail.columns) == 5
    found = probe.reproduced(spark.createDataFrame([("a", 0.5), ("b", 0.5)], "metric string, value double"), spark.createDataFrame([("a", 0.5004), ("c", 0.1)], "metric string, value double"))
    assert {r.metric: r.same for r in found.collect()} == {"a": True, "b": False, "c": False}
    plan = sampling.grid_plan(spark.range(200).withColumnRenamed("id", "row_id"), "row_id", {"role": ["x", "y"], "tone": ["p", "q", "r"]}, [1, 2])
    assert sampling.breadth(plan.withColumn("pool", F.lit("all")), ["role", "tone"]).first().combinations == 6


def test_string_labels_and_weights(spark):
    from gaugeworks.operators import corpus, vectors

    df = spark.createDataFrame([(k, "ab"[k % 2], [1.0, 0.1 * k] if k % 2 else [0.1 * k, 1.0]) for k in range(8)], "row_id bigint, label string, embedding array<double>")
    assert {r.row_id: r.label for r in vectors.nearest_centroid(df, df).collect()} == {k: "ab"[k % 2] for k in range(8)}
    weights = {r.label: r.weight for r in corpus.class_weights(df, ["a", "b", "c"], 1.0).collect()}
    raw = np.array([2**0.5, 2**0.5 * 1.5, 8**0.5 * 2])
    assert [weights[x] for x in "abc"] == pytest.approx((raw / raw.mean()).tolist())
    assert {r.label: r.ratio for r in corpus.prior_ratios(df, df.where("row_id < 3")).collect()}["a"] == pytest.approx(np.log(4 / 3))
    names = spark.createDataFrame([("t", "x", 1), ("t", "y", 2)], "text string, tier string, at int")
    assert corpus.relabelled(spark.createDataFrame([("t",), ("u",)], "text string"), names).orderBy("text").collect()[0].tier == "y"
