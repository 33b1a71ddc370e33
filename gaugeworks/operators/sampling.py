"""Resampling and selection; hash order takes the place of a seeded shuffle, so any engine repeats it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.text import hash_order, hash_unit


def _rank(by: str | list[str], *order) -> Column:
    return F.row_number().over(Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order))


#: Hexadecimal digits of a hash that rows are counted by: 16 ** 4 counts a group.
PREFIX = 4


def within_quota(rows: DataFrame, by: list[str], order: Column, key: str, quotas: DataFrame) -> DataFrame:
    """rows with in_quota: is the row among its group's first `quota` by the hash `order` (hexadecimal), then by key?

    quotas (by, quota) has a row for each of a few groups. Rows are counted by group and prefix of the hash; all but
    those of the one prefix where a group's quota ends are decided by that alone, so no group is sorted in one task."""
    marked = rows.withColumn("_h", order).withColumn("_b", F.substring("_h", 1, PREFIX))
    counts = marked.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    so_far = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b"))).join(F.broadcast(quotas), by)
    ends = so_far.where((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
    ends = ends.select(*by, F.col("_b").alias("_cut"), (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_left"))
    joined = marked.join(F.broadcast(quotas.join(ends, by, "left")), by)
    sure = F.when(F.col("quota") <= 0, False).when(F.col("_cut").isNull() | (F.col("_b") < F.col("_cut")), True).when(F.col("_b") > F.col("_cut"), False)
    decided = joined.where(sure.isNotNull()).withColumn("in_quota", sure)
    edge = joined.where(sure.isNull()).withColumn("in_quota", _rank(by, "_h", key) <= F.col("_left"))
    return decided.unionByName(edge).select(*rows.columns, "in_quota")


def hash_rank(rows: DataFrame, by: list[str], key: str, seed: str) -> DataFrame:
    """rows with `rank`: each row's place, from 0, among its group's rows in the order of a hash and then of the key. Rows are
    counted by group and prefix of the hash; a place is that of the prefix and that among the rows of the prefix, so no
    group is sorted in one task."""
    marked = rows.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    counts = marked.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).drop("_n")
    ranked = marked.withColumn("_rn", _rank([*by, "_b"], "_h", key))
    return ranked.join(before, [*by, "_b"]).withColumn("rank", F.col("_before") + F.col("_rn") - 1).select(*rows.columns, "rank")


def stratified(rows: DataFrame, stratum: str, n: int, key: str = "row_id", seed: str = "s") -> DataFrame:
    """At most n rows of each stratum, without replacement. A bounded heap for each task precedes the shuffle: Spark
    limits ranked windows before the exchange."""
    return rows.withColumn("_rn", _rank(stratum, hash_order(seed, ":", F.col(key)), key)).where(F.col("_rn") <= n).drop("_rn")


def split(rows: DataFrame, share: float, key: str = "row_id", seed: str = "s") -> DataFrame:
    """part: train for a share of the rows, dev for the rest, by each row's own hash and without a shuffle."""
    return rows.withColumn("part", F.when(hash_unit(seed, ":", F.col(key)) < share, "train").otherwise("dev"))


def balanced(rows: DataFrame, label: str, key: str = "row_id", seed: str = "b") -> DataFrame:
    """Every label to the upper median of the counts: larger ones sampled, smaller ones repeated by hash-chosen rows.
    `copy` numbers the copies of a row."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    target = counts.agg(F.sort_array(F.collect_list("n")).alias("all")).select(F.get("all", F.floor(F.size("all") / 2).cast("int")).alias("target"))
    # of n rows below the target, the first target % n are used once more than the others
    sizes = counts.join(F.broadcast(target), F.lit(True))
    quotas = sizes.select(label, F.when(F.col("n") >= F.col("target"), F.col("target")).otherwise(F.col("target") % F.col("n")).alias("quota"))
    marked = within_quota(rows, [label], hash_order(seed, ":", F.col(key)), key, quotas).join(F.broadcast(sizes), label)
    copies = F.when(F.col("n") >= F.col("target"), 0).otherwise(F.floor(F.col("target") / F.col("n"))) + F.col("in_quota").cast("int")
    return marked.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1))).select(*rows.columns, "copy")


def to_prior(rows: DataFrame, prior: DataFrame, label: str, root: bool = False, key: str = "row_id", seed: str = "p") -> DataFrame:
    """As many rows as have the class mix of prior (label, share); root takes the geometric mean of both mixes."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).join(prior.withColumnRenamed("share", "want"), label)
    whole = Window.partitionBy()  # one row for each label
    share = F.sqrt(F.col("want") * F.col("n") / F.sum("n").over(whole)) if root else F.col("want")
    counts = counts.withColumn("w", share).withColumn("w", F.col("w") / F.sum("w").over(whole))
    counts = counts.withColumn("total", F.min(F.when(F.col("w") > 0, F.col("n") / F.col("w"))).over(whole)).select(label, F.floor(F.col("total") * F.col("w") + 1e-9).alias("quota"))
    return within_quota(rows, [label], hash_order(seed, ":", F.col(key)), key, counts).where("in_quota").drop("in_quota")


def _capped(rows: DataFrame, budget: int, labels: int, order: list, pred: str) -> DataFrame:
    """The first rows of each predicted label, the same number of each and one at least; of those the first `budget`."""
    capped = rows.withColumn("_rn", _rank(pred, *order)).where(F.col("_rn") <= max(1, budget // labels)).drop("_rn")
    return capped.orderBy(*order).limit(budget)


def most_uncertain(rows: DataFrame, budget: int, labels: int, random_share: float = 0.0, pred: str = "pred", key: str = "row_id", seed: str = "u") -> DataFrame:
    """The rows of least margin, at most an equal part of each predicted label, and a share of the budget at random
    among the rest. `chosen` says which."""
    n_random = int(budget * random_share)
    found = _capped(rows, budget - n_random, labels, [F.col("margin"), F.col(key)], pred).withColumn("chosen", F.lit("uncertain"))
    if not n_random:
        return found
    rest = rows.join(F.broadcast(found.select(key)), key, "left_anti")  # budget rows at most
    return found.unionByName(rest.orderBy(hash_order(seed, ":", F.col(key)), key).limit(n_random).withColumn("chosen", F.lit("random")))


def disagreements(rows: DataFrame, least_margin: float, budget: int, labels: int, screen: str = "screen", key: str = "row_id") -> DataFrame:
    """Confident rows whose screen label differs from the prediction, the most confident first, capped by label."""
    found = rows.where((F.col("margin") >= least_margin) & (F.col("pred") != F.col(screen)))
    return _capped(found, budget, labels, [F.desc("margin"), F.col(key)], "pred")


def slice_after(rows: DataFrame, first: int, last: int, key: str = "row_id", seed: str = "x") -> DataFrame:
    """Rows first to last - 1 of a shuffle by hash: what one set takes, the set of the next slice doesn't."""
    quotas = lambda n: rows.sparkSession.createDataFrame([(0, n)], "_all int, quota bigint")
    order = hash_order(seed, ":", F.col(key))
    upto = within_quota(rows.withColumn("_all", F.lit(0)), ["_all"], order, key, quotas(last)).where("in_quota").drop("in_quota")
    return within_quota(upto, ["_all"], order, key, quotas(first)).where(~F.col("in_quota")).drop("in_quota", "_all")


def retained(rows: DataFrame, rate: float, key: str, conf: str = "conf", low: float = 0.6, boost: float = 5.0, most: int | None = None, order: str | None = None) -> DataFrame:
    """A hash sample at the rate, boosted where confidence is low; at most the `most` first rows of it by `order`."""
    kept = rows.where(hash_unit("r:", F.col(key)) < F.least(F.lit(1.0), F.lit(rate) * F.when(F.col(conf) < low, boost).otherwise(1.0)))
    return kept if most is None else kept.orderBy(order or key, key).limit(most)


def planned_jobs(spark, n: int, roles: list[str], settings: list[str], stride: int = 3) -> DataFrame:
    """(job, role, setting): a round-robin plan over roles and settings."""
    at = lambda values, k: F.element_at(F.lit(values), (k % len(values) + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("job"), at(roles, F.col("id")).alias("role"), at(settings, F.col("id") * stride).alias("setting"))


#: How far the domains of a plan's neighbouring jobs are apart.
PAIR_STRIDE, ANTICUE_STRIDE = 11, 13
EXEMPLARS = 6


def _over_pairs(pairs: DataFrame, a: str, b: str, kind: str, domains: list[str], per: int, stride: int) -> DataFrame:
    jobs = pairs.select(a, b).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    start = F.conv(F.substring(F.md5(F.concat_ws("/", a, b)), 1, 8), 16, 10).cast("bigint")
    domain = F.get(F.lit(domains), F.pmod(F.col("i") * stride + start, F.lit(len(domains))).cast("int"))
    return jobs.select(F.concat_ws("/", F.lit(kind), a, b, "i").alias("job"), F.lit(kind).alias("kind"), a, b, domain.alias("domain"))


def boundary_plan(boundaries: DataFrame, domains: list[str], per: int = 9) -> DataFrame:
    """(job, kind, a, b, domain): `per` jobs for each boundary (a, b) between two labels, over the domains by a stride that
    begins where a hash of the pair says; the same plan each time."""
    return _over_pairs(boundaries, "a", "b", "pairs", domains, per, PAIR_STRIDE)


def anticue_plan(confusable: DataFrame, domains: list[str], per: int = 7) -> DataFrame:
    """(job, kind, label, decoy, domain): jobs for texts of a label that look like its decoy."""
    return _over_pairs(confusable, "label", "decoy", "anticue", domains, per, ANTICUE_STRIDE)


def exemplar_plan(labels: DataFrame, pool: DataFrame, key: str, per: int = 14, exemplars: int = EXEMPLARS, seed: str = "e:") -> DataFrame:
    """(job, label, slot, key): `per` jobs for each label, each with so many different exemplars of the pool. Jobs take the
    pool in the order of a keyed hash, one after the other and round again: each exemplar serves as often as any other, or
    once more. Exemplars and jobs meet by their places; a pool of fewer rows serves whole in each job."""
    order = hash_rank(pool.select(key).dropDuplicates().withColumn("_all", F.lit(0)), ["_all"], key, seed).select(key, "rank")
    size = pool.select(F.countDistinct(key).alias("size"))
    ranked = labels.select("label").distinct()
    first = F.row_number().over(Window.partitionBy().orderBy("label")) - 1  # labels are few
    jobs = ranked.withColumn("_l", first).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    slots = jobs.join(F.broadcast(size), F.lit(True)).where("size > 0").withColumn("slot", F.explode(F.sequence(F.lit(0), F.least(F.lit(exemplars), F.col("size")).cast("int") - 1)))
    taken = F.least(F.lit(exemplars), F.col("size"))
    at = slots.withColumn("rank", F.pmod((F.col("_l") * per + F.col("i")) * taken + F.col("slot"), F.col("size")))
    return at.join(order, "rank").select(F.concat_ws("/", F.lit("real"), "label", "i").alias("job"), "label", "slot", key)


def breadth(jobs: DataFrame, settings: list[str]) -> DataFrame:
    """(pool, jobs, combinations): how many different combinations of settings the jobs of each pool have."""
    return jobs.groupBy("pool").agg(F.count(F.lit(1)).alias("jobs"), F.countDistinct(*settings).alias("combinations"))


def grid_plan(rows: DataFrame, key: str, dimensions: dict[str, list[str]], strides: list[int], seed: str = "g") -> DataFrame:
    """rows with a value of each dimension by their place in a hash order, each dimension at its own stride, so that
    values meet in many combinations; the same plan each time."""
    out, h = rows, F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 31))
    for (name, values), stride in zip(dimensions.items(), strides, strict=True):
        out = out.withColumn(name, F.element_at(F.lit(values), (F.pmod(F.floor(h / stride), F.lit(len(values))) + 1).cast("int")))
    return out
