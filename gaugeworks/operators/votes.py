"""Jury votes: adjudication, agreement, ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plurality(votes: Column) -> Column:
    """Struct (n, label): the most frequent vote, the first seen of equal ones; NULL votes don't count."""
    cast = F.filter(votes, lambda v: v.isNotNull())
    tally = F.transform(F.array_distinct(cast), lambda v: F.struct((-F.size(F.filter(cast, lambda x: x == v))).alias("n"), F.array_position(cast, v).alias("at"), v.alias("label")))
    best = F.array_min(tally)
    return F.struct((-best.n).alias("n"), best.label.alias("label"))


def unanimous(votes: Column) -> Column:
    return F.coalesce((F.size(votes) > 0) & (F.size(F.array_distinct(votes)) == 1), F.lit(False))


def contested(votes: Column) -> Column:
    """Votes differ; rows without votes count as not contested."""
    return F.coalesce(F.size(F.array_distinct(votes)) > 1, F.lit(False))


def answered(votes: Column) -> Column:
    return F.coalesce((F.size(votes) > 0) & ~F.exists(votes, lambda v: v.isNull()), F.lit(False))


def adjudicate(rows: DataFrame, votes: str = "votes", jurors: int = 3) -> DataFrame:
    """Add stratum (gold, contested, unresolved, unanswered) and tier, the plurality label of the first two."""
    top = plurality(F.col(votes))
    stratum = F.when(~answered(F.col(votes)), "unanswered").when(top.n == jurors, "gold").when(top.n >= 2, "contested").otherwise("unresolved")
    return rows.withColumn("stratum", stratum).withColumn("tier", F.when(F.col("stratum").isin("gold", "contested"), top.label))


def two_labellers(rows: DataFrame, votes: str = "votes") -> DataFrame:
    """Two votes a row: agree, and the first labeller's label as nominal tier."""
    return rows.where((F.size(votes) == 2) & answered(F.col(votes))).withColumn("agree", F.get(votes, F.lit(0)) == F.get(votes, F.lit(1))).withColumn("tier", F.get(votes, F.lit(0)))


def self_consistent(rows: DataFrame, votes: str = "votes") -> DataFrame:
    """The majority of repeated passes; ties are dropped, unstable says that passes differ."""
    top = plurality(F.col(votes))
    ties = F.size(F.filter(F.transform(F.array_distinct(votes), lambda v: F.size(F.filter(votes, lambda x: x == v))), lambda n: n == top.n))
    return rows.where((F.size(votes) > 0) & (ties == 1)).withColumn("tier", top.label).withColumn("unstable", top.n < F.size(votes))


def resolve_ties(rows: DataFrame, third: str, votes: str = "votes") -> DataFrame:
    """Rows whose third vote is among the first ones, with that label; the rest are ill-posed and go."""
    return rows.where(F.array_contains(votes, F.col(third))).withColumn("tier", F.col(third))


def pairwise_agreement(rows: DataFrame, jurors: int, votes: str = "votes") -> DataFrame:
    """(a, b, n, agreement) of each pair of jurors, over the rows that all answered."""
    full = rows.where(answered(F.col(votes)) & (F.size(votes) == jurors))
    pairs = [(a, b) for a in range(jurors) for b in range(a + 1, jurors)]
    equal = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.get(votes, F.lit(a)) == F.get(votes, F.lit(b))).cast("int").alias("same")) for a, b in pairs))
    return full.select(F.inline(equal)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("same").alias("agreement"))


def label_pairs(labels: Column) -> Column:
    """All pairs (low, high) of an array's distinct labels."""
    ordered = F.array_sort(F.array_distinct(F.filter(labels, lambda v: v.isNotNull())))
    return F.flatten(F.transform(ordered, lambda a, i: F.transform(F.slice(ordered, i + 2, F.size(ordered)), lambda b: F.struct(a.alias("low"), b.alias("high")))))


def boundary_shares(rows: DataFrame, votes: str = "votes", tier: str = "truth", least: int = 3) -> DataFrame:
    """(low, high, splits, opportunities, over): how much more often a pair of labels splits a jury than it has occasion
    to. A row with two votes or more splits on each pair of labels among its votes, and gives occasion to each pair
    among its votes and its own tier. Pairs that split `least` rows or more."""
    cast = F.filter(F.col(votes), lambda v: v.isNotNull())
    rows = rows.where(F.size(cast) >= 2).select(label_pairs(cast).alias("split"), label_pairs(F.concat(cast, F.array(tier))).alias("chance"))
    marked = rows.select(F.explode(F.transform("chance", lambda p: F.struct(p.low.alias("low"), p.high.alias("high"), F.array_contains("split", p).cast("int").alias("split"))))).select("col.*")
    pairs = marked.groupBy("low", "high").agg(F.sum("split").alias("splits"), F.count(F.lit(1)).alias("opportunities"))
    whole = pairs.agg(F.sum("splits").alias("all_s"), F.sum("opportunities").alias("all_o"))
    out = pairs.where(F.col("splits") >= least).join(F.broadcast(whole), F.lit(True))
    return out.select("low", "high", "splits", "opportunities", ((F.col("splits") / F.col("all_s")) / (F.col("opportunities") / F.col("all_o"))).alias("over"))


def refined(rows: DataFrame, votes: str = "votes", tier: str = "tier") -> DataFrame:
    """Gold judged anew: rows whose new votes are all there and alike, with that label as tier, the old one as tier_v1,
    and changed; all others go."""
    kept = rows.where(answered(F.col(votes)) & (F.size(F.array_distinct(votes)) == 1))
    out = kept.withColumn("tier_v1", F.col(tier)).withColumn(tier, F.get(votes, F.lit(0))).withColumn("refined", F.lit(True))
    return out.withColumn("changed", ~F.col(tier).eqNullSafe(F.col("tier_v1")))


def self_agreement(rows: DataFrame, passes: str, votes: str = "votes") -> DataFrame:
    """(stratum, n, self_agreement, inter_agreement) of all rows, of those whose jurors agree and of those whose don't:
    how often repeated passes of one labeller agree, and how often jurors do, over rows whose passes all answered."""
    ok = rows.where(answered(F.col(passes)))
    same, jury = (F.size(F.array_distinct(passes)) == 1).cast("double"), unanimous(F.col(votes))
    per = ok.select(same.alias("s"), jury.cast("double").alias("j"), F.explode(F.array(F.lit("all"), F.when(jury, "unanimous").otherwise("contested"))).alias("stratum"))
    return per.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("self_agreement"), F.avg("j").alias("inter_agreement"))


def self_disagreements(rows: DataFrame, passes: str, most: int = 5) -> DataFrame:
    """(labels, n) of the sets of labels between which repeated passes waver, the most frequent first."""
    split = rows.where(answered(F.col(passes)) & (F.size(F.array_distinct(passes)) > 1))
    return split.groupBy(F.array_join(F.array_sort(F.array_distinct(passes)), "/").alias("labels")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "labels").limit(most)


def rubric_agreement(rows: DataFrame, rubrics: dict[str, tuple[str, str]]) -> DataFrame:
    """(rubric, n, agreement) of two labellers under each rubric, which names their columns; rows without both labels
    don't count."""
    cells = F.array(*(F.struct(F.lit(name).alias("rubric"), F.col(a).alias("a"), F.col(b).alias("b")) for name, (a, b) in rubrics.items()))
    both = rows.select(F.inline(cells)).where("a is not null and b is not null")
    return both.groupBy("rubric").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))


def rubric_residuals(rows: DataFrame, rubrics: dict[str, tuple[str, str]], most: int = 4) -> DataFrame:
    """(rubric, pair, n, rank): the pairs of labels that two labellers still disagree in most often under each rubric, in
    either order; equal counts rank by pair."""
    cells = F.array(*(F.struct(F.lit(name).alias("rubric"), F.col(a).alias("a"), F.col(b).alias("b")) for name, (a, b) in rubrics.items()))
    differ = rows.select(F.inline(cells)).where("a <> b")
    counts = differ.groupBy("rubric", F.concat_ws("/", F.least("a", "b"), F.greatest("a", "b")).alias("pair")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("rubric").orderBy(F.desc("n"), "pair")))
    return ranked.where(F.col("rank") <= most)


def gold_agreement(a: DataFrame, b: DataFrame, key: str = "row_id", tier: str = "tier") -> DataFrame:
    """One row: on how many rows two sets of gold labels both have one, and how often it is the same."""
    both = a.select(key, F.col(tier).alias("a")).join(b.select(key, F.col(tier).alias("b")), key).where("a is not null and b is not null")
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))
