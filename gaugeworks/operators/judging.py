"""Judged comparisons, merged models, distilled labels, error overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import probs
from gaugeworks.functions.text import hash_unit


def flipped(key: Column, seed: str = "f") -> Column:
    """A fair coin by hash: does the second answer stand first?"""
    return hash_unit(f"{seed}:", key) < 0.5


def paired_tally(judged: DataFrame) -> DataFrame:
    """Of judged pairs (row_id, verdict A, B or tie, flip): gold, model and neither, and the ceiling 1 - gold / n."""
    first = F.col("verdict") == "A"
    who = F.when(F.col("verdict") == "tie", "neither").when(first == ~F.col("flip"), "gold").otherwise("model")
    rows = judged.select(who.alias("who"))
    share = lambda x: F.sum((F.col("who") == x).cast("long")).alias(x)
    return rows.agg(F.count(F.lit(1)).alias("n"), share("gold"), share("model"), share("neither")).withColumn("ceiling", 1 - F.try_divide("gold", "n"))


def length_bias(judged: DataFrame) -> DataFrame:
    """How often the longer of two answers wins among decided pairs (verdict, flip, words_a, words_b)."""
    decided = judged.where("verdict <> 'tie' and words_a <> words_b")
    a_won = (F.col("verdict") == "A") == ~F.col("flip")
    return decided.agg(F.count(F.lit(1)).alias("decided"), F.avg((a_won == (F.col("words_a") > F.col("words_b"))).cast("double")).alias("longer_wins"), F.median("words_a").alias("median_a"), F.median("words_b").alias("median_b"))


def arbitrated(rows: DataFrame, labels: list[str], pairs: dict[tuple[str, str], str]) -> DataFrame:
    """Where the two best labels are a specialist's pair, the specialist decides: pairs names its column of two
    probabilities, in the pair's order. Adds final and fired."""
    best = F.array_sort(F.transform(probs.top_two(F.col("probs")), lambda i: F.get(F.lit(labels), i)))
    final, fired = F.lit(None).cast("string"), F.lit(False)
    for (a, b), column in pairs.items():
        hit = best == F.array_sort(F.array(F.lit(a), F.lit(b)))
        final = F.when(hit & F.col(column).isNotNull(), F.when(F.get(column, F.lit(0)) >= F.get(column, F.lit(1)), a).otherwise(b)).otherwise(final)
        fired = fired | (hit & F.col(column).isNotNull())
    return rows.withColumn("fired", fired).withColumn("final", F.coalesce(final, probs.argmax_label(F.col("probs"), labels)))


def arbiter_summary(rows: DataFrame) -> DataFrame:
    ok = lambda c: (F.col(c) == F.col("truth")).cast("long")
    return rows.agg(F.sum(F.col("fired").cast("long")).alias("fired"), F.sum((F.col("final") != F.col("pred")).cast("long")).alias("changed"), F.sum(ok("final") - ok("pred")).alias("net_corrected"))


def distilled(members: DataFrame, columns: list[str], labels: list[str], digits: int = 5) -> DataFrame:
    """tier and soft_dist from the mean of the teachers' probabilities."""
    mean = F.col(columns[0])
    for c in columns[1:]:
        mean = F.zip_with(mean, F.col(c), lambda x, y: x + y)
    mean = F.transform(mean, lambda x: x / len(columns))
    return members.withColumn("tier", probs.argmax_label(mean, labels)).withColumn("soft_dist", F.transform(mean, lambda x: F.round(x, digits)))


def error_overlap(members: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, both, either, jaccard) of the errors of each pair of prediction columns, in one pass."""
    wrong = lambda c: F.col(c) != F.col("truth")
    cells = []
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            both, either = F.sum((wrong(a) & wrong(b)).cast("long")), F.sum((wrong(a) | wrong(b)).cast("long"))
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), both.alias("both"), either.alias("either"), F.try_divide(both, either).alias("jaccard")))
    return members.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def all_wrong(members: DataFrame, names: list[str]) -> DataFrame:
    """Rows that every member gets wrong."""
    out = members
    for n in names:
        out = out.where(F.col(n) != F.col("truth"))
    return out


def kept_by_verifier(rows: DataFrame) -> DataFrame:
    """stratum: kept where the verifier repeats the generator's label, else contested."""
    return rows.withColumn("stratum", F.when(F.col("verifier") == F.col("tier"), "kept").otherwise("contested"))


def agreement_by(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, n, agreement) of two labels, over the rows that have both."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def verifier_agreement(rows: DataFrame) -> DataFrame:
    """One row: how many generated rows were verified, and how often the verifier repeats the generator's label."""
    seen = rows.where("verifier is not null")
    return seen.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("verifier") == F.col("tier")).cast("double")).alias("agreement"))


def verifier_disagreements(rows: DataFrame, most: int = 5) -> DataFrame:
    """(tier, verifier, n) of the most frequent disagreements."""
    wrong = rows.where("verifier <> tier").groupBy("tier", "verifier").agg(F.count(F.lit(1)).alias("n"))
    return wrong.orderBy(F.desc("n"), "tier", "verifier").limit(most)


def paired_answers(answers: DataFrame, small: str, large: str, key: str = "row_id") -> DataFrame:
    """(row_id, small, large): both models' answers to each prompt, of rows (row_id, model, answer); prompts that lack
    one go, and of repeated answers the least counts."""
    one = lambda m: answers.where((F.col("model") == m) & F.col("answer").isNotNull()).groupBy(key).agg(F.min("answer").alias("answer"))
    return one(small).withColumnRenamed("answer", "small").join(one(large).withColumnRenamed("answer", "large"), key)


def adjudicated_detail(rows: DataFrame, most: int = 400) -> DataFrame:
    """(text, gold, model, verdict, why) of judged disagreements, texts cut for reading."""
    return rows.select(F.left("text", F.lit(most)).alias("text"), "gold", "model", "verdict", "why")


def hypothesis_labels(scores: DataFrame, labels: list[str], key: str = "row_id") -> DataFrame:
    """(row_id, label, score): the label whose hypothesis entails best, the first in label order of equal ones. scores
    has a row for each text and hypothesis (row_id, label, score); other labels don't count."""
    rank = F.array_position(F.lit(labels), F.col("label"))
    best = scores.where(rank > 0).groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), rank.alias("at"), "label")).alias("b"))
    return best.select(key, F.col("b.label").alias("label"), (-F.col("b.s")).alias("score"))
