"""Taxonomies, and the coarser label sets they fold into."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_MINORITY = 0.06


@dataclass(frozen=True)
class Taxonomy:
    """An ordered list of labels, gates on it, and named folds that map every label to a group."""

    name: str
    labels: list[str]
    ordered: bool = False
    gates: list[str] = field(default_factory=list)
    folds: dict[str, dict[str, str]] = field(default_factory=dict)
    deployment_fold: str | None = None

    def __post_init__(self):
        if len(set(self.labels)) != len(self.labels) or not self.labels:
            raise ValueError("labels must be distinct, and there must be some")
        if self.gates and not self.ordered:
            raise ValueError("gates need an ordered taxonomy")
        if missing := set(self.gates) - set(self.labels):
            raise ValueError(f"gates {sorted(missing)} are not labels")
        for fold, table in self.folds.items():
            if set(table) != set(self.labels):
                raise ValueError(f"fold {fold} must map each label")
        if self.deployment_fold and self.deployment_fold not in self.folds:
            raise ValueError(f"deployment fold {self.deployment_fold} is not among {sorted(self.folds)}")

    def folded(self, fold: str) -> Taxonomy:
        """The taxonomy of a fold's groups, in lexicographic order; it has no gates."""
        return Taxonomy(f"{self.name}:{fold}", sorted(set(self.folds[fold].values())))

    def rank(self, label: Column) -> Column:
        """From 0; -1 for a label that isn't known."""
        return F.coalesce((F.array_position(F.lit(self.labels), label) - 1).cast("int"), F.lit(-1))

    def group(self, fold: dict[str, str], label: Column) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for pair in fold.items() for x in pair)), label)


def fold_rows(df: DataFrame, task: Taxonomy, fold: dict[str, str], label: str = "truth", votes: str = "votes") -> DataFrame:
    """Labels and votes mapped to groups; rows of unknown label go, unknown votes go, and a row left without votes
    votes for its own group. Soft targets of the finer labels would be stale and are dropped."""
    inside = F.filter(F.transform(F.col(votes), lambda v: task.group(fold, v)), lambda v: v.isNotNull())
    out = df.withColumn(label, task.group(fold, F.col(label))).where(F.col(label).isNotNull()).withColumn(votes, inside)
    return out.withColumn(votes, F.when(F.size(votes) > 0, F.col(votes)).otherwise(F.array(label))).drop("soft_dist")


#: The ladders of labels and the named decisions that they fold into.
LADDERS = {
    "complexity": ["SIMPLE", "MEDIUM", "COMPLEX", "REASONING"],
    "cost": ["MINIMAL", "LOW", "MODERATE", "HIGH"],
    "sensitivity": ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "REGULATED", "NEVER_EGRESS"],
}
#: Each decision's ladder, and its groups in the ladder's order.
DECISIONS = {
    "reasoning": ("complexity", ["NO", "NO", "NO", "YES"]),
    "route": ("complexity", ["SMALL", "SMALL", "LARGE", "LARGE"]),
    "genlen": ("cost", ["SHORT", "SHORT", "LONG", "LONG"]),
    "cx2": ("complexity", ["SIMPLE", "SIMPLE", "REASONING", "REASONING"]),
    "triage": ("complexity", ["TRIVIAL", "WORK", "WORK", "WORK"]),
    "triage3cx": ("complexity", ["TRIVIAL", "STANDARD", "HARD", "HARD"]),
    "oneliner": ("cost", ["ONELINE", "COMPOSED", "COMPOSED", "COMPOSED"]),
    "triage3": ("sensitivity", ["ALLOW", "REVIEW", "REVIEW", "REVIEW", "BLOCK"]),
    "egress": ("sensitivity", ["ALLOW", "ALLOW", "ALLOW", "ALLOW", "BLOCK"]),
}


def decision(name: str) -> tuple[Taxonomy, dict[str, str]]:
    """The taxonomy of a named decision's ladder, and its fold."""
    ladder, groups = DECISIONS[name]
    labels = LADDERS[ladder]
    table = dict(zip(labels, groups, strict=True))
    return Taxonomy(ladder, labels, True, folds={name: table}), table


def threshold_fold(task: Taxonomy, gate: str, low: str = "ALLOW", high: str = "BLOCK") -> dict[str, str]:
    g = task.labels.index(gate)
    return {label: high if k >= g else low for k, label in enumerate(task.labels)}


def threshold_rows(df: DataFrame, task: Taxonomy, gate: str, label: str = "truth", votes: str = "votes", low: str = "ALLOW", high: str = "BLOCK") -> DataFrame:
    """Labels and votes as what the gate does with them. An unknown vote is below every gate; rows of unknown label go,
    and so do soft targets."""
    side = lambda c: F.when(task.rank(c) >= task.labels.index(gate), high).otherwise(low)
    return df.where(task.rank(F.col(label)) >= 0).withColumn(label, side(F.col(label))).withColumn(votes, F.transform(votes, side)).drop("soft_dist")


def merges(task: Taxonomy) -> dict[str, dict[str, str]]:
    """Every way to merge two neighbouring labels, and every gate as a fold."""
    pairs = {f"merge {a}+{b}": {x: f"{a}+{b}" if x in (a, b) else x for x in task.labels} for a, b in zip(task.labels, task.labels[1:], strict=False)}
    return pairs | {f"gate {g}": threshold_fold(task, g) for g in task.labels[1:]}


def fold_scores(preds: DataFrame, task: Taxonomy, tables: dict[str, dict[str, str]]) -> DataFrame:
    """(name, n, agreement, accuracy, majority) of each fold as the deployed decision: do the votes fall in one group, is
    the prediction in the truth's, and how large is the largest group. Unknown votes are ignored, rows of unknown truth
    go. Rows are first counted by truth, prediction and set of votes, so that folds meet a few rows for each."""
    index = lambda c: (F.array_position(F.lit(task.labels), c) - 1).cast("int")
    votes = F.array_sort(F.array_distinct(F.filter(F.transform("votes", index), lambda i: i >= 0)))
    few = preds.where(task.rank(F.col("truth")) >= 0).groupBy(index(F.col("truth")).alias("t"), index(F.col("pred")).alias("p"), votes.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    every = [F.struct(F.lit(name).alias("name"), F.lit([table[x] for x in task.labels]).alias("g")) for name, table in tables.items()]
    per = few.select("*", F.inline(F.array(*every)))
    group = lambda c: F.get("g", c)
    agree = F.size(F.array_distinct(F.transform("v", group))) == 1
    parts = per.groupBy("name", group(F.col("t")).alias("own")).agg(F.sum("n").alias("n"), F.sum(F.when(agree, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(group(F.col("t")) == group(F.col("p")), F.col("n")).otherwise(0)).alias("k"))
    n = F.sum("n")
    return parts.groupBy("name").agg(n.alias("n"), (F.sum("a") / n).alias("agreement"), (F.sum("k") / n).alias("accuracy"), (F.max("n") / n).alias("majority"))


def duplicate_folds(spark, tasks: list[Taxonomy]) -> DataFrame:
    """(digest, folds) of folds that map the same labels to the same groups, under several names."""
    rows = [(t.name, f, list(t.labels), [table[x] for x in t.labels]) for t in tasks for f, table in t.folds.items()]
    folds = spark.createDataFrame(rows, "task string, fold string, labels array<string>, groups array<string>")
    digest = F.substring(F.sha2(F.to_json(F.struct("labels", "groups")), 256), 1, 16)
    return folds.groupBy(digest.alias("digest")).agg(F.array_sort(F.collect_list(F.concat_ws(":", "task", "fold"))).alias("folds")).where(F.size("folds") > 1)


def contiguous_folds(spark, task: Taxonomy) -> DataFrame:
    """(fold_id, name, n_groups, groups): every way to cut the ordered labels into two or more runs. Bit k of fold_id
    says that a run ends after label k."""
    n = len(task.labels)
    bits = spark.range(1, 1 << (n - 1)).withColumnRenamed("id", "fold_id")
    ends = lambda k: F.shiftright("fold_id", k).bitwiseAND(F.lit(1))
    group = [F.lit(0)]
    for k in range(n - 1):
        group.append(group[-1] + ends(k))
    out = bits.withColumn("groups", F.array(*(g.cast("int") for g in group))).withColumn("n_groups", F.array_max("groups") + 1)
    short = F.lit([x[:4] for x in task.labels])
    run = lambda g: F.array_join(F.filter(F.transform("groups", lambda x, i: F.when(x == g, F.get(short, i))), lambda x: x.isNotNull()), "+")
    return out.withColumn("name", F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_groups") - 1), run), " | "))


def fold_search(rows: DataFrame, task: Taxonomy, label: str = "truth", votes: str = "votes") -> DataFrame:
    """(name, n_groups, agreement, minority, degenerate) of each contiguous fold. A row agrees if its votes fall in one
    group; votes outside the taxonomy are ignored, and a row without others disagrees.

    Rows are first counted by label and set of votes, so that the folds meet a few rows for each such set only."""
    index = lambda c: (F.array_position(F.lit(task.labels), c) - 1).cast("int")
    known = F.array_sort(F.array_distinct(F.filter(F.transform(F.col(votes), index), lambda i: i >= 0)))
    few = rows.where(F.size(votes) > 0).groupBy(index(F.col(label)).alias("t"), known.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    folds = contiguous_folds(rows.sparkSession, task)
    every = [F.struct(*(F.lit(x).alias(n) for x, n in zip(r, folds.columns, strict=True))) for r in folds.collect()]  # 2 ** (labels - 1) - 1
    per = few.withColumn("fold", F.explode(F.array(*every))).select("*", "fold.*")
    agree = F.size(F.array_distinct(F.transform("v", lambda i: F.get(F.col("groups"), i)))) == 1
    shares = per.groupBy("fold_id", "name", "n_groups", F.get("groups", F.col("t")).alias("g")).agg(F.sum("n").alias("n"), F.sum(F.when(agree, F.col("n")).otherwise(0)).alias("a"))
    out = shares.groupBy("name", "n_groups").agg((F.sum("a") / F.sum("n")).alias("agreement"), (F.min(F.when(F.col("g").isNotNull(), F.col("n"))) / F.sum("n")).alias("minority"))
    return out.withColumn("degenerate", F.col("minority") < LEAST_MINORITY)


def best_folds(found: DataFrame, most: int = 10) -> DataFrame:
    """The first of fold_search by agreement, minority, groups and name, each descending."""
    return found.orderBy(F.desc("agreement"), F.desc("minority"), F.desc("n_groups"), F.desc("name")).limit(most)
