"""Probability vectors as array<double> columns in label order."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def argmax_index(p: Column) -> Column:
    """From 0; the first of equal maxima."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def argmax_label(p: Column, labels: list[str]) -> Column:
    return F.element_at(F.lit(labels), argmax_index(p) + 1)


def top_two(p: Column) -> Column:
    """Indices of the largest and second largest, the earlier of equal ones first."""
    ranked = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, 2), lambda s: s.i)


def margin(p: Column) -> Column:
    ordered = F.sort_array(p, asc=False)
    return F.get(ordered, F.lit(0)) - F.coalesce(F.get(ordered, F.lit(1)), F.lit(0.0))


def normalised(p: Column) -> Column:
    """Divided by the sum; uniform where the sum is not positive."""
    return F.when(total(p) > 0, F.transform(p, lambda x: x / total(p))).otherwise(F.transform(p, lambda x: F.lit(1.0) / F.size(p)))


def softmax(scores: Column) -> Column:
    """Over the scores that are numbers; a missing score has probability 0."""
    top = F.array_max(F.filter(scores, lambda x: x.isNotNull() & ~F.isnan(x)))
    e = F.transform(scores, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.exp(x - top)))
    return normalised(e)


def one_hot(label: Column, labels: list[str]) -> Column:
    return F.transform(F.lit(labels), lambda x: F.when(x == label, 1.0).otherwise(0.0))


def reordered(p: Column, have: list[str], want: list[str]) -> Column:
    return F.array(*(F.get(p, F.lit(have.index(w))) if w in have else F.lit(0.0) for w in want))


def folded(p: Column, labels: list[str], fold: dict[str, str]) -> Column:
    """Summed by group; groups in lexicographic order."""
    groups = sorted(set(fold.values()))
    return F.array(*(sum((F.get(p, F.lit(k)) for k, x in enumerate(labels) if fold[x] == g), F.lit(0.0)) for g in groups))


def shifted(p: Column, offsets: list[float]) -> Column:
    return F.zip_with(p, F.lit([float(x) for x in offsets]), lambda x, b: x + b)


def log_clipped(p: Column) -> Column:
    return F.transform(p, lambda x: F.log(F.least(F.greatest(x, F.lit(1e-9)), F.lit(1.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """At length 1; a zero vector stays zero."""
    n = F.sqrt(dot(v, v))
    whole = F.array(F.when(n > 0, n).otherwise(1.0))  # an array of one, so that it's worked out once and not for each component
    return F.get(F.transform(whole, lambda m: F.transform(v, lambda x: x.cast("double") / m)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def smoothed(target: Column, n: int, alpha: float = 0.12, reach: int = 2, decay: float = 0.5) -> Column:
    """Of each label's mass, alpha goes to the labels within reach, by decay; the result sums to 1."""
    weight = lambda i, j: decay ** (abs(i - j) - 1) if 0 < abs(i - j) <= reach else 0.0
    whole = [sum(weight(i, j) for j in range(n)) or 1.0 for i in range(n)]
    mass = lambda i: F.greatest(F.get(target, F.lit(i)), F.lit(0.0))
    moved = F.array(*(mass(j) * (1 - alpha) + sum((mass(i) * (alpha * weight(i, j) / whole[i]) for i in range(n) if weight(i, j)), F.lit(0.0)) for j in range(n)))
    return F.when(total(moved) > 0, F.transform(moved, lambda x: x / total(moved)))


def smoothed_ordinal(label_index: Column, n: int, alpha: float = 0.12, reach: int = 2, decay: float = 0.5) -> Column:
    """1 - alpha on the label, alpha shared among labels within reach by decay; sums to 1."""
    weight = lambda i: F.when(i == label_index, 0.0).when(F.abs(i - label_index) <= reach, F.pow(F.lit(decay), F.abs(i - label_index) - 1)).otherwise(0.0)
    index = F.sequence(F.lit(0), F.lit(n - 1))
    near = F.transform(index, weight)
    return F.transform(index, lambda i: F.when(i == label_index, F.when(total(near) > 0, 1 - alpha).otherwise(1.0)).otherwise(alpha * weight(i) / F.greatest(total(near), F.lit(1e-12))))


def soft_target(votes: Column, labels: list[str], smooth: float = 0.03, given: Column | None = None) -> Column:
    """Shares of the votes for known labels, mixed with a uniform share; NULL without such votes. A target that is
    given goes first, if it has a number for each label."""
    if given is not None:
        return F.when(F.size(given) == len(labels), given).otherwise(soft_target(votes, labels, smooth))
    known = F.filter(votes, lambda v: F.array_contains(F.lit(labels), v))
    n = F.size(known)
    share = F.transform(F.lit(labels), lambda x: (1 - smooth) * F.size(F.filter(known, lambda v: v == x)) / n + smooth / len(labels))
    return F.when(n > 0, share)


