"""Benchmark decontamination by pigeonhole edit matching.

Method: a test item of n characters may differ from a passage by ERRORS_PER_CHARACTER * n edits. Cut into one piece
more than that, at least one piece of it must occur unchanged. One automaton finds the pieces of all items in a
document; each hit proposes a place, and Myers' bit-parallel algorithm gives the least edit distance of the item to
any stretch of text there. Letters are compared in lower case, and line ends and tabs as spaces; offsets stay those
of the original text.

The items are taken in blocks of at most BLOCK_BYTES. Each block is broadcast and run against all documents, and where
there are several, the documents with their hits so far are stored in between, so that a task has one block's automaton
at a time: memory is bounded for benchmarks of any size.

Defined results: null and empty texts and items match nothing; an item too short for an edit (under 16 characters) must
stand between characters that are neither letters nor digits; repeated items are reported each, as are rows of one
item_id; repeated documents get equal hits; of an item's places in a document the one of least distance is kept, the
first of equal ones; empty tables give no hits; columns named like a result are replaced, all others kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import discard, kept_columns, materialise, slices, texts_of

ERRORS_PER_CHARACTER = 1 / 16
BLOCK_BYTES = 4 << 20

HITS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "start", "end", "distance")]))
_ARROW_HITS = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "end", "distance")]))


def folded(text: str) -> str:
    """In lower case, white space as spaces, each character in its place."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low.replace("\n", " ").replace("\t", " ").replace("\r", " ")


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the stretch of text nearest to item, the first of equal ends, if within most edits."""
    n = len(item)
    where: dict[str, int] = {}
    for k, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << k
    mask, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, end = mask, 0, n, most + 1, 0
    for k, c in enumerate(text):
        eq = where.get(c, 0)
        cross = ((eq & plus) + plus ^ plus) | eq | minus
        up = minus | mask & ~(cross | plus)
        down = plus & cross
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1  # a match may begin anywhere: the first row costs nothing
        cross = eq | minus
        plus, minus = (down | ~(cross | up)) & mask, up & cross & mask
        if score < best:
            best, end = score, k + 1
    return (best, end) if best <= most else None


def apart(text: str, start: int, end: int) -> bool:
    """Is there no letter or digit right before start or after end?"""
    return not (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum())


class Matcher:
    """The pieces of one block of items, ready to be found."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t, int(len(t) * ERRORS_PER_CHARACTER)) for i, t in ((i, folded(t or "")) for i, t in items) if t.strip()]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, errors) in enumerate(self.items):
            for at, piece in pieces(t, errors):
                found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of each item that occurs, by start."""
        if not self.items or not text:
            return []
        low = folded(text)
        places: dict[int, set[int]] = {}
        for last, (size, uses) in self.automaton.iter(low):
            for k, at in uses:
                places.setdefault(k, set()).add(last + 1 - size - at)
        out = []
        for k, starts in places.items():
            item_id, item, errors = self.items[k]
            best = next(((0, s, s + len(item)) for s in sorted(starts) if s >= 0 and low.startswith(item, s) and (errors or apart(low, s, s + len(item)))), None)
            if best is None and errors:
                best = self._nearest(item, errors, low, sorted(starts))
            if best:
                out.append((item_id, best[1], best[2], best[0]))
        return sorted(out, key=lambda h: (h[1], h[0]))

    @staticmethod
    def _nearest(item: str, errors: int, low: str, starts: list[int]) -> tuple[int, int, int] | None:
        best, k = None, 0
        while k < len(starts):
            first = last = starts[k]
            while k < len(starts) and starts[k] <= last + 2 * errors + 1:  # places whose windows overlap are one
                last = starts[k]
                k += 1
            a, b = max(0, first - errors), last + len(item) + errors
            if (got := myers(item, low[a:b], errors)) and (best is None or got[0] < best[0]):
                end = a + got[1]
                back = max(0, end - len(item) - errors)
                start = end - myers(item[::-1], low[back:end][::-1], errors)[1]
                best = (got[0], start, end)
        return best


@lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int, str], ...]) -> Matcher:
    return Matcher(list(items))


def item_blocks(items: DataFrame, column: str = "text", key: str = "item_id") -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of about BLOCK_BYTES; the driver holds one block at a time."""
    rows = items.where(F.length(column) > 0).select(F.col(key).cast("bigint").alias("k"), F.col(column).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == k)
        yield [(r.k, r.t) for r in part.orderBy("k", "t").collect()]


def benchmark_hits(df: DataFrame, items: DataFrame, column: str = "text", out: str = "hits", keep_text: bool = True) -> DataFrame:
    """Add `out`: the items found in each text, with place and distance."""
    spark = df.sparkSession
    result = df.select(*kept_columns(df, out)).withColumn(out, F.lit(None).cast(HITS))
    before = stored = None
    for block in item_blocks(items):
        if before is not None:  # one automaton a task
            last, result = stored, materialise(result, "hits")
            stored = result
            if last is not None:
                discard(last)
            before.destroy()
        before = spark.sparkContext.broadcast(tuple(block))
        result = _with_hits(result, before, column, out)
    result = result.withColumn(out, F.coalesce(out, F.array().cast(HITS)))
    return result if keep_text else result.drop(column)


def _with_hits(df: DataFrame, items, column: str, out: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items.value)
        for batch in batches:
            for part in slices(batch, column):
                names = [c for c in part.schema.names if c != out]
                found = [
                    (before or []) + [dict(zip(("item_id", "start", "end", "distance"), h, strict=True)) for h in matcher.hits(text)]
                    for before, text in zip(part.column(out).to_pylist(), texts_of(part, column), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, _ARROW_HITS)], [*names, out])

    return df.mapInArrow(run, T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, HITS)]))
