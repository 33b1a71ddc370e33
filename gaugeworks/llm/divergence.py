"""How the sources of a language diverge in their words: sums of frequency differences from count-level bitmaps.

Method. A group is a (lang, source). Its frequency p of a term depends on the term's count there alone, so all of its
terms of one count are one level: a bitset of term ids. The terms that have count a in one group and count b in another are the
bits that two bitsets share; their number times |p(a) - q(b)|, added up over all pairs of levels, is the
groups' divergence. Terms that a group lacks are the complement of its levels.

Ids follow the language's counts, so that the terms of a block of BLOCK ids have similar counts and few levels: pairs of
levels are many only in the blocks of the most frequent terms. A block's bitsets of all groups meet in one task, or, where
a language has more than TILE groups, those of two tiles of groups at a time.

Tasks count words before anything is shuffled: a slice of texts sends one row for each group and term.
All arithmetic is exact, in whole numbers.

Defined results: null text, lang and source are ''; a lang without kept terms has pairs of value 0 and no terms; equal values
rank by item; repeated rows are documents of their own, whatever their ids; a lang of one source has no pairs; an empty table gives an
empty table; other columns aren't kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import discard, materialise, packed, slices

#: Documents of a lang that hold a kept term, at least.
LEAST_DOCUMENTS = 30
UNIT, ADDED = 1_000_000_000, 5
TOP = 50
#: Term ids of a bitset, and groups of a lang whose bitsets meet in one task.
BLOCK = 512
TILE = 64
#: Bytes of text whose words are counted together.
SLICE = 8 << 20
#: 64-bit words of intersections that are held at once.
HELD = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---- counting ----------------------------------------------------------------------------------------------------


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of packed texts in a row, and the text of each: runs of letters A-Z and all beyond ASCII, A-Z lowered."""
    letter = _LETTER[data]
    edge = np.ones(len(data) + 1, bool)  # a text's end divides terms too
    edge[1:-1] = letter[1:] != letter[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    held = letter[starts] if len(data) else np.zeros(0, bool)
    starts, ends = starts[held], ends[held]
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(_LOWER[data[letter]]))
    return terms, np.searchsorted(offsets, starts, "right") - 1


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences of each term in a group, and documents that hold it, both in parts that
    are yet to be added up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                terms, doc = words_of(*packed(rows))
                if not len(terms):
                    continue
                coded = terms.dictionary_encode()
                term, size = coded.indices.to_numpy(), len(coded.dictionary)
                pairs = pa.StructArray.from_arrays([rows.column("lang"), rows.column("source")], ["lang", "source"])
                named = {p: k for k, p in enumerate(dict.fromkeys((p["lang"], p["source"]) for p in pairs.to_pylist()))}
                group = np.array([named[p["lang"], p["source"]] for p in pairs.to_pylist()], np.int64)
                in_doc, n = np.unique(doc * size + term, return_counts=True)
                key, at = np.unique(group[in_doc // size] * size + in_doc % size, return_inverse=True)
                whole = np.zeros(len(key), np.int64)
                np.add.at(whole, at, n)
                names = list(named)
                whose = key // size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in names], pa.string()).take(pa.array(whose)), pa.array([x for _, x in names], pa.string()).take(pa.array(whose)), coded.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(whole), pa.array(np.bincount(at, minlength=len(key)))],
                    ["lang", "source", "term", "n", "d"],
                )

    return docs.mapInArrow(run, "lang string, source string, term string, n bigint, d bigint")


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, lang_n) of the terms that enough documents of a lang hold. All of a term's parts meet in
    one shuffle, on (lang, term): each slice of texts and source adds one row to them."""
    each = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of_lang = Window.partitionBy("lang", "term")
    whole = each.withColumns({"lang_n": F.sum("n").over(of_lang), "lang_d": F.sum("d").over(of_lang)})
    return whole.where(F.col("lang_d") >= least).select("lang", "source", "term", "n", "lang_n")


def frequency(count: Column, whole: Column, size: Column) -> Column:
    """1 + floor(1000000000 * (count + 5) / (whole + 5 * size)), null without terms."""
    exact = lambda c: c.cast("decimal(19,0)")
    over = F.nullif(exact(whole + ADDED * size), F.lit(0).cast("decimal(19,0)"))
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * exact(count + ADDED), over)


# ---- bitsets -----------------------------------------------------------------------------------------------------

LEVELS = "lang string, block bigint, n_terms int, source string, counts array<bigint>, bits binary"


def count_levels(kept: DataFrame, size: int = BLOCK) -> DataFrame:
    """(lang, block, n_terms, source, counts, bits): for each block of `size` term ids and group that has some of them, the
    counts that occur and the bitset of each in a row. One shuffle, by range of (lang, count in the lang, term), in which
    ids are given as rows pass; a term's rows are never apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, left = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([left, rows]).combine_chunks() if left is not None else rows
            place, lang = _places(rows)
            block, last = _blocks(place, lang, size)
            whole = int(np.searchsorted(block, last))  # what follows may belong to the last block
            for a, b in _runs(block[:whole]):
                yield _levels(rows.slice(a, b - a), place[a:b], number, size)
                number += 1
            left = rows.slice(whole)
        if left is not None and len(left):
            place, _ = _places(left)
            yield _levels(left, place, number, size)

    ordered = kept.repartitionByRange("lang", F.desc("lang_n"), "term").sortWithinPartitions("lang", F.desc("lang_n"), "term").select("lang", "source", "term", "n")
    return ordered.mapInArrow(run, LEVELS)


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    values = values.dictionary_encode().indices.to_numpy()
    return np.concatenate([[True], values[1:] != values[:-1]])


def _places(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's term among the terms of its lang here, and of its lang."""
    new_lang = _changes(rows.column("lang"))
    term = np.cumsum(new_lang | _changes(rows.column("term"))) - 1
    lang = np.cumsum(new_lang) - 1
    return term - term[np.flatnonzero(new_lang)][lang], lang


def _blocks(place: np.ndarray, lang: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    key = np.concatenate([[True], (place[1:] // size != place[:-1] // size) | (lang[1:] != lang[:-1])])
    block = np.cumsum(key) - 1
    return block, int(block[-1])


def _runs(block: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else np.zeros(0, int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _levels(rows: pa.Table, place: np.ndarray, number: int, size: int) -> pa.RecordBatch:
    """A block's rows as one row for each group: its counts, and a bitset for each."""
    bit = place % size
    coded = rows.column("source").combine_chunks().dictionary_encode()
    n = rows.column("n").to_numpy()
    level, at = np.unique(np.stack([coded.indices.to_numpy().astype(np.int64), n]), axis=1, return_inverse=True)
    bits = np.zeros((level.shape[1], size), np.uint8)
    bits[at.ravel(), bit] = 1
    raw = np.packbits(bits, axis=1, bitorder="little")
    groups = _runs(level[0])
    k = len(groups)
    lang = rows.column("lang")[0].as_py()
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * k, pa.string()), pa.array([number] * k), pa.array([int(bit.max()) + 1] * k, pa.int32()), coded.dictionary.take(pa.array([int(level[0, a]) for a, _ in groups])), pa.array([level[1, a:b].tolist() for a, b in groups], pa.list_(pa.int64())), pa.array([raw[a:b].tobytes() for a, b in groups], pa.binary())],
        ["lang", "block", "n_terms", "source", "counts", "bits"],
    )


# ---- pairs -------------------------------------------------------------------------------------------------------


def joint_divergence(n_terms: int, left: list[tuple], right: list[tuple], same: bool) -> list[tuple[int, int, int]]:
    """(i, j, value) of each group of `left` and each of `right` within a block of n_terms terms, those of i < j if both
    lists are the `same`. A group is (frequencies of its levels, that of a term it lacks, bitsets)."""
    sizes = [np.bitwise_count(g[2]).sum(1, dtype=np.int64) for g in right]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    bits = np.concatenate([g[2] for g in right])
    out = []
    for i, (p, p0, own) in enumerate(left):
        size = np.bitwise_count(own).sum(1, dtype=np.int64)
        first = i + 1 if same else 0
        joint = np.zeros((len(own), int(at[-1] - at[first])), np.int64)
        step = max(1, HELD // max(1, joint.shape[1] * bits.shape[1]))
        for a in range(0, len(own), step):
            joint[a : a + step] = np.bitwise_count(own[a : a + step, None] & bits[None, at[first] :]).sum(2, dtype=np.int64)
        for j in range(first, len(right)):
            q, q0, _ = right[j]
            cells = joint[:, at[j] - at[first] : at[j + 1] - at[first]]
            only_left, only_right = size - cells.sum(1), sizes[j] - cells.sum(0)  # the other's complement
            neither = n_terms - int(size.sum()) - int(only_right.sum())
            value = int((cells * np.abs(p[:, None] - q[None])).sum() + (only_left * np.abs(p - q0)).sum() + (only_right * np.abs(p0 - q)).sum()) + neither * abs(p0 - q0)
            out.append((i, j, value))
    return out


def _frequencies(counts: np.ndarray, whole: int, size: int) -> np.ndarray:
    return np.array([1 + UNIT * (int(c) + ADDED) // (whole + ADDED * size) for c in counts], np.int64)


def pair_values(levels: DataFrame, groups: DataFrame, size: int = BLOCK) -> DataFrame:
    """(lang, source, item, value) of every two sources of a lang, once each way. groups: (lang, source, n, v, tile, tiles)."""
    blocks = levels.select("lang", "block", "n_terms").distinct()
    grid = blocks.join(groups, "lang").join(levels.select("lang", "block", "source", "counts", "bits"), ["lang", "block", "source"], "left")
    units = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "tile").alias("a"), F.greatest(t, "tile").alias("b")))
    met = grid.withColumn("unit", F.explode(units)).select("lang", "block", F.col("unit.a").alias("a"), F.col("unit.b").alias("b"), "tile", "n_terms", "source", "n", "v", "counts", "bits")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["source"])  # joins leave any order: two sources are (i, j) one way in all blocks
        sides: list[list[tuple]] = [[], []]
        names: list[list[str]] = [[], []]
        for r in rows:
            side = int(r["a"] != r["b"] and r["tile"] == r["b"])
            bits = np.frombuffer(r["bits"] or b"", "<u8").reshape(-1, size // 64)
            p = _frequencies(np.array([*(r["counts"] or []), 0]), r["n"], r["v"])
            sides[side].append((p[:-1], int(p[-1]), bits))
            names[side].append(r["source"])
        same = rows[0]["a"] == rows[0]["b"]
        other = 0 if same else 1
        got = joint_divergence(rows[0]["n_terms"], sides[0], sides[other], same) if sides[0] and sides[other] else []
        return pa.table({"lang": pa.array([rows[0]["lang"]] * len(got), pa.string()), "source": pa.array([names[0][i] for i, _, _ in got], pa.string()), "item": pa.array([names[other][j] for _, j, _ in got], pa.string()), "value": pa.array([x for _, _, x in got], pa.int64())})

    parts = met.groupBy("lang", "block", "a", "b").applyInArrow(run, "lang string, source string, item string, value bigint")
    once = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def source_divergence(df: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` is each other source of the lang with the sum of frequency
    differences over all kept terms; part `term` is each term more frequent in the group than in the lang, to rank `top`."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = df.select(empty("text"), empty("lang"), empty("source"))
    kept = materialise(kept_terms(docs, least), "kept_terms")
    # one row for each group, and one for each lang: they are few beside documents and terms
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_whole"))
    found = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")).drop("docs")
    sources = found.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    groups = found.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").join(sources, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int"))
    groups = materialise(groups.fillna(0, ["n", "v", "lang_whole"]), "groups")
    levels = materialise(count_levels(kept, block), "count_levels")
    pairs = pair_values(levels, groups.where("v > 0").select("lang", "source", "n", "v", "tile", "tiles"), block)
    none = groups.where("v = 0").select("lang", "source")
    pairs = pairs.unionByName(none.join(none.select("lang", F.col("source").alias("item")), "lang").where("source != item").withColumn("value", F.lit(0).cast("bigint")))
    both = kept.join(groups.select("lang", "source", F.col("n").alias("whole"), "v", "lang_whole"), ["lang", "source"])
    more = frequency(F.col("n"), F.col("whole"), F.col("v")) - frequency(F.col("lang_n"), F.col("lang_whole"), F.col("v"))
    terms = both.select("lang", "source", F.col("term").alias("item"), more.cast("bigint").alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    out = materialise(ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top)), "divergence")
    discard(kept, groups, levels)
    return out
