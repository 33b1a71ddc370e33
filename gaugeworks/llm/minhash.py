"""Near-duplicates by bottom-k sketches of one hash function.

Method. A document's sketch is the SKETCH least hashes of its distinct five-word shingles. Documents of equal sets
are one class, and what follows sees classes only. Inverted lists of the retained values generate candidates: two sets
of Jaccard 0.75 have 3/4 of their union's sketch in common, so MIN_SHARED of SKETCH retained values is a bound that a
pair misses about twice in a million, and a class need be listed only under its rarest values: as many as leave fewer
than MIN_SHARED others. The most central class of each list is its centre. Pairs of a class and a centre whose
union-sketch estimate is near 0.75 or above are verified on full sets, and links join components. A class that stays
apart from a centre is then compared, on full sets, with all that share this centre; such groups are cut into blocks
of bounded size, and only links leave a block. Classes linked to the same centre are connected already and need no
comparison, so a group of copies costs one comparison a class, not all pairs.

Defined results: null and empty texts, and texts of white space, have no shingles and are linked with nothing; a text
of fewer than five words is one shingle; repeated rows are one class, whatever their ids, and a null id is larger than
all others and kept only where no other id is in its class; an empty table gives an empty table; other columns aren't
kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import Words, discard, materialise, mixed, packed, slices, stored_alone
from gaugeworks.llm.components import connected_components

SHINGLE = 5
SKETCH = 64
MIN_SHARED = 32
#: Pairs whose estimate is below this can't be links, but for five standard deviations of chance.
LEAST_ESTIMATE = 0.48
#: Shingles and classes in a side of a block of comparisons.
BLOCK_SHINGLES = 1 << 16
BLOCK_ROWS = 64


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each packed text."""
    words = Words(data, offsets)
    value, doc = words.shingles(SHINGLE)
    edges = np.searchsorted(doc, np.arange(words.n_docs + 1)).tolist()
    sets = [np.unique(value[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    first = np.concatenate([[0], np.cumsum(words.counts)])
    for d in np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE)):
        h = words.counts[d : d + 1].astype(np.uint64)
        for k in range(first[d], first[d + 1]):
            h = mixed(h * np.uint64(31) + words.hash[k : k + 1])
        sets[d] = h
    return sets


def links_by_jaccard(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * inter >= 75 * (a + b - inter)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32()), pa.array(values))


def sketches(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sketch): k1 and k2 are equal for equal sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                sets = shingle_sets(*packed(part, column))
                with np.errstate(over="ignore"):
                    k1 = np.array([mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                    k2 = np.array([mixed(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                columns = [part.column(key), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), _lists([s[:SKETCH] for s in sets])]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_shingles", "k1", "k2", "sketch"])

    return df.select(F.col(key).cast("bigint").alias(key), column).mapInArrow(run, f"{key} bigint, n_shingles bigint, k1 bigint, k2 bigint, sketch array<bigint>")


def full_sets(df: DataFrame, wanted: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(c, shingles) of the documents in wanted (c)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_arrays([part.column("c"), _lists(shingle_sets(*packed(part, column)))], ["c", "shingles"])

    rows = df.select(F.col(key).cast("bigint").alias("c"), column).join(wanted.select("c").distinct(), "c", "left_semi")
    return rows.mapInArrow(run, "c bigint, shingles array<bigint>").dropDuplicates(["c"])


def listed_classes(classes: DataFrame) -> DataFrame:
    """(c, n, sketch, rank, listed): classes that may have a near-duplicate, and the retained values to list them under."""
    values = classes.select("c", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = values.join(shared, "v").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"), F.sum("df").alias("weight"))
    rows = own.join(classes, "c")
    size = F.size("sketch")
    need = F.ceil(size * MIN_SHARED / SKETCH).cast("int")
    held = F.size("shared")
    rows = rows.where(held >= need)  # values that no other class retains come first in the order, and need no list
    listed = F.slice(F.col("shared.v"), F.lit(1), held - need + 1)
    rank = F.struct((held / size).alias("share"), F.col("weight"), (-F.col("c")).alias("c"))
    return rows.select("c", "n", "sketch", rank.alias("rank"), listed.alias("listed"))


def estimates(pairs: DataFrame) -> DataFrame:
    """Pairs (c, z) with both sketches whose union-sketch estimate is LEAST_ESTIMATE or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = np.array(a, np.int64).view(np.uint64), np.array(b, np.int64).view(np.uint64)
                both, n = np.unique(np.concatenate([a, b]), return_counts=True)
                size = SKETCH if len(a) == len(b) == SKETCH else min(len(both), SKETCH)
                keep.append(bool((n[:size] == 2).sum() >= LEAST_ESTIMATE * size))
            yield batch.select(["c", "z"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "c bigint, z bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (c, z) that are links, by their full sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            keep = []
            for k in range(len(batch)):
                x, y = a[k].values.to_numpy(), b[k].values.to_numpy()
                keep.append(bool(links_by_jaccard(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield batch.select(["c", "z"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.withColumnRenamed("shingles", "a"), "c").join(sets.select(F.col("c").alias("z"), F.col("shingles").alias("b")), "z")
    return joined.select("c", "z", "a", "b").mapInArrow(run, "c bigint, z bigint")


def compare_block(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between the orphans and the members of one block; both hold at most about BLOCK_SHINGLES shingles and BLOCK_ROWS rows."""
    side, comp, c = rows.column("side").to_numpy(), rows.column("comp").to_numpy(), rows.column("c").to_numpy()
    lists = rows.column("shingles").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    value = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    row = np.repeat(np.arange(len(side)), size)
    orphan, member = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    place = np.empty(len(side), np.int64)
    place[orphan], place[member] = np.arange(len(orphan)), np.arange(len(member))
    _, element = np.unique(value, return_inverse=True)
    n = element.max(initial=-1) + 1
    useful = np.zeros((2, n), bool)
    useful[side[row], element] = True
    renumber = np.cumsum(useful.all(0)) - 1
    kept = useful.all(0)[element]
    row, element = row[kept], renumber[element[kept]]
    order = np.argsort(element, kind="stable")
    row, element = row[order], element[order]
    inter = np.zeros((len(orphan), len(member)), np.float32)
    width = 4096
    for low in range(0, int(element[-1]) + 1 if len(element) else 0, width):
        a, b = np.searchsorted(element, [low, low + width])
        r, e = row[a:b], element[a:b] - low
        left, right = np.zeros((len(orphan), width), np.float32), np.zeros((len(member), width), np.float32)
        o = side[r] == 0
        left[place[r[o]], e[o]] = 1
        right[place[r[~o]], e[~o]] = 1
        inter += left @ right.T
    linked = links_by_jaccard(inter.astype(np.int64), size[orphan][:, None], size[member][None, :])
    linked &= comp[orphan][:, None] != comp[member][None, :]
    i, j = np.nonzero(linked)
    return pa.table({"u": pa.array(c[orphan[i]]), "v": pa.array(c[member[j]])})


def links_among_groups(pairs: DataFrame, comps: DataFrame, sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links (u, v) between a class that isn't connected to the centre z of its pair and the others of that centre."""
    own = pairs.join(comps.select(F.col("node").alias("c"), F.col("component").alias("comp")), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    own = own.join(comps.select(F.col("node").alias("z"), F.col("component").alias("zcomp")), "z", "left").withColumn("zcomp", F.coalesce("zcomp", "z"))
    own = own.join(sizes, "c").withColumn("orphan", F.col("comp") != F.col("zcomp"))
    per_group = own.groupBy("z").agg(
        F.sum(F.when(F.col("orphan"), F.col("n"))).alias("orphan_n"), F.sum("n").alias("member_n"), F.count(F.lit(1)).alias("members"), F.sum(F.col("orphan").cast("int")).alias("orphans")
    ).where("orphan_n > 0 and members > 1")
    blocks = lambda n, rows: F.greatest(F.ceil(F.col(n) / BLOCK_SHINGLES), F.ceil(F.col(rows) / BLOCK_ROWS)).cast("int")
    own = own.join(per_group.select("z", blocks("orphan_n", "orphans").alias("n_o"), blocks("member_n", "members").alias("n_m")), "z")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    orphans = own.where("orphan").select("z", F.pmod(F.xxhash64("c"), "n_o").cast("int").alias("o"), F.explode(every("n_m")).alias("m"), F.lit(0).alias("side"), "c", "comp")
    members = own.select("z", F.explode(every("n_o")).alias("o"), F.pmod(F.xxhash64("c"), "n_m").cast("int").alias("m"), F.lit(1).alias("side"), "c", "comp")
    rows = orphans.unionByName(members).join(sets, "c")
    return rows.groupBy("z", "o", "m").applyInArrow(compare_block, "u bigint, v bigint")


def near_duplicates(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked by 100 * intersection >= 75 * union of their shingle
    sets, directly or through others, have the least doc_id among them as component_id; that document is kept."""
    docs = materialise(sketches(df, column, key), "sketches")
    filled = docs.where("n_shingles > 0")
    classes = materialise(filled.groupBy("k1", "k2", "n_shingles").agg(F.min(key).alias("c"), F.first("sketch").alias("sketch")).withColumnRenamed("n_shingles", "n"), "classes")
    listed = materialise(listed_classes(classes.select("c", "n", "sketch")), "listed")
    entries = listed.select("c", "rank", F.explode("listed").alias("v"))
    centres = entries.groupBy("v").agg(F.max("rank").alias("top"), F.count(F.lit(1)).alias("many")).where("many > 1").select("v", F.negative("top.c").alias("z"))
    pairs = materialise(entries.select("c", "v").join(centres, "v").where("c <> z").select("c", "z").distinct(), "pairs")
    members = pairs.select("c").unionByName(pairs.select(F.col("z").alias("c")))
    sets = materialise(full_sets(df, members, column, key), "sets")
    both = pairs.join(listed.select("c", F.col("sketch").alias("a")), "c").join(listed.select(F.col("c").alias("z"), F.col("sketch").alias("b")), "z")
    links = verified(estimates(both.select("c", "z", "a", "b")), sets).toDF("u", "v")
    comps = stored_alone(lambda: connected_components(links), "components")
    more = materialise(links_among_groups(pairs, comps, sets, listed.select("c", "n")), "more_links")
    if not more.isEmpty():
        first = comps
        comps = stored_alone(lambda: connected_components(more, first), "components")
        discard(first)
    discard(listed, pairs, sets, more)
    owned = classes.select("k1", "k2", F.col("n").alias("n_shingles"), "c").join(comps.withColumnRenamed("node", "c"), "c", "left")
    owned = owned.select("k1", "k2", "n_shingles", F.coalesce("component", "c").alias("component"))
    joined = docs.drop("sketch").join(owned, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col(key))
    return joined.select(key, "n_shingles", component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
