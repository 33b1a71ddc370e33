"""Substring dedup: repeated passages found by the digests of short units, and removed but for the first.

Method: a text's lines are cut into units of words, whose digests are grouped over the whole corpus; the earliest
occurrence by (doc_id, place) stays and every later one is marked. The units are whole lines, whose later occurrences
all go, whatever their length, and parts of lines, as whole lines are too coarse for passages that begin and end inside
them: a line is cut at words chosen by content, those whose hash is least among some WINDOW neighbouring words of the
line. Neighbouring marked parts join to a span, and spans of MIN_WORDS words or more go. Equal lines always give equal
parts, and so does a passage inside different lines, but for WINDOW - 1 words at its start and WINDOW at its end at
most. Hence every repeat of MIN_WORDS + 2 * WINDOW - 1 = 51 words that is cut alike into lines is found, wherever it
stands. A second pass compares the windows of 51 words about the ends of these spans, so that every word goes that stands
in 51 words whose earliest occurrence ends before they begin. Shorter repeats inside lines may stay.
Words of parts are compared with A-Z as a-z, those of whole lines as they are (short lines that differ in case are not
the same); white space only divides words.

Digests have 128 bits: two of 64, each made of word hashes of its own, which are independent. Different units share
both by chance once in 2**128 pairs.

Defined results: null and empty texts have no units and no spans; within a document later repeats go too; of rows of
equal doc_id the texts rank by their hash, and rows that are equal in both are one document stored again: all but one
of them go whole (`copy` tells which); a null doc_id sorts first; an empty table has no spans; other columns are kept
by remove_spans, whatever their names, but for those named like a result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import Words, discard, free_name, materialise, mixed, packed, slices

WINDOW = 12
MIN_WORDS = 28

UNITS = "doc_id bigint, text_key bigint, unit int, d1 bigint, d2 bigint, start_at int, end_at int, n_words int, n_parts int"
_SALTS = (np.uint64(0xD1B54A32D192ED03), np.uint64(0xA0761D6478BD642F))


def _digests(hashes: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Two digests of the runs of words that begin at `at`, one from each kind of word hash, and their numbers of words."""
    n = len(hashes[0])
    size = np.diff(np.append(at, n))
    place = (np.arange(n) - np.repeat(at, size)).astype(np.uint64)  # of a word in its run
    return [mixed(np.add.reduceat(mixed(h ^ (place * salt + salt)), at) + size.astype(np.uint64)) for h, salt in zip(hashes, _SALTS, strict=True)], size


def units_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The units of packed texts: document, number in it, digest, code point offsets, words; parts of lines, whose
    `parts` is 0, then whole lines, with the number of their first part and of all of their parts."""
    words = Words(data, offsets)
    n = len(words.hash)
    if not n:
        return {k: np.zeros(0, np.int64) for k in ("doc", "unit", "d1", "d2", "start", "end", "words", "parts")}
    breaks = np.cumsum(np.concatenate([[0], data == 10]))
    line = breaks[words.start] + words.doc  # differs between lines and between documents
    first = np.concatenate([[True], line[1:] != line[:-1]])
    cut = first.copy()
    if n >= WINDOW:
        view = np.lib.stride_tricks.sliding_window_view(words.hash, WINDOW)
        same = line[: n - WINDOW + 1] == line[WINDOW - 1 :]
        least = view.argmin(1) + np.arange(len(view))
        cut[least[same]] = True
    at, lines = np.flatnonzero(cut), np.flatnonzero(first)
    part, size = _digests((words.hash, words.hashed(words.lowered, 1)), at)
    whole, length = _digests((words.hashed(data), words.hashed(data, 1)), lines)
    d1, d2 = (np.concatenate([p, mixed(~w)]).view(np.int64) for p, w in zip(part, whole, strict=True))
    number = np.arange(len(at)) - np.searchsorted(words.doc[at], words.doc[at])
    head = np.searchsorted(at, lines)  # each line's first part
    at, size = np.concatenate([at, lines]), np.concatenate([size, length])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    doc = words.doc[at]
    base = points[offsets[doc]]
    return {
        "doc": doc, "unit": np.concatenate([number, number[head]]), "d1": d1, "d2": d2, "start": points[words.start[at]] - base,
        "end": points[words.end[at + size - 1]] - base, "words": size, "parts": np.concatenate([np.zeros(len(number), np.int64), np.diff(np.append(head, len(number)))]),
    }


def corpus_units(df: DataFrame, column: str = "text", key: str = "doc_id", ids_repeat: bool = False) -> DataFrame:
    """The units of all texts. text_key tells the texts of one doc_id apart, where ids repeat."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                u = units_of(*packed(part, column))
                whose = pa.array(u["doc"])
                ints = [pa.array(u[k].astype(np.int32)) for k in ("start", "end", "words", "parts")]
                columns = [part.column(key).take(whose), part.column("text_key").take(whose), pa.array(u["unit"].astype(np.int32)), pa.array(u["d1"]), pa.array(u["d2"]), *ints]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in UNITS.split(", ")])

    text_key = F.xxhash64(column) if ids_repeat else F.lit(0).cast("bigint")
    return df.select(F.col(key).cast("bigint").alias("doc_id"), column, text_key.alias("text_key")).select(F.col("doc_id").alias(key), column, "text_key").mapInArrow(run, UNITS)


def repeated_rows(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, n) of the doc_ids that several rows have."""
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(column).alias("text_key")).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    several = rows.groupBy("doc_id").agg(F.sum("n").alias("rows")).where("rows > 1").select("doc_id")
    return materialise(rows.join(several, rows.doc_id.eqNullSafe(several.doc_id), "left_semi"), "repeated_rows")


def repeated_spans(df: DataFrame, column: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, copy, start_at, end_at, n_words, first_doc_id, first_start): what to remove, in code points of
    the original text, and where the span's first unit, or the words added before it, occur first. text_key is 0 unless
    ids repeat; copy is 0 but for a span of a row that is stored again, which covers its text."""
    again = repeated_rows(df, column, key)
    ids_repeat = not again.isEmpty()
    units = corpus_units(df, column, key, ids_repeat)
    place = F.struct("doc_id", "text_key", "unit", "start_at")
    # stored first, so that both sides of the join are plain exchanges whose hot digests Spark splits; a row stored
    # again has the same places
    many = F.min(F.xxhash64(place)) < F.max(F.xxhash64(place)) if ids_repeat else F.count(F.lit(1)) > 1
    repeated = materialise(units.groupBy("d1", "d2").agg(F.min(place).alias("first"), many.alias("many")).where("many").drop("many"), "repeated")
    later = units.join(repeated, ["d1", "d2"]).where(~F.col("first").eqNullSafe(place))
    # a whole line and its first part share a place, but not a digest
    if ids_repeat:
        later = later.repartition("doc_id", "text_key").dropDuplicates(["doc_id", "text_key", "unit", "n_parts"])
    # neighbouring parts have equal differences of unit and row number; the parts of a later line are later ones too
    text = ["doc_id", "text_key"] if ids_repeat else ["doc_id"]
    by_place = Window.partitionBy(*text).orderBy("unit", F.desc("n_parts")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.col("n_parts") == 0
    marked = later.withColumn("_until", F.max(F.when(~part, F.col("unit") + F.col("n_parts"))).over(by_place))
    marked = marked.withColumn("_whole", part & F.coalesce(F.col("_until") > F.col("unit"), F.lit(False)))
    marked = marked.withColumn("_run", F.col("unit") - F.sum(part.cast("int")).over(by_place)).withColumn("_lines", F.col("unit") - F.sum(F.col("_whole").cast("int")).over(by_place))
    of_run = Window.partitionBy(*text, "_run")
    so_far = F.sum("n_words").over(of_run.orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = marked.where(part).withColumns({"_all": F.sum("n_words").over(of_run), "_so_far": so_far, "_next": F.lead("n_words").over(of_run.orderBy("unit")), "_before": F.lag("n_words").over(of_run.orderBy("unit"))})
    first = F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), F.col("first.start_at").alias("start_at"))
    left, right = _anchors()
    runs = runs.select("doc_id", "text_key", "unit", "d1", "d2", "start_at", "end_at", "n_words", first.alias("first"), "_run", "_lines", "_whole", (F.col("_all") >= min_words).alias("_long"), left.alias("left"), right.alias("right"))
    runs = materialise(runs, "runs")
    discard(repeated)
    # a run that is too short leaves its whole lines
    spans = runs.where(F.col("_long") | F.col("_whole")).groupBy("doc_id", "text_key", "_run", F.when(~F.col("_long"), F.col("_lines")).alias("_lines")).agg(
        F.min("start_at").alias("start_at"),
        F.max("end_at").alias("end_at"),
        F.max("_long").alias("long"),
        F.min_by("first", "unit").alias("first"),
    )
    spans = materialise(spans, "runs_joined")
    whole_spans = widened(df, runs, spans, column, key, ids_repeat, min_words + 2 * WINDOW - 1)
    discard(runs, spans)
    spans = whole_spans.select("doc_id", "text_key", F.lit(0).alias("copy"), "start_at", "end_at", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start_at").alias("first_start"))
    if ids_repeat:
        whole = units.groupBy("doc_id", "text_key").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.countDistinct(F.when(part, F.col("unit"))).cast("int").alias("n"), F.sum(F.when(part, F.col("n_words"))).alias("w"))
        more = again.where("n > 1").withColumnRenamed("n", "rows")
        both = more.join(whole, more.doc_id.eqNullSafe(whole.doc_id) & (more.text_key == whole.text_key)).select(more.doc_id, more.text_key, F.explode(F.sequence(F.lit(1), F.col("rows").cast("int") - 1)).alias("copy"), "start_at", "end_at", (F.col("w") / F.col("rows")).cast("int").alias("n_words"))
        spans = spans.unionByName(both.select("*", F.col("doc_id").alias("first_doc_id"), F.col("start_at").alias("first_start")))
    return spans.withColumnsRenamed({"doc_id": key, "first_doc_id": f"first_{key}"})


# ---- ends of spans -----------------------------------------------------------------------------------------------

#: What is asked of a text: its spans, and its units about which windows stand; left and right have a bit for each number
#: of words by which a window begins before them or ends after them.
_ASKED = ("start_at", "end_at", "n_words", "is_span", "left", "right", "first")
WINDOWS = (
    "doc_id bigint, text_key bigint, h1 bigint, h2 bigint, w bigint, at int, span int, start_at int, end_at int, w0 bigint, w1 bigint, first struct<doc_id:bigint,text_key:bigint,start_at:int>"
)


def _bits(least: Column, most: Column) -> Column:
    power = lambda n: F.call_function("shiftleft", F.lit(1), n.cast("int"))
    return F.when(least <= most, power(most + 1) - power(least)).otherwise(0)


def _anchors() -> tuple[Column, Column]:
    """Bits of the windows that a unit of a run stands for. A window that begins k words before the run may share its
    first cut only with what it repeats from WINDOW - 1 - k words of the run on: the first unit from there stands for it. So
    does the last unit that ends WINDOW - k words before the run's end, for a window that ends k words after the run."""
    begin, rest = F.col("_so_far") - F.col("n_words"), F.col("_all") - F.col("_so_far")
    before, after = F.coalesce(begin - F.col("_before"), F.lit(-1)), F.coalesce(rest - F.col("_next"), F.lit(-1))
    left = _bits(begin + F.greatest(F.lit(1), F.lit(WINDOW - 1) - begin), begin + F.lit(WINDOW - 2) - before)
    return left, _bits(rest + F.greatest(F.lit(1), F.lit(WINDOW) - rest), rest + F.lit(WINDOW - 1) - after)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` words in a row, by doubling."""
    p = 1
    pair = lambda a, b: mixed(a * _SALTS[0] + mixed(b ^ _SALTS[1]))
    while 2 * p <= size:
        h, p = pair(h[:-p], h[p:]), 2 * p
        if not len(h):
            return h
    return pair(h[: len(h) - (size - p)], h[size - p :])


def _edge_windows(part: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Rows with hashes: the windows of `size` words that stand up to WINDOW words out of a unit asked for (no span), and
    those out of a span, with the offsets and words that the span would have with them. Rows without: the spans."""
    data, offsets = packed(part, column)
    words = Words(data, offsets)
    asked = part.column("asked")
    doc = pc.list_parent_indices(asked).to_numpy().astype(np.int64)
    flat = asked.flatten()
    field = {k: pc.struct_field(flat, k) for k in _ASKED}
    start_at, end_at, n_words, left, right = (field[k].fill_null(0).to_numpy().astype(np.int64) for k in ("start_at", "end_at", "n_words", "left", "right"))
    is_span = field["is_span"].to_numpy(zero_copy_only=False)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = points[offsets[words.doc]]
    begins, ends = points[words.start] - base, points[words.end] - base
    key = (words.doc << 32) + begins
    w0 = np.searchsorted(key, (doc << 32) + start_at)
    w1 = np.where(is_span, np.searchsorted(key, (doc << 32) + end_at), w0 + n_words)
    h1, h2 = (window_hashes(h, size).view(np.int64) for h in (words.hash, words.hashed(words.lowered, 1)))
    first_word = np.searchsorted(words.doc, np.arange(words.n_docs))
    last_word = np.searchsorted(words.doc, np.arange(words.n_docs), "right")

    def rows(at: np.ndarray, b: np.ndarray | None, start: np.ndarray, end: np.ndarray, a0: np.ndarray, a1: np.ndarray, first: bool, own: bool = True) -> pa.RecordBatch:
        whose, n, spans = pa.array(doc[at]), len(at), pa.array(is_span[at] & own)
        none = pa.nulls(n, pa.int64())
        of_window = [none, none, none, pa.nulls(n, pa.int32())] if b is None else [pa.array(h1[b]), pa.array(h2[b]), pa.array(b - first_word[doc[at]]), pa.array(begins[b].astype(np.int32))]
        mine = [pc.if_else(spans, pa.array(x.astype(t)), pa.scalar(None, pa.from_numpy_dtype(t))) for x, t in ((start_at[at], np.int32), (start, np.int32), (end, np.int32), (a0 - first_word[doc[at]], np.int64), (a1 - first_word[doc[at]], np.int64))]
        firsts = field["first"].take(pa.array(at)) if first else pa.nulls(n, field["first"].type)
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(whose), part.column("text_key").take(whose), *of_window, *mine, firsts], [f.split()[0] for f in WINDOWS.split(", ")])

    spans = np.flatnonzero(is_span)
    if len(spans):
        yield rows(spans, None, start_at[spans], end_at[spans], w0[spans], w1[spans], True)
    others = np.zeros(len(words.hash), bool)  # windows of units; several may ask for one
    for mask, before in ((left, True), (right, False)):
        k, at = np.nonzero(mask[None] >> np.arange(2 * WINDOW + 1)[:, None] & 1)
        b = w0[at] - k if before else w1[at] + k - size
        ok = (b >= first_word[doc[at]]) & (b + size <= last_word[doc[at]])
        at, k, b = at[ok], k[ok], b[ok]
        others[b[~is_span[at]]] = True
        at, k, b = (x[is_span[at]] for x in (at, k, b))
        if len(at):
            yield rows(at, b, begins[b] if before else start_at[at], end_at[at] if before else ends[b + size - 1], w0[at] - k * before, w1[at] + k * (not before), False)
    b = np.flatnonzero(others)
    if len(b):
        at = np.searchsorted(doc, words.doc[b])  # any row of the text that asks; doc is in order
        yield rows(at, b, begins[b], begins[b], b, b, False, False)


def widened(df: DataFrame, runs: DataFrame, spans: DataFrame, column: str, key: str, ids_repeat: bool, size: int) -> DataFrame:
    """(doc_id, text_key, start_at, end_at, n_words, first): the spans with the words at their ends that stand in `size`
    words in a row which occur earlier. What such words repeat has one of the units near the span's end too, so the windows
    about all occurrences of these units are compared. Spans that then overlap are one."""
    units = runs.where("_long and (left | right) != 0").groupBy("d1", "d2").agg(F.bit_or("left").alias("left"), F.bit_or("right").alias("right"), F.first("n_words").alias("n_words"), F.first("first").alias("first"))
    units = materialise(units, "ends")
    other = [F.lit(None).cast("int").alias("end_at"), "n_words", F.lit(False).alias("is_span"), "left", "right", F.lit(None).cast(runs.schema["first"].dataType).alias("first")]
    bits = lambda most: F.when(F.col("long"), F.lit((2 << most) - 2)).otherwise(0)
    own = spans.select("doc_id", "text_key", "start_at", "end_at", F.lit(None).cast("int").alias("n_words"), F.lit(True).alias("is_span"), bits(WINDOW - 1).alias("left"), bits(WINDOW).alias("right"), "first")
    at_first = units.select("first.*", *other)
    elsewhere = runs.select("doc_id", "text_key", "start_at", "d1", "d2").join(units.drop("first"), ["d1", "d2"]).select("doc_id", "text_key", "start_at", *other)
    asked = own.unionByName(at_first).unionByName(elsewhere).groupBy(F.col("doc_id").alias("k"), F.col("text_key").alias("t")).agg(F.collect_list(F.struct(*_ASKED)).alias("asked"))
    text_key = F.xxhash64(column) if ids_repeat else F.lit(0).cast("bigint")
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), column, text_key.alias("text_key"))
    joined = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("text_key") == F.col("t"))).drop("k", "t")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield from _edge_windows(part, column, size)

    windows = materialise(joined.mapInArrow(run, WINDOWS), "windows")
    place = F.struct("doc_id", "text_key", "w", "at")
    earliest = windows.where("h1 is not null").groupBy("h1", "h2").agg(F.min(place).alias("earliest"))
    same_text = F.col("earliest.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("earliest.text_key") == F.col("text_key"))
    # in one text, words that overlap what they repeat stay
    found = windows.where("h1 is not null and span is not null").join(earliest, ["h1", "h2"]).where(~same_text | (F.col("earliest.w") + size <= F.col("w")))
    before = F.struct(F.col("earliest.doc_id").alias("doc_id"), F.col("earliest.text_key").alias("text_key"), F.col("earliest.at").alias("start_at"))
    found = found.withColumn("first", F.when(F.col("start_at") < F.col("span"), before))
    columns = ["doc_id", "text_key", "span", "start_at", "end_at", "w0", "w1", "first"]
    wide = windows.where("h1 is null").select(*columns).unionByName(found.select(*columns)).groupBy("doc_id", "text_key", "span").agg(
        F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.min("w0").alias("w0"), F.max("w1").alias("w1"),
        F.min_by("first", F.when(F.col("first").isNotNull(), F.col("w0"))).alias("first"),
    )
    order = Window.partitionBy("doc_id", "text_key").orderBy("w0", "w1")
    apart = F.col("w0") >= F.coalesce(F.max("w1").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    islands = wide.withColumn("_apart", apart.cast("int")).withColumn("_island", F.sum("_apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = islands.groupBy("doc_id", "text_key", "_island").agg(
        F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), (F.max("w1") - F.min("w0")).cast("int").alias("n_words"), F.min_by("first", F.struct("w0", "w1")).alias("first")
    )
    out = materialise(out.drop("_island"), "widened")
    discard(units, windows)
    return out


def remove_spans(df: DataFrame, spans: DataFrame, column: str = "text", key: str = "doc_id", changed: bool = False) -> DataFrame:
    """df with its spans cut out of the text, and `kept`: the (start, end) of what stays, in the original text. With
    `changed`, only the rows that lose text, and also `spans` (start_at, end_at, first occurrence), `n_spans` and
    `n_words` of what goes. A row's own spans are found by id, text and copy, so rows of equal or no id don't mix."""
    own = {n: free_name(df, n) for n in ("cuts", "text_key", "copy")}
    repeats = spans.agg(F.max(F.greatest("copy", (F.col("text_key") != 0).cast("int")))).first()[0]  # 0, 1 or none
    rows = df.withColumn(own["text_key"], F.xxhash64(column) if repeats else F.lit(0).cast("bigint"))
    if repeats:  # number the rows that are equal in id and text; others have a group of their own
        rows = rows.withColumn(own["copy"], F.row_number().over(Window.partitionBy(key, own["text_key"]).orderBy(F.lit(0))) - 1)
    else:
        rows = rows.withColumn(own["copy"], F.lit(0))
    gone = F.array_sort(F.collect_list(F.struct("start_at", "end_at", f"first_{key}", "first_start")))
    cuts = spans.groupBy(F.col(key).alias("k"), F.col("text_key").alias("t"), F.col("copy").alias("c")).agg(gone.alias(own["cuts"]), F.sum("n_words").alias("w"))
    joined = rows.join(cuts, F.col(key).eqNullSafe(F.col("k")) & (F.col(own["text_key"]) == F.col("t")) & (F.col(own["copy"]) == F.col("c")), "inner" if changed else "left")
    at = lambda end: F.coalesce(F.transform(own["cuts"], lambda s: s[end]), F.array().cast("array<int>"))
    size = F.length(F.coalesce(column, F.lit("")))
    kept = F.filter(F.zip_with(F.concat(F.array(F.lit(0)), at("end_at")), F.concat(at("start_at"), F.array(size)), lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda s: s.start < s.end)
    text = F.array_join(F.transform(kept, lambda s: F.substring(F.col(column), s.start + 1, s.end - s.start)), "")
    out = joined.select("*", kept.alias(f"{own['cuts']}_kept"), F.when(F.col(column).isNotNull(), text).alias(f"{own['cuts']}_text"))
    new = {column: F.col(f"{own['cuts']}_text").alias(column)}
    added = {"kept": F.col(f"{own['cuts']}_kept")}
    if changed:
        added |= {"spans": F.col(own["cuts"]), "n_spans": F.size(own["cuts"]).cast("bigint"), "n_words": F.col("w")}
    return out.select(*(new.get(c, F.col(f"`{c}`")) for c in df.columns if c.lower() not in added), *(v.alias(k) for k, v in added.items()))
