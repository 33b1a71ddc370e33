"""Document fingerprints: canonical exact digests.

Method: a text is brought to compatibility composition (NFKC), full case folding and single spaces; two salted 64-bit
xxhash digests of that form make a bucket; where a bucket has more than one row, the forms themselves are compared
byte by byte, and a bucket of several forms gives each a number of its own. All of it is DataFrame functions; the
normaliser and case folder are those of the ICU library that Spark brings for its collations.

Defined results: null and empty texts are one and the same empty form; white space is what Unicode calls so; rows of
equal doc_id have one place in the ring of documents; rows without a doc_id have no
place in it and no row in edited_fingerprints; an empty table gives an empty table; other columns are kept by
with_fingerprints, whatever their names, unless named `fingerprint`, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import free_name, kept_columns, materialise, text_or_empty


def canonical(text: Column) -> Column:
    """NFKC, case-folded, NFKC again, white space folded to single spaces and trimmed."""
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = compose(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def bucket(form: Column, bits: int = 128) -> Column:
    """Two digests of a canonical form. Fewer bits than 128 are for tests of what follows a collision."""
    parts = [F.xxhash64(F.lit(salt), form) for salt in ("first", "second")]
    if bits < 128:
        parts = [F.pmod(parts[0], F.lit(1 << bits)), F.lit(0).cast("bigint")]
    return F.struct(parts[0].alias("h1"), parts[1].alias("h2"))


def text_of(h: Column, variant: Column) -> Column:
    half = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(half(h.h1), half(h.h2), F.when(variant > 0, F.concat(F.lit("-"), variant.cast("string"))).otherwise(F.lit("")))


def collisions(forms: DataFrame) -> DataFrame:
    """(h, form, variant) of the forms of buckets that hold several, in forms (h, form); variant 0 is left out.

    Equal forms meet in the partial aggregation, so that a group of copies costs a row for each task."""
    distinct = forms.groupBy("h", "form").agg(F.count(F.lit(1)).alias("n")).drop("n")
    shared = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    several = distinct.join(shared, "h", "left_semi")
    numbered = several.withColumn("variant", F.row_number().over(Window.partitionBy("h").orderBy("form")) - 1)
    return materialise(numbered.where("variant > 0"), "collisions")


def with_fingerprints(df: DataFrame, column: str = "text", bits: int = 128) -> DataFrame:
    """Add `fingerprint`: equal for texts of equal canonical form and for no others."""
    form, h, variant = (free_name(df, n) for n in ("form", "h", "variant"))
    rows = df.select(*kept_columns(df, "fingerprint")).withColumn(form, canonical(text_or_empty(column))).withColumn(h, bucket(F.col(form), bits))
    shared = rows.groupBy(h).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(h)
    found = collisions(rows.join(shared, h, "left_semi").select(F.col(h).alias("h"), F.col(form).alias("form")))
    if found.isEmpty():
        return rows.select(*kept_columns(df, "fingerprint"), text_of(F.col(h), F.lit(0)).alias("fingerprint"))
    rows = rows.join(found.toDF(h, form, variant), [h, form], "left")
    return rows.select(*kept_columns(df, "fingerprint"), text_of(F.col(h), F.coalesce(variant, F.lit(0))).alias("fingerprint"))


# ---- each document and its successor ------------------------------------------------------------------------


def successors(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, next_id): the documents in a ring by ascending doc_id. Ids alone are sorted and shuffled."""
    ids = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.length(text_or_empty(column))).alias("n"))
    ranged = ids.repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id())
    ring = materialise(ranged, "ring")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.part: r.n for r in ring.groupBy(part.cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    ranked = ring.select(key, "n", (F.element_at(F.lit(before or [0]), part.cast("int") + 1) + place).alias("rank"))
    after = ranked.select(F.col(key).alias("next_id"), F.pmod(F.col("rank") - 1, F.lit(max(total, 1))).alias("rank"))
    return ranked.join(after, "rank").select(key, F.col("n").alias("n_chars"), "next_id")


def edited(df: DataFrame, ring: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text, edited) of the documents in ring: the last quarter of each text replaced by as much of the
    beginning of the next document. Whole texts are shuffled once, by doc_id; beginnings go to their predecessor."""
    texts = df.select(key, text_or_empty(column).alias("text"))
    take = F.floor(F.col("n_chars") / 4).cast("int")
    wanted = ring.select(F.col("next_id").alias(key), F.col(key).alias("_before"), take.alias("_take"))
    heads = texts.join(wanted, key).select(F.col("_before").alias(key), F.expr("substring(text, 1, _take)").alias("head"))
    heads = heads.groupBy(key).agg(F.min("head").alias("head"))
    size = F.length("text")
    text = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("substring(head, 1, cast(floor(length(text) / 4) as int))"))
    return texts.join(heads, key).select(key, "text", size.cast("long").alias("n_chars"), text.alias("edited"))


def edited_fingerprints(df: DataFrame, column: str = "text", key: str = "doc_id", bits: int = 128) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document with
    an id; the likeness of two exact digests is 1 if they are equal, else 0."""
    ring = materialise(successors(df, column, key), "successors")
    form = canonical(F.col("text"))
    edited_form = canonical(F.col("edited"))
    rows = edited(df, ring, column, key).select(key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), bucket(form, bits).alias("h"), bucket(edited_form, bits).alias("eh"))
    rows = materialise(rows, "digests")
    all_of = rows.select(key, "h").unionByName(rows.select(key, F.col("eh").alias("h")))
    shared = materialise(all_of.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "shared")
    compare = rows.join(shared, "h", "left_semi").select(key).unionByName(rows.join(shared.toDF("eh"), "eh", "left_semi").select(key)).distinct()
    again = edited(df, ring.join(compare, key, "left_semi"), column, key)
    forms = again.select(F.explode(F.array(form, edited_form)).alias("form")).select(bucket(F.col("form"), bits).alias("h"), "form")
    found = collisions(forms.join(shared, "h", "left_semi") if bits == 128 else forms)
    if found.isEmpty():
        named = rows.select(key, "n_chars", "edited_sha256", text_of(F.col("h"), F.lit(0)).alias("fingerprint"), text_of(F.col("eh"), F.lit(0)).alias("edited_fingerprint"))
    else:
        forms = edited(df, ring, column, key).select(key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), form.alias("form"), edited_form.alias("eform"))
        forms = forms.withColumns({"h": bucket(F.col("form"), bits), "eh": bucket(F.col("eform"), bits)})
        forms = forms.join(found, ["h", "form"], "left").join(found.toDF("eh", "eform", "evariant"), ["eh", "eform"], "left")
        variant = lambda c: F.coalesce(c, F.lit(0))
        named = forms.select(key, "n_chars", "edited_sha256", text_of(F.col("h"), variant("variant")).alias("fingerprint"), text_of(F.col("eh"), variant("evariant")).alias("edited_fingerprint"))
    following = named.groupBy(F.col(key).alias("next_id")).agg(F.min("fingerprint").alias("next_fingerprint"))
    out = named.join(ring.select(key, "next_id"), key).join(following, "next_id")
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return out.select(*named.columns, like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
