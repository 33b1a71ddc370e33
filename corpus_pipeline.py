"""From raw documents to token ids: quality, near-duplicates, decontamination, personal data, byte-level BPE.

Each stage takes documents (doc_id, text, lang, source, n_chars, in any order and with more columns if there are any)
and works on all that its predecessor kept; all but the last return the same columns. In every stage an empty table
gives an empty table, and extra columns are kept, whatever their names, by all stages but the last."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, decontaminate, minhash, pii, quality
from gaugeworks.llm.common import discard, free_name, kept_columns, materialise, stored_alone, table
from gaugeworks.llm.queries import PII_KEY


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It is fitted on the labelled ones among docs.

    Null and empty texts get the share of good labels and stay if that is a half or more; equal texts are judged alike;
    a null doc_id has no label, and its text is judged as any other; without usable labels all documents stay."""
    score = free_name(docs, "quality")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, out=score).where(F.col(score) >= 0.5).select(*kept_columns(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of near-duplicates.

    Documents without words, null texts among them, are nobody's duplicates and all stay. Rows of equal doc_id are
    documents of their own: rows are then numbered by doc_id (null last) and text, and the first of a group stays, so
    that of rows stored twice one does."""
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    key = "doc_id"
    if not again.isEmpty():
        key = free_name(docs, "row")
        ranked = docs.repartitionByRange(F.asc_nulls_last("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_last("doc_id"), F.xxhash64("text"))
        docs = materialise(ranked.withColumn(key, F.monotonically_increasing_id()), "numbered")
    kept = minhash.near_duplicates(docs.select(key, "text"), key=key).where("kept").select(key)
    out = docs.join(kept, key, "left_semi")
    return out.select(*kept_columns(docs, *([] if key == "doc_id" else [key])))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; equal texts stay or go together; ids
    don't matter; without items all documents stay."""
    hits = free_name(docs, "hits")
    found = decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), out=hits)
    return found.where(F.size(hits) == 0).select(*kept_columns(docs))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data; n_chars follows the text, and is null where that is.
    Equal texts get equal surrogates; ids don't matter."""
    out = pii.replace_pii(docs, PII_KEY, found=free_name(docs, "found"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*kept_columns(docs))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (packed little-endian unsigned 32-bit integers), and the digest of what they decode
    to. A row for each row: null and empty texts have no ids, repeated rows and null doc_ids stay."""
    coded = bpe.bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("PII", replace_personal_data),
    ("byte-level BPE", to_token_ids),
]

#: The classifier, the components and the tokeniser are beyond SQL; tests/llm holds run() against a brute-force
#: pipeline on a small fixture, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored_alone(lambda: stage(spark, docs, sf_dir), "stage")  # noqa: B023
        if hasattr(before, "stored_at"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
