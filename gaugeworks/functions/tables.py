"""Functions for SQL that give the parts of a text, to be exploded laterally:

    SELECT doc_id, at, segment FROM (SELECT doc_id, segments_of(text) AS parts FROM documents) LATERAL VIEW posexplode(parts) s AS at, segment

They are SQL themselves and give arrays, which Spark takes into the plan of the query: one pass over the rows, no Python. (A
function that returns a table is planned as a join of all distinct texts with the rows, which shuffles the texts; and Spark
takes no function of SQL inside LATERAL VIEW itself.)
"""

from __future__ import annotations

from pyspark.sql import SparkSession

LEAST, MOST = 80, 6

_TRIMMED = r"regexp_replace({0}, r'^\s+|\s+$', '')"
_QUOTED = rf"""transform(regexp_extract_all(t, r'"[^"]{{{LEAST},}}"|“[^”]{{{LEAST},}}”', 0), s -> {_TRIMMED.format("substring(s, 2, length(s) - 2)")})"""
_PARTS = rf"""filter(transform(split(t, r'\n\s*\n'), s -> {_TRIMMED.format("s")}), s -> length(s) >= {LEAST})"""

#: The same rules as the column functions of functions/text.py.
BODIES = {
    "sentences_of": r"filter(transform(split(t, r'(?<=[.!?])\s+|\n+'), s -> trim(s)), s -> s != '')",
    "segments_of": f"concat(array(t), slice(CASE WHEN size({_QUOTED}) > 0 THEN filter({_QUOTED}, s -> length(s) >= {LEAST}) ELSE {_PARTS} END, 1, {MOST}))",
}


def register_tables(spark: SparkSession) -> list[str]:
    """Make sentences_of(t) and segments_of(t) callable from SQL."""
    for name, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS ARRAY<STRING> RETURN {body}")
    return list(BODIES)
