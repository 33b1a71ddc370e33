"""Text keys and segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(t: Column) -> Column:
    """Lower case, trimmed, white space (as Unicode has it) collapsed."""
    return F.trim(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))


def normal_ascii(t: Column) -> Column:
    """The same for ASCII white space alone, which SQL engines agree on."""
    return F.trim(F.regexp_replace(F.lower(t), "[ \\t\\n\\r\\f\\x0B]+", " "))


def key(t: Column) -> Column:
    """Equal for texts of equal normal form."""
    return F.md5(normal_ascii(t))


def word_count(t: Column) -> Column:
    return F.size(F.filter(F.split(t, r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))


def newlines(t: Column) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))


def sentences(t: Column) -> Column:
    """Cut after . ! or ? before white space, and at line ends; trimmed, none empty."""
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def quoted_spans(t: Column, least: int = 80) -> Column:
    """What stands in straight or curly quotes, if it is long enough, trimmed, in the order of the text."""
    found = F.regexp_extract_all(t, F.lit(f'"[^"]{{{least},}}"|“[^”]{{{least},}}”'), F.lit(0))
    return F.transform(found, lambda s: F.regexp_replace(F.substring(s, F.lit(2), F.length(s) - 2), r"^\s+|\s+$", ""))


def paragraphs(t: Column, least: int = 80, most: int = 6) -> Column:
    parts = F.filter(F.transform(F.split(t, r"\n\s*\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) >= least)
    return F.slice(parts, 1, most)


def segments(t: Column, least: int = 80, most: int = 6) -> Column:
    """The whole text, then its first quoted spans, or its first paragraphs if it quotes nothing."""
    quoted = F.slice(F.filter(quoted_spans(t, least), lambda s: F.length(s) >= least), 1, most)
    return F.concat(F.array(t), F.when(F.size(quoted_spans(t, least)) > 0, quoted).otherwise(paragraphs(t, least, most)))


def hash_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone, the same in every engine with md5."""
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_order(*parts: Column | str) -> Column:
    """What stands in for a seeded shuffle: sort by it."""
    return F.md5(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))


def capped(t: Column, most: int) -> Column:
    """The first characters, for what goes into a prompt or a log."""
    return F.left(t, F.lit(most))


def scheme_of(uri: Column) -> Column:
    """What stands before ://, in lower case; empty where nothing does."""
    return F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def level_of(metric: Column) -> Column:
    """The number after the @ of a metric's name; NULL without one."""
    return F.try_to_number(F.nullif(F.regexp_extract(metric, r"@([0-9]*\.?[0-9]+)$", 1), F.lit("")), F.lit("9.999999")).cast("double")
