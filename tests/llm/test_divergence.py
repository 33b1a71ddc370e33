"""Source divergence against brute force: awkward rows, blocks, tiles, languages without terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gaugeworks.llm import divergence
from tests.llm.test_operators import LONG, TEXTS

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def brute(rows, least, top=50):
    counts, whole, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = terms_of(text)
        counts[lang, source].update(found)
        whole[lang].update(found)
        docs[lang].update(set(found))
    kept = {lang: [t for t, n in docs[lang].items() if n >= least] for lang, _ in groups}

    def p_of(c, lang):
        n = sum(c[t] for t in kept[lang])
        return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept[lang])) for t in kept[lang]}

    own = {g: p_of(counts[g], g[0]) for g in groups}
    out = set()
    for lang, source in groups:
        p, q = own[lang, source], p_of(whole[lang], lang)
        pairs = [(-sum(abs(p[t] - own[g][t]) for t in kept[lang]), g[1].encode(), g[1]) for g in groups if g[0] == lang and g[1] != source]
        terms = [(q[t] - p[t], t.encode(), t) for t in kept[lang] if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item, -value, k) for k, (value, _, item) in enumerate(found, 1)}
    return out


def found(spark, rows, **settings):
    df = spark.createDataFrame([(t, x, s, 1, "n") for t, x, s in rows], "text string, lang string, source string, n int, term string").repartition(3)
    got = divergence.source_divergence(df, **settings)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = got.collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdéüñ") for _ in range(r.randint(1, 5))) for _ in range(900)]
    weights = [1 / (k + 1) for k in range(900)]
    out = []
    for k in range(400):
        words = r.choices(vocabulary, weights, k=r.randint(0, 80))
        out.append((r.choice((" ", ", ", "1\n", "_")).join(w.upper() if r.random() < 0.1 else w for w in words), ("en", "de", None, "tiny")[min(k % 7, 3)] if k % 7 < 4 else "en", ("a", "b", "", None, "ß", "c")[k % 6]))
    return [*out, *((t, "en", "a") for t in TEXTS if t is not LONG), ("ÀÉ K ſ word", "lone", "one"), (None, None, None), ("", "en", "only empty")]


@pytest.mark.parametrize("least", [30, 5, 1])
def test_all_rows_of_a_small_table(spark, rows, least):
    assert found(spark, rows, least=least) == brute(rows, least)


def test_blocks_and_tiles_of_any_size(spark, rows):
    assert found(spark, rows, least=2, tile=2, top=3, block=64) == brute(rows, 2, 3)


@pytest.mark.parametrize("tile", [64, 3])
def test_blocks_whose_sources_come_in_any_order(spark, rows, tile):
    """Joins that shuffle leave each block's sources in an order of its own."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert found(spark, rows, least=2, tile=tile, block=64) == brute(rows, 2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_many_sources_and_one_very_long_text(spark):
    r = random.Random(1)
    rows = [(" ".join(r.choice(("ab", "cd", "ef", "g")) for _ in range(r.randint(1, 9))), "x", f"s{k}") for k in range(150)] + [(LONG, "x", "s0")] * 2
    assert found(spark, rows, least=2) == brute(rows, 2)


def test_tables_without_rows_and_without_terms(spark):
    assert found(spark, []) == set()
    rows = [("1 2 3", "en", "a"), (None, "en", "b"), ("!", "fr", "a")]
    assert found(spark, rows) == brute(rows, 30) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


@pytest.mark.parametrize("held", [1, 64, 1 << 20])
def test_joint_cells_are_those_of_plain_counts(monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    r = np.random.default_rng(2)
    counts = r.integers(0, 4, (3, 500))
    p = [{c: int(r.integers(1, 10**9)) for c in range(4)} for _ in range(3)]
    groups = []
    for row, own in zip(counts, p, strict=True):
        levels = [c for c in (1, 2, 3) if (row == c).any()]
        bits = np.zeros((len(levels), divergence.BLOCK), np.uint8)
        for k, c in enumerate(levels):
            bits[k, :500] = row == c
        groups.append((np.array([own[c] for c in levels]), own[0], np.packbits(bits, axis=1, bitorder="little").view("<u8")))
    for i, j, value in divergence.joint_divergence(500, groups, groups, True):
        assert value == sum(abs(p[i][a] - p[j][b]) for a, b in zip(counts[i], counts[j], strict=True))


def test_words_of_packed_texts():
    texts = ["", "Ab", "cd e", "é1É", "--", "x"]
    raw = [t.encode() for t in texts]
    terms, doc = divergence.words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert list(zip(terms.to_pylist(), doc.tolist(), strict=True)) == [(w, k) for k, t in enumerate(texts) for w in terms_of(t)]
    assert isinstance(terms, pa.LargeStringArray)
