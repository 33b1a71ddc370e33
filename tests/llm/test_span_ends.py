"""Ends of repeated passages against brute force: every word of 51 in a row that occur earlier goes, wherever they begin and end."""

import random

import numpy as np
import pytest

from gaugeworks.llm import substring
from tests.llm.test_operators import SPACE, prose

SIZE = substring.MIN_WORDS + 2 * substring.WINDOW - 1


def brute(rows):
    """The places of words that stand in SIZE words in a row whose earliest occurrence ends before they begin."""
    seen, gone = {}, {}
    for i, t in rows:
        words = [(m.start(), m[0].lower()) for m in SPACE.finditer(t)]
        gone[i] = set()
        for k in range(len(words) - SIZE + 1):
            j, at = seen.setdefault(tuple(w for _, w in words[k : k + SIZE]), (i, k))
            if j != i or at + SIZE <= k:
                gone[i] |= {a for a, _ in words[k : k + SIZE]}
    return gone


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    own = lambda n: prose(n, r.randint(1000, 10**6)).split()
    passages = [own(n) for n in (51, 52, 60, 75, 140)]
    common = [own(n) for n in (2, 3, 5)]  # short parts that stand everywhere, also right before and after passages
    out = []
    for i in range(60):
        words = own(r.randint(0, 30))
        for _ in range(r.randint(1, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) - 51)
            words += [*r.choice(common), *p[a : a + r.randint(51, len(p))], *r.choice(common), *own(r.randint(0, 30))]
        out.append((i, " ".join(w + ("\n" if w.endswith("a") and len(w) > 6 else "") for w in words).replace("\n ", "\n")))
    return [*out, (60, "la " * 150), (61, "one two la " * 70 + " ".join(own(20)))]


def test_no_word_of_a_repeat_stays(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = substring.repeated_spans(docs).collect()
    want, texts = brute(rows), dict(rows)
    assert sum(map(len, want.values())) > 1000
    for i, t in rows:
        spans = sorted((s for s in got if s.doc_id == i), key=lambda s: s.start_at)
        words = [(m.start(), m.end()) for m in SPACE.finditer(t)]
        covered = {a for a, b in words if any(s.start_at <= a and b <= s.end_at for s in spans)}
        assert want[i] <= covered
        assert all(a.end_at <= b.start_at for a, b in zip(spans, spans[1:], strict=False))
        for s in spans:
            cut = t[s.start_at : s.end_at]
            assert s.n_words == len(cut.split()) and cut == cut.strip()
            assert (s.first_doc_id, s.first_start) < (i, s.start_at)
            # what a span begins with stands where it is said to stand first
            assert texts[s.first_doc_id][s.first_start :].split()[0].lower() == cut.split()[0].lower()


def test_ends_that_another_copy_than_the_first_has(spark):
    """The first copy stands in other words; the third shares more with the second, and what they share goes."""
    p, before, after = prose(60, 1), prose(9, 2), prose(10, 3)
    rows = [(1, f"{prose(20, 4)} {p} {prose(20, 5)}"), (2, f"{prose(20, 6)} {before} {p} {after} {prose(20, 7)}"), (3, f"{prose(20, 8)} {before} {p} {after} {prose(20, 9)}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    out = {r.doc_id: " ".join(r.text.split()) for r in substring.remove_spans(docs, substring.repeated_spans(docs)).collect()}
    assert out[2] == f"{prose(20, 6)} {before} {after} {prose(20, 7)}"
    assert out[3] == f"{prose(20, 8)} {prose(20, 9)}"


@pytest.mark.parametrize("size", [1, 2, 3, 51])
def test_hashes_of_windows(size):
    r = np.random.default_rng(3)
    words = r.integers(0, 2, 200 + size).astype(np.uint64)
    h = substring.window_hashes(words, size).tolist()
    windows = [tuple(words[k : k + size].tolist()) for k in range(len(words) - size + 1)]
    assert len(h) == len(windows) and len(set(h)) == len(set(windows)) == len(set(zip(h, windows, strict=True)))
    assert not len(substring.window_hashes(words[: size - 1], size))
