"""Hashes of words, and what rests on them: texts that differ are never taken as equal; rows of equal or no id stay apart."""

from collections import Counter

import numpy as np
import pytest

from gaugeworks.llm import minhash, queries, substring
from gaugeworks.llm.common import Words
from tests.llm.test_operators import prose


def thue_morse(n, first="a", second="b"):
    return "".join((first, second)[k.bit_count() % 2] for k in range(n))


@pytest.mark.parametrize("size", [1024, 4096, 65536])
def test_words_that_polynomials_confuse(size):
    raw = f"{thue_morse(size)} {thue_morse(size, 'b', 'a')} {thue_morse(size)}".encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    for seed in (0, 1):
        h = words.hashed(words.lowered, seed)
        assert h[0] == h[2] != h[1]


def test_hashes_depend_on_every_byte_and_on_nothing_else():
    base = "abcdefghijklmnopqrstuvwxyz0123456789" * 4
    texts = [base[:n] for n in range(1, 140)] + [base[:k] + "#" + base[k + 1 : n] for n in (1, 7, 8, 9, 16, 63, 64, 65, 130) for k in range(n)]
    raw = " ".join(texts).encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    first, second = (words.hashed(words.lowered, s) for s in (0, 1))
    assert len(set(first.tolist())) == len(set(second.tolist())) == len(set(texts))
    assert not set(first.tolist()) & set(second.tolist())
    for t, h in zip(texts[::7], first[::7], strict=True):  # wherever a word stands
        own = f"xyz  {t.upper()}\t".encode()
        assert Words(np.frombuffer(own, np.uint8), np.array([0, len(own)])).hash[1] == h


@pytest.mark.parametrize("size", [1024, 65536])
def test_texts_that_differ_in_such_words_stay(spark, size):
    a, b = thue_morse(size), thue_morse(size, "b", "a")
    rest = prose(40, 5).split()
    of = lambda w: " ".join(x for r in rest for x in (r, w))
    rows = [(1, a), (2, b), (3, of(a)), (4, of(b)), (5, of(a)), (6, " ".join([a] * 5)), (7, " ".join([b] * 5))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    spans = {(r.doc_id, r.first_doc_id) for r in substring.repeated_spans(docs).collect()}
    assert {i for i, _ in spans if i not in (6, 7)} == {5} and (2, 1) not in spans and (4, 3) not in spans and (7, 6) not in spans
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 6: 6, 7: 7}


def test_query_of_rows_with_equal_and_no_ids(spark, tmp_path):
    """Against plain hashing of whole lines: every row that loses a line, with its own spans and none of another row."""
    line, own = prose(30, 40), lambda k: prose(30, 300 + k)
    rows = [(1, own(1)), (1, f"{own(2)}\n{line}"), (None, f"{line}\n{own(3)}"), (None, f"{own(4)}\n{line}"), (None, own(5)), (2, f"{line}\n{own(6)}"), (2, f"{line}\n{own(6)}"), (2, own(7)), (3, None), (3, None), (None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_substring_dedup(spark, str(tmp_path)).collect()
    texts = [t for _, t in rows if t]
    assert len([r for r in got if r.doc_id is None]) in (1, 2)  # the first of the two is kept, unless another's hash is less
    lost = Counter()
    for r in got:
        assert r.n_spans == len(r.spans) > 0
        source = [t for t in texts if "".join(t[s.start : s.end] for s in r.kept) == r.text and (line in t or not r.text) and all(0 <= s.start_at < s.end_at <= len(t) for s in r.spans)]
        assert source
        gone = [source[0][s.start_at : s.end_at] for s in r.spans]
        assert r.n_words == sum(len(x.split()) for x in gone)
        assert line not in r.text and (gone == [line] or r.text.strip() == "")
        lost[r.doc_id] += 1
    # five rows hold the line; one keeps it; of the two equal rows one goes whole
    assert sum(lost.values()) == 4 and lost[1] in (0, 1) and lost[2] in (1, 2)
    again = [r for r in got if r.doc_id == 2]
    assert any(not r.text.strip() for r in again)
