"""Extractive shortening of texts: sentences ranked by centrality, place, density and novelty, within a token budget."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Weights of centrality, place, density and novelty.
WEIGHTS = (0.20, 0.40, 0.35, 0.05)
#: The most terms of a text that are looked at, the most frequent ones.
MOST_TERMS = 20_000
_TERM = re.compile(r"\b\w\w+\b")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def _z(x: np.ndarray) -> np.ndarray:
    return (x - x.mean()) / (x.std() or 1.0)


def sentences_of(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE_END.split(text) if s.strip()] or [text.strip()]


def term_weights(sentences: list[str], stop_words: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(sentence, term, weight, number of terms): TF-IDF of each sentence's terms, at unit length by sentence."""
    words = [[w for w in _TERM.findall(s.lower()) if w not in stop_words] for s in sentences]
    all_words, sentence = [w for ws in words for w in ws], np.repeat(np.arange(len(words)), [len(ws) for ws in words])
    if not all_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    names, term = np.unique(np.array(all_words), return_inverse=True)
    if len(names) > MOST_TERMS:
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(-np.bincount(term), kind="stable")] = np.arange(len(names))
        kept = rank[term] < MOST_TERMS
        sentence, term = sentence[kept], rank[term[kept]]
    n_terms = int(term.max()) + 1
    pair, count = np.unique(sentence * n_terms + term, return_counts=True)
    sentence, term = pair // n_terms, pair % n_terms
    idf = np.log((1 + len(sentences)) / (1 + np.bincount(term, minlength=n_terms))) + 1
    weight = count * idf[term]
    length = np.sqrt(np.bincount(sentence, weight**2, len(sentences)))
    return sentence, term, weight / length[sentence], n_terms


def sentence_scores(sentences: list[str], stop_words: frozenset[str], weights: Sequence[float] = WEIGHTS, damping: float = 0.85, rounds: int = 30) -> np.ndarray | None:
    """The weighted sum of four z-scores: rank in the graph of cosines, nearness to the text's ends, sum of term
    weights, and distance from the other sentences. None for sentences without terms. The matrix of cosines is never
    built: its products are two of the term weights, so memory is in proportion to the text."""
    sentence, term, weight, n_terms = term_weights(sentences, stop_words)
    if not n_terms:
        return None
    n = len(sentences)
    own = np.bincount(sentence, weight**2, n)  # of a sentence with itself: 1, or 0 without terms
    cosines = lambda r: np.bincount(sentence, weight * np.bincount(term, weight * r[sentence], n_terms)[term], n)
    others = lambda r: cosines(r) - own * r
    sums = others(np.ones(n))
    sums[sums < 1e-12] = 1.0
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        rank = (1 - damping) / n + damping * others(rank / sums)
    place = np.arange(n) / max(1, n - 1)
    ends = 0.5 + 2 * (place - 0.5) ** 2
    mean = cosines(np.ones(n)) / n
    novelty = 1 - (mean - mean.min()) / (np.ptp(mean) or 1.0)
    return sum(w * _z(x) for w, x in zip(weights, (rank, ends, np.bincount(sentence, weight, n), novelty), strict=True))


def shortened(text: str, budget: int, count: Callable[[str], int], stop_words: frozenset[str]) -> str:
    """The best sentences that fit into the budget, in their order; a text of under three sentences, or one that fits,
    stays as it is."""
    sentences = sentences_of(text)
    if len(sentences) < 3 or count(text) <= budget:
        return text
    score = sentence_scores(sentences, stop_words)
    if score is None:
        return text
    kept, used = [], 0
    for k in np.argsort(-score, kind="stable"):
        size = count(sentences[k])
        if used + size > budget and kept:
            continue
        kept.append(k)
        used += size
        if used >= budget:
            break
    return " ".join(sentences[k] for k in sorted(kept))


def words_of(text: str) -> int:
    return len(text.split())


def compress(rows: DataFrame, budget: int = 256, count: Callable[[str], int] = words_of, stop_words: Sequence[str] | None = None, column: str = "text") -> DataFrame:
    """Add `short`; NULL stays NULL. count should be the tokenizer's of the model that reads the text. stop_words are
    those of Spark's English list unless given."""
    if stop_words is None:
        from pyspark.ml.feature import StopWordsRemover

        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    known = frozenset(stop_words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(short=[None if t is None else shortened(t, budget, count, known) for t in pdf[column]])

    return rows.drop("short").mapInPandas(run, T.StructType([*(f for f in rows.schema.fields if f.name != "short"), T.StructField("short", T.StringType())]))
