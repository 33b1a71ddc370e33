"""Secret scans by an inverted index of trigrams.

Method: each rule's regular expression is turned into a Boolean query of trigrams that every match must hold. Each
task indexes its documents block by block: a posting list per trigram that some query names. A rule's query
intersects (AND) and unites (OR) those lists, and the expression runs on the candidates alone. Rules without
mandatory trigrams scan all documents. The index of a block is complete for that block, so no row moves between
executors and memory is bounded by the block.

Defined results: null and empty texts have no spans; repeated rows give equal results; columns other than the text
are kept, unless named `found`, which is replaced; an empty table gives an empty table. Offsets are in code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugeworks.llm.common import packed, slices, texts_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to find, and the shortest a group of it may be."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def keeps(self, m: re.Match) -> bool:
        return m.end(self.group) - m.start(self.group) >= self.least


#: The three base kinds, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the longest runs of 16 or more are the runs of any length that are kept
)
#: Further public formats of keys and tokens. None takes more than linear time: what comes before a fixed
#: part has a bounded length, and no match begins inside a run that it would scan again.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("forge_token", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pay_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s:/@]++:[^\s:/@]{3,}+@[^\s/@]+"),
)

#: A Boolean query: True (anything may match), or a set of alternatives, each a set of trigrams that must all occur.
Query = bool | frozenset[frozenset[bytes]]
REPEATS = (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT)
#: Strings that an expression part may stand for, or None if they are too many to list.
MOST_STRINGS = 64


def _both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    both = frozenset(x | y for x in a for y in b)
    return both if len(both) <= MOST_STRINGS else a


def _either(queries: list[Query]) -> Query:
    return True if any(q is True for q in queries) else frozenset().union(*queries)


def _grams(text: str) -> Query:
    """The trigrams, in lower case, of one string that must occur."""
    raw = text.encode()
    got = frozenset(raw[k : k + 3] for k in range(len(raw) - 2))
    return frozenset([got]) if got else True


def _of_strings(strings: set[str]) -> Query:
    return _either([_grams(s) for s in strings])


def _strings(op, arg) -> set[str] | None:
    """All strings, in lower case, that one parsed element matches, if they are few."""
    if op is sre.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is sre.IN:
        if any(kind is not sre.LITERAL or x >= 128 for kind, x in arg):
            return None
        return {chr(x).lower() for _, x in arg}
    if op in REPEATS:
        low, high, inner = arg
        one = _sequence(inner)[0]
        if one is None or high is sre.MAXREPEAT or high > 2:
            return None
        out, now = set(), {""}
        for n in range(high + 1):
            out |= now if n >= low else set()
            now = {a + b for a in now for b in one}
        return out
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])[0]
    if op is sre.BRANCH:
        parts = [_sequence(x)[0] for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    return {""} if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT) else None


def _inner(op, arg) -> Query:
    """What must occur inside an element whose strings can't be listed."""
    if op in REPEATS:
        return _sequence(arg[2])[1] if arg[0] else True
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])[1]
    if op is sre.BRANCH:
        return _either([_sequence(x)[1] for x in arg[1]])
    return True


def _sequence(parsed) -> tuple[set[str] | None, Query]:
    """Strings of a whole sequence if they are few, and the query that each of its matches fulfils."""
    query: Query = True
    run: set[str] = {""}
    listed = True
    for op, arg in parsed:
        one = _strings(op, arg)
        if one is not None and len(run) * len(one) <= MOST_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        query = _both(query, _of_strings(run))
        listed = False
        if one is not None:
            run = one
        else:
            query, run = _both(query, _inner(op, arg)), {""}
    query = _both(query, _of_strings(run))
    return (run if listed else None), query


def trigram_query(pattern: str) -> Query:
    """The Boolean query of trigrams (bytes, A-Z as a-z) that each text with a match fulfils."""
    return _sequence(sre_parse.parse(pattern))[1]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Index:
    """Posting lists of one block of documents, for the trigrams that the rules' queries name."""

    def __init__(self, grams: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        low = _LOWER[data]
        self.n = len(offsets) - 1
        self.lists: dict[int, np.ndarray] = {}
        if len(low) < 3:
            return
        codes = low[:-2].astype(np.uint32) << 16 | low[1:-1].astype(np.uint32) << 8 | low[2:]
        wanted = np.zeros(1 << 24, bool)
        wanted[grams] = True
        at = np.flatnonzero(wanted[codes])
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[doc + 1]
        pairs = np.unique(codes[at[inside]].astype(np.int64) * self.n + doc[inside])
        gram, doc = pairs // self.n, pairs % self.n
        edges = np.flatnonzero(np.diff(gram, prepend=-1))
        self.lists = {int(gram[a]): doc[a:b] for a, b in zip(edges, [*edges[1:], len(gram)], strict=True)}

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        found = [self._all(sorted(code(g) for g in need)) for need in query]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def _all(self, need: list[int]) -> np.ndarray:
        lists = sorted((self.lists.get(g, np.empty(0, np.int64)) for g in need), key=len)
        got = lists[0]
        for other in lists[1:]:
            got = np.intersect1d(got, other, assume_unique=True)
        return got


def code(gram: bytes) -> int:
    return int.from_bytes(gram, "big")


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scanner(rules: tuple[Rule, ...]) -> Callable[[Iterable[pa.RecordBatch], str], Iterator[pa.RecordBatch]]:
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({code(g) for q in queries if q is not True for need in q for g in need})

    def scan(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        named = np.array(grams, np.int64)
        for batch in batches:
            for part in slices(batch, column):
                index = Index(named, *packed(part, column))
                texts = texts_of(part, column)
                spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
                for k, (rule, regex, query) in enumerate(zip(rules, compiled, queries, strict=True)):
                    for d in index.candidates(query).tolist():
                        spans[d] += [(m.start(), k, m.end()) for m in regex.finditer(texts[d]) if rule.keeps(m)]
                found = pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(s)] for s in spans], _ARROW_SPANS)
                kept = [n for n in part.schema.names if n not in (column, "found")]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), found], [*kept, "found"])

    return scan


def secret_spans(df: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, column: str = "text") -> DataFrame:
    """`found` instead of the text: kind, start and end of each match, by start and then by the order of the rules."""
    scan = scanner(rules)
    schema = T.StructType([f for f in df.schema.fields if f.name not in (column, "found")] + [T.StructField("found", SPANS)])
    return df.mapInArrow(lambda batches: scan(batches, column), schema)
