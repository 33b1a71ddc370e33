"""SentencePiece encoding that keeps offsets, and decoding.

Method: a text is normalised by the longest prefix that the model's compiled character map (a double-array trie over
UTF-8 bytes) has at each place, and each normalised byte is recorded with the place of the original bytes that it stands for.
Spaces become U+2581, one more goes before the text. The normalised text is merged pair by pair, the pair of highest score
first, the leftmost of equal ones, and every piece is projected back to bytes of the original.

Two neighbouring characters that no piece of the vocabulary holds side by side are never merged, so the text is cut
between them, and each distinct part is merged once and remembered: those of a batch as the rows of padded matrices, like
the pieces of byte-level BPE, and those in which pieces of equal score may meet one by one. Characters without a piece are
spelt in bytes.

Ids and decoded texts equal those of the sentencepiece library. `offsets` has one number more than `ids`: id k stands for
the original's bytes offsets[k] to offsets[k + 1]. Of a character spelt in bytes the last id has the span, those before it an
empty one; begin and end ids have empty spans.

Models must be of BPE type with bytes for unknown characters, without user-defined or unused pieces; others are refused.

Defined results: null and empty texts have the begin and end id alone; repeated rows give equal results; columns other
than the text are kept unless named `ids`, `offsets` or `decoded`, which are replaced; an empty table gives an empty table.
Texts are encoded whole, however long.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugeworks.llm.bpe import PairTable, merge_ids
from gaugeworks.llm.common import slices, texts_of

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Entries of a worker's memories of words and of their parts; at this count they start anew, which changes speed alone.
REMEMBERED = 500_000
#: Bytes of text whose new parts are merged together.
SLICE = 4 << 20


class CharMap:
    """The compiled character map: the size of the trie, its units, and the texts that its values point to."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.begins = re.compile(f"[{re.escape(''.join(sorted(self._first_characters())))}]") if self.units else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _child(self, node: int, byte: int) -> tuple[int, bool] | None:
        """The node that a byte leads to, and whether a key ends there."""
        at = node ^ byte
        if at >= len(self.units) or (self.units[at] & 0x800000FF) != byte:
            return None
        return at ^ self._offset(self.units[at]), bool(self.units[at] >> 8 & 1)

    def _first_characters(self) -> set[str]:
        found, todo = set(), [(b"", self._offset(self.units[0]))]
        while todo:
            raw, node = todo.pop()
            for byte in range(1, 256):
                if (step := self._child(node, byte)) is None:
                    continue
                longer = raw + bytes([byte])
                try:
                    found.add(longer.decode())
                except UnicodeDecodeError:
                    todo.append((longer, step[0]))
        return found

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest key at a place, and what it becomes."""
        node, best = self._offset(self.units[0]), None
        for k in range(at, len(raw)):
            if (step := self._child(node, raw[k])) is None:
                break
            node, ends = step
            if ends:
                value = self.units[node] & 0x7FFFFFFF
                best = k + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return best


class Model:
    """A model's vocabulary, its normaliser and its merges."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        kinds = [p.type for p in proto.pieces]
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or not {NORMAL, UNKNOWN, CONTROL, BYTE}.issuperset(kinds):
            raise ValueError("not a BPE model with bytes for unknown characters, or one with user-defined or unused pieces")
        if proto.trainer_spec.treat_whitespace_as_suffix or not proto.normalizer_spec.escape_whitespaces or proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("spaces after words, spaces that stay spaces and denormalisers aren't covered")
        spec = proto.normalizer_spec
        self.prefix, self.trims = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.score = {p.piece: (-p.score, k) for k, p in enumerate(proto.pieces) if p.type == NORMAL}
        named = {p.piece: k for k, p in enumerate(proto.pieces)}
        self.of_byte = [named[f"<0x{b:02X}>"] for b in range(256)]
        self.begin, self.end = named["<s>"], named["</s>"]
        self.together = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        joined = set("".join(self.together))
        # pieces hold spaces at their beginning only, or a text is one word
        inside = any(pair[1] == SPACE and pair[0] != SPACE for pair in self.together)
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in joined)
        single = f"[{alone}]|" if alone else ""
        self.words = re.compile("(?s).+" if inside else f"{single}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+").findall
        self.size = np.array([1 if p.type == BYTE else len(p.piece.encode()) if p.type == NORMAL else 0 for p in proto.pieces])
        byte = {k: b for b, k in enumerate(self.of_byte)}
        self.surface = [bytes([byte[k]]) if p.type == BYTE else b"" if p.type == CONTROL else p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else proto.trainer_spec.unk_surface.encode() for k, p in enumerate(proto.pieces)]
        self.is_byte = [p.type == BYTE for p in proto.pieces]
        self._rank_pieces()
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _rank_pieces(self) -> None:
        """Numbers for the matrices: pieces in the order of merging, then characters that are in pieces, but none."""
        order = sorted(self.score, key=self.score.__getitem__)
        number = {p: k for k, p in enumerate(order)}
        for c in sorted(set("".join(order)).difference(number)):
            number[c] = len(number)
        pairs = (x for p in order for k in range(1, len(p)) if p[:k] in number and p[k:] in number for x in (number[p[:k]], number[p[k:]], number[p]))
        self.table = PairTable(*np.fromiter(pairs, np.uint64).reshape(-1, 3).T)
        self.of_char = np.full(0x110000, len(number), np.uint32)  # a character of no piece has the last number
        for p, k in number.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k
        self.of_number = np.array([self.score[p][1] for p in order], np.uint32)
        scores = [self.score[p][0] for p in order]
        tied = {p for k, p in enumerate(order) if scores[k] in scores[max(k - 1, 0) : k] + scores[k + 1 : k + 2]}
        ties = {p[k : k + 2] for p in tied for k in range(len(p) - 1)}
        self.may_tie = re.compile("|".join(map(re.escape, sorted(ties))) or "(?!)").search
        self.joined = np.array(sorted(ord(a) << 32 | ord(b) for a, b in self.together) or [0], np.uint64)

    # ---- normalising

    def normalised(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text; and, for each of its bytes and its end, the original's byte, where the map or trimming
        changes the text (None where spaces alone are replaced)."""
        if not text:
            return "", None
        if self.map is None and not self.trims:
            return (SPACE if self.prefix else "") + text.replace(" ", SPACE), None
        raw, out, of = text.encode(), bytearray(), []

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            of.extend([at] * len(piece))

        space = SPACE.encode()
        begun, after_space = False, self.trims
        for at, _, piece in self._steps(text, raw):
            if not begun and self.trims and piece == b" ":
                continue
            if not begun and self.prefix:
                put(space, at)
            begun = True
            if after_space:
                piece = piece.lstrip(b" ")
            for byte in piece:
                put(space if byte == 32 else bytes([byte]), at)
            if self.trims and piece:
                after_space = piece.endswith(b" ")
        end = len(raw)
        if self.trims:
            while out.endswith(space):
                end = of[-3]
                del out[-3:], of[-3:]
        return out.decode(), np.array([*of, end], np.int64)

    def _steps(self, text: str, raw: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Each original stretch of bytes (place, length) and what it becomes."""
        point = at = 0
        while point < len(text):
            hit = self.map.begins.search(text, point) if self.map else None
            until = hit.start() if hit else len(text)
            for c in text[point:until]:
                piece = c.encode()
                yield at, len(piece), piece
                at += len(piece)
            point = until
            if hit:
                found = self.map.longest(raw, at)
                size, piece = found or (len(text[point].encode()), text[point].encode())
                yield at, size, piece
                point += len(raw[at : at + size].decode())
                at += size

    # ---- encoding

    def merged(self, part: str) -> list[str]:
        """The pieces of a part: of all neighbours whose joint text is a piece, those of highest score merge first."""
        pieces = list(part)
        before, after = list(range(-1, len(pieces) - 1)), list(range(1, len(pieces) + 1))
        heap = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(pieces) and (found := self.score.get(pieces[a] + pieces[b])):
                heapq.heappush(heap, (found[0], a, b, len(pieces[a]) + len(pieces[b])))

        for k in range(len(pieces) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not pieces[a] or not pieces[b] or after[a] != b or len(pieces[a]) + len(pieces[b]) != size:
                continue  # one of them has merged since
            pieces[a] += pieces[b]
            pieces[b] = ""
            after[a] = after[b]
            if after[b] < len(pieces):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in pieces if p]

    def _spelt_out(self, pieces: list[str]) -> bytes:
        ids = []
        for p in pieces:
            own = self.score.get(p)
            ids += [own[1]] if own else map(self.of_byte.__getitem__, p.encode())
        return np.array(ids, "<u4").tobytes()

    def _cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The parts of all words in a row, and how many of them each word and those before it have."""
        text, ends = "".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        pair = code[:-1] << np.uint64(32) | code[1:]
        cut = self.joined[np.minimum(np.searchsorted(self.joined, pair), len(self.joined) - 1)] != pair
        cut[ends[:-1] - 1] = True
        at = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(text)]])
        places = at.tolist()
        return [text[a:b] for a, b in zip(places, places[1:], strict=False)], np.searchsorted(at, ends)

    def learn(self, words: set[str]) -> None:
        """Find the ids of new words, from those of their parts."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known = {}
        if len(self.parts) > REMEMBERED:
            self.parts = {}
        words = list(words)
        parts, until = self._cut(words)
        buckets: dict[int, list[str]] = {}
        for p in set(parts).difference(self.parts):
            if len(p) == 1 or self.may_tie(p):
                self.parts[p] = self._spelt_out(self.merged(p))
            else:
                buckets.setdefault(len(p) if len(p) < 16 else 1 << len(p).bit_length(), []).append(p)
        for width, some in buckets.items():
            step = max(1, (1 << 18) // width)
            for a in range(0, len(some), step):
                self._merge(some[a : a + step])
        ids, a = list(map(self.parts.__getitem__, parts)), 0
        for w, b in zip(words, until.tolist(), strict=True):
            self.known[w] = ids[a] if b == a + 1 else b"".join(ids[a:b])
            a = b

    def _merge(self, parts: list[str]) -> None:
        flat = self.of_char[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]
        rows = merge_ids(self.table, flat, np.fromiter(map(len, parts), np.int64, len(parts)))
        numbers = np.concatenate(rows)
        places = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])
        odd = np.maximum.reduceat(numbers, places[:-1]) >= len(self.of_number)
        packed = self.of_number[np.minimum(numbers, len(self.of_number) - 1)].astype("<u4").tobytes()
        edges = (4 * places).tolist()
        self.parts.update(zip(parts, (packed[a:b] for a, b in zip(edges, edges[1:], strict=False)), strict=True))
        for k in np.flatnonzero(odd).tolist():  # some of its characters are no pieces: their text tells what they are
            self.parts[parts[k]] = self._spelt_out(self.merged(parts[k]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of normalised texts."""
        words = [self.words(t) for t in texts]
        every = [w for own in words for w in own]
        got = list(map(self.known.get, every))
        missed = [k for k, x in enumerate(got) if x is None]
        if missed:
            self.learn({every[k] for k in missed})
            for k in missed:
                got[k] = self.known[every[k]]
        out, at = [], 0
        for own in words:
            out.append(b"".join(got[at : at + len(own)]))
            at += len(own)
        return out

    def offsets(self, ids: np.ndarray, text: str, normal: str, of: np.ndarray | None) -> np.ndarray:
        """The original's byte at which each id begins, and its end."""
        at = np.concatenate([[0], np.cumsum(self.size[ids])])
        raw = np.frombuffer(normal.encode(), np.uint8)
        assert at[-1] == len(raw)
        for _ in range(3):  # ids of bytes begin where their character does
            inside = np.flatnonzero((raw[np.minimum(at, len(raw) - 1)] & 0xC0) == 0x80) if len(raw) else []
            inside = [] if not len(inside) else inside[at[inside] < len(raw)]
            if not len(inside):
                break
            at[inside] -= 1
        if of is None:
            own = np.frombuffer(text.encode(), np.uint8)
            lead = np.zeros(3 if self.prefix and len(own) else 0, np.int64)
            of = np.concatenate([lead, np.repeat(np.arange(len(own)), np.where(own == 32, 3, 1)), [len(own)]])
        return of[at]

    # ---- decoding

    def decode(self, ids: list[int]) -> bytes:
        """The text that ids stand for, in UTF-8."""
        parts = list(map(self.surface.__getitem__, ids))
        if self.prefix or self.trims:
            for k, i in enumerate(ids):
                if self.is_byte[i]:
                    break
                if parts[k].startswith(b" ") and self.size[i]:
                    parts[k] = parts[k][1:]
                    if not self.trims:
                        break
                if parts[k]:
                    break
        if b"" not in parts[1:-1]:  # or it may stand between bytes, which are no character then
            out = b"".join(parts)
            try:
                out.decode()
                return out
            except UnicodeDecodeError:
                pass
        whole, k = [], 0
        while k < len(ids):
            run = k
            while run < len(ids) and self.is_byte[ids[run]]:
                run += 1
            whole.append(_spelt(b"".join(parts[k:run])) if run > k else parts[k])
            k = max(run, k + 1)
        return b"".join(whole)


def _spelt(raw: bytes) -> bytes:
    """Bytes as UTF-8, each one that belongs to no character as U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode().encode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            size = 1
        at += size
    return b"".join(out)


@lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    return Model(path)


def encoded(batches: Iterable[pa.RecordBatch], path: str, column: str = "text", ends: bool = True, keep_text: bool = True) -> Iterator[pa.RecordBatch]:
    model = model_of(path)
    first, last = (np.array([x] if ends else [], "<u4").tobytes() for x in (model.begin, model.end))
    for batch in batches:
        for part in slices(batch, column, SLICE):
            ids, offsets = [], []
            texts = texts_of(part, column)
            normals = [model.normalised(t) for t in texts]
            for text, (normal, of), own in zip(texts, normals, model.encode([n for n, _ in normals]), strict=True):
                at = model.offsets(np.frombuffer(own, "<u4"), text, normal, of)
                at = np.concatenate([at[:1], at, at[-1:]]) if ends else at
                ids.append(first + own + last)
                offsets.append(at.astype("<u4").tobytes())
            yield _with(part if keep_text else part.drop_columns([column]), ids=ids, offsets=offsets)


def decoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = model_of(path)
    for batch in batches:
        texts = [model.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
        yield _with(batch, decoded=texts)


def _with(batch: pa.RecordBatch, **values: list[bytes]) -> pa.RecordBatch:
    kept = [f for f in batch.schema.names if f.lower() not in values]
    return pa.RecordBatch.from_arrays([*(batch.column(f) for f in kept), *(pa.array(v, pa.binary()) for v in values.values())], [*kept, *values])


def _schema(df: DataFrame, *names: str, drop: tuple[str, ...] = ()) -> T.StructType:
    gone = {x.lower() for x in (*names, *drop)}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in gone] + [T.StructField(n, T.BinaryType()) for n in names])


def piece_encode(df: DataFrame, path: str, column: str = "text", ends: bool = True) -> DataFrame:
    """Add `ids`, packed little-endian unsigned 32-bit integers, and `offsets`, packed alike, one more than ids."""
    return df.mapInArrow(lambda batches: encoded(batches, path, column, ends), _schema(df, "ids", "offsets"))


def piece_decode(df: DataFrame, path: str) -> DataFrame:
    """Add `decoded`: the UTF-8 bytes that the packed `ids` stand for. An id outside the vocabulary fails the task."""
    return df.mapInArrow(lambda batches: decoded(batches, path), _schema(df, "decoded"))


def piece_round_trip(df: DataFrame, path: str, column: str = "text", ends: bool = True) -> DataFrame:
    """piece_encode and piece_decode in one pass over the rows: `ids`, `offsets` and `decoded` instead of the text."""
    schema = _schema(df, "ids", "offsets", "decoded", drop=(column,))
    return df.mapInArrow(lambda batches: decoded(encoded(batches, path, column, ends, False), path), schema)
