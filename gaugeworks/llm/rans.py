"""Token-ID output: tokenised documents in blocks of a static range asymmetric numeral system (rANS).

Method: all ids are counted once into one frequency table, scaled to 2**SCALE_BITS, that every block shares. A block
holds whole documents in ascending doc_id order. Its ids go round LANES interleaved 64-bit states, which push 32-bit
words to one stream. At each CHECKPOINT_STEPS steps the states and the place in the stream are stored, so that a
block's segments are decoded side by side, and each block has a checksum of its ids and of whose they are. Blocks depend on nothing but the
shared table. numpy advances all blocks (to encode) or segments (to decode) of a batch together.

The files: a folder with `blocks` (one row a block, as Parquet) and `table` (symbol, frequency). Spark writes and
reads both, so any store that Spark reaches will do.

Defined results: null and empty texts are documents of the end id alone; rows of equal doc_id are neighbours in any
order; a null doc_id sorts first; an empty table gives files without blocks. Decoding a damaged block raises.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import materialise, shared_folder, shuffles_removed, slices, texts_of

SCALE_BITS = 20
LANES = 16
CHECKPOINT_STEPS = 256
#: A block takes documents until it has so many ids.
BLOCK_IDS = 16_384
#: Blocks whose ids, padded, are encoded together.
BATCH_IDS = 4 << 20
#: Entries of a worker's memory of words; at this count it starts anew, which changes speed alone.
REMEMBERED = 1_000_000

LOW = np.uint64(1 << 32)
_32 = np.uint64(32)
_M = np.uint64(SCALE_BITS)
_MASK = np.uint64((1 << SCALE_BITS) - 1)


# ---- tokenising ----------------------------------------------------------------------------------------------


class WordTokenizer:
    """The tokenizers library over the distinct words of texts.

    The library's pre-tokeniser never joins what a space, tab or line end divides, so a text's ids are those of its
    words in a row. Letters and the plain signs after them are two of its pieces, so these are kept apart too. Each
    distinct word is encoded once and remembered. All of that holds for tokenizers that pass PROBES; the texts of any
    other are encoded whole."""

    #: Texts whose ids must be those of their words, or the tokenizer isn't one whose words can be taken apart.
    PROBES = (
        "The cat sat, quite still; on the mat.  Twice\tor\r\nthrice!", "don't we'll I'd (you're) 'tis rock'n'roll", "ÉCOLE Straße naïve café, ¿qué? Ñandú", "x=1; y+=2.5e-3 #define A_B <|endoftext|> <|pad|>",
        "日本語 한국어 Σας İstanbul ﬁn e\u0301 \u00a0 \x85 \x1c \u200b", "UPPER lower MiXeD 1st 22nd 3,000.50 a1b2 ... --- !!! a.b.c", " leading and trailing ", "", "\n\n", "wordsigns!?( and )more, \"quoted\" `code` ~tilde",
    )

    _cut = re.compile("[ \t\r\n]+").split
    #: A word with signs after it, which is cut if normalising keeps its letters letters. An apostrophe may begin a contraction, which is a piece of another kind.
    _signs = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)").fullmatch

    _only_signs = re.compile(r"[!-&(-/:-@\[-`{-~]+").fullmatch

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        size = self.own.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.lowers = '"type":"Lowercase"' in self.own.to_str().replace(" ", "")
        # the byte-level alphabet: printable bytes stand for themselves, the others for what follows 255, in order
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.model = self.own.model if '"type":"ByteLevel"' in self.own.to_str().replace(" ", "") else None
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        whole = [np.array(self.own.encode(t, add_special_tokens=False).ids, self.dtype).tobytes() for t in self.PROBES]
        self.by_words = self._by_words(list(self.PROBES)) == whole

    def direct(self, part: str) -> list[int] | None:
        """The ids of a part that normalising leaves as it is and that is one piece: it needs the library's model only."""
        if self.model is None or not self.lowers:
            return None
        if part.isascii():
            if (part.isalpha() and part.islower()) or (self._only_signs(part)):
                return [t.id for t in self.model.tokenize(part)]
        elif part.isalpha() and part == part.lower() and max(part) <= "\xff":
            return [t.id for t in self.model.tokenize("".join(map(self.alphabet.__getitem__, part.encode())))]
        return None

    def words(self, text: str) -> list[str]:
        if self.lowers and "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split(), not to the library
            return [w for w in self._cut(text) if w]
        return text.split()

    def learn(self, new: set[str]) -> None:
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
        split = {w: m.groups() for w in new if (m := self._signs(w)) and m[1].isalpha() and max(m[1]) <= "\xff"}
        parts = {x for w in new for x in split.get(w, (w,))}.difference(self.parts)
        if len(self.parts) + len(parts) > REMEMBERED:
            self.parts = {}
            parts = {x for w in new for x in split.get(w, (w,))}
        todo = []
        for x in parts:
            if (ids := self.direct(x)) is None:
                todo.append(x)
            else:
                self.parts[x] = np.array(ids, self.dtype).tobytes()
        for k in range(0, len(todo), 4096):
            some = todo[k : k + 4096]
            for w, e in zip(some, self.own.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.parts[w] = np.array(e.ids, self.dtype).tobytes()
        for w in new:
            self.known[w] = b"".join(self.parts[x] for x in split.get(w, (w,)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.by_words:
            return self._by_words(texts)
        return [np.array(e.ids, self.dtype).tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        words = [self.words(t) for t in texts]
        every = [w for ws in words for w in ws]
        got = list(map(self.known.get, every))
        missed = [k for k, x in enumerate(got) if x is None]
        if missed:
            self.learn({every[k] for k in missed})
            for k in missed:
                got[k] = self.known[every[k]]
        out, at = [], 0
        for ws in words:
            out.append(b"".join(got[at : at + len(ws)]))
            at += len(ws)
        return out


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenise(df: DataFrame, path: str, end_id: int, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(part, doc_id, before, n_tokens, ids): packed ids with the end id, in order of doc_id; `before` counts the ids
    of the part's documents so far. Parts follow each other in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = tokenizer_of(path), 0
        end = np.array([end_id], encode.dtype).tobytes()
        size = encode.dtype.itemsize
        for batch in batches:
            for rows in slices(batch, column):
                ids = [x + end for x in encode(texts_of(rows, column))]
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // size
                until = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays([rows.column("part"), rows.column(key), pa.array(until - n), pa.array(n), pa.array(ids, pa.binary())], ["part", key, "before", "n_tokens", "ids"])
                before = int(until[-1])

    ordered = df.select(key, column).repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    return ordered.mapInArrow(run, f"part int, {key} bigint, before bigint, n_tokens bigint, ids binary")


# ---- the frequency table -------------------------------------------------------------------------------------


def count_ids(ids: DataFrame, size: int, width: int) -> np.ndarray:
    """How often each id occurs; the driver gets one row for each id of the vocabulary at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            raw = b"".join(batch.column("ids").to_pylist())
            for k in range(0, len(raw), 4 << 20):  # few counts over many ids each, in bounded memory
                total += np.bincount(np.frombuffer(raw[k : k + (4 << 20)], f"<u{width}"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE_BITS, one at least for each id that occurs, none takes all."""
    seen = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    whole = (1 << SCALE_BITS) - 1  # one slot stays free, so that no frequency fills the scale
    if not len(seen):
        return out
    if len(seen) > whole // 2:
        raise ValueError(f"{len(seen)} ids don't fit a scale of {SCALE_BITS} bits")
    share = counts[seen].astype(float) / counts[seen].sum()
    out[seen] = 1 + np.floor(share * (whole - len(seen))).astype(np.int64)
    out[seen[np.argmax(counts[seen])]] += whole - out.sum()
    return out


class Table:
    def __init__(self, frequency: np.ndarray):
        self.f = frequency.astype(np.uint64)
        self.c = np.concatenate([[0], np.cumsum(frequency)[:-1]]).astype(np.uint64)
        self.slot = np.zeros(1 << SCALE_BITS, np.uint32)
        self.slot[: int(frequency.sum())] = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency)
        self.filler = int(np.argmax(frequency))

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        """(checkpoints, words) of each block."""
        steps = np.array([-(-len(b) // LANES) for b in blocks])
        order = np.argsort(-steps, kind="stable")
        most, n = int(steps.max()), len(blocks)
        symbols = np.full((most, n, LANES), self.filler, np.uint32)
        for row, k in enumerate(order):
            b = blocks[k]
            padded = np.full(int(steps[k]) * LANES, self.filler, np.uint32)
            padded[: len(b)] = b
            symbols[: steps[k], row] = padded.reshape(-1, LANES)
        room = most * LANES
        stream = np.zeros((n, room), np.uint32)
        at = np.full(n, room)
        state = np.full((n, LANES), LOW)
        active = np.searchsorted(-steps[order], -np.arange(most), "left")  # rows that have a step t
        marks: list[list[bytes]] = [[] for _ in blocks]
        for t in range(most - 1, -1, -1):
            a = int(active[t])
            s, x = symbols[t, :a], state[:a]
            f = self.f[s]
            push = x >= f << np.uint64(64 - SCALE_BITS)
            row, lane = np.nonzero(push)
            if len(row):
                count = push.sum(1)
                rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at[:a] -= count
                stream[row, at[row] + rank] = x[row, lane].astype(np.uint32)
                x[row, lane] >>= _32
            q = x // f
            state[:a] = (q << _M) + (x - q * f) + self.c[s]
            if t % CHECKPOINT_STEPS == 0:
                for r in range(a):
                    marks[r].append(np.uint32(room - at[r]).tobytes() + state[r].astype("<u8").tobytes())
        out: list = [None] * n
        for row, k in enumerate(order):
            out[k] = (b"".join(reversed(marks[row])), stream[row, at[row] :].astype("<u4").tobytes())
        return out

    def decode(self, blocks: list[tuple[int, bytes, bytes]]) -> list[np.ndarray]:
        """The ids of blocks given as (number of ids, checkpoints, words); all their segments advance together."""
        size = 4 + 8 * LANES
        words = np.frombuffer(b"".join(w for _, _, w in blocks) + bytes(4), "<u4")
        ends = np.cumsum([len(w) // 4 for _, _, w in blocks])
        at, states, steps = [], [], []
        for (n, marks, _), end in zip(blocks, ends, strict=True):
            total = -(-n // LANES)
            for k in range(len(marks) // size):
                mark = marks[k * size : (k + 1) * size]
                at.append(end - int.from_bytes(mark[:4], "little"))
                states.append(np.frombuffer(mark, "<u8", LANES, 4))
                steps.append(min(CHECKPOINT_STEPS, total - k * CHECKPOINT_STEPS))
        steps = np.array(steps)
        order = np.argsort(-steps, kind="stable")
        at, state = np.array(at)[order], np.array(states)[order]
        active = np.searchsorted(-steps[order], -np.arange(steps.max()), "left")
        got = np.zeros((len(order), int(steps.max()), LANES), np.uint32)
        for t in range(got.shape[1]):
            a = int(active[t])
            x = state[:a]
            low = x & _MASK
            s = self.slot[low]
            got[:a, t] = s
            x = self.f[s] * (x >> _M) + low - self.c[s]
            pull = x < LOW
            row, lane = np.nonzero(pull)
            if len(row):
                count = pull.sum(1)
                rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                # a damaged block may ask for more words than there are: its checksum tells
                x[row, lane] = x[row, lane] << _32 | words[np.clip(at[row] + rank, 0, len(words) - 1)]
                at[:a] += count
            state[:a] = x
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        out, seg = [], 0
        for n, marks, _ in blocks:
            k = len(marks) // size
            out.append(np.concatenate([got[place[j], : steps[j]].ravel() for j in range(seg, seg + k)])[:n])
            seg += k
        return out


# ---- files ---------------------------------------------------------------------------------------------------

BLOCKS = "first bigint, start bigint, n_tokens bigint, id_bytes int, doc_ids binary, doc_nulls binary, doc_tokens binary, checkpoints binary, words binary, checksum bigint"


def write_blocks(tokenised: DataFrame, path: str, size: int, width: int, key: str = "doc_id") -> None:
    """Encode what tokenise() returned into files at path. tokenised must be a stored table: it is read thrice."""
    spark = tokenised.sparkSession
    frequency = scaled(count_ids(tokenised, size, width))
    ends = tokenised.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n")).orderBy("part").collect()  # a row for each part
    offset, so_far = {}, 0
    for r in ends:
        offset[r.part], so_far = so_far, so_far + r.n

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(frequency)
        ready: list[tuple] = []
        now: list = [None, 0, 0, [], [], []]  # part, start, ids, doc_ids, counts, packed ids

        def close() -> None:
            if now[3]:
                ready.append(tuple(now))
            now[:] = [None, 0, 0, [], [], []]

        def flush() -> pa.RecordBatch:
            ids = [np.frombuffer(b"".join(x[5]), f"<u{width}") for x in ready]
            coded = table.encode(ids)
            rows = []
            for (_, start, n, docs, counts, raw), (marks, words) in zip(ready, coded, strict=True):
                known = np.array([0 if d is None else d for d in docs], "<i8")
                nulls = np.array([d is None for d in docs], np.uint8)
                about = known.tobytes(), nulls.tobytes(), np.array(counts, "<u4").tobytes()
                rows.append((int(known[0]), start, n, width, *about, marks, words, zlib.crc32(b"".join([*about, *raw]))))
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW_BLOCKS, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for part, doc, before, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", key, "before", "n_tokens", "ids")), strict=True):
                start = offset[part] + before
                if now[3] and (now[0] != part or now[1] + now[2] != start or now[2] + n > BLOCK_IDS):
                    close()
                    if sum(x[2] for x in ready) >= BATCH_IDS:
                        yield flush()
                if not now[3]:
                    now[0], now[1] = part, start
                now[2] += n
                now[3].append(doc)
                now[4].append(n)
                now[5].append(ids)
        close()
        if ready:
            yield flush()

    with shuffles_removed(spark):
        tokenised.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
        rows = [(int(k), int(frequency[k])) for k in np.flatnonzero(frequency)]
        spark.createDataFrame(rows, "symbol bigint, frequency bigint").coalesce(1).write.parquet(f"{path}/table")


_ARROW_BLOCKS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]


def read_blocks(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids from the files, packed as unsigned 32-bit integers."""
    rows = spark.read.parquet(f"{path}/table").collect()  # bounded by the vocabulary
    frequency = np.zeros(max((r.symbol for r in rows), default=0) + 1, np.int64)
    for r in rows:
        frequency[r.symbol] = r.frequency

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(frequency)
        for batch in batches:
            for k in range(0, len(batch), 128):
                rows = batch.slice(k, 128).to_pylist()
                decoded = table.decode([(r["n_tokens"], r["checkpoints"], r["words"]) for r in rows])
                docs, starts, counts, packed = [], [], [], []
                for r, ids in zip(rows, decoded, strict=True):
                    about = r["doc_ids"] + r["doc_nulls"] + r["doc_tokens"]
                    if zlib.crc32(about + ids.astype(f"<u{r['id_bytes']}").tobytes()) != r["checksum"]:
                        raise ValueError(f"block at {r['start']} doesn't match its checksum")
                    n = np.frombuffer(r["doc_tokens"], "<u4").astype(np.int64)
                    until = np.cumsum(n)
                    raw = ids.astype("<u4").tobytes()
                    nulls = np.frombuffer(r["doc_nulls"], np.uint8)
                    docs += [None if z else d for d, z in zip(np.frombuffer(r["doc_ids"], "<i8").tolist(), nulls, strict=True)]
                    starts += (r["start"] + until - n).tolist()
                    counts += n.tolist()
                    packed += [raw[4 * (b - c) : 4 * b] for b, c in zip(until.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], [key, "start", "n_tokens", "ids"])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, f"{key} bigint, start bigint, n_tokens bigint, ids binary")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, column: str = "text", key: str = "doc_id") -> str:
    """Tokenise docs and write them at path (a new one in the shared folder if none is given), which is returned."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/gaugeworks/tokens-{uuid.uuid4().hex}"
    size = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    tokenised = materialise(tokenise(docs, tokenizer_path, end_id, column, key), "tokenised")
    write_blocks(tokenised, path, size, 2 if size <= 1 << 16 else 4, key)
    return path
