"""What the operators of this subpackage share: tables, shared scratch space, packed text batches."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of df has, for a column that df gets for a while."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name = f"_{name}"
    return name


def kept_columns(df: DataFrame, *replaced: str) -> list[Column]:
    """The columns of df but those named like a result."""
    gone = {r.lower() for r in replaced}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.TemporaryDirectory(prefix="gaugeworks-")
    atexit.register(folder.cleanup)
    return folder.name


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a session that is one process (tests) gets a folder of
    its own; a cluster gets none, as there is no telling which folders its machines share."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within this block the shuffle files of a finished query go at once, so that a chain of jobs holds one job's."""
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and lost executors cost no rework."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gaugeworks/{name}-{uuid.uuid4().hex}"
    _made.paths.append(path)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


class _Made(threading.local):
    """Paths of the tables that this thread stored."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _made.paths:
        _made.paths.remove(path)


def stored_alone(df_of: Callable[[], DataFrame], name: str) -> DataFrame:
    """What df_of returns, stored; the tables that it stored on the way are deleted."""
    before = set(_made.paths)
    out = materialise(df_of(), name)
    for path in [p for p in _made.paths if p not in before and p != out.stored_at]:
        _delete(out.sparkSession, path)
    return out


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part stay near most_bytes; one longer text is a part of its own."""
    _, offsets = packed(batch, column)
    part = offsets[1:] // most_bytes
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(part)], strict=True):
        yield batch.slice(int(a), int(b - a))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's texts, null as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def packed(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and n + 1 offsets; null texts are empty."""
    array = batch.column(column).cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


# ---- words of packed texts ---------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Where the hashes of words begin: each gives a hash that is independent of the other's.
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
#: What is left of eight loaded bytes if a word has so many more.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one, by the xxhash library.
_LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of packed texts, between the bytes 9 to 13 and 32, with A-Z taken as a-z: document, place, 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n_docs = len(offsets) - 1
        gap = _SPACE[data]
        edge = np.ones(len(data) + 1, bool)  # a text's end divides words too
        edge[1:-1] = gap[1:] | gap[:-1]
        edge[offsets] = True
        at = np.flatnonzero(edge)
        words = ~gap[at[:-1]] if len(data) else np.zeros(0, bool)
        self.start, self.end = at[:-1][words], at[1:][words]
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.lowered = _LOWER[data]
        self.hash = self.hashed(self.lowered)
        self.counts = np.bincount(self.doc, minlength=self.n_docs)

    def hashed(self, data: np.ndarray, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes in data, which are the texts' bytes or stand for them one by one: eight
        bytes at a time go into a state that is mixed after each. Hashes of seed 0 and 1 are independent."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))  # at every byte
        size = self.end - self.start
        out = mixed(size.astype(np.uint64) * _BASE + _SEEDS[seed])
        out = mixed(out ^ (eight[self.start] & _MASKS[np.minimum(size, 8)]))
        todo = np.flatnonzero(size > 8)
        for k in todo[size[todo] > _LONG].tolist():
            out[k] = xxhash.xxh3_64_intdigest(data[self.start[k] : self.end[k]].tobytes(), seed=int(_SEEDS[seed]))
        todo = todo[size[todo] <= _LONG]
        for at in range(8, _LONG, 8):
            todo = todo[size[todo] > at]
            if not len(todo):
                break
            out[todo] = mixed(out[todo] * _BASE ^ (eight[self.start[todo] + at] & _MASKS[np.minimum(size[todo] - at, 8)]))
        return out

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k words in a row, and their documents; none of documents with fewer words."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        value = np.zeros(n, np.uint64)
        for j in range(k):
            value = mixed(value * _BASE + self.hash[j : j + n] + np.uint64(j + 1))
        whole = self.doc[:n] == self.doc[k - 1 :]
        return value[whole], self.doc[:n][whole]
