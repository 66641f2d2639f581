"""Shared helpers: the cluster's shared folder, written scratch tables, and vectorised token hashing.

Token hashing works on the UTF-8 bytes of an Arrow string column, so no Python object is made per
word.  A word's hash depends on its lower-cased bytes only, never on its place.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes hashed at once; longer texts are cut between words, so memory stays bounded.
PIECE_BYTES = 1 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); own temporary one in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = tempfile.mkdtemp(prefix="inklattice-")
    spark.sparkContext.setCheckpointDir(f"file://{at}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The table survives lost executors and is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inklattice-{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._inklattice_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by ``materialize`` that nothing will read again."""
    path = getattr(df, "_inklattice_path", None)
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the JVM is gone already
            return


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (full avalanche)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, PIECE_BYTES + 1)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]))
                cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64)]))
        return cls.up[:n], cls.down[:n]


def _byte_tables(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    values = mix64((fold.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return values, ~breaks


_is_space = np.zeros(256, bool)
_is_space[list(SPACES)] = True
_VALUES, _WORD_BYTE = _byte_tables(_is_space)


def _hash_piece(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` and the byte at which each starts; words end at the starts of texts too."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = _Powers.upto(len(data))
    word = _WORD_BYTE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[doc_starts] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up, out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix64(h ^ (end - start).astype(np.uint64)), start


def _pieces(view: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut at texts, or inside a very long one before a space, so that a piece has about PIECE_BYTES."""
    at, stop = int(bounds[0]), int(bounds[-1])
    while at < stop:
        if stop - at <= PIECE_BYTES:
            yield at, stop
            return
        k = int(np.searchsorted(bounds, at + PIECE_BYTES, "right")) - 1
        cut = int(bounds[k])
        if cut <= at:  # one text of more than a piece
            end = int(bounds[k + 1])
            cut = min(at + PIECE_BYTES, end)
            while cut < end and not _is_space[view[cut]]:
                nxt = np.flatnonzero(_is_space[view[cut : min(cut + PIECE_BYTES, end)]])
                cut = cut + int(nxt[0]) if len(nxt) else min(cut + PIECE_BYTES, end)
        yield at, cut
        at = cut


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; a null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), bounds


def slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts have about ``most`` bytes, one row at least."""
    _, bounds = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        stop = min(stop, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` (A-Z folded) and, for each text, where its words begin.

    Returns (hashes, bounds); text i has hashes[bounds[i]:bounds[i+1]].
    """
    view, bounds = text_bytes(column)
    hashes, starts = [], []
    for at, stop in _pieces(view, bounds):
        inner = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, stop)] - at
        h, s = _hash_piece(view[at:stop], inner)
        hashes.append(h)
        starts.append(s + at)
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def word_hash(word: str) -> int:
    """The hash that ``word_hashes`` gives a single word."""
    return int(word_hashes(pa.array([word]))[0][0])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words (empty if there are fewer)."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + size]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return mix64(h)
