"""What the corpus operators share: reading tables, words, hashes over byte arrays, map-side helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

# A word is a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")

_ODD = 0x9E3779B97F4A7C15  # any odd 64-bit number; the golden ratio's bits


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def fold(column: str, buckets: int) -> Column:
    """crc32 of a column's decimal text, modulo ``buckets``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


def in_fold(doc_id: int | None, buckets: int) -> int:
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % buckets


def map_batches(df: DataFrame, columns: list, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 1000) -> DataFrame:
    """``fn`` over Arrow batches of at most ``rows`` rows, on just the columns it needs.

    Rows are independent of each other, so nothing is shuffled and a lost task is simply run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield fn(b.slice(at, rows))

    return df.select(*columns).mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array and the offsets between them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    # The buffers of a slice reach beyond it, so offsets are taken relative to its first row.
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any byte range, from one running sum.

    With powers p**i and their inverses, sum(v[i] * p**i, a <= i < b) * p**-a is a hash of the
    bytes a..b alone: the base is odd, so it has an inverse modulo 2**64. Byte values are spread
    over 64 bits first and the result is mixed, which keeps the low bits useful.
    """

    def __init__(self, seed: int = 1):
        self.base = (_ODD * (2 * seed + 1)) | 1
        self.base %= 1 << 64
        self.values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(seed))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = max(n, 1 << 16)
        inverse = pow(self.base, -1, 1 << 64)
        for name, b in (("up", self.base), ("down", inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            setattr(self, name, np.multiply.accumulate(p))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums to be passed to ``ranges``."""
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((sums[end] - sums[start]) * self.down[start])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of the texts in ``data``, and the number of words per text."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = ~space
    # A text's first byte starts a word even if the text before it ends in one.
    before = np.zeros(len(data) + 1, bool)
    before[1:] = word[:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    first = word[:-1] & ~before[:-1]
    first[cut] = word[cut]
    last = before.copy()
    last[:-1] &= ~word[:-1]
    inner = cut[cut > 0]
    last[inner] |= word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    return start, end, np.diff(np.searchsorted(start, offsets))


def per_text(counts: np.ndarray) -> np.ndarray:
    """Number of the text of each item, given the items per text."""
    return np.repeat(np.arange(len(counts)), counts)


def totals(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int = 1, rows: int = 2000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows`` rows and about ``size`` bytes of one text column; a longer text is a slice of its own."""
    for b in batches:
        lengths = np.diff(text_bytes(b.column(column))[1])
        at, held = 0, 0
        for i, n in enumerate(lengths):
            if i > at and (i - at >= rows or held + n > size):
                yield b.slice(at, i - at)
                at, held = i, 0
            held += int(n)
        if at < b.num_rows:
            yield b.slice(at)
