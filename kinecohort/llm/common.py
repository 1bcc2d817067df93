"""What the operators of this package share: choosing columns, reading tables, texts as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task looks at together, at most (or one text).
SLICE_BYTES = 2 << 20

_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """What a process keeps from task to task: one model at a time, so that stages do not add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns (exact spelling, the first of equal names); whatever else df has cannot clash."""
    at: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"no column {missing}; there are {df.columns}")
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{at[n]}").alias(n) for n in names])


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, all other letters as they are.

    Texts of plain ASCII take the fast way; in others, only the letters A-Z are replaced.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, lower))


def held_out(doc_id: Column, parts: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod parts = remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == remainder, F.lit(False))


def learnable(doc_id: Column, parts: int, remainder: int) -> Column:
    """Rows to learn from: crc32(doc_id as text) mod parts is known and another."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts != remainder, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the places where each text starts, null as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, places, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each have up to `limit` bytes, or are one text."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.asarray(pa.compute.binary_length(column).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def keep_rows(docs: DataFrame, decide: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of docs, with all their columns, for which decide(batch) is true; batches go through without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(decide(batch), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def word_places(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes that is_word marks, within a text), and the words before each text."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = is_word[data]
    starts = inside[:-1].copy()
    starts[1:] &= ~inside[:-2]
    first = offsets[:-1][offsets[:-1] < len(data)]
    starts[first] = inside[first]  # a text's first byte starts a word even if the text before ended in one
    ends = inside[:-1] & ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: For hashes of words: an odd number and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are hashed together.
_HASHED = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


_POWERS: list[np.ndarray] = [_powers(_BASE, 0), _powers(_INVERSE, 0)]


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits mixed."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (starts and ends in order): its bytes as digits in an odd base, then mixed.

    Differences of one running sum, shifted back by the word's place, so that no loop over words is needed; text by
    text of _HASHED bytes, so that memory does not depend on the length.
    """
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        first = starts[a]
        b = max(a + 1, int(np.searchsorted(starts, first + _HASHED)))
        part = data[first : ends[b - 1]]
        if len(_POWERS[0]) <= len(part):
            _POWERS[:] = [_powers(_BASE, len(part)), _powers(_INVERSE, len(part))]
        up, down = _POWERS
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        own = starts[a:b] - first
        out[a:b] = mixed((sums[ends[a:b] - first] - sums[own]) * down[own])
        a = b
    return out


def lower_words() -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z as a-z, and which of them are part of words: ASCII letters and digits, and all beyond ASCII."""
    same = np.arange(256, dtype=np.uint8)
    same[ord("A") : ord("Z") + 1] += 32
    word = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
    return same, word
