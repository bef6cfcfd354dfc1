"""Shared text helpers: word rules as columns, and whole-batch word hashing for Arrow tasks.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; letters A-Z are lowered, nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C55, pow(0x9E3779B97F4A7C55, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def lowered(text: Column) -> Column:
    """Lower A-Z only; null counts as empty. ASCII rows take the short way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of an Arrow string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, end row, bytes, offsets. A longer row is a run of its own."""
    data, offsets = text_bytes(column)
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high
    pa.default_memory_pool().release_unused()


def _power(n: int, base: int) -> np.ndarray:
    """Powers 0 … n-1 of ``base`` modulo 2**64."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept, dtype=np.uint64)
        if len(kept) <= 4 * CHUNK_BYTES:
            _powers[base] = kept
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs of True bytes; a run never crosses a row."""
    n = len(inside)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


class Spans:
    """64-bit hashes of byte spans of one buffer, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(len(data), _BASE), out=self.sums[1:])
        self.inverse = _power(len(data) + 1, _BASE_INVERSE)

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[begins]) * self.inverse[begins] + (ends - begins).astype(np.uint64))


def hash_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(data).hashes(begins, ends)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lowered."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of each word, and the position of each row's first word (one more entry than rows)."""
    data = lower_bytes(data)
    begins, ends = spans_of(~_SPACE[data], offsets)
    return hash_spans(data, begins, ends), begins, ends, np.searchsorted(begins, offsets)


def some_rows(rows: DataFrame, doc_id: str, most: int, total: int) -> DataFrame:
    """About ``most`` of ``total`` rows, chosen by the hash of their id (all if there are no more); no sort, no task that sees them all."""
    share = 2 ** 31 * most // max(total, 1)
    return rows if total <= most else rows.filter(F.pmod(F.xxhash64(doc_id), F.lit(2 ** 31)) < share)
