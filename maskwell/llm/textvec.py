"""Words of many texts at once, with numpy over their UTF-8 bytes.

A block is a run of whole texts of about ``BLOCK_BYTES``; one longer text is a block of its own. Words get
64-bit hashes from a polynomial over their bytes, so a word has the same hash in any block, task or run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next block."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows; a null text has no bytes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.null_count:
            texts = texts.fill_null("")
        texts = texts.cast(pa.large_string())
        n = len(texts)
        if not n:
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        begin = 0
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
            end = min(end, n)
            yield batch.slice(begin, end - begin), data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
            begin = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; words end at white space and at the end of their text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    in_word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = in_word.copy(), in_word.copy()
    opens[1:] &= ~in_word[:-1] | edge[1:-1]
    closes[:-1] &= ~in_word[1:] | edge[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))


def hash_keys(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of integers."""
    return mix(keys.astype(np.int64).view(np.uint64) * _U(_BASE) + _U(seed * 2 + 1))


def unit_interval(h: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1."""
    return ((h >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)
