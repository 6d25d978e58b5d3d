"""Array helpers shared by the text operators: words, hashes and sliding minima over one Arrow batch.

A batch of texts is one byte array with offsets. Every helper works on all texts of the batch at once;
`pieces` cuts a batch so that the arrays of one step stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * K2
    h = (h ^ (h >> np.uint64(27))) * K3
    return h ^ (h >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * K1 + np.uint64(seed)) | np.uint64(1)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if "string" in str(column.type) else b"")
    n, kind = len(column), np.int64 if large else np.int32
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, offs[-1] - offs[0], offs[0]), offs - offs[0]


def pieces(offs: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts [a, b) of about `size` bytes; a longer text is a run of its own."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    blank = WHITESPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    before[offs[offs < n]] = True
    after[offs[offs > 0] - 1] = True
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = ends - starts
    h = np.full(len(starts), K1, np.uint64) + left.astype(np.uint64)
    at, live = starts, None
    while len(at):
        part = eight[at] & LOW_BYTES[np.minimum(left, 8)]
        if live is None:
            h = mix((h ^ part) * K1)
            live = np.flatnonzero(left > 8)
            at, left = at[live] + 8, left[live] - 8
        else:
            h[live] = mix((h[live] ^ part) * K1)
            on = left > 8
            live, at, left = live[on], at[on] + 8, left[on] - 8
    return h


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words inside one text, and the index of its first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(m, np.uint64)
    for k, odd in enumerate(odd_numbers(n, n)):
        g += h[k : k + m] * odd
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[:m] == text[n - 1 :])
    return mix(g[at]), at


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs twice or more, and whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` places lie in a run of n that begins at one of `at`."""
    delta = np.bincount(at, minlength=size + 1)[: size + 1] - np.bincount(np.minimum(at + n, size), minlength=size + 1)[: size + 1]
    return np.cumsum(delta)[:size] > 0


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values (len(x) - w + 1 results), by block-wise prefix and suffix minima."""
    n = len(x)
    if n < w:
        return x[:0]
    blocks = -(-n // w)
    full = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    rows = full.reshape(blocks, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def input_size(frame):
    """Bytes of text and number of rows, from which operators size their groups."""
    from pyspark.sql import functions as F

    row = frame.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return int(row["b"] or 0), int(row["n"])
