"""Blocks of documents that count keys together.

Some operators need, for every key in a text (a word, a word pair, an anchor), what the whole corpus says about it.
Documents are dealt to blocks by a hash; a block counts its own keys first (so a key that is in every document is
one entry for each block), cuts the sorted keys into parts by hash, and sends each part as one packed row. The task of
a part adds up and answers every block with values in the order in which the block sent its keys, so that answers carry no
keys. Blocks and parts have a bounded size; their number grows with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger.llm import textops as ops

BLOCK_BYTES = 12 << 20
PART_BYTES = 12 << 20


def blocked(docs: DataFrame, columns: list[Column], block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The chosen columns with `block`, the same for equal rows, and the number of blocks."""
    size, _ = ops.input_size(docs)
    n = 1 + size // block_bytes
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), *columns), n


def parts(n_blocks: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, n_blocks * block_bytes // PART_BYTES)


def deal(keys: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of each key in them, and the bounds of the parts (equal ranges of hashes)."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    unique = k[new]
    edges = np.array([(p << 64) // n_parts for p in range(n_parts)], np.uint64)
    return unique, place, np.append(np.searchsorted(unique, edges), len(unique))


def packed(keys: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, size)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :size] = raw
    return out.view("<u8").ravel()


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of keys, the sums of their counts over all lists; and nothing is kept but sums."""
    if not keys:
        return []
    unique, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(unique))
    bounds = np.cumsum([0, *(len(k) for k in keys)])
    return [total[place[a:b]] for a, b in zip(bounds, bounds[1:])]


def ordered(table: pa.Table) -> pa.Table:
    """Rows of a block in an order that doesn't depend on how they came."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
