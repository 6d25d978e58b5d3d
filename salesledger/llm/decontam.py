"""Benchmark decontamination by the q-gram lemma.

Two strings of which one is n long and which differ by at most e edits share at least n - q + 1 - q*e q-grams, and these
lie on diagonals (place in the document less place in the passage) at most e apart. Documents are read once: each
character q-gram that a passage also has is a hit, hits are counted per passage in overlapping bands of diagonals, bands
that meet the bound are verified by banded alignment. No document is shuffled.

Hits are not spelled out one by one: a run of equal q-grams in a document (rules, dashes) meets each place of a passage on a run of
neighbouring diagonals, and such runs are added to the bands they cross. So a text of one character costs its length over the band's
width for each place, and what is counted at a time is bounded.

The passages are searched in blocks of about BLOCK_CHARS characters: only one block's index is sent to the tasks at a
time, as plain arrays, and where there are more blocks the documents are written to the shared folder between them, so that a benchmark
of any size costs more passes and not more memory.

Texts are compared lower-cased, with runs of white space as one space. Edits allowed: EDIT_RATE of a passage's
length, but never so many that the bound falls below one q-gram.

Defined cases: null and empty documents are clean; null and empty passages, and passages shorter than q, match nothing;
repeated documents and repeated passages are judged each; empty tables give empty results. Input columns that share a
name with a result column are replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesledger.llm import textops as ops
from salesledger.llm.storage import written

Q = 10
EDIT_RATE = 0.08
BLOCK_CHARS = 4_000_000
PIECE_CHARS = 1 << 20
FILTER_BITS = 22
#: Crossings of runs and bands that are counted at a time, about; longer runs than RUN are cut.
CROSSINGS, RUN = 1 << 20, 1 << 14


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces; NUL, which separates texts here, counts as white space."""
    if not text:
        return ""
    return " ".join((text.replace("\0", " ") if "\0" in text else text).lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of q code points, by doubling."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    h, size, out, done = x.astype(np.uint64) + np.uint64(1), 1, None, 0
    left = q
    while True:
        if left & 1:
            if out is None:
                out = h
            else:
                m = min(len(out), len(h) - done)
                out = out[:m] * ops.K2 + h[done : done + m]
            done += size
        left >>= 1
        if not left:
            return out * ops.K1
        h = h[:-size] * (ops.K3 + np.uint64(2 * size)) + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2


def allowed(n: int, q: int, rate: float) -> int:
    return max(0, min(int(rate * n), (n - q) // q))


class Index:
    """The q-grams of one block of passages: sorted hashes, and for each hash its passages and places."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q, self.items = q, items
        self.edits = np.array([allowed(len(t), q, rate) for _, t in items], np.int64)
        self.least = np.array([len(t) - q + 1 - q * e for (_, t), e in zip(items, self.edits.tolist())], np.int64)
        grams = [gram_hashes(points(t), q) for _, t in items]
        h = np.concatenate(grams or [np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.item = np.repeat(np.arange(len(items)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.keys)] = True

    @classmethod
    def of(cls, arrays: dict) -> Index:
        """The index whose attributes were sent as plain arrays."""
        index = cls.__new__(cls)
        index.__dict__.update(arrays)
        return index

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def runs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of equal q-grams of x that a passage has: first place, length, and the q-gram's index in `keys`."""
        h = gram_hashes(x, self.q)
        at = np.flatnonzero(self.filter[self._slot(h)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        real = self.keys[k] == h[at]
        at, k = at[real], k[real]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(k) != 0) | (at[1:] % RUN == 0)])) if len(at) else at
        return at[new], np.diff(np.append(new, len(at))), k[new]


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n[0] + n[1] + ... entries, whose it is and its place among them."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def bands(x: np.ndarray, begins: np.ndarray, index: Index) -> list[tuple[int, int, int]]:
    """(text, passage, band) of the bands of diagonals that meet the bound; x holds the texts, which begin at `begins`.

    Band b of a passage covers the diagonals from b to b + 2 widths, so neighbouring bands overlap by one width.
    """
    at, length, k = index.runs(x)
    step = np.maximum(1, np.cumsum(index.count[k] * (2 + length)) // CROSSINGS) if len(k) else k
    found: list[np.ndarray] = []
    for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(step)) + 1):
        run, j = spread(index.count[k[part]])  # every place of a passage that a run meets
        rows, run = index.first[k[part]][run] + j, part[run]
        item, text = index.item[rows], np.searchsorted(begins, at[run], "right") - 1
        low = at[run] - begins[text] - index.place[rows]  # the run meets the diagonals low to low + length - 1
        width = index.edits[item] + 1
        cells = (low + length[run] - 1) // width - low // width + 1
        owner, c = spread(cells)
        cell = low[owner] // width[owner] + c
        edge = cell * width[owner]
        n = np.minimum(low[owner] + length[run][owner], edge + width[owner]) - np.maximum(low[owner], edge)
        key = np.stack([text[owner], item[owner], cell, n])
        found.append(folded(np.concatenate([key, key - [[0], [0], [1], [0]]], axis=1)))
    total = folded(np.concatenate(found, axis=1)) if found else np.zeros((4, 0), np.int64)
    return total[:3, total[3] >= index.least[total[1]]].T.tolist()


def folded(key: np.ndarray) -> np.ndarray:
    """Columns (text, passage, band, hits) in order, hits of equal ones added up."""
    key = key[:, np.lexsort(key[2::-1])]
    if not key.shape[1]:
        return key
    new = np.flatnonzero(np.concatenate([[True], (key[:3, 1:] != key[:3, :-1]).any(axis=0)]))
    return np.concatenate([key[:3, new], np.add.reduceat(key[3], new)[None]])


def distance(pattern: np.ndarray, window: np.ndarray, most: int, before: int, width: int) -> int | None:
    """Fewest edits between the pattern and a part of the window along the diagonals -before to width - before - 1, if at most `most`.

    A row holds one entry for each diagonal of the band, not for each character of the window.
    """
    far, none = len(pattern) + most + 1, 0xFFFFFFFF
    padded = np.full(len(pattern) + width, none, np.uint32)
    held = window[: len(padded) - before]
    padded[before : before + len(held)] = held
    row = np.where(np.arange(width) >= before, 0, far)
    row[before + len(window) + 1 :] = far
    climb = np.arange(width)
    for k, c in enumerate(pattern):
        step = row + (padded[k : k + width] != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - climb) + climb
        if row.min() > most:
            return None
    return int(row.min())


def matches(texts: list[str], index: Index) -> list[dict[int, int]]:
    """For each normalised text the passages it holds, with the fewest edits found."""
    out: list[dict[int, int]] = [{} for _ in texts]
    if not len(index.keys):
        return out
    lens = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(lens)])
    x = points("\0".join([*texts, ""]))
    seen: tuple[int, int] | None = None
    tried: dict[tuple[int, str], int | None] = {}
    for d, i, b in bands(x, begins, index):
        if out[d].get(i) == 0:
            continue
        if seen != (d, i):
            seen, tried = (d, i), {}
        text, (_, passage), e = texts[d], index.items[i], int(index.edits[i])
        first = b * (e + 1) - e  # diagonals from here, on either side of the band as many as there may be edits
        lo, width = max(0, first), 2 * (e + 1) + 2 * e + 1
        window = text[lo : first + width + len(passage)]
        if passage in window:
            out[d][i] = 0
        elif e:
            if (lo - first, window) not in tried:  # repetitive texts bring the same window again and again
                tried[lo - first, window] = distance(points(passage), points(window), e, lo - first, width)
            found = tried[lo - first, window]
            if found is not None:
                out[d][i] = min(found, out[d].get(i, found))
    return out


def _index_blocks(benchmark: DataFrame, q: int, rate: float, block_chars: int) -> Iterator[Index]:
    """Indexes of blocks of passages; each block is fetched by itself and holds about block_chars characters."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + int(chars // block_chars)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        found = [(r[0], t) for r in rows if len(t := normal(r[1])) >= q]
        yield Index(sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1])), q, rate)


def _search(docs: DataFrame, shared, text: str) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField("items", T.ArrayType(T.LongType())), T.StructField("edits", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(shared.value)
        for whole in batches:
            at = whole.schema.get_field_index(text)
            offs = ops.flat(whole.column(at))[1]
            for a, b in ops.pieces(offs, PIECE_CHARS):
                batch = whole.slice(a, b - a)
                found = matches([normal(t) for t in batch.column(at).to_pylist()], index)
                ids = [[index.items[i][0] for i in sorted(f)] for f in found]
                edits = [[f[i] for i in sorted(f)] for f in found]
                cols = [pa.array(ids, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema.names)

    return docs.mapInArrow(run, schema)


def find_passages(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS, text: str = "text") -> DataFrame:
    """`docs` with items (ids of the passages found, in order), edits (of each) and contaminated."""
    made = ["items", "edits", "contaminated"]
    found = docs.select(*(c for c in docs.columns if c not in made))
    keep, context = found.columns, docs.sparkSession.sparkContext
    parts: list[tuple[str, str]] = []
    for k, index in enumerate(_index_blocks(benchmark, q, rate, block_chars)):
        if k:
            found = written(found, "searched")  # one index and one Python stage at a time
        found = _search(found, context.broadcast(vars(index)), text)
        parts.append((f"_items{k}", f"_edits{k}"))
        found = found.withColumnsRenamed({"items": parts[-1][0], "edits": parts[-1][1]})
    join = lambda names: reduce(F.concat, [F.col(n) for n in names]) if names else F.array()
    items, edits = join([p[0] for p in parts]), join([p[1] for p in parts])
    return found.select(*keep, items.alias("items"), edits.alias("edits"), (F.size(items) > 0).alias("contaminated"))
