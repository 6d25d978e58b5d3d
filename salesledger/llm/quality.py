"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths over the words of a text mark every word inside an n-gram that occurs
twice or more; the share of characters in such words, and in lines that repeat, decides. One pass without a shuffle.

Defined cases: a null or empty text has no words, all counts are 0 and it fails the base rule; texts of any length
are measured whole; repeated rows are measured each on its own; an empty table gives an empty table. Input columns
that share a name with a result column are replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from salesledger.llm import textops as ops

#: Most characters, of those in words, that may lie in n-grams (by n) that occur twice or more.
COVERAGE_LIMITS = {4: 0.5, 6: 0.4, 10: 0.3}
#: Most characters, of those in words, that may lie in lines equal to an earlier line.
LINE_LIMIT = 0.3
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _lines(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
    """Start, end and text of each line that has a word."""
    breaks = np.flatnonzero(data == 10) + 1
    begin = np.unique(np.concatenate([offs[:-1], breaks[breaks < len(data)]])) if len(data) else np.zeros(0, np.int64)
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))
    has = np.searchsorted(starts, begin) < np.searchsorted(starts, end)
    begin, end = begin[has], end[has]
    end = end - (data[end - 1] == 10)
    return begin, end, np.searchsorted(offs, begin, "right") - 1


def measure(data: np.ndarray, offs: np.ndarray, limits: dict[int, float], line_limit: float) -> dict[str, np.ndarray]:
    """The counts, the coverage of each n and the verdict of every text."""
    n = len(offs) - 1
    starts, ends, first = ops.words(data, offs)
    per_text = np.diff(first)
    text = np.repeat(np.arange(n), per_text)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[first])
    inner = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    chars = inner[ends] - inner[starts]
    symbols = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), dtype=np.int64)])
    out = {"n_words": per_text, "word_chars": total(chars), "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]]}

    own = ops.mix(np.arange(n, dtype=np.uint64) + ops.K3)
    begin, end, owner = _lines(data, offs, starts, ends, first)
    _, later = ops.repeated(ops.mix(ops.hashes(data, begin, end) ^ own[owner]))
    out["n_dup_lines"] = np.bincount(owner[later], minlength=n)[:n]
    done = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    in_lines = (done[np.searchsorted(starts, end)] - done[np.searchsorted(starts, begin)])[later]
    line_chars = np.bincount(owner[later], in_lines, minlength=n)[:n]

    h = ops.hashes(data, starts, ends)
    most = np.maximum(out["word_chars"], 1)
    out["line_coverage"] = line_chars / most
    good = out["line_coverage"] <= line_limit
    for size in sorted({WINDOW, *limits}):
        keys, at = ops.grams(h, first, size)
        twice, _ = ops.repeated(keys + own[text[at]])
        inside = ops.covered(at[twice], size, len(h))
        if size == WINDOW:
            out["n_repeat_words"] = total(inside)
        if size in limits:
            out[f"coverage_{size}"] = total(chars * inside) / most
            good &= out[f"coverage_{size}"] <= limits[size]
    out["base_failed"] = (per_text < 20) | (100 * out["n_repeat_words"] > 30 * per_text)
    out["kept"] = ~out["base_failed"] & good
    return out


def repetition_coverage(
    docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, text: str = "text"
) -> DataFrame:
    """`docs` with the word and repetition counts, the coverage of each n-gram length, base_failed and kept."""
    limits = COVERAGE_LIMITS if limits is None else limits
    longs, doubles = COUNTS, ["line_coverage", *(f"coverage_{n}" for n in sorted(limits))]
    made = [*longs, *doubles, "base_failed", "kept"]
    plain = docs.select(*(c for c in docs.columns if c not in made))
    schema = T.StructType(
        [*plain.schema.fields]
        + [T.StructField(c, T.LongType()) for c in longs]
        + [T.StructField(c, T.DoubleType()) for c in doubles]
        + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    )

    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = ops.flat(batch.column(batch.schema.get_field_index(text)))
            for a, b in ops.pieces(offs):
                base = offs[a]
                found = measure(data[base : offs[b]], offs[a : b + 1] - base, limits, line_limit)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[c]) for c in made)], names)

    return plain.mapInArrow(run, schema)
