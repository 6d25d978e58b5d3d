"""Language-model scoring by deleted interpolation.

P(w | u) = a_b * c(u w) / c(u) + b_b * c(w) / N + c_b / (V + 1), with u the word before w (a boundary sign at the beginning), the end
of a text a token of its own, and weights a, b, c for each bucket b of the context's frequency (powers of two). The weights
are learned by expectation-maximisation on held-out counts in the deleted sense: every training token is predicted from
counts from which it has been taken out.

Words and word pairs are counted over all training documents with the packed exchange of blocks.py: one shuffle of the
documents, one of the distinct keys of each block, one of the counts back. The counts of each token are then written
to the shared folder, so that learning weights (a histogram on a fixed grid) and scoring read them without a shuffle.
Words travel as 48 bits of a hash and word pairs as 40, besides the bits that name one of many parts of a bounded size: two words of a
corpus meet by chance hardly ever, a pair meets another about once in a million, and then counts at most as often as its words.

Defined cases: a null or empty text is one end token; rows may repeat and count as often as they stand there; a null id counts as the empty text
and so trains; without training documents every token gets 1 / (V + 1) = 1; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger.llm import blocks
from salesledger.llm import textops as ops
from salesledger.llm.storage import written

END = np.uint64(0x51ED270B9F3A6C1D)
BUCKETS = 48
#: Cells of the weight histogram for each power of ten of a probability.
GRID = 20
ROUNDS = 60
SLICE = 1 << 18
#: Bytes of a hash that travel; a part is a range of hashes, so the leading bits go without saying.
WORD_BYTES, PAIR_BYTES = 6, 5
COUNTS = "doc_id long, held_out boolean, word_counts array<int>, pair_counts array<int>, word_big array<long>, pair_big array<long>, vocabulary long"
LISTS = ["word_counts", "pair_counts", "word_big", "pair_big"]
#: Beyond MOST a text holds -k in place of a count, for the k-th of its big counts; from WIDE on a part sends 64 bits.
MOST, WIDE = (1 << 31) - 1, 1 << 32


def held_out(doc: Column) -> Column:
    """Documents that are scored without having been learned from."""
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token, hash of each pair with the token before, and the first token of each text."""
    data, offs = ops.flat(table.column("text"))
    token, pair, first = [], [], [np.zeros(1, np.int64)]
    done = 0
    for a, b in ops.pieces(offs):
        low = ops.LOWER[data[offs[a] : offs[b]]]
        starts, ends, word0 = ops.words(low, offs[a : b + 1] - offs[a])
        n = np.diff(word0) + 1
        upto = np.cumsum(n)
        h = np.full(int(upto[-1]), END, np.uint64)
        word = np.ones(len(h), bool)
        word[upto - 1] = False
        h[word] = ops.hashes(low, starts, ends)
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[upto - n] = END
        token.append(h)
        pair.append(ops.mix(before * ops.K1 + h * ops.K2 + ops.K3))
        first.append(done + upto)
        done += int(upto[-1])
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(token or none), np.concatenate(pair or none), np.concatenate(first)


def narrowed(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[list[int] | None]]:
    """Counts in 32 bits, and the big counts of each text, which stand as -1, -2, ... in their places."""
    out, over = counts.astype(np.int32), [None] * (len(first) - 1)
    at = np.flatnonzero(counts > MOST)
    for k in np.unique(np.searchsorted(first, at, "right") - 1).tolist():
        mine = at[(at >= first[k]) & (at < first[k + 1])]
        values, place = np.unique(counts[mine], return_inverse=True)
        out[mine] = -1 - place
        over[k] = values.tolist()
    return out, over


def widened(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The whole counts of all texts of a batch, and the first one of each text."""
    column = lambda c: batch.column(batch.schema.get_field_index(f"{name}_{c}"))
    lists, big = column("counts"), column("big")
    offs = lists.offsets.to_numpy().astype(np.int64)
    counts = lists.values.to_numpy()[offs[0] : offs[-1]].astype(np.int64)
    first = offs - offs[0]
    at = np.flatnonzero(counts < 0)
    if len(at):
        text = np.searchsorted(first, at, "right") - 1
        counts[at] = big.values.to_numpy()[big.offsets.to_numpy()[text] - counts[at] - 1]
    return counts, first


def count_tokens(docs: DataFrame, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """For each document the training counts of its tokens and pairs, in order; rows with `vocabulary` add up to V."""
    rows, n_blocks = blocks.blocked(docs, [F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"], block_bytes)
    n_parts = blocks.parts(n_blocks, block_bytes)

    def send(table: pa.Table) -> pa.Table:
        table = blocks.ordered(table)
        token, pair, first = _tokens(table)
        trains = np.repeat(~np.array(table.column("held_out").to_pylist(), bool), np.diff(first))
        out = {c: [] for c in ("part", "block", "words", "word_n", "pairs", "pair_n")}
        sides = []
        for keys in (token, pair):
            unique, place, bounds = blocks.deal(keys, n_parts)
            sides.append((unique, np.bincount(place, trains, len(unique)).astype(np.uint32), bounds))
        for p in range(n_parts):
            (w, wn, wb), (x, xn, xb) = sides
            wa, we, xa, xe = wb[p], wb[p + 1], xb[p], xb[p + 1]
            if wa < we or xa < xe:
                out["part"].append(p)
                out["words"].append(blocks.packed(w[wa:we], WORD_BYTES))
                out["word_n"].append(wn[wa:we].tobytes())
                out["pairs"].append(blocks.packed(x[xa:xe], PAIR_BYTES))
                out["pair_n"].append(xn[xa:xe].tobytes())
        out["block"] = [table.column("block")[0].as_py()] * len(out["part"])
        return pa.table({c: pa.array(v, pa.int32() if c in ("part", "block") else pa.binary()) for c, v in out.items()})

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        read = lambda c: [np.frombuffer(x, np.uint32) for x in table.column(c).to_pylist()]
        words = [blocks.unpacked(x, WORD_BYTES) for x in table.column("words").to_pylist()]
        pairs = [blocks.unpacked(x, PAIR_BYTES) for x in table.column("pairs").to_pylist()]
        back = [blocks.summed(words, read("word_n")), blocks.summed(pairs, read("pair_n"))]
        known = len(np.unique(np.concatenate([w[c > 0] for w, c in zip(words, back[0])])))
        part, block = table.column("part")[0].as_py(), table.column("block").to_pylist()
        cols = [[x.astype(np.int64 if len(x) and x.max() >= WIDE else np.uint32).tobytes() for x in side] for side in back]
        return pa.table({
            "block": pa.array(block, pa.int32()), "part": pa.array([part] * len(block), pa.int32()),
            "word_n": pa.array(cols[0], pa.binary()), "pair_n": pa.array(cols[1], pa.binary()),
            "vocabulary": pa.array([known] + [0] * (len(block) - 1), pa.int64()),
        })

    def receive(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, answers = blocks.ordered(table), answers.sort_by("part")
        token, pair, first = _tokens(table)
        lists, big = [], []
        for keys, c in ((token, "word_n"), (pair, "pair_n")):
            _, place, bounds = blocks.deal(keys, n_parts)
            sizes = np.diff(bounds)[answers.column("part").to_numpy()]
            values = [np.frombuffer(x, np.uint32 if len(x) == 4 * n else np.int64).astype(np.int64) for x, n in zip(answers.column(c).to_pylist(), sizes)]
            counts, over = narrowed(np.concatenate(values or [np.zeros(0, np.int64)])[place], first)
            lists.append(pa.ListArray.from_arrays(pa.array(np.append(first, first[-1]), pa.int32()), pa.array(counts)))
            big.append(pa.array([*over, None], pa.list_(pa.int64())))
        n = table.num_rows
        return pa.table({
            "doc_id": pa.concat_arrays([table.column("doc_id").combine_chunks(), pa.nulls(1, pa.int64())]),
            "held_out": pa.array([*table.column("held_out").to_pylist(), None], pa.bool_()),
            "word_counts": lists[0], "pair_counts": lists[1], "word_big": big[0], "pair_big": big[1],
            "vocabulary": pa.array([None] * n + [sum(answers.column("vocabulary").to_pylist())], pa.int64()),
        })

    sent = rows.groupBy("block").applyInArrow(send, "part int, block int, words binary, word_n binary, pairs binary, pair_n binary")
    back = sent.groupBy("part").applyInArrow(answer, "block int, part int, word_n binary, pair_n binary, vocabulary long")
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(receive, COUNTS)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of whole documents of about SLICE tokens, so that what a task works on stays small."""
    for batch in batches:
        offs = batch.column(batch.schema.get_field_index("word_counts")).offsets.to_numpy().astype(np.int64)
        for a, b in ops.pieces(offs, SLICE):
            yield batch.slice(a, b - a)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """c(w), c(u) and c(u w) of all tokens of a batch, and the first token of each text."""
    w, first = widened(batch, "word")
    x, _ = widened(batch, "pair")
    u = np.empty_like(w)
    u[1:] = w[:-1]
    full = first[:-1][first[:-1] < first[1:]]
    u[full] = w[first[1:][first[:-1] < first[1:]] - 1]  # a text begins after the boundary sign, which is as frequent as the end
    return w, u, np.minimum(x, np.minimum(u, w)), first


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the power of two below its count."""
    return np.minimum(BUCKETS - 1, np.frexp(context.astype(float))[1].astype(np.int64))


def _cells(counts: DataFrame, tokens: int) -> list[tuple[int, int, int, int]]:
    """Training tokens by bucket and by the grid cells of their deleted pair and word probabilities (none: -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in _slices(batches):
            w, u, x, first = _arrays(b)
            use = np.repeat(~np.array(b.column(0).to_pylist(), bool), np.diff(first))
            w, u, x = w[use] - 1, u[use] - 1, x[use] - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                cell = [np.where(c > 0, np.round(-GRID * np.log10(c / np.maximum(n, 1))), -1).astype(np.int64) for c, n in ((x, u), (w, tokens - 1))]
            key, n = np.unique((_bucket(u) << 40) | ((cell[0] + 1) << 20) | (cell[1] + 1), return_counts=True)
            for k, v in zip(key.tolist(), n.tolist()):
                total[k] = total.get(k, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["key", "n"])

    rows = counts.where("vocabulary is null").select("held_out", *LISTS).mapInArrow(run, "key long, n long")
    rows = rows.groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").collect()  # the grid bounds the number of rows
    return [(r["key"] >> 40, ((r["key"] >> 20) & 0xFFFFF) - 1, (r["key"] & 0xFFFFF) - 1, r["n"]) for r in rows]


def learn_weights(cells: list[tuple[int, int, int, int]], vocabulary: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (pair, word, uniform) of each bucket by expectation-maximisation."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    if not cells:
        return weights
    bucket, pair, word, n = (np.array(x) for x in zip(*cells))
    p = np.stack([np.where(x >= 0, 10.0 ** (-np.maximum(x, 0) / GRID), 0) for x in (pair, word)] + [np.full(len(n), 1 / (vocabulary + 1))], axis=1)
    p[bucket == 0, 0] = 0
    for _ in range(rounds):
        part = weights[bucket] * p
        part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        sums = np.stack([np.bincount(bucket, part[:, k], BUCKETS) for k in range(3)], axis=1)
        overall = sums.sum(axis=0) / max(sums.sum(), 1e-300)
        sums += 3 * np.maximum(overall, 1e-6)  # buckets with few tokens lean on the whole
        sums[0, 0] = 0
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def score_documents(docs: DataFrame, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """For each document: held_out, n_tokens, n_known, train_tokens, base_score (add-half unigrams) and score, log10."""
    counts = written(count_tokens(docs, block_bytes), "token-counts")
    size = F.sum(F.when(~F.col("held_out"), F.size("word_counts"))).alias("n")
    row = counts.agg(size, F.sum("vocabulary").alias("v")).first()
    tokens, vocabulary = int(row["n"] or 0), int(row["v"] or 0)
    weights = learn_weights(_cells(counts, tokens), vocabulary)
    fields = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            w, u, x, first = _arrays(b)
            total = lambda v: np.add.reduceat(v, first[:-1]) if len(v) else np.zeros(0)
            base = total(np.log10((w + 0.5) / (tokens + 0.5 * (vocabulary + 1))))
            by = weights[_bucket(u)]
            p = by[:, 0] * x / np.maximum(u, 1) + by[:, 1] * w / max(tokens, 1) + by[:, 2] / (vocabulary + 1)
            score = total(np.log10(np.maximum(p, 1e-300)))
            cols = [b.column(0), b.column(1), pa.array(np.diff(first)), pa.array(total((w > 0).astype(np.int64)), pa.int64())]
            cols += [pa.array(np.full(b.num_rows, tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, fields)

    texts = counts.where("vocabulary is null").select("doc_id", "held_out", *LISTS)
    return texts.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
