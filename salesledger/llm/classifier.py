"""Quality classifier: hashed word n-grams and logistic regression, trained with follow-the-regularised-leader updates.

Tokens are runs of letters and digits (every byte from 0x80 counts as a letter) or of other signs, as they are written. Tokens and
pairs of neighbouring tokens fall into 2^BITS buckets by hash; a text is the vector of the logarithms of 1 + count, scaled to length 1, and its
score the logistic function of a sparse dot product with the weights and a bias.

Training reads at most SAMPLE different labelled documents (the ones with the smallest hashes, whole texts), in the order of their
hashes. A pass is one task that streams them and holds the sums of gradients and of squared gradients of each bucket, nothing else; the
next pass starts where it ended. Scoring reads every document once, without a shuffle; what is sent to the tasks are the
weights, whose number is fixed.

Defined cases: null and empty texts have no features and get the bias alone; several labels of one id are folded (1 if at least half of
them are 1), null labels and ids without a document are left out; equal (id, text) rows train once; without labelled documents every
score is 0.5; an empty table gives an empty table. Columns other than id, text and label are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger.llm import textops as ops
from salesledger.llm.storage import sampled, written

BITS = 18
SAMPLE, PASSES = 20_000, 3
#: Learning rate, smoothing of the rate, and weights of the absolute and the squared penalty.
ALPHA, BETA, L1, L2 = 8.0, 1.0, 0.02, 0.0
PIECE_BYTES = 2 << 20

#: 0 white space, 1 letters and digits, 2 other signs.
KIND = np.full(256, 2, np.uint8)
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
KIND[[0x20, *range(0x09, 0x0E)]] = 0


def held_out(doc: Column) -> Column:
    """Documents whose labels are not learned from."""
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of all texts, and the first token of each text."""
    n = len(data)
    kind = KIND[data]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offs[offs < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    return ops.hashes(data, starts, ends), np.searchsorted(starts, offs)


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and values of all texts one after another, and the first entry of each text."""
    h, first = tokens(data, offs)
    n = len(offs) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    pair = np.flatnonzero(text[1:] == text[:-1])
    keys = [ops.mix(h * ops.K1), ops.mix(h[pair] * ops.K2 + h[pair + 1] * ops.K3)]
    bucket = (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64)
    found, count = np.unique(np.concatenate([text, text[pair]]) << bits | bucket, return_counts=True)
    upto = np.searchsorted(found, np.arange(n + 1) << bits)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(found >> bits, value * value, n))
    return found & ((1 << bits) - 1), value / np.repeat(norm, np.diff(upto)), upto


def chosen(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> DataFrame:
    """(_key, _label, text) of the documents that are learned from: one row for each id and text, texts are shuffled for these only."""
    votes = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    votes = votes.groupBy(F.col(key).alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    ids = docs.select(F.col(key).alias("_doc"), F.xxhash64(key, text).alias("_key"))
    known = written(ids.join(votes, F.col("_doc") == F.col("_id")).groupBy("_key").agg(F.max("_label").alias("_label")), "labelled")
    few = sampled(known, "_key", sample).select(F.col("_key").alias("_k"), "_label")
    rows = docs.select(F.xxhash64(key, text).alias("_key"), F.col(text).alias("text"))
    return rows.join(F.broadcast(few), F.col("_key") == F.col("_k")).groupBy("_key", "_label").agg(F.first("text").alias("text"))


def featured(rows: DataFrame, bits: int) -> DataFrame:
    """(key, label, buckets, values) of rows (_key, _label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = ops.flat(batch.column(2))
            for a, b in ops.pieces(offs, PIECE_BYTES):
                bucket, value, upto = features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], bits)
                lists = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), v) for v in (pa.array(bucket, pa.int32()), pa.array(value, pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *lists], ["key", "label", "buckets", "values"])

    return rows.select("_key", "_label", "text").mapInArrow(run, "key long, label int, buckets array<int>, values array<double>")


class Leader:
    """The state of the learner: sums z of gradients less their pull, and n of squared gradients. The last place is the bias."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        far = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -far / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (logistic(w @ x) - label) * x
        pull = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - pull * w
        self.n[at] += g * g


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def trained(rows: DataFrame, bits: int, passes: int) -> np.ndarray:
    """The weights after all passes over featured rows; the last one is the bias."""
    context, size = rows.sparkSession.sparkContext, 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    ordered = rows.coalesce(1).sortWithinPartitions("key")
    for _ in range(passes):
        state = context.broadcast((z, n))

        def run(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            leader = Leader(*(v.copy() for v in state.value))
            for batch in batches:
                label = batch.column(1).to_numpy()
                bucket, value = batch.column(2), batch.column(3)
                upto, from_ = bucket.offsets.to_numpy(), value.offsets.to_numpy()
                b, v = bucket.values.to_numpy(), value.values.to_numpy()
                for k, y in enumerate(label.tolist()):
                    at, x = np.append(b[upto[k] : upto[k + 1]], size), np.append(v[from_[k] : from_[k + 1]], 1.0)
                    leader.learn(at, x, y)
            yield pa.RecordBatch.from_arrays([pa.array([leader.z.tobytes()]), pa.array([leader.n.tobytes()])], ["z", "n"])

        row = ordered.mapInArrow(run, "z binary, n binary").first()
        state.destroy()
        if row is None:  # no rows, no task
            break
        z, n = (np.frombuffer(row[c], np.float64) for c in ("z", "n"))
    return Leader(z, n).weights(np.arange(size + 1))


def scored(docs: DataFrame, weights: np.ndarray, key: str, text: str, bits: int) -> DataFrame:
    """(key, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            data, offs = ops.flat(batch.column(1))
            for a, b in ops.pieces(offs, PIECE_BYTES):
                bucket, value, upto = features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], bits)
                dots = np.bincount(np.repeat(np.arange(b - a), np.diff(upto)), value * w[bucket], b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(logistic(dots + w[-1]))], ["id", "score"])

    read = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(run, "id long, score double").withColumnRenamed("id", key)


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "label",
    sample: int = SAMPLE, passes: int = PASSES, bits: int = BITS,
) -> DataFrame:
    """(key, held_out, score, predicted) of every document; labels (key, label 0 or 1) of documents that aren't held out are learned."""
    rows = written(featured(chosen(docs, labels, key, text, label, sample), bits), "features")
    found = scored(docs, trained(rows, bits, passes), key, text, bits)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
