"""Ranked lexical search by norm buckets of impact vectors, as LEMP does for inner products.

A document is the vector of its impacts on the terms that queries use, a query the vector of its term weights; a score is their
inner product. Both carry the square root of the term's weight, so that long vectors are those with many heavy terms.

1. One pass over the texts counts, for each document, its terms and how often it has each term of the queries; counts of documents
   and terms over the whole table follow from that, and with them the impacts and the length (norm) of each vector.
2. Vectors are ordered by length, longest first, and written. A task reads a run of them, slice by slice: a slice is a bucket
   whose greatest length is known.
3. The longest vectors are searched first; their k-th scores are where the others start. By Cauchy-Schwarz a vector shorter than the least
   of score / query length can't win: the scan of the rest leaves these out by the statistics of the written files.
   In a task, a bucket is met only by queries whose length times the bucket's greatest length reaches their k-th score so far.
4. Inside a bucket a query's heaviest coordinates come first: what is known of the product, plus the lengths of what is left of
   both vectors, bounds the score, and vectors below the k-th score drop out group by group.
5. Survivors are scored again in 64-bit integers. Every task sends k rows for each query at most; these are ranked in two steps.

Queries are equal texts folded to one, in blocks of about BLOCK_CHARS characters; a block is one pass over the documents and what is
sent to tasks (its terms and vectors) is bounded by it. Terms meet under 64-bit hashes.

Defined cases: null and empty texts have no terms, match nothing and are in no count; only scores above 0 are ranked; equal scores
go by id, null ids last; repeated documents are ranked each, repeated items get their rows each; items or documents without terms and empty
tables give no rows. Columns other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesledger.llm import textops as ops
from salesledger.llm.storage import written

BLOCK_CHARS = 1 << 20
#: Entries of a bucket, and coordinates that a query looks at before it prunes again.
BUCKET, FOCUS = 1 << 19, 6
#: The longest vectors that are searched first, at least.
FIRST = 1 << 13
#: Bounds are computed in doubles; they may be wrong by this share, and what is left of a squared length by the second.
SLACK, CANCELLED = 1e-9, 1e-12

TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of all texts (lower-cased bytes), and the first term of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    inside = TERM[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offs[offs < n]] = False
    after[offs[offs > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return ops.hashes(data, starts, ends), np.searchsorted(starts, offs)


class Queries:
    """Queries of one block: for each its terms (places in `vocabulary`) and how often it has them."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        data, offs = ops.flat(pa.array(texts, pa.large_string()))
        h, first = terms(ops.LOWER[data], offs)
        self.vocabulary = np.unique(h)
        place = np.searchsorted(self.vocabulary, h)
        self.counts = [np.unique(place[a:b], return_counts=True) for a, b in zip(first, first[1:])]

    def weighted(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Terms (heaviest first), coordinates and whole-number weights of each query; terms without weight are left out."""
        out = []
        for t, n in self.counts:
            order = np.argsort(-n * np.sqrt(weights[t]), kind="stable")
            t, n = t[order], n[order]
            t, n = t[weights[t] > 0], n[weights[t] > 0]
            out.append((t, n * np.sqrt(weights[t]), n * weights[t]))
        return out


def counted(docs: DataFrame, vocabulary: np.ndarray, key: str, text: str) -> DataFrame:
    """(id, n, terms, tfs): the number of terms of each document, and how often it has those of the vocabulary."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = ops.flat(batch.column(1))
            for a, b in ops.pieces(offs):
                h, first = terms(ops.LOWER[data[offs[a] : offs[b]]], offs[a : b + 1] - offs[a])
                n = np.diff(first)
                at = np.minimum(np.searchsorted(vocabulary, h), size - 1)
                known = vocabulary[at] == h
                found, tf = np.unique((np.repeat(np.arange(b - a), n) * size + at)[known], return_counts=True)
                upto = pa.array(np.searchsorted(found, np.arange(b - a + 1) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(upto, pa.array(v.astype(np.int32))) for v in (found % size, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), *lists], ["id", "n", "terms", "tfs"])

    read = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>")


def entries(batch: pa.RecordBatch, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets from 0 of list columns that run alike, and their values."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
    offs = columns[0].offsets.to_numpy().astype(np.int64)
    values = []
    for c in columns:
        o = c.offsets.to_numpy()
        values.append(c.values.to_numpy(zero_copy_only=False)[o[0] : o[-1]].astype(np.int64))
    return offs - offs[0], values


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of every run of values; no run is empty."""
    return np.add.reduceat(values, offs[:-1]) if len(offs) > 1 else values[:0]


def measured(counts: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(id, length, terms, impacts) of the documents with a term that weighs something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, (t, tf) = entries(batch, ("terms", "tfs"))
            n = batch.column(1).to_numpy()
            if len(n) and 25 * int(n.max()) * n_docs >= 1 << 63:
                m = np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], np.int64)
            else:
                m = 75 + 25 * n * n_docs // n_terms
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(offs)))
            square = sums((weights[t] * impact.astype(float) ** 2), offs)
            use = np.flatnonzero(sums((weights[t] > 0).astype(np.int64), offs))
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(impact.astype(np.int32)))
            rows = [batch.column(0), pa.array(np.sqrt(np.maximum(square, 0))), batch.column(2), lists]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(use)) for c in rows], ["id", "length", "terms", "impacts"])

    return counts.where(F.size("terms") > 0).mapInArrow(run, "id long, length double, terms array<int>, impacts array<int>")


def survivors(query, start: np.ndarray, doc: np.ndarray, value: np.ndarray, square: np.ndarray, least: float) -> np.ndarray:
    """Documents of a bucket that may reach `least`; entries are sorted by term, start[t] is the first of term t.

    The bound of a document is its product with the coordinates seen so far, plus the length of what is left of the query
    times the length of what is left of the document.
    """
    t, q, _ = query
    known, seen = np.zeros(len(square)), np.zeros(len(square))
    left = np.cumsum((q * q)[::-1])[::-1]
    live = np.zeros(0, np.int64)
    for a in range(0, len(t), FOCUS):
        for term, weight in zip(t[a : a + FOCUS], q[a : a + FOCUS]):
            at = slice(start[term], start[term + 1])
            known[doc[at]] += weight * value[at]
            seen[doc[at]] += value[at] ** 2
        rest = left[a + FOCUS] if a + FOCUS < len(t) else 0.0
        bound = known + np.sqrt(rest * np.maximum(square * (1 + CANCELLED) - seen, 0))
        live = np.flatnonzero(bound * (1 + SLACK) >= least)
        if len(live) * 20 <= len(square):
            break
    return live


class Best:
    """The k best (score, id) of each query in one task, and the score that others have to reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in least]

    def add(self, q: int, scores: np.ndarray, ids: list) -> None:
        rows = self.rows[q] + [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids)]
        self.rows[q] = sorted(rows)[: self.k]
        if len(self.rows[q]) == self.k:
            self.least[q] = max(self.least[q], -self.rows[q][-1][0])


def best_of(impacts: DataFrame, queries: list, size: int, weights: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """(query, id, score, part): from every task the k best rows of each query that reach `least`."""
    norms = np.array([np.sqrt((q * q).sum()) for _, q, _ in queries])
    roots = np.sqrt(weights)

    def search(batch: pa.RecordBatch, best: Best) -> None:
        length = batch.column(1).to_numpy()
        active = np.flatnonzero(norms * length.max() * (1 + SLACK) >= best.least)
        if not len(active):
            return
        offs, (t, impact) = entries(batch, ("terms", "impacts"))
        doc = np.repeat(np.arange(len(length)), np.diff(offs))
        order = np.argsort(t, kind="stable")
        start = np.searchsorted(t[order], np.arange(size + 1))
        value = (roots[t] * impact)[order]
        by_term, square = doc[order], length**2
        whole = np.zeros(size, np.int64)
        for q in active.tolist():
            live = survivors(queries[q], start, by_term, value, square, best.least[q])
            if not len(live):
                continue
            n = offs[live + 1] - offs[live]
            begins = np.cumsum(n) - n
            rows = np.repeat(offs[live] - begins, n) + np.arange(n.sum())
            whole[queries[q][0]] = queries[q][2]
            scores = sums(whole[t[rows]] * impact[rows], np.append(begins, n.sum()))
            whole[queries[q][0]] = 0
            good = np.flatnonzero(scores >= best.least[q])
            if len(good) > 4 * k:  # only the best can stay, with all that tie with the last of them
                good = good[scores[good] >= np.partition(scores[good], len(good) - k)[len(good) - k]]
            if len(good):
                best.add(q, scores[good], batch.column(0).take(pa.array(live[good])).to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(least, k)
        for batch in batches:
            upto = batch.column(2).offsets.to_numpy().astype(np.int64)
            for a, b in ops.pieces(upto - upto[0], BUCKET):
                search(batch.slice(a, b - a), best)
        rows = [(q, None if none else i, -s) for q, kept in enumerate(best.rows) for s, none, i in kept]
        cols = list(zip(*rows)) or [(), (), ()]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], ["query", "id", "score"])

    found = impacts.mapInArrow(run, "query int, id long, score long")
    return found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank: first inside 64 parts, so that no task gets the rows of all others."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    for keys in (["query", "part"], ["query"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return rows.select("query", "rank", "id", "score")


def searched(docs: DataFrame, queries: Queries, k: int, key: str, text: str) -> DataFrame:
    """(query, rank, id, score) of one block of queries over all documents."""
    size = len(queries.vocabulary)
    counts = written(counted(docs, queries.vocabulary, key, text), "term-counts")
    row = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = int(row["docs"] or 0), int(row["terms"] or 0)
    df = np.zeros(size, np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as the block has terms
        df[r["t"]] = r["count"]
    weights = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)

    lengths = measured(counts, weights, n_docs, n_terms).withColumn("_tie", F.monotonically_increasing_id())
    impacts = written(lengths.orderBy(F.desc("length"), "_tie").drop("_tie"), "impacts", drop_shuffles=True)
    vectors = queries.weighted(weights)
    classes = impacts.groupBy(F.floor(F.log2("length") * 8).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("low"))
    cut, seen = 0.0, 0
    for r in sorted(classes.collect(), key=lambda r: -r["c"]):  # eight rows for each doubling of length
        cut, seen = r["low"], seen + r["n"]
        if seen >= FIRST:
            break
    first = written(best_of(impacts.where(F.col("length") >= cut), vectors, size, weights, np.ones(len(vectors)), k), "first")
    least = np.ones(len(vectors))
    for r in ranked(first, k).where(F.col("rank") == k).collect():  # a row for each query of the block
        least[r["query"]] = r["score"]
    norms = np.array([np.sqrt((q * q).sum()) for _, q, _ in vectors])
    reach = min((s / n for s, n in zip(least.tolist(), norms.tolist()) if n), default=0.0) * (1 - SLACK)
    rest = impacts.where((F.col("length") < cut) & (F.col("length") >= reach))
    return ranked(first.unionByName(best_of(rest, vectors, size, weights, least, k)), k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(item, rank, document, score): the k highest-scoring documents of each item, equal scores by ascending id."""
    spark = docs.sparkSession
    asked = items.where(F.col(text).isNotNull()).select(F.col(item).alias("_item"), F.col(text).alias("_asked"))
    texts = asked.groupBy("_asked").agg(F.length("_asked").alias("_chars"))
    n = 1 + int(texts.agg(F.sum("_chars")).first()[0] or 0) // block_chars
    schema, parts = asked.schema, []
    for block in range(n):
        rows = texts.where(F.pmod(F.xxhash64("_asked"), F.lit(n)) == block).select("_asked").collect()
        queries = Queries(sorted(r[0] for r in rows))
        if not len(queries.vocabulary):
            continue
        found = written(searched(docs, queries, k, key, text), "ranked")
        names = spark.createDataFrame(list(enumerate(queries.texts)), "_query int, _text string")
        named = found.join(F.broadcast(names), F.col("query") == F.col("_query")).select("_text", "rank", "id", "score")
        parts.append(asked.join(named, F.col("_asked") == F.col("_text")).select("_item", "rank", "id", "score"))
    if not parts:
        return spark.createDataFrame([], schema).select(
            F.col("_item").alias(item), F.lit(0).alias("rank"), F.lit(0).cast("long").alias(key), F.lit(0).cast("long").alias("score")
        )
    return reduce(DataFrame.unionByName, parts).select(F.col("_item").alias(item), "rank", F.col("id").alias(key), "score")
