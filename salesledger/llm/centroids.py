"""Centroid clustering (k-means on integers) by subvector dictionaries.

The dimensions are cut into blocks of WIDTH. Every chunk of at most CHUNK vectors holds, for each block, the distinct
subvectors and one short code for each vector: a lossless encoding, like the dictionary pages of a column file. A round
computes the squared distance of every distinct subvector to every centroid once for each chunk, and a vector's distance is the sum of
the partial distances that its codes name. Sums for new centroids come from counts of codes, so no round touches the vectors themselves.

Vectors are encoded in one pass and written to the shared folder; a round reads the codes without a shuffle, and each task sends
one row for each centroid and dimension. A dictionary lives in one chunk: no table of subvectors is sent to tasks or to the driver, which
holds k centroids only. All arithmetic is in integers.

Defined cases: vectors with another number of components, a null or a non-finite one, and null vectors are left out; fewer kept
vectors than centroids make every one a centroid; rows may repeat and count as often as they stand there; ids may repeat or be null (null ids
come last among the seeds, ties are settled by the components); an empty table gives an empty table. Columns other than id and vector are
not read, so their names cannot clash. A component beyond 2^27 after scaling raises, since its squared distance need not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger.llm.storage import written

#: Dimensions of a block, and vectors that share a dictionary (their codes take 16 bits).
WIDTH, CHUNK = 2, 1 << 15
LARGEST = 1 << 27


def scaled(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are kept, and their components as integers floor(scale * x)."""
    if not len(column) or pa.types.is_null(column.type):
        return np.zeros(0, np.int64), np.zeros((0, dims), np.int64)
    offs = column.offsets.to_numpy().astype(np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(valid & (np.diff(offs) == dims))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
    x = values[offs[rows][:, None] + np.arange(dims)]
    good = np.isfinite(x).all(axis=1)
    x = np.floor(x[good] * scale)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a scaled component is beyond {LARGEST}")
    return rows[good], x.astype(np.int64)


def dictionary(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a block of columns, and the code of every row."""
    code = np.zeros(len(block), np.int64)
    for j in range(block.shape[1]):
        low = block[:, j].min()
        span = block[:, j].max() - low + 1
        _, first, code = np.unique(code * span + (block[:, j] - low), return_index=True, return_inverse=True)
    return block[first], code


def encoded(vectors: DataFrame, key: str, vector: str, dims: int, scale: int, width: int, chunk: int) -> DataFrame:
    """One row for each chunk: ids, codes (a row of 16-bit codes for each block), and the dictionaries one after another."""

    def pack(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        ids, x = pa.concat_arrays(ids), np.concatenate(parts)
        codes, entries, sizes = [], [], []
        for a in range(0, dims, width):
            entry, code = dictionary(x[:, a : a + width])
            codes.append(code.astype("<u2").tobytes())
            entries.append(entry.astype("<i4").tobytes())
            sizes.append(len(entry))
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([b"".join(codes)], pa.binary()), pa.array([b"".join(entries)], pa.binary()), pa.array([sizes], pa.list_(pa.int32())),
            ],
            ["ids", "codes", "entries", "sizes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for batch in batches:
            rows, x = scaled(batch.column(1), dims, scale)
            keys = batch.column(0).take(pa.array(rows))
            for a in range(0, len(x), chunk):
                if n + len(x[a : a + chunk]) > chunk:
                    yield pack(ids, parts)
                    ids, parts, n = [], [], 0
                ids.append(keys.slice(a, chunk))
                parts.append(x[a : a + chunk])
                n += len(parts[-1])
        if n:
            yield pack(ids, parts)

    read = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    return read.mapInArrow(run, "ids array<long>, codes binary, entries binary, sizes array<int>")


def chunks(batch: pa.RecordBatch, dims: int, width: int) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray]]]:
    """Ids, codes by block, and the dictionary of each block, chunk by chunk."""
    widths = [min(width, dims - a) for a in range(0, dims, width)]
    for r in range(batch.num_rows):
        ids, codes, entries, sizes = (batch.column(c)[r] for c in range(4))
        flat, at, tables = np.frombuffer(entries.as_buffer(), "<i4").astype(np.int64), 0, []
        for w, m in zip(widths, sizes.as_py()):
            tables.append(flat[at : at + w * m].reshape(m, w))
            at += w * m
        yield ids.values, np.frombuffer(codes.as_buffer(), "<u2").reshape(len(widths), -1), tables


def nearest(codes: np.ndarray, tables: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (of equally near ones the first) and squared distance of each vector of a chunk."""
    total, at = np.zeros((codes.shape[1], len(centroids)), np.int64), 0
    for code, table in zip(codes, tables):
        w = table.shape[1]
        part = ((table[:, None, :] - centroids[None, :, at : at + w]) ** 2).sum(axis=2)
        total += part[code]
        at += w
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best]


def seeds(vectors: DataFrame, key: str, vector: str, dims: int, scale: int, k: int, seed: int) -> list[list[int]]:
    """The k kept vectors with the smallest hashes of seed and id; every task sends k rows at most."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    rows = vectors.where((F.size(vector) == dims) & F.forall(vector, finite)).select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).alias("h"), ints.alias("x")
    )
    return [r["x"] for r in rows.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()]


def moved(codes: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors; empty ones stay."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, code, tables in chunks(batch, dims, width):
                best, at = nearest(code, tables, centroids)[0], 0
                counts += np.bincount(best, minlength=k)
                for c, table in zip(code, tables):
                    used = np.bincount(best * len(table) + c, minlength=k * len(table)).reshape(k, -1)
                    sums[:, at : at + table.shape[1]] += used @ table
                    at += table.shape[1]
        whole = np.concatenate([counts[:, None], sums], axis=1).ravel()
        place = np.arange(len(whole), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(whole)], ["place", "value"])

    parts = codes.mapInArrow(run, "place int, value long").groupBy("place")
    total = {r["place"]: int(r["value"]) for r in parts.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    out = centroids.copy()
    for c in range(k):
        n = total.get(c * (dims + 1), 0)
        if n:
            out[c] = [total[c * (dims + 1) + 1 + d] // n for d in range(dims)]
    return out


def assigned(codes: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """(id, cluster, distance) of every kept vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, code, tables in chunks(batch, dims, width):
                best, far = nearest(code, tables, centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(far)], ["id", "cluster", "distance"])

    return codes.mapInArrow(run, "id long, cluster int, distance long")


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1,
    key: str = "vec_id", vector: str = "embedding", width: int = WIDTH, chunk: int = CHUNK,
) -> DataFrame:
    """For each kept vector its id, cluster, squared distance, the sums of distances over its cluster and over all, and the
    SHA-256 of its final centroid."""
    first = seeds(vectors, key, vector, dims, scale, k, seed)
    centroids = np.array(first, np.int64).reshape(len(first), dims)
    out = "id long, cluster int, distance long"
    if first:
        codes = written(encoded(vectors, key, vector, dims, scale, width, chunk), "codes")
        for _ in range(rounds):
            centroids = moved(codes, centroids, width)
        found = written(assigned(codes, centroids, width), "assigned")
    else:
        found = vectors.sparkSession.createDataFrame([], out)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    marks = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = [(c, s, sum(sums.values()), marks[c]) for c, s in sums.items()]
    totals = vectors.sparkSession.createDataFrame(table, "_c int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = found.join(F.broadcast(totals), F.col("cluster") == F.col("_c"))
    return rows.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
