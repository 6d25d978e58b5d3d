import math
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from salesledger.llm import centroids, queries
from tests.llm.data import FOLDER


def brute(rows, k=16, rounds=3, dims=64, scale=64, seed=1):
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), vector by vector."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: (i is None, sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    cents = [x for _, x in sorted(((mark(i), x) for i, x in kept))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    out = [(i, *nearest(x)) for i, x in kept]
    inertia = Counter()
    for _, d, c in out:
        inertia[c] += d
    total = sum(inertia.values())
    return sorted(((i, c, d, inertia[c], total, sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, d, c in out), key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(queries.op12_clusters(spark, FOLDER)) == brute(rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_vectors(spark, kind):
    r = np.random.default_rng(2)
    good = [[float(x) for x in np.float32(r.normal(0, 0.3, 6))] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(good)] + [(7, good[7]), (7, good[7]), (7, good[9]), (None, good[3]), (None, good[4])]
    rows += [(100, None), (101, []), (102, good[0][:5]), (103, good[0] + [0.0]), (104, [None] + good[0][1:]), (105, [float("nan")] + good[0][1:])]
    rows += [(106, [float("inf")] + good[0][1:]), (107, [0.0] * 6), (108, [-0.0] * 6), (109, [1000.0, -1000.0] * 3)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance string").repartition(3)
    for k, width, chunk in ((4, 2, 1 << 15), (4, 4, 7), (3, 1, 5), (500, 2, 16)):
        out = centroids.cluster(frame, k, 3, 6, 64, 1, width=width, chunk=chunk)
        assert found(out) == brute(rows, k, 3, 6)
    assert centroids.cluster(frame.limit(0)).count() == centroids.cluster(frame.where("vec_id >= 100 and vec_id < 107"), dims=6).count() == 0


def test_dictionary_is_lossless():
    x = np.random.default_rng(1).integers(-20, 20, (5000, 2))
    table, code = centroids.dictionary(x)
    assert (table[code] == x).all() and len(table) == len(np.unique(x, axis=0)) < 1700


def test_far_components_are_refused():
    with pytest.raises(ValueError, match="beyond"):
        centroids.scaled(pa.array([[1e9, 0.0]]), 2, 64)
