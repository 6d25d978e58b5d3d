import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from salesledger.llm import classifier, queries
from salesledger.llm import textops as ops

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")


def buckets(text, bits):
    """Bucket and value of one text, token by token."""
    raw = [m.group() for m in TOKEN.finditer((text or "").encode())]
    one = lambda b: ops.hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))
    h = [one(t) for t in raw]
    keys = [ops.mix(x * ops.K1) for x in h] + [ops.mix(a * ops.K2 + b * ops.K3) for a, b in zip(h, h[1:])]
    count = Counter(int(k[0]) >> (64 - bits) for k in keys)
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in count.values()))
    return {b: math.log1p(c) / norm for b, c in count.items()}


def weight(z, n):
    if abs(z) <= classifier.L1:
        return 0.0
    return -(z - math.copysign(classifier.L1, z)) / ((classifier.BETA + math.sqrt(n)) / classifier.ALPHA + classifier.L2)


def logistic(x):
    return 1 / (1 + math.exp(-x))


def learned(rows, passes):
    """Coordinate by coordinate: rows of (features, label) in order; the bias has the key None."""
    z, n = Counter(), Counter()
    for _ in range(passes):
        for x, y in rows:
            x = x | {None: 1.0}
            w = {k: weight(z[k], n[k]) for k in x}
            p = logistic(sum(w[k] * v for k, v in x.items()))
            for k, v in x.items():
                g = (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / classifier.ALPHA * w[k]
                n[k] += g * g
    return {k: weight(z[k], n[k]) for k in z}


def area(scores, labels):
    good, bad = ([s for s, y in zip(scores, labels) if y == k] for k in (1, 0))
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_features(odd):
    texts = [r["text"] for r in odd.collect()]
    data, offs = ops.flat(pa.array(texts, pa.large_string()))
    found, value, upto = classifier.features(data, offs, 12)
    for k, text in enumerate(texts):
        got = dict(zip(found[upto[k] : upto[k + 1]].tolist(), value[upto[k] : upto[k + 1]].tolist()))
        want = buckets(text, 12)
        assert got.keys() == want.keys() and all(math.isclose(got[b], want[b]) for b in want)


def test_odd_rows_equal_brute_force(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    marks = [(i, int(i % 3 > 0)) for i in range(1, 20)] + [(4, 0), (4, None), (None, 0), (999, 1)]
    labels = spark.createDataFrame([(*m, 5) for m in marks], "doc_id long, label int, score int")
    votes = {}
    for i, y in marks:
        if i is not None and y is not None and crc32(str(i).encode()) % 5:
            votes.setdefault(i, []).append(y)
    pairs = {r for r in rows if r[0] in votes}
    order = {tuple(r[1:]): r[0] for r in odd.selectExpr("xxhash64(doc_id, text)", "doc_id", "text").collect()}
    train = [(buckets(t, 12), int(sum(votes[i]) * 2 >= len(votes[i]))) for i, t in sorted(pairs, key=lambda r: order[r])]
    w = learned(train, 2)
    want = sorted((str(i), crc32(str("" if i is None else i).encode()) % 5 == 0, logistic(w[None] + sum(w.get(b, 0) * v for b, v in buckets(t, 12).items()))) for i, t in rows)
    out = sorted((str(r["doc_id"]), r["held_out"], r["score"], r["predicted"]) for r in classifier.classify(odd, labels, passes=2, bits=12).collect())
    assert len(out) == len(want)
    for (i, held, score, predicted), (j, h, s) in zip(out, want):
        assert (i, held) == (j, h) and score == pytest.approx(s, abs=1e-5) and predicted == int(score >= 0.3)


def test_no_rows_and_no_labels(odd, spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    assert classifier.classify(odd.limit(0), labels).count() == 0
    assert {r["score"] for r in classifier.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('word', id) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as label")
    n = classifier.chosen(docs, labels, "doc_id", "text", "label", 1000).count()
    assert 700 < n <= 1000


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op13_quality_classifier(spark, folder).collect() if r["held_out"] and r["doc_id"] in marks]
    assert area([r["score"] for r in rows], [marks[r["doc_id"]] for r in rows]) > 0.95
    good = [r["predicted"] for r in rows if marks[r["doc_id"]]]
    assert sum(good) / len(good) > 0.98
