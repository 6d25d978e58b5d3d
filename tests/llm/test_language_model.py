import math

import numpy as np
import pytest

from salesledger.llm import lm, queries
from tests.llm import brute
from tests.llm.data import FOLDER


def compare(out, docs):
    expect, rows, one, two = brute.base_scores(docs)
    key = lambda x: tuple((v is None, v or 0) for v in x[:3])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out), key=key)
    want = sorted(((d, *e) for (d, _), e in zip(docs, expect)), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    return rows, one, two


def test_query(spark, rows):
    out = queries.op2_language_model(spark, FOLDER).collect()
    compare(out, [r[:2] for r in rows])
    assert sum(r["score"] - r["base_score"] for r in out if r["held_out"]) > 0


def test_score_is_the_mixture(spark, rows):
    """The model's numbers from plain counts and the learned weights; small blocks change nothing."""
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    docs = [r[:2] for r in rows]
    _, parsed, one, two = brute.base_scores(docs)
    n, v = sum(one.values()), len(one)
    counts = lm.count_tokens(frame).cache()
    weights = lm.learn_weights(lm._cells(counts, n), v)
    assert weights.sum(axis=1) == pytest.approx(1) and weights[0, 0] == 0 and (weights > 0)[1:].all()
    assert abs(weights[2] - weights[9]).max() > 0.01

    def score(tokens):
        total = 0.0
        for u, w in zip([None, *tokens], tokens):
            a, b, c = weights[int(math.frexp(one[u])[1])]
            total += math.log10(a * two[u, w] / max(one[u], 1) + b * one[w] / n + c / (v + 1))
        return total

    expect = {d: score(t) for (d, _), (_, t) in zip(docs, parsed)}
    for size in (12 << 20, 20_000):
        got = {r["doc_id"]: r["score"] for r in lm.score_documents(frame, size).collect()}
        assert got == pytest.approx(expect)


def test_weights_favour_what_predicts():
    cells = [(5, 0, 40, 1000), (5, -1, 40, 10), (2, -1, 20, 500)]
    w = lm.learn_weights(cells, 100)
    assert w[5, 0] > 0.9 and w[2, 1] > 0.9


def test_odd_rows(odd):
    out = lm.score_documents(odd).collect()
    compare(out, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in out)
    assert lm.score_documents(odd.limit(0)).count() == 0


def test_parts_cover_all_keys():
    import numpy as np

    from salesledger.llm import blocks

    keys = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    keys = np.concatenate([keys, keys[:700]])
    unique, place, bounds = blocks.deal(keys, 7)
    assert (unique[place] == keys).all() and len(unique) == 5000 and bounds[0] == 0 and bounds[-1] == 5000 and (np.diff(bounds) > 500).all()
    assert (blocks.unpacked(blocks.packed(unique, 5), 5) == unique & np.uint64((1 << 40) - 1)).all()
    assert [s.tolist() for s in blocks.summed([unique[:3], unique[1:2]], [np.array([1, 2, 3]), np.array([5])])] == [[1, 7, 3], [7]]


def test_counts_beyond_32_bits(odd, monkeypatch):
    """Counts that do not fit travel and are stored whole; here everything above 2 counts as such."""

    def scores(**how):
        rows = lm.score_documents(odd, **how).collect()
        return sorted(((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows))

    plain = scores()
    monkeypatch.setattr(lm, "MOST", 2)
    monkeypatch.setattr(lm, "WIDE", 3)
    for how in ({}, {"block_bytes": 4000}):
        for found, expected in zip(scores(**how), plain, strict=True):
            assert found[:3] == expected[:3] and found[3:] == pytest.approx(expected[3:])
    counts, over = lm.narrowed(np.array([1, 3_000_000_000, 5, 1 << 40, 3_000_000_000, 2]), np.array([0, 3, 3, 6]))
    assert counts.tolist() == [1, -2, -1, -2, -1, 2] and over == [[5, 3_000_000_000], None, [3_000_000_000, 1 << 40]]
