from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesledger.llm import graph, minhash, queries
from tests.llm import brute
from tests.llm.data import FOLDER, prose


def check(frame, plan, **how):
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    out = minhash.near_duplicates(frame, plan, **how).collect()
    expect = brute.near(rows, plan.words, plan.threshold)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    whole = sorted(((d, n, c if n else d) for (d, _), (n, c) in zip(rows, expect)), key=key)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=key) == whole
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_query(spark, rows):
    out = {r["doc_id"]: r for r in queries.op6_near_duplicates(spark, FOLDER).collect()}
    for (d, *_), (n, c) in zip(rows, brute.near([r[:2] for r in rows], 3, Fraction(17, 20))):
        assert (out[d]["n_shingles"], out[d]["component_id"], out[d]["kept"]) == (n, c if n else d, d == c or not n)


@pytest.mark.parametrize("plan", [queries.NEAR, minhash.Plan()])
def test_odd_rows(odd, plan):
    check(odd, plan)
    assert minhash.near_duplicates(odd.limit(0), plan).count() == 0


def test_chains_and_outsiders(spark):
    """A centre with many copies of copies: links that don't pass the centre of a bucket."""
    r = np.random.default_rng(3)
    base = prose(120, 9).split()
    texts, pool = [], [base]
    for i in range(150):
        w = list(pool[r.integers(len(pool))])
        for k in r.integers(0, len(w), r.integers(0, 4)):
            w[k] = f"new{i}x{k}"
        pool.append(w)
        texts.append((int(i), " ".join(w)))
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    check(frame, queries.NEAR)
    check(frame, minhash.Plan())


def test_pruning_keeps_what_reaches_the_threshold():
    plan = queries.NEAR
    steps = plan.least_matches()
    assert [n for n, _ in steps] == [32, 64, 96, 128] and steps[-1][1] > 80
    r = np.random.default_rng(1)
    a = r.integers(0, 2**32, (4000, plan.hashes), dtype=np.uint32)
    b = np.where(r.random(a.shape) < 0.85, a, a + np.uint32(1))
    assert len(minhash.go_on(a, b, steps)) == 4000
    far = np.where(r.random(a.shape) < 0.5, a, a + np.uint32(1))
    assert len(minhash.go_on(a, far, steps)) < 20


def test_components(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 502), (502, 501), (900, 900)]
    out = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(1, 201)} | {501: 500, 502: 500}


def test_one_of_each(odd):
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    sets = [frozenset(brute.shingle_set(t, 5)) for _, t in rows]
    full = [s for s in sets if s]
    assert len(full) == len(set(full))


def test_one_of_each_without_ids_of_their_own(spark):
    """Near copies under null ids, under one id, and repeated rows: one row of each class stays, with the smallest id there is."""
    base, other = prose(200, 11), prose(200, 12)
    near = [" ".join([*base.split()[:k], f"new{k}", *base.split()[k + 1 :]]) for k in (20, 90, 150)]
    rows = [(None, near[0]), (None, near[1]), (None, near[2]), (7, other), (7, other + " tail"), (7, other), (3, base), (9, ""), (9, ""), (None, None), (8, other)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in minhash.one_of_each(frame).collect()), key=str)
    full = [r for r in kept if r[1]]
    assert [d for d, _ in full] == [3, 7] and sorted(str(r) for r in kept if not r[1]) == ["(9, '')", "(None, None)"]
    untitled = frame.where("doc_id is null")
    assert minhash.one_of_each(untitled).where("text is not null").count() == 1


def page(i, own=40):
    """A page of a template that makes most of it, with words of its own."""
    words = [f"own{i}x{k}" for k in range(own)]
    return " ".join([*prose(220, 21).split(), *words])


def test_pages_of_a_template(spark):
    """Pages that share a bucket and don't link: links among them are found, and no two pages meet for the template alone."""
    texts = [(i, page(i)) for i in range(0, 300)] + [(1000 + i, page(i) + " tail") for i in range(0, 300, 5)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    plan = minhash.Plan(threshold=Fraction(9, 10))
    check(frame, plan)
    rows = minhash.sketches(frame, plan)
    texts = rows.join(frame, "doc_id").selectExpr("_digest", "text as _text")
    involved = rows.selectExpr("_digest as node", "_digest as label", "true as outsider")
    rare = minhash._rare_tokens(minhash._token_sets(involved, texts, plan), plan)
    met = rare.groupBy("token").agg(F.count("*").alias("n"), F.max("short").alias("short")).where("short")
    assert met.count() > 0 and met.agg({"n": "max"}).first()[0] == 2


def test_prefixes_lose_no_pair(spark):
    """Sets over few tokens: each pair that reaches the threshold shares a rare token."""
    r = np.random.default_rng(4)
    sets = [sorted(set(r.integers(0, 60, r.integers(5, 50)).tolist())) for _ in range(120)]
    sets += [sorted({*s[:-1], int(r.integers(60))}) for s in sets]
    frame = spark.createDataFrame([(bytes([i]), bytes([i]), True, s) for i, s in enumerate(sets)], "node binary, label binary, outsider boolean, tokens array<bigint>")
    for t in (Fraction(4, 5), Fraction(17, 20)):
        held, short = {}, {}
        for row in minhash._rare_tokens(frame, minhash.Plan(threshold=t)).collect():
            held.setdefault(row["node"][0], set()).add(row["token"])
            if row["short"]:
                short.setdefault(row["node"][0], set()).add(row["token"])
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len({*sets[i]} & {*sets[j]}) >= t * len({*sets[i]} | {*sets[j]})]
        pairs = [(i, j) if len(sets[i]) <= len(sets[j]) else (j, i) for i, j in pairs]
        assert len(pairs) > 50 and all(short[i] & held[j] for i, j in pairs)
