import random
import re
from collections import Counter
from math import floor, log

import numpy as np

from salesledger.llm import lexical, queries
from tests.llm.data import FOLDER, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    """(item, rank, document, score) by scoring every document for every item."""
    held = [(d, parsed(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    weight = {w: floor(1000 * log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item, text in items:
        asked, found = Counter(parsed(text)), []
        for d, t in held:
            tf = Counter(t)
            m = 100 - 25 + (25 * len(t) * n_docs) // n_terms if t else 0
            score = sum(n * weight[w] * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m)) for w, n in asked.items() if tf[w])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query(spark, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(queries.op11_lexical_search(spark, FOLDER)) == brute([r[:2] for r in rows], items)


def test_odd_rows_ties_and_repeats(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    asked = [(1, "one two ONE"), (1, "one two ONE"), (None, prose(30, 1)), (3, None), (4, "  ,;"), (5, "É é ab x" + "x" * 4999), (6, "İstanbul nul 1.2.3")]
    items = spark.createDataFrame([(i, t, "clash", 7) for i, t in asked], "item_id long, text string, rank string, score int")
    assert found(lexical.search(odd, items)) == brute(docs, asked)
    assert found(lexical.search(odd, items, k=2)) == brute(docs, asked, 2)
    assert found(lexical.search(odd.limit(0), items)) == found(lexical.search(odd, items.limit(0))) == []


def test_blocks_and_buckets(spark, monkeypatch):
    """Many small buckets, few vectors searched first, and many blocks of queries: results stay whole, with thousands of ties."""
    monkeypatch.setattr(lexical, "BUCKET", 300)
    monkeypatch.setattr(lexical, "FIRST", 5)
    r = random.Random(4)
    words = prose(400, 8).split()
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 40, 300])))) for i in range(400)]
    docs += [(1000 + i, "the same old words " + words[3]) for i in range(2500)]
    items = [(i, " ".join(r.choice(words) for _ in range(25))) for i in range(12)] + [(50, "same same " + words[3])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(lexical.search(frame, asked, block_chars=300)) == brute(docs, items)


def test_bounds_prune_and_lose_nothing():
    """Documents that a bound drops score below the bound's aim; a strict aim drops most."""
    r = np.random.default_rng(5)
    n, size = 2000, 300
    dense = np.where(r.random((n, size)) < 0.1, r.integers(1, 1000, (n, size)), 0).astype(float)
    t = np.argsort(r.random(size))[:20]
    q = np.sort(r.random(20) * 100)[::-1] + 1
    doc, term = np.nonzero(dense)
    order = np.argsort(term, kind="stable")
    start = np.searchsorted(term[order], np.arange(size + 1))
    exact = dense[:, t] @ q
    for least in (np.sort(exact)[-20], exact.max(), 1.0):
        live = lexical.survivors((t, q, None), start, doc[order], dense[doc, term][order], (dense**2).sum(axis=1), least)
        assert set(np.flatnonzero(exact >= least)) <= set(live.tolist())
    top = lexical.survivors((t, q, None), start, doc[order], dense[doc, term][order], (dense**2).sum(axis=1), np.sort(exact)[-20])
    assert len(top) < n / 10
