import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from salesledger.llm import mixing, queries
from tests.llm import brute
from tests.llm.data import FOLDER


def check(rows, out):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    targets = brute.mixed_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == float(targets[r["source"]])
        taken[r["source"]] += r["taken"]
    assert taken == {s: int(t) for s, t in targets.items()}
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["size"]) for r in out), key=key) == sorted(((d, len(brute.words(t))) for d, t, _ in rows), key=key)


def test_query(spark, rows, docs):
    out = mixing.mix_documents(docs)
    first = out.collect()
    check([(d, t, s) for d, t, _, s in rows], first)
    again = queries.op9_mixing(spark, FOLDER).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, first)) == sorted(map(key, again))


def test_odd_rows(odd):
    check([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], mixing.mix_documents(odd).collect())
    assert mixing.mix_documents(odd.limit(0)).count() == 0


def test_order_of_rows_does_not_matter(spark, docs):
    key = lambda f: sorted((r["doc_id"], r["taken"]) for r in f.collect())
    assert key(mixing.mix_documents(docs)) == key(mixing.mix_documents(docs.repartition(13, F.rand(1))))


def test_overlapping_sources(spark):
    """Shared documents are used before anything repeats."""
    rows = [(i, ["a"] if i < 20 else ["a", "b"] if i < 60 else ["b", None], 10) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, members array<string>, size long")
    sizes = mixing.pattern_sizes(frame, "members", "size")
    assert [n for _, n in sizes] == [200, 400, 400]
    out = mixing.mix_to_targets(frame, {"a": 500, "b": 300, None: 200}, sizes, "members", "size").collect()
    assert sum(r["taken"] for r in out) == 1000 and all(r["taken"] == 10 for r in out)
    out = mixing.mix_to_targets(frame, {"a": 900, "b": 300, None: 0}, sizes, "members", "size").collect()
    assert sum(r["taken"] for r in out) == 1200 and max(r["taken"] for r in out) == 20


def brute_cost(patterns, quotas, repeats):
    """Most words routed, and the least cost, by trying all splits of tiny patterns."""
    best = (0, 0)

    def go(k, left, moved, cost):
        nonlocal best
        if k == len(patterns):
            best = max(best, (moved, -cost))
            return
        size, members = patterns[k]

        def split(ms, gone, room):
            if not ms:
                c = sum(max(0, min(size, gone - u * size)) * u for u in range(repeats))
                go(k + 1, room, moved + gone, cost + c)
                return
            for x in range(min(room[ms[0]], size * repeats - gone) + 1):
                split(ms[1:], gone + x, [v - x * (i == ms[0]) for i, v in enumerate(room)])

        split(members, 0, left)

    go(0, quotas, 0, 0)
    return best


@pytest.mark.parametrize("seed", range(25))
def test_flow_is_cheapest(seed):
    r = random.Random(seed)
    quotas = [r.randint(0, 4) for _ in range(r.randint(1, 3))]
    patterns = [(r.randint(0, 3), sorted(r.sample(range(len(quotas)), r.randint(1, len(quotas))))) for _ in range(r.randint(1, 3))]
    flows = mixing.min_cost_flow(patterns, quotas, 2)
    moved = sum(sum(f.values()) for f in flows)
    cost = sum(max(0, sum(f.values()) - size) for (size, _), f in zip(patterns, flows))
    assert (moved, -cost) == brute_cost(patterns, quotas, 2)
    for s, q in enumerate(quotas):
        assert sum(f.get(s, 0) for f in flows) <= q


def test_too_many_patterns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 2)
    rows = [(i, "a b", str(i)) for i in range(3)]
    with pytest.raises(ValueError):
        mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_water_fill():
    got = mixing.water_fill({"a": 10, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2}, Fraction(315))
    assert got == {"a": 20, "b": Fraction(295, 3), "c": Fraction(590, 3)}


def test_any_number_of_sources(spark, rows, docs, odd, monkeypatch):
    key = lambda f: sorted(str(tuple(r)) for r in f.collect())
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    many = [(i, "w " * (i * i % 23), str(i % 300) if i % 7 else None) for i in range(1500)]
    frame = spark.createDataFrame(many, "doc_id long, text string, source string")
    whole = [key(mixing.mix_documents(x).select(columns)) for x in (docs, frame)]
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 2)
    assert [key(mixing.mix_sources(x).select(columns)) for x in (docs, frame)] == whole
    check(many, [r for r in mixing.mix_sources(frame.select("doc_id", "text", "source")).collect()])
    check([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], mixing.mix_sources(odd).collect())
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def routes(frame, targets):
    spark = frame.sparkSession
    wanted = spark.createDataFrame(list(targets.items()), "s string, quota long")
    out = mixing.mix_overlapping(frame, wanted, "members", "size")
    assert out.columns == [c for c in frame.columns if c != "taken"] + ["taken"]
    return {r["doc_id"]: r["taken"] for r in out.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_networks_in_tasks(spark, seed, monkeypatch):
    """Components are solved apart, and give as many words at the same cost as one network of all."""
    r = random.Random(seed)
    names = [*"abcdefgh", None]
    rows = [(i, r.sample(names[:3] if i % 2 else names[3:], r.choice([1, 1, 2, 3])), r.randint(0, 9), "clash") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, members array<string>, size long, taken string")
    targets = {s: r.randint(0, 400) for s in names}
    taken = routes(frame, targets)
    by = {}
    for i, m, n, _ in rows:
        by.setdefault(frozenset(m), []).append((i, n))
    patterns = [(sum(n for _, n in v), [names.index(s) for s in k]) for k, v in by.items()]
    whole = mixing.min_cost_flow(patterns, [targets[s] for s in names], 2)
    assert sum(taken.values()) == sum(sum(f.values()) for f in whole)
    repeated = lambda got, size: max(0, got - size)
    cost = sum(repeated(sum(taken[i] for i, _ in v), sum(n for _, n in v)) for v in by.values())
    assert cost == sum(repeated(sum(f.values()), n) for f, (n, _) in zip(whole, patterns))
    assert all(0 <= taken[i] <= 2 * n for i, _, n, _ in rows)
    assert taken == routes(frame.repartition(7, F.rand(1)), targets)
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 2)
    assert taken == routes(frame, targets)


def test_odd_memberships(spark):
    rows = [(1, None, 5), (2, [], 5), (3, ["z"], 5), (4, ["a", "a"], None), (None, ["a", None], 4), (None, [None, "a"], 4), (6, ["a"], 0)]
    frame = spark.createDataFrame(rows, "doc_id long, members array<string>, size long")
    out = mixing.mix_overlapping(frame, spark.createDataFrame([("a", 7), ("b", 3)], "s string, quota long"), "members", "size").collect()
    assert sorted(r["taken"] for r in out if r["doc_id"] is None) == [3, 4]
    assert all(r["taken"] == 0 for r in out if r["doc_id"] is not None) and len(out) == 7
    assert mixing.mix_overlapping(frame.limit(0), spark.createDataFrame([], "s string, quota long"), "members", "size").count() == 0


def test_query_routes_through_the_flow(spark, docs, monkeypatch):
    """Without its solver the query gives nothing: quotas come from the networks alone."""
    whole = mixing._routed
    monkeypatch.setattr(mixing, "_routed", lambda n, repeats: whole(n, repeats).withColumn("flow", F.transform("flow", lambda x: x * 0)))
    assert {r["taken"] for r in queries.op9_mixing(spark, FOLDER).collect()} == {0}


def test_equal_ids_are_placed_by_text(spark):
    rows = spark.createDataFrame([(None, "w " * (i % 90), "s") for i in range(2000)], "doc_id long, text string, source string")
    placed = mixing._placed(rows.withColumn(mixing.MARK, F.xxhash64("text")), "doc_id", 7)
    assert placed.select("_bin").distinct().count() > 80
