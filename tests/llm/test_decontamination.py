import os
import random
import subprocess
import sys
import time
from pathlib import Path

import pytest

from salesledger.llm import decontam, queries
from tests.llm import brute
from tests.llm.data import FOLDER, prose


def edit(text, n, r):
    out = list(text)
    for _ in range(n):
        k = r.randrange(len(out))
        kind = r.randrange(3)
        out[k : k + (kind != 1)] = [] if kind == 0 else [r.choice("qzjk")]
    return "".join(out)


def test_query(spark, rows):
    items = {r["item_id"]: decontam.normal(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    out = {r["doc_id"]: r for r in queries.op10_decontamination(spark, FOLDER).collect()}
    assert len(out) == len(rows)
    for d, t, *_ in rows:
        exact = {i for i, x in items.items() if x in decontam.normal(t)}
        assert exact == {i for i, e in zip(out[d]["items"], out[d]["edits"]) if e == 0}
        assert out[d]["contaminated"] == bool(out[d]["items"])


@pytest.mark.parametrize("q, rate", [(6, 0.05), (12, 0.06)])
def test_against_alignment(spark, q, rate):
    """Edited passages inside prose: just those within the edit budget are found, with the fewest edits."""
    r = random.Random(q)
    items = [(i, prose(30 + 3 * i, 100 + i)) for i in range(5)] + [(9, None), (10, ""), (11, "short")]
    texts = []
    for k in range(60):
        i = r.randrange(5)
        passage = edit(items[i][1], r.choice([0, 0, 1, 3, 6, 9, 14]), r)
        texts.append((k, prose(r.randint(0, 40), 200 + k).upper() + "\n " + passage + "  " + prose(r.randint(0, 40), 300 + k)))
    texts += [(100, None), (101, ""), (102, "short"), (103, prose(500, 7))]
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = {x["doc_id"]: x for x in decontam.find_passages(frame, bench, q=q, rate=rate).collect()}
    for d, t in texts:
        expect = {}
        for i, x in items[:5]:
            e = brute.edits_inside(x, decontam.normal(t))
            if e <= decontam.allowed(len(x), q, rate):
                expect[i] = e
        assert dict(zip(out[d]["items"], out[d]["edits"])) == expect
    blocks = decontam.find_passages(frame, bench, q=q, rate=rate, block_chars=150)
    assert {x["doc_id"]: sorted(x["items"]) for x in blocks.collect()} == {d: sorted(x["items"]) for d, x in out.items()}


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, prose(300, 1)), (1, prose(300, 1)), (None, prose(300, 3)), (4, None)], "item_id long, text string")
    out = decontam.find_passages(odd, bench).collect()
    assert len(out) == odd.count()
    for r in out:
        found = decontam.normal(r["text"]).replace("thon", "")
        assert r["contaminated"] == (decontam.normal(prose(300, 1)) in decontam.normal(r["text"]) or any(e > 0 for e in r["edits"])), found[:50]
    assert not any(r["contaminated"] for r in decontam.find_passages(odd, bench.limit(0)).collect())
    assert decontam.find_passages(odd.limit(0), bench).count() == 0


def test_repeated_characters(spark):
    """Rules of one character meet a passage on every diagonal; they are counted by runs, and judged like other texts."""
    dashes = [("-" * 500), "-" * 300 + "end" + "-" * 200, "ab" * 200]
    items = [(i, t) for i, t in enumerate(dashes)]
    texts = [(0, "-" * 200_000), (1, "-" * 499), (2, "x " + "-" * 450), (3, "-" * 310 + "end" + "-" * 210), (4, "ab" * 60_000), (5, "-" * 20 + prose(50, 1))]
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    began = time.monotonic()
    out = {r["doc_id"]: dict(zip(r["items"], r["edits"])) for r in decontam.find_passages(frame, bench).collect()}
    assert time.monotonic() - began < 60
    for d, t in texts:
        if len(t) > 1000:
            continue
        budget = {i: decontam.allowed(len(x), decontam.Q, decontam.EDIT_RATE) for i, x in items}
        expect = {i: e for i, x in items if (e := brute.edits_inside(x, decontam.normal(t))) <= budget[i]}
        assert out[d] == expect
    assert out[0] == {0: 0, 1: 3} and out[4] == {2: 0}


def test_banded_distance():
    r = random.Random(8)
    for _ in range(200):
        text = "".join(r.choice("ab") for _ in range(r.randint(0, 30)))
        pattern = "".join(r.choice("ab") for _ in range(r.randint(1, 12)))
        best = brute.edits_inside(pattern, text)
        found = decontam.distance(decontam.points(pattern), decontam.points(text), 30, len(pattern), len(pattern) + len(text) + 1)
        assert found == best
        assert decontam.distance(decontam.points(pattern), decontam.points(text), 0, 0, len(text) + 1) in ((0,) if best == 0 else (None,))


def test_blocks_run_one_after_another(spark, rows):
    frame = spark.createDataFrame([r[:2] for r in rows[:50]], "doc_id long, text string")
    bench = spark.createDataFrame([(i, prose(40, i)) for i in range(8)], "item_id long, text string")
    found = decontam.find_passages(frame, bench, block_chars=300)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_workers_without_the_package(tmp_path):
    """Driver code finds the package, workers do not: they start in another folder, without the path."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from salesledger.session import session
from salesledger.llm import queries
spark = session("alone", "local[2]", {{"spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path)!r}, "spark.sql.shuffle.partitions": "2"}})
print("ROWS", queries.op10_decontamination(spark, {FOLDER!r}).count(), queries.op11_lexical_search(spark, {FOLDER!r}).count(),
      queries.op12_clusters(spark, {FOLDER!r}).count(), queries.op13_quality_classifier(spark, {FOLDER!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 200 800 500 200" in said.stdout, said.stderr[-2000:]
