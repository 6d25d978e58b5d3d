from fractions import Fraction

import corpus_pipeline
from salesledger.llm import decontam, pii
from tests.llm import brute
from tests.llm.data import FOLDER


def test_stages_take_effect(spark, rows):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    passages = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        kept = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, FOLDER)
        got = {r["doc_id"]: r for r in out.collect()}
        if name != "mixture":
            assert out.columns == columns
        if name == "language":
            assert len(got) >= 0.99 * before
        elif name == "near_dups":
            classes = brute.near(kept, 5, Fraction(4, 5))
            assert set(got) == {d for (d, _), (n, c) in zip(kept, classes) if not n or c == d}
        elif name == "benchmark":
            leaks = {d for d, t in kept if any(p in decontam.normal(t) for p in passages)}
            assert leaks and not leaks & set(got) and len(got) >= len(kept) - len(leaks) - 2
        elif name == "privacy":
            assert set(got) == {d for d, _ in kept}
            assert all(r["text"] == pii.masked(t, pii.spans(t)) for d, t in kept for r in [got[d]])
            assert not any(sum(brute.personal(r["text"])[0]) for r in got.values())
        else:
            assert set(got) == {d for d, _ in kept} and all(0 <= r["taken"] <= 2 * r["size"] for r in got.values())
        docs = out


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() and {"doc_id", "taken", "target"} <= set(out.columns)


def test_odd_rows(spark, odd, tmp_path):
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (odd, odd.limit(0)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != "mixture":
                assert docs.columns == odd.columns
        assert docs.count() <= frame.count()


def test_result_is_a_corpus(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    got, given = out.collect(), {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got and all(r["taken"] > 0 and r["text"] == pii.masked(t, pii.spans(t)) for r in got for t in [given[r["doc_id"]]])
    sources = {r["source"]: int(r["target"]) for r in got}
    assert {s: sum(r["taken"] for r in got if r["source"] == s) for s in sources} == sources


def test_mixture_keeps_texts(spark, odd):
    out = corpus_pipeline.mixture(spark, odd, FOLDER)
    assert set(odd.columns) <= set(out.columns)
    assert sorted(map(str, odd.select("doc_id", "text").collect())) == sorted(map(str, out.select("doc_id", "text").collect()))
