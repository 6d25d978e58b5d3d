import pytest

from salesledger.llm import quality, queries
from tests.llm import brute
from tests.llm.data import FOLDER


def test_query(spark, rows):
    out = {r["doc_id"]: r for r in queries.op3_quality(spark, FOLDER).collect()}
    assert len(out) == len(rows)
    for d, t, *_ in rows:
        counts, failed = brute.quality(t)
        assert [out[d][c] for c in quality.COUNTS] == counts
        assert out[d]["base_failed"] == failed and not (failed and out[d]["kept"])


def test_coverage_and_odd_rows(odd):
    out = quality.repetition_coverage(odd).collect()
    assert len(out) == odd.count()
    for r in out:
        counts, failed = brute.quality(r["text"])
        assert [r[c] for c in quality.COUNTS] == counts and r["base_failed"] == failed
        covered = {n: brute.coverage(r["text"], n) for n in quality.COVERAGE_LIMITS}
        assert {n: r[f"coverage_{n}"] for n in covered} == pytest.approx(covered)
        good = all(covered[n] <= most for n, most in quality.COVERAGE_LIMITS.items()) and r["line_coverage"] <= quality.LINE_LIMIT
        assert r["kept"] == (not failed and good)
    assert quality.repetition_coverage(odd.limit(0)).count() == 0
