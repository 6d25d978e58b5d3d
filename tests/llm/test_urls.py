import numpy as np
import pytest

from salesledger.llm import queries, urls
from tests.llm.data import FOLDER

RULES = queries.URL_RULES


def plain(url):
    """Host, path and rule by the contract."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for _, r in RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    rule = max(fits, key=len, default=None)
    return host, path, rule, {r: v for v, r in RULES}.get(rule)


def test_query(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    out = queries.op5_urls(spark, FOLDER).collect()
    assert sorted(r["page_id"] for r in out) == sorted(pages)
    for r in out:
        host, path, rule, verdict = plain(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "http://net/x", "http://xnet/x", "http://example.net/en/1", "http://www.example.net/de/",
    "http://example.com/de", "http://example.com/de/x?u=http://a.net/", "x://É.ORG/fr/#a", "http://u:p@h.org/fr/?q", "a?b://c.net/", "http://casino-win.example.com/1", "http://a\n.net/x",
]


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    out = urls.filter_urls(pages, RULES, queries.seed_labels(pages)).collect()
    assert len(out) == len(URLS) * 2
    for r in out:
        host, path, rule, verdict = plain(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r["url"]
        assert verdict in (None, r["verdict"])
    empty = pages.limit(0)
    assert urls.filter_urls(empty, RULES, queries.seed_labels(empty)).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(pages.where("page_id = 15"), RULES, queries.seed_labels(empty)).collect()} == {"allow"}


def test_held_out_accuracy(spark):
    """Trees fitted on half of the hosts judge the other half."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    labelled = queries.seed_labels(pages)
    half = F.pmod(F.xxhash64(urls.host_of(F.col("url"))), F.lit(2)) == 0
    out = urls.filter_urls(labelled.where(half), [], labelled.where(~half)).agg(F.avg((F.col("verdict") == F.when(F.col("label") == 1, "block").otherwise("allow")).cast("int")))
    assert out.first()[0] > 0.95


def test_shuffled_rates_agree(spark, monkeypatch):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url")
    key = lambda: sorted(tuple(r) for r in urls.filter_urls(pages, RULES, queries.seed_labels(pages)).collect())
    small = key()
    monkeypatch.setattr(urls, "MAX_SUFFIXES", 1)
    assert key() == small


def test_trees_learn_a_step():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = urls.fit_trees(x, y)
    assert ((model.margin(x) > 0) == y).mean() > 0.97
    assert urls.fit_trees(x[:0], y[:0]).margin(x)[0] < 0
    assert urls.fit_trees(x, y * 0).margin(x) == pytest.approx(urls.fit_trees(x, y * 0).base)
