"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Features: lengths, path depth, digit share, entropy, parameters, hyphens, labels, and the smoothed block rate of the
host's suffix, aggregated over every labelled URL. The trees are fitted on a sample of at most SAMPLE different labelled URLs,
the ones with the smallest hashes; everything else covers all rows.

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule and goes to the trees; the
longest rule wins, of equally long ones a blocking one; repeated rows are judged each; without labelled URLs of both
kinds the trees say allow. Input columns that share a name with a result column are replaced by the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesledger.llm.storage import sampled

#: Labelled URLs that the trees are fitted on, at most.
SAMPLE = 8000
#: Suffix rates are pulled towards the overall rate with the weight of this many URLs.
SMOOTHING = 50.0
#: Suffixes whose rates may be sent to every task; beyond it they are joined by a shuffle.
MAX_SUFFIXES = 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_len", "host_len", "path_len", "depth", "labels", "host_digits", "digits", "hyphens", "host_entropy", "url_entropy", "params", "suffix_rate"]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The text of the longest rule (verdict, host/path) that fits, or null."""
    found = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        h, p = rule.split("/", 1)
        found = F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), F.lit(rule)).otherwise(found)
    return found


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), return_counts=True)[1]
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def features(url: str | None, host: str, path: str, rate: float) -> list[float]:
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    return [
        len(url), len(host), len(path), sum(1 for p in path.split("/") if p), host.count(".") + bool(host),
        sum(c.isdigit() for c in host) / max(1, len(host)), sum(c.isdigit() for c in url) / max(1, len(url)),
        host.count("-"), _entropy(host), _entropy(url), len([p for p in re.split("[&;]", query) if p]), rate,
    ]


@dataclass
class Trees:
    """Boosted regression trees for the logistic loss. A node is (feature, cut, left, right); a leaf is its value."""

    base: float
    rate: float
    trees: list

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            stack = [(tree, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if isinstance(node, float):
                    out[rows] += self.rate * node
                elif len(rows):
                    left = x[rows, node[0]] <= node[1]
                    stack += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5, ridge: float = 1.0) -> Trees:
    """Greedy second-order splits over at most 64 cuts per feature."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 1e-3
    model = Trees(float(np.log(share / (1 - share))), rate, [])
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1], method="lower")) for c in x.T]
    places = [np.searchsorted(c, v) for c, v in zip(cuts, x.T)]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        leaf = float(-g[rows].sum() / (h[rows].sum() + ridge))
        if level == depth or len(rows) < 2 * least:
            return leaf
        best = (1e-6, 0, 0)
        gs, hs = g[rows].sum(), h[rows].sum()
        for f, c in enumerate(cuts):
            at = places[f][rows]
            gl = np.cumsum(np.bincount(at, g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(at, h[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(at, minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
        if best[0] <= 1e-6:
            return leaf
        _, f, k = best
        left = places[f][rows] <= k
        return (f, float(cuts[f][k]), grow(rows[left], g, h, level + 1), grow(rows[~left], g, h, level + 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-model.margin(x)))
        model.trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0))
        model.trees[-1] = float(model.trees[-1]) if not isinstance(model.trees[-1], tuple) else model.trees[-1]
    return model


def suffix_rates(labelled: DataFrame) -> tuple[DataFrame, float]:
    """Smoothed block rate of each suffix over all labelled URLs (url, label 0/1), and the overall rate."""
    by = labelled.select(suffix_of(host_of(F.col("url"))).alias("suffix"), F.col("label").cast("double").alias("y"))
    by = by.groupBy("suffix").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    total = by.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    overall = float(total["s"] or 0) / max(1, total["n"] or 0)
    rate = (F.col("s") + F.lit(SMOOTHING * overall)) / (F.col("n") + F.lit(SMOOTHING))
    return by.select(F.col("suffix").alias("_suffix"), rate.alias("_rate")), overall


def _rated(frame: DataFrame, rates: DataFrame, overall: float) -> DataFrame:
    small = len(rates.limit(MAX_SUFFIXES + 1).select("_suffix").take(MAX_SUFFIXES + 1)) <= MAX_SUFFIXES
    joined = frame.join(F.broadcast(rates) if small else rates, F.col("_suffix") == suffix_of(F.col("host")), "left")
    return joined.withColumn("_rate", F.coalesce("_rate", F.lit(overall))).drop("_suffix")


def fit(labelled: DataFrame, sample: int = SAMPLE, **how) -> tuple[Trees, DataFrame, float]:
    """Trees and suffix rates from labelled URLs."""
    rates, overall = suffix_rates(labelled)
    url = F.col("url")
    rows = labelled.select("url", F.col("label").cast("int").alias("label"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = sampled(rows.distinct().withColumn("h", F.xxhash64("url")), "h", sample)
    rows = sorted(_rated(rows, rates, overall).collect(), key=lambda r: (r["h"], r["label"]))
    x = np.array([features(r["url"], r["host"], r["path"], r["_rate"]) for r in rows]).reshape(len(rows), len(FEATURES))
    return fit_trees(x, np.array([r["label"] for r in rows], float), **how), rates, overall


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame, sample: int = SAMPLE, cut: float = 0.5) -> DataFrame:
    """`pages` with host, path, rule, block_score and verdict (the rule's, else the trees')."""
    trees, rates, overall = fit(labelled, sample)
    made = ["host", "path", "rule", "block_score", "verdict"]
    plain = pages.select(*(c for c in pages.columns if c not in made))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = _rated(plain.withColumn("host", host).withColumn("path", path), rates, overall)
    schema = T.StructType([*rows.schema.fields, T.StructField("block_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("url", "host", "path", "_rate")]
            x = np.array([features(*row) for row in zip(*cols)], float).reshape(b.num_rows, len(FEATURES))
            p = 1 / (1 + np.exp(-trees.margin(x)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], schema.names)

    scored = rows.mapInArrow(run, schema).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for verdict, rule in rules:
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    method = F.when(F.col("block_score") >= cut, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("verdict", F.coalesce(said, method)).select(*plain.columns, *made)
