"""Language identification by Bayesian evidence fusion.

Four sources of evidence are added up as log probabilities for each language:
  text      likelihood of the byte trigrams of the whole text, tempered because trigrams overlap;
  markup    the declared language (the lang attribute of an html tag in the text, else the column), through a confusion table; the tag is
            read whole, up to its end or the next "<";
  suffix    the last label of the host, or of the source that stands for it;
  host      a prior of the host, smoothed towards its suffix, which is smoothed towards the whole corpus.
Every label is a language. The trigram table of each is fitted on a sample of its own: at most SAMPLE different texts, the ones with the
smallest hashes, whole if they have at most SAMPLE_CHARS characters together, else an equal share of that from the start of each. Tables
take 128 KB a language in every task; likelihoods are worked out for so many texts at a time that CELLS numbers hold them. Confusions and
priors come from a grouped aggregation over all documents (of what their text alone says), so they grow with the data and not
with a task. Priors are sent to all tasks while there are at most MAX_HOSTS hosts, else joined by a shuffle.

Defined cases: a null or empty text, or one without a letter, has no text evidence and is rejected (language null); null declared
languages and hosts add no evidence and stand for themselves in the statistics; unknown declared languages count as none; repeated rows are judged each;
an empty table gives an empty table. Input columns that share a name with a result column are replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesledger.llm import textops as ops
from salesledger.llm.markup import extract_text
from salesledger.llm.storage import checkpointed, small_hashes, written
from salesledger.llm.urls import host_of

#: Sampled texts and characters of one language, at most.
SAMPLE = 4000
SAMPLE_CHARS = 40_000_000
#: Likelihoods (texts times languages) that a task holds at once, about.
CELLS = 1 << 21
MAX_HOSTS = 50_000
SLOTS = 1 << 15
TEMPER = 0.2
#: Weight, in documents, of the prior that a host or suffix is smoothed towards.
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 50.0
#: Least posterior probability of the best language.
LEAST = 0.6
MARKUP = r"(?i)<html\b[^<>]*?(?<![\w-])lang\s*=\s*[\"']?([a-z]{2,3})\b"


def _slots(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table slot of each byte trigram that holds a letter, and the text of it; a text begins and ends with a blank."""
    text = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.full(len(data) + 2 * (len(offs) - 1), 32, np.uint8)
    low[np.arange(1, len(data) + 1) + 2 * text] = ops.LOWER[data]
    text = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs) + 2)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    x = np.where(letter, low, 32).astype(np.uint32)
    key = (x[:-2] * np.uint32(65599) + x[1:-1]) * np.uint32(65599) + x[2:]
    key ^= key >> np.uint32(15)
    slot = (key * np.uint32(2654435761)) >> np.uint32(32 - 15)
    ok = (text[:-2] == text[2:]) & (letter[:-2] | letter[1:-1] | letter[2:])
    return slot[ok].astype(np.int64), text[:-2][ok]


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # log probability of each slot, a column for each language

    def likelihood(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Log likelihood of every text (row) in every language; rows without a letter are NaN."""
        n = len(offs) - 1
        slot, text = _slots(data, offs)
        out = np.empty((n, len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(text, self.table[k][slot], n)[:n]
        out[np.bincount(text, minlength=n)[:n] == 0] = np.nan
        return out


def fit(labelled: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> TextModel:
    """Trigram tables from labelled texts. The labels of all rows settle which languages there are."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    sizes = known.select("l", "h").distinct().groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language
    languages = sorted(r["l"] for r in sizes)
    if not languages:
        return TextModel([], np.zeros((0, SLOTS), np.float32))
    spark = labelled.sparkSession
    limits = spark.createDataFrame([(r["l"], small_hashes(r["n"], sample)) for r in sizes], "_l string, _most long")
    few = known.join(F.broadcast(limits), F.col("l") == F.col("_l")).where(F.shiftrightunsigned("h", 1) <= F.col("_most"))
    few = checkpointed(few.groupBy("h", "l").agg(F.min("t").alias("t")))
    lengths = few.groupBy("l").agg(F.sum(F.length("t").cast("long")).alias("chars"), F.count(F.lit(1)).alias("n")).collect()
    over = [(r["l"], SAMPLE_CHARS // r["n"]) for r in lengths if r["chars"] > SAMPLE_CHARS]
    if over:
        shares = spark.createDataFrame(over, "_l string, _share int")
        few = few.join(F.broadcast(shares), F.col("l") == F.col("_l"), "left")
        few = few.withColumn("t", F.when(F.col("_share").isNull(), F.col("t")).otherwise(F.col("t").substr(F.lit(1), F.col("_share"))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sums.astype(np.uint32).tobytes()])], ["l", "n"])
        at, sums = None, np.zeros(SLOTS, np.int64)
        for whole in batches:
            data, offs = ops.flat(whole.column(1))
            for a, b in ops.pieces(offs):
                slot, row = _slots(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                first = 0
                for label, run in groupby(whole.column(0).slice(a, b - a).to_pylist()):
                    if label != at:
                        if at is not None:
                            yield done()
                        at, sums = label, np.zeros(SLOTS, np.int64)
                    last = first + sum(1 for _ in run)
                    i, j = np.searchsorted(row, (first, last))
                    sums += np.bincount(slot[i:j], minlength=SLOTS)
                    first = last
        if at is not None:
            yield done()

    counts = np.zeros((len(languages), SLOTS), np.uint32)
    place = {x: k for k, x in enumerate(languages)}
    by_language = few.select("l", "t").repartition("l").sortWithinPartitions("l")
    for r in by_language.mapInArrow(count, "l string, n binary").toLocalIterator():
        counts[place[r["l"]]] += np.frombuffer(r["n"], np.uint32)
    table = np.empty(counts.shape, np.float32)
    for k, n in enumerate(counts):
        table[k] = np.log((n + 0.5) / (n.sum() + 0.5 * SLOTS))
    return TextModel(languages, table)


def declared(page: Column) -> Column:
    """The language that an html tag declares, in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(page, MARKUP, 1)), F.lit(""))


def _evidence(docs: DataFrame, text: str, lang: str | None, host: str | None) -> DataFrame:
    """`docs` with _said (what is declared, in lower case), _host and _suffix."""
    markup = declared(F.col(text))
    said = F.coalesce(markup, F.lower(F.col(lang))) if lang else markup
    at = F.col(host) if host else F.lit(None).cast("string")
    rows = docs.withColumn("_said", said).withColumn("_host", at)
    return rows.withColumn("_suffix", F.when(F.instr("_host", ".") > 0, F.element_at(F.split("_host", r"\."), -1)))


def _judged(batches: Iterator[pa.RecordBatch], model: TextModel, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of batches with the likelihoods of their texts, and which texts have any."""
    most = max(1, CELLS // len(model.languages))
    for whole in batches:
        data, offs = ops.flat(whole.column(whole.schema.get_field_index(text)))
        for low, high in ops.pieces(offs):
            for a in range(low, high, most):
                b = min(high, a + most)
                ll = model.likelihood(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                yield whole.slice(a, b - a), np.nan_to_num(ll), ~np.isnan(ll[:, 0])


def identify(docs: DataFrame, model: TextModel, text: str = "text", lang: str | None = "lang", host: str | None = "source", least: float = LEAST) -> DataFrame:
    """`docs` with language (null if rejected), text_language (of the text alone), posterior and kept."""
    names = model.languages
    made = ["language", "text_language", "posterior", "kept"]
    plain = docs.select(*(c for c in docs.columns if c not in made))
    if not names:
        empty = F.lit(None).cast("string")
        return plain.select("*", empty.alias("language"), empty.alias("text_language"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("kept"))

    place = {x: k for k, x in enumerate(names)}
    rows = _evidence(plain, text, lang, host)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ll, some in _judged(batches, model, text):
            said = pa.array([place.get(x) for x in batch.column(3).to_pylist()], pa.int32())
            best = pa.array(ll.argmax(axis=1).astype(np.int32), mask=~some)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), said, best], ["_host", "_suffix", "_said", "_best"])

    voters = rows.select(text, "_host", "_suffix", "_said").mapInArrow(vote, "_host string, _suffix string, _said int, _best int").where("_best is not null")
    # one row for each host, suffix and pair of languages: what the text says against what is declared
    votes = checkpointed(voters.groupBy("_host", "_suffix", "_said", "_best").agg(F.count(F.lit(1)).alias("n")))
    total, declared = np.zeros(len(names)), np.zeros(len(names))
    confusion: dict[int, list[tuple[int, int]]] = {}
    for r in votes.groupBy("_said", "_best").agg(F.sum("n").alias("n")).collect():  # at most (languages + 1) * languages rows
        total[r["_best"]] += r["n"]
        if r["_said"] is not None:
            declared[r["_best"]] += r["n"]
            confusion.setdefault(r["_said"], []).append((r["_best"], r["n"]))
    overall = (total + 1) / (total.sum() + len(names))

    def grouped(key: list[str], name: str) -> DataFrame:
        """Votes for languages as a list of (_best, n), without the languages that have none."""
        counts = votes.where(F.col(key[0]).isNotNull()).groupBy(*key, "_best").agg(F.sum("n").alias("n"))
        return counts.groupBy(*key).agg(F.collect_list(F.struct("_best", "n")).alias(name))

    hosts, suffixes = grouped(["_host", "_suffix"], "_of_host"), grouped(["_suffix"], "_of_suffix")
    suffixes = suffixes.select(F.col("_suffix").alias("_sfx"), "_of_suffix")
    priors = hosts.join(suffixes, F.col("_suffix") == F.col("_sfx"), "left").select(F.col("_host").alias("_h"), "_of_host", "_of_suffix")
    few = len(hosts.select("_host").take(MAX_HOSTS + 1)) <= MAX_HOSTS
    rows = rows.join(F.broadcast(priors) if few else priors, F.col("_host") == F.col("_h"), "left")
    rows = rows.select(*plain.columns, "_said", "_host", "_of_host", "_of_suffix")
    kinds = [T.StringType(), T.StringType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*plain.schema.fields, *(T.StructField(c, k) for c, k in zip(made, kinds))])
    width, out_names = len(plain.columns), schema.names

    def said_log(d: int | None) -> np.ndarray | float:
        """log P(declared d | language), for all languages."""
        if d is None:
            return 0.0
        n = np.ones(len(names))
        for k, v in confusion.get(d, ()):
            n[k] += v
        return np.log(n / (declared + len(names)))

    def smoothed(found: list[dict] | None, towards: np.ndarray, weight: float) -> np.ndarray:
        p = weight * towards
        for x in found or ():
            p[x["_best"]] += x["n"]
        return p / p.sum() if found else towards

    def prior(batch: pa.RecordBatch, k: int) -> np.ndarray:
        of_host, of_suffix = (batch.column(width + c)[k].as_py() for c in (2, 3))
        return np.log(smoothed(of_host, smoothed(of_suffix, overall, SUFFIX_WEIGHT), HOST_WEIGHT) if of_host else overall)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ll, some in _judged(batches, model, text):
            score = TEMPER * ll
            for c, made_of in ((width, lambda k: said_log(place.get(batch.column(width)[k].as_py()))), (width + 1, lambda k: prior(batch, k))):
                code = pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                _, first, code = np.unique(code, return_index=True, return_inverse=True)
                order = np.argsort(code, kind="stable")
                for k, part in zip(first.tolist(), np.split(order, np.cumsum(np.bincount(code))[:-1])):
                    score[part] += made_of(k)
            best = score.argmax(axis=1)
            posterior = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
            kept = some & (posterior >= least)
            named = lambda which, ok: pa.array([names[k] if yes else None for k, yes in zip(which.tolist(), ok.tolist())], pa.string())
            cols = [named(best, kept), named(ll.argmax(axis=1), some), pa.array(posterior, mask=~some), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *cols], out_names)

    return rows.mapInArrow(judge, schema)


def identify_pages(pages: DataFrame, model: TextModel, url: str = "url", html: str = "html", least: float = LEAST) -> DataFrame:
    """`pages` without the markup, with title, text, declared, host and what identify adds, by all four kinds of evidence.

    The text is what the page shows, declared the language of its html tag and host that of its address, without a port (empty if there is
    none, then null). No label of the pages is needed: the model comes from other rows. A null page has no text and is rejected.
    """
    made = ["title", "text", "declared", "host", "language", "text_language", "posterior", "kept"]
    keep = [c for c in pages.columns if c not in {*made, html}]
    host = F.nullif(F.regexp_replace(host_of(F.col(url)), r":[0-9]*$", ""), F.lit(""))
    rows = extract_text(pages.select(*keep, declared(F.col(html)).alias("declared"), host.alias("host"), html), html)
    return identify(written(rows, "shown"), model, lang="declared", host="host", least=least)  # rendered once, read twice
