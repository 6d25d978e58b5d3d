"""The registered queries of the text operators and, where SQL can express them, their DuckDB checks."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger.llm import centroids, classifier, decontam, langid, lexical, lm, markup, minhash, mixing, pii, quality, suffix, urls
from salesledger.llm.oracle import ORACLE_SQL  # noqa: F401

#: The rules of the URL query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Words that label a host as one to block; the trees see shapes, not words.
SEED_WORDS = ["adult", "bet", "casino", "cheap", "pills", "spam", "track", "win"]
NEAR = minhash.Plan(words=3, threshold=Fraction(17, 20))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, mask=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op2_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_documents(_table(spark, folder, "documents").select("doc_id", "text"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.repetition_coverage(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", "lang", "language", "text_language", "posterior", "kept")


def page_language(spark: SparkSession, folder: str) -> DataFrame:
    """op4's operator on pages, which have markup and hosts; fitted on documents, so that no label of a page is evidence."""
    model = langid.fit(_table(spark, folder, "documents").select("text", "lang"))
    pages = langid.identify_pages(_table(spark, folder, "pages").select("page_id", "url", "html"), model)
    return pages.select("page_id", "host", "declared", "language", "text_language", "posterior", "kept")


def seed_labels(pages: DataFrame) -> DataFrame:
    """(url, label): 1 where the host has one of the seed words between its marks, else 0."""
    host = F.concat(F.lit("-"), F.regexp_replace(urls.host_of(F.col("url")), r"[^a-z0-9]+", "-"), F.lit("-"))
    bad = F.lit(False)
    for w in SEED_WORDS:
        bad = bad | host.rlike(f"-{w}s?-")
    return pages.where(F.col("url").isNotNull()).select("url", bad.cast("int").alias("label"))


def op5_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES, seed_labels(pages)).select("page_id", "host", "path", "rule", "verdict")


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, NEAR).select("doc_id", "n_shingles", "component_id", "kept")


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))


def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return markup.extract_text(_table(spark, folder, "pages").select("page_id", "html"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return decontam.find_passages(docs, _table(spark, folder, "benchmark")).select("doc_id", "items", "edits", "contaminated")


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return lexical.search(docs, _table(spark, folder, "benchmark").select("item_id", "text"))


def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(_table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return classifier.classify(docs, _table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_personal_data, op2_language_model, op3_quality, op4_language, op5_urls,
        op6_near_duplicates, op7_suffix_dedup, op8_html_text, op9_mixing, op10_decontamination,
        op11_lexical_search, op12_clusters, op13_quality_classifier, page_language,
    )
}
