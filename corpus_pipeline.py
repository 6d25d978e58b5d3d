"""A training corpus from raw documents, in five stages; each is written as Parquet and read again as the next one's input.

language    documents whose language the evidence doesn't settle go
near_dups   one document of each near-duplicate class stays (five-word shingles, similarity of 0.8 or more)
benchmark   documents that hold a benchmark passage go
privacy     personal data is masked in the text
mixture     words taken of each document, so that sources meet their target weights

All return the columns of documents; the last adds size, source_size, target and taken. It marks every document, and run() lets those
go of which nothing is taken. taken counts words with repeats: twice the size is a document to be used twice, less than the
size the one document in which a source's quota ends (its text stays whole). Null or empty texts go in the first stage; repeated rows (id and text alike)
leave one row in the second; empty tables stay empty; columns beyond those of documents are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger.llm import decontam, langid, minhash, mixing, pii
from salesledger.llm.storage import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs.withColumn("_declared", F.col("lang")), langid.fit(docs), lang="_declared")
    return found.where("kept").select(*docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(docs)
    text = {"text": F.col("masked")} | ({"n_chars": F.length("masked").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.withColumns(text).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, texts=True)


STAGES = [("language", language), ("near_dups", near_dups), ("benchmark", benchmark), ("privacy", privacy), ("mixture", mixture)]

#: Trigram tables, signatures, banded alignment and a seeded choice are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs.where("taken > 0")
