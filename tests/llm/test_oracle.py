"""The SQL checks on the test tables, and on texts made to be hard for them."""

import os
import random

import duckdb
import pytest
from oracle_check import compare, connect

from salesledger.llm import queries
from tests.llm.data import cases

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_matches_sql(spark, name):
    rows, problems = compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLE_SQL[name])
    assert not problems and rows > 0


def odd_tables(spark, folder):
    """Documents and items that are hard texts, and vectors of which some must be left out."""
    rows = [(i, r[1], "en", "s") for i, r in enumerate(cases())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    items = [(i, t) for i, t, *_ in rows if t is None or len(t) < 9000]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    r = random.Random(6)
    vectors = [[r.gauss(0, 0.2) for _ in range(64)] for _ in range(50)]
    vectors += [vectors[3], vectors[4], [0.0] * 64, None, [], vectors[0][:63], [float("nan"), *vectors[1][1:]], [float("inf"), *vectors[1][1:]], [None, *vectors[1][1:]]]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_odd_texts_match_sql(spark, tmp_path, name):
    odd_tables(spark, tmp_path)
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        connection.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    rows, problems = compare(queries.QUERIES[name](spark, str(tmp_path)), connection, queries.ORACLE_SQL[name])
    assert not problems and rows == {"op11_lexical_search": rows, "op12_clusters": 53}.get(name, len(cases())) > 0
