"""The llm queries on the small test tables, against SQL where there is some, and the pipeline."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["op1_chat_format", "op6_positional_index", "op7_url_filter", "op8_jaccard_join"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    expected = _rows([d[0] for d in want.description], want.fetchall())
    got = __spark_entry__.queries()[name](spark, SF)
    assert _rows(got.columns, got.collect()) == expected


def test_ten_operators_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
        assert docs.count() <= before
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == first
    assert docs.count() > 0 and docs.filter("n_tokens > 0 AND ids IS NULL").count() == 0
