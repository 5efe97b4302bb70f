"""Groups that span Arrow batches give what they give in one batch."""

import pytest

from difforge.llm import exact_dedup, ngram_join, substring

SF = "/root/testdata/sf0.001"
OPERATORS = {"exact": exact_dedup.exact_groups, "near": ngram_join.near_groups, "passages": substring.repeated_passages}


@pytest.mark.parametrize("name", OPERATORS)
def test_small_batches(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.selectExpr("doc_id + 100000", "text", "lang", "source", "n_chars")).union(docs.selectExpr("doc_id + 200000", "concat(text, ' tail')", "lang", "source", "n_chars"))
    rows = lambda: sorted(map(str, OPERATORS[name](docs).collect()))
    want = rows()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "3")
    try:
        assert rows() == want
    finally:
        spark.conf.unset(key)
