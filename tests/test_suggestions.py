"""Whole documents are checked as suggestions."""

from pyspark.sql import functions as F

from difforge.functions import models
from difforge.plans import catalog

TEXTS = [(2, "x = 1\n" * 20 + "y = (2"), (3, "y = (2"), (4, "x = 1"), (5, "x = 1\n" * 20)]


def test_suggestion_checks_reads_whole_texts(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, content string")
    monkeypatch.setattr(catalog.P, "documents", lambda spark, sf: docs)
    got = {r.doc_id: r.is_valid for r in catalog.queries()["suggestion_checks"](spark, "").collect()}
    assert got == {2: False, 3: False, 4: True, 5: True}


def test_literal_suggestions(spark):
    docs = spark.createDataFrame([(0, "    x = 1\n    return x"), (1, "y = (2")], "doc_id long, suggestion_code string")
    rows = models.validate_suggestions(docs.withColumns({"language": F.lit("python"), "line_start": F.lit(1), "line_end": F.lit(2)})).collect()
    assert {r.doc_id: r.is_valid for r in rows}[1] is False
