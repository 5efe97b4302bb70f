"""Nulls in every column, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from difforge.llm import ann, exact_dedup, fixity, language, mixing, ngram_join, packing, pipeline, quality, sharding, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, cls string, token string, block long, rate double, _id long, _sha string, _copies string, _Kept long, _copy int"
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(20000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the  quick brown\nfox jumps over the lazy DOG", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, "  \t\n ", None, "b"),
    (6, LONG, "de", "a"),
    (7, LONG, "de", None),
    (8, "x " + PASSAGE + " y", "fr", "c"),
    (9, "other words come first here and more of them so that it stays apart " + PASSAGE + " and others end it", None, "c"),
    (10, "one two", "en", "d"),
    (10, "one two", "en", "d"),
    (11, "12 34 ---", "en", ""),
    (12, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (None, "no id at all", "fr", "e"),
    (13, "é è ü ß ñ", "fr", "e"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 7, "clash", "clash", "clash", 3, 0.5, 1, "clash", "clash", 5, 6) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_exact_dedup(spark, docs, none):
    got = rows(exact_dedup.exact_groups(docs))
    assert len(got) == len(TEXTS)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept == {1, 2, 3, 5, 6, 8, 9, 10, 11, None, 13}
    assert sum(r["kept"] for r in got if r["doc_id"] == 10) == 1
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[7]["keep_id"] == 6 and by_id[4]["keep_id"] == 3 and by_id[12]["group_size"] == 2
    assert by_id[3]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by_id[5]["text_sha256"] == hashlib.sha256(b" ").hexdigest()
    stay = exact_dedup.keep_first(docs)
    assert stay.columns == docs.columns and stay.count() == len(kept)
    assert rows(exact_dedup.exact_groups(none)) == [] and rows(exact_dedup.keep_first(none)) == []


def test_pipeline_stages(spark, docs, none, tmp_path):
    """Every stage on all cases at once, and on an empty table; columns that clash with helper names come through."""
    labels = [(1, 1, 0), (2, 1, 0), (6, 0, None), (8, None, 0), (8, 0, 0), (999, 1, 1), (None, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()}, name
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    assert pipeline.packing(spark, docs, str(tmp_path)).count() == len(TEXTS)
    assert pipeline.packing(spark, none, str(tmp_path)).count() == 0
    mixed = pipeline.mix(spark, docs, str(tmp_path)).groupBy("doc_id").count().collect()
    want = mixing.balance(docs).groupBy("doc_id").agg(F.sum("copies").alias("count")).where("count > 0").collect()
    assert {tuple(r) for r in mixed} == {tuple(r) for r in want}


def test_one_id_with_a_good_and_a_bad_text(spark, tmp_path):
    good, bad = (" ".join(random.Random(s).choices(w, k=40)) for s, w in ((1, ["tree", "river", "house", "walks"]), (2, ["zzq", "xkv", "qqj"])))
    rows = [(i, good) for i in range(20)] + [(100 + i, bad) for i in range(20)] + [(7, bad), (None, bad), (None, good)]
    spark.createDataFrame([(i, int(i < 50)) for i, _ in rows if i is not None and i != 7], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.quality(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert {r.text for r in got} == {good} and len(got) == 21


def test_written_shards_hold_each_row_once(spark, docs, tmp_path):
    sharding.write_shards(docs, sharding.assign_shards(docs, 3), f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    some = ["doc_id", "text", "lang", "source"]
    assert sorted(map(str, back.select(some).collect())) == sorted(map(str, docs.select(some).collect()))


def test_sharding(spark, docs, none):
    got = rows(sharding.assign_shards(docs, 3))
    assert len(got) == len(TEXTS)
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    sizes = {i: len((t or "").encode()) + 16 for i, t, *_ in TEXTS}
    assert all(r["size"] == sizes[r["doc_id"]] for r in got)
    crc = {i: zlib.crc32((t or "").encode()) for i, t, *_ in TEXTS}
    assert all(r["text_crc32"] == crc[r["doc_id"]] and r["grown_shard"] is None for r in got)
    assert rows(sharding.assign_shards(none, 3)) == []


def test_packing(spark, docs, none):
    got = rows(packing.pack(docs, buckets=4, token_budget=100))
    assert len(got) == len(TEXTS)
    assert all(r["n_tokens"] <= r["bucket_len"] for r in got)
    places = [(r["bucket"], r["batch"], r["row_in_batch"]) for r in got]
    assert len(set(places)) == len(places)
    for b in {r["bucket"] for r in got}:
        per = max(1, 100 // max(1, next(r["bucket_len"] for r in got if r["bucket"] == b)))
        mine = sorted(r["batch"] * per + r["row_in_batch"] for r in got if r["bucket"] == b)
        assert mine == list(range(len(mine)))
    assert rows(packing.pack(none)) == []


def test_ngram_join(spark, docs, none):
    got = {r["doc_id"]: r for r in rows(ngram_join.near_groups(docs))}
    assert len(got) == 14 and got[None]["n_shingles"] == 1 and got[None]["component_id"] is None
    assert got[2]["component_id"] == 1 and got[12]["component_id"] == 1 and got[7]["component_id"] == 6
    assert [got[i]["n_shingles"] for i in (3, 4, 5, 10, 1)] == [0, 0, 0, 1, 5]
    assert all(got[i]["component_id"] == i for i in (3, 4, 5, 8, 9, 10))
    stay = ngram_join.keep_one(docs)
    assert stay.columns == docs.columns and stay.count() == len(TEXTS) - 3
    assert rows(ngram_join.near_groups(none)) == []


def test_ann(spark):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [-1.0, 0.0]), (50, [float("inf"), 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("block", F.lit("x"))
    got = rows(ann.nearest(df, F.col("vec_id") % 50 == 0, k=5))
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, -1.0)]
    assert rows(ann.nearest(df.where("false"), F.col("vec_id") % 50 == 0)) == []
    # A repeated query row is two queries, each of which finds the other; other lengths have neighbours of their own.
    v = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (50, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 2.0])]
    got = rows(ann.nearest(spark.createDataFrame(v, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=3))
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted([(0, 1, 0), (0, 2, 1), (0, 3, 2)] * 2 + [(50, 1, 4)])


def test_substring(spark, docs, none):
    got = rows(substring.repeated_passages(docs))
    pair = [r for r in got if {r["doc_id"], r["partner_id"]} == {8, 9}]
    assert len(pair) == 1 and pair[0]["similarity"] == 1.0
    spans = {pair[0]["doc_id"]: (pair[0]["start_word"], pair[0]["end_word"]), pair[0]["partner_id"]: (pair[0]["partner_start"], pair[0]["partner_end"])}
    assert spans == {8: (1, 61), 9: (14, 74)}
    whole = [r for r in got if r["doc_id"] == 7]
    assert [(r["partner_id"], r["start_word"], r["end_word"]) for r in whole] == [(6, 0, 20000)]
    assert len(got) == 2
    assert rows(substring.repeated_passages(none)) == []


def test_mixing(spark, docs, none):
    got = rows(mixing.balance(docs))
    assert len(got) == len(TEXTS)
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-9 for r in got)
    assert rows(mixing.balance(none)) == []
    again = rows(mixing.balance(docs.repartition(5)))
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_language(spark, docs, none):
    got = rows(language.identify(docs))
    assert len(got) == len(TEXTS)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (3, 4, 5, 11))
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "fr", "und") for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert rows(language.identify(none)) == []


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, None), (8, None, 0), (8, 0, 0), (999, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = rows(quality.score_quality(docs, labels))
    assert len(got) == len(TEXTS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["score"] == 0.5 for r in rows(quality.score_quality(docs, labels.where("false"))))
    assert rows(quality.score_quality(none, labels)) == []


def test_fixity(spark):
    pages = [(1, "u", "body"), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "u", "x"), (1500, "v", "long " * 5000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("status", F.lit("clash"))
    same = rows(fixity.audit(fixity.records(df), fixity.records(df)))
    assert len(same) == 6 and {r["status"] for r in same} == {"ok"}
    right = df.where("page_id IS NULL OR page_id <> 2").withColumn("html", F.when(F.col("page_id") == 1500, "short").otherwise(F.col("html")))
    right = right.union(spark.createDataFrame([(7, "u", "new", "clash")], right.schema))
    got = {r["page_id"]: r["status"] for r in rows(fixity.audit(fixity.records(df), fixity.records(right)))}
    assert got == {1: "ok", 2: "missing", 3: "ok", None: "ok", 1500: "changed", 7: "extra"}
    assert rows(fixity.audit(fixity.records(df.where("false")), fixity.records(df.where("false")))) == []
