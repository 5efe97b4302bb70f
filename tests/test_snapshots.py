"""Snapshot tables: changes against a dictionary, killed writers, untouched files, replays, conflicts; the stored inverted index on top."""

import random

import pytest
from pyspark.sql import functions as F

from difforge.operators import postings, retrieval
from difforge.sources.snapshots import Conflict, SnapshotTable


def rows(table):
    return {tuple(r) for r in table.read().collect()}


def test_changes_equal_a_dictionary(spark, tmp_path):
    random.seed(4)
    t, held = SnapshotTable.create(spark, f"{tmp_path}/t", "k long, v string", ["k"], 8), {}
    assert rows(t) == set()
    for step in range(6):
        some = {k: f"{step}-{k}" for k in random.sample(range(60), 20)}
        t.put(spark.createDataFrame(list(some.items()), "k long, v string"))
        held |= some
        gone = random.sample(range(60), 5)
        t.delete(spark.createDataFrame([(k,) for k in [*gone, gone[0]]], "k long"))
        held = {k: v for k, v in held.items() if k not in gone}
        assert rows(t) == set(held.items())
        if step % 2:
            t.compact()
            assert rows(t) == set(held.items())
    t.delete_where(F.col("k") < 30)
    assert rows(t) == {(k, v) for k, v in held.items() if k >= 30}
    t.compact()
    assert t.vacuum() > 0 and rows(t) == {(k, v) for k, v in held.items() if k >= 30}


def test_a_killed_writer_changes_nothing(spark, tmp_path, monkeypatch):
    t = SnapshotTable.create(spark, f"{tmp_path}/t", "k long, v string", ["k"], 4)
    t.put(spark.createDataFrame([(i, "a") for i in range(20)], "k long, v string"))
    t.put(spark.createDataFrame([(i, "b") for i in range(5)], "k long, v string"))
    before = rows(t)

    def killed(self, snapshot):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_publish", killed)
        for change in (t.compact, lambda: t.put(spark.createDataFrame([(1, "z")], "k long, v string")), lambda: t.delete_where(F.lit(True))):
            with pytest.raises(KeyboardInterrupt):
                change()
    assert rows(SnapshotTable(spark, f"{tmp_path}/t")) == before
    t.vacuum()
    assert rows(t) == before


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    t = SnapshotTable.create(spark, f"{tmp_path}/t", "k long, v string", ["k"], 16)
    t.put(spark.createDataFrame([(i, "a") for i in range(200)], "k long, v string"))
    assert t.compact() == list(range(16))
    base = t.snapshot()["base"]
    t.put(spark.createDataFrame([(7, "b")], "k long, v string"))
    (bucket,) = t.buckets_of(spark.createDataFrame([(7,)], "k long"))
    assert t.compact() == [bucket]
    now = t.snapshot()["base"]
    assert {b for b in base if base[b] != now[b]} == {str(bucket)}
    files = t.read({bucket}).inputFiles()
    assert files and all(f"bucket={bucket}/" in f for f in files)
    assert (7, "b") in rows(t) and len(rows(t)) == 200


def test_replays_and_conflicts(spark, tmp_path):
    t = SnapshotTable.create(spark, f"{tmp_path}/t", "k long, v string", ["k"], 4)
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    assert t.put(one, ("s", 0)) and not t.put(one.withColumn("v", F.lit("b")), ("s", 0)) and t.put(one, ("other", 0))
    assert rows(t) == {(1, "a")}
    old = t.snapshot()
    t.put(one)
    with pytest.raises(Conflict):
        t._publish(old | {"n": old["n"] + 1})
    assert rows(t) == {(1, "a")}


def test_stored_index(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "run", "the"]
    random.seed(1)
    data = [("r1" if i % 3 else "r2", f"c{i}", f"f{i % 9}", i, " ".join(random.sample(words, 3)) + " The the") for i in range(90)]
    cols = "repo_id string, chunk_id string, file_path string, start_line int, content string"
    index = postings.Index(spark, f"{tmp_path}/i", 8)
    index.add(spark.createDataFrame(data, cols))
    # Two files anew, one gone.
    anew = [(*r[:4], "alpha only") for r in data if r[2] in ("f1", "f2")]
    index.add(spark.createDataFrame(anew, cols))
    index.remove(spark.createDataFrame([("r1", "f3"), ("r2", "f3")], "repo_id string, file_path string"))
    now = [r for r in data if r[2] not in ("f1", "f2", "f3")] + anew
    names = spark.createDataFrame([(f"q{i}", repo, name, ["f4"]) for i, (repo, name) in enumerate([("r1", "alpha beta"), ("r2", "the run Gamma"), ("r1", "only"), ("r1", "missing the"), ("r2", "--")])], "query_id string, repo_id string, name string, exclude array<string>")
    want = set()
    for q in names.collect():
        tokens = set(__import__("re").findall(r"\w+", q.name.lower()))
        hits = sorted((r[2], r[3], r[1]) for r in now if r[0] == q.repo_id and tokens and tokens <= set(r[4].lower().split()) and r[2] != "f4")
        want |= {(q.query_id, c, i + 1) for i, (_, _, c) in enumerate(hits[:10])}
    for _ in range(2):
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in index.callers(names).collect()} == want
        direct = retrieval.callers(names, spark.createDataFrame(now, cols), 10, r"\w+")
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in direct.collect()} == want
        index.entries.compact()
    some = index.of(spark.createDataFrame([("only",)], "token string"))
    assert len({f.split("bucket=")[1].split("/")[0] for f in some.inputFiles()}) == 1
