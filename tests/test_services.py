"""Calls in flight, time limits, retries, rejects; incremental indexing that is killed and goes on."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from difforge.functions import models
from difforge.sources import sinks
from difforge.sources.snapshots import SnapshotTable
from difforge.streaming import index_stream, streams


class Slow:
    """Counts calls in flight; fails some items a number of times, hangs on others."""

    def __init__(self, fails=None, hangs=()):
        self.fails, self.hangs, self.lock = dict(fails or {}), hangs, threading.Lock()
        self.now = self.most = self.calls = 0

    def __call__(self, x):
        with self.lock:
            self.now, self.calls = self.now + 1, self.calls + 1
            self.most = max(self.most, self.now)
        time.sleep(3 if x in self.hangs else 0.05)
        with self.lock:
            self.now -= 1
            if self.fails.get(x, 0) > 0:
                self.fails[x] -= 1
                raise ValueError(f"no {x}")
        return x * 10


def test_bounded_calls():
    fn = Slow(fails={2: 1, 5: 9}, hangs=(7,))
    start = time.perf_counter()
    got = models.bounded(fn, list(range(12)), at_once=4, seconds=0.5, tries=2, pause=0.01)
    assert time.perf_counter() - start < 2.5 and 2 <= fn.most <= 5  # one that was given up may still run
    assert [g[0] for g in got] == [None if x in (5, 7) else x * 10 for x in range(12)]
    assert got[2] == (20, None, 2) and got[5] == (None, "ValueError: no 5", 2) and got[7] == (None, "no answer within 0.5 s", 2)


def test_completion_runs_at_once_and_falls_back(spark):
    def first(prompt):
        time.sleep(0.2)
        if "3" in prompt:
            raise OSError("down")
        return '{"a": 1}' if "strict" in prompt or "4" not in prompt else "prose", 1, 2

    def second(prompt):
        if "13" in prompt:
            raise OSError("down too")
        return "[]", 5, 6

    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(20)], "prompt_id string, prompt string").coalesce(1)
    start = time.perf_counter()
    got = {r.prompt_id: r for r in models.complete(prompts, [first, second], ["x", "y"], strict=" strict", at_once=5).collect()}
    assert time.perf_counter() - start < 20 and len(got) == 20
    assert (got["3"].model, got["3"].input_tokens) == ("y", 5) and got["13"].response is None and got["13"].error == "y: OSError: down too"
    assert (got["4"].attempts, got["4"].input_tokens, got["4"].response) == (2, 2, '{"a": 1}') and got["0"].model == "x"


def test_posts_are_retried_one_by_one(spark, tmp_path):
    def post(rows):
        if any(r["v"] % 7 == 3 for r in rows):
            raise ValueError("bad row")

    sinks.post_rows(spark.range(50).select(F.col("id").alias("v")), post, f"{tmp_path}/bad", batch=10)
    bad = [r.row for r in spark.read.parquet(f"{tmp_path}/bad").collect()]
    assert sorted(bad) == sorted(str({"v": i}) for i in range(50) if i % 7 == 3)


CHUNKS = "repo_id long, chunk_id string, file_path string, commit_sha string, content string"


def chunk_rows(n, sha, step=1):
    return [(i % 3, f"c{i}", f"f{i % 5}", sha, f"{sha} {i}") for i in range(0, n, step)]


def test_a_killed_lane_goes_on(spark, tmp_path):
    """Killed after the snapshot and before the checkpoint, and before the snapshot; the index is as if nothing had happened."""
    table = SnapshotTable.create(spark, f"{tmp_path}/index", CHUNKS, index_stream.KEYS, 8)
    write = lambda rows, lane: spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{lane}")
    for part in (chunk_rows(40, "s1"), chunk_rows(60, "s1", 2), chunk_rows(60, "s2", 5)):
        write(part, "full")
    write(chunk_rows(80, "s3", 7), "updates")
    deaths = {"full": ["after", "before"], "updates": ["before"]}

    def lane(name):
        run = index_stream.index_batch(table, name)

        def dying(batch, batch_id):
            when = deaths[name].pop(0) if batch_id and deaths[name] or name == "updates" and deaths[name] else None
            if when != "before":
                run(batch, batch_id)
            if when:
                raise RuntimeError(f"killed {when}")

        source = streams.file_stream(spark, f"{tmp_path}/{name}", CHUNKS, per_trigger=1)
        streams.write_batches(source, dying, f"{tmp_path}/checkpoint/{name}").awaitTermination()

    for name, tries in (("full", 2), ("updates", 1)):
        for _ in range(tries):
            with pytest.raises(Exception, match="killed"):
                lane(name)
        lane(name)
    want = {}
    for i, sha, *_ in [(i, s) for n, s, step in ((40, "s1", 1), (60, "s1", 2), (60, "s2", 5), (80, "s3", 7)) for i in range(0, n, step)]:
        want[f"c{i}"] = sha
    got = table.read().collect()
    assert {r.chunk_id: r.commit_sha for r in got} == want and len(got) == len(want)
    assert index_stream.progress(table) == {"full": 2, "updates": 0}
    snapshots = table.snapshot()["n"]
    lane("full")
    assert table.snapshot()["n"] == snapshots
