"""The streaming cache against the batch answer and a plain loop, with disorder within the delay, restarts and expiry."""

import random
from datetime import datetime, timedelta

from difforge.streaming import expiring, streams

START = datetime(2024, 1, 1)


def operations(seed, n=300, late=30):
    random.seed(seed)
    rows = []
    for i in range(n):
        at = START + timedelta(seconds=i * 20 - random.randrange(late))
        kind = random.choice(["put", "get", "get"])
        rows.append((i, at, kind, random.choice("abc") if i % 3 else "hot", f"v{i}" if kind == "put" else None, random.choice([5, 60, 600]) if kind == "put" else None))
    return rows


def loop(rows):
    store, out = {}, set()
    for i, at, kind, key, value, seconds in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind == "put":
            store[key] = value, at + timedelta(seconds=seconds)
        else:
            held = store.get(key)
            out.add((i, key, held[0] if held and held[1] > at else None))
    return out


def write(spark, rows, path):
    spark.createDataFrame(rows, expiring.OPS).coalesce(1).write.mode("append").parquet(path)


def run(spark, root):
    ops = streams.file_stream(spark, f"{root}/ops", expiring.OPS, per_trigger=1)
    streams.write_batches(expiring.cache_stream(ops, "5 minutes"), streams.log_sink(f"{root}/out"), f"{root}/checkpoint").awaitTermination()
    return [tuple(r) for r in spark.read.schema(expiring.ANSWERS).parquet(f"{root}/out").select("op_id", "key", "value").collect()]


def test_batch_answer(spark):
    rows = operations(1)
    got = [tuple(r) for r in expiring.cache_answers(spark.createDataFrame(rows, expiring.OPS)).collect()]
    assert len(got) == len(set(got)) and set(got) == loop(rows)


def test_stream_with_a_restart_equals_the_batch_answer(spark, tmp_path):
    rows = operations(2)
    write(spark, rows[:120], f"{tmp_path}/ops")
    early = run(spark, tmp_path)
    assert set(early) < loop(rows)
    write(spark, rows[120:], f"{tmp_path}/ops")
    write(spark, [(10_000, START + timedelta(days=9), "get", "end", None, None)], f"{tmp_path}/ops")
    write(spark, [(10_001, START + timedelta(days=9), "get", "end", None, None)], f"{tmp_path}/ops")
    got = run(spark, tmp_path)
    assert len(got) == len(set(got)) and set(got) == loop(rows)
