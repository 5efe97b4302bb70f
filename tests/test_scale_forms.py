"""Forms that hold no key whole, against plain loops: admission, blocked vectors, islands of findings, dyadic cells of ranges."""

import random
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from difforge.operators import findings, indexing, intervals, retrieval

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("seed, limit, seconds", [(1, 30, 60), (2, 3, 10), (3, 1, 7)])
def test_admission_equals_a_loop(spark, seed, limit, seconds):
    """One key holds most calls and comes in bursts; the queue runs empty between some of them."""
    random.seed(seed)
    rows, at = [], START
    for i in range(1500):
        at += timedelta(seconds=random.choice([0, 0, 0, 0, 1, 2]) if i % 400 else 3000)
        rows.append((i, "hot" if random.random() < 0.7 else random.choice("abc"), at))
    want, rings = {}, {}
    for i, key, t in rows:
        ring = rings.setdefault(key, deque(maxlen=limit))
        go = max(t, ring[0] + timedelta(seconds=seconds)) if len(ring) == limit else t
        ring.append(go)
        want[i] = go
    calls = spark.createDataFrame(rows, "id long, key string, at timestamp")
    got = {r.id: r.admitted_at for r in indexing.admitted(calls, "key", "at", "id", limit, seconds).collect()}
    assert got == want


def test_blocked_vectors_equal_all_pairs(spark):
    """Several blocks a repository, equal vectors, nulls, zeros, other lengths, excluded files; the border of the threshold."""
    rng = np.random.default_rng(5)
    base = rng.integers(-3, 4, (40, 6)).astype(float)
    vectors = [base[i % 40].tolist() for i in range(160)]
    vectors[3], vectors[5], vectors[7], vectors[9] = None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0] * 4
    vectors[12] = [2.0, 1.0] * 4
    vectors[11] = [float("nan")] * 6
    rows = [(i, i % 3 and "big" or "small", v, f"f{i % 10}") for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "chunk_id long, repo_id string, embedding array<double>, file_path string")
    queries = chunks.select(F.col("chunk_id").alias("query_id"), "repo_id", F.col("embedding").alias("vector"), F.array("file_path").alias("skip"))
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        dot = lambda x, y: sum((p * q for p, q in zip(x, y, strict=True)), 0.0)
        return dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5)

    want = set()
    for i, repo, v, path in rows:
        if fine(v):
            near = [(-cosine(v, w), j) for j, r, w, p in rows if r == repo and p != path and fine(w) and len(v) == len(w) and cosine(v, w) >= 0.5]
            want |= {(i, j, k + 1) for k, (_, j) in enumerate(sorted(near)[:4])}
    for block in (2048, 16, 3):
        got = retrieval.similar_chunks(queries, chunks, 4, 0.5, "skip", block=block).collect()
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == want and len(got) == len(want)


def fold(rows, tolerance=3):
    seeds, out = {}, {}
    for path, o, lo, hi in sorted(rows, key=lambda r: r[1]):
        mine = seeds.setdefault(path, [])
        hit = next((s for s, a, b in mine if None not in (a, b, lo, hi) and a <= hi + tolerance and b >= lo - tolerance), None)
        if hit is None:
            mine.append((o, lo, hi))
        out[path, o] = o if hit is None else hit
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merging_equals_the_fold(spark, seed):
    random.seed(seed)
    rows = []
    for o in range(800):
        lo = random.randrange(2000)
        rows.append((random.choice(["hot", "hot", "a", "b"]), o, None if o % 97 == 0 else lo, lo + random.choice([0, 1, 5, 40, -3]) if o % 89 else None))
    want = fold(rows)
    df = spark.createDataFrame([(*r, r[1] % 4, (r[1] * 7 % 11) / 10) for r in rows], "file_path string, ord long, line_start int, line_end int, rank int, confidence double").repartition(7)
    best = {}
    for path, o, _, _ in rows:
        key = path, want[path, o]
        best[key] = min(best.get(key, (9,)), (o % 4, -(o * 7 % 11) / 10, o))
    got = {(r.file_path, r.seed_ord): r.ord for r in findings.merge_overlapping(df, ["file_path"]).collect()}
    assert got == {k: v[2] for k, v in best.items()}


def test_a_file_of_many_findings(spark):
    """A quarter of a million findings of one file, all of one island; no task holds them as one row."""
    df = spark.range(250_000).select(F.lit("f").alias("file_path"), F.col("id").alias("ord"), (F.col("id") * 4 % 1_000_003).cast("int").alias("line_start"), F.lit(1).alias("rank"), F.lit(0.5).alias("confidence"))
    df = df.withColumn("line_end", F.col("line_start") + 1)
    got = findings.merge_overlapping(df, ["file_path"])
    assert got.count() < 250_000 and "collect_list" not in got._jdf.queryExecution().toString()


def test_cells_of_a_long_range(spark):
    one = spark.createDataFrame([(1, 100_000_000), (5, 5), (300, 200), (-7, 900), (255, 256)], "lo long, hi long")
    runs = one.select("lo", "hi", F.explode(intervals.covering(F.col("lo"), F.col("hi"))).alias("r")).select("lo", "hi", "r.*").collect()
    held = {}
    for r in runs:
        held.setdefault((r.lo, r.hi), []).append((int(r.cell) << r.level, (int(r.cell) + 1) << r.level))
    for (lo, hi), spans in held.items():
        spans.sort()
        assert len(spans) < 64 and spans[0][0] == lo // 256 and spans[-1][1] == max(lo, hi) // 256 + 1
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_joins_equal_loops(spark, seed):
    random.seed(seed)
    make = lambda n: [(i, random.choice("ab"), x := random.randrange(5000), x + random.choice([-9, 0, 3, 700, 100_000])) for i in range(n)]
    a, b = make(120), make(15)
    left, right = spark.createDataFrame(a, "id long, f string, lo long, hi long"), spark.createDataFrame(b, "rid long, f string, rlo long, rhi long")
    for tolerance in (0, 3):
        meets = {i for i, f, lo, hi in a if any(f == g and lo <= h2 + tolerance and hi >= l2 - tolerance for _, g, l2, h2 in b)}
        got = {r.id for r in intervals.overlapping(left, right, ["f"], ("lo", "hi"), ("rlo", "rhi"), "id", tolerance).collect()}
        rest = {r.id for r in intervals.not_covered(left, right, ["f"], ("lo", "hi"), ("rlo", "rhi"), "id", tolerance).collect()}
        assert got == meets and rest == {r[0] for r in a} - meets
    nodes = right.select("f", F.col("rlo").alias("start_line"), F.col("rhi").alias("end_line"), F.col("rid").cast("string").alias("name"))
    points = left.select(F.col("id").alias("probe_id"), "f", F.col("lo").alias("line"))
    for r in intervals.innermost(points, nodes, ["f"]).collect():
        around = [(l2, -h2, str(i)) for i, g, l2, h2 in b if g == r.f and l2 <= r.line <= h2]
        assert r.enclosing == (max(around)[2] if around else None) or len({x[:2] for x in around}) < len(around)
    hunks = right.select("f", F.col("rlo").alias("hunk_start"), F.col("rhi").alias("hunk_end"))
    ranges = left.select(F.col("id").alias("probe_id"), "f", F.col("lo").alias("line_start"), F.col("hi").alias("line_end"))
    for r in intervals.same_range(ranges, hunks, ["f"]).collect():
        assert r.same_hunk == any(r.f == g and r.line_start >= l2 and r.line_start <= h2 and r.line_end <= h2 for _, g, l2, h2 in b)


def test_replies_are_parsed_once(spark):
    """A reply is computed and parsed once, and two replies to one prompt stay two."""
    reply = F.to_json(F.struct((F.col("id") >= 0).alias("has_breaking_changes"), F.array(F.struct(F.lit("a").alias("file"), (F.col("id") + 5).alias("line"))).alias("affected_call_sites")))
    replies = spark.range(2).select(F.lit("p").alias("prompt_id"), F.lit("f").alias("func_name"), F.lit("b").alias("changed_file"), reply.alias("response"))
    positions = spark.createDataFrame([("a", 5, 50), ("a", 8, 80), ("b", 6, 60)], "file_path string, new_lineno int, diff_position int")
    found = findings.from_impact(replies, positions)
    assert sorted((r.line_start, r.diff_position) for r in found.collect()) == [(5, 50), (6, 50)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1 and "Window" not in plan, plan
