"""Sharding, batches, mixing, language and quality against plain loops over the same rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from difforge.llm import language, mixing, packing, quality, sharding
from difforge.llm.text import word_hashes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]


def words(text):
    return len("".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ")) - "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ").count("")


def test_items_go_where_the_dot_product_is_highest(monkeypatch):
    monkeypatch.setattr(sharding, "even_out", lambda vectors, out, shards: out)
    vectors = np.random.default_rng(1).dirichlet(np.ones(60), 3).T
    got = sharding.place(vectors, 7)
    left = [[1 / 7] * 3 for _ in range(7)]
    for i in sorted(range(60), key=lambda i: (-max(vectors[i]), i)):
        dots = [sum(w * a * b for w, a, b in zip((16, 1, 1), r, vectors[i], strict=True)) for r in left]
        assert dots[got[i]] >= max(dots) - 1e-12
        left[got[i]] = [a - b for a, b in zip(left[got[i]], vectors[i], strict=True)]


def test_sharded_rows(docs, texts):
    got = sharding.assign_shards(docs, 12).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), words(t)) for i, t, _ in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.tokens) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(12))


def test_rows_without_id_are_spread(spark):
    rows = [(None if i % 3 == 0 else i, "same" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 10).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert size.max() / size.mean() < 1.1 and got[got.doc_id.isna()].shard.nunique() >= 5


def test_batches(docs, texts):
    got = packing.pack(docs, 8, 4096).collect()
    n = {i: words(t) for i, t, _ in texts}
    bounds = sorted({r.bucket_len for r in got})
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens == n[r.doc_id] and r.bucket_len == min(b for b in bounds if b >= r.n_tokens) and r.padding == r.bucket_len - r.n_tokens
        batches[r.bucket, r.batch].append((r.row_in_batch, r.bucket_len))
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in texts)
    of_bucket = defaultdict(dict)
    for (bucket, batch), held in batches.items():
        room = max(1, 4096 // max(1, held[0][1]))
        assert sorted(x for x, _ in held) == list(range(len(held))) and len(held) <= room
        of_bucket[bucket][batch] = len(held) == room
    for full in of_bucket.values():  # only the last batch of a bucket may have room left
        assert sorted(full) == list(range(len(full))) and all(full[k] for k in range(len(full) - 1))


def solve(sizes, target):
    """The multiplier by bisection: sum of size * min(3, exp(lam * size / mean)) = target."""
    mean = sum(sizes) / len(sizes)
    low, high = -1e4, 1e4
    for _ in range(200):
        lam = (low + high) / 2
        low, high = (lam, high) if sum(s * min(3.0, math.exp(min(50.0, lam * s / mean))) for s in sizes) < target else (low, lam)
    return lam, mean


def test_mixing_equals_bisection(docs, texts):
    sizes = defaultdict(list)
    for _, t, s in texts:
        sizes[s].append(words(t))
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    total, left, weight = sum(map(sum, sizes.values())), set(sizes), {s: i % 3 + 1 for i, s in enumerate(names)}
    target = {}
    while True:  # whoever would pass three times its size gets that, the others share the rest anew
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * sum(sizes[s])}
        target |= {s: 3.0 * sum(sizes[s]) for s in over} if over else share
        left -= over
        if not over:
            break
    got = mixing.balance(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, words(t)) for i, t, _ in texts)
    lam = {s: solve(v, target[s]) for s, v in sizes.items()}
    for r in got:
        k, mean = lam[r.source]
        assert r.source_size == sum(sizes[r.source]) and r.target == pytest.approx(target[r.source], rel=1e-9)
        want = min(3.0, math.exp(min(50.0, k * r["size"] / mean))) if r["size"] else 1.0
        assert r.rate == pytest.approx(want, rel=1e-4) and 0 <= r.copies <= 3 and abs(r.copies - r.rate) < 2.01 and r.taken == r.copies * r["size"]


def test_mixing_with_one_id_or_none_for_a_third(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "w " * (1 + i % (4 if i % 3 == 1 else 50)), f"s{i % 2}") for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = Counter(map(tuple, mixing.balance(table.repartition(5)).collect()))
    assert one == Counter(map(tuple, mixing.balance(table.repartition(2)).collect())) and sum(one.values()) == 6000
    for s in ("s0", "s1"):
        mine = [(dict(zip(("id", "source", "size", "whole", "target", "rate", "copies", "taken"), r, strict=True)), n) for r, n in one.items() if r[1] == s]
        assert sum(r["taken"] * n for r, n in mine) == pytest.approx(mine[0][0]["target"], rel=0.01)


def test_languages_by_counting_grams(spark, docs, texts):
    filters = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(docs, filters).collect()}
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
    for i, text, _ in texts[:60]:
        raw = [fold(b) for b in (text or "").encode()]
        grams = np.array([sum(b << 8 * k for k, b in enumerate(raw[j : j + 4])) for j in range(len(raw) - 3)], np.uint32)
        share = []
        for k in range(len(filters.langs)):
            held = sum(all(int(filters.slots[int(s[0])]) >> k & 1 for s in language._slots(g[None])) for g in grams)
            share.append(max(0.0, (held / max(1, len(grams)) - filters.false[k]) / (1 - filters.false[k])))
        if not any(c.isalpha() for c in text or ""):
            assert got[i].lang_pred == "und" and got[i].score == 0
        else:
            assert got[i].lang_pred == (filters.langs[int(np.argmax(share))] if max(share) > 0 else filters.usual)
            assert got[i].score == pytest.approx(max(share) / max(sum(share), 1e-12), abs=1e-9)


def test_quality_scores_by_hand(spark, docs, texts):
    """Each text alone: words, word pairs and character n-grams looked up one by one, their mean through the logistic."""
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    shift = 64 - quality.BUCKETS.bit_length() + 1
    mix = lambda x: int(quality.mix64(np.array([x % (1 << 64)], np.uint64))[0])
    odd = int(quality._ODD)
    for i, text, _ in sorted(texts, key=lambda t: len(t[1] or ""))[:40]:
        parts = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
        hashes = [int(word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), fold=False)[0]) for w in parts]
        buckets = [h >> shift for h in hashes]
        buckets += [quality.BUCKETS if a == b else mix(a * odd + b) >> shift for a, b in zip(hashes, hashes[1:], strict=False)]
        chars = [int.from_bytes(c.encode(), "little") for c in text or ""]
        for n in quality.GRAMS:
            for j in range(len(chars) - n + 1):
                h = n
                for c in chars[j : j + n]:
                    h = (h * odd + c) % (1 << 64)
                buckets.append(h * odd % (1 << 64) >> shift)
        mean = float(np.mean(model.table[buckets].astype(np.float64))) if buckets else 0.0
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.bias + mean))), abs=1e-9)


def test_scores_of_a_batch_are_those_of_each_text(texts):
    model = quality.Model(np.random.default_rng(2).normal(size=quality.BUCKETS + 1).astype(np.float32), 0.1)
    some = [t for _, t, _ in texts[:50]] + [None, ""]
    together = model.scores(pa.array(some))
    assert together == pytest.approx([model.scores(pa.array([t], pa.string()))[0] for t in some], abs=1e-9)
