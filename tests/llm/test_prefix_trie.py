"""The conversation trie against a plain one of nested dictionaries, in blocks of every size."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from difforge.llm import prefix_trie
from difforge.llm.common import Scratch

NAMES = prefix_trie.OUT


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids.get(p, [])) or 1
        saved[p] = sum(saved[q] for q in kids.get(p, [])) + (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = set()
    for p, cs in nodes.items():
        ends = sorted(c for c in cs if len(convs[c]) == len(p))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.add((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), leaves[p], saved[p], sha))
    return out


def compare(got, want):
    got = [tuple(r[c] for c in NAMES) for r in got]
    assert len(got) == len(set(got))
    assert set(got) == want


@pytest.mark.parametrize("block", [1 << 16, 7, 1])
def test_conversations_of_the_table(spark, monkeypatch, block):
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    scratch = Scratch(spark, "trie-test")
    sequences = prefix_trie.rebuilt(conversations, scratch)
    compare(small_blocks(sequences, scratch, monkeypatch, block).collect(), brute(rebuilt([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()])))


def small_blocks(sequences, scratch, monkeypatch, block):
    """The trie in blocks of ``block`` rows; the size goes along to the workers."""
    whole = prefix_trie._blocks

    def blocks(batches):
        prefix_trie.BLOCK = block
        yield from whole(batches)

    monkeypatch.setattr(prefix_trie, "_blocks", blocks)
    out = prefix_trie.trie(sequences, scratch)
    monkeypatch.undo()
    return out


@pytest.mark.parametrize("seed, block", [(1, 1), (2, 2), (3, 3), (4, 5), (5, 64), (6, 1 << 16)])
def test_dense_tries(spark, monkeypatch, seed, block):
    """Few different turns: many equal conversations, prefixes of others, long shared stretches, turnless ones; one conversation holds a third."""
    random.seed(seed)
    rows = []
    for c in range(700):
        n = random.choice([0, 1, 2, 3, 5, 8, 12])
        turns = [random.choice("ab") for _ in range(n)] if c % 3 else list("abab")
        rows += [(c * (1 if seed % 2 else 5) - 20, t, "user" if t % 2 else "assistant", x) for t, x in enumerate(turns)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    scratch = Scratch(spark, "trie-test")
    got = small_blocks(prefix_trie.rebuilt(conversations, scratch), scratch, monkeypatch, block).collect()
    own = {}
    for c, t, r, x in rows:
        own.setdefault(c, []).append((r, x))
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        convs[c] = own.get(base, [])[:h] + turns[h:]
    compare(got, brute(convs))


def test_cases(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 1, "", ""), (None, 0, "user", "nobody's"), (2, 0, "user", "x"), (2, 0, "user", "x"), (10, 0, "user", "y" * 100_000), (11, 3, "user", "z"), (4, 5, "a", "é")]
    rows += [(15, t, "user", f"turn {t}") for t in range(3000)] + [(16, t, "user", f"turn {t}") for t in range(2999)]
    conversations = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, seq string")
    compare(prefix_trie.conversation_trie(conversations).collect(), brute(rebuilt(rows)))
    assert prefix_trie.conversation_trie(conversations.where("false")).count() == 0
    compare(prefix_trie.conversation_trie(conversations.where("conv_id = 11")).collect(), brute(rebuilt([(11, 3, "user", "z")])))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-1, 5), min_size=1, max_size=40), st.integers(0, 5))
def test_minima(values, than):
    m = prefix_trie.Minima(np.array([-2, *values, -2]))
    array = [-2, *values, -2]
    for start in range(len(array)):
        assert m.smaller_left(np.array([start]), np.array([than]))[0] == max(i for i in range(start + 1) if array[i] < than)
        assert m.smaller_right(np.array([start]), np.array([than]))[0] == min(i for i in range(start, len(array)) if array[i] < than)
        for stop in range(start, len(array) + 1):
            assert m.least(np.array([start]), np.array([stop]))[0] == min(array[start:stop], default=prefix_trie.FAR)
