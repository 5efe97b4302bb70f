"""Best-fit packing: the vocabulary's own merges, cuts, offsets and ids by brute force, the search on histograms."""

import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from difforge.llm import best_fit

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def test_vocabulary_entries_are_what_their_own_merges_end_in():
    """Then merging any pair that is an entry, and merging listed pairs only, agree on every text."""
    model = json.load(open(PATH, encoding="utf-8"))["model"]
    pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    rank = {p: i for i, p in enumerate(pairs)}
    assert all(model["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(pairs))
    for token in model["vocab"].keys() - {"<|endoftext|>"}:
        parts = list(token)
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(rank)))
            assert (parts[at], parts[at + 1]) in rank, token
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_ids_are_those_of_the_tokenizer(monkeypatch):
    own, encode = Tokenizer.from_file(PATH), best_fit.encoder(PATH)
    some = ["", " ", "a<|endoftext|> b", "  \n\n x  y", "éè 12 3'll <|endoftext|><|endoftext|>", "a" * 5000, " " * 3000 + "b", "\U0001f600 ‍ x", "word " * 999]
    for stretch in (1 << 18, 50):
        monkeypatch.setattr(best_fit, "STRETCH", stretch)
        for text in some:
            assert best_fit.token_ids(encode, text).tolist() == own.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_search_keeps_every_piece_and_never_adds_bins(counts):
    start, end = best_fit.first_fit_classes(counts, 64), best_fit.search(counts, 64)
    for classes in (start, end):
        held = Counter()
        for pattern, bins in classes.items():
            assert sum(pattern) <= 64 and bins > 0
            for x in pattern:
                held[x] += bins
        assert held == Counter(counts)
    assert sum(end.values()) <= sum(start.values())
    assert sum(b * sum(p) ** 2 for p, b in end.items()) >= sum(b * sum(p) ** 2 for p, b in start.items())


def test_local_search_empties_bins_that_best_fit_leaves():
    rng = np.random.default_rng(0)
    lengths, counts = np.unique(rng.integers(300, 420, 2000), return_counts=True)
    given_counts = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    assert sum(best_fit.search(given_counts, 1024).values()) < 0.98 * sum(best_fit.first_fit_classes(given_counts, 1024).values())


def check(texts, got, room=1024):
    own = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text in texts:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % room or room
        for k, at in enumerate([0, *range(first, len(ids), room)]):
            piece = ids[at : first if k == 0 else at + room]
            want[i, k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= room
    return len(bins)


def test_documents_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = best_fit.pack_best_fit(docs, PATH).collect()
    bins = check([(r.doc_id, r.text) for r in docs.collect()], got)
    assert bins <= 1.02 * sum(r.length for r in got) / 1024 + 1


def test_cases(spark):
    random.seed(3)
    long_text = " ".join(f"w{random.random()}" for _ in range(20000))
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id"), (None, "no id"), (4, long_text), (5, " \n\t "), *((i, "same text") for i in range(100, 400))]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, length long, _number string, offset long").repartition(3)
    check(rows, best_fit.pack_best_fit(docs, PATH).collect())
    assert best_fit.pack_best_fit(docs.where("false"), PATH).count() == 0


def test_whole_sequences(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 9)) for i in range(60)], "doc_id long, text string")
    got = best_fit.sequences(best_fit.pack_best_fit(docs, PATH, room=64, with_ids=True)).collect()
    own = Tokenizer.from_file(PATH)
    assert sum(len(r.ids) for r in got) == sum(len(own.encode(f"text number {i} " * (i % 9), add_special_tokens=False).ids) + 1 for i in range(60))
    assert all(len(r.ids) == sum(r.lengths) <= 64 for r in got)


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 5000])
def test_only_the_first_piece_may_be_shorter(n):
    cut = best_fit.cut_pieces(n, 1024)
    assert sum(k for _, k in cut) == n and all(k == 1024 for _, k in cut[1:]) and [a for a, _ in cut] == list(np.cumsum([0, *(k for _, k in cut)])[:-1])
