"""Spelling variants against a plain loop: words, near words, forms and roots, with cells small enough to be cut again and again."""

import collections
import random
import re
import zlib

import pytest

from difforge.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = collections.defaultdict(set)
    letters = {c for w in n for c in w}
    for w in n:
        for i in range(len(w) + 1):
            for x in [w[:i] + w[i + 1 :], *(w[:i] + c + w[i:] for c in letters), *(w[:i] + c + w[i + 1 :] for c in letters)]:
                if x in n and x != w:
                    near[w].add(x)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return out


@pytest.mark.parametrize("cell", [4096, 20])
def test_documents_of_the_table(spark, cell):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [tuple(r) for r in spelling.variants(docs, cell=cell).collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_words_and_cases(spark, monkeypatch, seed):
    """Few letters make words with very many near words; two very long words; nulls, empty texts, repeated rows, clashing names."""
    random.seed(seed)
    rows = [(i, "".join(random.choice("abABé ") for _ in range(2000))) for i in range(30)]
    rows += [(None, None), (5, ""), (7, None), (None, "wörter wörter Wörter worter"), *((6 + i, "x" * 3000 + " " + "x" * 2999 + " " + "x" * 2998 + "y") for i in range(3))]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string").repartition(3)
    got = [tuple(r) for r in spelling.variants(docs, cell=15).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    monkeypatch.setattr(spelling, "BLOCK", 7)
    assert spelling.variants(docs.where("false")).count() == 0


def test_one_prefix_holds_a_third_of_the_words(spark):
    words = [f"{'common' if i % 3 == 0 else 'pre' + chr(97 + i % 26)}{chr(97 + i % 7)}{chr(97 + i // 7 % 9)}{chr(97 + i // 63 % 9)}" for i in range(900)]
    rows = [(i, " ".join(words[i::3] * (1 + i % 4))) for i in range(9)]
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), cell=10).collect()}
    assert got == brute(rows)
