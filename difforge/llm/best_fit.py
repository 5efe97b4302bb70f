"""Best-fit packing improved by swap-based local search.

Every document is tokenised once, where it is read, and cut into pieces; a piece is a few numbers from then on. How many pieces
have each length, at most ``room`` counts, is all that the search needs: bins that hold the same lengths are one class with a
multiplicity, so its work doesn't grow with the corpus. Best fit decreasing makes the first classes; then documents move between
underfull bins, one for one, two for one, one for two, or as plain moves, while the sum of squared fills grows, until bins empty.
A step is made in as many bins as both classes have. Then Spark numbers the pieces within each length, and the numbers say
which bin and offset a piece gets; no task holds all pieces of a length.

Token ids are those of the library ``tokenizers`` for the same file, special strings included. They are made by ``tiktoken`` from
that file's vocabulary, at four times the speed; the two agree on every text if each entry of the vocabulary is what
its own merges end in, which ``tests/llm/test_best_fit.py`` checks. Texts that ``tiktoken`` refuses go to ``tokenizers``.

Cases: null text counts as empty, and an empty text has the end id only; repeated rows, also such without id, are rows of their own;
an empty table gives an empty result; of ties in length the hash of the id decides; columns other than doc_id and text are
ignored. Long texts are cut, for the tokeniser's memory, where a letter meets a single space, which no token spans.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, number_rows, over_batches

ROOM = 1024
END = 2
#: Characters of a text that are tokenised at once, where it can be cut.
STRETCH = 1 << 18
#: Steps of the local search at most; it mostly ends sooner, where no step is left, and any step leaves a right packing.
STEPS = 4000
_CUT = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its ids, by the vocabulary of ``path``, a byte-level BPE file of ``tokenizers``."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = byte_of_sign()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow: list = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except (ValueError, RuntimeError):  # the pattern's own limits, on runs of millions of blanks
            if not slow:
                slow.append(Tokenizer.from_file(path))
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_ids(encode, text: str) -> np.ndarray:
    """All ids of a text, long ones stretch by stretch."""
    out, at = [], 0
    while len(text) - at > STRETCH and (cut := _CUT.search(text, at + STRETCH)):
        out.extend(encode(text[at : cut.start()]))
        at = cut.start()
    out.extend(encode(text[at:] if at else text))
    return np.array(out, np.uint32)


def cut_pieces(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of a document of ``n`` ids; only the first piece may be shorter than ``room``."""
    first = n % room or room
    return [(0, first)] + [(at, room) for at in range(first, n, room)]


def first_fit_classes(counts: dict[int, int], room: int) -> Counter:
    """Best fit decreasing over lengths with counts: patterns (lengths, descending) with their number of bins."""
    by_left: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for gap in range(length, room):
            while left and by_left.get(gap):
                pattern, bins = by_left[gap].pop()
                fit = min(gap // length, left)
                use = min(bins, left // fit)
                if use < bins:
                    by_left[gap].append((pattern, bins - use))
                by_left.setdefault(gap - fit * length, []).append((pattern + (length,) * fit, use))
                left -= use * fit
        each = room // length
        full, over = divmod(left, each)
        for number, bins in ((each, full), (over, 1)):
            if number and bins:
                by_left.setdefault(room - number * length, []).append(((length,) * number, bins))
    out: Counter = Counter()
    for held in by_left.values():
        for pattern, bins in held:
            out[pattern] += bins
    return out


def _best_step(classes: Counter, room: int):
    """The step that adds most to the squared fill, from the emptiest class; None if no class has one."""
    under = sorted((p for p in classes if sum(p) < room), key=lambda p: (sum(p), p))
    fill = np.array([sum(p) for p in under], np.int64)
    takers, takes, back = [], [], []
    for i, p in enumerate(under):
        seen = {()} | {(x,) for x in p} | {tuple(sorted(p[a : a + 1] + p[b : b + 1])) for a in range(len(p)) for b in range(a + 1, len(p))}
        for s in sorted(seen):
            takers.append(i)
            takes.append(sum(s))
            back.append(s)
    to, got = np.array(takers, np.int64), np.array(takes, np.int64)
    size = np.array([len(s) for s in back], np.int64)
    for i, p in enumerate(under):
        gives = {(x,) for x in p} | {tuple(sorted(p[a : a + 1] + p[b : b + 1])) for a in range(len(p)) for b in range(a + 1, len(p))}
        best = None
        for give in sorted(gives):
            flow = sum(give) - got
            gain = 2 * flow * (fill[to] - fill[i] + flow)
            ok = (flow > 0) & (fill[to] + flow <= room) & (gain > 0) & (size < 3 if len(give) == 1 else size < 2)
            if classes[p] < 2:
                ok &= to != i
            if ok.any():
                at = int(np.where(ok, gain, 0).argmax())
                if best is None or gain[at] > best[0]:
                    best = (int(gain[at]), p, give, under[to[at]], back[at])
        if best:
            return best[1:]
    return None


def _without(pattern: tuple[int, ...], some: tuple[int, ...]) -> list[int]:
    rest = list(pattern)
    for x in some:
        rest.remove(x)
    return rest


def search(counts: dict[int, int], room: int = ROOM, steps: int = STEPS) -> Counter:
    """Patterns with their number of bins, after local search from best fit decreasing."""
    classes = first_fit_classes(counts, room)
    least = -(-sum(n * c for n, c in counts.items()) // room)
    for _ in range(steps):
        if sum(classes.values()) <= least:
            break
        step = _best_step(classes, room)
        if step is None:
            break
        giver, give, taker, back = step
        times = classes[giver] // 2 if giver == taker else min(classes[giver], classes[taker])
        less = tuple(sorted([*_without(giver, give), *back], reverse=True))
        more = tuple(sorted([*_without(taker, back), *give], reverse=True))
        for p, by in ((giver, -times), (taker, -times), (less, times), (more, times)):
            if p:
                classes[p] += by
                if not classes[p]:
                    del classes[p]
    return classes


def places(classes: Counter) -> np.ndarray:
    """Rows (length, first number, pieces of it in a bin, first sequence, offset), by length and number."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, bins in sorted(classes.items(), reverse=True):
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, used[length], each, sequence, offset))
            used[length] += each * bins
            offset += each * length
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(path: str, room: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            doc, piece, start, length, crc, all_ids = [], [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = np.append(token_ids(encode, text.as_py() or ""), np.uint32(END)).astype("<u4")
                for k, (at, n) in enumerate(cut_pieces(len(ids), room)):
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    all_ids.append(ids[at : at + n].astype(np.int32))
            out = {
                "doc_id": b.column(0).take(pa.array(doc, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.record_batch(out)

    return run


def pieces(docs: DataFrame, path: str, room: int = ROOM, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``) of every piece."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_batches(rows, _pieces(path, room, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _placed(spark: SparkSession, numbered: DataFrame, table: np.ndarray) -> DataFrame:
    at = spark.sparkContext.broadcast(table)  # at most some rows for each of ``room`` lengths
    kept = [f for f in numbered.schema if f.name != "_number"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"

    def run(batches):
        keys = at.value[:, 0] * (1 << 50) + at.value[:, 1]
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            number = b.column(b.schema.get_field_index("_number")).to_numpy()
            row = at.value[np.searchsorted(keys, length * (1 << 50) + number, "right") - 1]
            bin_, slot = np.divmod(number - row[:, 1], row[:, 2])
            own = b.select([f.name for f in kept])
            yield own.append_column("sequence_id", pa.array(row[:, 3] + bin_)).append_column("offset", pa.array(row[:, 4] + slot * length))

    return over_batches(numbered, run, schema)


def pack_best_fit(docs: DataFrame, path: str, room: int = ROOM, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece (and its ``ids``)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "best-fit")
    cut = scratch.keep(pieces(docs, path, room, with_ids))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``room`` rows
    table = places(search(counts, room))
    mixed = cut.withColumn("_mixed", F.xxhash64("doc_id", "piece"))
    numbered = number_rows(scratch, mixed, "length", ["_mixed", "doc_id", "ids_crc32"], "_number").drop("_mixed")
    scratch.drop(cut)
    return _placed(spark, numbered, table)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, lengths: whole training sequences, from the pieces of ``pack_best_fit(with_ids=True)``."""
    held = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length"))).alias("p"))
    return held.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
