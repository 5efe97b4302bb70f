"""Language identification by language-bitmask n-gram filters.

A Bloom filter for each language is stored bit-sliced: slot by slot, one word holds that slot's bit of every
filter, so the bitwise and of an n-gram's slots names all languages that contain it. A text's hits are counted for each
language, corrected by the filter's false-positive rate, and the language with the most wins. N-grams are four
bytes of folded text with non-letters as spaces. A language's filter holds the n-grams that make up at
least FLOOR of its sample, unless another language uses them more than 1/RIVAL times as often; FLOOR bounds
the number of n-grams at 1/FLOOR for each language. The sample takes about PER_LANG documents of each language, those whose id
hashes lowest.

Cases: text that is null or has no letter is ``und`` with score 0; without anything learned all are ``und``; rows that
repeat are predicted each; an empty table gives an empty result; a null lang teaches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_crc, over_batches
from .text import chunks

N = 4
SLOTS = 1 << 20
PER_LANG = 1500
FLOOR = 2e-5
RIVAL = 0.3
MOST_LANGS = 64

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte n-grams in text order and where each text's begin (one more entry); all-space ones stay."""
    size = np.maximum(np.diff(offs) - N + 1, 0)
    at = np.concatenate([[0], np.cumsum(size)])
    if len(data) < N:
        return np.zeros(0, np.uint32), at
    folded = _LETTER[data].astype(np.uint32)
    n = len(data) - N + 1
    gram = folded[:n] | folded[1 : n + 1] << np.uint32(8) | folded[2 : n + 2] << np.uint32(16) | folded[3:] << np.uint32(24)
    inside = np.ones(len(data), bool)
    for k in range(1, N):
        end = offs[1:] - k
        inside[end[end >= offs[:-1]]] = False
    return gram[inside[:n]], at


def _slots(gram: np.ndarray) -> list[np.ndarray]:
    """Two slots of each n-gram."""
    h = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    mask = np.uint64(SLOTS - 1)
    return [((h >> np.uint64(s)) & mask).astype(np.int32) for s in (44, 22)]


@dataclass
class Filters:
    """``slots`` has a bit for each of ``langs``; ``false`` are the filters' false-positive rates; ``usual`` is the answer without hits."""

    langs: list[str]
    slots: np.ndarray
    false: np.ndarray
    usual: str | None = None

    @classmethod
    def build(cls, by_lang: dict[str, np.ndarray], usual: str | None = None) -> Filters:
        langs = sorted(by_lang)
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= len(langs))
        slots = np.zeros(SLOTS, kind)
        for k, lang in enumerate(langs):
            for at in _slots(by_lang[lang].astype(np.uint32)):
                slots[at] |= kind(1 << k)
        fill = np.array([((slots >> kind(k)) & kind(1)).mean() for k in range(len(langs))])
        return cls(langs, slots, fill**2, usual)

    def hits(self, column: pa.Array) -> np.ndarray:
        """Corrected share of each text's n-grams that each language contains."""
        out = np.zeros((len(column), len(self.langs)))
        kind = self.slots.dtype.type
        for i, j, data, offs in chunks(column):
            gram, at = grams(data, offs)
            a, b = _slots(gram)
            mask = self.slots[a] & self.slots[b]
            n = np.maximum(np.diff(at), 1)
            for k in range(len(self.langs)):
                run = np.concatenate([[0], np.cumsum((mask >> kind(k)) & kind(1), dtype=np.int64)])
                out[i:j, k] = (run[at[1:]] - run[at[:-1]]) / n
        return np.maximum((out - self.false) / (1 - self.false), 0)


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Filters:
    """Filters from ``docs`` (doc_id, text, lang)."""
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    count = dict(docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS + 1).collect())
    if len(count) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not count:
        return Filters.build({})
    bound = F.create_map(*(F.lit(v) for lang, n in count.items() for v in (lang, min(1.0, per_lang / n))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.where(draw < F.element_at(bound, F.col("lang"))).select("lang", "text")

    def local(batches):
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for i, j, data, offs in chunks(b.column(1)):
                gram, at = grams(data, offs)
                owner = np.repeat(langs[i:j], np.diff(at))
                for lang in set(langs[i:j]):
                    value, n = np.unique(gram[owner == lang], return_counts=True)
                    yield pa.record_batch({"lang": pa.array([lang] * len(value), pa.string()), "gram": value.astype(np.int64), "n": n.astype(np.int64)})

    counts = over_batches(sample, local, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = dict(counts.groupBy("lang").agg(F.sum("n")).collect())
    share = F.col("n") / F.element_at(F.create_map(*(F.lit(v) for k, n in total.items() for v in (k, float(n)))), F.col("lang")) if total else F.lit(0.0)
    # Bounded: at most 1 / FLOOR n-grams of each of at most MOST_LANGS languages.
    got = counts.withColumn("share", share).where(F.col("share") >= FLOOR).select("lang", "gram", "share").toPandas()
    got = got[got["share"] >= RIVAL * got.groupby("gram")["share"].transform("max")]
    return Filters.build({lang: got["gram"][got["lang"] == lang].to_numpy() for lang in count}, max(count, key=lambda k: (count[k], k)))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of each row of ``docs``; the score is the winner's part of all corrected hits."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for b in batches:
            f = shared.value
            lettered = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            if f.langs and b.num_rows:
                hits = f.hits(b.column(1))
                best = hits.argmax(axis=1)
                top = hits[np.arange(len(hits)), best]
                pred = np.where(lettered, np.where(top > 0, np.array(f.langs, object)[best], f.usual or f.langs[0]), "und")
                score = np.where(lettered, top / np.maximum(hits.sum(axis=1), 1e-12), 0.0)
            yield pa.record_batch({"doc_id": b.column(0), "lang_pred": pa.array(pred, pa.string()), "score": np.clip(score, 0, 1)})

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return over_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lettered.alias("l")), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the held-out fifth is never learned from."""
    out = predict(docs, fit(docs.where(fold_crc(F.col("doc_id"), 5) != 0)))
    return out.select("doc_id", (fold_crc(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
