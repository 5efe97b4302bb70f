"""Spelling variants by a self-join of the vocabulary's trie with active-node sets.

A pair at distance one parts at a node of the trie, its longest common prefix: there one letter is replaced or inserted, and below
only equal letters lead on in both. So the active set of a node is itself at distance zero and nodes at distance one,
which go down level by level through equal letters; where both sides end a word, the pair is emitted, once, at its parting node.

The trie is cut by prefixes of CUT letters. A cell of at most CELL words is walked whole in one task; a larger one is cut again,
so no prefix is too common. Pairs that part above a cut have equal rests below it: words go once more to the group
of their rest, where the short prefixes, at most alphabet ^ (CUT + 1), are walked the same way. Both kinds are groups of
(key, string) in one shuffle, and a task walks many groups at once, so the work is in numpy and not in Python loops over words.

Words: maximal runs of Latin letters (U+00C0 to U+00FF as they stand there), A-Z lower-cased; runs whose crc32 with their
document's id is divisible by TYPO lose one letter first. A word's form is its most frequent near word, if twice as
frequent; its root is found by pointer doubling along forms, whose counts at least double, so chains are short.

Cases: null or empty text has no words; a null id counts as an empty text in the crc; repeated rows count again; of ties
the form is the smallest in code-point order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, over_batches, sent_if_small

RUN = r"[A-Za-zÀ-ÿ]+"
TYPO = 97
CUT = 2
#: Words of a cell that one task walks whole.
CELL = 4096
#: Strings walked at once; a group is never split, so the last may go over by one group.
BLOCK = 1 << 16
_CODE = 1 << 21


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.lower(text) == text, text).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of all words of enough letters and occurrences."""
    run = lower_ascii(F.col("run"))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= least_length).select("id", run.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % TYPO == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _groups(words: DataFrame, scratch: Scratch, cell: int) -> DataFrame:
    """(key, rest, n, top): the groups that have to be walked. ``top``: pairs count only if they part above this depth."""
    out, now, depth = [], words, 0
    while True:
        rest = F.expr(f"substring(word, {depth + 1})")
        above = F.substring("word", 1, depth)
        n_rest = F.char_length("word") - depth
        short, long_ = F.substring(rest, 1, CUT), F.substring(rest, 1, CUT + 1)
        by_rest = [
            now.select(F.concat(above, F.lit(" "), F.expr(f"substring(word, {depth + CUT + 1})")).alias("key"), short.alias("part"), "n", "word", F.lit(CUT).alias("top")),
            now.where(n_rest > CUT).select(F.concat(above, F.lit(" "), F.expr(f"substring(word, {depth + CUT + 2})")).alias("key"), long_.alias("part"), "n", "word", F.lit(CUT).alias("top")),
        ]
        depth += CUT
        under = now.where(n_rest >= CUT).withColumn("cell", F.substring("word", 1, depth))
        large = scratch.keep(under.groupBy("cell").count().where(F.col("count") > cell).select("cell"))
        hot = sent_if_small(scratch, large)
        out += [*by_rest, under.join(hot, "cell", "left_anti").select(F.concat("cell", F.lit("*")).alias("key"), F.expr(f"substring(word, {depth + 1})").alias("part"), "n", "word", F.lit(1 << 30).alias("top"))]
        if large.isEmpty():
            break
        now = scratch.keep(under.join(hot, "cell", "left_semi").select("word", "n"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def walk(group: np.ndarray, codes: np.ndarray, offs: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of all pairs at distance one within a group, each once.

    Rows are sorted by group and string; ``codes`` are the code points of all strings, ``offs`` where each begins. ``top``: a pair
    counts only if the strings part above this depth, and then not between two strings longer than it.
    """
    length = np.diff(offs)
    change = np.ones(len(group), bool)
    change[1:] = group[1:] != group[:-1]
    node = np.cumsum(change) - 1
    first = np.flatnonzero(change)
    tops = top[first]
    alive = np.arange(len(group))

    class Level:
        """Nodes at one depth: the row that ends there or -1, and the edges that lead to them."""

        def __init__(self, n, rows, at, depth, keys):
            self.n, self.depth, self.keys = n, depth, keys
            self.end = np.full(n, -1, np.int64)
            done = length[rows] == depth
            self.end[at[done]] = rows[done]
            more = ~done
            self.rows, self.at = rows[more], at[more]

        def below(self):
            code = codes[offs[self.rows] + self.depth].astype(np.int64)
            key = self.at * _CODE + code
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            keys = key[new]
            return Level(len(keys), self.rows, np.cumsum(new) - 1, self.depth + 1, keys)

        def children(self, of):
            """(place in ``of``, child) of all children, where ``self`` is the level below that of ``of``."""
            lo, hi = np.searchsorted(self.keys, of * _CODE), np.searchsorted(self.keys, (of + 1) * _CODE)
            count = hi - lo
            which = np.repeat(np.arange(len(of)), count)
            return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)

        def child(self, of, code):
            key = of * _CODE + code
            at = np.minimum(np.searchsorted(self.keys, key), max(self.n - 1, 0))
            return (at, self.keys[at] == key) if self.n else (at, np.zeros(len(key), bool))

    none = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    here = Level(len(first), alive, node, 0, none)
    below = here.below()
    tops = tops.astype(np.int64)
    same_u = same_v = more_u = more_v = none
    while here.n:
        after = below.below()
        # Replaced: two children of one node, both or the lesser first; at most an alphabet of them.
        parent, code = below.keys // _CODE, below.keys % _CODE
        may = tops[parent] > here.depth
        start = np.searchsorted(parent, parent)
        before = np.where(may, np.arange(below.n) - start, 0)
        v = np.repeat(np.arange(below.n), before)
        u = np.repeat(start, before) + np.arange(len(v)) - np.repeat(np.cumsum(before) - before, before)
        # Inserted: a node and its child; what follows in the shorter one must not begin with the inserted letter, or they part deeper.
        ins_v = np.flatnonzero(may)
        ins_u = parent[ins_v]
        first_code = code[ins_v]
        for a, b, deep, fresh in ((same_u, same_v, False, None), (more_u, more_v, True, None), (ins_u, ins_v, True, first_code)):
            end_u, end_v = here.end[a], (below if deep else here).end[b]
            both = (end_u >= 0) & (end_v >= 0)
            found.append((end_u[both], end_v[both]))
        next_same = [(u, v)]
        which, cu = below.children(same_u)
        cv, ok = below.child(same_v[which], below.keys[cu] % _CODE)
        next_same.append((cu[ok], cv[ok]))
        next_more = []
        for a, b, fresh in ((more_u, more_v, None), (ins_u, ins_v, first_code)):
            which, cu = below.children(a)
            letter = below.keys[cu] % _CODE
            if fresh is not None:
                keep = letter != fresh[which]
                which, cu, letter = which[keep], cu[keep], letter[keep]
            cv, ok = after.child(b[which], letter)
            next_more.append((cu[ok], cv[ok]))
        same_u, same_v = (np.concatenate(x) for x in zip(*next_same, strict=True))
        more_u, more_v = (np.concatenate(x) for x in zip(*next_more, strict=True))
        tops = tops[parent]
        here, below = below, after
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    apart = (length[i] <= top[i]) | (length[j] <= top[j])
    return i[apart], j[apart]


def _best_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of sorted batches walked in blocks; for each word its number of near words there and the best of them."""

    def solve(t: pa.Table):
        t = t.combine_chunks()
        key, part, word = (t.column(c).combine_chunks() for c in ("key", "part", "word"))
        n, top = t.column("n").to_numpy(), t.column("top").to_numpy()
        group = key.dictionary_encode().indices.to_numpy()
        text = part.to_pylist()
        offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, text), np.int64, len(text)))])
        codes = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
        i, j = walk(group, codes, offs, top)
        if len(i) == 0:
            return None
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        rank = np.empty(t.num_rows, np.int64)
        rank[pc.sort_indices(word).to_numpy()] = np.arange(t.num_rows)
        order = np.lexsort((rank[b], -n[b], a))
        a, b = a[order], b[order]
        head = np.ones(len(a), bool)
        head[1:] = a[1:] != a[:-1]
        at = np.flatnonzero(head)
        return pa.record_batch({"word": word.take(pa.array(a[at])), "near": pa.array(np.diff(np.append(at, len(a)))), "form": word.take(pa.array(b[at])), "form_n": pa.array(n[b[at]])})

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < BLOCK:
            continue
        # Whole groups go on, the last one waits for its end.
        t = pa.Table.from_batches(held)
        key = t.column("key")
        edge = pc.equal(key, key[-1]).to_numpy()
        stop = int(np.argmax(edge))
        if stop:
            if (out := solve(t.slice(0, stop))) is not None:
                yield out
            held, rows = t.slice(stop).to_batches(), t.num_rows - stop
    if held and (out := solve(pa.Table.from_batches(held))) is not None:
        yield out


def near_words(words: DataFrame, scratch: Scratch, cell: int = CELL) -> DataFrame:
    """(word, n_near, best): for each word that has near words their number and (form_n, form) of the most frequent one."""
    groups = _groups(words, scratch, cell).repartition("key").sortWithinPartitions("key", "part")
    partial = scratch.keep(over_batches(groups, _best_near, "word string, near long, form string, form_n long"))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return partial.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, by pointer doubling."""
    now = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = scratch.keep(now.join(then, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        moved = not step.where("moved").isEmpty()
        scratch.drop(now)
        now = step.select("word", "root")
        if not moved:
            return now


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, cell: int = CELL) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``docs``."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(vocabulary(docs, least_length, least_count))
    near = near_words(words, scratch, cell)
    form_n = -F.col("best.less")
    taken = form_n >= 2 * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, form_n).alias("form_n")
    )
    rows = scratch.keep(rows)
    ends = roots(rows.where("form IS NOT NULL"), scratch)
    return rows.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
