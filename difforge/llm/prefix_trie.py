"""The prefix trie of rebuilt conversations, from the Cartesian tree over the LCP array of sorted conversations.

A turn becomes 24 bytes: half of a SHA-256 of role and text, and the text's length. A conversation is the string of its turns, so
texts leave the plan where they are read. Equal conversations become one row; these are dealt out by range and sorted, and the
number of turns that neighbours share is the LCP array. A trie node that branches is a maximal interval of rows between two smaller
LCP values with its depth as least value inside: boundaries with equal value and equal nearest smaller value to the left
are one node. A row with turns of its own is an interval of one. The turns between a node's depth and its parent's are the
missing depths, with the same members, and come out as rows of their own.

Nearest smaller values are found in blocks of at most BLOCK rows, by a stack in each. What stays open at a block's border looks for
the nearest block with a smaller minimum; the minima, one number a block, are all that the driver and every task see of the
other blocks. The place inside that block is one of its prefix or suffix minima, at most one for each depth.

Members, leaves and saved bytes of an interval are differences of running sums: of a subtree, what its members hold
below a depth, less what its nodes hold once. The smallest member is a range minimum over a block's rows or over block minima.

Cases: null role or text is empty; null turns come first; turns of equal number are ordered by the hash of role and text; rows
without conv_id belong to no conversation; repeated rows are turns of their own; an empty table has no nodes, not even a root;
other columns are ignored. Limits: a conversation's turns, 24 bytes each, are one row; those alike in
their first LEAD turns, equal ones counted once, are sorted in one task, as a stream; ids of equal conversations are hashed in order, 256 at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, over_batches, sent_if_small

TURN = 24
LEAD = 32
#: Rows in a block: what a task holds at once, and one row of numbers for the driver.
BLOCK = 1 << 16
NODE, PIECE, ENTRY, STATS, TAIL = range(5)
#: Where a boundary stands: at a block's start, or among the minima of its prefixes or suffixes.
BORDER, PREFIX, SUFFIX = range(3)
#: What a piece of a node is: inside a block and open to one side or both, a border, or the first or last row of a block alone.
LEFT, RIGHT, BOTH, EDGE, FIRST, LAST = range(6)
FAR = 1 << 60
#: More than any depth.
DEEP = 1 << 31
NOBODY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ref_blk long, ref_side int, ref_value long"
_ALL = f"kind int, blk long, side int, value long, upto long, nums array<long>, cum array<long>, sha string, seq binary, {_NODE}"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class Minima:
    """Range minima and nearest smaller values of a fixed array, for many questions at once."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values, np.int64)]
        while 2 * (step := 1 << (len(self.levels) - 1)) <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of [lo, hi); FAR where that is empty."""
        out = np.full(len(lo), FAR, np.int64)
        size = hi - lo
        for k, level in enumerate(self.levels):
            at = (size >= 1 << k) & (size < 2 << k)
            out[at] = np.minimum(level[lo[at]], level[hi[at] - (1 << k)])
        return out

    def smaller_left(self, start: np.ndarray, than: np.ndarray) -> np.ndarray:
        """The last place up to ``start`` with a value less than ``than``; one has to exist."""
        at = start.copy()
        for k in reversed(range(len(self.levels))):
            from_ = at - (1 << k) + 1
            at = np.where((from_ >= 0) & (self.levels[k][np.maximum(from_, 0)] >= than), at - (1 << k), at)
        return at

    def smaller_right(self, start: np.ndarray, than: np.ndarray) -> np.ndarray:
        at, n = start.copy(), len(self.levels[0])
        for k in reversed(range(len(self.levels))):
            fits = at + (1 << k) <= n
            level = self.levels[k]
            at = np.where(fits & (level[np.minimum(at, len(level) - 1)] >= than), at + (1 << k), at)
        return at


def common_turns(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b)) // TURN
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[: mid * TURN] == b[: mid * TURN] else (lo, mid - 1)
    return lo


def _nearest_smaller(lcp: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For boundaries 1 to n-1 the nearest smaller ones on both sides; 0 and n where there is none."""
    n = len(lcp)
    left, right, stack = np.zeros(n, np.int64), np.full(n, n, np.int64), []
    for j in range(1, n):
        while stack and lcp[stack[-1]] > lcp[j]:
            right[stack.pop()] = j
        left[j] = left[stack[-1]] if stack and lcp[stack[-1]] == lcp[j] else (stack[-1] if stack else 0)
        stack.append(j)
    return left, right


def expand(depth, above, n, conv, children, leaves, total, distinct, sha, ends, cum, at, parent, ref):
    """Rows of all depths from ``above`` + 1 to ``depth`` of each interval, as a node batch.

    ``total``: bytes of all members' turns; ``distinct``: bytes of the interval's nodes, from the first row's first turn on;
    ``cum``, ``at``: running bytes of the first row, from ``at``; ``parent`` is -1 where ``ref`` names it or there is none.
    """
    times = depth - above
    x = np.repeat(np.arange(len(depth)), times)
    d = np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times) + above[x] + 1
    top, bottom = d == above[x] + 1, d == depth[x]
    before = cum[at[x] + np.maximum(d - 1, 0)]
    saved = (total[x] - n[x] * before) - (distinct[x] - before)
    none = ~top | (ref[2][x] < 0)
    digest = np.where(bottom & ends[x], np.asarray(sha, object)[x], NOBODY)
    return {
        "conv_id": conv[x],
        "depth": d,
        "parent_conv_id": pa.array(np.where(top, parent[x], conv[x]), mask=top & (parent[x] == -FAR)),
        "n_convs": n[x],
        "n_children": np.where(bottom, children[x], 1),
        "n_leaves": leaves[x],
        "saved_tokens": saved,
        "ends_sha256": pa.array(digest, pa.string()),
        "ref_blk": pa.array(ref[0][x], mask=none),
        "ref_side": pa.array(ref[1][x].astype(np.int32), mask=none),
        "ref_value": pa.array(ref[2][x], mask=none),
    }


def _batch(rows: int, schema: pa.Schema, **columns) -> pa.RecordBatch:
    made = {c: x if isinstance(x, pa.Array) else pa.array(x, schema.field(c).type) for c, x in columns.items()}
    return pa.record_batch([made[f.name] if f.name in made else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _arrow_schema(fields: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])


def _solve(blk: int, seqs: list[bytes], members: list[int], convs: list[int], shas: list[str], previous: bytes | None) -> Iterator[pa.RecordBatch]:
    """Everything that one block can say: finished nodes, open pieces, its prefix and suffix minima, its sums."""
    schema, n = _arrow_schema(_ALL), len(seqs)
    size = np.array([len(s) // TURN for s in seqs], np.int64)
    at = np.concatenate([[0], np.cumsum(size + 1)])
    cum = np.zeros(at[-1], np.int64)
    for i, s in enumerate(seqs):
        np.cumsum(np.frombuffer(s, ">u8").reshape(-1, 3)[:, 2].astype(np.int64), out=cum[at[i] + 1 : at[i + 1]])
    common = [-1, *(common_turns(seqs[i - 1], seqs[i]) for i in range(1, n))]
    lcp, m, conv = np.array(common, np.int64), np.array(members, np.int64), np.array(convs, np.int64)
    whole = cum[at[1:] - 1]
    run = lambda x: np.concatenate([[0], np.cumsum(x)])
    M, T = run(m), run(m * whole)
    U = run(np.append(0, (whole - cum[at[:-1] + np.maximum(lcp, 0)])[1:]))  # the first row's part waits for the border
    L = run(np.append(lcp[1:] != size[:-1], False))  # the last row's too
    rmq = Minima(conv)
    left, right = _nearest_smaller(common)

    j = np.arange(1, n)
    key, rep, of, k = np.unique(left[1:] * DEEP + lcp[1:], return_index=True, return_inverse=True, return_counts=True)
    lo, hi, value = left[1:][rep], right[1:][rep], lcp[1:][rep]
    lo_open, hi_open = lo == 0, hi == n
    closed = ~lo_open & ~hi_open
    least = rmq.least(lo, hi)
    node_of = np.append(-1, of)  # of a boundary

    # Finished nodes: closed intervals, and rows alone that no border touches.
    i = np.arange(1, n - 1) if n > 2 else np.zeros(0, np.int64)
    i = i[size[i] > np.maximum(lcp[i], lcp[i + 1])]
    l_ = np.concatenate([lo[closed], i])
    r_ = np.concatenate([hi[closed], i + 1])
    depth = np.concatenate([value[closed], size[i]])
    if len(l_):
        q = np.where(lcp[l_] >= lcp[r_], l_, r_)
        up = node_of[q]
        known = closed[up]
        side = np.where(lo_open[up], PREFIX, SUFFIX)
        ref = (np.full(len(up), blk), side, np.where(known, -1, lcp[q]))
        kids = np.concatenate([k[closed], np.zeros(len(i), np.int64)]) + 1 - (size[l_] == depth)
        rows = expand(
            depth, lcp[q], M[r_] - M[l_], np.concatenate([least[closed], conv[i]]), kids, L[r_] - L[l_], T[r_] - T[l_], U[r_] - U[l_ + 1] + whole[l_],
            [shas[x] for x in l_], size[l_] == depth, cum, at[l_], np.where(known, least[up], -FAR), ref,
        )
        yield _batch(len(rows["depth"]), schema, kind=np.full(len(rows["depth"]), NODE, np.int32), **rows)

    pieces = [(EDGE, -1, 1), (FIRST, int(size[0]), 0), *([(LAST, int(size[-1]), 0)] if n > 1 else [])]
    for x in np.flatnonzero(~closed):
        pieces.append((BOTH if lo_open[x] and hi_open[x] else LEFT if lo_open[x] else RIGHT, int(value[x]), int(k[x])))
    yield _batch(len(pieces), schema, kind=[PIECE] * len(pieces), blk=[blk] * len(pieces), side=[p[0] for p in pieces], value=[p[1] for p in pieces], nums=[[p[2]] for p in pieces])

    entries = [(BORDER, -1, FAR, 0, [0, 0, 0, 0, FAR], 0)]
    for side, order in ((PREFIX, j), (SUFFIX, j[::-1])):
        nearer = FAR
        for x in order:
            if lcp[x] < nearer:
                far = rmq.least(*((np.array([a]) for a in ((0, x) if side == PREFIX else (x, n)))))
                entries.append((side, int(lcp[x]), nearer, int(x), [M[x], T[x], U[x + (side == SUFFIX)], L[x], far[0]], x))
                nearer = lcp[x]
    yield _batch(
        len(entries), schema, kind=[ENTRY] * len(entries), blk=[blk] * len(entries), side=[e[0] for e in entries], value=[e[1] for e in entries], upto=[e[2] for e in entries],
        nums=[[e[3], *map(int, e[4])] for e in entries], cum=[cum[at[e[5]] : at[e[5] + 1]] for e in entries], sha=[shas[e[5]] for e in entries],
    )

    stats = [n, int(M[n]), int(T[n]), int(U[n]), int(L[n]), int(lcp[1:].min()) if n > 1 else FAR, int(conv.min()), int(size[-1]), -2 if previous is None else common_turns(previous, seqs[0])]
    yield _batch(1, schema, kind=[STATS], blk=[blk], nums=[stats], cum=[cum[: at[1]]], seq=[seqs[0] if previous is None else b""])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (seq, bucket, ids): chunks of equal conversations become one row, and BLOCK of these a block."""
    part = TaskContext.get().partitionId()
    seqs: list[bytes] = []
    members: list[int] = []
    convs: list[int] = []
    hashes: list = []
    made, previous = 0, None

    def block():
        nonlocal made, previous
        yield from _solve((part << 32) + made, seqs, members, convs, [h.hexdigest() for h in hashes], previous)
        made, previous = made + 1, seqs[-1]
        for x in (seqs, members, convs, hashes):
            x.clear()

    for b in batches:
        for seq, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            joined = ",".join(map(str, ids)).encode()
            if seqs and seq == seqs[-1]:
                members[-1] += len(ids)
                convs[-1] = min(convs[-1], ids[0])
                hashes[-1].update(b"," + joined)
                continue
            if len(seqs) >= BLOCK:
                yield from block()
            seqs.append(seq)
            members.append(len(ids))
            convs.append(ids[0])
            hashes.append(hashlib.sha256(joined))
    if seqs:
        yield from block()
        yield _batch(1, _arrow_schema(_ALL), kind=[TAIL], blk=[(part << 32) + made - 1], seq=[previous])


class Borders:
    """What every task knows of the other blocks: values at borders, minima inside, sums before, smallest members."""

    def __init__(self, stats: list, tails: dict[int, bytes]):
        self.ids = np.array([s.blk for s in stats], np.int64)
        k = len(stats)
        first = np.full(k + 1, -1, np.int64)
        last = None
        for b, s in enumerate(stats):
            if b:
                first[b] = s.nums[8] if s.nums[8] >= 0 else common_turns(last, bytes(s.seq))
            last = bytes(tails[s.blk]) if s.blk in tails else last
        self.first = first
        nums = np.array([s.nums for s in stats], np.int64).reshape(k, 9)
        self.own = np.array([s.cum[-1] - s.cum[max(0, first[b])] for b, s in enumerate(stats)], np.int64)
        leaf = nums[:, 7] != first[1:]
        before = lambda x: np.concatenate([[0], np.cumsum(x)])[:-1]
        self.M, self.T, self.U, self.L = (before(x) for x in (nums[:, 1], nums[:, 2], nums[:, 3] + self.own, nums[:, 4] + leaf))
        self.total = [int(x) for x in (nums[:, 1].sum(), nums[:, 2].sum(), (nums[:, 3] + self.own).sum(), (nums[:, 4] + leaf).sum())]
        between = np.full(2 * k + 1, FAR, np.int64)
        between[0::2], between[1::2] = first, nums[:, 5]
        self.minima, self.least = Minima(between), Minima(nums[:, 6])


_FOUND = "blk long, side int, value long, k long, l_blk long, l_side int, r_blk long, r_side int"


def _find(borders):
    """The blocks, and the kind of place in them, where each piece's node begins and ends."""

    def run(batches):
        schema = _arrow_schema(_FOUND)
        for b in batches:
            if b.num_rows == 0:
                continue
            x = borders.value
            blk, side, value, k = (b.column(i).to_numpy() for i in range(4))
            at = np.searchsorted(x.ids, blk)
            value = np.where(side == EDGE, x.first[at], value)
            keep = value >= 0
            blk, side, value, k, at = (a[keep] for a in (blk, side, value, k, at))
            lo = x.minima.smaller_left(2 * at + np.select([np.isin(side, (LEFT, BOTH, FIRST)), side == EDGE], [0, -1], 1), value)
            hi = x.minima.smaller_right(2 * at + np.where(np.isin(side, (RIGHT, BOTH, LAST)), 2, 1), value)
            # The border after the last block is its own block, one past the last.
            ids = np.append(x.ids, FAR)
            yield _batch(
                len(blk), schema, blk=blk, side=side.astype(np.int32), value=value, k=k, l_blk=ids[lo // 2], l_side=np.where(lo % 2, SUFFIX, BORDER).astype(np.int32),
                r_blk=ids[hi // 2], r_side=np.where(hi % 2, PREFIX, BORDER).astype(np.int32),
            )

    return run


_OPEN = "value long, k long, l_blk long, l_side int, l_value long, l_nums array<long>, cum array<long>, sha string, r_blk long, r_side int, r_value long, r_nums array<long>"


def _finish(borders):
    """Rows of the nodes that blocks left open, once both their ends are known."""

    def run(batches):
        schema = _arrow_schema(_NODE + ", l_blk long, l_pos long, value long")
        for b in batches:
            if b.num_rows == 0:
                continue
            x = borders.value
            col = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            num = lambda name: col(name).to_numpy(zero_copy_only=False)
            value, l_blk, l_side, r_blk, r_side = (num(c) for c in ("value", "l_blk", "l_side", "r_blk", "r_side"))
            lb, rb = np.searchsorted(x.ids, l_blk), np.searchsorted(x.ids, r_blk)
            ln, rn = (np.array(col(c).to_pylist(), np.int64) for c in ("l_nums", "r_nums"))
            end = lambda sums, total: np.append(sums, total)
            sums = [end(s, t) for s, t in zip((x.M, x.T, x.U, x.L), x.total, strict=True)]
            own = np.append(x.own, 0)
            ln_sum = [sums[i][lb] + ln[:, i + 1] for i in range(4)]
            rn_sum = [sums[i][rb] + rn[:, i + 1] for i in range(4)]
            ln_sum[2] = ln_sum[2] + own[lb]
            rn_sum[2] = rn_sum[2] + np.where(r_side == PREFIX, own[rb], 0)
            l_value = np.where(l_side == BORDER, x.first[lb], num("l_value"))
            r_value = np.where(r_side == BORDER, x.first[rb], num("r_value"))
            inside = l_side == SUFFIX
            least = x.least.least(lb + inside, np.maximum(rb, lb + inside))
            least = np.minimum(least, np.where(inside, ln[:, 5], FAR))
            least = np.minimum(least, np.where(r_side == PREFIX, rn[:, 5], FAR))
            cum = col("cum")
            at = cum.offsets.to_numpy().astype(np.int64)
            flat, at = cum.values.to_numpy(), at
            size = np.diff(at) - 1
            take_left = l_value >= r_value
            above = np.where(take_left, l_value, r_value)
            ref = (np.where(take_left, l_blk, r_blk), np.where(take_left, l_side, r_side), above)
            n, ends = rn_sum[0] - ln_sum[0], size == value
            rows = expand(
                value, above, n, least, num("k") + 1 - ends, rn_sum[3] - ln_sum[3], rn_sum[1] - ln_sum[1], rn_sum[2] - ln_sum[2] + flat[at[1:] - 1],
                col("sha").to_pylist(), ends, flat, at[:-1], np.full(len(n), -FAR), ref,
            )
            x_of = np.repeat(np.arange(len(n)), value - above)
            yield _batch(len(x_of), schema, **rows, l_blk=l_blk[x_of], l_pos=ln[:, 0][x_of], value=value[x_of])

    return run


def rebuilt(conversations: DataFrame, scratch: Scratch, group: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, seq): own turns, the first of them, as many as the id's hash says, taken from the group's first conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turn = F.concat(F.substring(mark, 1, 2 * 16), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), turn.alias("id"))
    held = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("t"))
    own = scratch.keep(held.select("conv_id", F.unhex(F.array_join("t.id", "")).alias("seq")))
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.substring("seq", 1, TURN * (most - 1)).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int") * TURN
    return own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left").select(
        "conv_id", F.concat(F.substring(F.coalesce("head", F.lit(b"")), F.lit(1), h), F.substring("seq", h + 1, F.lit(1 << 30))).alias("seq")
    )


def _named(df: DataFrame, parent: Column) -> DataFrame:
    return df.select(*(parent.alias(c) if c == "parent_conv_id" else F.col(c) for c in OUT))


def trie(sequences: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each node of the trie of (conv_id, seq)."""
    spark = sequences.sparkSession
    chunks = sequences.groupBy("seq", F.floor(F.col("conv_id") / 256).alias("bucket")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = scratch.keep(chunks)
    dealt = chunks.repartitionByRange(F.substring("seq", 1, TURN * LEAD)).sortWithinPartitions("seq", "bucket").select("seq", "ids")
    found = scratch.keep(over_batches(dealt, _blocks, _ALL))
    scratch.drop(chunks)
    stats = sorted(found.where(f"kind = {STATS}").select("blk", "nums", "cum", "seq").collect(), key=lambda r: r.blk)
    tails = {r.blk: r.seq for r in found.where(f"kind = {TAIL}").select("blk", "seq").collect()}
    borders = spark.sparkContext.broadcast(Borders(stats, tails))

    pieces = found.where(f"kind = {PIECE}").select("blk", "side", "value", F.col("nums")[0].alias("k"))
    pieces = scratch.keep(over_batches(pieces, _find(borders), _FOUND))
    entry = found.where(f"kind = {ENTRY}")
    starts = entry.where(F.col("side") != PREFIX).select(F.col("blk").alias("l_blk"), F.col("side").alias("l_side"), F.col("value").alias("l_value"), F.col("upto").alias("l_upto"), F.col("nums").alias("l_nums"), "cum", "sha")
    ends = entry.where(F.col("side") != SUFFIX).select(F.col("blk").alias("r_blk"), F.col("side").alias("r_side"), F.col("value").alias("r_value"), F.col("upto").alias("r_upto"), F.col("nums").alias("r_nums"))
    past = spark.range(1).select(F.lit(FAR).alias("r_blk"), F.lit(BORDER).alias("r_side"), F.lit(-1).cast("long").alias("r_value"), F.lit(FAR).alias("r_upto"), F.array(*(F.lit(x).cast("long") for x in (0, 0, 0, 0, 0, FAR))).alias("r_nums"))
    within = lambda e: (F.col(f"{e}_side") == BORDER) | ((F.col(f"{e}_value") < F.col("value")) & (F.col("value") <= F.col(f"{e}_upto")))
    both = pieces.join(starts, ["l_blk", "l_side"]).where(within("l")).join(ends.unionByName(past), ["r_blk", "r_side"]).where(within("r"))
    both = scratch.keep(both.drop("l_upto", "r_upto"))
    place = ["l_blk", F.col("l_nums")[0].alias("l_pos"), "value"]
    rest = ["l_side", "l_value", "l_nums", "cum", "sha", "r_blk", "r_side", "r_value", "r_nums"]
    nodes = both.groupBy(*place).agg(F.sum("k").alias("k"), *(F.first(c).alias(c) for c in rest))
    nodes = nodes.select(*(f.split(" ")[0] for f in _OPEN.split(", ")))
    late = scratch.keep(over_batches(nodes, _finish(borders), _NODE + ", l_blk long, l_pos long, value long"))

    # The names under which other nodes know an open node: of its piece at a block's start, end or border.
    side = F.col("side")
    names = F.when(side == EDGE, F.array(F.lit(BORDER))).when(side == BOTH, F.array(F.lit(PREFIX), F.lit(SUFFIX))).when(side == LEFT, F.array(F.lit(PREFIX))).when(side == RIGHT, F.array(F.lit(SUFFIX)))
    named = both.select("blk", F.explode(names).alias("name"), *place)
    whose = late.where("depth = value").select("l_blk", "l_pos", "value", F.col("conv_id").alias("up"))
    named = named.join(whose, ["l_blk", "l_pos", "value"]).select(F.col("blk").alias("ref_blk"), F.col("name").alias("ref_side"), F.col("value").alias("ref_value"), "up")
    # At most two rows for each depth and block.
    named = sent_if_small(scratch, named)
    every = found.where(f"kind = {NODE}").select(*late.columns[:11]).unionByName(late.select(*late.columns[:11]))
    return _named(every.join(named, ["ref_blk", "ref_side", "ref_value"], "left"), F.coalesce("parent_conv_id", "up"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node."""
    scratch = Scratch(conversations.sparkSession, "trie")
    return trie(rebuilt(conversations, scratch), scratch)
