"""Packing into optimal length buckets.

A global histogram of lengths goes to the driver; dynamic programming over it finds the bucket boundaries with the
least padding; inside each bucket, batches hold as many rows as the token budget allows at the bucket's length.
Lengths up to EXACT have a cell of their own; above, cells are 1/128 of a power of two wide, which bounds the
histogram whatever the longest text is. A boundary is always a length that occurs, the longest of its cell.

Cases: null or empty text has length 0 and goes to the shortest bucket; a text longer than the budget is a batch of
its own; rows that repeat are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, number_rows, word_count

EXACT = 8192


def _cell(n: Column) -> Column:
    shift = F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)))) - 7, F.lit(0)).cast("int")
    return F.when(n <= EXACT, n).otherwise(shift * F.lit(1 << 20) + F.call_function("shiftright", n, shift))


def boundaries(lengths: list[int], counts: list[int], tokens: list[int], buckets: int) -> list[int]:
    """The at most ``buckets`` upper bounds that minimise padding; all lists are by ascending length.

    Bucket (i, j] pads to lengths[j]: cost lengths[j] * rows - tokens. For a fixed number of buckets the best
    split is a lower envelope of lines with falling slopes queried at rising points, so a layer takes linear time.
    """
    m = len(lengths)
    if m == 0:
        return []
    rows, toks = [0], [0]
    for c, t in zip(counts, tokens, strict=True):
        rows.append(rows[-1] + c)
        toks.append(toks[-1] + t)
    best = [lengths[j] * rows[j + 1] - toks[j + 1] for j in range(m)]
    cuts = [[0] * m]
    for _ in range(1, min(buckets, m)):
        hull: list[tuple[int, int, int]] = []
        head, layer, cut = 0, [], []
        for j in range(m):
            if j > 0:
                slope, base = -rows[j], best[j - 1] + toks[j]
                while len(hull) - head >= 2:
                    (s1, b1, _), (s2, b2, _) = hull[-2], hull[-1]
                    if (base - b1) * (s1 - s2) <= (b2 - b1) * (s1 - slope):
                        hull.pop()
                    else:
                        break
                hull.append((slope, base, j))
            x = lengths[j]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            whole = x * rows[j + 1] - toks[j + 1]
            if head < len(hull) and (split := whole + hull[head][0] * x + hull[head][1]) < best[j]:
                layer.append(split)
                cut.append(hull[head][2])
            else:
                layer.append(best[j])
                cut.append(-1)
        best = layer
        cuts.append(cut)
    out, j, k = [], m - 1, len(cuts) - 1
    while j >= 0:
        while k > 0 and cuts[k][j] == -1:
            k -= 1
        out.append(lengths[j])
        j, k = (cuts[k][j] - 1, k - 1) if k > 0 else (-1, 0)
    return out[::-1]


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 65536, length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch (within the bucket), row_in_batch, padding for each row.

    ``length`` is the number of tokens, words unless given.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    n = word_count(F.col("text")) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    base = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_tokens")))
    cells = base.groupBy(_cell(F.col("n_tokens")).alias("cell")).agg(F.max("n_tokens").alias("len"), F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"))
    hist = sorted(cells.select("len", "rows", "tokens").collect())
    bounds = boundaries([r[0] for r in hist], [r[1] for r in hist], [r[2] for r in hist], buckets) or [0]
    bucket = sum((F.when(F.col("n_tokens") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    rows = base.withColumn("bucket", bucket.cast("int"))
    rows = rows.withColumn("bucket_len", F.element_at(F.array(*(F.lit(b).cast("long") for b in bounds)), F.col("bucket") + 1))
    rows = number_rows(scratch, rows.withColumn("_mixed", F.xxhash64("doc_id")), "bucket", ["_mixed", "doc_id", "n_tokens"], "_slot")
    scratch.drop(base)
    per = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    return rows.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(F.col("_slot") / per).alias("batch"),
        F.pmod(F.col("_slot"), per).alias("row_in_batch"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
