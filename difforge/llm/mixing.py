"""Mixing sources to target weights by entropy balancing.

Targets are token shares by source. Among all document rates in [0, MOST], those nearest to 1 in relative entropy
that meet every source's token target are rate = min(MOST, exp(lambda_source * x)), x being the document's size over
its source's mean. The multipliers minimise the convex dual; each Newton step takes its gradient and curvature
from one distributed pass over the histogram of (source, size). Rates become whole copies by error diffusion, within about one of the rate, largest
documents first, in chunks of about CHUNK rows that a hash of id and size fixes. Rows alike in source, id and size are counted first and
cut into pieces of CHUNK, so neither a large source nor one id, or none, that most rows have makes a large chunk. Sums are of
decimals, which no order of rows changes, so reruns agree.

Cases: null text has size 0; a null source is a source, the last; documents of size 0 have rate 1; repeated rows
are rows of their own; an empty table gives an empty result. More than MOST_SOURCES sources are refused, as their
multipliers go through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, word_count

MOST = 3
CHUNK = 512
MOST_SOURCES = 65536
STEPS = 80


def token_targets(sizes: dict, weights: list[int] = (1, 2, 3), most: float = MOST) -> dict:
    """Targets that share all tokens by weight, none above ``most`` times its source's size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = float(sum(sizes.values())), {}, list(names)
    while open_:
        left = total - sum(target.values())
        all_w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / all_w > most * sizes[s]]
        for s in over:
            target[s] = float(most * sizes[s])
        if not over:
            target |= {s: left * weight[s] / all_w for s in open_}
            break
        open_ = [s for s in open_ if s not in target]
    return target


def _rate(lam, x):
    return F.least(F.lit(float(MOST)), F.exp(F.least(lam * x, F.lit(50.0))))


def _whole_copies(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
    copies, behind = np.zeros(len(rows), np.int64), 0.0
    for i, (size, rate) in enumerate(zip(rows["size"].to_numpy(), rows["rate"].to_numpy(), strict=True)):
        low = math.floor(rate)
        if size <= 0:
            copies[i] = round(rate)
            continue
        behind += rate * size
        copies[i] = min(low + 2, MOST, max(low - 1, 0, round(behind / size)))
        behind -= copies[i] * size
    rows["copies"] = copies
    return rows[["doc_id", "source", "size", "source_size", "target", "rate", "copies"]]


def _chunk_copies(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows with how many times each occurs, as rows with their copies."""
    return _whole_copies(rows.loc[rows.index.repeat(rows["times"])].reset_index(drop=True))


def balance(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for each row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    base = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    hist = scratch.keep(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("rows")))
    found = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("s"), F.sum("rows").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    size, count = {r.source: r.s for r in found}, {r.source: r.n for r in found}
    target = token_targets(size, weights)
    full = {s: target[s] >= MOST * size[s] * (1 - 1e-12) for s in size}
    lam = {s: 1e9 if full[s] else math.log(target[s] / size[s]) for s in size}
    low, high = dict.fromkeys(size, -1e5), dict.fromkeys(size, 1e5)
    open_ = {s for s in size if not full[s]}

    def table(sources):
        rows = [(s, lam[s], float(size[s]) / max(1, count[s]), int(size[s]), float(target[s]), -(-count[s] // CHUNK)) for s in sources]
        out = spark.createDataFrame(rows, "source string, lam double, mean double, source_size long, target double, chunks long")
        # Bounded: at most MOST_SOURCES rows.
        return F.broadcast(out.withColumnRenamed("source", "_source"))

    def with_rate(df, sources):
        df = df.join(table(sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        x = F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9))
        return df.withColumn("x", x).withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(_rate(F.col("lam"), x)))

    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    for _ in range(STEPS):
        if not open_:
            break
        mass = F.col("size") * F.col("rows") * F.col("rate")
        slope = F.when(F.col("rate") < MOST, mass * F.col("x")).otherwise(0.0)
        for r in with_rate(hist, open_).groupBy("source").agg(exact(mass).alias("f"), exact(slope).alias("h")).collect():
            s, miss = r.source, r.f - target[r.source]
            if abs(miss) <= 1e-7 * target[s]:
                open_.discard(s)
                continue
            (high if miss > 0 else low)[s] = lam[s]
            step = lam[s] - miss / r.h if r.h > 0 else math.inf
            lam[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    lam = {s: round(v, 9) for s, v in lam.items()}
    alike = base.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("all"))
    alike = alike.select("source", "doc_id", "size", "all", F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / CHUNK))).alias("piece"))
    alike = alike.withColumn("times", F.least(F.lit(CHUNK), F.col("all") - F.col("piece") * CHUNK))
    rated = with_rate(alike, list(size)).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", "piece"), F.col("chunks")))
    rated = rated.select("source", "chunk", "doc_id", "size", "source_size", "target", "rate", "times")
    out = rated.groupBy("source", "chunk").applyInPandas(_chunk_copies, "doc_id long, source string, size long, source_size long, target double, rate double, copies long")
    return out.withColumn("taken", F.col("copies") * F.col("size"))
