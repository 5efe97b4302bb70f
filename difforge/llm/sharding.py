"""Sharding by vector bin packing.

Bytes, tokens and rows are balanced jointly: groups of equal texts are placed, largest first, on the shard where
the dot product of their vector with the residual capacity is highest. Law ``bytes``: shard sizes come out near
equal. Only a bounded number of items reaches the driver: groups that make up a noticeable part of a shard are
items of their own (at most 3 * shards * FINE of them, as their shares sum to 3), all smaller ones are hashed into
shards * BUNDLES bundles. A group larger than a quarter of a shard is split by a hash of the id; rows without id are split by a number that they get when they
are first written.

Cases: null text has size OVERHEAD, no tokens, and forms a group; null ids are dealt like others; repeated rows are
rows of their own; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_names, number_rows, word_count

OVERHEAD = 16
FINE = 256
BUNDLES = 1000


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; ``vectors`` has shares of the totals, one column for each resource."""
    weight = np.array([16.0, 1.0, 1.0][: vectors.shape[1]])
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), np.int32)
    for i in np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1))):
        s = int(np.argmax(residual @ (vectors[i] * weight)))
        residual[s] -= vectors[i]
        out[i] = s
    return even_out(vectors, out, shards)


def even_out(vectors: np.ndarray, out: np.ndarray, shards: int, rounds: int = 400) -> np.ndarray:
    """Swaps items of the shards with most and least bytes while that brings them closer."""
    size = vectors[:, 0]
    load = np.bincount(out, weights=size, minlength=shards)
    for _ in range(rounds):
        top, low = int(load.argmax()), int(load.argmin())
        half = (load[top] - load[low]) / 2
        mine, theirs = np.flatnonzero(out == top), np.flatnonzero(out == low)
        if half * shards < 1e-4 or len(mine) == 0 or len(theirs) == 0:
            break
        theirs = theirs[np.argsort(size[theirs], kind="stable")]
        at = np.searchsorted(size[theirs], size[mine] - half)
        i = np.concatenate([mine, mine])
        j = theirs[np.concatenate([np.clip(at, 0, len(theirs) - 1), np.clip(at - 1, 0, len(theirs) - 1)])]
        miss = np.abs(size[i] - size[j] - half) + 0.05 * np.abs(vectors[i, 1:] - vectors[j, 1:]).sum(axis=1)
        best = int(miss.argmin())
        i, j = i[best], j[best]
        if abs(size[i] - size[j] - half) >= half:
            break
        load[top] += size[j] - size[i]
        load[low] += size[i] - size[j]
        out[i], out[j] = low, top
    return out


def assign_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens for each row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col("text")
    base = scratch.keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            word_count(text).alias("tokens"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text, text.isNull()).alias("g"),
            F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("salt"),
        )
    )
    key = ["g", "text_crc32", "size"]
    total = base.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    total = [max(1, x or 0) for x in total]
    groups = base.groupBy(*key).agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r"))
    share = F.greatest(*(F.col(c) / float(n) for c, n in zip("btr", total, strict=True)))
    large = groups.withColumn("share", share).where(F.col("share") >= 1.0 / (shards * FINE))
    pieces = F.when((F.col("share") > 0.25 / shards) & (F.col("r") > 1), F.least(F.ceil(F.col("share") * shards * 8), F.col("r"))).otherwise(1)
    large = scratch.keep(large.select(*key, pieces.cast("long").alias("pieces")))
    # Bounded: see the module's text.
    rows = base.join(F.broadcast(large), key, "left")
    piece = F.pmod(F.xxhash64("doc_id", "salt"), F.col("pieces"))
    item = F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("g"), F.lit(shards * BUNDLES))).otherwise(F.xxhash64("g", piece))
    rows = rows.withColumn("item", item)
    items = rows.groupBy("item").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")).orderBy("item").toArrow()
    vectors = np.stack([items[c].to_numpy() / float(n) for c, n in zip("btr", total, strict=True)], axis=1) if items.num_rows else np.zeros((0, 3))
    at = items.select(["item"]).append_column("shard", [place(vectors, shards)])
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("shard", T.IntegerType())])
    placed = rows.join(F.broadcast(spark.createDataFrame(at, schema)), "item")
    numbered = number_rows(scratch, placed.select("doc_id", "size", "text_crc32", "tokens", "shard"), "shard", ["doc_id", "text_crc32"], "slot")
    scratch.drop(base, large)
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Write the documents as one folder for each shard, in slot order within each file; a column ``shard`` of theirs gives way.

    Rows are matched by id, size and text hash; rows that agree in all of these are told apart by their number.
    """
    docs = docs.drop("shard")
    i, z, c, n, slot = free_names(docs, "_id", "_bytes", "_crc", "_n", "_slot")
    text = F.col("text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")
    rows = docs.withColumns({i: F.col("doc_id").cast("long"), z: size, c: F.crc32(F.coalesce(text, F.lit("")).cast("binary"))})
    rows = rows.withColumn(n, F.row_number().over(Window.partitionBy(i, z, c).orderBy(F.lit(0))))
    place = assigned.select(F.col("doc_id").alias("a"), F.col("size").alias("b"), F.col("text_crc32").alias("c"), "shard", F.col("slot").alias(slot))
    place = place.withColumn("n", F.row_number().over(Window.partitionBy("a", "b", "c").orderBy(slot)))
    rows = rows.join(place, rows[i].eqNullSafe(place["a"]) & (rows[z] == place["b"]) & (rows[c] == place["c"]) & (rows[n] == place["n"]))
    rows = rows.select(*docs.columns, "shard", slot)
    rows.repartitionByRange("shard", slot).sortWithinPartitions("shard", slot).drop(slot).write.partitionBy("shard").parquet(path)
