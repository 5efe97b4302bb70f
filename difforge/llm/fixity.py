"""Merkle fixity audit of WARC replicas.

A leaf hashes one record, a node its up to FANOUT children in offset order with their lengths, so that a node stands for a
contiguous range of offsets in its file. Replicas are compared from the roots down: at each level only children of
nodes that differ are looked at, until the records that differ are found. A record's place in the tree is its slot, the
rank of its key in the file's manifest, not its offset; a lost record so spoils its own path only.

Cases: null content is an empty record body; records that share file and slot form one leaf, by counts and sums of hash parts, which
pre-aggregate; a null key has slot 0 of a file of its own; a record in one replica only is ``missing`` or ``extra``; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FANOUT = 16
PER_FILE = 1000


def warc_record(key: Column, url: Column, body: Column) -> Column:
    """The bytes of a WARC resource record."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Manifest of the WARC files of ``pages`` (page_id, url, html): page_id, file, slot, length, sha256."""
    key = F.col("page_id").cast("long")
    rec = warc_record(key, F.col("url"), F.col("html"))
    file, slot = F.coalesce(F.floor(key / per_file), F.lit(-1)), F.coalesce(F.pmod(key, F.lit(per_file)), F.lit(0))
    return pages.select(key.alias("page_id"), file.cast("long").alias("file"), slot.cast("long").alias("slot"), F.octet_length(rec).cast("long").alias("length"), F.sha2(rec, 256).alias("sha256"))


def _leaves(manifest: DataFrame, replica: int) -> DataFrame:
    part = lambda i: F.sum(F.conv(F.substring("sha256", 16 * i + 1, 16), 16, 10).cast("decimal(38,0)"))
    mark = F.sha2(F.concat_ws(":", F.count(F.lit(1)), *(part(i) for i in range(4))), 256)
    return manifest.groupBy("file", "slot").agg(mark.alias("hash"), F.sum("length").alias("bytes")).withColumn("replica", F.lit(replica))


def _differ(nodes: DataFrame) -> DataFrame:
    of = lambda r: F.max(F.when(F.col("replica") == r, F.col("hash")))
    pairs = nodes.groupBy("file", "slot").agg(of(0).alias("a"), of(1).alias("b"))
    return pairs.where(~F.col("a").eqNullSafe(F.col("b")))


def tree(left: DataFrame, right: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The levels of both replicas' trees, leaves first: file, slot, hash, bytes, replica."""
    level = scratch.keep(_leaves(left, 0).unionByName(_leaves(right, 1)))
    levels, most = [level], level.agg(F.max("slot")).first()[0] or 0
    while most > 0:
        child = F.array_sort(F.collect_list(F.struct("slot", "hash", "bytes")))
        text = F.array_join(F.transform(child, lambda c: F.concat_ws(",", c["slot"], c["hash"], c["bytes"])), ";")
        up = level.groupBy("replica", "file", F.floor(F.col("slot") / FANOUT).cast("long").alias("slot"))
        level = scratch.keep(up.agg(F.sha2(text, 256).alias("hash"), F.sum("bytes").alias("bytes")).select("file", "slot", "hash", "bytes", "replica"))
        levels.append(level)
        most //= FANOUT
    return levels


def damaged(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(file, slot, a, b) of the leaves that differ, found from the roots down."""
    bad = _differ(levels[-1])
    for level in levels[-2::-1]:
        bad = scratch.keep(bad.select(F.col("file").alias("_file"), F.col("slot").alias("_slot")))
        under = (F.col("file") == F.col("_file")) & (F.floor(F.col("slot") / FANOUT) == F.col("_slot"))
        bad = _differ(level.join(bad, under, "left_semi"))
    return scratch.keep(bad)


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row for each record of ``left``, and each that only ``right`` has: page_id, file, slot, start, length, sha256, status.

    ``start`` is the record's offset in its file, null for extra records.
    """
    scratch = Scratch(left.sparkSession, "fixity")
    left, right = scratch.keep(left), scratch.keep(right)
    bad = damaged(tree(left, right, scratch), scratch)
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    bad = bad.select(F.col("file").alias("_file"), F.col("slot").alias("_slot"), status.alias("status"))
    # Offsets: sums over stretches of FANOUT * FANOUT slots, then within each; no window holds more than a stretch of slots.
    stretch = F.floor(F.col("slot") / (FANOUT * FANOUT)).cast("long")
    sums = left.groupBy("file", "slot").agg(F.sum("length").alias("len")).withColumn("stretch", stretch)
    whole = sums.groupBy("file", "stretch").agg(F.sum("len").alias("len"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("file", "stretch", F.coalesce(F.sum("len").over(before("file").orderBy("stretch")), F.lit(0)).alias("base"))
    starts = sums.select("file", "slot", "stretch", F.coalesce(F.sum("len").over(before("file", "stretch").orderBy("slot")), F.lit(0)).alias("inner"))
    starts = starts.join(whole, ["file", "stretch"]).select(F.col("file").alias("_f"), F.col("slot").alias("_s"), (F.col("base") + F.col("inner")).alias("start"))
    starts = scratch.keep(starts)
    mine = left.join(starts, (F.col("file") == F.col("_f")) & (F.col("slot") == F.col("_s"))).drop("_f", "_s")
    lost = bad.where("status = 'extra'")
    extra = right.join(lost, (F.col("file") == F.col("_file")) & (F.col("slot") == F.col("_slot"))).withColumn("start", F.lit(None).cast("long"))
    mine = mine.join(bad, (F.col("file") == F.col("_file")) & (F.col("slot") == F.col("_slot")), "left")
    out = ["page_id", "file", "slot", "start", "length", "sha256", F.coalesce("status", F.lit("ok")).alias("status")]
    return mine.select(*out).union(extra.select(*out))
