"""Exact dedup by content sort.

Sampled splitters deal the normalised texts out by range, an external sort brings equals next to each
other, and comparing neighbours in full marks the runs of equal texts. Splitters and sort order are
(leading bytes, hash, whole text, id): the bounded leading key keeps the sample that the driver sees small
however long the texts are, and the id as last key lets a run of thousands of copies span partitions, so that
no task gets a whole group. Only a partition's first and last run can go on elsewhere; these, two for each
partition, are merged afterwards.

Cases: null text counts as empty; empty texts are equal to each other; of rows that repeat both id and text
exactly one is kept; null ids come last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_names, over_batches, sent_if_small, split_by_ids

LEAD = 64
_OUT = "doc_id long, text_sha256 string, first_id long, run long, leads boolean, edge boolean"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_replace(spaced, " {2,}", " ")


def _mark_runs(batches):
    """Neighbours compared in full; a run's ids are held until it ends, 8 bytes each, at most a partition's."""
    held: list[pa.Array] = []
    runs: list[tuple[str, int, bool]] = []
    ids: list[pa.Array] = []
    text, first = None, True

    def end_run(edge: bool) -> None:
        runs.append((hashlib.sha256(text.encode()).hexdigest(), sum(map(len, held)), edge))
        ids.extend(held)
        held.clear()

    def rows() -> pa.RecordBatch:
        size = np.array([n for _, n, _ in runs])
        at = np.repeat(np.arange(len(runs)), size)
        start = np.cumsum(size) - size
        leads = np.zeros(len(at), bool)
        leads[start] = True
        flat = pa.concat_arrays(ids)
        out = {
            "doc_id": flat,
            "text_sha256": pa.array([sha for sha, _, _ in runs]).take(pa.array(at)),
            "first_id": flat.take(pa.array(start[at])),
            "run": pa.array(size[at]),
            "leads": pa.array(leads),
            "edge": pa.array(np.array([e for _, _, e in runs])[at]),
        }
        runs.clear()
        ids.clear()
        return pa.record_batch(out)

    for b in batches:
        if b.num_rows == 0:
            continue
        texts = b.column(1)
        change = np.ones(b.num_rows, bool)
        change[0] = text is None or texts[0].as_py() != text
        change[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        at = [0, *(int(i) for i in np.flatnonzero(change)), b.num_rows]
        for i, j in zip(at, at[1:], strict=False):
            if i == j:
                continue
            if change[i]:
                if held:
                    end_run(first)
                    first = False
                text = texts[i].as_py()
            held.append(b.column(0)[i:j])
        if runs:
            yield rows()
    if held:
        end_run(True)
        yield rows()


def exact_groups(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("t"))
    keyed = norm.select("doc_id", "t", F.substring("t", 1, LEAD).alias("lead"), F.xxhash64("t").alias("h"))
    # The whole text stays out of the splitters, which the driver samples; rows with equal splitter keys share a partition.
    dealt = keyed.repartitionByRange("lead", "h", F.asc_nulls_last("doc_id"))
    dealt = dealt.sortWithinPartitions("lead", "h", "t", F.asc_nulls_last("doc_id"))
    rows = scratch.keep(over_batches(dealt.select("doc_id", "t"), _mark_runs, _OUT))
    # At most two runs of a partition are edges.
    merged = rows.where("edge AND leads").groupBy("text_sha256").agg(F.min("first_id").alias("all_first"), F.sum("run").alias("all_rows"))
    out = rows.join(sent_if_small(scratch, merged), "text_sha256", "left")
    keep_id = F.coalesce("all_first", "first_id")
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("all_rows", "run").cast("long").alias("group_size"),
        (F.col("leads") & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of rows that repeat id and text, any one."""
    scratch = Scratch(docs.sparkSession, "exact-keep")
    groups = exact_groups(docs, scratch)
    gone = groups.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("any_kept"), F.count(F.lit(1)).alias("times"))
    i, h, k = free_names(docs, "_id", "_sha", "_kept")
    gone = gone.where("NOT any_kept OR times > 1").select(F.col("doc_id").alias(i), F.col("text_sha256").alias(h), F.col("any_kept").alias(k))
    gone = scratch.finish(gone)
    repeated = gone.where(F.col(k)).count()
    scratch.settle()
    key = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.sha2(normalised(F.col("text")), 256) == F.col(h))
    rest, some = split_by_ids(docs, gone.select(i))
    once = rest.unionByName(some.join(gone.select(i, h), key, "left_anti"))
    if not repeated:
        return once
    again = some.join(gone.where(F.col(k)).select(i, h), key, "inner")
    return once.unionByName(again.dropDuplicates([i, h]).drop(i, h))
