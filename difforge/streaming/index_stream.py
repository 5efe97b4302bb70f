"""Incremental indexing as streams into one snapshot table: what is stored at a commit isn't stored again, replays add nothing.

Two lanes, say the first indexing of a repository and the updates of its changes, are two streams with names of their own. A batch's rows and
its number become visible with one snapshot, so a lane that dies anywhere goes on where the table says it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.indexing import latest, new_chunks
from ..sources.snapshots import SnapshotTable
from .streams import write_batches

#: One row for each chunk of a file; the commit tells what it was stored at.
KEYS = ["repo_id", "chunk_id"]


def index_batch(table: SnapshotTable, lane: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: chunks that aren't in ``table`` at their commit, made ready by ``prepare`` (embedded, say) and put in.

    Of chunks that repeat in a batch the one with the largest (commit_sha, file_path) stays. Only buckets that the batch touches are read.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if table.snapshot()["batches"].get(lane, -1) >= batch_id:
            return
        rows = latest(batch, KEYS, F.col("commit_sha"), F.col("file_path")).persist()
        try:
            fresh = new_chunks(rows, table.read(table.buckets_of(rows)))
            table.put(prepare(fresh), (lane, batch_id))
        finally:
            rows.unpersist()

    return run


def run_lane(chunks: DataFrame, table: SnapshotTable, lane: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, once: bool = True) -> StreamingQuery:
    return write_batches(chunks, index_batch(table, lane, prepare), f"{checkpoint}/{lane}", once)


def progress(table: SnapshotTable) -> dict[str, int]:
    """The last batch of each lane that the table holds."""
    return table.snapshot()["batches"]
