"""Structured Streaming forms of the event path. Batch operators are reused; sinks are idempotent under replays."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.indexing import latest
from ..operators.routing import event_route, gatekeeper
from ..session import shared_dir
from ..sources.readers import pr_events


def folder_until_end(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints that goes when the application ends."""
    root = f"{shared_dir(spark)}/difforge-{name}-{uuid.uuid4().hex[:12]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return root


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """A stream of files; ``glob`` picks them from a mixed folder, ``per_trigger`` bounds a batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).format(fmt).load(path)


def routed(deliveries: DataFrame) -> DataFrame:
    """Deliveries with their route and, for reviews, the gatekeeper's verdict; stateless."""
    rows = gatekeeper(pr_events(deliveries))
    return rows.withColumn("route", event_route(F.col("event"), F.col("action")))


def unique_deliveries(deliveries: DataFrame, ts: str = "at", delay: str = "1 hour") -> DataFrame:
    """Deliveries without repeats that come within ``delay``; state older than that is dropped."""
    return deliveries.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["delivery_id"])


def write_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_lanes(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Processed events as files of their queue."""
    writer = stream.where("should_process").writeStream.partitionBy("queue").option("checkpointLocation", checkpoint).format("parquet")
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def log_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own, so that a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_view(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """Latest-wins view of a log that ``log_sink`` wrote."""
    return latest(spark.read.parquet(path), keys, order)


def replay(spark: SparkSession, sf_dir: str, name: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """Run ``transform`` over a table as a stream until all of it is read, and give the result as a table."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    query = write_batches(transform(file_stream(spark, sf_dir, schema, glob=f"{name}.parquet")), log_sink(out), checkpoint)
    query.awaitTermination()
    return spark.read.parquet(out)
