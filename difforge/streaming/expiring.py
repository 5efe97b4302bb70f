"""A key-value cache with expiry as streaming state: puts and gets of a stream, answered in event-time order.

Operations wait in a key's state until the watermark has passed them, then take effect by (time, id), so the answers don't depend on how
the stream was cut into batches, nor on restarts. A value that has expired is dropped by a timer of its own; an
operation that comes later than the watermark allows is lost, as for any operator with a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPS = "op_id long, at timestamp, kind string, key string, value string, seconds long"
ANSWERS = "op_id long, key string, value string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Cache(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "value string, until long")
        self.timer = handle.getValueState("timer", "ms long")
        self.waiting = handle.getListState("waiting", "op_id long, micros long, kind string, value string, seconds long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            micros = df["micros"].astype("int64")
            self.waiting.appendList(list(zip(df["op_id"].astype("int64"), micros, df["kind"], df["value"], df["seconds"].astype("int64"), strict=True)))
            self._wake(int(micros.min()) // 1000 + 1)
        return iter(())

    def _wake(self, ms: int) -> None:
        """Have a timer at ``ms`` unless an earlier one is set: one for each stretch of waiting operations, not one for each operation."""
        if not self.timer.exists() or ms < self.timer.get()[0]:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that waits up to the watermark takes effect at once; the next timer is that of the first operation, or of the value's end, after it."""
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((x for x in held if x[1] < passed), key=lambda x: (x[1], x[0]))
        value, until = self.now.get() if self.now.exists() else (None, -1)
        answers = []
        for op_id, micros, kind, new, seconds in due:
            if kind == "put":
                value, until = new, micros + seconds * 1_000_000
            else:
                answers.append((op_id, key[0], value if until > micros else None))
        rest = [tuple(x) for x in held if x[1] >= passed]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if until < passed:
            self.now.clear()
        elif due:
            self.now.update((value, until))
        ahead = [x[1] for x in rest] + ([until] if until >= passed else [])
        if ahead:
            self._wake(min(ahead) // 1000 + 1)
        if answers:
            yield pd.DataFrame(answers, columns=["op_id", "key", "value"])

    def close(self) -> None:
        pass


def cache_stream(ops: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Answers (op_id, key, value or null) to the gets of a stream of operations (OPS) that come at most ``delay`` late."""
    ops.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = ops.withWatermark("at", delay).select("op_id", "at", F.unix_micros("at").alias("micros"), "kind", "key", "value", F.coalesce("seconds", F.lit(0)).alias("seconds"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Cache(), outputStructType=ANSWERS, outputMode="Append", timeMode="EventTime")


def cache_answers(ops: DataFrame) -> DataFrame:
    """The same answers over a table of operations; a put takes effect before a get of the same time if its id is smaller."""
    order = Window.partitionBy("key").orderBy("at", "op_id").rowsBetween(Window.unboundedPreceding, 0)
    put = F.when(F.col("kind") == "put", F.struct("value", (F.col("at") + F.make_interval(secs=F.col("seconds"))).alias("until")))
    rows = ops.withColumn("_last", F.last(put, ignorenulls=True).over(order)).where(F.col("kind") == "get")
    alive: Column = F.col("_last.until") > F.col("at")
    return rows.select("op_id", "key", F.when(alive, F.col("_last.value")).alias("value"))
