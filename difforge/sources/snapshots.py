"""Tables of keyed rows on plain Parquet that change in small steps: bucketed base files, delta logs, atomic snapshots.

A row's bucket is a hash of its key. A change is written beside what is there, as a delta of the buckets that it touches, and becomes visible
when one small file, the next snapshot, gets its name; whoever dies before that has changed nothing. Readers merge deltas
over the base only in touched buckets; ``compact`` rewrites those and leaves the files of the others alone. A snapshot also names the last batch
that each stream has put in, so a replayed batch is known by its number and adds nothing.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: How often a change is put on top of changes that others published meanwhile.
TRIES = 8


class Conflict(RuntimeError):
    """Someone else has published the next snapshot first; nothing of this change is visible."""


class SnapshotTable:
    """A table at ``path``. ``put`` and ``delete`` append deltas, ``read`` gives the current rows, ``compact`` folds deltas in."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], buckets: int = 64, by: list[str] | None = None) -> SnapshotTable:
        """A new table; rows are told apart by ``keys`` and bucketed by ``by``, some of these, or by all."""
        table = cls(spark, path)
        fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        table._publish({"n": 0, "schema": fields.json(), "keys": keys, "by": by or keys, "buckets": buckets, "base": {}, "deltas": [], "batches": {}})
        return table

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def snapshot(self) -> dict:
        """The current snapshot."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._hadoop(f"{self.path}/snapshots")) if s.getPath().getName().endswith(".json")]
        stream = self.fs.open(self._hadoop(f"{self.path}/snapshots/{max(names)}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, snapshot: dict) -> None:
        """Give the snapshot its name; exactly one writer gets it."""
        folder = f"{self.path}/snapshots"
        self.fs.mkdirs(self._hadoop(folder))
        beside, name = self._hadoop(f"{folder}/.{uuid.uuid4().hex}"), self._hadoop(f"{folder}/{snapshot['n']:012d}.json")
        out = self.fs.create(beside, False)
        out.write(bytearray(json.dumps(snapshot).encode()))
        out.close()
        # A local rename would replace a file of that name, so the name is taken first, which only one can.
        claim = self._hadoop(f"{folder}/.{snapshot['n']:012d}.claim")
        try:
            self.fs.create(claim, False).close()
        except Exception as e:
            self.fs.delete(beside, False)
            raise Conflict(f"snapshot {snapshot['n']} of {self.path} exists") from e
        if self.fs.exists(name) or not self.fs.rename(beside, name):
            raise Conflict(f"snapshot {snapshot['n']} of {self.path} exists")

    def _bucket(self, snapshot: dict) -> Column:
        return F.pmod(F.xxhash64(*snapshot["by"]), F.lit(snapshot["buckets"])).cast("int")

    def _write(self, rows: DataFrame, snapshot: dict, folder: str) -> list[int]:
        """Rows by bucket under ``folder``; the buckets that got any."""
        (rows.withColumn("bucket", self._bucket(snapshot)).repartition(F.col("bucket")).sortWithinPartitions("bucket", *snapshot["keys"]).write.partitionBy("bucket").parquet(f"{self.path}/{folder}"))
        return sorted(int(s.getPath().getName().split("=")[1]) for s in self.fs.listStatus(self._hadoop(f"{self.path}/{folder}")) if "=" in s.getPath().getName())

    def _change(self, rows: DataFrame, batch: tuple[str, int] | None) -> bool:
        snapshot = self.snapshot()
        if batch and snapshot["batches"].get(batch[0], -1) >= batch[1]:
            return False
        folder = f"delta/{uuid.uuid4().hex}"
        touched = self._write(rows, snapshot, folder)
        for left in reversed(range(TRIES)):
            if batch:
                snapshot["batches"][batch[0]] = batch[1]
            delta = [{"folder": folder, "n": snapshot["n"] + 1, "buckets": touched}] if touched else []
            try:
                self._publish(snapshot | {"n": snapshot["n"] + 1, "deltas": snapshot["deltas"] + delta})
                return True
            except Conflict:  # another writer was first; this delta goes on top of that one's
                if not left:
                    raise
            snapshot = self.snapshot()
            if batch and snapshot["batches"].get(batch[0], -1) >= batch[1]:
                return False
        return True

    def put(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Rows in, over rows of the same key; keys have to be unique among ``rows``. ``batch``: (stream, number); a number seen before changes nothing and gives False."""
        fields = T.StructType.fromJson(json.loads(self.snapshot()["schema"]))
        return self._change(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields), F.lit(False).alias("_gone")), batch)

    def delete(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Rows of these keys out."""
        snapshot = self.snapshot()
        fields = T.StructType.fromJson(json.loads(snapshot["schema"]))
        known = keys.select(*snapshot["keys"]).distinct()
        return self._change(known.select(*((F.col(f.name) if f.name in snapshot["keys"] else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields), F.lit(True).alias("_gone")), batch)

    def delete_where(self, condition: Column) -> bool:
        return self.delete(self.read().where(condition))

    def _fields(self, snapshot: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(snapshot["schema"]))

    def _load(self, folders: dict[str, list[int]], schema: T.StructType) -> DataFrame | None:
        """Those buckets of those folders that are named, with their bucket as a column."""
        parts = [
            self.spark.read.schema(T.StructType([*schema, T.StructField("bucket", T.IntegerType())])).option("basePath", f"{self.path}/{folder}").parquet(*(f"{self.path}/{folder}/bucket={b}" for b in buckets))
            for folder, buckets in sorted(folders.items())
            if buckets
        ]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _merged(self, snapshot: dict, buckets: set[int] | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """(rows of buckets without deltas, merged rows of buckets with deltas), of ``buckets`` or all."""
        schema, keys = self._fields(snapshot), snapshot["keys"]
        touched = {b for d in snapshot["deltas"] for b in d["buckets"] if buckets is None or b in buckets}
        calm: dict[str, list[int]] = {}
        busy: dict[str, list[int]] = {}
        for b, folder in snapshot["base"].items():
            if buckets is None or int(b) in buckets:
                (busy if int(b) in touched else calm).setdefault(folder, []).append(int(b))
        still, base = self._load(calm, schema), self._load(busy, schema)
        logs = [] if base is None else [base.withColumns({"_gone": F.lit(False), "_n": F.lit(-1)})]
        gone = T.StructField("_gone", T.BooleanType())
        for d in snapshot["deltas"]:
            if (some := [b for b in d["buckets"] if b in touched]) and (log := self._load({d["folder"]: some}, T.StructType([*schema, gone]))) is not None:
                logs.append(log.withColumn("_n", F.lit(d["n"])))
        if not logs:
            return still, None
        rest = [c for c in (*schema.names, "_gone") if c not in keys]
        last = reduce(DataFrame.unionByName, logs).groupBy("bucket", *keys).agg(F.max_by(F.struct(*rest), "_n").alias("_v"))
        return still, last.where("NOT _v._gone").select(*keys, *(F.col(f"_v.{c}").alias(c) for c in rest if c != "_gone"), "bucket").select(*schema.names, "bucket")

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The current rows, of some buckets if asked; others' files aren't opened."""
        snapshot = self.snapshot()
        parts = [p for p in self._merged(snapshot, buckets) if p is not None]
        schema = self._fields(snapshot)
        return (reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)).select(*schema.names)

    def buckets_of(self, keys: DataFrame) -> set[int]:
        """The buckets that hold these keys, at most as many as the table has."""
        snapshot = self.snapshot()
        return {r[0] for r in keys.select(self._bucket(snapshot).alias("b")).distinct().collect()}

    def compact(self) -> list[int]:
        """Fold deltas into the base of the buckets that they touch; these are returned."""
        snapshot = self.snapshot()
        touched = {b for d in snapshot["deltas"] for b in d["buckets"]}
        _, merged = self._merged(snapshot, touched)
        if merged is None:
            return []
        folder = f"base/{uuid.uuid4().hex}"
        held = self._write(merged.drop("bucket"), snapshot, folder)
        base = {b: f for b, f in snapshot["base"].items() if int(b) not in touched} | {str(b): folder for b in held}
        self._publish(snapshot | {"n": snapshot["n"] + 1, "base": base, "deltas": []})
        return sorted(touched)

    def vacuum(self) -> int:
        """Remove folders that the current snapshot doesn't name; not while a reader of an older one or another writer is at work."""
        snapshot = self.snapshot()
        named, removed = {*snapshot["base"].values(), *(d["folder"] for d in snapshot["deltas"])}, 0
        for kind in ("base", "delta"):
            if self.fs.exists(where := self._hadoop(f"{self.path}/{kind}")):
                for s in self.fs.listStatus(where):
                    if f"{kind}/{s.getPath().getName()}" not in named:
                        removed += self.fs.delete(s.getPath(), True)
        return removed
