"""Sinks and mutations over Parquet: append logs, rewrites, expiring keys, dispatch, and a batch sink with rejects."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_TABLE = "repo_id long, chunk_id string, file_path string, chunk_type string, name string, content string, start_line int, end_line int, language string, commit_sha string, embedding array<float>"
FINDING_TABLE = "finding_id string, repo_id long, org_id long, category string, severity string, title string, body string, language string, was_applied boolean, was_dismissed boolean, embedding array<float>"


def ensure_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, made empty if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def append(df: DataFrame, path: str, by: list[str] = ()) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def start_reviews(jobs: DataFrame, at: Column) -> DataFrame:
    """Log rows for reviews that begin: status processing, stage pipeline; the id is made from repository, number and commit."""
    key = F.sha2(F.concat_ws(":", "repo_id", "pr_number", "head_sha"), 256)
    return jobs.select(key.alias("review_id"), "repo_id", "pr_number", "pr_title", "head_sha", "base_sha", F.lit("processing").alias("status"), F.lit("pipeline").alias("stage"), F.lit(0).alias("seq"), at.alias("at"))


def replace_table(df: DataFrame, path: str) -> None:
    """Rewrite a table that ``df`` may read: write beside it, then swap. Old rows stay under ``path``.old until the new ones are in place.

    For tables that change often ``snapshots.SnapshotTable`` rewrites less and is never without a current version.
    """
    spark = df.sparkSession
    name = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = name(path).getFileSystem(spark._jsc.hadoopConfiguration())
    beside, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    df.write.parquet(beside)
    fs.delete(name(old), True)
    if not fs.rename(name(path), name(old)) or not fs.rename(name(beside), name(path)):
        raise OSError(f"can't put {beside} in place of {path}; the old table is {old}")
    fs.delete(name(old), True)


def kv_put(rows: DataFrame, path: str, seconds: int, now: Column | None = None) -> None:
    """Append (key, value) with an expiry ``seconds`` from now."""
    now = F.current_timestamp() if now is None else now
    append(rows.select("key", "value", (now + F.make_interval(secs=F.lit(seconds))).alias("expires_at")), path)


def dispatch(jobs: DataFrame, path: str) -> None:
    """Jobs as files of their queue."""
    append(jobs, path, ["queue"])


def post_rows(rows: DataFrame, post, rejects: str, batch: int = 100, at_once: int = 5, seconds: float = 60, tries: int = 1, pause: float = 0.5) -> None:
    """Post rows in batches; a batch that fails is tried row by row, and rows that fail alone are written to ``rejects``.

    ``post(list of dicts)`` raises on failure. It runs in the partitions, ``at_once`` posts of each in flight, so nothing goes through the driver.
    """
    import pandas as pd

    from ..functions.models import bounded

    def run(parts):
        for df in parts:
            some = [df.iloc[i : i + batch].to_dict("records") for i in range(0, len(df), batch)]
            done = bounded(post, some, at_once, seconds, tries, pause)
            alone = [[row] for part, (_, error, _) in zip(some, done, strict=True) if error is not None for row in part]
            left = [(str(row[0]), error) for row, (_, error, _) in zip(alone, bounded(post, alone, at_once, seconds, tries, pause), strict=True) if error is not None]
            yield pd.DataFrame(left, columns=["row", "error"])

    rows.mapInPandas(run, "row string, error string").write.mode("append").parquet(rejects)
