"""A stored inverted index: which chunks hold a token, kept in a SnapshotTable by (repository, token, chunk).

Rows are bucketed by token and sorted, so a question opens the buckets of its tokens only. Of a name's tokens the rarest in the repository
gives the candidates, and the others are looked up for these alone, by token and chunk: a frequent token's list is neither copied nor gathered. A
file's entries are replaced as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.snapshots import SnapshotTable
from .retrieval import top_k

WORD = r"\w+"
SCHEMA = "repo_id string, token string, chunk_id string, file_path string, start_line int"


def tokens(text: Column, pattern: str = WORD) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1)))


class Index:
    """The index at ``path``: entries by token, and the tokens of each file so that they can go with it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, pattern: str = WORD):
        self.pattern, self.keys = pattern, ["repo_id", "token", "chunk_id"]
        self.entries = SnapshotTable(spark, f"{path}/entries")
        if not self.entries.fs.exists(self.entries._hadoop(f"{path}/entries/snapshots")):
            self.entries = SnapshotTable.create(spark, f"{path}/entries", SCHEMA, self.keys, buckets, by=["token"])

    def _rows(self, chunks: DataFrame) -> DataFrame:
        line = F.col("start_line").cast("int").alias("start_line")
        return chunks.select(F.col("repo_id").cast("string").alias("repo_id"), F.explode(tokens(F.col("content"), self.pattern)).alias("token"), F.col("chunk_id").cast("string").alias("chunk_id"), "file_path", line).dropDuplicates(self.keys)

    def add(self, chunks: DataFrame) -> None:
        """Chunks (repo_id, chunk_id, file_path, start_line, content) of files; what the index held of these files goes."""
        rows = self._rows(chunks)
        snapshot = self.entries.snapshot()
        if not snapshot["base"] and not snapshot["deltas"]:  # nothing is stored, so nothing has to go
            self.entries._change(rows.withColumn("_gone", F.lit(False)), None)
            return
        files = chunks.select(F.col("repo_id").cast("string").alias("repo_id"), "file_path").distinct()
        old = self.entries.read().join(files, ["repo_id", "file_path"], "left_semi")
        self._replace(rows, old)

    def remove(self, files: DataFrame) -> None:
        """Entries of files (repo_id, file_path) out."""
        old = self.entries.read().join(files.select(F.col("repo_id").cast("string").alias("repo_id"), "file_path").distinct(), ["repo_id", "file_path"], "left_semi")
        self._replace(old.where("false"), old)

    def _replace(self, rows: DataFrame, old: DataFrame) -> None:
        stay = rows.select(*self.keys)
        gone = old.join(stay, self.keys, "left_anti").withColumn("_gone", F.lit(True))
        self.entries._change(rows.withColumn("_gone", F.lit(False)).unionByName(gone), None)

    def of(self, wanted: DataFrame) -> DataFrame:
        """Entries of the tokens of ``wanted`` (token); only their buckets are read."""
        return self.entries.read(self.entries.buckets_of(wanted))

    def holding(self, names: DataFrame) -> DataFrame:
        """Chunks that hold all words of a name: query_id, repo_id, chunk_id, file_path, start_line. names: query_id, repo_id, name."""
        want = names.select("query_id", F.col("repo_id").cast("string").alias("repo_id"), tokens(F.col("name"), self.pattern).alias("want")).where(F.size("want") > 0)
        pairs = want.select("query_id", "repo_id", F.size("want").alias("n"), F.explode("want").alias("token"))
        entries = self.of(pairs.select("token").distinct())
        asked = pairs.select("repo_id", "token").distinct()
        often = entries.join(asked, ["repo_id", "token"], "left_semi").groupBy("repo_id", "token").agg(F.count(F.lit(1)).alias("df"))
        ranked = pairs.join(often, ["repo_id", "token"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
        first = ranked.groupBy("query_id", "repo_id", "n").agg(F.min(F.struct("df", "token"))["token"].alias("rarest"))
        found = entries.join(first.withColumnRenamed("rarest", "token"), ["repo_id", "token"]).withColumnRenamed("token", "rarest")
        # All but the rarest: one row for each candidate and word, met by word and chunk.
        rest = found.where("n > 1").join(pairs.select("query_id", "repo_id", "token"), ["query_id", "repo_id"]).where("token <> rarest")
        held = rest.join(entries.select(*self.keys), self.keys).groupBy("query_id", "repo_id", "chunk_id").agg(F.count(F.lit(1)).alias("more"))
        both = found.join(held, ["query_id", "repo_id", "chunk_id"], "left").where(F.col("n") == 1 + F.coalesce("more", F.lit(0)))
        return both.select("query_id", "repo_id", "chunk_id", "file_path", "start_line")

    def callers(self, names: DataFrame, k: int = V.MAX_CALLERS) -> DataFrame:
        """The first ``k`` such chunks of each name by file and line, but those of files in its ``exclude``; adds rank."""
        hits = self.holding(names).join(names.select("query_id", "exclude"), "query_id")
        hits = hits.where(~F.coalesce(F.array_contains("exclude", F.col("file_path")), F.lit(False))).drop("exclude")
        return top_k(hits, ["query_id"], k, "file_path", "start_line", "chunk_id")
