"""Incremental index maintenance over plain tables: append logs, latest-wins views, anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import routing


def latest(log: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key of an append log. Aggregates before the shuffle, so a hot key's rows don't travel."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"))
    return best.select(*keys, "_v.*").select(*log.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` put in by key; of equal keys among ``rows`` the one with the largest values stays."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    rest = [c for c in table.columns if c not in keys and not c.startswith("_")]
    return latest(both, keys, "_new", *rest).drop("_new")


def points(chunks: DataFrame) -> DataFrame:
    """Chunks that aren't blank, with the point id they are stored under."""
    return chunks.where(~routing.blank(F.col("content"))).withColumn("point_id", C.point_id(F.col("chunk_id")))


def upsert_stats(chunks: DataFrame, cached: DataFrame, price: float = 0.02) -> DataFrame:
    """chunks_upserted, cache_hits, cache_misses, tokens_used, cost_usd; tokens are counted once for each distinct missing text."""
    valid = chunks.where(~routing.blank(F.col("content"))).select(C.short_hash(F.col("content")).alias("key"), C.tokens(F.col("content")).alias("tok"))
    by_key = valid.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("tok").alias("tok")).join(cached.select("key", F.lit(True).alias("hit")).distinct(), "key", "left")
    hit = F.col("hit").isNotNull()
    used = F.coalesce(F.sum(F.when(~hit, F.col("tok"))), F.lit(0))
    return by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks_upserted"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("cache_hits"), F.coalesce(F.sum(F.when(~hit, F.col("n"))), F.lit(0)).alias("cache_misses"), used.alias("tokens_used"), (used * price / 1e6).alias("cost_usd"))


def delete_where(table: DataFrame, keys: DataFrame) -> DataFrame:
    """``table`` without the rows that match ``keys`` on all its columns: (repo_id) or (repo_id, file_path)."""
    return table.join(keys.distinct(), keys.columns, "left_anti")


def indexed_ids(table: DataFrame, repo_id: int, file_path: str, sha: str) -> DataFrame:
    return table.where((F.col("repo_id") == repo_id) & (F.col("file_path") == file_path) & (F.col("commit_sha") == sha)).select("chunk_id").distinct()


def new_chunks(chunks: DataFrame, table: DataFrame, keys: list[str] = ("repo_id", "file_path", "chunk_id", "commit_sha")) -> DataFrame:
    """Chunks that aren't in the table at this commit."""
    return chunks.join(table.select(*keys).distinct(), list(keys), "left_anti")


def apply_change(table: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The table after a change: removed files and old names of renamed ones go, changed files' chunks are replaced.

    files: repo_id, filename, old_filename, status; chunks: the new chunks of changed files, in the table's columns.
    """
    gone = files.where(F.col("status") == "removed").select("repo_id", F.col("filename").alias("file_path"))
    moved = files.where("old_filename IS NOT NULL").select("repo_id", F.col("old_filename").alias("file_path"))
    replaced = chunks.select("repo_id", "file_path")
    kept = delete_where(table, gone.union(moved).union(replaced))
    return upsert(kept, chunks, ["repo_id", "chunk_id"])


def progress(log: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Indexing progress by repository: total, done, chunks_total, status, percent; ``not_indexed`` where nothing is known.

    log: repo_id, batch_no, total, files, chunks, status.
    """
    got = log.groupBy("repo_id").agg(F.max("total").alias("total"), F.sum("files").alias("done"), F.sum("chunks").alias("chunks_total"), F.max_by("status", "batch_no").alias("status"))
    if repos is not None:
        got = repos.select("repo_id").join(got, "repo_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    got = got.select("repo_id", zero("total"), zero("done"), zero("chunks_total"), F.coalesce("status", F.lit("not_indexed")).alias("status"))
    return got.withColumn("percent", percent(F.col("done"), F.col("total")))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done / total * 100, 1)).otherwise(0.0)


def running_totals(log: DataFrame) -> DataFrame:
    """Chunks and files so far after each batch of a repository."""
    w = Window.partitionBy("repo_id").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumns({"files_so_far": F.sum("files").over(w), "chunks_so_far": F.sum("chunks").over(w)})


def batches(df: DataFrame, size: int, keys: list[str], order: str) -> DataFrame:
    """Adds batch_no: consecutive rows of each key in groups of ``size``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def rate_limited(calls: DataFrame, key: str, ts: str, limit: int = 30, seconds: int = 60) -> DataFrame:
    """Adds in_window, the calls of the key in the last ``seconds`` up to this one, and whether that is over ``limit``."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return calls.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("over_limit", F.col("in_window") > limit)


def numbered(df: DataFrame, key: str, at: Column, row_id: str, span: int, out: str) -> DataFrame:
    """Adds ``out``: gapless numbers from 0 in each key by (``at``, ``row_id``), without a whole key in one task.

    Rows are numbered inside cells of ``span`` of ``at``; how many a key's earlier cells hold is added. Adds ``_cell`` too.
    """
    rows = df.withColumn("_cell", F.floor(at / span))
    held = rows.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_cell").orderBy(at, row_id)) - 1
    return rows.withColumn("_inside", inside).join(held, [key, "_cell"]).withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def admitted(calls: DataFrame, key: str, ts: str, row_id: str, limit: int = 30, seconds: int = 60) -> DataFrame:
    """Adds admitted_at: when each call of a key goes out if never more than ``limit`` do within ``seconds``, in order of (``ts``, ``row_id``).

    A call waits for its own time and until ``seconds`` after the one ``limit`` places before it went out: a(i) = max(t(i), a(i - limit) + w).
    Along places of equal remainder by ``limit`` that is a running maximum of t(i) - w * (i div limit), so the schedule needs
    no state and no loop: a hot key is split by remainder and by time cell, with the maxima of earlier cells added.
    """
    at, wait = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000
    span = 64 * wait
    rows = numbered(calls, key, at, row_id, span, "_i").withColumn("_lane", F.col("_i") % limit)
    slack = at - F.floor(F.col("_i") / limit) * wait
    tops = rows.groupBy(key, "_lane", "_cell").agg(F.max(slack).alias("_top"))
    earlier = Window.partitionBy(key, "_lane").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_carried", F.max("_top").over(earlier)).drop("_top")
    inside = Window.partitionBy(key, "_lane", "_cell").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_most", F.max(slack).over(inside)).join(tops, [key, "_lane", "_cell"])
    out = F.timestamp_micros(F.greatest("_most", "_carried") + F.floor(F.col("_i") / limit) * wait)
    return rows.withColumn("admitted_at", out).drop("_i", "_lane", "_cell", "_most", "_carried")


def soft_delete(table: DataFrame, keys: DataFrame, key: str, **values) -> DataFrame:
    """Sets columns of the rows that ``keys`` names; unknown keys change nothing."""
    hit = keys.select(key, F.lit(True).alias("_hit")).distinct()
    rows = table.join(hit, key, "left")
    for c, v in values.items():
        rows = rows.withColumn(c, F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c)))
    return rows.select(*table.columns)


def table_rows(table: DataFrame, cond: Column, limit: int = 100) -> DataFrame:
    """A filtered scan of at most ``limit`` rows."""
    return table.where(cond).limit(limit)


def installed(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Installations and their repositories after their events: installation_id, repo_id, repo_full_name, active.

    events: seq, installation_id, route (installation_created, installation_deleted, repos_added, repos_removed), repos
    (array of (id, full_name)). Creation and addition put repositories in, or back; removal and the end of an installation make
    them inactive. ``known`` is the table before the events.
    """
    add = F.col("route").isin("installation_created", "repos_added")
    named = events.where(add | (F.col("route") == "repos_removed")).select("seq", "installation_id", F.inline("repos"), add.alias("active"))
    named = named.select("seq", "installation_id", F.col("id").alias("repo_id"), F.col("full_name").alias("repo_full_name"), "active")
    if known is not None:
        named = named.unionByName(known.select(F.lit(-1).cast("long").alias("seq"), "installation_id", "repo_id", "repo_full_name", "active"))
    name = F.max_by("repo_full_name", F.struct(F.col("repo_full_name").isNotNull(), "seq"))
    rows = named.groupBy("installation_id", "repo_id").agg(F.max("seq").alias("seq"), F.max_by("active", F.struct("seq", "active")).alias("active"), name.alias("repo_full_name"))
    gone = events.where("route = 'installation_deleted'").groupBy("installation_id").agg(F.max("seq").alias("gone"))
    rows = rows.join(gone, "installation_id", "left")
    return rows.select("installation_id", "repo_id", "repo_full_name", (F.col("active") & (F.col("gone").isNull() | (F.col("gone") < F.col("seq")))).alias("active"))
