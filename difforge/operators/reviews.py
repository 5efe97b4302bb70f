"""Review bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .indexing import latest


def review_state(events: DataFrame) -> DataFrame:
    """Reviews from their event log (review_id, seq, status, stage, findings_count, cost_usd, error_message, at).

    The last event wins; completed_at is the time of the last event if that completed the review.
    """
    last = latest(events, ["review_id"], "seq")
    start = events.groupBy("review_id").agg(F.min("at").alias("started_at"))
    return last.join(start, "review_id").withColumn("completed_at", F.when(F.col("status") == "completed", F.col("at")))


def rollup(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Reviews with their number of findings and files, zero where there are none."""
    n = findings.groupBy("review_id").agg(F.count(F.lit(1)).alias("findings_count"), F.count_distinct("file_path").alias("files_reviewed"))
    return reviews.join(n, "review_id", "left").fillna(0, ["findings_count", "files_reviewed"])


def reviewed(hunks: DataFrame) -> DataFrame:
    """files_reviewed and hunks_reviewed of each diff."""
    return hunks.groupBy("diff_id").agg(F.count_distinct("file_ord").alias("files_reviewed"), F.count(F.lit(1)).alias("hunks_reviewed"))


def cost_by_model(calls: DataFrame, prices: dict | None = None) -> DataFrame:
    """Calls, tokens and dollars by model (model, input_tokens, output_tokens)."""
    cost = C.call_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), prices)
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(cost).alias("cost_usd"))


def latest_open(prs: DataFrame, by: str = "repo_id") -> DataFrame:
    """The open pull request that was updated last, by repository."""
    return prs.where(F.col("state") == "open").groupBy(by).agg(F.max_by("pr_number", F.struct("updated_at", "pr_number")).alias("pr_number"))


def head_sha(repos: DataFrame, branches: DataFrame) -> DataFrame:
    """The commit of each repository's default branch."""
    return repos.join(branches.select("repo_id", F.col("branch").alias("default_branch"), "sha"), ["repo_id", "default_branch"])


def children(parents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Parents with their rows, one to many."""
    return parents.join(rows, key)


def cascade_delete(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent still is."""
    return rows.join(parents.select(key), key, "left_semi")


def past_finding_rows(findings: DataFrame) -> DataFrame:
    """Findings as rows of the append-only memory; the id also hashes ``occurrence``, so repeats accumulate."""
    return findings.withColumn("finding_id", F.sha2(F.concat_ws(":", "review_id", "ord", "occurrence"), 256))
