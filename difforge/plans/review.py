"""A whole review as one plan: diffs through gate, linters and model replies to merged findings, comments and a summary.

Every table has a review_id; files of different reviews are kept apart by putting it in front of their path (``scoped``).
Replies come as tables, so the same plan runs on stored replies and behind ``models.complete``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import values as V
from ..operators import diff, findings, retrieval, routing

SEP = "\x1f"


def scoped(path: Column) -> Column:
    return F.concat_ws(SEP, F.col("review_id").cast("string"), path)


def _unscoped(df: DataFrame, path: str = "file_path") -> DataFrame:
    """review_id and the bare path again."""
    return df.withColumn("review_id", F.substring_index(path, SEP, 1)).withColumn(path, F.substring_index(path, SEP, -1))


@dataclass
class Replies:
    """Model replies by stage: summary (review_id, response), bug and style (review_id, file_path, response), and what models used."""

    summary: DataFrame
    bug: DataFrame
    style: DataFrame


@dataclass
class Review:
    gates: DataFrame
    findings: DataFrame
    comments: DataFrame
    summaries: DataFrame


def chosen_files(diffs: DataFrame, config: DataFrame, most: int = V.MAX_FILES) -> tuple[DataFrame, DataFrame]:
    """(files that are reviewed, gate of each review): reviewable, not ignored, the first ``most`` in diff order; none of a review that ends early."""
    files = diff.diff_files(diffs.withColumnRenamed("review_id", "diff_id"))
    kept = routing.review_files(files, config.withColumnRenamed("review_id", "diff_id"))
    n = files.groupBy("diff_id").agg(F.count(F.lit(1)).cast("int").alias("files"))
    m = kept.groupBy("diff_id").agg(F.count(F.lit(1)).cast("int").alias("reviewable_files"))
    rows = diffs.select(F.col("review_id").alias("diff_id")).join(n, "diff_id", "left").join(m, "diff_id", "left").na.fill(0, ["files", "reviewable_files"])
    rows = rows.join(config.select(F.col("review_id").alias("diff_id"), "enabled"), "diff_id", "left").withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    gates = routing.review_gate(rows)
    run = gates.where("gate = 'run'").select("diff_id")
    return retrieval.file_cap(kept.join(run, "diff_id", "left_semi"), most).withColumnRenamed("diff_id", "review_id"), gates.withColumnRenamed("diff_id", "review_id")


def review(diffs: DataFrame, config: DataFrame, lint: DataFrame, replies: Replies) -> Review:
    """diffs: review_id, diff_text; config: review_id, enabled, ignore_patterns, severity_threshold, style_review; lint: review_id, file_path, tool, rule, line, message, severity."""
    diffs = diffs.withColumn("review_id", F.col("review_id").cast("string"))
    config = config.withColumn("review_id", F.col("review_id").cast("string"))
    files, gates = chosen_files(diffs, config)
    lines = diff.diff_lines(diffs.withColumnRenamed("review_id", "diff_id")).withColumnRenamed("diff_id", "review_id")
    lines = lines.join(files.select("review_id", "file_ord"), ["review_id", "file_ord"], "left_semi")
    positions = diff.position_map(lines.withColumnRenamed("review_id", "diff_id")).withColumnRenamed("diff_id", "review_id").withColumn("file_path", scoped(F.col("file_path"))).drop("review_id")

    at_file = lambda df: df.withColumn("file_path", scoped(F.col("file_path")))
    found = at_file(lint).withColumn("probe_id", F.concat_ws(SEP, "file_path", "line", "tool", "rule", "message"))
    found = _unscoped(findings.from_lint(found, positions)).withColumn("local_ord", F.struct(F.col("file_path").alias("f"), F.col("line_start").alias("a"), F.col("probe_id").alias("b"))).drop("probe_id")

    def told(df: DataFrame, kind: str) -> DataFrame:
        asked = at_file(df.withColumn("review_id", F.col("review_id").cast("string"))).withColumn("prompt_id", F.col("file_path"))
        rows = _unscoped(findings.from_model(asked, positions, kind))
        return rows.withColumn("local_ord", F.struct(F.col("file_path").alias("f"), F.col("item_ord").alias("a"), F.lit("").alias("b"))).drop("prompt_id", "item_ord")

    style = replies.style.withColumn("review_id", F.col("review_id").cast("string")).join(config.where(routing.style_gate(F.col("style_review"))).select("review_id"), "review_id", "left_semi")
    all_ = findings.all_sources(lint=found, bug=told(replies.bug, "bug"), style=told(style, "style"))
    limit = config.select("review_id", "severity_threshold")
    all_ = all_.join(limit, "review_id", "left").where(C.severity_rank(F.col("severity")) <= C.threshold_rank(F.coalesce("severity_threshold", F.lit("low")))).drop("severity_threshold", "local_ord")
    final = findings.comment_markdown(findings.synthesise(all_))

    hunks = lines.where("new_lineno IS NOT NULL").groupBy("review_id", F.col("filename").alias("file_path"), "hunk_ord").agg(F.min("new_lineno").alias("hunk_start"), F.max("new_lineno").alias("hunk_end"))
    probes = at_file(final).withColumns({"probe_id": F.concat_ws(SEP, "review_id", "pos"), "body": F.col("comment")})
    requests = findings.review_comments(probes.select("probe_id", "file_path", "line_start", "line_end", "diff_position", "body"), positions, at_file(hunks).drop("review_id"))
    comments = requests.withColumn("review_id", F.substring_index("probe_id", SEP, 1)).withColumn("pos", F.substring_index("probe_id", SEP, -1).cast("int")).withColumn("path", F.substring_index("path", SEP, -1)).drop("probe_id")

    said = findings.summary_reply(replies.summary.withColumn("prompt_id", F.col("review_id").cast("string"))).select(F.col("prompt_id").alias("review_id"), F.col("summary").alias("pr_summary"))
    seen = lines.groupBy("review_id").agg(F.count_distinct("file_ord").alias("files_reviewed"), F.count_distinct("file_ord", "hunk_ord").alias("hunks_reviewed"))
    counts = findings.severity_counts(final, ["review_id"])
    rows = gates.where("gate = 'run'").select("review_id").join(said, "review_id", "left").join(counts, "review_id", "left").join(seen, "review_id", "left")
    rows = rows.na.fill(0, [*V.SEVERITIES[:4], "files_reviewed", "hunks_reviewed"]).withColumn("cost_usd", F.lit(0.0)).withColumn("stages", F.array(*map(F.lit, ["filter", "lint", "bug", "style", "synthesis"])))
    return Review(gates, final, comments, findings.summary_markdown(rows).select("review_id", "markdown"))
