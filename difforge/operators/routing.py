"""Event routing and path predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import values as V


def reviewable(path: Column) -> Column:
    """Whether a changed file is reviewed at all."""
    vendor = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, V.VENDOR_DIRS)))
    return ~C.any_glob(C.basename(path), V.NO_REVIEW_GLOBS) & ~vendor


def _glob_parts() -> tuple[list[str], list[str]]:
    """(whole names, suffixes) of the globs of files that aren't reviewed; any other shape of glob is refused."""
    names = [g for g in V.NO_REVIEW_GLOBS if "*" not in g]
    ends = [g[1:] for g in V.NO_REVIEW_GLOBS if g[0] == "*" and "*" not in g[1:]]
    if len(names) + len(ends) != len(V.NO_REVIEW_GLOBS) or any(c in g for g in V.NO_REVIEW_GLOBS for c in "?["):
        raise ValueError("a glob is neither a name nor a suffix")
    return names, ends


def reviewable_name(path: Column) -> Column:
    """``reviewable`` without patterns: by names, suffixes and folders."""
    names, ends = _glob_parts()
    base = F.substring_index(path, "/", -1)
    short, long = [e[1:] for e in ends if e.count(".") == 1], [e for e in ends if e.count(".") > 1]
    out = base.isin(*names) | (F.substring_index(base, ".", -1).isin(*short) & base.contains("."))
    for e in long:
        out = out | base.endswith(e)
    around = F.concat(F.lit("/"), path, F.lit("/"))
    for d in V.VENDOR_DIRS:
        out = out | around.contains(f"/{d}/")
    return ~out


def ignored(path: Column, patterns: Column) -> Column:
    """Whether the whole path matches one of the configured globs (a column of shell patterns)."""
    quoted = lambda p: F.regexp_replace(p, r"([.^$+(){}|\\])", r"\\$1")
    as_regex = lambda p: F.concat(F.lit(r"(?s)^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted(p), r"\[!", "[^"), r"\?", "."), r"\*", ".*"), F.lit(r"\z"))
    return F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: F.rlike(path, as_regex(p)))


def indexable(path: Column, size: Column) -> Column:
    """Whether a repository file is indexed."""
    suffix = F.lower(F.regexp_extract(C.basename(path), r"^.+(\.[^.]+)$", 1))
    return (size <= V.MAX_INDEX_BYTES) & suffix.isin(*V.DIFF_LANGUAGES) & ~path.rlike("(?i)" + "|".join(V.NO_INDEX_PATTERNS))


def is_test(path: Column) -> Column:
    return path.rlike("(?i)" + V.TEST_PATH)


def security_critical(path: Column) -> Column:
    return path.rlike("(?i)" + V.SECURITY_PATH)


def granularity(path: Column, hunks: Column) -> Column:
    """FILE_LEVEL for sensitive paths and files of more than three hunks, else HUNK_LEVEL."""
    return F.when(security_critical(path) | (hunks > 3), "FILE_LEVEL").otherwise("HUNK_LEVEL")


def blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def cascade(rules: list[tuple[Column, bool, Column, str]]) -> Column:
    """The first rule (condition, should_process, reason, queue) that holds, as a struct."""
    out = None
    for cond, process, reason, queue in rules:
        row = F.struct(F.lit(process).alias("should_process"), reason.alias("reason"), F.lit(queue).alias("queue"))
        out = F.when(cond, row) if out is None else out.when(cond, row)
    return out


def gatekeeper(events: DataFrame, author: str = "author", labels: str = "labels", draft: str = "draft", files: str = "changed_files") -> DataFrame:
    """Adds should_process, reason, queue; a null file list passes the rules on files."""
    a, n = F.coalesce(F.col(author), F.lit("")), F.size(files)
    # Counted once, as a column; what the globs name whole or by suffix is looked up, only the rest is matched.
    events = events.withColumn("_good", F.size(F.filter(files, reviewable_name)))
    good = F.col("_good")
    known = F.col(files).isNotNull()
    text = F.format_string
    rules = [
        (a.isin(*V.BOT_LOGINS) | a.endswith("[bot]"), False, F.concat(F.lit("Bot PR from "), a), "skip"),
        (F.coalesce(F.array_contains(labels, V.SKIP_LABEL), F.lit(False)), False, F.lit(f"{V.SKIP_LABEL} label present"), "skip"),
        (F.coalesce(F.col(draft), F.lit(False)), False, F.lit("Draft PR — awaiting ready-for-review"), "skip"),
        (known & (good == 0), False, text("All %d files match no-review patterns", n), "skip"),
        (known & (n > V.LARGE_PR_FILES), True, text("Large PR: %d files → slow lane", n), "slow_lane"),
        (known, True, text("Reviewable PR: %d code files", good), "fast_lane"),
        (F.lit(True), True, F.lit("No file list — defaulting to fast_lane"), "fast_lane"),
    ]
    return events.withColumn("_r", cascade(rules)).select("*", "_r.*").drop("_r", "_good")


def event_route(event: Column, action: Column) -> Column:
    """What a delivery starts: a handler's name, or ``noop``."""
    return (
        F.when((event == "installation") & (action == "created"), "installation_created")
        .when((event == "installation") & (action == "deleted"), "installation_deleted")
        .when((event == "installation_repositories") & (action == "added"), "repos_added")
        .when((event == "installation_repositories") & (action == "removed"), "repos_removed")
        .when((event == "pull_request") & action.isin("opened", "synchronize", "reopened"), "review")
        .when((event == "pull_request_review_comment") & (action == "created"), "comment")
        .otherwise("noop")
    )


def review_gate(reviews: DataFrame) -> DataFrame:
    """Adds ``gate``: why a review ends early, or ``run``. Needs files, enabled, reviewable_files."""
    gate = F.when(F.col("files") == 0, "no_files").when(~F.col("enabled"), "disabled").when(F.col("reviewable_files") == 0, "none_reviewable").otherwise("run")
    return reviews.withColumn("gate", gate)


def rag_gate(repo_id: Column, has_builder: Column) -> Column:
    return has_builder & (F.coalesce(repo_id, F.lit(0)) != 0)


def style_gate(style_review: Column) -> Column:
    return F.coalesce(style_review, F.lit(True))


def suggestion_long_enough(code: Column, line_start: Column, line_end: Column) -> Column:
    """Whether a suggestion has enough non-blank lines for the range it replaces."""
    need = line_end - line_start - 2
    have = F.size(F.filter(C.split_lines(code), lambda s: ~blank(s)))
    return ~((line_start > 0) & (line_end > line_start) & (need > 3) & (have < need))


def index_action(status: Column) -> Column:
    return F.when(status == "removed", "delete").when(status.isin("added", "modified", "renamed"), "index").otherwise("none")


def review_files(files: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Files (diff_id, filename) that are reviewed: reviewable, not ignored by ``config`` (diff_id, ignore_patterns)."""
    out = files.where(reviewable(F.col("filename")))
    if config is None:
        return out
    out = out.join(config.select("diff_id", "ignore_patterns"), "diff_id", "left")
    return out.where(~ignored(F.col("filename"), F.col("ignore_patterns"))).drop("ignore_patterns")
