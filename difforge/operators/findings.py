"""Findings: ingest, synthesis, rendering.

A finding is (review_id, ord, source, file_path, line_start, line_end, diff_position, severity, category, title, body,
suggestion_code, confidence); ``ord`` is its place in input order, which ties are broken by.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import values as V
from .intervals import nearest_lines, nearest_position

INVALID_NOTE = "> Note: the suggested code didn't pass validation and was left out."
SOURCES = ["lint", "bug", "xfile", "style"]


def ruff_report(report: Column) -> Column:
    return F.from_json(report, "array<struct<code:string,message:string,location:struct<row:int>>>")


def lint_findings(reports: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Linter reports (file_path, tool, report) as rows: file_path, tool, rule, line, message, severity.

    Rows of ruff and eslint stay only on ``changed`` lines (file_path, line), if given.
    """
    of = lambda tool: reports.where(F.col("tool") == tool)
    ruff = of("ruff").select("file_path", F.inline(ruff_report(F.col("report"))))
    rule = F.coalesce(F.nullif("code", F.lit("")), F.lit("ruff"))
    ruff = ruff.select("file_path", F.lit("ruff").alias("tool"), rule.alias("rule"), F.coalesce("location.row", F.lit(0)).alias("line"), F.coalesce("message", F.lit("")).alias("message"), F.when(rule.startswith("E"), "error").otherwise("warning").alias("severity"))
    es = F.from_json("report", "array<struct<messages:array<struct<line:int,ruleId:string,message:string,severity:int>>>>")
    eslint = of("eslint").select("file_path", F.inline(F.flatten(F.transform(es, lambda r: r["messages"]))))
    eslint = eslint.select("file_path", F.lit("eslint").alias("tool"), F.coalesce(F.nullif("ruleId", F.lit("")), F.lit("eslint")).alias("rule"), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("message", F.lit("")).alias("message"), F.when(F.col("severity") == 2, "error").otherwise("warning").alias("severity"))
    gofmt = of("gofmt").where(F.col("report").rlike(r"\S")).select("file_path", F.lit("gofmt").alias("tool"), F.lit("gofmt").alias("rule"), F.lit(1).alias("line"), F.lit("File is not gofmt-formatted").alias("message"), F.lit("warning").alias("severity"))
    leaks = of("gitleaks").select("file_path", F.inline(F.from_json("report", "array<struct<StartLine:int,RuleID:string,Description:string>>")))
    leaks = leaks.select("file_path", F.lit("gitleaks").alias("tool"), F.coalesce("RuleID", F.lit("secret")).alias("rule"), F.coalesce("StartLine", F.lit(0)).alias("line"), F.concat(F.lit("Potential secret detected: "), F.coalesce("Description", F.lit(""))).alias("message"), F.lit("error").alias("severity"))
    bound = ruff.unionByName(eslint)
    if changed is not None:
        bound = bound.join(changed.select("file_path", "line").distinct(), ["file_path", "line"], "left_semi")
    return bound.unionByName(gofmt).unionByName(leaks)


def from_lint(lint: DataFrame, positions: DataFrame, keys: list[str] = ("file_path",)) -> DataFrame:
    """Linter rows (with probe_id) as findings at the nearest diff position; rows far from the diff are dropped."""
    rows = nearest_position(lint, positions, list(keys))
    leak = F.col("tool") == "gitleaks"
    return rows.select(
        *keys, "probe_id", F.col("line").alias("line_start"), F.col("line").alias("line_end"), "diff_position",
        F.when(leak, "critical").when(F.col("severity") == "error", "medium").otherwise("low").alias("severity"), F.when(leak, "security").otherwise("bug").alias("category"),
        F.concat(F.lit("["), "tool", F.lit("] "), "rule").alias("title"), F.col("message").alias("body"), F.lit(None).cast("string").alias("suggestion_code"), F.lit(0.85).alias("confidence"),
    )


_ITEM = "line_start string, line_end string, severity string, category string, title string, body string, suggestion_code string"


def from_model(replies: DataFrame, positions: DataFrame, kind: str = "bug", valid: DataFrame | None = None) -> DataFrame:
    """A model's JSON replies (prompt_id, file_path, response) as findings of kind ``bug`` or ``style``.

    Replies that aren't arrays give nothing, items that aren't objects are skipped, items without a diff position
    dropped. ``valid`` (probe_id, is_valid, fixed_code) holds verdicts on suggestions.
    """
    items = C.once(C.model_json(F.col("response")), lambda c: F.filter(F.from_json(F.when(c.startswith("["), c), "array<string>"), lambda s: F.trim(s).startswith("{")))
    rows = replies.select("prompt_id", "file_path", F.posexplode(items).alias("item_ord", "j")).withColumn("i", F.from_json("j", _ITEM))
    number = lambda c: F.coalesce(F.col(f"i.{c}").try_cast("double").cast("int"), F.lit(0))
    start = number("line_start")
    rows = rows.select("prompt_id", "file_path", "item_ord", "i", start.alias("line"), F.coalesce(F.nullif(number("line_end"), F.lit(0)), start).alias("line_end"))
    rows = rows.withColumn("probe_id", F.concat_ws(":", "prompt_id", "item_ord"))
    rows = nearest_position(rows, positions, ["file_path"])
    style = kind == "style"
    severity = F.lower(F.coalesce("i.severity", F.lit("low")))
    category = F.lit("style") if style else F.lower(F.coalesce("i.category", F.lit("bug")))
    code = F.nullif(F.regexp_replace("i.suggestion_code", r"^\s+|\s+$", ""), F.lit(""))
    body = F.coalesce("i.body", F.lit(""))
    if valid is not None:
        rows = rows.join(valid.select("probe_id", "is_valid", "fixed_code"), "probe_id", "left")
        bad = code.isNotNull() & ~F.coalesce("is_valid", F.lit(True))
        body, code = F.when(bad, F.concat(body, F.lit("\n\n" + INVALID_NOTE))).otherwise(body), F.when(~bad, F.when(code.isNotNull(), F.coalesce("fixed_code", code)))
    sure = F.lit(0.7) if style else F.when(category == "security", 0.9).otherwise(0.8)
    return rows.select(
        "prompt_id", "item_ord", "file_path", F.col("line").alias("line_start"), "line_end", "diff_position",
        (F.when(severity.isin("low", "medium"), severity).otherwise("low") if style else severity).alias("severity"), category.alias("category"),
        F.coalesce("i.title", F.lit("Style issue" if style else "Issue found")).alias("title"), body.alias("body"), code.alias("suggestion_code"), sure.alias("confidence"),
    )


def from_impact(replies: DataFrame, positions: DataFrame) -> DataFrame:
    """Replies on breaking changes (prompt_id, func_name, changed_file, response) as findings.

    A site's position comes from its own file's map, else from the changed file's.
    """
    shape = "has_breaking_changes string, affected_call_sites array<struct<file:string,line:string,issue:string,suggestion:string>>"
    yes = lambda r: ~F.lower(F.coalesce(r["has_breaking_changes"], F.lit("false"))).isin("false", "0", "", "null", "[]", "{}")
    reply = C.once(C.model_json(F.col("response")), lambda c: F.from_json(F.when(c.startswith("{"), c), shape))
    # A reply is parsed once: all that is asked of it goes into the one generator, which filters don't pass.
    sites = C.once(reply, lambda r: F.when(yes(r), r["affected_call_sites"]))
    rows = replies.select("prompt_id", "func_name", "changed_file", F.posexplode_outer(sites).alias("item_ord", "s")).where("s IS NOT NULL")
    rows = rows.select("*", F.coalesce("s.file", "changed_file").alias("site_file"), F.coalesce(F.col("s.line").try_cast("double").cast("int"), F.lit(0)).alias("line"))
    near = nearest_lines(positions, ["file_path"])
    for file, pos in (("site_file", "own_pos"), ("changed_file", "changed_pos")):
        here = near.select(F.col("file_path").alias("_file"), "_line", F.col("diff_position").alias(pos))
        rows = rows.join(here, (F.col(file) == F.col("_file")) & (F.col("line") == F.col("_line")), "left").drop("_file", "_line")
    rows = rows.withColumn("diff_position", F.coalesce("own_pos", "changed_pos")).where("diff_position IS NOT NULL")
    fix = F.coalesce("s.suggestion", F.lit(""))
    issue = F.coalesce("s.issue", F.lit("Potential breaking change"))
    return rows.select(
        "prompt_id", "item_ord", F.col("site_file").alias("file_path"), F.col("line").alias("line_start"), F.col("line").alias("line_end"), "diff_position",
        F.lit("high").alias("severity"), F.lit("breaking-change").alias("category"), F.concat(F.lit("Breaking change: `"), "func_name", F.lit("` call site may be affected")).alias("title"),
        F.when(fix != "", F.concat(issue, F.lit("\n\n**Suggested fix:** "), fix)).otherwise(issue).alias("body"), F.lit(None).cast("string").alias("suggestion_code"), F.lit(0.75).alias("confidence"),
    )


def summary_reply(replies: DataFrame, fallback: str = "Change reviewed.") -> DataFrame:
    """A model's summary (prompt_id, response) as summary, key_changes, risk_level; anything but an object gives the fallback."""
    parsed = lambda c: F.struct(F.coalesce(c.startswith("{"), F.lit(False)).alias("ok"), F.from_json(F.when(c.startswith("{"), c), "summary string, key_changes string, risk_level string").alias("r"))
    rows = replies.withColumn("_p", C.once(C.model_json(F.col("response")), parsed)).select("prompt_id", "_p.ok", "_p.r")
    risk, none = F.lower("r.risk_level"), F.array().cast("array<string>")
    changes = F.when(F.col("r.key_changes").startswith("["), F.from_json("r.key_changes", "array<string>"))
    return rows.select("prompt_id", F.when(F.col("ok"), F.coalesce("r.summary", F.lit("PR reviewed."))).otherwise(fallback).alias("summary"), F.coalesce(changes, none).alias("key_changes"), F.when(risk.isin("low", "medium", "high"), risk).otherwise("low").alias("risk_level"))


def all_sources(**parts: DataFrame) -> DataFrame:
    """Findings of lint, bug, xfile and style as one table, in that order, with ``ord`` by (source, local_ord) in each review."""
    out = None
    for i, name in enumerate(SOURCES):
        if name in parts:
            df = parts[name].withColumns({"source": F.lit(name), "source_ord": F.lit(i)})
            out = df if out is None else out.unionByName(df)
    w = Window.partitionBy("review_id").orderBy("source_ord", "local_ord")
    return out.withColumn("ord", F.row_number().over(w))


def passing(findings: DataFrame, threshold: Column) -> DataFrame:
    """Findings with a position and at least the severity of ``threshold``."""
    return findings.where((F.col("diff_position") > 0) & (C.severity_rank(F.col("severity")) <= C.threshold_rank(threshold)))


def islands(findings: DataFrame, keys: list[str], tolerance: int = V.LINE_TOLERANCE) -> DataFrame:
    """Adds _island: findings of a key in different islands never overlap, as no range before reaches the next island's first line."""
    top = F.greatest("line_start", "line_end")
    order = Window.partitionBy(*keys).orderBy("line_start", "ord")
    reach = F.max(top).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce(F.col("line_start") - tolerance > F.col("_reach"), F.lit(True))
    return findings.withColumn("_reach", reach).withColumn("_island", F.sum(starts.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach")


def _seeds(keys: list[str], tolerance: int):
    """Adds seed_ord to rows sorted by (keys, _island, ord).

    Seeds of an island don't overlap, so they stay sorted by line; only they are held. Ranges that end before they begin are kept apart.
    """

    def run(batches):
        last, starts, ends, ords, odd = None, [], [], [], []
        for b in batches:
            group = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (*keys, "_island")), strict=True))
            lo, hi, ord_ = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("line_start", "line_end", "ord"))
            out = []
            for g, x, y, o in zip(group, lo, hi, ord_, strict=True):
                if g != last:
                    last, starts, ends, ords, odd = g, [], [], [], []
                if x is None or y is None:  # meets nothing
                    out.append(o)
                    continue
                i, first = bisect.bisect_left(ends, x - tolerance), next((s for a, b_, s in odd if a <= y + tolerance and b_ >= x - tolerance), None)
                while i < len(starts) and starts[i] <= y + tolerance:
                    first = ords[i] if first is None or ords[i] < first else first
                    i += 1
                if first is None and y < x:
                    odd.append((x, y, o))
                    first = o
                if first is None:
                    i = bisect.bisect_left(starts, x)
                    starts.insert(i, x)
                    ends.insert(i, y)
                    ords.insert(i, o)
                    first = o
                out.append(first)
            yield b.append_column("seed_ord", pa.array(out, pa.int64()))

    return run


def merge_overlapping(findings: DataFrame, keys: list[str], rank: str = "rank", tolerance: int = V.LINE_TOLERANCE) -> DataFrame:
    """The best finding of each group of overlapping ones, with the group's ``seed_ord``.

    In input order, a finding joins the earliest seed it overlaps, else becomes a seed itself. The fold runs over one island of a
    file at a time, as a stream, and holds the island's seeds only; the best has the lowest rank, then the highest confidence, then the lowest ord.
    """
    rows = islands(findings.withColumn("ord", F.col("ord").cast("long")), keys, tolerance)
    rows = rows.repartition(*keys, "_island").sortWithinPartitions(*keys, "_island", "ord")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    both = rows.mapInArrow(_seeds(keys, tolerance), fields + ", seed_ord long").drop("_island")
    w = Window.partitionBy(*keys, "seed_ord").orderBy(rank, F.desc("confidence"), "ord")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def synthesise(findings: DataFrame, threshold: Column | None = None, most: int = V.MAX_FINDINGS) -> DataFrame:
    """Deduplicated findings of each review, at most ``most``, with their final place ``pos``."""
    rows = passing(findings, F.lit("low") if threshold is None else threshold).withColumn("rank", C.severity_rank(F.col("severity")))
    rows = merge_overlapping(rows, ["review_id", "file_path"])
    cap = Window.partitionBy("review_id").orderBy("rank", "seed_ord")
    rows = rows.withColumn("_n", F.row_number().over(cap)).where(F.col("_n") <= most).drop("_n")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("review_id").orderBy("rank", "file_path", "line_start", "seed_ord")))


def keep_listed(findings: DataFrame, keep: DataFrame, least: int = 15) -> DataFrame:
    """Findings (review_id, idx from 0) whose idx a model kept (review_id, idx).

    An empty list keeps all; a list of less than half keeps the first max(``least``, half) instead.
    """
    total = findings.groupBy("review_id").agg(F.count(F.lit(1)).alias("total"))
    listed = findings.join(keep.select("review_id", "idx").distinct(), ["review_id", "idx"], "left_semi").select("review_id", "idx", F.lit(True).alias("listed"))
    kept = listed.groupBy("review_id").agg(F.count(F.lit(1)).alias("kept"))
    named = keep.select("review_id", F.lit(True).alias("named")).distinct()
    rows = findings.join(listed, ["review_id", "idx"], "left").join(total, "review_id").join(kept, "review_id", "left").join(named, "review_id", "left")
    half = F.floor(F.col("total") / 2)
    few = F.coalesce("kept", F.lit(0)) < half
    ok = F.when(F.col("named").isNull(), True).when(few, F.col("idx") < F.greatest(F.lit(least), half)).otherwise(F.coalesce("listed", F.lit(False)))
    return rows.where(ok).drop("listed", "total", "kept", "named")


def dedup_view(findings: DataFrame) -> DataFrame:
    """JSON list of each review's findings for a model: ordinal id, place, and the head of the body."""
    row = F.struct("pos", F.to_json(F.struct((F.col("pos") - 1).alias("id"), F.col("file_path").alias("file"), "line_start", "line_end", "severity", "category", "title", F.substring("body", 1, 200).alias("body"))).alias("j"))
    return findings.groupBy("review_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["j"]), ","), F.lit("]")).alias("view"))


def severity_counts(findings: DataFrame, keys: list[str], severity: str = "severity") -> DataFrame:
    """Counts of the four severities that are reported, zero where there are none."""
    return findings.groupBy(*keys).agg(*(F.count_if(F.col(severity) == s).alias(s) for s in V.SEVERITIES[:4]))


def comment_markdown(findings: DataFrame) -> DataFrame:
    mark = C.lookup(V.SEVERITY_MARKS, F.col("severity"), V.UNKNOWN_MARK)
    head = F.concat(F.lit("**"), mark, F.lit(" "), "title", F.lit("** ("), "severity", F.lit(")\n\n"), "body")
    code = F.nullif(F.coalesce("suggestion_code", F.lit("")), F.lit(""))
    return findings.withColumn("comment", F.when(code.isNull(), head).otherwise(F.concat(head, F.lit("\n\n```suggestion\n"), code, F.lit("\n```"))))


def summary_markdown(reviews: DataFrame, title: str = "## Automated review") -> DataFrame:
    """Markdown of a review: review_id, pr_summary, critical, high, medium, low, files_reviewed, hunks_reviewed, cost_usd, stages."""
    rows = [F.concat(F.lit(f"| {V.SEVERITY_MARKS[s]} {V.SEVERITY_LABELS[s]} | "), F.col(s).cast("string"), F.lit(" |")) for s in V.SEVERITIES[:4]]
    intro = F.when(F.coalesce("pr_summary", F.lit("")) != "", F.concat(F.lit("**Summary:** "), "pr_summary", F.lit("\n")))
    foot = F.concat(F.format_string("> Reviewed %d files, %d hunks | Cost: $%.4f | Stages: ", "files_reviewed", "hunks_reviewed", "cost_usd"), F.array_join("stages", ", "))
    return reviews.withColumn("markdown", F.concat_ws("\n", F.lit(title + "\n"), intro, F.lit("| Severity | Count |"), F.lit("|----------|-------|"), *rows, F.lit(""), foot))


def lint_context(lint: DataFrame) -> DataFrame:
    """A file's linter rows as a bullet list for a prompt."""
    row = F.format_string("  - Line %d [%s/%s]: %s", "line", "tool", "rule", "message")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_ord", row.alias("t")))), lambda r: r["t"])
    return lint.groupBy("file_path").agg(F.concat(F.lit("**Static analysis findings for this file:**\n"), F.array_join(lines, "\n")).alias("lint_context"))


def review_comments(findings: DataFrame, positions: DataFrame, hunks: DataFrame, keys: list[str] = ("file_path",)) -> DataFrame:
    """Comment requests: multi-line if both ends are mapped and lie in one hunk (…keys, hunk_start, hunk_end), else at the position.

    Files without hunk ranges aren't held to one hunk. Needs a unique ``probe_id`` and ``body``.
    """
    from .intervals import same_range

    keys = list(keys)
    end = lambda line, out: positions.select(*keys, F.col("new_lineno").alias(line), F.lit(True).alias(out))
    rows = findings.join(end("line_start", "_a"), [*keys, "line_start"], "left").join(end("line_end", "_b"), [*keys, "line_end"], "left")
    rows = same_range(rows, hunks, keys).join(hunks.select(*keys, F.lit(True).alias("_ranges")).distinct(), keys, "left")
    multi = (F.col("line_start") < F.col("line_end")) & F.coalesce("_a", F.lit(False)) & F.coalesce("_b", F.lit(False)) & (F.col("_ranges").isNull() | F.col("same_hunk"))
    when = lambda x: F.when(multi, x)
    return rows.select(
        "probe_id", F.col("file_path").alias("path"), F.when(~multi, F.col("diff_position")).alias("position"), when(F.col("line_start")).alias("start_line"), when(F.col("line_end")).alias("line"),
        when(F.lit("RIGHT")).alias("start_side"), when(F.lit("RIGHT")).alias("side"), "body",
    )
