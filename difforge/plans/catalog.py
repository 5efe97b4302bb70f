"""The registry of the engine's own queries: each applies one operator to whole tables; SQL twins are in ``sql.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import models
from ..operators import chunking, diff, findings, indexing, intervals, postings, retrieval, reviews, routing
from ..sources import readers, sinks
from ..sources.readers import table
from ..sources.snapshots import SnapshotTable
from ..streaming import expiring, index_stream, streams
from . import proxies as P
from . import review
from .sql import SQL

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _found[fn.__name__] = fn
    return fn


# --- retrieval ---------------------------------------------------------------


@query
def context_topk(spark, sf):
    """JOIN-10, FLT-9/10/11, WIN-7: five nearest vectors of the same label, itself left out, cosine at least 0.25."""
    e = table(spark, sf, "embeddings")
    name = F.col("vec_id").cast("string")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("repo_id"), F.col("embedding").alias("vector"), F.array(name).alias("exclude"))
    c = e.select(F.col("label").alias("repo_id"), F.col("vec_id").alias("chunk_id"), "embedding", name.alias("file_path"))
    return retrieval.similar_chunks(q, c, 5, 0.25, "exclude").select("query_id", "chunk_id", "score", "rank")


@query
def past_findings_topk(spark, sf):
    """JOIN-11: three most similar past findings, no threshold."""
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("repo_id"), F.col("embedding").alias("vector"))
    f = e.select(F.col("label").alias("repo_id"), F.col("vec_id").alias("finding_id"), "embedding")
    return retrieval.past_findings(q, f, 3).select("query_id", "finding_id", "score", "rank")


@query
def keyword_callers(spark, sf):
    """JOIN-9, SRT-3: the first ten files of each repository that hold a keyword."""
    d = P.documents(spark, sf).select("repo_id", F.col("doc_id").alias("chunk_id"), "file_path", F.lit(1).alias("start_line"), "content")
    words = spark.createDataFrame([(w,) for w in ("the", "und", "les", "de")], "name string")
    names = d.select("repo_id").distinct().crossJoin(F.broadcast(words)).select(F.concat_ws(":", "repo_id", "name").alias("query_id"), "repo_id", "name", F.array().cast("array<string>").alias("exclude"))
    return retrieval.callers(names, d, 10, "[a-z]+").select("query_id", "chunk_id", "rank")


@query
def token_budget(spark, sf):
    """WIN-4, AGG-11: documents of each source in order while their tokens fit 4000."""
    d = P.documents(spark, sf).withColumn("tok", F.coalesce(C.tokens(F.col("content")), F.lit(0)))
    return retrieval.within_budget(d, ["repo_id"], F.col("tok"), 4000, "doc_id").select("repo_id", "doc_id", "tok", "spent")


@query
def call_budget(spark, sf):
    """WIN-5, FLT-16: at most 20 model calls for each source, in file order."""
    d = P.documents(spark, sf)
    hunks = (F.col("doc_id") % 5 + 1).cast("int")
    f = d.select(F.col("repo_id").alias("review_id"), F.col("doc_id").alias("file_ord"), hunks.alias("hunks"), routing.granularity(F.col("file_path"), hunks).alias("granularity"))
    return retrieval.call_budget(f).select("review_id", "file_ord", "unit", "call_no", "granularity")


@query
def file_cap(spark, sf):
    """SRT-4: the first 15 files of each source."""
    d = P.documents(spark, sf).select(F.col("repo_id").alias("diff_id"), F.col("doc_id").alias("file_ord"))
    return retrieval.file_cap(d)


@query
def cache_split(spark, sf):
    """JOIN-12, SRC-9: texts against a cache of one source's texts; misses are computed once for each distinct text."""
    d = P.documents(spark, sf).select("doc_id", F.col("doc_id").alias("ord"), F.coalesce("content", F.lit("")).alias("text"), "repo_id")
    cache = d.where("repo_id IN ('src0', 'src3')").select(C.short_hash(F.col("text")).alias("key"), F.col("doc_id").alias("value"), F.when(F.col("repo_id") == "src0", F.lit("2100-01-01")).otherwise("2000-01-01").cast("timestamp").alias("expires_at"))
    rows = retrieval.cache_split(d, cache, now=F.lit("2024-06-01").cast("timestamp"))
    return rows.select("doc_id", "key", "hit", "computes")


@query
def payload_chunks(spark, sf):
    """PRJ-20: loosely typed payloads with defaults."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    p = e.select(F.col("event_id").alias("chunk_id"), F.col("event_type").alias("file_path"), F.lit(None).cast("string").alias("chunk_type"), F.lit("n").alias("name"), F.col("props").alias("content"), k.alias("start_line"), F.concat(k, F.lit("x")).alias("end_line"), F.lit(None).cast("string").alias("language"), F.col("value").cast("string").alias("score"))
    return retrieval.payload_chunk(p)


# --- chunking ----------------------------------------------------------------


@query
def line_windows(spark, sf):
    """WIN-10, PRJ-5, PRJ-23: windows of five lines that overlap by one."""
    return chunking.line_windows(P.documents(spark, sf), size=5, overlap=1).select("file_path", "name", "content", "start_line", "end_line", "language", "chunk_id")


@query
def file_header(spark, sf):
    """WIN-12, FLT-13: the first 50 lines of each file that isn't blank."""
    return chunking.header_chunks(P.documents(spark, sf)).select("file_path", "name", "content", "start_line", "end_line", "language", "chunk_id")


@query
def token_windows(spark, sf):
    """WIN-9: windows of 512 tokens that overlap by 128."""
    return chunking.token_windows(P.documents(spark, sf)).select("file_path", "name", F.sha2("content", 256).alias("content_sha"), "start_line", "end_line", "chunk_id")


@query
def chunk_dedup(spark, sf):
    """SET-4, WIN-6, PRJ-26: header and window chunks of each file, the first of each id."""
    return chunking.all_chunks(P.documents(spark, sf)).select("file_path", "chunk_type", "name", "start_line", "end_line", "chunk_id")


@query
def semantic_chunks(spark, sf):
    """PRJ-24, WIN-11: a node table of nested halves of each file, as functions and classes."""
    d = P.documents(spark, sf)
    n = F.size(C.split_lines(F.coalesce("content", F.lit(""))))
    node = lambda kind, name, lo, hi, i: F.struct(F.lit(kind).alias("node_type"), F.lit(name).alias("name"), lo.cast("int").alias("start_row"), hi.cast("int").alias("end_row"), F.lit(i).alias("node_ord"))
    nodes = d.where(n > 0).select("file_path", F.inline(F.array(node("class_definition", "whole", F.lit(0), n - 1, 0), node("function_definition", None, F.floor((n - 1) / 2), n - 1, 1))))
    return chunking.semantic_chunks(d, nodes).select("file_path", "chunk_type", "name", "content", "start_line", "end_line", "chunk_id")


@query
def point_ids(spark, sf):
    """PRJ-21, PRJ-23: chunk and point ids."""
    d = P.documents(spark, sf)
    cid = C.chunk_id(F.col("file_path"), F.lit("f"), F.col("doc_id"))
    return d.select("doc_id", cid.alias("chunk_id"), C.point_id(cid).alias("point_id"))


@query
def languages(spark, sf):
    """PRJ-4, PRJ-5: language by suffix under both tables."""
    return P.documents(spark, sf).select("doc_id", C.diff_language(F.col("file_path")).alias("diff_language"), C.chunk_language(F.col("file_path")).alias("chunk_language"))


# --- routing -----------------------------------------------------------------


@query
def gatekeeper_route(spark, sf):
    """FLT-1, FLT-2: the whole cascade, on authors, labels, drafts and file lists made from events."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    n = k % 60
    path = lambda i: F.concat(F.lit("src/f"), i.cast("string"), F.when(k % 3 == 0, ".md").otherwise(".py"))
    files = F.when(k % 11 != 0, F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), path)))
    e = e.select(
        "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 10 == 0, "[bot]").otherwise("")).alias("author"),
        F.when(k % 7 == 0, F.array(F.lit("bug"), F.lit("skip-ai-review"))).otherwise(F.array(F.lit("bug"))).alias("labels"), ((F.col("event_type") == "error") & (k % 2 == 0)).alias("draft"), files.alias("changed_files"),
    )
    return routing.gatekeeper(e).select("event_id", "should_process", "reason", "queue")


@query
def event_routes(spark, sf):
    """FLT-5: deliveries by event and action."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 4
    event = F.element_at(F.create_map(*(F.lit(x) for x in ("click", "pull_request", "view", "installation", "error", "installation_repositories", "purchase", "pull_request_review_comment", "signup", "push"))), F.col("event_type"))
    action = F.element_at(F.array(*map(F.lit, ("opened", "created", "added", "removed"))), (k + 1).cast("int"))
    return e.select("event_id", event.alias("event"), action.alias("action"), routing.event_route(event, action).alias("route"))


@query
def reviewable_paths(spark, sf):
    """FLT-2, FLT-3: reviewable files by their path, and those that configured globs ignore."""
    d = P.documents(spark, sf)
    globs = F.array(F.lit("src1/*"), F.lit("*.[gG]O"), F.lit("src?/1*.py"))
    return d.select("doc_id", "file_path", routing.reviewable(F.col("file_path")).alias("reviewable"), routing.ignored(F.col("file_path"), globs).alias("ignored"))


@query
def code_files(spark, sf):
    """FLT-4: files that are indexed."""
    d = P.documents(spark, sf)
    return d.where(routing.indexable(F.col("file_path"), F.col("size"))).select("doc_id", "file_path", "size")


@query
def path_classes(spark, sf):
    """FLT-14, FLT-15: test and security paths, on the URLs of pages."""
    p = table(spark, sf, "pages")
    return p.select("page_id", routing.is_test(F.col("url")).alias("is_test"), routing.security_critical(F.col("url")).alias("security"), C.basename(F.col("url")).alias("base"))


# --- diffs -------------------------------------------------------------------


@query
def segment_running(spark, sf):
    """WIN-1, WIN-2, WIN-3: segments of conversation turns that begin with a user's, with running positions."""
    c = table(spark, sf, "conversations")
    rows = diff.segment(c.select("conv_id", "turn", "role"), ["conv_id"], "turn", F.col("role") == "user", "seg")
    w = Window.partitionBy("conv_id", "seg").orderBy("turn")
    return rows.withColumn("pos", F.row_number().over(w))


@query
def diff_line_table(spark, sf):
    """PRJ-1, WIN-1/2/3: typed lines of diffs made from documents."""
    return diff.diff_lines(P.diffs(spark, sf)).select("diff_id", "hunk_ord", "content", "line_type", "old_lineno", "new_lineno", "diff_position")


@query
def diff_file_table(spark, sf):
    """PRJ-3, PRJ-4, AGG-1: files of diffs with additions and deletions."""
    return diff.diff_files(P.diffs(spark, sf)).select("diff_id", "filename", "old_filename", "status", "language", "is_binary", "additions", "deletions")


@query
def diff_hunk_table(spark, sf):
    """PRJ-6: hunk headers."""
    return diff.diff_hunks(P.diffs(spark, sf)).select("diff_id", "hunk_ord", "old_start", "old_count", "new_start", "new_count", "function_context")


@query
def line_positions(spark, sf):
    """PRJ-2: position by new line."""
    return diff.position_map(diff.diff_lines(P.diffs(spark, sf)))


@query
def hunk_rendering(spark, sf):
    """PRJ-11, AGG-14: hunks as numbered text."""
    return diff.render_hunks(diff.diff_lines(P.diffs(spark, sf))).select("diff_id", "hunk_ord", "rendered")


@query
def change_query_text(spark, sf):
    """PRJ-17, SRT-6: added lines of the first hunk that has any."""
    return diff.query_text(diff.diff_lines(P.diffs(spark, sf))).select("diff_id", "query_text")


@query
def line_context(spark, sf):
    """PRJ-16: the text around each added line."""
    return diff.context_around(diff.diff_lines(P.diffs(spark, sf))).where("line_type = 'added'").select("diff_id", "diff_position", F.sha2("context", 256).alias("context_sha"))


@query
def scope_lines(spark, sf):
    """PRJ-15: file lines around a hunk."""
    d = P.documents(spark, sf)
    h = d.select(F.col("doc_id").alias("diff_id"), "file_path", F.lit(1).alias("hunk_ord"), (F.col("doc_id") % 9 + 1).cast("int").alias("new_start"), F.lit(3).alias("new_count"))
    return diff.scope_context(h, d.where("content IS NOT NULL")).select("diff_id", "scope_context")


# --- intervals ---------------------------------------------------------------


@query
def nearest_position(spark, sf):
    """JOIN-1: errors at the nearest hour that has a view."""
    e = P.hours(spark, sf)
    pos = e.where("event_type = 'view'").groupBy("user_id", F.col("h").alias("new_lineno")).agg(F.max("event_id").alias("diff_position"))
    probes = e.where("event_type = 'error'").select(F.col("event_id").alias("probe_id"), "user_id", F.col("h").alias("line"))
    return intervals.nearest_position(probes, pos, ["user_id"]).select("probe_id", "line", "matched_line", "diff_position")


def _ranges(spark, sf):
    e = P.hours(spark, sf)
    h = e.where("event_type = 'click'").select("event_id", "user_id", F.col("h").alias("lo"), (F.col("h") + 4).alias("hi"))
    f = e.where("event_type = 'error'").select("user_id", F.col("h").alias("f_lo"), (F.col("h") + 2).alias("f_hi"))
    return h, f


@query
def overlap_semi(spark, sf):
    """JOIN-2: hunks that meet a finding within three lines."""
    h, f = _ranges(spark, sf)
    return intervals.overlapping(h, f, ["user_id"], ("lo", "hi"), ("f_lo", "f_hi"), "event_id", 3)


@query
def covered_anti(spark, sf):
    """JOIN-4: hunks that meet none."""
    h, f = _ranges(spark, sf)
    return intervals.not_covered(h, f, ["user_id"], ("lo", "hi"), ("f_lo", "f_hi"), "event_id", 3)


@query
def innermost_scope(spark, sf):
    """JOIN-14: the innermost purchase interval around each view."""
    e = P.hours(spark, sf)
    nodes = e.where("event_type = 'purchase'").groupBy("user_id", F.col("h").alias("start_line"), (F.col("h") + F.col("event_id") % 7).alias("end_line")).agg(F.max("event_id").alias("name"))
    points = e.where("event_type = 'view'").select(F.col("event_id").alias("probe_id"), "user_id", F.col("h").alias("line"))
    return intervals.innermost(points, nodes, ["user_id"]).select("probe_id", "line", "enclosing")


@query
def same_hunk(spark, sf):
    """JOIN-13: whether both ends of an interval lie in one click interval."""
    e = P.hours(spark, sf)
    hunks = e.where("event_type = 'click'").select("user_id", F.col("h").alias("hunk_start"), (F.col("h") + 4).alias("hunk_end"))
    rows = e.where("event_type = 'signup'").select(F.col("event_id").alias("probe_id"), "user_id", F.col("h").alias("line_start"), (F.col("h") + F.col("event_id") % 3).alias("line_end"))
    return intervals.same_range(rows, hunks, ["user_id"]).select("probe_id", "same_hunk")


# --- findings ----------------------------------------------------------------


@query
def dedup_findings(spark, sf):
    """JOIN-3, AGG-6: the best of each group of overlapping findings, by seeds in input order."""
    return findings.merge_overlapping(P.findings(spark, sf), ["file_path"]).select("file_path", "ord", "seed_ord", "rank", "confidence")


@query
def severity_counts(spark, sf):
    """AGG-2: counts by severity for each file."""
    return findings.severity_counts(P.findings(spark, sf), ["file_path"])


@query
def severity_gate(spark, sf):
    """FLT-7, FLT-8: findings with a position and at least medium severity."""
    rows = P.findings(spark, sf).withColumn("diff_position", (F.col("ord") % 4).cast("int"))
    return findings.passing(rows, F.lit("medium")).select("ord", "severity", "diff_position")


@query
def cap_by_severity(spark, sf):
    """SRT-2: the first 25 findings of each file, by severity, line and input order."""
    return retrieval.top_k(P.findings(spark, sf), ["file_path"], 25, "rank", "line_start", "ord", out="pos").select("file_path", "ord", "pos")


@query
def source_union(spark, sf):
    """SET-1: findings of four sources in their fixed order."""
    f = P.findings(spark, sf).withColumn("review_id", F.col("file_path")).withColumn("local_ord", F.col("ord")).drop("ord")
    of = lambda c: f.where(F.col("category") == c)
    return findings.all_sources(style=of("view"), lint=of("error"), bug=of("purchase"), xfile=of("signup")).select("review_id", "source", "local_ord", "ord")


@query
def finding_comments(spark, sf):
    """PRJ-13: findings as markdown."""
    f = P.findings(spark, sf).select("ord", "severity", F.concat(F.lit("T"), F.col("ord").cast("string")).alias("title"), F.col("category").alias("body"), F.when(F.col("ord") % 3 == 0, F.lit("x = 1")).when(F.col("ord") % 3 == 1, "").alias("suggestion_code"))
    return findings.comment_markdown(f).select("ord", "comment")


@query
def review_summaries(spark, sf):
    """PRJ-14, AGG-2: one markdown summary for each file's findings."""
    n = findings.severity_counts(P.findings(spark, sf), ["file_path"])
    r = n.select("*", F.col("file_path").alias("review_id"), F.when(F.col("critical") > 5, F.lit("Busy.")).alias("pr_summary"), F.col("high").alias("files_reviewed"), F.col("low").alias("hunks_reviewed"), (F.col("medium") / 8.0).alias("cost_usd"), F.array(F.lit("lint"), F.lit("bugs")).alias("stages"))
    return findings.summary_markdown(r).select("review_id", "markdown")


@query
def json_findings(spark, sf):
    """UDF-3, PRJ-8, JOIN-1: model replies, fenced or not, as findings at their diff position."""
    e = P.hours(spark, sf)
    k = F.get_json_object("props", "$.k").cast("int")
    item = F.concat(F.lit('{"line_start": '), F.col("h").cast("string"), F.lit(', "severity": "High", "title": "t'), k.cast("string"), F.lit('"}'))
    text = F.when(k % 4 == 0, F.concat(F.lit("```json\n["), item, F.lit("]\n```"))).when(k % 4 == 1, F.concat(F.lit(" ["), item, F.lit(", 7]"))).when(k % 4 == 2, item).otherwise(F.lit("not json"))
    replies = e.where("event_type = 'error'").select(F.col("event_id").cast("string").alias("prompt_id"), F.col("user_id").alias("file_path"), text.alias("response"))
    pos = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("file_path"), F.col("h").alias("new_lineno")).agg(F.max("event_id").alias("diff_position"))
    return findings.from_model(replies, pos).select("prompt_id", "file_path", "line_start", "line_end", "diff_position", "severity", "category", "title", "confidence")


@query
def lint_ingest(spark, sf):
    """SRC-10, FLT-6: linter reports as rows, ruff and eslint on changed lines only."""
    e = P.hours(spark, sf)
    h, u = F.col("h").cast("string"), F.col("user_id").cast("string")
    ruff = F.concat(F.lit('[{"code":"'), F.when(F.col("event_id") % 2 == 0, "E501").otherwise("W1"), F.lit('","message":"m","location":{"row":'), h, F.lit("}}]"))
    leak = F.concat(F.lit('[{"StartLine":'), h, F.lit(',"RuleID":"key","Description":"d"}]'))
    reports = e.where("event_type IN ('error', 'signup')").select(u.alias("file_path"), F.when(F.col("event_type") == "error", "ruff").otherwise("gitleaks").alias("tool"), F.when(F.col("event_type") == "error", ruff).otherwise(leak).alias("report"))
    changed = e.where("event_type = 'view'").select(u.alias("file_path"), F.col("h").alias("line"))
    return findings.lint_findings(reports, changed)


# --- index and bookkeeping ---------------------------------------------------


@query
def latest_wins(spark, sf):
    """The latest-wins view behind SNK-2 and SNK-5: the last order of each customer."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return indexing.latest(o, ["o_custkey"], "o_orderdate", "o_orderkey")


@query
def soft_delete(spark, sf):
    """SNK-4: customers of some nations marked removed."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    gone = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return indexing.soft_delete(c, gone, "c_nationkey", c_mktsegment="removed")


@query
def delete_by_filter(spark, sf):
    """SNK-7: documents without those of two repositories and one language's files of a third."""
    d = P.documents(spark, sf).select("repo_id", "file_path", "doc_id")
    repos = spark.createDataFrame([("src1",), ("src2",)], "repo_id string")
    files = d.where("repo_id = 'src3' AND file_path LIKE '%.py'").select("repo_id", "file_path")
    return indexing.delete_where(indexing.delete_where(d, repos), files)


@query
def incremental_chunks(spark, sf):
    """JOIN-5, SET-3: header chunks of files that are not in the table at this commit."""
    c = chunking.header_chunks(P.documents(spark, sf), ["repo_id"]).withColumn("commit_sha", F.substring("chunk_id", 1, 1))
    old = c.where("repo_id < 'src2'").withColumn("commit_sha", F.when(F.col("commit_sha") < "8", F.col("commit_sha")).otherwise("old"))
    return indexing.new_chunks(c, old).select("repo_id", "file_path", "chunk_id", "commit_sha")


@query
def upsert_stats(spark, sf):
    """AGG-13: cache hits, misses, tokens and cost of storing all documents."""
    d = P.documents(spark, sf).where("content IS NOT NULL")
    cached = d.where("repo_id = 'src0'").select(C.short_hash(F.col("content")).alias("key"))
    return indexing.upsert_stats(d, cached)


@query
def review_rollup(spark, sf):
    """JOIN-17, AGG-3: orders with the number of their lines and parts."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_orderstatus").alias("status"))
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("review_id"), F.col("l_partkey").alias("file_path"))
    return reviews.rollup(o, f)


@query
def cost_by_model(spark, sf):
    """AGG-4: cost of conversation turns, priced by role."""
    c = table(spark, sf, "conversations")
    tok = F.coalesce(C.tokens(F.col("text")), F.lit(0))
    rows = c.select(F.when(F.col("role") == "user", "deepseek-chat").when(F.col("role") == "assistant", "deepseek-reasoner").otherwise("other").alias("model"), tok.alias("input_tokens"), (tok * 2).alias("output_tokens"))
    return reviews.cost_by_model(rows).withColumn("cost_usd", F.round("cost_usd", 8))


def _batches(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("batch_no"), F.lit(50).cast("long").alias("total"), F.lit(2).cast("long").alias("files"), (F.col("o_orderkey") % 5).alias("chunks"), F.col("o_orderstatus").alias("status"))


@query
def index_progress(spark, sf):
    """AGG-5, AGG-10, SRC-13: progress of each customer, not indexed where there are no orders."""
    repos = table(spark, sf, "customer").select(F.col("c_custkey").alias("repo_id"))
    return indexing.progress(_batches(spark, sf), repos)


@query
def running_totals(spark, sf):
    """AGG-5: files and chunks so far."""
    return indexing.running_totals(_batches(spark, sf)).select("repo_id", "batch_no", "files_so_far", "chunks_so_far")


@query
def batch_slices(spark, sf):
    """SRT-7: documents of each source in batches of 20."""
    return indexing.batches(P.documents(spark, sf), 20, ["repo_id"], "doc_id").select("repo_id", "doc_id", "batch_no")


@query
def rate_limit(spark, sf):
    """WIN-8: events of each user within the last six hours, against a limit of two."""
    e = table(spark, sf, "events")
    return indexing.rate_limited(e, "user_id", "ts", 2, 6 * 3600).select("event_id", "in_window", "over_limit")


@query
def admission(spark, sf):
    """WIN-8: when the calls of seven keys go out, at most three within an hour."""
    e = table(spark, sf, "events").withColumn("key", F.col("user_id") % 7)
    rows = indexing.admitted(e, "key", "ts", "event_id", 3, 3600)
    at = F.unix_micros("admitted_at")
    return rows.select("event_id", at.alias("admitted_us"), (at - F.unix_micros(F.col("ts").cast("timestamp"))).alias("waited_us"))


@query
def tree_listing(spark, sf):
    """SRC-3, SRC-2: files of a listing joined to their content."""
    d = P.documents(spark, sf)
    entries = d.select("repo_id", "file_path", F.when(F.col("doc_id") % 3 == 0, "tree").otherwise("blob").alias("type"), F.lit("s").alias("sha"))
    return readers.file_content(readers.tree_blobs(entries), d.withColumn("sha", F.lit("s"))).select("file_path", F.length("content").alias("chars"))


@query
def latest_open(spark, sf):
    """SRC-11: the last open order of each customer."""
    o = table(spark, sf, "orders")
    prs = o.select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("pr_number"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"), F.col("o_orderdate").alias("updated_at"))
    return reviews.latest_open(prs)


@query
def default_heads(spark, sf):
    """SRC-12: two lookups, from customer to nation to region."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_nationkey").alias("default_branch"))
    b = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("branch"), F.concat_ws("/", "n_name", "r_name").alias("sha"))
    return reviews.head_sha(c, c.select("repo_id", F.col("default_branch").alias("branch")).join(b, "branch")).select("repo_id", "sha")


@query
def kv_lookup(spark, sf):
    """SRC-9: values that are still alive at an hour, by user."""
    e = P.hours(spark, sf)
    store = e.where("event_type <> 'view'").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), F.struct("h", "event_id").alias("expires_at"))
    keys = e.select(F.col("user_id").alias("key")).distinct()
    return readers.kv_get(keys, store, F.struct(F.lit(700).alias("h"), F.lit(0).cast("long").alias("event_id")))


# --- model replies, synthesis and bookkeeping ---------------------------------


def _views(spark, sf, key: str = "user_id") -> DataFrame:
    e = P.hours(spark, sf).where("event_type = 'view'")
    return e.groupBy(F.col("user_id").alias(key), F.col("h").alias("new_lineno")).agg(F.max("event_id").alias("diff_position"))


@query
def lint_to_findings(spark, sf):
    """PRJ-7, JOIN-1: linter rows as findings at their diff position."""
    e = P.hours(spark, sf).where("event_type = 'error'")
    leak = F.col("event_id") % 5 == 0
    lint = e.select(F.col("event_id").alias("probe_id"), "user_id", F.col("h").alias("line"), F.when(leak, "gitleaks").otherwise("ruff").alias("tool"), F.lit("R").alias("rule"), F.lit("m").alias("message"), F.when(F.col("event_id") % 2 == 0, "error").otherwise("warning").alias("severity"))
    return findings.from_lint(lint, _views(spark, sf), ["user_id"]).drop("suggestion_code")


@query
def lint_contexts(spark, sf):
    """PRJ-19: linter rows as a prompt's bullet list."""
    e = P.hours(spark, sf).where("event_type = 'error'")
    return findings.lint_context(e.select(F.col("user_id").alias("file_path"), F.col("event_id").alias("line_ord"), F.col("h").alias("line"), F.lit("ruff").alias("tool"), F.lit("R").alias("rule"), F.lit("m").alias("message")))


@query
def style_findings(spark, sf):
    """PRJ-9, JOIN-1: style replies as findings; severities other than low and medium count as low."""
    e = P.hours(spark, sf).where("event_type = 'signup'")
    k = F.get_json_object("props", "$.k").cast("int")
    severity = F.element_at(F.array(*map(F.lit, ("High", "Medium", "Low"))), k % 3 + 1)
    text = F.concat(F.lit('[{"line_start": '), F.col("h").cast("string"), F.lit(', "severity": "'), severity, F.lit('", "category": "bug"}]'))
    replies = e.select(F.col("event_id").cast("string").alias("prompt_id"), F.col("user_id").alias("file_path"), text.alias("response"))
    return findings.from_model(replies, _views(spark, sf, "file_path"), "style").select("prompt_id", "file_path", "line_start", "line_end", "diff_position", "severity", "category", "title", "confidence")


@query
def impact_findings(spark, sf):
    """PRJ-10, JOIN-15: breaking call sites at their own file's position, else at the changed file's."""
    e = P.hours(spark, sf).where("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    site = F.struct(F.col("user_id").cast("string").alias("file"), F.col("h").alias("line"), F.lit("i").alias("issue"), F.when(k % 2 == 0, "s").otherwise("").alias("suggestion"))
    reply = F.to_json(F.struct((k % 3 != 0).alias("has_breaking_changes"), F.array(site).alias("affected_call_sites")))
    replies = e.select(F.col("event_id").cast("string").alias("prompt_id"), F.lit("f").alias("func_name"), (F.col("user_id") + 1).cast("string").alias("changed_file"), reply.alias("response"))
    pos = _views(spark, sf, "file_path").withColumn("file_path", F.col("file_path").cast("string"))
    return findings.from_impact(replies, pos).select("prompt_id", "file_path", "line_start", "diff_position", "body")


@query
def review_requests(spark, sf):
    """PRJ-12, JOIN-13: comment requests, over several lines where both ends are mapped and lie in one hunk."""
    e = P.hours(spark, sf)
    f = e.where("event_type = 'signup'").select(F.col("event_id").alias("probe_id"), F.col("user_id").alias("file_path"), F.col("h").alias("line_start"), (F.col("h") + F.col("event_id") % 3).cast("int").alias("line_end"), F.col("event_id").alias("diff_position"), F.lit("b").alias("body"))
    hunks = e.where("event_type = 'click'").select(F.col("user_id").alias("file_path"), F.col("h").alias("hunk_start"), (F.col("h") + 4).alias("hunk_end"))
    return findings.review_comments(f, _views(spark, sf, "file_path"), hunks)


@query
def rag_sections(spark, sf):
    """PRJ-18: retrieved context as markdown, from each source's first documents."""
    d = P.documents(spark, sf).withColumn("content", F.coalesce("content", F.lit("")))
    d = retrieval.top_k(d, ["repo_id"], 5, "doc_id").withColumn("query_id", F.col("repo_id"))
    c = d.select("query_id", "rank", "file_path", F.lit(1).alias("start_line"), F.col("rank").alias("end_line"), F.lit("n").alias("name"), F.lit("text").alias("language"), F.lit(0.5).alias("score"), "content")
    past = d.select("query_id", "rank", F.lit("low").alias("severity"), F.lit("t").alias("title"), F.col("content").alias("body"))
    return retrieval.rag_section(c, c, past).select("query_id", F.sha2("section", 256).alias("section_sha"))


@query
def summary_replies(spark, sf):
    """PRJ-25: summary replies, whole, partial, broken and of the wrong shape."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    whole = F.concat(F.lit('{"summary": "s'), k.cast("string"), F.lit('", "key_changes": ["a", "b"], "risk_level": "HIGH"}'))
    text = F.when(k % 4 == 0, whole).when(k % 4 == 1, '{"risk_level": "huge"}').when(k % 4 == 2, "[1]").otherwise('{"summary": "x", "key_changes": "none"}')
    rows = findings.summary_reply(e.select(F.col("event_id").cast("string").alias("prompt_id"), text.alias("response")))
    return rows.select("prompt_id", "summary", F.array_join("key_changes", "|").alias("changes"), "risk_level")


@query
def kept_findings(spark, sf):
    """JOIN-16: findings that a model's list keeps, unless it keeps under half."""
    e = table(spark, sf, "events")
    f = retrieval.top_k(e.select(F.col("user_id").alias("review_id"), "event_id"), ["review_id"], 1 << 30, "event_id", out="idx").withColumn("idx", F.col("idx") - 1)
    few = (F.col("review_id") % 3 == 1) & (F.col("idx") % 4 == 0)
    keep = f.where(few | ((F.col("review_id") % 3 == 2) & (F.col("idx") % 4 != 0))).select("review_id", "idx")
    return findings.keep_listed(f, keep).select("review_id", "idx")


def _function_diffs(spark, sf) -> DataFrame:
    """Diffs that change a function's signature in one file and call some function in another; every fourth is of no known language."""
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("a."), F.when(F.col("doc_id") % 4 == 0, "none").otherwise("py"))
    f = lambda n: F.concat(F.lit("f"), (F.col("doc_id") % n).cast("string"))
    first = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1,2 +1,2 @@\n-def "), f(7), F.lit("(a):\n+def "), f(7), F.lit("(b):\n x = 1\n"))
    second = F.concat(F.lit("diff --git a/b.py b/b.py\n--- a/b.py\n+++ b/b.py\n@@ -1 +1,2 @@\n y = 2\n+z = "), f(5), F.lit("(3)"))
    return d.select(F.col("doc_id").alias("diff_id"), F.concat(first, second).alias("diff_text"))


@query
def changed_signatures(spark, sf):
    """SET-2: functions whose definition is removed and added in one hunk."""
    return diff.changed_functions(diff.diff_lines(_function_diffs(spark, sf))).select("diff_id", "filename", "name", "description")


@query
def function_gate(spark, sf):
    """FLT-17: whether a diff touches a function's definition."""
    return diff.touches_functions(diff.diff_lines(_function_diffs(spark, sf)))


@query
def changed_call_sites(spark, sf):
    """JOIN-8, SRT-5, PRJ-16: calls of changed functions in other files."""
    lines = diff.diff_lines(_function_diffs(spark, sf))
    return diff.call_sites(diff.changed_functions(lines), lines)


@query
def synthesis(spark, sf):
    """SRT-1, SRT-2, JOIN-3, AGG-6, FLT-7/8: findings of ten reviews, gated, merged, capped at 25 and put in order."""
    f = P.findings(spark, sf).withColumns({"review_id": F.substring("file_path", 1, 1), "diff_position": (F.col("ord") % 4).cast("int")}).drop("rank")
    return findings.synthesise(f).select("review_id", "file_path", "ord", "pos")


@query
def dedup_views(spark, sf):
    """PRJ-22: the list of findings that a model is asked to thin out."""
    f = P.findings(spark, sf).withColumns({"review_id": F.col("file_path"), "pos": F.col("ord"), "title": F.lit("t"), "body": F.lit("b")})
    return findings.dedup_view(f).select("review_id", F.sha2("view", 256).alias("view_sha"))


@query
def review_log(spark, sf):
    """SNK-2: reviews from their log; a purchase completes one."""
    e = table(spark, sf, "events")
    log = e.select(F.col("user_id").alias("review_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type")).alias("status"), F.col("ts").alias("at"))
    rows = reviews.review_state(log)
    return rows.select("review_id", F.when(F.col("status") == "completed", "purchase").otherwise(F.col("status")).alias("status"), "seq", "started_at", "completed_at")


@query
def vector_upsert(spark, sf):
    """SNK-5: chunks put in by key over older ones, and new keys appended."""
    d = P.documents(spark, sf).select("doc_id")
    old, new = d.withColumn("commit_sha", F.lit("old")), d.where("doc_id % 3 = 0").withColumn("commit_sha", F.lit("new"))
    more = d.where("doc_id % 5 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("commit_sha"))
    return indexing.upsert(old, new.unionByName(more), ["doc_id"])


@query
def kv_round_trip(spark, sf):
    """SNK-8, SRC-9: values put with an expiry and read back between two expiries."""
    e, path = table(spark, sf, "events"), streams.folder_until_end(spark, "kv") + "/log"
    at = F.lit("2024-01-01").cast("timestamp")
    for kind, seconds in (("error", 60), ("click", 10)):
        sinks.kv_put(e.where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.col("event_id").alias("value")), path, seconds, at)
    return readers.kv_get(e.select(F.col("user_id").alias("key")).distinct(), spark.read.parquet(path), at + F.expr("INTERVAL 30 SECONDS"))


@query
def installation_state(spark, sf):
    """SNK-3, SNK-4: repositories of installations after additions, removals and ends, put back where they come again."""
    e = table(spark, sf, "events")
    end = F.when(F.col("event_id") % 50 == 0, "installation_deleted").otherwise("noop")
    route = F.when(F.col("event_type") == "signup", "installation_created").when(F.col("event_type") == "click", "repos_added").when(F.col("event_type") == "view", "repos_removed").when(F.col("event_type") == "error", end).otherwise("noop")
    repo = F.array(F.struct(F.col("user_id").alias("id"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("full_name")))
    return indexing.installed(e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 20).alias("installation_id"), route.alias("route"), repo.alias("repos")))


@query
def status_table(spark, sf):
    """AGG-7: files by status."""
    d = table(spark, sf, "documents")
    status = F.element_at(F.array(*map(F.lit, ("added", "modified", "removed"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return diff.status_counts(d.select(F.col("doc_id").alias("diff_id"), status.alias("status")))


@query
def changed_line_table(spark, sf):
    """AGG-8: distinct lines of the new file that the diff shows."""
    return diff.changed_lines(diff.diff_lines(P.diffs(spark, sf)))


@query
def function_name_lists(spark, sf):
    """AGG-9: distinct names in first-seen order."""
    c = table(spark, sf, "conversations")
    h = c.select(F.col("conv_id").alias("diff_id"), F.lit("f").alias("filename"), F.col("turn").alias("hunk_ord"), F.col("role").alias("ast_function_context"))
    return diff.function_names(h).select("diff_id", F.array_join("names", ",").alias("names"))


@query
def text_matches(spark, sf):
    """FLT-12: documents that hold all words of a name."""
    d = P.documents(spark, sf)
    return d.where(retrieval.text_match(F.col("content"), "the and")).select("doc_id")


@query
def review_gates(spark, sf):
    """FLT-18, FLT-19, FLT-20, FLT-21: gates of a review and of its stages, and what indexing does with a file."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    status = F.when(F.col("event_type") == "error", "removed").when(F.col("event_type") == "click", "renamed").otherwise("other")
    rows = routing.review_gate(e.withColumns({"files": i % 4, "enabled": F.col("event_type") != "error", "reviewable_files": i % 3}))
    return rows.select("event_id", "gate", routing.rag_gate(i % 7, i % 2 == 0).alias("rag"), routing.style_gate(F.when(F.col("event_type") == "view", i % 2 == 0)).alias("style"), routing.index_action(status).alias("action"))


@query
def point_lookup(spark, sf):
    """SRC-8: one row by its key."""
    return readers.by_key(table(spark, sf, "customer"), "c_custkey", 42).select("c_custkey", "c_name")


@query
def payload_scroll(spark, sf):
    """SRC-6: a filtered scan, at most 100 rows; the filter leaves fewer."""
    return indexing.table_rows(table(spark, sf, "nation"), F.col("n_regionkey") == 1).select("n_nationkey", "n_name")


@query
def indexed_chunk_ids(spark, sf):
    """SRC-7: ids stored for a file at a commit."""
    d = P.documents(spark, sf)
    c = chunking.header_chunks(d, ["repo_id", "doc_id"]).withColumn("commit_sha", F.lit("s"))
    one = c.withColumns({"file_path": F.col("doc_id").cast("string"), "repo_id": F.lit(1)})
    return indexing.indexed_ids(one, 1, "7", "s")


@query
def reviewed_counts(spark, sf):
    """AGG-3: files and hunks of each diff."""
    lines = diff.diff_lines(P.diffs(spark, sf))
    return reviews.reviewed(lines.select("diff_id", "file_ord", "hunk_ord").distinct())


@query
def bug_prompts(spark, sf):
    """JOIN-6, UDF-9, SRT-6: each file's prompt with the context that was found for it."""
    d = P.documents(spark, sf)
    files = d.select("doc_id", F.col("repo_id").alias("diff_id"), F.col("file_path").alias("filename"), "content")
    found = d.where("doc_id % 2 = 0").select(F.col("repo_id").alias("diff_id"), F.col("file_path").alias("filename"), F.concat(F.lit("ctx"), F.col("doc_id").cast("string")).alias("section"))
    rows = retrieval.enriched_files(files, found)
    text = models.stage_prompt("bug", filename=F.col("filename"), context=F.col("section"), diff=F.col("content"))
    return rows.select("doc_id", F.sha2(text, 256).alias("prompt_sha"))


@query
def cached_descriptions(spark, sf):
    """UDF-10: descriptions of changes, half of them from a cache."""
    lines = diff.diff_lines(P.diffs(spark, sf))
    key = C.short_hash(F.col("query_text"))
    cache = diff.query_text(lines).where(key < "8").select(key.alias("key"), F.lit("known").alias("value"), F.lit("2100-01-01").cast("timestamp").alias("expires_at")).distinct()
    return diff.described(lines, cache, F.lit("2024-01-01").cast("timestamp")).select("diff_id", "hit", "description")


def _describer(prompt: str) -> tuple[str, int, int]:
    """Stands for a service that fails on long texts."""
    if len(prompt) > 300:
        raise OSError("too long")
    return f" said {len(prompt)} ", 1, 1


@query
def told_descriptions(spark, sf):
    """UDF-10: descriptions of changes from a cache, else from a model, else the head of the text."""
    lines = diff.diff_lines(P.diffs(spark, sf))
    key = C.short_hash(F.col("query_text"))
    cache = diff.query_text(lines).where(key < "8").select(key.alias("key"), F.lit("known").alias("value"), F.lit("2100-01-01").cast("timestamp").alias("expires_at")).distinct()
    rows = diff.described(lines, cache, F.lit("2024-01-01").cast("timestamp"))
    return models.describe_missing(rows, [_describer], ["small"], pause=0).select("diff_id", "hit", "model", "description")


@query
def settings_rows(spark, sf):
    """SRC-5: settings from YAML that is absent, whole, partly of the wrong type, or no YAML."""
    i = F.col("doc_id")
    whole = F.concat(F.lit("review:\n  ignore_patterns: ['a/*', b]\n  style: false\n  custom_guidelines: be kind "), i.cast("string"), F.lit("\n"))
    texts = {1: F.lit("review:\n  enabled: false\n  severity_threshold: high\n"), 2: whole, 3: F.lit(": not yaml: ["), 4: F.lit("review:\n  enabled: 'yes'\n  severity_threshold: huge\n  ignore_patterns: [1]\n"), 5: F.lit("other: 1")}
    text = F.lit(None).cast("string")
    for n, t in texts.items():
        text = F.when(i % 6 == n, t).otherwise(text)
    rows = readers.config_rows(table(spark, sf, "documents").select(i.alias("repo_id"), text.alias("content")))
    return rows.withColumn("ignore_patterns", F.array_join("ignore_patterns", ","))


def _post(rows: list[dict]) -> None:
    """Stands for a service that refuses a batch with a bad row in it."""
    if any(r["doc_id"] % 97 == 5 for r in rows):
        raise ValueError("bad row")


@query
def post_rejects(spark, sf):
    """SNK-9, SNK-11: rows posted in batches, then one by one; those that are refused alone, in a table made for them."""
    path = streams.folder_until_end(spark, "posts") + "/rejects"
    sinks.ensure_table(spark, path, "row string, error string")
    sinks.post_rows(table(spark, sf, "documents").select("doc_id"), _post, path, batch=20, pause=0)
    return sinks.ensure_table(spark, path, "row string, error string")


# --- beyond SQL --------------------------------------------------------------


@query
def route_stream(spark, sf):
    """§2.11, SRC-4: events replayed as a stream of deliveries, routed and logged batch by batch."""
    root = streams.folder_until_end(spark, "routes")

    def deliveries(e: DataFrame) -> DataFrame:
        user = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("login"))
        body = F.to_json(F.struct(F.lit("opened").alias("action"), F.struct(user.alias("user"), F.col("event_id").alias("number"), (F.col("event_type") == "error").alias("draft")).alias("pull_request")))
        return streams.routed(e.select(F.col("event_id").cast("string").alias("delivery_id"), F.lit("pull_request").alias("event"), body.alias("body")))

    out = streams.replay(spark, sf, "events", f"{root}/checkpoint", deliveries, f"{root}/out")
    return out.select("delivery_id", "author", "route", "should_process", "queue")


@query
def embed_cached(spark, sf):
    """UDF-1, JOIN-12: embeddings of all documents, each distinct text once."""
    d = P.documents(spark, sf).select("doc_id", F.coalesce("content", F.lit("")).alias("text"))
    empty = spark.createDataFrame([], "key string, value array<float>")
    return models.embed_missing(d, empty, models.hashing_embedder(16)).select("doc_id", "key", "value")


@query
def suggestion_checks(spark, sf):
    """UDF-6, FLT-22: the whole content of each document, checked as Python."""
    d = P.documents(spark, sf)
    return models.validate_suggestions(d.select("doc_id", F.col("content").alias("suggestion_code"), F.lit("python").alias("language"), F.lit(1).alias("line_start"), (F.col("doc_id") % 9).cast("int").alias("line_end"))).select("doc_id", "is_valid", "error", "fixed_code")


@query
def kv_stream(spark, sf):
    """SNK-8, SRC-9, §2.11: events as puts and gets of a cache on a stream of several batches; values expire after one or six hours."""
    ops = P.cache_ops(spark, sf)
    root = streams.folder_until_end(spark, "cache")
    # Two late operations of their own key move the watermark past all others.
    end = ops.agg(F.max("at").alias("at")).select(F.expr("explode(array(-1L, -2L))").alias("op_id"), (F.col("at") + F.expr("INTERVAL 100 DAYS")).alias("at"), F.lit("get").alias("kind"), F.lit("end").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("seconds"))
    ops.repartitionByRange(4, "at").write.parquet(f"{root}/ops")
    for _ in range(2):
        end.coalesce(1).write.mode("append").parquet(f"{root}/ops")
    got = expiring.cache_stream(streams.file_stream(spark, f"{root}/ops", expiring.OPS, per_trigger=1), "40 days")
    streams.write_batches(got, streams.log_sink(f"{root}/out"), f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(expiring.ANSWERS).parquet(f"{root}/out").where("op_id >= 0").select("op_id", "key", "value")


@query
def kv_answers(spark, sf):
    """SNK-8, SRC-9: the same puts and gets as a batch, by one window."""
    return expiring.cache_answers(P.cache_ops(spark, sf))


@query
def syntax_table(spark, sf):
    """UDF-4: functions and classes of a source in each of six languages that holds the whole content of a document in a comment and brackets in a text."""
    return models.syntax_nodes(P.sources(spark, sf)).select("file_path", "node_type", "name", "start_row", "end_row", "node_ord")


@query
def import_table(spark, sf):
    """UDF-5: import statements of the same sources."""
    return models.imports(P.sources(spark, sf)).select("file_path", "import_ord", "statement")


@query
def syntax_marks(spark, sf):
    """UDF-11: brackets without partner in the same sources, with some opened and some closed too often."""
    return models.syntax_errors(P.sources(spark, sf, broken=True).where(~F.col("file_path").endswith(".py"))).select("file_path", "error_ord", "what", "row")


@query
def syntax_chunks(spark, sf):
    """PRJ-26, PRJ-24: chunks of these sources; files that parse by function and class, the others by windows of lines."""
    files = P.sources(spark, sf, broken=F.col("doc_id") % 4 == 0)
    return chunking.chunks_with_nodes(models.with_nodes(files)).select("file_path", "chunk_type", "name", "start_line", "end_line")


@query
def whole_review(spark, sf):
    """End to end: diffs of up to four files through gate, linters and stored replies to the comments that are posted."""
    many, config, lint, replies = P.review_input(spark, sf)
    return review.review(many, config, lint, review.Replies(**replies)).comments.select("review_id", "pos", "path", "position", "start_line", "line", "body")


@query
def whole_review_summaries(spark, sf):
    """End to end: the summary of each review that isn't ended early."""
    many, config, lint, replies = P.review_input(spark, sf)
    return review.review(many, config, lint, review.Replies(**replies)).summaries


@query
def table_upserts(spark, sf):
    """SNK-5, SNK-7: documents in a snapshot table, put in over older ones, deleted by key and by filter, compacted twice."""
    d = P.documents(spark, sf).select("doc_id", "repo_id", F.lit("old").alias("commit_sha"))
    t = SnapshotTable.create(spark, streams.folder_until_end(spark, "table"), "doc_id long, repo_id string, commit_sha string", ["doc_id"], 16)
    t.put(d)
    t.compact()
    t.put(d.where("doc_id % 3 = 0").withColumn("commit_sha", F.lit("new")).unionByName(d.where("doc_id % 5 = 0").withColumns({"doc_id": F.col("doc_id") + 1000000, "commit_sha": F.lit("new")})))
    t.delete(d.where("doc_id % 11 = 0").select("doc_id"))
    t.delete_where(F.col("repo_id") == "src1")
    t.compact()
    t.put(d.where("doc_id % 13 = 0").withColumn("commit_sha", F.lit("late")))
    return t.read()


def _word_index(spark, sf, pattern):
    index = postings.Index(spark, streams.folder_until_end(spark, "index"), 16, pattern)
    index.add(P.documents(spark, sf).where("content IS NOT NULL").select("repo_id", F.col("doc_id").cast("string").alias("chunk_id"), "file_path", F.lit(1).alias("start_line"), "content"))
    return index


@query
def stored_text_matches(spark, sf):
    """FLT-12: documents that hold all words of a name, from a stored inverted index."""
    names = P.documents(spark, sf).select("repo_id").distinct().select(F.col("repo_id").alias("query_id"), "repo_id", F.lit("the AND").alias("name"))
    return _word_index(spark, sf, postings.WORD).holding(names).select(F.col("chunk_id").cast("long").alias("doc_id"))


@query
def stored_callers(spark, sf):
    """JOIN-9, SRT-3: the first ten files of each repository that hold a keyword, from a stored inverted index."""
    words = F.explode(F.array(*map(F.lit, ("the", "und", "les", "de")))).alias("name")
    names = P.documents(spark, sf).select("repo_id").distinct().select("repo_id", words).select(F.concat_ws(":", "repo_id", "name").alias("query_id"), "repo_id", "name", F.array().cast("array<string>").alias("exclude"))
    return _word_index(spark, sf, "[a-z]+").callers(names).select("query_id", F.col("chunk_id").cast("long").alias("chunk_id"), "rank")


@query
def index_lane(spark, sf):
    """SRC-13, SNK-10, §2.11: chunks as a stream of three batches into a snapshot table; what is there at its commit isn't put in again."""
    i, root = F.col("doc_id"), streams.folder_until_end(spark, "lane")
    rows = table(spark, sf, "documents").select((i % 3).alias("repo_id"), F.concat(F.lit("c"), (i % 300).cast("string")).alias("chunk_id"), "source", F.format_string("s%06d", F.floor(i / 300)).alias("commit_sha"), i.alias("doc_id"), F.col("source").alias("file_path"))
    schema = rows.drop("source").schema
    third = rows.agg(F.percentile_approx("doc_id", F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0]
    for lo, hi in zip([-1, *third], [*third, 1 << 62], strict=True):
        rows.drop("source").where((i > lo) & (i <= hi)).coalesce(1).write.mode("append").parquet(f"{root}/chunks")
    t = SnapshotTable.create(spark, f"{root}/table", schema, index_stream.KEYS, 8)
    index_stream.run_lane(streams.file_stream(spark, f"{root}/chunks", schema, per_trigger=1), t, "full", f"{root}/checkpoint").awaitTermination()
    return t.read().select("repo_id", "chunk_id", "commit_sha")


def _first_client(prompt: str) -> tuple[str, int, int]:
    """Stands for a service: down for some prompts, talkative for others unless told not to be."""
    n = int(prompt.split(":")[1].split("\n")[0])
    if n % 7 == 0:
        raise OSError("down")
    return ('{"n": 1}' if n % 5 or prompt.endswith("only.") else "well"), len(prompt), 3


def _second_client(prompt: str) -> tuple[str, int, int]:
    n = int(prompt.split(":")[1].split("\n")[0])
    if n % 14 == 0:
        raise OSError("down")
    return "[]", 1, 1


@query
def model_replies(spark, sf):
    """UDF-2: replies to a prompt for each document, five in flight for each task; a second client where the first fails, one more try where the reply isn't JSON."""
    prompts = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("prompt_id"), F.concat(F.lit("id:"), F.col("doc_id").cast("string"), F.lit("\n")).alias("prompt"))
    return models.complete(prompts, [_first_client, _second_client], ["first", "second"], pause=0).select("prompt_id", "response", "model", "input_tokens", "output_tokens", "attempts", "error")


@query
def stage_prompts(spark, sf):
    """UDF-9, SRT-6: the prompts of the other four stages for each document."""
    d = P.documents(spark, sf)
    text = F.col("content")
    made = {
        "summary": models.stage_prompt("summary", title=F.col("file_path"), diff=text),
        "xfile": models.stage_prompt("xfile", description=F.col("repo_id"), diff=text),
        "style": models.stage_prompt("style", filename=F.col("file_path"), guidelines=F.col("repo_id"), diff=text),
        "dedup": models.stage_prompt("dedup", findings=text),
    }
    return d.select("doc_id", *(F.sha2(p, 256).alias(f"{stage}_sha") for stage, p in made.items()))


@query
def started_reviews(spark, sf):
    """SNK-1: log rows of reviews that begin."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("pr_number"), F.lit("t").alias("pr_title"), F.col("o_orderstatus").alias("head_sha"), F.lit("b").alias("base_sha"))
    return sinks.start_reviews(o, F.lit("2024-01-01").cast("timestamp")).select("review_id", "repo_id", "pr_number", "status", "stage", "seq")


@query
def finding_memory(spark, sf):
    """SNK-6: findings appended twice to the memory; repeats accumulate under ids of their own."""
    f, path = P.findings(spark, sf).select("review_id", "ord", "category"), streams.folder_until_end(spark, "memory") + "/rows"
    for n in (1, 2):
        sinks.append(reviews.past_finding_rows(f.withColumn("occurrence", F.lit(n))), path)
    return spark.read.parquet(path).select("finding_id", "category", "occurrence")


@query
def dispatched_jobs(spark, sf):
    """SNK-10: jobs as files of their queue."""
    path = streams.folder_until_end(spark, "jobs") + "/queues"
    sinks.dispatch(table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", "slow").otherwise("fast").alias("queue")), path)
    return spark.read.parquet(path).select("event_id", F.col("queue").cast("string").alias("queue"))


@query
def reviewed_files(spark, sf):
    """JOIN-7, SET-5: reviewable files that the repository's settings don't ignore."""
    d = P.documents(spark, sf).select(F.col("repo_id").alias("diff_id"), F.col("file_path").alias("filename"))
    config = d.select("diff_id").distinct().where("diff_id <> 'src2'").withColumn("ignore_patterns", F.when(F.col("diff_id") == "src1", F.array(F.lit("src1/*"))).otherwise(F.array(F.lit("*.[gG]O"))))
    return routing.review_files(d, config)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in _found}
