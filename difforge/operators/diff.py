"""Unified diffs as typed line tables.

All operators take and give flat rows keyed by (diff_id, file_ord, hunk_ord, line_ord). A diff is one row, so its lines are numbered where it is
read: the lines of an Arrow batch of diffs are one array, and files, hunks and positions are running counts over it, less the count where
the stretch began. No line is shuffled for it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import values as V


def segment(lines: DataFrame, keys: list[str], order: str, starts: Column, out: str) -> DataFrame:
    """Number the stretches that begin where ``starts`` holds; 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(out, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w).cast("int"))


_LINES = "line_ord int, text string, file_ord int, hunk_ord int, is_header boolean, line_type string, old_lineno int, new_lineno int, diff_position int, filename string"
_HEADER = re.compile(V.HUNK_HEADER)


def _start(digits: str) -> int:
    return n if (n := int(digits)) < 1 << 31 else 1


def _number_lines(batches):
    """Every line of a file of every diff: its file, hunk and position; line_type is null where a line takes no position."""
    for b in batches:
        lists = pc.split_pattern(b.column(1), "\n")
        flat, first = lists.flatten(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        n = len(flat)
        at = np.arange(n)
        row = np.repeat(np.arange(b.num_rows), np.diff(first))
        starts = lambda x: pc.starts_with(flat, x).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        ats = starts("@@")
        header = np.zeros(n, bool)
        old_start, new_start = np.ones(n, np.int64), np.ones(n, np.int64)
        for i in np.flatnonzero(ats):
            if m := _HEADER.match(flat[int(i)].as_py()):
                header[i], old_start[i], new_start[i] = True, _start(m[1]), _start(m[3])
        is_file = starts("diff --git ")
        latest = lambda flags: np.maximum.accumulate(np.where(flags, at, -1)) if n else at  # noqa: B023, E731
        file_at = latest(is_file)
        inside = file_at >= first[row]
        count = lambda flags: np.cumsum(flags)
        since = lambda total, begin: total - total[np.maximum(begin, 0)]
        files = count(is_file)
        file_ord = np.where(inside, files - (files - is_file)[np.minimum(first[row], max(n - 1, 0))], 0)
        hunk_ord = np.where(inside, since(count(header), file_at), 0)
        plus, minus = starts("+"), starts("-")
        empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
        counted = inside & (hunk_ord > 0) & (header | ~(ats | empty | starts("\\ No newline at end of file")))
        kind = np.select([~counted, header, plus, minus], [0, 1, 2, 3], 4)
        hunk_at = latest(header)
        old = np.where((kind == 3) | (kind == 4), old_start[np.maximum(hunk_at, 0)] - 1 + since(count((kind == 3) | (kind == 4)), hunk_at), -1)
        new = np.where((kind == 2) | (kind == 4), new_start[np.maximum(hunk_at, 0)] - 1 + since(count((kind == 2) | (kind == 4)), hunk_at), -1)
        position = since(count(counted), file_at)

        # A file's name: its last +++ line before the first hunk, unless a mark of a new file stands before that; else its first line's.
        meta = inside & (hunk_ord == 0)
        named = np.full(n, -1)
        for i in np.flatnonzero(meta & starts("+++ b/")):
            named[file_at[i]] = i
        fresh = np.full(n, n)
        for i in np.flatnonzero(meta & (starts("new file mode") | pc.equal(flat, "--- /dev/null").to_numpy(zero_copy_only=False)))[::-1]:
            fresh[file_at[i]] = i
        names = {}
        for i in np.flatnonzero(is_file):
            text = flat[int(i)].as_py()
            if named[i] >= 0 and fresh[i] > named[i]:
                names[i] = flat[int(named[i])].as_py()[6:]
            else:
                names[i] = m[2] if (m := re.match(r"diff --git a/(.*) b/(.*)$", text)) else text
        keep = np.flatnonzero(inside)
        ids = list(names)
        which = np.searchsorted(ids, file_at[keep]) if ids else keep
        int32 = lambda x, ok: pa.array(x[keep].astype(np.int32), mask=~ok[keep])  # noqa: B023, E731
        yes = np.ones(n, bool)
        yield pa.record_batch(
            [
                b.column(0).take(pa.array(row[keep])), int32(at - first[row], yes), flat.take(pa.array(keep)).cast(pa.string()), int32(file_ord, yes), int32(hunk_ord, yes), pa.array(header[keep]),
                pa.array(np.array([None, "header", "added", "removed", "context"], object)[kind[keep]], pa.string()), int32(old, old >= 0), int32(new, new >= 0), int32(position, counted),
                pa.array(list(names.values()), pa.string()).take(pa.array(which)),
            ],
            names=["diff_id", *(f.split(" ")[0] for f in _LINES.split(", "))],
        )


def raw_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, line_ord, text, file_ord, hunk_ord, is_header, line_type and numbers of each line that belongs to a file."""
    some = diffs.where(F.col("diff_text").rlike(r"\S")).select("diff_id", C.unix_lines(F.col("diff_text")).alias("diff_text"))
    return some.mapInArrow(_number_lines, f"diff_id {diffs.schema['diff_id'].dataType.simpleString()}, {_LINES}")


def diff_files(diffs: DataFrame) -> DataFrame:
    """One row per file: diff_id, file_ord, filename, old_filename, status, language, is_binary, additions, deletions."""
    return files_of(raw_lines(diffs))


def files_of(lines: DataFrame) -> DataFrame:
    t, meta = F.col("text"), F.col("hunk_ord") == 0
    git = r"^diff --git a/(.*) b/(.*)$"
    new_file = t.startswith("new file mode") | (t == "--- /dev/null")
    status = (
        F.when(new_file, "added")
        .when(t.startswith("deleted file mode") | (t == "+++ /dev/null"), "removed")
        .when(t.startswith("similarity index") | t.startswith("rename from"), "renamed")
    )
    first = F.max(F.when(t.startswith("diff --git "), t))
    added_before = F.min(F.when(meta & new_file, F.col("line_ord")))
    plus_ord = F.max(F.when(meta & t.rlike(r"^\+\+\+ b/"), F.col("line_ord")))
    plus = F.max_by(F.regexp_extract(t, r"^\+\+\+ b/(.*)$", 1), F.when(meta & t.rlike(r"^\+\+\+ b/"), F.col("line_ord")))
    body = (F.col("hunk_ord") > 0) & ~t.startswith("@@")
    out = lines.groupBy("diff_id", "file_ord").agg(
        first.alias("head"),
        F.max_by(status, F.when(meta & status.isNotNull(), F.col("line_ord"))).alias("marked"),
        F.when(added_before.isNull() | (added_before > plus_ord), plus).alias("plus"),
        F.bool_or(meta & t.startswith("Binary files")).alias("is_binary"),
        F.count_if(body & t.startswith("+")).alias("additions"),
        F.count_if(body & t.startswith("-")).alias("deletions"),
    )
    matched = F.col("head").rlike(git)
    old, new = F.regexp_extract("head", git, 1), F.regexp_extract("head", git, 2)
    old_name = F.when(matched & (old != new), old)
    name = F.coalesce("plus", F.when(matched, new).otherwise(F.col("head")))
    status = F.coalesce("marked", F.when(old_name.isNotNull(), "renamed").otherwise("modified"))
    return out.select("diff_id", "file_ord", name.alias("filename"), old_name.alias("old_filename"), status.alias("status"), C.diff_language(name).alias("language"), "is_binary", "additions", "deletions")


def hunks_of(lines: DataFrame) -> DataFrame:
    """One row per hunk: header fields; counts default to 1, the trailing context is null if blank."""
    g = lambda i: F.regexp_extract("text", V.HUNK_HEADER, i)
    num = lambda i: F.coalesce(F.try_to_number(F.nullif(g(i), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(1))
    context = F.nullif(F.trim(g(5)), F.lit(""))
    return lines.where("is_header").select(
        "diff_id", "file_ord", "hunk_ord", num(1).alias("old_start"), num(2).alias("old_count"), num(3).alias("new_start"), num(4).alias("new_count"), F.col("text").alias("header"), context.alias("function_context")
    )


def diff_hunks(diffs: DataFrame) -> DataFrame:
    return hunks_of(raw_lines(diffs))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, file_ord, filename, language, hunk_ord, line_ord, content, line_type, old_lineno, new_lineno, diff_position.

    Headers take a position but give no row; ``\\ No newline`` markers and empty lines take none.
    """
    t = F.col("text")
    content = F.when(t.rlike(r"^[+\- ]"), F.substr(t, F.lit(2))).otherwise(t)
    return raw_lines(diffs).where("line_type <> 'header'").select(
        "diff_id", "file_ord", "filename", C.diff_language(F.col("filename")).alias("language"), "hunk_ord", "line_ord", content.alias("content"), "line_type", "old_lineno", "new_lineno", "diff_position"
    )


def position_map(lines: DataFrame) -> DataFrame:
    """diff_id, file_path, new_lineno, diff_position of added and context lines; a later line wins."""
    some = lines.where(F.col("line_type").isin("added", "context"))
    return some.groupBy("diff_id", F.col("filename").alias("file_path"), "new_lineno").agg(F.max_by("diff_position", F.struct("file_ord", "line_ord")).alias("diff_position"))


def changed_lines(lines: DataFrame) -> DataFrame:
    """Distinct (diff_id, file_path, line) of lines that the new file has in the diff."""
    return lines.where("line_type <> 'removed' AND new_lineno IS NOT NULL").select("diff_id", F.col("filename").alias("file_path"), F.col("new_lineno").alias("line")).distinct()


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("diff_id", "status").agg(F.count(F.lit(1)).alias("files"))


def _joined(value: Column, *order: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("_v"))))
    return F.array_join(F.transform(rows, lambda r: r["_v"]), "\n")


def render_hunks(lines: DataFrame) -> DataFrame:
    """Each hunk as text with line numbers and +/- marks: diff_id, filename, file_ord, hunk_ord, rendered."""
    mark = F.when(F.col("line_type") == "added", "+").when(F.col("line_type") == "removed", "-").otherwise(" ")
    number = F.coalesce(F.nullif("new_lineno", F.lit(0)), "old_lineno", F.lit(0))
    return lines.groupBy("diff_id", "filename", "file_ord", "hunk_ord").agg(_joined(F.format_string("%4d %s %s", number, mark, F.col("content")), "line_ord").alias("rendered"))


def query_text(lines: DataFrame, limit: int = 500) -> DataFrame:
    """Added lines of each file's first hunk that has any, cut to ``limit`` characters."""
    added = lines.where("line_type = 'added'").groupBy("diff_id", "filename", "file_ord", "hunk_ord").agg(_joined(F.col("content"), "line_ord").alias("t"))
    return added.groupBy("diff_id", "filename", "file_ord").agg(F.substring(F.min_by("t", "hunk_ord"), 1, limit).alias("query_text"))


def describe_change(lines: DataFrame, limit: int = 200) -> DataFrame:
    """The description used where no model is at hand: the head of the query text."""
    return query_text(lines).withColumn("description", F.substring("query_text", 1, limit))


def described(lines: DataFrame, cache: DataFrame, now: Column, limit: int = 200) -> DataFrame:
    """Descriptions of changes, from ``cache`` (key, value, expires_at) where it has a live one: adds key, hit.

    The key is the hash of the query text; a description that was made anew is to be put for seven days under it.
    """
    made = describe_change(lines, limit).withColumn("key", C.short_hash(F.col("query_text")))
    alive = cache.where(F.col("expires_at") > now).groupBy("key").agg(F.max_by("value", F.struct("expires_at", "value")).alias("value"))
    rows = made.join(alive, "key", "left")
    return rows.withColumn("hit", F.col("value").isNotNull()).withColumn("description", F.coalesce("value", "description")).drop("value")


def context_around(lines: DataFrame, reach: int = 10) -> DataFrame:
    """For each line, the text of up to ``reach`` hunk lines on either side, removed ones left out."""
    w = Window.partitionBy("diff_id", "file_ord", "hunk_ord").orderBy("line_ord").rowsBetween(-reach, reach)
    near = F.collect_list(F.struct("line_type", "new_lineno", "old_lineno", "content")).over(w)
    kept = F.filter(near, lambda r: r["line_type"] != "removed")
    number = lambda r: F.coalesce(F.nullif(r["new_lineno"], F.lit(0)), r["old_lineno"])
    text = F.array_join(F.transform(kept, lambda r: F.concat(F.lpad(F.coalesce(number(r).cast("string"), F.lit("?   ")), 4, " "), F.lit(" "), r["content"])), "\n")
    return lines.withColumn("context", text)


def scope_context(hunks: DataFrame, files: DataFrame, reach: int = 5) -> DataFrame:
    """File lines from ``reach`` before to ``reach`` after each hunk: hunks (diff_id, file_path, hunk_ord, new_start, new_count), files (file_path, content)."""
    rows = hunks.join(files.select("file_path", C.split_lines(F.col("content")).alias("ls")), "file_path")
    end = F.col("new_start") + F.col("new_count") - 1
    lo, hi = F.greatest(F.col("new_start") - 1 - reach, F.lit(0)), F.least(end + reach, F.size("ls"))
    part = F.slice("ls", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    return rows.select("diff_id", "file_path", "hunk_ord", F.array_join(part, "\n").alias("scope_context"))


def _function_name() -> Column:
    out = F.lit(None).cast("string")
    for lang, pattern in V.FUNCTION_NAMES.items():
        groups = [F.regexp_extract("content", pattern, i) for i in range(V.FUNCTION_GROUPS[lang], 0, -1)]
        name = F.coalesce(*(F.when(g.rlike(r"^\w+$"), g) for g in groups))
        out = F.when(F.col("language") == lang, name).otherwise(out)
    return out


def changed_functions(lines: DataFrame) -> DataFrame:
    """Functions whose definition line is both removed and added in one hunk: diff_id, filename, hunk_ord, name, description."""
    named = lines.withColumn("name", _function_name()).where("name IS NOT NULL")
    both = named.groupBy("diff_id", "filename", "file_ord", "hunk_ord", "name").agg(F.bool_or(F.col("line_type") == "added").alias("a"), F.bool_or(F.col("line_type") == "removed").alias("r"))
    text = F.concat(F.lit("Function `"), "name", F.lit("` signature was modified in `"), "filename", F.lit("`"))
    return both.where("a AND r").select("diff_id", "filename", "file_ord", "hunk_ord", "name", text.alias("description"))


def touches_functions(lines: DataFrame) -> DataFrame:
    """The gate of the cross-file stage, by diff: does any added or removed line define a function?"""
    hit = F.lit(False)
    for lang, pattern in V.FUNCTION_LINES.items():
        hit = hit | ((F.col("language") == lang) & F.col("content").rlike(pattern))
    return lines.groupBy("diff_id").agg(F.bool_or(F.coalesce(hit, F.lit(False)) & F.col("line_type").isin("added", "removed")).alias("touches_functions"))


def call_sites(functions: DataFrame, lines: DataFrame, limit: int = V.MAX_CALL_SITES) -> DataFrame:
    """Calls of changed functions in other files of the diff, at most ``limit`` for each function.

    Called names are extracted once and joined by equality, so no pattern is tried against every line.
    """
    site = context_around(lines).where("line_type <> 'removed'")
    called = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b(\w+)\s*\("), F.lit(1)))
    site = site.select("diff_id", F.col("filename").alias("site_file"), F.coalesce("new_lineno", F.lit(0)).alias("line"), F.col("context").alias("code"), F.col("file_ord").alias("site_ord"), "line_ord", F.explode(called).alias("name"))
    wanted = functions.select("diff_id", F.col("filename").alias("changed_file"), "name").distinct()
    hits = site.join(wanted, ["diff_id", "name"]).where("site_file <> changed_file")
    w = Window.partitionBy("diff_id", "changed_file", "name").orderBy("site_ord", "line_ord")
    return hits.withColumn("site_no", F.row_number().over(w)).where(F.col("site_no") <= limit).select("diff_id", "changed_file", "name", "site_file", "line", "code", "site_no")


def function_names(hunks: DataFrame) -> DataFrame:
    """Distinct names of the enclosing functions of a file's hunks, in first-seen order."""
    first = hunks.where("ast_function_context IS NOT NULL AND ast_function_context <> ''").groupBy("diff_id", "filename", "ast_function_context").agg(F.min("hunk_ord").alias("o"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("o", "ast_function_context"))), lambda r: r["ast_function_context"])
    return first.groupBy("diff_id", "filename").agg(names.alias("names"))
