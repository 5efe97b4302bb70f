"""Source text as chunks: (file_path, chunk_type, name, content, start_line, end_line, language, chunk_id, ord).

Files come as (…keys, file_path, content); all other columns of the input are dropped but those in ``keys``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

HEADER_LINES = 50
WINDOW_LINES, WINDOW_OVERLAP = 100, 20
WINDOW_TOKENS, TOKEN_OVERLAP = 512, 128
PART_LINES, PART_OVERLAP, PART_LOOKBACK = 100, 5, 20


def _finish(rows: DataFrame, keys: list[str], kind: str | Column) -> DataFrame:
    return rows.select(
        *keys, "file_path", (F.lit(kind) if isinstance(kind, str) else kind).alias("chunk_type"), "name", "content", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"),
        C.chunk_language(F.col("file_path")).alias("language"), C.chunk_id(F.col("file_path"), F.col("name"), F.col("start_line")).alias("chunk_id"), "ord",
    )


def with_lines(files: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Files that aren't blank, with their lines as an array."""
    rows = files.where(F.col("content").rlike(r"(?U)\S")).select(*keys, "file_path", C.split_lines(F.col("content")).alias("ls"))
    return rows.where(F.size("ls") > 0)


def header_chunks(files: DataFrame, keys: list[str] = (), n: int = HEADER_LINES) -> DataFrame:
    rows = with_lines(files, keys).select(
        *keys, "file_path", F.lit("<file_header>").alias("name"), F.array_join(F.slice("ls", 1, n), "\n").alias("content"),
        F.lit(1).alias("start_line"), F.least(F.lit(n), F.size("ls")).alias("end_line"), F.lit(0).alias("ord"),
    )
    return _finish(rows, list(keys), "file_header")


def line_windows(files: DataFrame, keys: list[str] = (), size: int = WINDOW_LINES, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Windows of ``size`` lines, each starting ``size - overlap`` lines after the one before."""
    starts = F.posexplode(F.sequence(F.lit(0), F.size("ls") - 1, F.lit(size - overlap))).alias("win", "pos")
    rows = with_lines(files, keys).select(*keys, "file_path", "ls", starts)
    rows = rows.select(
        *keys, "file_path", F.format_string("<window_%d>", "win").alias("name"), F.array_join(F.slice("ls", F.col("pos") + 1, size), "\n").alias("content"),
        (F.col("pos") + 1).alias("start_line"), F.least(F.col("pos") + size, F.size("ls")).alias("end_line"), (F.col("win") + 1).alias("ord"),
    )
    return _finish(rows, list(keys), "window")


_TOKEN = re.compile(r"\s*\S+|\s+$", re.ASCII)


def _cut_tokens(text: str, size: int, step: int) -> list[dict]:
    """Windows of a text in one pass: ends of tokens and the line ends before each are counted once."""
    ends = np.array([0, *(m.end() for m in _TOKEN.finditer(text))])
    lines = np.concatenate([[0], np.cumsum([text.count("\n", a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)])]).astype(int)
    n = len(ends) - 1
    return [{"content": text[ends[i] : ends[j := min(i + size, n)]], "start_line": int(lines[i]) + 1, "end_line": int(lines[j]) + 1} for i in range(0, n, step)]


def token_windows(files: DataFrame, keys: list[str] = (), size: int = WINDOW_TOKENS, overlap: int = TOKEN_OVERLAP) -> DataFrame:
    """Windows of ``size`` tokens; a token is a word with the white space before it, so windows join back to the text."""

    @F.pandas_udf("array<struct<content:string,start_line:int,end_line:int>>")
    def cut(text: pd.Series) -> pd.Series:
        return pd.Series([_cut_tokens(t, size, size - overlap) for t in text])

    rows = with_lines(files, keys).select(*keys, "file_path", F.posexplode(cut(F.array_join("ls", "\n"))).alias("win", "w"))
    rows = rows.select(*keys, "file_path", F.format_string("<window_%d>", "win").alias("name"), "w.content", "w.start_line", "w.end_line", (F.col("win") + 1).alias("ord"))
    return _finish(rows, list(keys), "window")


def part_bounds(blanks: Column, compat: bool = False) -> Column:
    """Starts and ends (0-based, exclusive) of the parts of a long function, from an array telling which of its lines are blank.

    A part takes up to PART_LINES lines and prefers to end after the last blank line among its final PART_LOOKBACK;
    the next begins PART_OVERLAP lines before that end. Without ``compat`` the last part is the one that reaches the function's end;
    with it, shrinking tail parts follow, as some callers expect.
    """
    n = F.size(blanks)

    def step(acc: Column, _) -> Column:
        start = acc["next"]
        full = F.least(start + PART_LINES, n)
        back = F.filter(F.sequence(F.lit(1), F.lit(PART_LOOKBACK)), lambda k: (full - k >= start) & F.coalesce(F.try_element_at(blanks, full - k + 1), F.lit(False)))
        end = F.when((full < n) & (F.size(back) > 0), full - F.array_min(back) + 1).otherwise(full)
        after = F.greatest(end - PART_OVERLAP, start + 1)
        stop = n if not compat else F.lit(None).cast("int")
        ahead = F.when(end == stop, n).otherwise(after)
        new = F.struct(F.concat(acc["parts"], F.array(F.struct(start.alias("lo"), end.alias("hi")))).alias("parts"), ahead.cast("int").alias("next"))
        return F.when(start < n, new).otherwise(acc)

    zero = F.struct(F.array().cast("array<struct<lo:int,hi:int>>").alias("parts"), F.lit(0).alias("next"))
    steps = F.floor(n / (PART_LINES - PART_LOOKBACK - PART_OVERLAP)) + PART_OVERLAP + 3  # the least that a part moves on, and the tail
    return F.aggregate(F.sequence(F.lit(1), steps.cast("int")), zero, step)["parts"]


def _cut(spans: DataFrame, keys: list[str], compat: bool = False) -> DataFrame:
    """Chunks of spans (…keys, file_path, kind, name, s, e, ord; lines from 1) of lines ``ls``, in one pass; those of over PART_LINES lines in parts, as functions."""
    body = F.slice("ls", F.col("s"), F.col("e") - F.col("s") + 1)
    long = F.col("e") - F.col("s") + 1 > PART_LINES
    rows = spans.withColumn("body", body).drop("ls").withColumn("long", long)
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.size("body").alias("hi")))
    parts = F.when(F.col("long"), part_bounds(F.transform("body", lambda x: ~x.rlike(r"(?U)\S")), compat)).otherwise(whole)
    rows = rows.select("*", F.posexplode(parts).alias("part", "b"))
    rows = rows.select(
        *keys, "file_path", F.when(F.col("long"), "function").otherwise(F.col("kind")).alias("kind"), F.when(F.col("long"), F.format_string("%s__part%d", "name", "part")).otherwise(F.col("name")).alias("name"),
        F.array_join(F.slice("body", F.col("b.lo") + 1, F.col("b.hi") - F.col("b.lo")), "\n").alias("content"),
        (F.col("s") + F.col("b.lo")).alias("start_line"), F.when(F.col("long"), F.col("s") + F.col("b.hi") - 1).otherwise(F.col("e")).alias("end_line"), "ord",
    )
    return _finish(rows, list(keys), F.col("kind"))


def semantic_chunks(files: DataFrame, nodes: DataFrame, keys: list[str] = (), compat: bool = False) -> DataFrame:
    """Chunks of syntax nodes (…keys, file_path, node_type, name, start_row, end_row, node_ord; rows from 0).

    Short nodes are one chunk; functions of over PART_LINES lines are cut at blank lines.
    """
    rows = with_lines(files, keys).join(nodes, [*keys, "file_path"])
    kind = F.when(F.col("node_type").contains("class"), "class").otherwise("function").alias("kind")
    some = rows.where(f"start_row IS NOT NULL AND end_row IS NOT NULL AND (node_type IS NOT NULL OR end_row - start_row >= {PART_LINES})")
    some = some.select(*keys, "file_path", kind, F.coalesce("name", F.lit("<anonymous>")).alias("name"), (F.col("start_row") + 1).alias("s"), (F.col("end_row") + 1).alias("e"), (F.col("node_ord") + 1).alias("ord"), "ls")
    return _cut(some, list(keys), compat)


def chunks_with_nodes(files: DataFrame, keys: list[str] = ()) -> DataFrame:
    """As ``all_chunks``, of files that carry their nodes as an array (``nodes``: node_type, name, start_row, end_row; null where a file wasn't parsed).

    All chunks of a file come from one reading of its row, and no text is shuffled.
    """
    rows = files.where(F.col("content").rlike(r"(?U)\S")).select(*keys, "file_path", C.split_lines(F.col("content")).alias("ls"), "nodes").where(F.size("ls") > 0)
    n = F.size("ls")
    span = lambda kind, name, s, e, at: F.struct(kind.alias("kind"), name.alias("name"), s.cast("int").alias("s"), e.cast("int").alias("e"), at.cast("int").alias("ord"))
    header = F.array(span(F.lit("file_header"), F.lit("<file_header>"), F.lit(1), F.least(F.lit(HEADER_LINES), n), F.lit(0)))
    starts = F.sequence(F.lit(0), n - 1, F.lit(WINDOW_LINES - WINDOW_OVERLAP))
    windows = F.transform(starts, lambda pos, i: span(F.lit("window"), F.format_string("<window_%d>", i), pos + 1, F.least(pos + WINDOW_LINES, n), i + 1))
    kind = lambda x: F.when(x["node_type"].contains("class"), "class").otherwise("function")
    own = F.transform("nodes", lambda x, i: span(kind(x), F.coalesce(x["name"], F.lit("<anonymous>")), x["start_row"] + 1, x["end_row"] + 1, i + 1))
    spans = rows.select(*keys, "file_path", "ls", F.inline(F.concat(header, F.when(F.col("nodes").isNull(), windows).otherwise(own))))
    return first_by(_cut(spans, list(keys)), [*keys, "chunk_id"], "ord", "start_line", "name")


def first_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def all_chunks(files: DataFrame, nodes: DataFrame | None = None, parsed: DataFrame | None = None, keys: list[str] = ()) -> DataFrame:
    """Header chunk of each file, with its semantic chunks if it was parsed (``parsed``: …keys, file_path), else line windows."""
    on = [*keys, "file_path"]
    out = header_chunks(files, keys)
    if nodes is None or parsed is None:
        out = out.unionByName(line_windows(files, keys))
    else:
        some = files.join(parsed.select(*on).distinct(), on, "left_semi")
        rest = files.join(parsed.select(*on).distinct(), on, "left_anti")
        out = out.unionByName(semantic_chunks(some, nodes, keys)).unionByName(line_windows(rest, keys))
    return first_by(out, [*keys, "chunk_id"], "ord", "start_line", "name")
