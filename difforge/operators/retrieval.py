"""Retrieval: filtered cosine top-k, keyword search, caches and budgets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import columns as C
from ..functions import values as V


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column | str, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, numbered from 1; the planner limits each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


#: Vectors of one side that meet in a task.
BLOCK = 2048
#: A matrix product may differ this much from the exact cosine; candidates within it are computed again, exactly.
SLACK = 1e-9


def _blocks(df: DataFrame, row_id: str, size: int, out: str) -> DataFrame:
    """Adds ``out``, the row's block of its repository, and ``_of``, how many there are; blocks hold ``size`` rows on average."""
    df = df.withColumn("_repo", F.col("repo_id"))
    many = df.groupBy("_repo").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_of"))
    return df.join(many, "_repo").withColumn(out, F.pmod(F.xxhash64(row_id), F.col("_of")).cast("int"))


def _matrices(column) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: (places, vectors as rows, their norms) of vectors that take part; null, zero and non-finite ones don't."""
    by: dict[int, list[int]] = {}
    held = column.to_pylist()
    for i, v in enumerate(held):
        if v and None not in v and any(v) and np.isfinite(v).all():
            by.setdefault(len(v), []).append(i)
    out = {}
    for n, at in by.items():
        m = np.array([held[i] for i in at], np.float64)
        out[n] = np.array(at), m, np.sqrt(_in_order(m * m))
    return out


def _in_order(products: np.ndarray) -> np.ndarray:
    """Sums of rows from first to last, whatever the shape."""
    return np.cumsum(products, axis=1)[:, -1] if products.size else np.zeros(len(products))


def _block_top(k: int, threshold: float, fields: pa.Schema):
    """The best ``k`` chunks of one block for each query of one block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.Table.from_batches([], fields)
        if not left.num_rows or not right.num_rows:
            return none
        skip, paths = [None] * left.num_rows, {}
        if "exclude" in left.column_names:
            skip = left.column("exclude").to_pylist()
            for i, path in enumerate(right.column("file_path").to_pylist()):
                paths.setdefault(path, []).append(i)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        chunks = _matrices(right.column("embedding"))
        for n, (q_at, q, qn) in _matrices(left.column("vector")).items():
            if n not in chunks:
                continue
            c_at, c, cn = chunks[n]
            near = (q @ c.T) / (qn[:, None] * cn[None, :])
            for i, at in enumerate(q_at):
                if gone := [x for p in skip[at] or () for x in paths.get(p, ())]:
                    near[i, np.isin(c_at, gone)] = -np.inf
            best = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
            qi, ci = np.nonzero((near >= np.maximum(best, threshold)[:, None] - SLACK) & np.isfinite(near))
            exact = np.concatenate([np.zeros(0), *(_in_order(q[qi[i : i + BLOCK]] * c[ci[i : i + BLOCK]]) for i in range(0, len(qi), BLOCK))]) / (qn[qi] * cn[ci])
            ok = exact >= threshold
            found.append((q_at[qi[ok]], c_at[ci[ok]], exact[ok]))
        qi, ci, exact = (np.concatenate(x) for x in zip(*found, strict=True))
        rank = np.empty(right.num_rows, np.int64)
        rank[pc.sort_indices(right.column("chunk_id")).to_numpy()] = np.arange(right.num_rows)
        order = np.lexsort((rank[ci], -exact, qi))
        qi, ci, exact = qi[order], ci[order], exact[order]
        first = np.searchsorted(qi, qi)
        keep = np.arange(len(qi)) - first < k
        qi, ci = pa.array(qi[keep]), pa.array(ci[keep])
        cols = {"query_id": left.column("query_id").take(qi), "_cos": pa.array(exact[keep])}
        cols |= {f.name: right.column(f.name).take(ci) for f in fields if f.name not in cols}
        return pa.table([cols[f.name].cast(f.type) for f in fields], schema=fields)

    return run


def similar_chunks(queries: DataFrame, chunks: DataFrame, k: int = 5, threshold: float = V.SCORE_THRESHOLD, exclude: str | None = None, block: int = BLOCK) -> DataFrame:
    """Top ``k`` chunks of the query's own repository by cosine, at or over ``threshold``.

    queries: query_id, repo_id, vector (and ``exclude``, an array of file paths); chunks: repo_id, chunk_id, embedding and whatever is
    to come along, file_path if ``exclude`` is given. Both sides of a repository are cut into blocks and each pair of blocks meets in one
    task as a matrix product, of which at most ``k`` rows a query go on to the merge. Threshold and rank are by the exact
    cosine, summed in order; ``score`` shows six digits of it. Vectors that are null, zero or
    non-finite take no part, and only vectors of one length meet.
    """
    q = queries.select("query_id", "repo_id", "vector", *([F.col(exclude).alias("exclude")] if exclude else []))
    q, c = _blocks(q, "query_id", block, "_q").drop("repo_id"), _blocks(chunks, "chunk_id", block, "_c")
    q = q.select(*(F.col(x).alias(x) for x in q.columns))  # columns of their own, as both sides may stem from one table
    across = lambda df, own, other, n: df.drop("_of").join(n, "_repo").withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    n_q, n_c = (df.groupBy("_repo").agg(F.max("_of").alias("_n")) for df in (q, c))
    pairs = ["_repo", "_q", "_c"]
    kept = [f for f in chunks.schema if f.name != "embedding"]  # repo_id among them
    names = ["query_id", "_cos", *(f.name for f in kept)]
    schema = T.StructType([queries.schema["query_id"], T.StructField("_cos", T.DoubleType()), *kept])
    fields = to_arrow_schema(schema)
    hits = across(q, "_q", "_c", n_c).groupBy(*pairs).cogroup(across(c, "_c", "_q", n_q).groupBy(*pairs)).applyInArrow(_block_top(k, threshold, fields), schema)
    best = top_k(hits.select(*names), ["query_id"], k, F.desc("_cos"), "chunk_id")
    return best.withColumn("score", F.round("_cos", 6)).drop("_cos")


def past_findings(queries: DataFrame, findings: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most similar past findings of the repository, whatever their score."""
    return similar_chunks(queries, findings.withColumnRenamed("finding_id", "chunk_id"), k, -2.0).withColumnRenamed("chunk_id", "finding_id")


def keyword_index(df: DataFrame, text: str, pattern: str = r"[a-z0-9_]+") -> DataFrame:
    """Inverted index: one row per distinct lower-case token of each row."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({pattern})"), F.lit(1)))
    return df.withColumn("token", F.explode(found))


def callers(names: DataFrame, chunks: DataFrame, k: int = V.MAX_CALLERS, pattern: str = r"[a-z0-9_]+") -> DataFrame:
    """Chunks that hold all tokens of a function's name, by file and line, at most ``k`` of each name.

    names: query_id, repo_id, name, exclude (array of paths). Tokens are joined by equality, never matched row against row.
    """
    parts = F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(f"({pattern})"), F.lit(1)))
    want = names.withColumn("want", parts).where(F.size("want") > 0)
    want = want.select("query_id", "repo_id", "name", "exclude", F.size("want").alias("n"), F.explode("want").alias("token"))
    index = keyword_index(chunks, "content", pattern).select("repo_id", "chunk_id", "file_path", "start_line", "token")
    hits = want.join(index, ["repo_id", "token"]).where(~F.coalesce(F.array_contains("exclude", F.col("file_path")), F.lit(False)))
    hits = hits.groupBy("query_id", "repo_id", "name", "chunk_id", "file_path", "start_line").agg(F.count(F.lit(1)).alias("found"), F.first("n").alias("n")).where("found = n")
    return top_k(hits.drop("found", "n"), ["query_id", "name"], k, "file_path", "start_line", "chunk_id")


def text_match(content: Column, name: str) -> Column:
    """Whether all words of ``name`` occur in ``content``, in any case."""
    import re

    words = re.findall(r"\w+", name.lower())
    out = F.lit(bool(words))
    for w in words:
        out = out & content.rlike(rf"(?i)\b{w}\b")
    return out


def distinct_callers(rows: DataFrame, keys: list[str] = ("query_id",)) -> DataFrame:
    """Callers of several functions without repeats; the first function's hit stays."""
    w = Window.partitionBy(*keys, "chunk_id").orderBy("name_ord", "rank")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def within_budget(df: DataFrame, keys: list[str], cost: Column, budget: int, *order: Column | str, out: str = "spent") -> DataFrame:
    """The longest prefix of each key's rows whose costs add up to at most ``budget``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(cost).over(w)).where(F.col(out) <= budget)


def call_budget(files: DataFrame, most: int = V.MAX_CALLS) -> DataFrame:
    """Model calls in file order: one for FILE_LEVEL files, one for each hunk else, ``most`` for each review.

    files: review_id, file_ord, granularity, hunks.
    """
    units = F.when(F.col("granularity") == "FILE_LEVEL", F.lit(1)).otherwise(F.col("hunks"))
    calls = files.where(units > 0).withColumn("unit", F.explode(F.sequence(F.lit(1), units.cast("int"))))
    return top_k(calls, ["review_id"], most, "file_ord", "unit", out="call_no")


def file_cap(files: DataFrame, most: int = V.MAX_FILES) -> DataFrame:
    return top_k(files, ["diff_id"], most, "file_ord", out="file_no")


def cache_split(texts: DataFrame, cache: DataFrame, text: str = "text", now: Column | None = None) -> DataFrame:
    """Each text with its cached value, if one is alive: adds key, value, hit, and ``computes`` for the first miss of each key.

    cache: key, value, expires_at. Misses of the same key are to be computed once.
    """
    now = F.current_timestamp() if now is None else now
    alive = cache.where(F.col("expires_at") > now).groupBy("key").agg(F.max_by("value", F.struct("expires_at", "value")).alias("value"))
    rows = texts.withColumn("key", C.short_hash(F.col(text))).join(alive, "key", "left").withColumn("hit", F.col("value").isNotNull())
    w = Window.partitionBy("key").orderBy("ord")
    return rows.withColumn("computes", ~F.col("hit") & (F.row_number().over(w) == 1))


def payload_chunk(df: DataFrame) -> DataFrame:
    """Chunks from loosely typed payload columns, with defaults."""
    text = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d)).alias(c)
    num = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c)
    return df.select(text("chunk_id"), text("file_path"), text("chunk_type"), text("name"), text("content"), num("start_line"), num("end_line"), text("language"), F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("score"))


def rag_section(chunks: DataFrame, called: DataFrame, past: DataFrame) -> DataFrame:
    """Markdown of the retrieved context by query: (query_id, section). Inputs carry query_id and rank."""

    def part(df: DataFrame, n: int | None, head: str, row: Column, out: str, sep: str) -> DataFrame:
        df = df if n is None else df.where(F.col("rank") <= n)
        rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", row.alias("t")))), lambda r: r["t"])
        return df.groupBy("query_id").agg(F.concat(F.lit(head + "\n\n"), F.array_join(rows, sep)).alias(out))

    fence = lambda n: F.concat(F.lit("```"), "language", F.lit("\n"), F.substring("content", 1, n), F.lit("\n```"))
    where = F.concat(F.lit("**"), "file_path", F.lit(":"), F.col("start_line").cast("string"))
    a = part(chunks, 3, "## Semantically Related Code in This Repository", F.concat(where, F.lit("–"), F.col("end_line").cast("string"), F.lit("** `"), "name", F.format_string("` (similarity %.2f):\n", "score"), fence(400)), "a", "\n\n")
    b = part(called, 3, "## Call Sites of Changed Functions", F.concat(where, F.lit("** `"), "name", F.lit("`:\n"), fence(300)), "b", "\n\n")
    c = part(past, None, "## Similar Past Findings (Few-Shot Examples)", F.concat(F.lit("- **["), "severity", F.lit("]** "), "title", F.lit(": "), F.substring("body", 1, 150)), "c", "\n\n")
    return a.join(b, "query_id", "full").join(c, "query_id", "full").select("query_id", F.concat_ws("\n\n", "a", "b", "c").alias("section"))


def enriched_files(files: DataFrame, sections: DataFrame) -> DataFrame:
    """Files (diff_id, filename) with the context that was retrieved for them (diff_id, filename, section); null where there is none."""
    return files.join(sections.select("diff_id", "filename", "section"), ["diff_id", "filename"], "left")
