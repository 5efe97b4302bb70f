"""Adapters for what built-in functions can't compute: models, parsers, validators. All run on Arrow batches.

Each takes a plain Python callable, so that a service client, a local model or a table of canned results can stand behind it.
"""

from __future__ import annotations

import ast
import hashlib
import re
import textwrap
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import columns as C
from . import syntax
from . import values as V


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder for tests and offline use: signed hashes of words, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        words = [re.findall(r"\w+", t.lower()) for t in texts]
        known = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}  # each distinct word of a batch is hashed once
        h = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in known], np.uint64)
        out = np.zeros((len(texts), dim))
        at = np.array([known[w] for ws in words for w in ws], np.int64)
        np.add.at(out, (np.repeat(np.arange(len(texts)), [len(ws) for ws in words]), (h % np.uint64(dim)).astype(int)[at]), np.where(h >> np.uint64(63), 1, -1)[at])
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()

    return embed


def embed(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """Adds ``embedding``: ``embedder`` on batches of at most ``batch`` texts."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            done: list = []
            for i in range(0, len(s), batch):
                done.extend(embedder(s.iloc[i : i + batch].fillna("").tolist()))
            yield pd.Series(done)

    return df.withColumn("embedding", run(F.col(text)))


def embed_missing(texts: DataFrame, cache: DataFrame, embedder: Callable, text: str = "text") -> DataFrame:
    """Texts with their embedding, from ``cache`` (key, value) where it has one; each missing text is embedded once."""
    keyed = texts.withColumn("key", C.short_hash(F.col(text)))
    missing = keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"]).select("key", text)
    fresh = embed(missing, text, embedder).select("key", F.col("embedding").alias("value"))
    return keyed.join(cache.select("key", "value").unionByName(fresh), "key")


def bounded(fn: Callable, items: list, at_once: int = V.LLM_CONCURRENCY, seconds: float = 60, tries: int = 1, pause: float = 0.5) -> list[tuple[object, str | None, int]]:
    """(value, None, tries used) or (None, what went wrong, tries used) of ``fn`` on each item, in their order.

    At most ``at_once`` items are worked on; a call that takes longer than ``seconds`` counts as failed and is left to end by itself;
    between tries the wait doubles, from ``pause`` on.
    """

    def once(item):
        held: list = []

        def call() -> None:
            try:
                held.append((fn(item), None))
            except Exception as e:  # noqa: BLE001  whatever the service raises
                held.append((None, f"{type(e).__name__}: {e}"))

        thread = threading.Thread(target=call, daemon=True)
        thread.start()
        thread.join(seconds)
        return held[0] if held else (None, f"no answer within {seconds:g} s")

    def run(item):
        for k in range(1, tries + 1):
            value, error = once(item)
            if error is None or k == tries:
                return value, error, k
            time.sleep(pause * 2 ** (k - 1))

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(run, items))


def complete(
    prompts: DataFrame, clients: list[Callable[[str], tuple[str, int, int]]], names: list[str], strict: str = "\n\nReply with JSON only.", at_once: int = V.LLM_CONCURRENCY, seconds: float = 60, tries: int = 1, pause: float = 0.5, wants_json: bool = True
) -> DataFrame:
    """Replies to prompts (prompt_id, prompt): response, model, input_tokens, output_tokens, attempts, error.

    Clients are tried in turn until one doesn't fail; each is asked up to ``tries`` times, with ``at_once`` prompts of a task in flight. If ``wants_json``, a
    reply that isn't JSON is asked for once more, with ``strict`` added; tokens of all attempts are summed. If all
    clients fail the response is null and ``error`` says what the last one did.
    """
    import json

    def is_json(text: str) -> bool:
        clean = re.sub(r"^```(?:json)?\s*|\s*```$", "", text.strip())
        try:
            return isinstance(json.loads(clean), dict | list)
        except ValueError:
            return False

    def ask(texts: list[str]) -> list[tuple]:
        """(model, response, input tokens, output tokens, error) of each; a later client gets what the earlier ones failed."""
        out: list = [(None, None, 0, 0, None)] * len(texts)
        open_ = list(range(len(texts)))
        for name, client in zip(names, clients, strict=True):
            done = bounded(client, [texts[i] for i in open_], at_once, seconds, tries, pause)
            for i, (value, error, _) in zip(open_, done, strict=True):
                out[i] = (name, *value, None) if error is None else (None, None, 0, 0, f"{name}: {error}")
            open_ = [i for i in open_ if out[i][4] is not None]
            if not open_:
                break
        return out

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            prompts = df["prompt"].fillna("").tolist()
            first = ask(prompts)
            odd = [i for i, r in enumerate(first) if wants_json and r[1] is not None and not is_json(r[1])]
            again = dict(zip(odd, ask([prompts[i] + strict for i in odd]), strict=True))
            rows = []
            for i, (pid, (name, text, n_in, n_out, error)) in enumerate(zip(df["prompt_id"], first, strict=True)):
                attempts = 1
                if i in again:
                    name2, text2, more_in, more_out, _ = again[i]
                    n_in, n_out, attempts = n_in + more_in, n_out + more_out, 2
                    name, text = (name2, text2) if text2 is not None else (name, text)
                rows.append((pid, text, name, n_in, n_out, attempts, error))
            yield pd.DataFrame(rows, columns=["prompt_id", "response", "model", "input_tokens", "output_tokens", "attempts", "error"])

    return prompts.select("prompt_id", "prompt").mapInPandas(run, "prompt_id string, response string, model string, input_tokens long, output_tokens long, attempts int, error string")


def describe_missing(rows: DataFrame, clients: list[Callable[[str], tuple[str, int, int]]], names: list[str], **limits) -> DataFrame:
    """Rows of ``diff.described`` (key, hit, query_text, description) with a model's description where the cache had none: adds ``model``.

    Each distinct text is asked for once; where all clients fail, or say nothing, the description stays what it was.
    """
    asked = rows.where(~F.col("hit")).dropDuplicates(["key"]).select(F.col("key").alias("prompt_id"), stage_prompt("describe", diff=F.col("query_text")).alias("prompt"))
    said = complete(asked, clients, names, wants_json=False, **limits)
    told = F.regexp_replace("response", r"^\s+|\s+$", "")
    said = said.where(told != "").select(F.col("prompt_id").alias("key"), told.alias("_told"), "model")
    return rows.join(said, "key", "left").withColumn("description", F.coalesce("_told", "description")).drop("_told")


def _tree(source: str) -> ast.Module | tuple[str, int]:
    """The tree of Python source, or (what is wrong, row from 0). Source nested beyond the parser's own limits counts as wrong."""
    try:
        return ast.parse(source)
    except SyntaxError as e:
        return e.msg or "syntax error", max(0, (e.lineno or 1) - 1)
    except (ValueError, MemoryError, RecursionError) as e:  # a NUL, or nesting of thousands
        return ("NUL character" if isinstance(e, ValueError) else "nested too deeply"), 0


def _sound(code: str, language: str) -> bool:
    return isinstance(_tree(code), ast.Module) if language == "python" else not syntax.errors(code, language)


def check_suggestion(code: str | None, language: str | None, start: int = 0, end: int = 0) -> tuple[bool, str | None, str | None]:
    """(is_valid, error, fixed_code) of a suggested replacement of lines start to end.

    Python is parsed, the brace languages are checked for brackets, texts and comments without end; other languages pass.
    """
    if not code or not code.strip():
        return False, "Empty suggestion", None
    need, have = end - start - 2, sum(1 for line in code.splitlines() if line.strip())
    if 0 < start < end and need > 3 and have < need:
        return False, f"Suggestion has {have} non-empty lines but the finding spans {end - start + 1} lines — likely incomplete fix", None
    if language not in PARSED or _sound(code, language):
        return True, None, None
    flat = textwrap.dedent(code).strip()
    if _sound(flat, language):
        return True, None, flat
    if language == "python" and _sound("def _():\n" + textwrap.indent(code, "    ", lambda _: True) + "\n", language):
        return True, None, None
    return False, f"Syntax errors detected in {language} suggestion", None


def validate_suggestions(df: DataFrame) -> DataFrame:
    """Adds is_valid, error, fixed_code to suggestions (suggestion_code, language, line_start, line_end)."""

    @F.pandas_udf("is_valid boolean, error string, fixed_code string")
    def run(code: pd.Series, lang: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
        rows = [check_suggestion(*r) for r in zip(code, lang, start, end, strict=True)]
        return pd.DataFrame(rows, columns=["is_valid", "error", "fixed_code"])

    return df.withColumn("_v", run("suggestion_code", "language", "line_start", "line_end")).select("*", "_v.*").drop("_v")


#: Languages whose files are read for functions, imports and errors.
PARSED = ("python", *syntax.LANGUAGES)


def python_nodes(source: str) -> tuple[list[tuple[str, str, int, int]], list[str], list[tuple[str, int]]]:
    """(functions and classes, import lines, what is wrong) of Python source; rows from 0."""
    tree = _tree(source)
    if not isinstance(tree, ast.Module):
        return [], [], [tree]
    kinds = {ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition"}
    found = [(kinds[type(n)], n.name, n.lineno - 1, n.end_lineno - 1) for n in ast.walk(tree) if type(n) in kinds]
    lines = [n for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom)]
    rows = source.splitlines(keepends=True) if lines else []
    texts = ["".join(rows[n.lineno - 1 : n.end_lineno]).encode()[n.col_offset :] for n in sorted(lines, key=lambda n: (n.lineno, n.col_offset))]
    ends = [n.end_col_offset - n.col_offset if n.lineno == n.end_lineno else None for n in sorted(lines, key=lambda n: (n.lineno, n.col_offset))]
    return sorted(found, key=lambda n: (n[2], -n[3])), [t[:e].decode().strip() for t, e in zip(texts, ends, strict=True)], []


def file_syntax(source: str | None, language: str) -> tuple[list, list[str], list[tuple[str, int]]]:
    """(nodes, import lines, errors) of a file of one of the PARSED languages."""
    text = source or ""
    return python_nodes(text) if language == "python" else (syntax.nodes(text, language), syntax.import_lines(text, language), syntax.errors(text, language))


_NODE_FIELDS = ("node_type", "name", "start_row", "end_row")
_SYNTAX = "nodes array<struct<node_type:string,name:string,start_row:int,end_row:int>>, imports array<string>, errors array<struct<what:string,row:int>>"


def _read_syntax(source: Column, language: Column) -> Column:
    """What ``file_syntax`` finds; nothing where the language is null."""

    @F.pandas_udf(_SYNTAX)
    def run(source: pd.Series, language: pd.Series) -> pd.DataFrame:
        read = [file_syntax(*x) if x[1] is not None else ([], [], []) for x in zip(source, language, strict=True)]
        return pd.DataFrame({
            "nodes": [[dict(zip(_NODE_FIELDS, n, strict=True)) for n in nodes] for nodes, _, _ in read],
            "imports": [lines for _, lines, _ in read],
            "errors": [[{"what": w, "row": r} for w, r in wrong] for _, _, wrong in read],
        })

    # Called nondeterministic, else a filter on its result is pushed below it and reads each text a second time.
    return run.asNondeterministic()(source, language)


def with_syntax(files: DataFrame, keys: list[str] = ()) -> DataFrame:
    """…keys, file_path, language and ``p`` (nodes, imports, errors) of files (file_path, content) whose language is read; one pass over each text."""
    rows = files.select(*keys, "file_path", C.chunk_language(F.col("file_path")).alias("language"), "content").where(F.col("language").isin(*PARSED))
    return rows.withColumn("p", _read_syntax(F.col("content"), F.col("language"))).drop("content")


def with_nodes(files: DataFrame, keys: list[str] = ()) -> DataFrame:
    """…keys, file_path, content and ``nodes``, an array of a file's functions and classes; null if it has errors or its language isn't read."""
    language = C.chunk_language(F.col("file_path"))
    rows = files.select(*keys, "file_path", "content", F.when(language.isin(*PARSED), language).alias("language"))
    rows = rows.withColumn("p", _read_syntax(F.when(F.col("language").isNotNull(), F.col("content")), F.col("language")))
    return rows.select(*keys, "file_path", "content", F.when(F.col("language").isNotNull() & (F.size("p.errors") == 0), F.col("p.nodes")).alias("nodes"))


def syntax_nodes(files: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Function and class nodes of files without errors: …keys, file_path, node_type, name, start_row, end_row, node_ord.

    A file that parses without any node gives one row whose node_ord is null, so ``parsed`` files stay known.
    """
    rows = with_syntax(files, keys).where(F.size("p.errors") == 0)
    return rows.select(*keys, "file_path", F.posexplode_outer("p.nodes").alias("node_ord", "n")).select(*keys, "file_path", "n.*", "node_ord")


def imports(files: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Import statements of files: …keys, file_path, import_ord, statement."""
    return with_syntax(files, keys).select(*keys, "file_path", F.posexplode("p.imports").alias("import_ord", "statement"))


def syntax_errors(files: DataFrame, keys: list[str] = ()) -> DataFrame:
    """What is wrong in files: …keys, file_path, error_ord, what, row; files without errors have no row."""
    return with_syntax(files, keys).select(*keys, "file_path", F.posexplode("p.errors").alias("error_ord", "e")).select(*keys, "file_path", "error_ord", "e.what", "e.row")


#: Longest part of each kind of text that goes into a prompt.
PROMPT_LIMITS = {"diff": 3000, "file": 8000, "hunk": 500}


#: What each stage asks a model; {slots} are filled by ``stage_prompt``. The wording is ours, the reply shapes are what ``findings`` reads.
PROMPTS = {
    "summary": "Summarise this change.\nTitle: {title}\nDiff:\n{diff}\nReply with a JSON object: summary, key_changes (list), risk_level (low, medium or high).",
    "bug": "Find defects in {filename}.\n{context}\n{lint}\nDiff:\n{diff}\nReply with a JSON list of objects: line_start, line_end, severity, category, title, body, suggestion_code.",
    "xfile": "{description}\nCall sites:\n{diff}\nReply with a JSON object: has_breaking_changes, affected_call_sites (list of file, line, issue, suggestion).",
    "style": "Review the style of {filename}. {guidelines}\nDiff:\n{diff}\nReply with a JSON list as for defects, severity low or medium.",
    "describe": "Say in one sentence what this change does.\n{diff}",
    "dedup": "Some of these findings may say the same.\n{findings}\nReply with a JSON list of the ids to keep.",
}


def stage_prompt(stage: str, **parts: Column) -> Column:
    """The prompt of a stage; a null or missing part is empty, ``diff`` and ``file`` are cut to PROMPT_LIMITS."""
    pieces = re.split(r"\{(\w+)\}", PROMPTS[stage])
    out = []
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            out.append(F.lit(piece))
        elif piece in parts:
            text = F.coalesce(parts[piece], F.lit(""))
            out.append(F.substring(text, 1, PROMPT_LIMITS[piece]) if piece in PROMPT_LIMITS else text)
    return F.concat(*out)
