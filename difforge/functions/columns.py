"""Scalar helpers as Spark column expressions."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def _map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def lookup(table: dict, key: Column, default=None) -> Column:
    """``table[key]`` as a literal map; ``default`` for keys it lacks and for null."""
    found = F.try_element_at(_map(table), F.coalesce(key, F.lit("")))
    return found if default is None else F.coalesce(found, F.lit(default))


def unix_lines(text: Column) -> Column:
    """Text with CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def split_lines(text: Column) -> Column:
    """Lines at LF, CR, CRLF and the Unicode line ends; no empty line after a final end."""
    ended = F.regexp_replace(text, "(\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])", "\n")
    return F.when(ended == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(ended, r"\n\z", ""), "\n"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def diff_language(path: Column) -> Column:
    """Language by suffix, case-sensitive; null if unknown."""
    return lookup(V.DIFF_LANGUAGES, F.regexp_extract(path, r"(\.[^.]*)$", 1))


def chunk_language(path: Column) -> Column:
    """Language by lower-cased suffix; text if unknown."""
    return lookup(V.CHUNK_LANGUAGES, F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)), "text")


def glob_regex(pattern: str) -> str:
    """An anchored Java pattern for a shell glob whose ``*`` crosses slashes."""
    return "^" + fnmatch.translate(pattern).replace(r"\Z", r"\z").replace("(?>.*?", "(?:.*?")


def any_glob(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def short_hash(text: Column, n: int = 16) -> Column:
    """The first ``n`` hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, n)


def chunk_id(path: Column, name: Column, start_line: Column) -> Column:
    return short_hash(F.concat_ws(":", path, name, start_line.cast("string")))


def point_id(chunk: Column) -> Column:
    """A chunk id padded to a UUID; null unless it is hexadecimal."""
    full = F.rpad(F.lower(chunk), 32, "0")
    parts = [F.substring(full, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(full.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))


def tokens(text: Column) -> Column:
    """Token estimate: a quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def severity_rank(severity: Column, unknown: int = V.UNKNOWN_SEVERITY) -> Column:
    return lookup({s: i for i, s in enumerate(V.SEVERITIES)}, severity, unknown)


def threshold_rank(threshold: Column) -> Column:
    return lookup({s: i for i, s in enumerate(V.SEVERITIES)}, threshold, V.DEFAULT_THRESHOLD)


def ranges_overlap(start1: Column, end1: Column, start2: Column, end2: Column, tolerance: int = V.LINE_TOLERANCE) -> Column:
    return (start1 <= end2 + tolerance) & (end1 >= start2 - tolerance)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for a row, however often ``use`` names it and wherever the optimiser moves the whole."""
    return F.element_at(F.transform(F.array(value), use), 1)


def model_json(text: Column) -> Column:
    """A model's reply without its code fence, if it is a JSON object or array; null otherwise."""

    def clean(bare: Column) -> Column:
        inner = F.regexp_extract(bare, r"(?s)^```(?:json)?\s*\n?(.*?)\n?```\s*$", 1)
        return once(inner, lambda i: F.regexp_replace(F.when(bare.startswith("```") & (i != ""), i).otherwise(bare), r"^\s+|\s+$", ""))

    def checked(json: Column) -> Column:
        return once(F.schema_of_variant(F.try_parse_json(json)), lambda kind: F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), json))

    return once(once(F.regexp_replace(text, r"^\s+|\s+$", ""), clean), checked)


def call_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict | None = None) -> Column:
    """Dollars of one model call."""
    table = V.PRICES if prices is None else prices
    price = lambda i: lookup({m: float(p[i]) for m, p in table.items()}, model, float(V.DEFAULT_PRICE[i]))
    return (tokens_in * price(0) + tokens_out * price(1)) / 1e6
