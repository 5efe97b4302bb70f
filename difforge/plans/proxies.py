"""Review-shaped relations derived from the benchmark tables, as Spark frames; the SQL twins are in ``sql.py``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table

EXTENSIONS = {"en": "py", "fr": "min.js", "de": "lock", "es": "GO"}


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Files: repo_id (source), doc_id, file_path, content, size."""
    d = table(spark, sf, "documents")
    ext = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), F.coalesce("lang", F.lit(""))), F.lit("txt"))
    return d.select(F.col("source").alias("repo_id"), "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("file_path"), F.col("text").alias("content"), F.col("n_chars").alias("size"))


def hours(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their hour of the month, as a line number."""
    e = table(spark, sf, "events")
    return e.withColumn("h", (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("int"))


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Events as findings: the user is the file, the hour the line."""
    rank = {"error": 0, "purchase": 1, "signup": 2, "click": 3, "view": 4}
    names = ["critical", "high", "medium", "low", "info"]
    r = F.try_element_at(F.create_map(*(F.lit(x) for kv in rank.items() for x in kv)), F.col("event_type"))
    h = hours(spark, sf)
    return h.select(
        F.lit("r").alias("review_id"), F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("file_path"), F.col("h").alias("line_start"), (F.col("h") + F.col("event_id") % 5).cast("int").alias("line_end"),
        r.alias("rank"), F.element_at(F.array(*map(F.lit, names)), r + 1).alias("severity"), F.col("value").alias("confidence"), F.col("event_type").alias("category"), "user_id",
    )


def diffs(spark: SparkSession, sf: str) -> DataFrame:
    """A two-hunk diff for each document: line i is context, added or removed by i mod 3; lines from the eleventh on are the second hunk."""
    d = documents(spark, sf)
    ls = F.split(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n"), "\n")
    mark = lambda x, i: F.concat(F.element_at(F.array(F.lit(" "), F.lit("+"), F.lit("-")), (i % 3 + 1).cast("int")), x)
    body = d.select("doc_id", "file_path", F.transform(ls, mark).alias("m"))
    head = F.concat(F.lit("diff --git a/"), "file_path", F.lit(" b/"), "file_path", F.lit("\nindex 1..2 100644\n--- a/"), "file_path", F.lit("\n+++ b/"), "file_path")
    first = F.concat(F.lit("\n@@ -1,10 +1,10 @@ start\n"), F.array_join(F.slice("m", 1, 10), "\n"))
    second = F.when(F.size("m") > 10, F.concat(F.lit("\n@@ -101 +201 @@\n"), F.array_join(F.slice("m", F.lit(11), F.size("m")), "\n"), F.lit("\n\\ No newline at end of file"))).otherwise("")
    return body.select(F.col("doc_id").alias("diff_id"), F.concat(head, first, second).alias("diff_text"))


#: Sources around a comment; {c} is the content, {i} the document's id, {b} brackets that may lack a partner.
SOURCES = {
    "js": "import x{i} from 'm{i}';\n/*{c}*/\nfunction f{i}(a) {\n  return \"([{\";\n}\nclass K{i} { m(x) { return x; } }\n{b}",
    "ts": "import {x{i}} from 'm{i}';\n/*{c}*/\nfunction f{i}(a: string): number {\n  return '([{';\n}\nclass K{i} { m(x: number) { return x; } }\n{b}",
    "go": "import \"m{i}\"\n/*{c}*/\nfunc f{i}(a int) int {\n  return '{'\n}\nfunc (k K{i}) m(x int) int { return x }\n{b}",
    "rs": "use m{i};\n/*{c}*/\nfn f{i}(a: &str) -> char {\n  return '{';\n}\nimpl K{i} { fn m(x: u8) -> u8 { x } }\n{b}",
    "java": "import m{i};\n/*{c}*/\nclass K{i} {\n  String s = \"([{\";\n}\nclass L{i} { int m(int x) { return x; } }\n{b}",
    "py": "import m{i}\n\"\"\"{c}\"\"\"\ndef f{i}(a):\n  return \"([{\"\n\nclass K{i}:\n  def m(x): return x\n{b}",
}


def sources(spark: SparkSession, sf: str, broken: Column | bool = False) -> DataFrame:
    """Six files for each document: doc_id, file_path, content. ``broken``: where its id asks for it, a file opens or closes round brackets too often."""
    d = documents(spark, sf)
    calm = F.regexp_replace(F.coalesce("content", F.lit("")), r'[*/"\\\x00\r]', " ")
    brackets = F.when(F.lit(broken) if isinstance(broken, bool) else broken, F.concat(F.repeat(F.lit("("), F.col("doc_id").cast("int") % 4), F.repeat(F.lit(")"), F.col("doc_id").cast("int") % 3))).otherwise("")
    fill = lambda t: F.replace(F.replace(F.replace(F.lit(t), F.lit("{i}"), F.col("doc_id").cast("string")), F.lit("{b}"), brackets), F.lit("{c}"), calm)
    made = F.array(*(F.struct(F.lit(ext).alias("ext"), fill(t).alias("content")) for ext, t in SOURCES.items()))
    rows = d.select("doc_id", F.explode(made).alias("s"))
    return rows.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("."), F.col("s.ext")).alias("file_path"), "s.content")


def cache_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Events as operations on a cache: views and errors get, the others put; forty keys."""
    put = F.col("event_type").isin("signup", "purchase", "click")
    seconds = F.when(F.col("event_type") == "click", 3600).otherwise(6 * 3600).cast("long")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("op_id"), F.col("ts").cast("timestamp").alias("at"), F.when(put, "put").otherwise("get").alias("kind"), F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("key"),
        F.when(put, F.col("props")).alias("value"), F.when(put, seconds).alias("seconds"),
    )


def review_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    """(diffs, settings, linter rows, replies) of reviews of up to four files: the documents whose id divided by four is the review's."""
    d = diffs(spark, sf).join(documents(spark, sf).select(F.col("doc_id").alias("diff_id"), F.col("file_path"), "content"), "diff_id").withColumn("review_id", F.floor(F.col("diff_id") / 4))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("diff_id", "diff_text"))), lambda x: x["diff_text"])
    many = d.groupBy("review_id").agg(F.array_join(texts, "\n").alias("diff_text"))
    r = F.col("review_id")
    config = many.select("review_id", (r % 9 != 0).alias("enabled"), F.when(r % 5 == 0, F.array(F.lit("src1/*"))).otherwise(F.array().cast("array<string>")).alias("ignore_patterns"), F.when(r % 4 == 0, "medium").otherwise("low").alias("severity_threshold"), (r % 3 != 0).alias("style_review"))
    i = F.col("diff_id")
    line = F.array((i % 7 + 1).cast("int"), (i % 11 + 201).cast("int"))
    lint = d.select("review_id", "file_path", F.when(i % 3 == 0, "gitleaks").otherwise("ruff").alias("tool"), F.lit("R1").alias("rule"), F.explode(line).alias("line"), F.lit("message").alias("message"), F.when(i % 2 == 0, "error").otherwise("warning").alias("severity"))
    item = lambda a, b, sev, cat: F.struct(a.cast("int").alias("line_start"), b.cast("int").alias("line_end"), F.lit(sev).alias("severity"), F.lit(cat).alias("category"), F.concat(F.lit(f"{cat} in "), "file_path").alias("title"), F.lit("why").alias("body"), F.when(i % 2 == 0, "x = 1").alias("suggestion_code"))
    bugs = F.to_json(F.array(item(i % 7 + 1, i % 7 + 3, "high", "bug"), item(i % 5 + 203, i % 5 + 203, "critical", "security"), item(F.lit(9000), F.lit(9001), "high", "bug")))
    bug = d.select("review_id", "file_path", F.when(i % 6 == 0, "no json").otherwise(F.concat(F.lit("```json\n"), bugs, F.lit("\n```"))).alias("response"))
    style = d.select("review_id", "file_path", F.to_json(F.array(item(i % 13 + 1, i % 13 + 1, "high", "style"))).alias("response"))
    summary = many.select("review_id", F.when(r % 2 == 0, F.concat(F.lit('{"summary": "Change '), r.cast("string"), F.lit('", "key_changes": [], "risk_level": "low"}'))).otherwise("?").alias("response"))
    return many, config, lint, {"summary": summary, "bug": bug, "style": style}
