import pytest
from pyspark.sql import functions as F

from difforge.operators import diff

TWO_HUNKS = """diff --git a/app/x.py b/app/x.py
index 1..2 100644
--- a/app/x.py
+++ b/app/x.py
@@ -1,2 +1,3 @@ def top():
 a
+b
 c
@@ -50,3 +51,3 @@
 d
-old
+new
 e
\\ No newline at end of file
"""
NEW = "diff --git a/n.go b/n.go\nnew file mode 100644\n--- /dev/null\n+++ b/n.go\n@@ -0,0 +1,3 @@\n+one\n+two\n+three\n"
GONE = "diff --git a/g.rb b/g.rb\ndeleted file mode 100644\n--- a/g.rb\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-one\n-two\n"
MOVED = "diff --git a/o.ts b/p.ts\nsimilarity index 95%\nrename from o.ts\nrename to p.ts\n--- a/o.ts\n+++ b/p.ts\n@@ -5,3 +5,4 @@\n x\n+y\n z\n w\n"
BINARY = "diff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n"
TRICKY = "diff --git a/t.c b/t.c\n--- a/t.c\n+++ b/t.c\n@@ -1,3 +1,3 @@\n--- looks like a header\n+++ so does this\n@@ broken\n\nodd first character\n \n"


def table(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "diff_id string, diff_text string")


def lines(spark, text):
    rows = diff.diff_lines(table(spark, d=text)).orderBy("file_ord", "line_ord").collect()
    return [(r.line_type, r.content, r.old_lineno, r.new_lineno, r.diff_position) for r in rows]


def positions(spark, text):
    rows = diff.position_map(diff.diff_lines(table(spark, d=text))).collect()
    return {r.new_lineno: r.diff_position for r in rows}


def test_positions_go_on_across_hunks(spark):
    assert positions(spark, TWO_HUNKS) == {1: 2, 2: 3, 3: 4, 51: 6, 52: 8, 53: 9}
    assert positions(spark, NEW) == {1: 2, 2: 3, 3: 4}
    assert positions(spark, GONE) == {}
    assert positions(spark, MOVED) == {5: 2, 6: 3, 7: 4, 8: 5}
    assert positions(spark, BINARY) == {}


@pytest.mark.parametrize("end", ["\r\n", "\r"])
def test_line_ends(spark, end):
    assert lines(spark, TWO_HUNKS.replace("\n", end)) == lines(spark, TWO_HUNKS)


def test_lines(spark):
    assert lines(spark, GONE) == [("removed", "one", 1, None, 2), ("removed", "two", 2, None, 3)]
    assert lines(spark, TRICKY) == [
        ("removed", "-- looks like a header", 1, None, 2),
        ("added", "++ so does this", None, 1, 3),
        ("context", "odd first character", 2, 2, 4),
        ("context", "", 3, 3, 5),
    ]


def test_files(spark):
    df = diff.diff_files(table(spark, d=TWO_HUNKS + NEW + GONE + MOVED + BINARY, blank="  \n "))
    got = [(r.filename, r.old_filename, r.status, r.language, r.is_binary, r.additions, r.deletions) for r in df.orderBy("file_ord").collect()]
    assert got == [
        ("app/x.py", None, "modified", "python", False, 2, 1),
        ("n.go", None, "added", "go", False, 3, 0),
        ("g.rb", None, "removed", "ruby", False, 0, 2),
        ("p.ts", "o.ts", "renamed", "typescript", False, 1, 0),
        ("i.png", None, "modified", None, True, 0, 0),
    ]
    counts = {r.status: r.files for r in diff.status_counts(df).collect()}
    assert counts == {"modified": 2, "added": 1, "removed": 1, "renamed": 1}


def test_hunks(spark):
    got = [(r.old_start, r.old_count, r.new_start, r.new_count, r.function_context) for r in diff.diff_hunks(table(spark, d=TWO_HUNKS)).orderBy("hunk_ord").collect()]
    assert got == [(1, 2, 1, 3, "def top():"), (50, 3, 51, 3, None)]


def test_renderings(spark):
    ls = diff.diff_lines(table(spark, d=TWO_HUNKS))
    got = [r.rendered for r in diff.render_hunks(ls).orderBy("hunk_ord").collect()]
    assert got[0] == "   1   a\n   2 + b\n   3   c"
    assert got[1].split("\n")[1] == "  51 - old"
    assert diff.query_text(ls).first().query_text == "b"
    ctx = diff.context_around(ls, 1).where("content = 'new'").first().context
    assert ctx == "  52 new\n  53 e"
    assert diff.changed_lines(ls).count() == 6


def test_changed_functions_and_call_sites(spark):
    text = (
        "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,1 +1,1 @@\n-def area(x):\n+def area(x, y):\n+def fresh():\n"
        "diff --git a/b.py b/b.py\n--- a/b.py\n+++ b/b.py\n@@ -9,2 +9,3 @@\n+v = area(2)\n-w = area (3)\n other_area(1)\n"
    )
    ls = diff.diff_lines(table(spark, d=text))
    fns = diff.changed_functions(ls)
    assert [(r.name, r.filename) for r in fns.collect()] == [("area", "a.py")]
    sites = diff.call_sites(fns, ls).collect()
    assert [(r.site_file, r.line) for r in sites] == [("b.py", 9)]
    assert diff.touches_functions(ls).first().touches_functions
    assert not diff.touches_functions(ls.where("filename = 'b.py'")).first().touches_functions


def test_scope(spark):
    hunks = spark.createDataFrame([("d", "f", 1, 2, 1)], "diff_id string, file_path string, hunk_ord int, new_start int, new_count int")
    files = spark.createDataFrame([("f", "\n".join(map(str, range(1, 21))))], "file_path string, content string")
    assert diff.scope_context(hunks, files).first().scope_context == "\n".join(map(str, range(1, 8)))


def test_function_names(spark):
    rows = spark.createDataFrame([("d", "f", 2, "b"), ("d", "f", 1, "a"), ("d", "f", 3, "a"), ("d", "f", 4, None)], "diff_id string, filename string, hunk_ord int, ast_function_context string")
    assert diff.function_names(rows).first().names == ["a", "b"]


def test_segment_is_lazy_about_nulls(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, True), (1, 3, False)], "k int, o int, s boolean")
    assert [r.seg for r in diff.segment(df, ["k"], "o", F.col("s"), "seg").orderBy("o").collect()] == [0, 1, 1]


def test_lines_are_numbered_without_a_shuffle(spark):
    plan = diff.diff_lines(table(spark, a=TWO_HUNKS, b=NEW))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_many_diffs_of_one_batch(spark):
    """Stretches begin anew with each diff, whatever stands before; text before the first file, blank and null diffs give nothing."""
    texts = [TWO_HUNKS, "", "prose\n@@ -1 +1 @@\n+x\n" + NEW + MOVED, None, GONE, " \n ", BINARY, "+only\n-lines", TRICKY + TWO_HUNKS]
    one = spark.createDataFrame(list(enumerate(texts)), "diff_id long, diff_text string").coalesce(1)
    together = {}
    for r in diff.diff_lines(one).orderBy("diff_id", "file_ord", "line_ord").collect():
        together.setdefault(r.diff_id, []).append((r.line_type, r.content, r.old_lineno, r.new_lineno, r.diff_position))
    alone = {i: lines(spark, t) for i, t in enumerate(texts) if t is not None}
    assert together == {i: v for i, v in alone.items() if v} and set(together) == {0, 2, 4, 8}
    assert [(r.file_ord, r.filename) for r in diff.diff_files(one).where("diff_id = 8").orderBy("file_ord").collect()] == [(1, "t.c"), (2, "app/x.py")]
