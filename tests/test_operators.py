import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from difforge.functions import columns as C
from difforge.functions import models
from difforge.operators import chunking, findings, indexing, intervals, retrieval, reviews, routing
from difforge.sources import readers, sinks
from difforge.streaming import streams


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


# --- routing


def verdict(spark, author="ann", labels=(), draft=False, files=None):
    df = spark.createDataFrame([(author, list(labels), draft, files)], "author string, labels array<string>, draft boolean, changed_files array<string>")
    r = routing.gatekeeper(df).first()
    return r.should_process, r.reason, r.queue


def test_gatekeeper(spark):
    assert verdict(spark, "dependabot[bot]", ["skip-ai-review"]) == (False, "Bot PR from dependabot[bot]", "skip")
    assert verdict(spark, "snyk-bot")[2] == "skip" and verdict(spark, "any[bot]")[2] == "skip"
    assert verdict(spark, labels=["x", "skip-ai-review"], draft=True)[1] == "skip-ai-review label present"
    assert verdict(spark, draft=True)[1].startswith("Draft PR")
    assert verdict(spark, files=["README.md", "a/yarn.lock", "i.png"]) == (False, "All 3 files match no-review patterns", "skip")
    assert verdict(spark, files=["README.md", "vendor/x.py", "a.py"]) == (True, "Reviewable PR: 1 code files", "fast_lane")
    assert verdict(spark, files=[f"f{i}.py" for i in range(51)]) == (True, "Large PR: 51 files → slow lane", "slow_lane")
    assert verdict(spark, files=[f"f{i}.py" for i in range(50)])[2] == "fast_lane"
    assert verdict(spark, None)[1] == "No file list — defaulting to fast_lane"


def test_paths(spark):
    paths = ["src/a.py", "docs/a.md", "x/.gitignore", "build/a.py", "a/rebuild/b.py", "m.min.js", "go.sum", "tests/test_a.py", "core/auth/login.py", "A.PY", "pkg/a_pb2.py", "noext"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    p = F.col("p")
    got = {r.p: r for r in df.select(p, routing.reviewable(p).alias("r"), routing.indexable(p, F.lit(10)).alias("i"), routing.is_test(p).alias("t"), routing.granularity(p, F.lit(1)).alias("g"), C.diff_language(p).alias("d"), C.chunk_language(p).alias("c")).collect()}
    assert [x for x in paths if got[x].r] == ["src/a.py", "a/rebuild/b.py", "tests/test_a.py", "core/auth/login.py", "A.PY", "pkg/a_pb2.py", "noext"]
    assert [x for x in paths if got[x].i] == ["src/a.py", "a/rebuild/b.py", "tests/test_a.py", "core/auth/login.py", "A.PY"]
    assert [x for x in paths if got[x].t] == ["tests/test_a.py"]
    assert [x for x in paths if got[x].g == "FILE_LEVEL"] == ["core/auth/login.py"]
    assert got["A.PY"].d is None and got["A.PY"].c == "python" and got["docs/a.md"].c == "text"
    assert df.select(routing.indexable(F.lit("a.py"), F.lit(500_001)).alias("i")).first().i is False


def test_ignore_patterns(spark):
    df = spark.createDataFrame([("gen/a/b.py", ["gen/*"]), ("a.py", None), ("a+b.py", ["a+b.py"]), ("x1.go", ["x[!0].go"]), ("x0.go", ["x[!0].go"])], "p string, g array<string>")
    assert [r.i for r in df.select(routing.ignored(F.col("p"), F.col("g")).alias("i")).collect()] == [True, False, True, True, False]


def test_events(spark):
    cases = [("pull_request", "opened", "review"), ("pull_request", "closed", "noop"), ("installation", "deleted", "installation_deleted"), ("installation_repositories", "added", "repos_added"), ("pull_request_review_comment", "created", "comment"), ("push", None, "noop")]
    df = spark.createDataFrame(cases, "e string, a string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", routing.event_route(F.col("e"), F.col("a"))).collect())


def test_gates(spark):
    df = spark.createDataFrame([(0, True, 0), (2, False, 2), (2, True, 0), (2, True, 1)], "files int, enabled boolean, reviewable_files int")
    assert [r.gate for r in routing.review_gate(df).collect()] == ["no_files", "disabled", "none_reviewable", "run"]
    assert one(spark, "a\n\nb").select(routing.suggestion_long_enough(F.col("x"), F.lit(1), F.lit(7)).alias("y")).first().y is False
    assert one(spark, "a\nb").select(routing.suggestion_long_enough(F.col("x"), F.lit(1), F.lit(6)).alias("y")).first().y is True
    assert [routing_action for routing_action in spark.createDataFrame([("removed",), ("renamed",), ("copied",)], "s string").select(routing.index_action(F.col("s"))).toPandas().iloc[:, 0]] == ["delete", "index", "none"]


# --- functions


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a": 1}', '{"a": 1}'), ('```json\n[1]\n```', "[1]"), ("```\n{}\n```", "{}"), ("nope", None), ("", None), ("42", None), (None, None), ('  [1, 2] \n', "[1, 2]")],
)
def test_model_json(spark, text, want):
    assert one(spark, text).select(C.model_json(F.col("x")).alias("y")).first().y == want


def test_small_functions(spark):
    r = one(spark, "a\r\nb\u2028c\n").select(C.split_lines(F.col("x")).alias("ls"), C.tokens(F.lit("x" * 9)).alias("t"), C.point_id(F.lit("ab12")).alias("p"), C.point_id(F.lit("xyz")).alias("bad"), C.call_cost(F.lit("deepseek-chat"), F.lit(1000), F.lit(500)).alias("c")).first()
    assert r.ls == ["a", "b", "c"] and r.t == 2 and r.p == "ab120000-0000-0000-0000-000000000000" and r.bad is None
    assert r.c == pytest.approx(0.00028)
    assert one(spark, "").select(C.split_lines(F.col("x")).alias("y")).first().y == []


# --- chunking


def naive_parts(blank, compat=False):
    out, start = [], 0
    while start < len(blank):
        end = min(start + 100, len(blank))
        if end < len(blank):
            for i in range(end, max(start, end - 20), -1):
                if blank[i - 1]:
                    end = i
                    break
        out.append((start, end))
        if end == len(blank) and not compat:
            break
        start = max(end - 5, start + 1)
    return out


@pytest.mark.parametrize("compat", [False, True])
def test_long_functions(spark, compat):
    rng = random.Random(3)
    cases = [[rng.random() < p for _ in range(n)] for n in (1, 5, 99, 100, 101, 119, 250, 431) for p in (0, 0.04, 0.3)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, b array<boolean>")
    got = {r.i: [(p.lo, p.hi) for p in r.p] for r in df.select("i", chunking.part_bounds(F.col("b"), compat).alias("p")).collect()}
    assert got == {i: naive_parts(c, compat) for i, c in enumerate(cases)}


def test_chunk_tiers(spark):
    source = "import os\n\nclass A:\n    def f(self):\n        return 1\n\n\ndef g():\n    pass\n"
    files = spark.createDataFrame([("a.py", source), ("bad.py", "def ("), ("t.txt", "x\n" * 150), ("e.py", " \n ")], "file_path string, content string")
    nodes = models.syntax_nodes(files)
    got = chunking.all_chunks(files, nodes.where("node_type IS NOT NULL"), nodes).collect()
    of = lambda p: sorted((r.chunk_type, r.name, r.start_line, r.end_line) for r in got if r.file_path == p)
    assert of("a.py") == [("class", "A", 3, 5), ("file_header", "<file_header>", 1, 9), ("function", "f", 4, 5), ("function", "g", 8, 9)]
    assert of("bad.py") == [("file_header", "<file_header>", 1, 1), ("window", "<window_0>", 1, 1)]
    assert of("t.txt") == [("file_header", "<file_header>", 1, 50), ("window", "<window_0>", 1, 100), ("window", "<window_1>", 81, 150)]
    assert of("e.py") == []
    assert len({r.chunk_id for r in got}) == len(got)
    assert [r.statement for r in models.imports(files.where("file_path = 'a.py'")).collect()] == ["import os"]


# --- retrieval


def test_similar_chunks(spark):
    c = spark.createDataFrame([(1, "a", [1.0, 0.0], "f1"), (1, "b", [0.9, 0.1], "f2"), (1, "c", [0.0, 1.0], "f3"), (2, "d", [1.0, 0.0], "f4"), (1, "e", [1.0, 0.0], "own")], "repo_id int, chunk_id string, embedding array<float>, file_path string")
    q = spark.createDataFrame([("q", 1, [2.0, 0.0], ["own"])], "query_id string, repo_id int, vector array<float>, exclude array<string>")
    got = retrieval.similar_chunks(q, c, 5, exclude="exclude").orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b"] and got[0].score == 1.0


def test_budget_is_a_prefix(spark):
    df = spark.createDataFrame([("q", i, 1.0 - 0.05 * i, "x" * 2000) for i in range(20)], "query_id string, ord int, score double, content string")
    got = retrieval.within_budget(df, ["query_id"], C.tokens(F.col("content")), 4000, F.desc("score"), "ord").collect()
    assert sorted(r.ord for r in got) == list(range(8))


def test_callers_need_all_tokens(spark):
    c = spark.createDataFrame([(1, "a", "f", 1, "x = parse_diff(y)"), (1, "b", "g", 1, "parse the diff"), (1, "c", "own", 1, "parse_diff")], "repo_id int, chunk_id string, file_path string, start_line int, content string")
    n = spark.createDataFrame([("q", 1, "parse_diff", ["own"])], "query_id string, repo_id int, name string, exclude array<string>")
    assert [r.chunk_id for r in retrieval.callers(n, c).collect()] == ["a"]
    assert [r.chunk_id for r in retrieval.callers(n, c, pattern="[a-z]+").orderBy("rank").collect()] == ["a", "b"]


def test_cache_and_embedding(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "ord int, text string")
    cache = texts.where("ord = 1").select(C.short_hash(F.col("text")).alias("key"), F.array(F.lit(9.0).cast("float")).alias("value"), F.lit("2100-01-01").cast("timestamp").alias("expires_at"))
    got = {r.ord: (r.hit, r.computes) for r in retrieval.cache_split(texts, cache).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, False), 4: (False, True)}
    full = {r.ord: r.value for r in models.embed_missing(texts, cache, models.hashing_embedder(4)).collect()}
    assert full[1] == [9.0] and full[2] == full[3] != full[4] and len(full) == 4


def test_rag_section(spark):
    chunk = "query_id string, rank int, file_path string, start_line int, end_line int, name string, language string, content string, score double"
    a = spark.createDataFrame([("q", i, f"f{i}", 1, 2, "n", "python", "c" * 500, 0.9) for i in range(1, 6)], chunk)
    p = spark.createDataFrame([("q", 1, "high", "T", "b" * 200)], "query_id string, rank int, severity string, title string, body string")
    got = retrieval.rag_section(a, a.where("false"), p).first().section
    assert got.count("similarity 0.90") == 3 and "c" * 401 not in got and "b" * 151 not in got and "Call Sites" not in got


# --- intervals


def test_nearest_position_prefers_later(spark):
    pos = spark.createDataFrame([("f", 9, 1), ("f", 11, 2), ("f", 20, 3)], "file_path string, new_lineno int, diff_position int")
    probes = spark.createDataFrame([(i, "f", n) for i, n in enumerate((10, 9, 17, 16, 24, 23))], "probe_id int, file_path string, line int")
    got = {r.probe_id: r.diff_position for r in intervals.nearest_position(probes, pos, ["file_path"]).collect()}
    assert got == {0: 2, 1: 1, 2: 3, 5: 3}


def test_intervals_against_loops(spark):
    rng = random.Random(1)
    make = lambda n: [(i, rng.choice("ab"), s := rng.randrange(2000), s + rng.choice((0, 5, 600))) for i in range(n)]
    left, right = make(150), make(60)
    schema = "id int, f string, lo int, hi int"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    want = {x[0] for x in left if any(x[1] == y[1] and x[2] <= y[3] + 3 and x[3] >= y[2] - 3 for y in right)}
    args = (["f"], ("lo", "hi"), ("lo", "hi"), "id", 3)
    assert {r.id for r in intervals.overlapping(a, b, *args).collect()} == want
    assert {r.id for r in intervals.not_covered(a, b, *args).collect()} == {x[0] for x in left} - want
    nodes = b.select("f", F.col("lo").alias("start_line"), F.col("hi").alias("end_line"), F.col("id").alias("name"))
    points = a.select(F.col("id").alias("probe_id"), "f", F.col("lo").alias("line"))
    got = {r.probe_id: r.enclosing for r in intervals.innermost(points, nodes, ["f"]).collect()}
    for i, f, at, _ in left:
        around = [(y[2], -y[3]) for y in right if y[1] == f and y[2] <= at <= y[3]]
        assert (got[i] is None) == (not around)
        if around:
            y = next(y for y in right if y[0] == got[i])
            assert (y[2], -y[3]) == max(around)


def test_hunk_end(spark):
    rules = ("exact", "at_least_start", "one_past")
    r = one(spark, 1, "int").select(*(intervals.hunk_end(F.lit(7), F.lit(0), k).alias(k) for k in rules)).first()
    assert [r[k] for k in rules] == [6, 7, 7]


# --- findings

FIND = "review_id string, ord int, file_path string, line_start int, line_end int, diff_position int, severity string, confidence double"


def greedy(rows):
    order = {s: i for i, s in enumerate(("critical", "high", "medium", "low", "info"))}
    seeds, groups = [], {}
    for r in sorted(rows, key=lambda r: r[1]):
        for s in seeds:
            if s[2] == r[2] and s[3] <= r[4] + 3 and s[4] >= r[3] - 3:
                groups[s[1]].append(r)
                break
        else:
            seeds.append(r)
            groups[r[1]] = [r]
    return {min(g, key=lambda r: (order[r[6]], -r[7], r[1]))[1] for g in groups.values()}


def test_synthesis_is_seed_greedy(spark):
    rows = [("r", 1, "f", 10, 10, 1, "low", 0.5), ("r", 2, "f", 14, 14, 1, "low", 0.5), ("r", 3, "f", 12, 12, 1, "high", 0.5), ("r", 4, "f", 50, 50, 0, "critical", 0.9), ("r", 5, "g", 10, 10, 2, "odd", 0.9)]
    got = findings.synthesise(spark.createDataFrame(rows, FIND)).orderBy("pos").collect()
    assert [r.ord for r in got] == [3, 2]


def test_synthesis_against_loop(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        s = rng.randrange(300)
        rows.append(("r", i, rng.choice("abc"), s, s + rng.randrange(9), 1, rng.choice(("critical", "high", "medium", "low")), rng.choice((0.7, 0.8, 0.9))))
    df = spark.createDataFrame(rows, FIND)
    assert {r.ord for r in findings.synthesise(df, most=10**6).collect()} == greedy(rows)
    capped = findings.synthesise(df).collect()
    assert len(capped) == 25
    assert findings.synthesise(df, F.lit("high")).where("severity NOT IN ('critical', 'high')").count() == 0


def test_from_model(spark):
    pos = spark.createDataFrame([("f", 3, 9)], "file_path string, new_lineno int, diff_position int")
    text = '```json\n[{"line_start": 4, "severity": "HIGH", "category": "Security", "suggestion_code": " x "}, 7, {"line_start": 90}, {"line_start": 3, "line_end": 5, "severity": "odd"}]\n```'
    replies = spark.createDataFrame([("p", "f", text), ("q", "f", '{"a": 1}'), ("s", "f", "oops")], "prompt_id string, file_path string, response string")
    got = [(r.line_start, r.line_end, r.diff_position, r.severity, r.category, r.title, r.suggestion_code, r.confidence) for r in findings.from_model(replies, pos).orderBy("item_ord").collect()]
    assert got == [(4, 4, 9, "high", "security", "Issue found", "x", 0.9), (3, 5, 9, "odd", "bug", "Issue found", None, 0.8)]
    style = findings.from_model(replies, pos, "style").orderBy("item_ord").collect()
    assert [(r.severity, r.category, r.confidence) for r in style] == [("low", "style", 0.7)] * 2
    verdicts = spark.createDataFrame([("p:0", False, None)], "probe_id string, is_valid boolean, fixed_code string")
    first = findings.from_model(replies, pos, valid=verdicts).orderBy("item_ord").first()
    assert first.suggestion_code is None and findings.INVALID_NOTE in first.body


def test_from_impact_and_summary(spark):
    pos = spark.createDataFrame([("a.py", 3, 9), ("b.py", 8, 4)], "file_path string, new_lineno int, diff_position int")
    text = '{"has_breaking_changes": true, "affected_call_sites": [{"file": "b.py", "line": 8, "issue": "i", "suggestion": "s"}, {"file": "zz.py", "line": 3}, {"line": 70}]}'
    replies = spark.createDataFrame([("p", "fn", "a.py", text), ("q", "fn", "a.py", text.replace("true", "false"))], "prompt_id string, func_name string, changed_file string, response string")
    got = [(r.file_path, r.line_start, r.diff_position, r.severity, r.body) for r in findings.from_impact(replies, pos).orderBy("item_ord").collect()]
    assert got == [("b.py", 8, 4, "high", "i\n\n**Suggested fix:** s"), ("zz.py", 3, 9, "high", "Potential breaking change")]
    s = spark.createDataFrame([("a", '{"summary": "S", "key_changes": ["x", 1], "risk_level": "HIGH"}'), ("b", "[1]"), ("c", '{"risk_level": "wild", "key_changes": 3}')], "prompt_id string, response string")
    got = [(r.summary, r.key_changes, r.risk_level) for r in findings.summary_reply(s).orderBy("prompt_id").collect()]
    assert got == [("S", ["x", "1"], "high"), ("Change reviewed.", [], "low"), ("PR reviewed.", [], "low")]


def test_lint(spark):
    reports = spark.createDataFrame(
        [("a.py", "ruff", '[{"code":"E1","message":"m","location":{"row":5}},{"code":null,"location":{"row":6}},{"code":"W","location":{"row":99}}]'), ("a.js", "eslint", '[{"messages":[{"line":2,"ruleId":null,"message":"x","severity":2}]}]'), ("a.go", "gofmt", "a.go\n"), ("s.txt", "gitleaks", '[{"StartLine":77,"Description":"key"}]')],
        "file_path string, tool string, report string",
    )
    changed = spark.createDataFrame([("a.py", 5), ("a.py", 6), ("a.js", 2)], "file_path string, line int")
    got = sorted((r.file_path, r.tool, r.rule, r.line, r.severity) for r in findings.lint_findings(reports, changed).collect())
    assert got == [("a.go", "gofmt", "gofmt", 1, "warning"), ("a.js", "eslint", "eslint", 2, "error"), ("a.py", "ruff", "E1", 5, "error"), ("a.py", "ruff", "ruff", 6, "warning"), ("s.txt", "gitleaks", "secret", 77, "error")]
    pos = spark.createDataFrame([("s.txt", 78, 4)], "file_path string, new_lineno int, diff_position int")
    f = findings.from_lint(findings.lint_findings(reports).withColumn("probe_id", F.monotonically_increasing_id()), pos).collect()
    assert [(r.severity, r.category, r.diff_position, r.title) for r in f] == [("critical", "security", 4, "[gitleaks] secret")]


def test_keep_list(spark):
    f = spark.createDataFrame([("r", i) for i in range(40)] + [("s", 0), ("t", 0)], "review_id string, idx int")
    keep = spark.createDataFrame([("r", 39), ("s", 0)], "review_id string, idx int")
    got = findings.keep_listed(f, keep)
    assert sorted(r.idx for r in got.where("review_id = 'r'").collect()) == list(range(20))
    assert got.where("review_id IN ('s', 't')").count() == 2


def test_review_comments(spark):
    pos = spark.createDataFrame([("f", i, i + 1) for i in (1, 2, 3, 51, 52)], "file_path string, new_lineno int, diff_position int")
    hunks = spark.createDataFrame([("f", 1, 3), ("f", 51, 52)], "file_path string, hunk_start int, hunk_end int")
    f = spark.createDataFrame([(1, "f", 1, 1, 2, "b"), (2, "f", 1, 3, 2, "b"), (3, "f", 3, 51, 4, "b"), (4, "f", 2, 9, 3, "b")], "probe_id int, file_path string, line_start int, line_end int, diff_position int, body string")
    got = [(r.position, r.start_line, r.line, r.side) for r in findings.review_comments(f, pos, hunks).orderBy("probe_id").collect()]
    assert got == [(2, None, None, None), (None, 1, 3, "RIGHT"), (4, None, None, None), (3, None, None, None)]


# --- index, reviews, sources, sinks


def test_index_changes(spark):
    cols = "repo_id int, chunk_id string, file_path string, commit_sha string, content string"
    t = spark.createDataFrame([(1, "a", "x.py", "s0", "1"), (1, "b", "gone.py", "s0", "2"), (1, "c", "old.py", "s0", "3"), (2, "a", "x.py", "s0", "4"), (1, "d", "x.py", "s0", "5")], cols)
    files = spark.createDataFrame([(1, "gone.py", None, "removed"), (1, "new.py", "old.py", "renamed"), (1, "x.py", None, "modified")], "repo_id int, filename string, old_filename string, status string")
    new = spark.createDataFrame([(1, "a", "x.py", "s1", "11"), (1, "n", "new.py", "s1", "12")], cols)
    got = sorted((r.repo_id, r.chunk_id, r.content) for r in indexing.apply_change(t, files, new).collect())
    assert got == [(1, "a", "11"), (1, "n", "12"), (2, "a", "4")]


def test_reviews(spark):
    ev = spark.createDataFrame([("r", 0, "processing", 0, "2024-01-01"), ("r", 1, "completed", 3, "2024-01-02"), ("s", 0, "processing", 0, "2024-01-01"), ("s", 1, "failed", 0, "2024-01-03")], "review_id string, seq int, status string, findings_count int, at string")
    got = {r.review_id: (r.status, r.findings_count, r.completed_at, r.started_at) for r in reviews.review_state(ev).collect()}
    assert got == {"r": ("completed", 3, "2024-01-02", "2024-01-01"), "s": ("failed", 0, None, "2024-01-01")}
    kids = spark.createDataFrame([("r", 1), ("zz", 2)], "review_id string, v int")
    assert reviews.cascade_delete(kids, ev, "review_id").count() == 1


@pytest.mark.parametrize("text", ["", None, "- 1\n- 2", "review: 7", "a: [", "other: {}"])
def test_config_defaults(text):
    assert readers.parse_config(text) == readers.ReviewConfig()


def test_config(spark):
    text = "review:\n  enabled: false\n  ignore_patterns: ['*.md']\n  style: false\n  severity_threshold: high\n"
    got = readers.config_rows(spark.createDataFrame([(1, text), (2, None)], "repo_id int, content string")).orderBy("repo_id").collect()
    assert (got[0].enabled, got[0].ignore_patterns, got[0].style_review, got[0].severity_threshold) == (False, ["*.md"], False, "high")
    assert (got[1].enabled, got[1].ignore_patterns, got[1].custom_guidelines) == (True, [], "")


def test_sinks(spark, tmp_path):
    t = str(tmp_path / "chunks")
    assert sinks.ensure_table(spark, t, "k int, v int").count() == 0
    sinks.append(spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), t)
    sinks.replace_table(indexing.upsert(sinks.ensure_table(spark, t, "k int, v int"), spark.createDataFrame([(1, 9)], "k int, v int"), ["k"]), t)
    assert sorted(map(tuple, spark.read.parquet(t).collect())) == [(1, 9), (2, 2)]
    kv = str(tmp_path / "kv")
    sinks.kv_put(spark.createDataFrame([("a", "1")], "key string, value string"), kv, 60)
    sinks.kv_put(spark.createDataFrame([("b", "1")], "key string, value string"), kv, -60)
    got = readers.kv_get(spark.createDataFrame([("a",), ("b",)], "key string"), spark.read.parquet(kv))
    assert {r.key: r.value for r in got.collect()} == {"a": "1", "b": None}

    def post(rows):
        if any(r["v"] == 3 for r in rows):
            raise ValueError("no")

    sinks.post_rows(spark.createDataFrame([(i, i) for i in range(6)], "k int, v int"), post, str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_completion(spark):
    def down(prompt):
        raise OSError

    def flaky(prompt):
        return ("[1]" if "JSON only" in prompt else "words"), 10, 2

    got = models.complete(spark.createDataFrame([("a", "p")], "prompt_id string, prompt string"), [down, flaky], ["x", "y"]).first()
    assert (got.response, got.model, got.input_tokens, got.output_tokens, got.attempts) == ("[1]", "y", 20, 4, 2)


@pytest.mark.parametrize(
    ("code", "lang", "span", "want"),
    [("x = 1", "python", (0, 0), True), ("    x = 1\n    y = 2", "python", (0, 0), True), ("return x", "python", (0, 0), True), ("x = (", "python", (0, 0), False), ("x = (", "go", (0, 0), False), ("x = (", "ruby", (0, 0), True), ("  ", "go", (0, 0), False), ("a\nb", "go", (1, 9), False)],
)
def test_suggestions(code, lang, span, want):
    assert models.check_suggestion(code, lang, *span)[0] is want


def test_stream_replays_are_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("1", "pull_request", '{"action":"opened","pull_request":{"user":{"login":"x[bot]"}}}'), ("2", "pull_request", '{"action":"opened","pull_request":{"user":{"login":"ann"}}}')], "delivery_id string, event string, body string").write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    for _ in range(2):
        q = streams.write_batches(streams.routed(streams.file_stream(spark, str(src), schema)), streams.log_sink(out), str(tmp_path / "cp"))
        q.awaitTermination()
    got = {r.delivery_id: (r.route, r.queue) for r in spark.read.parquet(out).collect()}
    assert got == {"1": ("review", "skip"), "2": ("review", "fast_lane")} and spark.read.parquet(out).count() == 2
    q = streams.write_lanes(streams.routed(streams.file_stream(spark, str(src), schema)), str(tmp_path / "lanes"), str(tmp_path / "cp2"))
    q.awaitTermination()
    assert [r.queue for r in spark.read.parquet(str(tmp_path / "lanes")).collect()] == ["fast_lane"]


def test_rate_limit_and_progress(spark):
    calls = spark.createDataFrame([("r", f"2024-01-01 00:00:{s:02d}") for s in (0, 10, 20, 59)] + [("r", "2024-01-01 00:01:05")], "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = [r.in_window for r in indexing.rate_limited(calls, "k", "ts", 3).orderBy("ts").collect()]
    assert got == [1, 2, 3, 4, 4]
    log = spark.createDataFrame([(1, 1, 3, 1, 5, "running"), (1, 2, 3, 1, 5, "completed")], "repo_id int, batch_no int, total int, files int, chunks int, status string")
    repos = spark.createDataFrame([(1,), (2,)], "repo_id int")
    got = {r.repo_id: (r.status, r.percent) for r in indexing.progress(log, repos).collect()}
    assert got == {1: ("completed", 66.7), 2: ("not_indexed", 0.0)}


def test_threshold_is_not_rounded(spark):
    """0.7499996 shows as 0.75 but lies under it."""
    c = 0.7499996
    q = spark.createDataFrame([("q", 1, [1.0, 0.0])], "query_id string, repo_id int, vector array<double>")
    rows = [(1, "under", [c, (1 - c * c) ** 0.5]), (1, "over", [0.7500004, (1 - 0.7500004**2) ** 0.5])]
    got = retrieval.similar_chunks(q, spark.createDataFrame(rows, "repo_id int, chunk_id string, embedding array<double>"), 5, 0.75).collect()
    assert [(r.chunk_id, r.score) for r in got] == [("over", 0.75)]


@pytest.mark.parametrize("line", ["ignore_patterns: 7", "enabled: 'yes please'", "severity_threshold: 3", "ignore_patterns: '*.md'", "style: 1", "custom_guidelines: [a]", "ignore_patterns: [1, '*.md']"])
def test_config_of_wrong_types(spark, line):
    text = f"review:\n  {line}\n"
    assert readers.parse_config(text) == readers.ReviewConfig()
    row = readers.config_rows(spark.createDataFrame([(1, text)], "repo_id long, content string")).first()
    assert row.enabled and row.ignore_patterns == [] and row.severity_threshold == "low" and row.style_review


def test_installations_come_back(spark):
    ev = [(1, 9, "installation_created", [(1, "a"), (2, "b")]), (2, 9, "repos_removed", [(1, "a")]), (3, 9, "installation_deleted", []), (4, 9, "installation_created", [(2, "b")]), (5, 8, "repos_added", [(7, "x")])]
    e = spark.createDataFrame(ev, "seq long, installation_id long, route string, repos array<struct<id:long,full_name:string>>")
    known = spark.createDataFrame([(9, 3, "old", True), (8, 5, "y", True)], "installation_id long, repo_id long, repo_full_name string, active boolean")
    got = {(r.installation_id, r.repo_id): r.active for r in indexing.installed(e, known).collect()}
    assert got == {(9, 1): False, (9, 2): True, (9, 3): False, (8, 7): True, (8, 5): True}


def test_files_keep_their_place_without_context(spark):
    files = spark.createDataFrame([(1, "a"), (1, "b")], "diff_id int, filename string")
    found = spark.createDataFrame([(1, "a", "ctx"), (2, "b", "no")], "diff_id int, filename string, section string")
    assert {(r.filename, r.section) for r in retrieval.enriched_files(files, found).collect()} == {("a", "ctx"), ("b", None)}


def test_diff_texts(spark, tmp_path):
    """SRC-1: whole files as diffs, their names as ids."""
    for name, text in (("a.diff", "diff --git a/x b/x\n@@ -1 +1 @@\n+one\n"), ("b.diff", "")):
        (tmp_path / name).write_text(text)
    got = {r.diff_id: r.diff_text for r in readers.diff_texts(spark, str(tmp_path)).collect()}
    assert got["a.diff"].endswith("+one\n") and set(got) <= {"a.diff", "b.diff"}


def test_deliveries_come_once_and_the_last_state_counts(spark, tmp_path):
    """Repeats within the delay are dropped, over batches too; the log's last row of a key is its state."""
    schema = "delivery_id string, at timestamp, k long, v string"
    rows = [("a", 0, 1, "x"), ("b", 1, 1, "y"), ("a", 2, 1, "x"), ("c", 3, 2, "z"), ("b", 4, 1, "y"), ("d", 5, 1, "w")]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame([(d, datetime(2024, 1, 1, 0, 0, s), k, v) for d, s, k, v in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    once = streams.unique_deliveries(streams.file_stream(spark, f"{tmp_path}/in", schema, per_trigger=1))
    streams.write_batches(once, streams.log_sink(f"{tmp_path}/log"), f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.delivery_id for r in spark.read.parquet(f"{tmp_path}/log").collect()) == ["a", "b", "c", "d"]
    assert {(r.k, r.v) for r in streams.latest_view(spark, f"{tmp_path}/log", ["k"], "at").collect()} == {(1, "w"), (2, "z")}


def test_callers_of_several_functions_come_once(spark):
    rows = spark.createDataFrame([("q", "c1", 2, 1), ("q", "c1", 1, 3), ("q", "c2", 2, 2)], "query_id string, chunk_id string, name_ord int, rank int")
    assert {(r.chunk_id, r.name_ord) for r in retrieval.distinct_callers(rows).collect()} == {("c1", 1), ("c2", 2)}
