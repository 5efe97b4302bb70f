"""DuckDB SQL for the queries of ``catalog.py``, written against the tables, not against the Spark forms."""

DOCS = """d AS (SELECT source AS repo_id, doc_id, source || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'min.js'
  WHEN 'de' THEN 'lock' WHEN 'es' THEN 'GO' ELSE 'txt' END AS file_path, text AS content, n_chars AS size FROM documents)"""
LINES = rf"""{DOCS}, ls AS (SELECT *, string_split(regexp_replace(regexp_replace(content, '(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}])', chr(10), 'g'), '\n$', ''), chr(10)) AS ls
  FROM d WHERE regexp_matches(content, '[^\s\x0b\x1c-\x1f\x85\x{{a0}}]'))"""
CHUNK_LANG = "CASE WHEN file_path LIKE '%.py' THEN 'python' WHEN file_path LIKE '%.js' THEN 'javascript' WHEN file_path LIKE '%.GO' THEN 'go' ELSE 'text' END"
EVENTS = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(day(ts) * 24 + hour(ts) AS INT) AS h FROM events)"
RANK = "CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END"
FINDINGS = f"""{EVENTS}, f AS (SELECT event_id AS ord, CAST(user_id AS VARCHAR) AS file_path, h AS line_start, CAST(h + event_id % 5 AS INT) AS line_end,
  {RANK} AS rank, ['critical', 'high', 'medium', 'low', 'info'][{RANK} + 1] AS severity, value AS confidence, event_type AS category FROM e)"""
#: The lines of the diffs that ``proxies.diffs`` makes, numbered by rule instead of parsed: i counts from 0, empty ones take no place.
DIFF = rf"""{DOCS}, raw AS (SELECT doc_id AS diff_id, file_path, unnest(string_split(regexp_replace(coalesce(content, ''), '\r\n?', chr(10), 'g'), chr(10))) AS x,
    generate_subscripts(string_split(regexp_replace(coalesce(content, ''), '\r\n?', chr(10), 'g'), chr(10)), 1) - 1 AS i FROM d),
  m AS (SELECT *, CASE i % 3 WHEN 0 THEN 'context' WHEN 1 THEN 'added' ELSE 'removed' END AS line_type, CASE WHEN i < 10 THEN 1 ELSE 2 END AS hunk_ord FROM raw),
  n AS (SELECT diff_id, file_path, x AS content, line_type, CAST(hunk_ord AS INT) AS hunk_ord, i,
    CASE WHEN line_type <> 'added' THEN CAST(CASE hunk_ord WHEN 1 THEN 0 ELSE 100 END + count(*) FILTER (line_type <> 'added') OVER w AS INT) END AS old_lineno,
    CASE WHEN line_type <> 'removed' THEN CAST(CASE hunk_ord WHEN 1 THEN 0 ELSE 200 END + count(*) FILTER (line_type <> 'removed') OVER w AS INT) END AS new_lineno,
    CAST(i + 1 + hunk_ord AS INT) AS diff_position FROM m WINDOW w AS (PARTITION BY diff_id, hunk_ord ORDER BY i))"""
RANGES = f"""{EVENTS}, h AS (SELECT event_id, user_id, h AS lo, h + 4 AS hi FROM e WHERE event_type = 'click'),
  f AS (SELECT user_id, h AS f_lo, h + 2 AS f_hi FROM e WHERE event_type = 'error')"""
BATCHES = "b AS (SELECT o_custkey AS repo_id, o_orderkey AS batch_no, 50 AS total, 2 AS files, o_orderkey % 5 AS chunks, o_orderstatus AS status FROM orders)"
NEAREST = """t AS (SELECT p.*, o.off, o.try FROM p, (VALUES (0, 0), (1, 1), (-1, 2), (2, 3), (-2, 4), (3, 5), (-3, 6)) AS o(off, try)),
  hit AS (SELECT t.*, t.line + t.off AS matched_line, pos.diff_position, row_number() OVER (PARTITION BY probe_id ORDER BY t.try) AS n
    FROM t JOIN pos ON pos.user_id = t.user_id AND pos.new_lineno = t.line + t.off)"""
VIEWS = "pos AS (SELECT user_id, h AS new_lineno, max(event_id) AS diff_position FROM e WHERE event_type = 'view' GROUP BY ALL)"
NO_REVIEW = r"\.(md|rst|txt|adoc|wiki|png|jpg|jpeg|gif|svg|ico|webp|lock|sum|map|iml)$|\.min\.(js|css)$"
SECURITY = "(auth|password|passwd|token|payment|billing|crypto|secret|jwt|oauth|credential|session|permission|rbac|acl|signature|hmac)"
TOP = "SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings c ON q.label = c.label"

SQL = {
    "context_topk": f"""WITH s AS ({TOP} AND q.vec_id <> c.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s WHERE score >= 0.25)
SELECT query_id, id AS chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
    "past_findings_topk": f"""WITH s AS ({TOP}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s)
SELECT query_id, id AS finding_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3""",
    "keyword_callers": f"""WITH {DOCS}, w AS (SELECT DISTINCT repo_id, doc_id, file_path, unnest(regexp_extract_all(lower(content), '[a-z]+')) AS token FROM d),
  h AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id, token ORDER BY file_path, doc_id) AS INT) AS rank FROM w WHERE token IN ('the', 'und', 'les', 'de'))
SELECT repo_id || ':' || token AS query_id, doc_id AS chunk_id, rank FROM h WHERE rank <= 10""",
    "token_budget": f"""WITH {DOCS}, t AS (SELECT repo_id, doc_id, coalesce(length(content) // 4, 0) AS tok FROM d),
  r AS (SELECT *, CAST(sum(tok) OVER (PARTITION BY repo_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM t)
SELECT * FROM r WHERE spent <= 4000""",
    "call_budget": f"""WITH {DOCS}, g AS (SELECT repo_id AS review_id, doc_id AS file_ord, CAST(doc_id % 5 + 1 AS INT) AS hunks,
    CASE WHEN regexp_matches(lower(file_path), '{SECURITY}') OR doc_id % 5 + 1 > 3 THEN 'FILE_LEVEL' ELSE 'HUNK_LEVEL' END AS granularity FROM d),
  u AS (SELECT review_id, file_ord, granularity, unnest(range(1, CASE granularity WHEN 'FILE_LEVEL' THEN 2 ELSE hunks + 1 END)) AS unit FROM g),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY review_id ORDER BY file_ord, unit) AS INT) AS call_no FROM u)
SELECT review_id, file_ord, CAST(unit AS INT) AS unit, call_no, granularity FROM r WHERE call_no <= 20""",
    "file_cap": f"WITH {DOCS}, r AS (SELECT repo_id AS diff_id, doc_id AS file_ord, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY doc_id) AS INT) AS file_no FROM d) SELECT * FROM r WHERE file_no <= 15",
    "cache_split": f"""WITH {DOCS}, t AS (SELECT doc_id, repo_id, substr(sha256(coalesce(content, '')), 1, 16) AS key FROM d), c AS (SELECT DISTINCT key FROM t WHERE repo_id = 'src0')
SELECT doc_id, t.key, c.key IS NOT NULL AS hit, c.key IS NULL AND row_number() OVER (PARTITION BY t.key ORDER BY doc_id) = 1 AS computes FROM t LEFT JOIN c ON c.key = t.key""",
    "payload_chunks": f"""WITH {EVENTS} SELECT CAST(event_id AS VARCHAR) AS chunk_id, event_type AS file_path, '' AS chunk_type, 'n' AS name, props AS content, k AS start_line, CAST(0 AS INT) AS end_line, '' AS language, value AS score FROM e""",
    "line_windows": f"""WITH {LINES}, p AS (SELECT *, unnest(range(0, len(ls), 4)) AS pos FROM ls)
SELECT file_path, '<window_' || pos // 4 || '>' AS name, array_to_string(ls[pos + 1 : pos + 5], chr(10)) AS content, CAST(pos + 1 AS INT) AS start_line, CAST(least(pos + 5, len(ls)) AS INT) AS end_line,
  {CHUNK_LANG} AS language, substr(sha256(file_path || ':<window_' || pos // 4 || '>:' || (pos + 1)), 1, 16) AS chunk_id FROM p""",
    "file_header": f"""WITH {LINES} SELECT file_path, '<file_header>' AS name, array_to_string(ls[1:50], chr(10)) AS content, CAST(1 AS INT) AS start_line, CAST(least(50, len(ls)) AS INT) AS end_line,
  {CHUNK_LANG} AS language, substr(sha256(file_path || ':<file_header>:1'), 1, 16) AS chunk_id FROM ls""",
    "token_windows": rf"""WITH {LINES}, t AS (SELECT file_path, regexp_extract_all(array_to_string(ls, chr(10)), '([\s\x0b]*[^\s\x0b]+|[\s\x0b]+$)') AS toks FROM ls),
  p AS (SELECT *, unnest(range(0, len(toks), 384)) AS pos FROM t),
  c AS (SELECT *, pos // 384 AS win, array_to_string(toks[pos + 1 : pos + 512], '') AS content, array_to_string(toks[1:pos], '') AS before FROM p),
  n AS (SELECT *, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INT) AS start_line FROM c)
SELECT file_path, '<window_' || win || '>' AS name, sha256(content) AS content_sha, start_line, CAST(start_line + length(content) - length(replace(content, chr(10), '')) AS INT) AS end_line,
  substr(sha256(file_path || ':<window_' || win || '>:' || start_line), 1, 16) AS chunk_id FROM n""",
    "chunk_dedup": f"""WITH {LINES}, c AS (SELECT file_path, 'file_header' AS chunk_type, '<file_header>' AS name, 1 AS start_line, least(50, len(ls)) AS end_line FROM ls
  UNION ALL SELECT file_path, 'window', '<window_' || pos // 80 || '>', pos + 1, least(pos + 100, n) FROM (SELECT file_path, len(ls) AS n, unnest(range(0, len(ls), 80)) AS pos FROM ls))
SELECT DISTINCT file_path, chunk_type, name, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, substr(sha256(file_path || ':' || name || ':' || start_line), 1, 16) AS chunk_id FROM c""",
    "semantic_chunks": rf"""WITH RECURSIVE {LINES}, n AS (SELECT file_path, ls, 'class' AS kind, 'whole' AS name, 1 AS s, len(ls) AS e FROM ls
    UNION ALL SELECT file_path, ls, 'function', '<anonymous>', (len(ls) - 1) // 2 + 1, len(ls) FROM ls),
  w AS (SELECT file_path, kind, name, s, e, ls[s:e] AS body FROM n),
  parts AS (
    SELECT file_path, name, s, body, 0 AS part, 0 AS lo, CASE WHEN len(body) > 100 THEN coalesce(list_max(list_filter(range(81, 101), lambda i: NOT regexp_matches(body[i], '\S'))), 100) ELSE len(body) END AS hi FROM w WHERE e - s + 1 > 100
    UNION ALL
    SELECT file_path, name, s, body, part + 1, greatest(hi - 5, lo + 1), CASE WHEN len(body) > greatest(hi - 5, lo + 1) + 100
      THEN coalesce(list_max(list_filter(range(greatest(hi - 5, lo + 1) + 81, greatest(hi - 5, lo + 1) + 101), lambda i: NOT regexp_matches(body[i], '\S'))), greatest(hi - 5, lo + 1) + 100) ELSE len(body) END
    FROM parts WHERE hi < len(body)),
  out AS (SELECT file_path, kind AS chunk_type, name, array_to_string(body, chr(10)) AS content, s AS start_line, e AS end_line FROM w WHERE e - s + 1 <= 100
    UNION ALL SELECT file_path, 'function', name || '__part' || part, array_to_string(body[lo + 1 : hi], chr(10)), s + lo, s + hi - 1 FROM parts)
SELECT file_path, chunk_type, name, content, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, substr(sha256(file_path || ':' || name || ':' || start_line), 1, 16) AS chunk_id FROM out""",
    "point_ids": f"""WITH {DOCS}, c AS (SELECT doc_id, substr(sha256(file_path || ':f:' || doc_id), 1, 16) AS chunk_id FROM d)
SELECT doc_id, chunk_id, substr(chunk_id, 1, 8) || '-' || substr(chunk_id, 9, 4) || '-' || substr(chunk_id, 13, 4) || '-0000-000000000000' AS point_id FROM c""",
    "languages": f"""WITH {DOCS} SELECT doc_id, CASE WHEN file_path LIKE '%.py' THEN 'python' WHEN file_path LIKE '%.js' THEN 'javascript' END AS diff_language, {CHUNK_LANG} AS chunk_language FROM d""",
    "gatekeeper_route": f"""WITH {EVENTS}, x AS (SELECT event_id, user_id, k, k % 60 AS n, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 60 END AS good, k % 11 <> 0 AS known,
    'u' || user_id || CASE WHEN user_id % 10 = 0 THEN '[bot]' ELSE '' END AS author, event_type = 'error' AND k % 2 = 0 AS draft FROM e),
  r AS (SELECT *, CASE WHEN user_id % 10 = 0 THEN 1 WHEN k % 7 = 0 THEN 2 WHEN draft THEN 3 WHEN known AND good = 0 THEN 4 WHEN known AND n > 50 THEN 5 WHEN known THEN 6 ELSE 7 END AS rule FROM x)
SELECT event_id, rule >= 5 AS should_process, CASE rule WHEN 1 THEN 'Bot PR from ' || author WHEN 2 THEN 'skip-ai-review label present' WHEN 3 THEN 'Draft PR — awaiting ready-for-review'
  WHEN 4 THEN 'All ' || n || ' files match no-review patterns' WHEN 5 THEN 'Large PR: ' || n || ' files → slow lane' WHEN 6 THEN 'Reviewable PR: ' || good || ' code files'
  ELSE 'No file list — defaulting to fast_lane' END AS reason, CASE WHEN rule < 5 THEN 'skip' WHEN rule = 5 THEN 'slow_lane' ELSE 'fast_lane' END AS queue FROM r""",
    "event_routes": f"""WITH {EVENTS}, x AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'pull_request' WHEN 'view' THEN 'installation' WHEN 'error' THEN 'installation_repositories'
    WHEN 'purchase' THEN 'pull_request_review_comment' ELSE 'push' END AS event, ['opened', 'created', 'added', 'removed'][k % 4 + 1] AS action FROM e)
SELECT *, CASE WHEN event = 'installation' AND action = 'created' THEN 'installation_created' WHEN event = 'installation_repositories' AND action = 'added' THEN 'repos_added'
  WHEN event = 'installation_repositories' AND action = 'removed' THEN 'repos_removed' WHEN event = 'pull_request' AND action = 'opened' THEN 'review'
  WHEN event = 'pull_request_review_comment' AND action = 'created' THEN 'comment' ELSE 'noop' END AS route FROM x""",
    "reviewable_paths": f"""WITH {DOCS} SELECT doc_id, file_path, NOT regexp_matches(file_path, '{NO_REVIEW}') AS reviewable,
  file_path GLOB 'src1/*' OR file_path GLOB '*.[gG]O' OR file_path GLOB 'src?/1*.py' AS ignored FROM d""",
    "code_files": f"WITH {DOCS} SELECT doc_id, file_path, size FROM d WHERE size <= 500000 AND regexp_matches(file_path, '\\.(py|GO)$')",
    "path_classes": rf"""SELECT page_id, regexp_matches(lower(url), '(test_|_test\.|\.test\.|\.spec\.|__test__|/tests?/|/spec/)') AS is_test, regexp_matches(lower(url), '{SECURITY}') AS security,
  string_split(url, '/')[-1] AS base FROM pages""",
    "segment_running": """WITH s AS (SELECT conv_id, turn, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS INT) AS seg FROM conversations)
SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, seg ORDER BY turn) AS INT) AS pos FROM s""",
    "diff_line_table": f"WITH {DIFF} SELECT diff_id, hunk_ord, content, line_type, old_lineno, new_lineno, diff_position FROM n",
    "diff_file_table": f"""WITH {DIFF} SELECT diff_id, any_value(file_path) AS filename, CAST(NULL AS VARCHAR) AS old_filename, 'modified' AS status,
  CASE WHEN any_value(file_path) LIKE '%.py' THEN 'python' WHEN any_value(file_path) LIKE '%.js' THEN 'javascript' END AS language, false AS is_binary,
  count(*) FILTER (line_type = 'added') AS additions, count(*) FILTER (line_type = 'removed') AS deletions FROM n GROUP BY diff_id""",
    "diff_hunk_table": f"""WITH {DIFF} SELECT DISTINCT diff_id, hunk_ord, CAST(CASE hunk_ord WHEN 1 THEN 1 ELSE 101 END AS INT) AS old_start, CAST(CASE hunk_ord WHEN 1 THEN 10 ELSE 1 END AS INT) AS old_count,
  CAST(CASE hunk_ord WHEN 1 THEN 1 ELSE 201 END AS INT) AS new_start, CAST(CASE hunk_ord WHEN 1 THEN 10 ELSE 1 END AS INT) AS new_count, CASE hunk_ord WHEN 1 THEN 'start' END AS function_context FROM n""",
    "line_positions": f"WITH {DIFF} SELECT diff_id, file_path, new_lineno, diff_position FROM n WHERE line_type <> 'removed'",
    "hunk_rendering": f"""WITH {DIFF} SELECT diff_id, hunk_ord, string_agg(printf('%4d', coalesce(new_lineno, old_lineno)) || ' ' || CASE line_type WHEN 'added' THEN '+' WHEN 'removed' THEN '-' ELSE ' ' END || ' ' || content, chr(10) ORDER BY i) AS rendered
FROM n GROUP BY ALL""",
    "change_query_text": f"""WITH {DIFF}, g AS (SELECT diff_id, hunk_ord, string_agg(content, chr(10) ORDER BY i) AS t FROM n WHERE line_type = 'added' GROUP BY ALL)
SELECT diff_id, substr(arg_min(t, hunk_ord), 1, 500) AS query_text FROM g GROUP BY diff_id""",
    "line_context": f"""WITH {DIFF} SELECT a.diff_id, a.diff_position, sha256(string_agg(printf('%4d', b.new_lineno) || ' ' || b.content, chr(10) ORDER BY b.i)) AS context_sha
FROM n a JOIN n b ON a.diff_id = b.diff_id AND a.hunk_ord = b.hunk_ord AND b.i BETWEEN a.i - 10 AND a.i + 10 AND b.line_type <> 'removed' WHERE a.line_type = 'added' GROUP BY ALL""",
    "scope_lines": rf"""WITH {DOCS}, ls AS (SELECT *, CASE WHEN content = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace(regexp_replace(content, '(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}])', chr(10), 'g'), '\n$', ''), chr(10)) END AS ls FROM d WHERE content IS NOT NULL),
  s AS (SELECT doc_id, ls, doc_id % 9 + 1 AS st FROM ls)
SELECT doc_id AS diff_id, coalesce(array_to_string(ls[greatest(st - 6, 0) + 1 : least(st + 7, len(ls))], chr(10)), '') AS scope_context FROM s""",
    "nearest_position": f"""WITH {EVENTS}, {VIEWS}, p AS (SELECT event_id AS probe_id, user_id, h AS line FROM e WHERE event_type = 'error'), {NEAREST}
SELECT probe_id, line, CAST(matched_line AS INT) AS matched_line, diff_position FROM hit WHERE n = 1""",
    "overlap_semi": f"WITH {RANGES} SELECT event_id, user_id, lo, hi FROM h WHERE EXISTS (SELECT 1 FROM f WHERE f.user_id = h.user_id AND lo <= f_hi + 3 AND hi >= f_lo - 3)",
    "covered_anti": f"WITH {RANGES} SELECT event_id, user_id, lo, hi FROM h WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = h.user_id AND lo <= f_hi + 3 AND hi >= f_lo - 3)",
    "innermost_scope": f"""WITH {EVENTS}, nodes AS (SELECT user_id, h AS s, h + event_id % 7 AS t, max(event_id) AS name FROM e WHERE event_type = 'purchase' GROUP BY ALL)
SELECT p.event_id AS probe_id, p.h AS line, (SELECT name FROM nodes n WHERE n.user_id = p.user_id AND n.s <= p.h AND p.h <= n.t ORDER BY n.s DESC, n.t LIMIT 1) AS enclosing FROM e p WHERE event_type = 'view'""",
    "same_hunk": f"""WITH {EVENTS} SELECT event_id AS probe_id, EXISTS (SELECT 1 FROM e c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND p.h >= c.h AND p.h + p.event_id % 3 <= c.h + 4) AS same_hunk
FROM e p WHERE event_type = 'signup'""",
    "dedup_findings": f"""WITH RECURSIVE {FINDINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY ord) AS k FROM f),
  walk AS (SELECT file_path, k, ord, ord AS seed, [{{'o': ord, 's': line_start, 'e': line_end}}] AS seeds FROM o WHERE k = 1
    UNION ALL SELECT file_path, k, ord, coalesce(hit, ord), CASE WHEN hit IS NULL THEN list_append(seeds, {{'o': ord, 's': line_start, 'e': line_end}}) ELSE seeds END
    FROM (SELECT o.file_path, o.k, o.ord, o.line_start, o.line_end, w.seeds, list_filter(w.seeds, lambda x: x.s <= o.line_end + 3 AND x.e >= o.line_start - 3)[1].o AS hit
      FROM walk w JOIN o ON o.file_path = w.file_path AND o.k = w.k + 1)),
  g AS (SELECT f.*, walk.seed, row_number() OVER (PARTITION BY f.file_path, walk.seed ORDER BY f.rank, f.confidence DESC, f.ord) AS n FROM f JOIN walk ON f.file_path = walk.file_path AND f.ord = walk.ord)
SELECT file_path, ord, seed AS seed_ord, rank, confidence FROM g WHERE n = 1""",
    "severity_counts": f"""WITH {FINDINGS} SELECT file_path, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low FROM f GROUP BY ALL""",
    "severity_gate": f"WITH {FINDINGS} SELECT ord, severity, CAST(ord % 4 AS INT) AS diff_position FROM f WHERE ord % 4 > 0 AND rank <= 2",
    "cap_by_severity": f"WITH {FINDINGS}, r AS (SELECT file_path, ord, CAST(row_number() OVER (PARTITION BY file_path ORDER BY rank, line_start, ord) AS INT) AS pos FROM f) SELECT * FROM r WHERE pos <= 25",
    "source_union": f"""WITH {FINDINGS}, s AS (SELECT *, CASE category WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS so FROM f WHERE category <> 'click')
SELECT file_path AS review_id, ['lint', 'bug', 'xfile', 'style'][so + 1] AS source, ord AS local_ord, CAST(row_number() OVER (PARTITION BY file_path ORDER BY so, ord) AS INT) AS ord FROM s""",
    "finding_comments": f"""WITH {FINDINGS} SELECT ord, '**' || CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' WHEN 'low' THEN '🔵' ELSE 'ℹ️' END || ' T' || ord || '** (' || severity || ')' || chr(10) || chr(10) || category
  || CASE WHEN ord % 3 = 0 THEN chr(10) || chr(10) || '```suggestion' || chr(10) || 'x = 1' || chr(10) || '```' ELSE '' END AS comment FROM f""",
    "review_summaries": f"""WITH {FINDINGS}, n AS (SELECT file_path, count(*) FILTER (rank = 0) AS c, count(*) FILTER (rank = 1) AS h, count(*) FILTER (rank = 2) AS m, count(*) FILTER (rank = 3) AS l FROM f GROUP BY ALL)
SELECT file_path AS review_id, '## Automated review' || chr(10) || chr(10) || CASE WHEN c > 5 THEN '**Summary:** Busy.' || chr(10) || chr(10) ELSE '' END || '| Severity | Count |' || chr(10) || '|----------|-------|' || chr(10)
  || '| 🔴 Critical | ' || c || ' |' || chr(10) || '| 🟠 High | ' || h || ' |' || chr(10) || '| 🟡 Medium | ' || m || ' |' || chr(10) || '| 🔵 Low | ' || l || ' |' || chr(10) || chr(10)
  || '> Reviewed ' || h || ' files, ' || l || ' hunks | Cost: $' || printf('%.4f', m / 8.0) || ' | Stages: lint, bugs' AS markdown FROM n""",
    "json_findings": f"""WITH {EVENTS}, {VIEWS}, p AS (SELECT event_id AS probe_id, user_id, h AS line, k FROM e WHERE event_type = 'error' AND k % 4 < 2), {NEAREST}
SELECT CAST(probe_id AS VARCHAR) AS prompt_id, user_id AS file_path, line AS line_start, line AS line_end, diff_position, 'high' AS severity, 'bug' AS category, 't' || k AS title, 0.8 AS confidence FROM hit WHERE n = 1""",
    "lint_ingest": f"""WITH {EVENTS} SELECT CAST(user_id AS VARCHAR) AS file_path, 'ruff' AS tool, CASE WHEN event_id % 2 = 0 THEN 'E501' ELSE 'W1' END AS rule, h AS line, 'm' AS message, CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'warning' END AS severity
  FROM e WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM e v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.h = e.h)
UNION ALL SELECT CAST(user_id AS VARCHAR), 'gitleaks', 'key', h, 'Potential secret detected: d', 'error' FROM e WHERE event_type = 'signup'""",
    "latest_wins": "SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "soft_delete": "SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'removed' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "delete_by_filter": f"WITH {DOCS} SELECT repo_id, file_path, doc_id FROM d WHERE repo_id NOT IN ('src1', 'src2') AND NOT (repo_id = 'src3' AND file_path LIKE '%.py')",
    "incremental_chunks": f"""WITH {LINES}, c AS (SELECT repo_id, file_path, substr(sha256(file_path || ':<file_header>:1'), 1, 16) AS chunk_id FROM ls)
SELECT *, substr(chunk_id, 1, 1) AS commit_sha FROM c WHERE NOT (repo_id < 'src2' AND substr(chunk_id, 1, 1) < '8')""",
    "upsert_stats": rf"""WITH {DOCS}, t AS (SELECT substr(sha256(content), 1, 16) AS key, length(content) // 4 AS tok, repo_id FROM d WHERE regexp_matches(content, '\S')),
  c AS (SELECT DISTINCT substr(sha256(content), 1, 16) AS key FROM d WHERE repo_id = 'src0'), m AS (SELECT key, any_value(tok) AS tok, count(*) AS n, key IN (SELECT key FROM c) AS hit FROM t GROUP BY key)
SELECT CAST(sum(n) AS BIGINT) AS chunks_upserted, CAST(coalesce(sum(n) FILTER (hit), 0) AS BIGINT) AS cache_hits, CAST(coalesce(sum(n) FILTER (NOT hit), 0) AS BIGINT) AS cache_misses,
  CAST(coalesce(sum(tok) FILTER (NOT hit), 0) AS BIGINT) AS tokens_used, CAST(coalesce(sum(tok) FILTER (NOT hit), 0) AS DOUBLE) * 0.02 / 1e6 AS cost_usd FROM m""",
    "review_rollup": """SELECT o_orderkey AS review_id, o_orderstatus AS status, count(l_orderkey) AS findings_count, count(DISTINCT l_partkey) AS files_reviewed
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
    "cost_by_model": """WITH c AS (SELECT CASE role WHEN 'user' THEN 'deepseek-chat' WHEN 'assistant' THEN 'deepseek-reasoner' ELSE 'other' END AS model, coalesce(length(text) // 4, 0) AS t FROM conversations),
  p AS (SELECT model, CASE model WHEN 'deepseek-reasoner' THEN 0.55 ELSE 0.14 END AS a, CASE model WHEN 'deepseek-reasoner' THEN 2.19 ELSE 0.28 END AS b, t FROM c)
SELECT model, count(*) AS calls, CAST(sum(t) AS BIGINT) AS input_tokens, CAST(sum(t * 2) AS BIGINT) AS output_tokens, CAST(round(CAST(sum(t * a + t * 2 * b) AS DOUBLE) / 1e6, 8) AS DOUBLE) AS cost_usd FROM p GROUP BY model""",
    "index_progress": f"""WITH {BATCHES}, g AS (SELECT repo_id, max(total) AS total, sum(files) AS done, sum(chunks) AS chunks, arg_max(status, batch_no) AS status FROM b GROUP BY repo_id)
SELECT c_custkey AS repo_id, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(done, 0) AS BIGINT) AS done, CAST(coalesce(chunks, 0) AS BIGINT) AS chunks_total, coalesce(status, 'not_indexed') AS status,
  CASE WHEN total > 0 THEN round(CAST(done AS DOUBLE) / total * 100, 1) ELSE 0.0 END AS percent FROM customer LEFT JOIN g ON repo_id = c_custkey""",
    "running_totals": f"""WITH {BATCHES} SELECT repo_id, batch_no, CAST(sum(files) OVER w AS BIGINT) AS files_so_far, CAST(sum(chunks) OVER w AS BIGINT) AS chunks_so_far FROM b
WINDOW w AS (PARTITION BY repo_id ORDER BY batch_no ROWS UNBOUNDED PRECEDING)""",
    "batch_slices": f"WITH {DOCS} SELECT repo_id, doc_id, CAST((row_number() OVER (PARTITION BY repo_id ORDER BY doc_id) - 1) // 20 AS INT) AS batch_no FROM d",
    "rate_limit": """WITH c AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM events) SELECT event_id, in_window, in_window > 2 AS over_limit FROM c""",
    "tree_listing": f"WITH {DOCS} SELECT file_path, CAST(length(content) AS INT) AS chars FROM d WHERE doc_id % 3 <> 0",
    "latest_open": "SELECT o_custkey AS repo_id, o_orderkey AS pr_number FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "default_heads": "SELECT c_custkey AS repo_id, n_name || '/' || r_name AS sha FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey",
    "kv_lookup": f"""WITH {EVENTS}, s AS (SELECT user_id, event_id, h FROM e WHERE event_type <> 'view' AND h >= 700 AND (h > 700 OR event_id > 0))
SELECT k.user_id AS key, arg_max(s.event_id, h * 1000000000000 + s.event_id) AS value FROM (SELECT DISTINCT user_id FROM e) k LEFT JOIN s ON s.user_id = k.user_id GROUP BY k.user_id""",
}

OFFSETS = "o AS (SELECT * FROM (VALUES (0, 0), (1, 1), (-1, 2), (2, 3), (-2, 4), (3, 5), (-3, 6)) AS o(off, try))"
_REPOS = "s AS (SELECT event_id AS seq, CAST(user_id % 20 AS BIGINT) AS inst, user_id AS repo, CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'add' WHEN 'view' THEN 'remove' WHEN 'error' THEN CASE WHEN event_id % 50 = 0 THEN 'end' END END AS what FROM events)"

SQL |= {
    "lint_to_findings": f"""WITH {EVENTS}, {VIEWS}, p AS (SELECT event_id AS probe_id, user_id, h AS line, event_id % 5 = 0 AS leak, event_id % 2 = 0 AS bad FROM e WHERE event_type = 'error'), {NEAREST}
SELECT user_id, probe_id, line AS line_start, line AS line_end, diff_position, CASE WHEN leak THEN 'critical' WHEN bad THEN 'medium' ELSE 'low' END AS severity, CASE WHEN leak THEN 'security' ELSE 'bug' END AS category,
  CASE WHEN leak THEN '[gitleaks] R' ELSE '[ruff] R' END AS title, 'm' AS body, 0.85 AS confidence FROM hit WHERE n = 1""",
    "lint_contexts": f"""WITH {EVENTS} SELECT user_id AS file_path, '**Static analysis findings for this file:**' || chr(10) || string_agg('  - Line ' || h || ' [ruff/R]: m', chr(10) ORDER BY event_id) AS lint_context FROM e WHERE event_type = 'error' GROUP BY ALL""",
    "style_findings": f"""WITH {EVENTS}, {VIEWS}, p AS (SELECT event_id AS probe_id, user_id, h AS line, k FROM e WHERE event_type = 'signup'), {NEAREST}
SELECT CAST(probe_id AS VARCHAR) AS prompt_id, user_id AS file_path, line AS line_start, line AS line_end, diff_position, CASE k % 3 WHEN 1 THEN 'medium' ELSE 'low' END AS severity, 'style' AS category, 'Style issue' AS title, 0.7 AS confidence FROM hit WHERE n = 1""",
    "impact_findings": f"""WITH {EVENTS}, {VIEWS}, {OFFSETS}, p AS (SELECT event_id, user_id, user_id + 1 AS other, h, k FROM e WHERE event_type = 'error' AND k % 3 <> 0),
  own AS (SELECT event_id, arg_min(diff_position, try) AS pos FROM p JOIN pos USING (user_id) JOIN o ON new_lineno = h + off GROUP BY event_id),
  back AS (SELECT event_id, arg_min(diff_position, try) AS pos FROM p JOIN pos ON pos.user_id = p.other JOIN o ON new_lineno = h + off GROUP BY event_id)
SELECT CAST(p.event_id AS VARCHAR) AS prompt_id, CAST(p.user_id AS VARCHAR) AS file_path, h AS line_start, coalesce(own.pos, back.pos) AS diff_position, 'i' || CASE WHEN k % 2 = 0 THEN chr(10) || chr(10) || '**Suggested fix:** s' ELSE '' END AS body
FROM p LEFT JOIN own USING (event_id) LEFT JOIN back USING (event_id) WHERE coalesce(own.pos, back.pos) IS NOT NULL""",
    "review_requests": f"""WITH {EVENTS}, {VIEWS}, p AS (SELECT event_id, user_id, h AS a, CAST(h + event_id % 3 AS INT) AS b FROM e WHERE event_type = 'signup'),
  m AS (SELECT *, a < b AND EXISTS (SELECT 1 FROM pos WHERE pos.user_id = p.user_id AND new_lineno = a) AND EXISTS (SELECT 1 FROM pos WHERE pos.user_id = p.user_id AND new_lineno = b)
    AND (NOT EXISTS (SELECT 1 FROM e c WHERE c.event_type = 'click' AND c.user_id = p.user_id) OR EXISTS (SELECT 1 FROM e c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND a >= c.h AND b <= c.h + 4)) AS multi FROM p)
SELECT event_id AS probe_id, user_id AS path, CASE WHEN NOT multi THEN event_id END AS position, CASE WHEN multi THEN a END AS start_line, CASE WHEN multi THEN b END AS line, CASE WHEN multi THEN 'RIGHT' END AS start_side, CASE WHEN multi THEN 'RIGHT' END AS side, 'b' AS body FROM m""",
    "rag_sections": f"""WITH {DOCS}, r AS (SELECT repo_id, file_path, doc_id, coalesce(content, '') AS c, row_number() OVER (PARTITION BY repo_id ORDER BY doc_id) AS n FROM d)
SELECT repo_id AS query_id, sha256('## Semantically Related Code in This Repository' || chr(10) || chr(10) || string_agg('**' || file_path || ':1–' || n || '** `n` (similarity 0.50):' || chr(10) || '```text' || chr(10) || substr(c, 1, 400) || chr(10) || '```', chr(10) || chr(10) ORDER BY n) FILTER (n <= 3)
  || chr(10) || chr(10) || '## Call Sites of Changed Functions' || chr(10) || chr(10) || string_agg('**' || file_path || ':1** `n`:' || chr(10) || '```text' || chr(10) || substr(c, 1, 300) || chr(10) || '```', chr(10) || chr(10) ORDER BY n) FILTER (n <= 3)
  || chr(10) || chr(10) || '## Similar Past Findings (Few-Shot Examples)' || chr(10) || chr(10) || string_agg('- **[low]** t: ' || substr(c, 1, 150), chr(10) || chr(10) ORDER BY n) FILTER (n <= 5)) AS section_sha FROM r GROUP BY repo_id""",
    "summary_replies": f"""WITH {EVENTS} SELECT CAST(event_id AS VARCHAR) AS prompt_id, CASE k % 4 WHEN 0 THEN 's' || k WHEN 1 THEN 'PR reviewed.' WHEN 2 THEN 'Change reviewed.' ELSE 'x' END AS summary, CASE WHEN k % 4 = 0 THEN 'a|b' ELSE '' END AS changes,
  CASE WHEN k % 4 = 0 THEN 'high' ELSE 'low' END AS risk_level FROM e""",
    "kept_findings": f"""WITH {EVENTS}, f AS (SELECT user_id AS review_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS total FROM e),
  m AS (SELECT *, CASE user_id3 WHEN 0 THEN NULL WHEN 1 THEN idx % 4 = 0 ELSE idx % 4 <> 0 END AS listed FROM (SELECT *, review_id % 3 AS user_id3 FROM f)),
  t AS (SELECT review_id, count(*) FILTER (listed) AS kept FROM m GROUP BY review_id)
SELECT review_id, CAST(idx AS INT) AS idx FROM m JOIN t USING (review_id) WHERE CASE WHEN user_id3 = 0 OR kept = 0 THEN true WHEN kept < total // 2 THEN idx < greatest(15, total // 2) ELSE listed END""",
    "changed_signatures": "SELECT doc_id AS diff_id, 'a.py' AS filename, 'f' || doc_id % 7 AS name, 'Function `f' || doc_id % 7 || '` signature was modified in `a.py`' AS description FROM documents WHERE doc_id % 4 <> 0",
    "function_gate": "SELECT doc_id AS diff_id, doc_id % 4 <> 0 AS touches_functions FROM documents",
    "changed_call_sites": """SELECT doc_id AS diff_id, 'a.py' AS changed_file, 'f' || doc_id % 7 AS name, 'b.py' AS site_file, 2 AS line, '   1 y = 2' || chr(10) || '   2 z = f' || doc_id % 5 || '(3)' AS code, 1 AS site_no
FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 7 = doc_id % 5""",
    "synthesis": f"""WITH RECURSIVE {FINDINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY ord) AS k FROM f WHERE ord % 4 > 0 AND rank <= 3),
  walk AS (SELECT file_path, k, ord, ord AS seed, [{{'o': ord, 's': line_start, 'e': line_end}}] AS seeds FROM o WHERE k = 1
    UNION ALL SELECT file_path, k, ord, coalesce(hit, ord), CASE WHEN hit IS NULL THEN list_append(seeds, {{'o': ord, 's': line_start, 'e': line_end}}) ELSE seeds END
    FROM (SELECT o.file_path, o.k, o.ord, o.line_start, o.line_end, w.seeds, list_filter(w.seeds, lambda x: x.s <= o.line_end + 3 AND x.e >= o.line_start - 3)[1].o AS hit
      FROM walk w JOIN o ON o.file_path = w.file_path AND o.k = w.k + 1)),
  g AS (SELECT o.*, walk.seed, row_number() OVER (PARTITION BY o.file_path, walk.seed ORDER BY o.rank, o.confidence DESC, o.ord) AS n FROM o JOIN walk ON o.file_path = walk.file_path AND o.ord = walk.ord),
  c AS (SELECT *, CAST(substr(file_path, 1, 1) AS VARCHAR) AS review_id, row_number() OVER (PARTITION BY substr(file_path, 1, 1) ORDER BY rank, seed) AS place FROM g WHERE n = 1)
SELECT review_id, file_path, ord, CAST(row_number() OVER (PARTITION BY review_id ORDER BY rank, file_path, line_start, seed) AS INT) AS pos FROM c WHERE place <= 25""",
    "dedup_views": f"""WITH {FINDINGS} SELECT file_path AS review_id, sha256('[' || string_agg('{{"id":' || (ord - 1) || ',"file":"' || file_path || '","line_start":' || line_start || ',"line_end":' || line_end || ',"severity":"' || severity || '","category":"' || category || '","title":"t","body":"b"}}', ',' ORDER BY ord) || ']') AS view_sha FROM f GROUP BY ALL""",
    "review_log": """SELECT user_id AS review_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq, min(ts) AS started_at, CASE WHEN arg_max(event_type, event_id) = 'completed' OR arg_max(event_type, event_id) = 'purchase' THEN arg_max(ts, event_id) END AS completed_at FROM events GROUP BY user_id""",
    "vector_upsert": f"""WITH {DOCS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS commit_sha FROM d UNION ALL SELECT doc_id + 1000000, 'new' FROM d WHERE doc_id % 5 = 0""",
    "kv_round_trip": "SELECT u.user_id AS key, m.value FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, max(event_id) AS value FROM events WHERE event_type = 'error' GROUP BY ALL) m USING (user_id)",
    "installation_state": f"""WITH {_REPOS}, r AS (SELECT inst, repo, max(seq) AS seq, arg_max(what, seq) AS what FROM s WHERE what IN ('add', 'remove') GROUP BY ALL), x AS (SELECT inst, max(seq) AS gone FROM s WHERE what = 'end' GROUP BY ALL)
SELECT inst AS installation_id, repo AS repo_id, 'r' || repo AS repo_full_name, what = 'add' AND (gone IS NULL OR gone < seq) AS active FROM r LEFT JOIN x USING (inst)""",
    "status_table": "SELECT doc_id AS diff_id, CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 3 = 1 THEN 'modified' ELSE 'removed' END AS status, count(*) AS files FROM documents GROUP BY ALL",
    "changed_line_table": f"WITH {DIFF} SELECT DISTINCT diff_id, file_path, new_lineno AS line FROM n WHERE line_type <> 'removed'",
    "function_name_lists": "WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations WHERE role <> '' GROUP BY ALL) SELECT conv_id AS diff_id, string_agg(role, ',' ORDER BY t, role) AS names FROM f GROUP BY ALL",
    "text_matches": f"WITH {DOCS} SELECT doc_id FROM d WHERE regexp_matches(content, '(?i)\\bthe\\b') AND regexp_matches(content, '(?i)\\band\\b')",
    "review_gates": """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'no_files' WHEN event_type = 'error' THEN 'disabled' WHEN event_id % 3 = 0 THEN 'none_reviewable' ELSE 'run' END AS gate, event_id % 7 <> 0 AND event_id % 2 = 0 AS rag, CASE WHEN event_type = 'view' THEN event_id % 2 = 0 ELSE true END AS style,
  CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'index' ELSE 'none' END AS action FROM events""",
    "point_lookup": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42",
    "payload_scroll": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1",
    "indexed_chunk_ids": f"WITH {LINES} SELECT substr(sha256(file_path || ':<file_header>:1'), 1, 16) AS chunk_id FROM ls WHERE doc_id = 7",
    "reviewed_counts": f"WITH {DIFF} SELECT diff_id, 1 AS files_reviewed, count(DISTINCT hunk_ord) AS hunks_reviewed FROM n GROUP BY diff_id",
    "bug_prompts": f"""WITH {DOCS} SELECT doc_id, sha256('Find defects in ' || file_path || '.' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'ctx' || doc_id ELSE '' END || chr(10) || '' || chr(10) || 'Diff:' || chr(10) || substr(coalesce(content, ''), 1, 3000) || chr(10)
  || 'Reply with a JSON list of objects: line_start, line_end, severity, category, title, body, suggestion_code.') AS prompt_sha FROM d""",
    "cached_descriptions": f"""WITH {DIFF}, g AS (SELECT diff_id, hunk_ord, string_agg(content, chr(10) ORDER BY i) AS t FROM n WHERE line_type = 'added' GROUP BY ALL), q AS (SELECT diff_id, substr(arg_min(t, hunk_ord), 1, 500) AS t FROM g GROUP BY diff_id)
SELECT diff_id, substr(sha256(t), 1, 16) < '8' AS hit, CASE WHEN substr(sha256(t), 1, 16) < '8' THEN 'known' ELSE substr(t, 1, 200) END AS description FROM q""",
}

#: The nodes of ``proxies.sources``: rows after the comment's own lines; names end in the document's id where ``own``.
_NODES = """v AS (SELECT * FROM (VALUES ('js', 0, 'function_declaration', 'f', true, 2, 4), ('js', 1, 'class_declaration', 'K', true, 5, 5), ('js', 2, 'method_definition', 'm', false, 5, 5),
    ('ts', 0, 'function_declaration', 'f', true, 2, 4), ('ts', 1, 'class_declaration', 'K', true, 5, 5), ('ts', 2, 'method_definition', 'm', false, 5, 5),
    ('go', 0, 'function_declaration', 'f', true, 2, 4), ('go', 1, 'method_declaration', 'm', false, 5, 5),
    ('rs', 0, 'function_item', 'f', true, 2, 4), ('rs', 1, 'impl_item', '<anonymous>', false, 5, 5), ('rs', 2, 'function_item', 'm', false, 5, 5),
    ('java', 0, 'class_declaration', 'K', true, 2, 4), ('java', 1, 'class_declaration', 'L', true, 5, 5), ('java', 2, 'method_declaration', 'm', false, 5, 5),
    ('py', 0, 'function_definition', 'f', true, 2, 3), ('py', 1, 'class_definition', 'K', true, 5, 6), ('py', 2, 'function_definition', 'm', false, 6, 6)) AS v(ext, node_ord, node_type, name, own, lo, hi)),
  d AS (SELECT doc_id, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS INT) AS nl FROM documents),
  n AS (SELECT doc_id, nl, ext, 'd' || doc_id || '.' || ext AS file_path, node_type, name || CASE WHEN own THEN CAST(doc_id AS VARCHAR) ELSE '' END AS name, lo + nl AS start_row, hi + nl AS end_row, node_ord FROM d, v)"""
_IMPORTS = "('js', 'import x{i} from ''m{i}'';'), ('ts', 'import {x{i}} from ''m{i}'';'), ('go', 'import \"m{i}\"'), ('go', '\"m{i}\"'), ('rs', 'use m{i};'), ('java', 'import m{i};'), ('py', 'import m{i}')"

SQL |= {
    "syntax_table": f"WITH {_NODES} SELECT file_path, node_type, name, start_row, end_row, node_ord FROM n",
    "import_table": f"""WITH v AS (SELECT *, CAST(row_number() OVER (PARTITION BY ext ORDER BY length(s) DESC) - 1 AS INT) AS import_ord FROM (VALUES {_IMPORTS}) AS v(ext, s))
SELECT 'd' || doc_id || '.' || ext AS file_path, import_ord, replace(s, '{{i}}', CAST(doc_id AS VARCHAR)) AS statement FROM documents, v""",
    "syntax_marks": """WITH d AS (SELECT doc_id, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS INT) AS nl, CAST(doc_id % 4 AS INT) AS a, CAST(doc_id % 3 AS INT) AS b FROM documents),
  e AS (SELECT doc_id, nl, CASE WHEN a > b THEN '(' ELSE ')' END || ' without partner' AS what, unnest(range(0, abs(a - b))) AS i FROM d)
SELECT 'd' || doc_id || '.' || ext AS file_path, CAST(i AS INT) AS error_ord, what, 6 + nl AS row FROM e, (VALUES ('js'), ('ts'), ('go'), ('rs'), ('java')) AS x(ext)""",
    "syntax_chunks": f"""WITH {_NODES}, q AS (SELECT doc_id, nl, 'd' || doc_id || '.' || ext AS file_path, ext, doc_id % 4 = 0 AND doc_id % 3 <> 0 AS bad,
    nl + 7 - CASE WHEN doc_id % 4 <> 0 OR doc_id % 3 = 0 THEN CASE WHEN ext = 'py' THEN 0 ELSE 1 END ELSE CASE WHEN ext = 'py' THEN -1 ELSE 0 END END AS lines FROM d, (SELECT DISTINCT ext FROM v)),
  c AS (SELECT file_path, 'file_header' AS chunk_type, '<file_header>' AS name, 1 AS start_line, least(50, lines) AS end_line FROM q
    UNION ALL SELECT file_path, 'window', '<window_' || pos // 80 || '>', pos + 1, least(pos + 100, lines) FROM (SELECT file_path, lines, unnest(range(0, lines, 80)) AS pos FROM q WHERE bad)
    UNION ALL SELECT n.file_path, CASE WHEN node_type LIKE '%class%' THEN 'class' ELSE 'function' END, name, start_row + 1, end_row + 1 FROM n JOIN q ON q.file_path = n.file_path WHERE NOT bad)
SELECT DISTINCT file_path, chunk_type, name, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line FROM c""",
}
_CACHE = """WITH o AS (SELECT event_id, ts, 'u' || user_id % 40 AS key, props, CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 6 WHEN 'purchase' THEN 6 END AS h FROM events),
  p AS (SELECT *, last_value(CASE WHEN h IS NOT NULL THEN {'v': props, 'u': ts + to_hours(h)} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id) AS l FROM o)
SELECT event_id AS op_id, key, CASE WHEN l.u > ts THEN l.v END AS value FROM p WHERE h IS NULL"""

SQL |= {"kv_stream": _CACHE, "kv_answers": _CACHE}

SQL |= {
    "admission": """WITH r AS (SELECT event_id, user_id % 7 AS key, ts, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) - 1 AS i FROM events),
  m AS (SELECT *, max(epoch_us(ts) - (i // 3) * 3600000000) OVER (PARTITION BY key, i % 3 ORDER BY i) + (i // 3) * 3600000000 AS a FROM r)
SELECT event_id, a AS admitted_us, a - epoch_us(ts) AS waited_us FROM m""",
}

_STAGES = {
    "summary": "'Summarise this change.' || chr(10) || 'Title: ' || file_path || chr(10) || 'Diff:' || chr(10) || t || chr(10) || 'Reply with a JSON object: summary, key_changes (list), risk_level (low, medium or high).'",
    "xfile": "repo_id || chr(10) || 'Call sites:' || chr(10) || t || chr(10) || 'Reply with a JSON object: has_breaking_changes, affected_call_sites (list of file, line, issue, suggestion).'",
    "style": "'Review the style of ' || file_path || '. ' || repo_id || chr(10) || 'Diff:' || chr(10) || t || chr(10) || 'Reply with a JSON list as for defects, severity low or medium.'",
    "dedup": "'Some of these findings may say the same.' || chr(10) || coalesce(content, '') || chr(10) || 'Reply with a JSON list of the ids to keep.'",
}

SQL |= {
    "table_upserts": f"""WITH {DOCS}, k AS (SELECT doc_id, repo_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS commit_sha FROM d WHERE doc_id % 11 <> 0 AND repo_id IS DISTINCT FROM 'src1'
    UNION ALL SELECT doc_id + 1000000, repo_id, 'new' FROM d WHERE doc_id % 5 = 0 AND repo_id IS DISTINCT FROM 'src1'), l AS (SELECT doc_id, repo_id, 'late' AS commit_sha FROM d WHERE doc_id % 13 = 0)
SELECT * FROM k WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT * FROM l""",
    "stored_text_matches": SQL["text_matches"],
    "stored_callers": SQL["keyword_callers"],
    "index_lane": "SELECT doc_id % 3 AS repo_id, 'c' || doc_id % 300 AS chunk_id, max('s' || lpad(CAST(doc_id // 300 AS VARCHAR), 6, '0')) AS commit_sha FROM documents GROUP BY ALL",
    "model_replies": """WITH p AS (SELECT doc_id, length(CAST(doc_id AS VARCHAR)) + 4 AS n, doc_id % 7 = 0 AS one, doc_id % 14 = 0 AS two, doc_id % 5 = 0 AS odd FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS prompt_id, CASE WHEN two THEN NULL WHEN one THEN '[]' ELSE '{"n": 1}' END AS response, CASE WHEN two THEN NULL WHEN one THEN 'second' ELSE 'first' END AS model,
  CASE WHEN two THEN 0 WHEN one THEN 1 WHEN odd THEN 2 * n + 23 ELSE n END AS input_tokens, CASE WHEN two THEN 0 WHEN one THEN 1 WHEN odd THEN 6 ELSE 3 END AS output_tokens,
  CASE WHEN odd AND NOT one THEN 2 ELSE 1 END AS attempts, CASE WHEN two THEN 'second: OSError: down' END AS error FROM p""",
    "stage_prompts": f"WITH {DOCS}, q AS (SELECT *, substr(coalesce(content, ''), 1, 3000) AS t FROM d) SELECT doc_id, " + ", ".join(f"sha256({text}) AS {stage}_sha" for stage, text in _STAGES.items()) + " FROM q",
    "started_reviews": "SELECT sha256(o_custkey || ':' || o_orderkey || ':' || o_orderstatus) AS review_id, o_custkey AS repo_id, o_orderkey AS pr_number, 'processing' AS status, 'pipeline' AS stage, 0 AS seq FROM orders",
    "finding_memory": "SELECT sha256('r:' || event_id || ':' || n) AS finding_id, event_type AS category, CAST(n AS INT) AS occurrence FROM events, (VALUES (1), (2)) AS o(n)",
    "dispatched_jobs": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'slow' ELSE 'fast' END AS queue FROM events",
    "reviewed_files": f"WITH {DOCS} SELECT repo_id AS diff_id, file_path AS filename FROM d WHERE NOT regexp_matches(file_path, '{NO_REVIEW}') AND (repo_id = 'src2' OR repo_id <> 'src1' AND NOT file_path GLOB '*.[gG]O')",
}

SQL |= {
    "told_descriptions": f"""WITH {DIFF}, g AS (SELECT diff_id, hunk_ord, string_agg(content, chr(10) ORDER BY i) AS t FROM n WHERE line_type = 'added' GROUP BY ALL), q AS (SELECT diff_id, substr(arg_min(t, hunk_ord), 1, 500) AS t FROM g GROUP BY diff_id),
  r AS (SELECT diff_id, t, substr(sha256(t), 1, 16) < '8' AS hit, length(t) + 43 AS n FROM q)
SELECT diff_id, hit, CASE WHEN NOT hit AND n <= 300 THEN 'small' END AS model, CASE WHEN hit THEN 'known' WHEN n <= 300 THEN 'said ' || n ELSE substr(t, 1, 200) END AS description FROM r""",
    "settings_rows": """SELECT doc_id AS repo_id, doc_id % 6 <> 1 AS enabled, CASE WHEN doc_id % 6 = 2 THEN 'be kind ' || doc_id ELSE '' END AS custom_guidelines, CASE WHEN doc_id % 6 = 2 THEN 'a/*,b' ELSE '' END AS ignore_patterns,
  CASE WHEN doc_id % 6 = 1 THEN 'high' ELSE 'low' END AS severity_threshold, doc_id % 6 <> 2 AS style_review FROM documents""",
    "post_rejects": "SELECT '{''doc_id'': ' || doc_id || '}' AS row, 'ValueError: bad row' AS error FROM documents WHERE doc_id % 97 = 5",
}

#: Every event is an opened pull request of its user, a draft if it is an error.
SQL["route_stream"] = """SELECT CAST(event_id AS VARCHAR) AS delivery_id, 'u' || user_id AS author, 'review' AS route, event_type <> 'error' AS should_process, CASE event_type WHEN 'error' THEN 'skip' ELSE 'fast_lane' END AS queue FROM events"""
