"""A whole review against plain loops over the same diffs, settings, linter rows and replies."""

import fnmatch
import json
import re

from difforge.functions import values as V
from difforge.plans import proxies as P
from difforge.plans import review

SF = "/root/testdata/sf0.001"
RANKS = {s: i for i, s in enumerate(V.SEVERITIES)}


def parse(text):
    """[(name, {new line: position}, [(first, last new line of a hunk)])] of a diff."""
    files, body = [], None
    for line in text.split("\n"):
        if line.startswith("diff --git "):
            body = {"name": re.match(r"diff --git a/(.*) b/(.*)$", line)[2], "map": {}, "hunks": [], "pos": 0}
            files.append(body)
        elif m := re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", line):
            body["pos"] += 1
            body["new"] = int(m[2]) - 1
            body["hunks"].append([])
        elif body["hunks"] and line and not line.startswith(("@@", "\\ No newline at end of file")):
            body["pos"] += 1
            if not line.startswith("-"):
                body["new"] += 1
                body["map"][body["new"]] = body["pos"]
                body["hunks"][-1].append(body["new"])
    return files


def nearest(mapped, line):
    return next((mapped[line + o] for o in (0, 1, -1, 2, -2, 3, -3) if line + o in mapped), None)


def expected(diffs, config, lint, replies):
    comments, gates = set(), {}
    for rid, text in diffs.items():
        files = parse(text)
        c = config[rid]
        kept = [f for f in files if not any(fnmatch.fnmatchcase(f["name"].rsplit("/", 1)[-1], g) for g in V.NO_REVIEW_GLOBS) and not set(f["name"].split("/")) & set(V.VENDOR_DIRS) and not any(fnmatch.fnmatchcase(f["name"], g) for g in c.ignore_patterns)]
        gates[rid] = "disabled" if not c.enabled else "none_reviewable" if not kept else "run"
        if gates[rid] != "run":
            continue
        files = {f["name"]: f for f in kept[: V.MAX_FILES]}
        found = []
        for r in sorted((r for r in lint if r.review_id == rid), key=lambda r: (r.file_path, r.line)):
            if r.file_path in files and (p := nearest(files[r.file_path]["map"], r.line)):
                leak = r.tool == "gitleaks"
                found.append([r.file_path, r.line, r.line, p, "critical" if leak else "medium" if r.severity == "error" else "low", f"[{r.tool}] {r.rule}", r.message, None, 0.85])
        for kind in ("bug", "style"):
            for r in sorted((r for r in replies[kind] if r.review_id == rid), key=lambda r: r.file_path):
                bare = re.sub(r"^```(?:json)?\s*|\s*```$", "", r.response)
                if r.file_path not in files or not bare.startswith("[") or kind == "style" and not c.style_review:
                    continue
                for x in json.loads(bare):
                    if p := nearest(files[r.file_path]["map"], x["line_start"]):
                        sure = 0.7 if kind == "style" else 0.9 if x["category"] == "security" else 0.8
                        found.append([r.file_path, x["line_start"], x["line_end"], p, "low" if kind == "style" else x["severity"], x["title"], x["body"], x.get("suggestion_code"), sure])
        found = [(i, *f) for i, f in enumerate(found) if RANKS[f[4]] <= RANKS[c.severity_threshold]]
        groups = []
        for f in found:
            home = next((g for g in groups if g[0][1] == f[1] and g[0][2] <= f[3] + 3 and g[0][3] >= f[2] - 3), None)
            groups.append([f]) if home is None else home.append(f)
        best = [(g[0][0], min(g, key=lambda f: (RANKS[f[5]], -f[9], f[0]))) for g in groups]
        best = sorted(best, key=lambda b: (RANKS[b[1][5]], b[0]))[: V.MAX_FINDINGS]
        best.sort(key=lambda b: (RANKS[b[1][5]], b[1][1], b[1][2], b[0]))
        for pos, (_, (_, path, lo, hi, at, severity, title, body, code, _)) in enumerate(best, 1):
            f = files[path]
            text = f"**{V.SEVERITY_MARKS[severity]} {title}** ({severity})\n\n{body}" + (f"\n\n```suggestion\n{code}\n```" if code else "")
            multi = lo < hi and lo in f["map"] and hi in f["map"] and any(h and h[0] <= lo and hi <= h[-1] for h in f["hunks"])
            comments.add((str(rid), pos, path, None if multi else at, lo if multi else None, hi if multi else None, text))
    return comments, gates


def test_a_review_equals_plain_loops(spark):
    many, config, lint, replies = P.review_input(spark, SF)
    many, config, lint = many.cache(), config.cache(), lint.cache()
    settings = {r.review_id: r for r in config.collect()}
    want, gates = expected({r.review_id: r.diff_text for r in many.collect()}, settings, lint.collect(), {k: v.collect() for k, v in replies.items()})
    out = review.review(many, config, lint, review.Replies(**replies))
    assert {r.review_id: r.gate for r in out.gates.collect()} == {str(k): v for k, v in gates.items()}
    got = [(r.review_id, r.pos, r.path, r.position, r.start_line, r.line, r.body) for r in out.comments.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    summaries = {r.review_id: r.markdown for r in out.summaries.collect()}
    assert set(summaries) == {str(k) for k, v in gates.items() if v == "run"}
    for rid, text in summaries.items():
        assert (f"Change {rid}" in text) == (int(rid) % 2 == 0)
        for s in V.SEVERITIES[:4]:
            n = sum(1 for c in want if c[0] == rid and c[6].split("\n")[0].endswith(f"({s})"))
            assert f"{V.SEVERITY_LABELS[s]} | {n} |" in text
