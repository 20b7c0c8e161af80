"""Operators that no SQL covers, against plain computations, and their edges."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import display, paths
from corvane.operators import budget, dependencies, documents, search, spans, trace
from corvane.plans import navigation


def test_callers_by_plain_search(spark):
    sites = navigation.sites_of(spark, "/root/testdata/sf0.001").select("path", "line", "callee", "caller", "text")
    rows = sorted(map(tuple, sites.collect()))

    def plain(root, depth, most_names, most_edges, skip, hub):
        edges, visited, hubs, frontier = [], set(), set(), {root}
        for hop in range(1, depth + 1):
            names = sorted(n for n in frontier if hop == 1 or (n not in skip and n not in hubs))[:most_names]
            frontier, tally = set(), {}
            for path, line, callee, caller, text in rows:
                if callee in names and len(edges) < most_edges:
                    tally[callee] = tally.get(callee, 0) + 1
                    edges.append((hop, caller, path, line, callee, text))
                    if caller != trace.TOP_LEVEL and (caller, path) not in visited:
                        visited.add((caller, path))
                        frontier.add(caller.rsplit(".", 1)[1])
            if len(edges) >= most_edges:
                break
            hubs |= {n for n, k in tally.items() if k >= hub}
        return sorted(edges)

    for arguments in ((3, 50, 10_000, (), 10_000), (4, 5, 10_000, (), 10_000), (3, 50, 777, (), 10_000), (3, 50, 10_000, ("f26",), 10_000), (5, 50, 10_000, (), 300)):
        found = trace.callers(sites, "T1.f13", arguments[0], arguments[1], arguments[2], arguments[3], arguments[4])
        assert sorted(found.edges) == plain("f13", *arguments) and len(found.edges) > 600
        assert found.edges == sorted(found.edges, key=lambda e: (e[0], e[2], e[3], e[4], e[1]))
    assert trace.callers(sites, "f13", 3, max_edges=777).edges_cut_at and trace.callers(sites, "nobody").unresolved == 1
    with pytest.raises(ValueError):
        trace.callers(sites, "f13", 6)


def test_names_end_at_their_last_separator():
    assert [trace.terminal(n) for n in ("A.B::m", "A::B.m", "m.", "m::", ".", "::", "a:b", "m", "")] == ["m", "m", "m", "m", "", "", "a:b", "m", ""]


def test_budgets_are_shared_out():
    assert budget.shares([100, 10, 100], 100) == [45, 10, 45]
    assert budget.shares([50, 50, 50], 100) == [34, 33, 33]
    assert budget.shares([5, 5], 100) == [5, 5] and budget.shares([], 9) == [] and budget.shares([3, 4], 0) == [0, 0] and sum(budget.shares([9] * 7, 5)) == 5


def test_spans_by_plain_search(spark):
    draw = random.Random(4)
    held = [(f"p{draw.randrange(3)}", k, a := draw.randrange(-5, 3000), a + draw.choice((0, 1, 7, 90, 2500, -2))) for k in range(400)]
    points = sorted({(f"p{draw.randrange(4)}", draw.randrange(-9, 4000)) for _ in range(900)})
    frame = spark.createDataFrame(held, "path string, id long, first long, last long")
    asked = spark.createDataFrame(points, "path string, at long")
    got = {(r.path, r["at"], r.id) for r in spans.containing(asked, frame, ["path"]).collect()}
    assert got == {(p, at, k) for p, at in points for q, k, a, b in held if p == q and a <= at <= b}
    assert spans.containing(asked, frame.limit(0), ["path"]).count() == 0
    named = spark.createDataFrame([("p", 1, 0, 9, True), ("p", 2, 2, 5, False), ("p", 3, 6, 8, True), ("p", 4, 6, 8, True)], "path string, id long, first long, last long, named boolean")
    asked = spark.createDataFrame([("p", k) for k in (0, 3, 7, 9, 10)], "path string, at long")
    assert {(r["at"], r.owner) for r in spans.narrowest_owner(asked, named).collect()} == {(0, 1), (9, 1)}


def test_fences_and_headings(spark):
    text = "# A\n````x y\n# no\n```\n````\n## B #\n~~~\n```\n~~~ \n   ### C {#c d}\n    # code\n#### \n#no\n# D ##\n```\n# in\nend"
    lines = spark.createDataFrame([("d.md", k + 1, t) for k, t in enumerate(text.split("\n"))], "path string, line int, text string")
    assert [(r.line, r.level, r.text, r["last"]) for r in documents.sections(lines).orderBy("line").collect()] == [(1, 1, "A", 13), (6, 2, "B", 13), (10, 3, "C #c", 13), (14, 1, "D", 17)]
    assert [(r.line, r["last"], r["name"]) for r in documents.code_blocks(lines).orderBy("line").collect()] == [(2, 5, "x"), (7, 9, "code"), (15, 17, "code")]
    assert documents.sections(lines.limit(0)).count() == 0


def test_column_functions_of_names_and_bytes(spark):
    one = spark.range(1)
    of = lambda c: one.select(c.alias("x")).first().x
    for n in range(9):
        assert of(display.byte_prefix(F.lit("aé€😀z"), n)) == "aé€😀z".encode()[:n].decode(errors="ignore")
    assert [of(display.token_count(F.lit(n).cast("long"))) for n in (999, 1000, 1050, 1150, 1250, 1350, 1_250_000, 999_950)] == ["999", "1.0k", "1.1k", "1.1k", "1.2k", "1.4k", "1.2M", "1000.0k"]
    assert [of(paths.extension(F.lit(n))) for n in ("a.b.c", ".env", "Makefile", ".env.local")] == ["c", "", "", "local"]
    assert of(dependencies.normalized(F.lit("a/./b/../c//d"))) == "a/c/d" and of(dependencies.normalized(F.lit("a/../../b"))) is None
    assert of(paths.common_folder(F.array(F.lit("a/b/c"), F.lit("a/b"), F.lit("a/bc")))) == "a" and of(paths.common_folder(F.array(F.lit("a"), F.lit("b")))) == "."
    assert of(display.is_newer_version(F.lit("1.10.0"), F.lit("1.9.9-rc"))) and not of(display.is_newer_version(F.lit("v2"), F.lit("0.0.1")))


def test_filters_are_read_strictly():
    assert search.qualifiers("Path:a text:b:c", ("path", "text")) == [("path", "a"), ("text", "b:c")]
    for bad in ("path", "path:", ":x", "other:x"):
        with pytest.raises(ValueError):
            search.qualifiers(bad, ("path",))
    assert search.line_range("3-7") == (3, 7) and search.line_range("4") == (4, 4)
    for bad in ("0", "7-3", "a", "-3", "3-", ""):
        with pytest.raises(ValueError):
            search.line_range(bad)


def test_python_that_does_not_parse_is_told(spark):
    from corvane.operators import syntax

    files = spark.createDataFrame([("a.py", "def f(:\n"), ("b.py", "def g(): return h(1)"), ("c.py", None), ("d.py", "x = 0\0"), ("e.py", "#" * 600_000)], "path string, content string")
    assert {r.path for r in syntax.errors(files).collect()} == {"a.py", "d.py", "e.py"}
    assert [(r.path, r.name, r.signature) for r in syntax.outline(files).collect()] == [("b.py", "g", "def g(): return h(1)")]
    assert [(r.path, r.callee, r.caller, r.returned) for r in syntax.calls(files).collect()] == [("b.py", "h", "g", True)]
    assert syntax.outline(files.limit(0)).count() == 0


def test_windows_cover_terms_greedily(spark):
    from corvane.plans import samples

    sf, terms, gap, span = "/root/testdata/sf0.001", ["handle", "user", "token"], 3, 12
    lines = samples.code_lines(spark, sf).select("path", "line", "text")
    by_path = {}
    for r in lines.collect():
        own = [t for t in terms if t in r.text]
        if own:
            by_path.setdefault(r.path, []).append((r.line, own))
    expected = set()
    for path, hits in by_path.items():
        windows = []
        for line, own in sorted(hits):
            if windows and line <= windows[-1][1] + gap and line - windows[-1][0] + 1 <= span:
                windows[-1][1], windows[-1][2], windows[-1][3] = line, windows[-1][2] + len(own), windows[-1][3] | set(own)
            else:
                windows.append([line, line, len(own), set(own)])
        covered, every, chosen = set(), set().union(*(w[3] for w in windows)), 0
        while chosen < 3 and windows and (len(covered) < len(every) or any(len(w[3]) > 1 for w in windows)):
            best = max(windows, key=lambda w: (len(w[3] - covered), len(w[3]), w[2], w[0] - w[1], -w[0]))
            windows.remove(best)
            covered |= best[3]
            chosen += 1
            expected.add((path, best[0], best[1], best[2], tuple(sorted(best[3]))))
    got = {(r[0], r[1], r[2], r[3], tuple(r[4])) for r in search.covering_windows(lines, terms, gap, span).select("path", "first", "last", "n_hits", "terms").collect()}
    assert got == expected and len(got) > 200
