"""Whole-number scores of matches, as one column: a sum of independent terms, so an order by score, path and line is total."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import code, paths
from corvane.functions.text import ascii_lower

# Path parts and words that lower a score.
VENDOR_DIRS = ("node_modules", "vendor", "dist", "build", ".git", "target", "__pycache__", ".venv", "venv", "pkg", "out")
FIXTURE_WORDS = ("mock", "fixture", "stub", "fake", "example")
DOC_EXTENSIONS = ("md", "mdx", "txt", "rst")


def _has(c: Column, part: str) -> Column:
    return F.contains(c, F.lit(part))


def _points(test: Column, n: int) -> Column:
    return F.when(test, n).otherwise(0)


def multi_word(path: Column, text: Column, query: str) -> Column:
    """All words of a query of several in path or text: 300; all but one: 120."""
    found = query.lower().split()
    if len(found) < 2:
        return F.lit(0)
    hay = ascii_lower(F.concat_ws(" ", path, text))
    n = reduce(lambda a, b: a + b, (_points(_has(hay, w), 1) for w in found))
    return F.when(n == len(found), 300).when(n >= len(found) - 1, 120).otherwise(0)


def scope_proximity(path: Column) -> Column:
    """200, less 20 for each part of the path below the scope, the file's name included."""
    return F.greatest(F.lit(0), 200 - 20 * F.size(F.split(path, "/")))


def basename(path: Column, query: str) -> Column:
    """How well the file's stem, or else its folder's name, is the query."""
    at = F.split(path, "/")
    own, q = ascii_lower(paths.stem(F.element_at(at, -1))), query.lower()
    if not q:
        return F.lit(0)
    after = F.substring(own, len(q) + 1, 1)
    folder = F.when(F.size(at) > 1, ascii_lower(F.element_at(at, -2))).otherwise("")
    return (
        F.when(own == q, 500).when(F.startswith(own, F.lit(q)) & after.isin("_", ".", "-"), 350).when(F.endswith(own, F.lit(q)), 250)
        .when(_has(own, q), 180).when(folder == q, 200).otherwise(0)
    )


def context_proximity(folder: Column, root: Column, context_folder: str, context_root: str | None) -> Column:
    """For matches near a file: 100 in its folder, 40 with two folders in common; 75 more in its package."""
    near = F.when(folder == context_folder, 100).when(paths.shared_depth(folder, F.lit(context_folder)) >= 2, 40).otherwise(0)
    return near + (_points(F.coalesce(root == context_root, F.lit(False)), 75) if context_root is not None else F.lit(0))


def definition_name(name: Column, impl_target: Column, query: str) -> Column:
    own, q = ascii_lower(name), query.lower()
    points = F.when(name == query, 220).when(own == q, 180).when(F.coalesce(impl_target == query, F.lit(False)), 120).when(F.startswith(own, F.lit(q)), 80).when(_has(own, q), 40).otherwise(0)
    return F.when(name.isNull(), 0).otherwise(points)


def query_intent(text: Column, query: str) -> Column:
    """A line that defines a type for a query with a capital, or a function for one without."""
    head = F.regexp_replace(text, r"^\s+", "")
    if query[:1].isupper():
        return _points(code.begins(head, code.TYPE_BEGINS), 90)
    return _points(code.begins(head, code.FUNCTION_BEGINS), 70) if query[:1].islower() else F.lit(0)


def incidental(text: Column, ext: Column, is_definition: Column, query: str) -> Column:
    """Comments: 150 for a whole line, 100 where only a trailing one has the query."""
    t = code.trimmed(text)
    comment = (F.startswith(t, F.lit("//")) & ~F.startswith(t, F.lit("///"))) | code.begins(t, ("/*", "<!--")) | (F.startswith(t, F.lit("#")) & ext.isin(*code.HASH_COMMENT_EXTENSIONS))
    low, q = ascii_lower(t), F.lit(query.lower())
    at = F.instr(low, F.lit("//"))
    before = F.substr(low, F.lit(1), at - 1)
    trailing = (at > 1) & ~F.endswith(before, F.lit(":")) & F.contains(F.substr(low, at), q) & ~F.contains(before, q)
    return F.when(is_definition, 0).when(comment, 150).when(trailing, 100).otherwise(0)


def is_test_query(query: str) -> bool:
    q = query.lower()
    return "test" in q or "spec" in q or q.startswith("should")


def recency(a: Column) -> Column:
    """By age in seconds: what lies ahead is new, an unknown age (null) is old."""
    return F.when(a <= 3_600, 100).when(a <= 86_400, 80).when(a <= 604_800, 50).when(a <= 2_592_000, 20).otherwise(0)


def exported_api(text: Column) -> Column:
    head = F.regexp_replace(text, r"^\s+", "")
    return F.when(F.startswith(head, F.lit("export default ")), 90).when(F.startswith(head, F.lit("export ")), 75).when(F.startswith(head, F.lit("pub ")), 60).otherwise(0)


def non_code(path: Column, ext: Column) -> Column:
    docs = ext.isin(*DOC_EXTENSIONS) | F.arrays_overlap(F.split(path, "/"), F.array(F.lit("docs"), F.lit("doc")))
    sample = (_has(path, "example") | _has(path, "sample") | _has(path, "template")) & ext.isin("md", "txt", "rst")
    return _points(docs, 250) + _points(sample, 80) + _points(_has(path, "generated"), 150)


def _fixture_points(c: Column, each: int) -> Column:
    low = ascii_lower(c)
    return reduce(lambda a, b: a + b, (_points(_has(low, w), each) for w in FIXTURE_WORDS))


def fixture(path_points: Column, text: Column) -> Column:
    """What a path (``_fixture_points`` of 90) and a line say of fixtures, 200 at most."""
    return F.least(F.lit(200), path_points + _fixture_points(text, 40))


def vendor(path: Column) -> Column:
    return _points(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR_DIRS))), 200)


def file_terms(query: str, path: Column, ext: Column, est_lines: Column, age: Column) -> dict[str, Column]:
    """The terms of a match's score that its file decides, and ``fixture_path`` for ``line_terms``. They are computed for each file, before matches join them."""
    return {
        "proximity": scope_proximity(path), "recency": recency(age), "small": _points((est_lines > 0) & (est_lines < 200), 50), "basename": basename(path, query), "non_code": -non_code(path, ext),
        "tests": F.lit(0) if is_test_query(query) else -_points(paths.is_test_file(path), 120), "vendor": -vendor(path), "fixture_path": _fixture_points(path, 90),
    }


def line_terms(query: str, m: dict[str, Column]) -> dict[str, Column]:
    """The terms that a match itself decides: ``m`` has its path, ext, text, is_definition, exact, def_name, def_weight, impl_target and its file's fixture_path."""
    return {
        "weight": F.when(m["is_definition"], m["def_weight"] * 10).otherwise(0), "definition": F.when(m["is_definition"], definition_name(m["def_name"], m["impl_target"], query)).otherwise(0), "exact": _points(m["exact"], 500),
        "intent": query_intent(m["text"], query), "words": multi_word(m["path"], m["text"], query), "exported": exported_api(m["text"]), "incidental": -incidental(m["text"], m["ext"], m["is_definition"], query), "fixtures": -fixture(m["fixture_path"], m["text"]),
    }


FILE_TERMS = ("proximity", "recency", "small", "basename", "non_code", "tests", "vendor")


def score(query: str, m: dict[str, Column]) -> Column:
    """The score of matches that carry their file's terms as columns."""
    return reduce(lambda a, b: a + b, [*line_terms(query, m).values(), *(m[k] for k in FILE_TERMS)])
