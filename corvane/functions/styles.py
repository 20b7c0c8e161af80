"""Names of style sheets as queries find them, and the files that a sheet names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPONENT = r"[.#][A-Za-z0-9_\-\x{80}-\x{10FFFF}]+"


def selector_matches(selector: Column, wanted: str) -> Column:
    """The whole selector, or one of its classes and ids, with or without its mark."""
    query = wanted.strip()
    parts = F.regexp_extract_all(selector, F.lit(COMPONENT), F.lit(0))
    found = F.exists(parts, lambda p: (p == query) | (F.substring(p, 2, 1 << 30) == query))
    return (selector == wanted) | (found if query else F.lit(False))


def variable_matches(name: Column, wanted: str) -> Column:
    return (name == wanted.strip()) | (F.regexp_replace(name, r"^[$@]+", "") == wanted.strip())


def at_rule_matches(name: Column, wanted: str) -> Column:
    return (name == wanted) | (F.regexp_extract(name, r"^@keyframes (\S+)", 1) == wanted)


def sources(content: Column) -> Column:
    """What @import, @use and @forward name and what url() holds, each once, in order; comments aren't read."""
    plain = F.regexp_replace(content, r"(?s)/\*.*?\*/", " ")
    named = F.regexp_extract_all(plain, F.lit(r"""(?i)@(?:import|use|forward)\s+(?:url\(\s*)?["']?([^"'\s);]+)|(?<![\w-])url\(\s*["']?([^"')]+?)\s*["']?\s*\)"""), F.lit(0))
    inner = F.transform(named, lambda x: F.regexp_replace(F.regexp_replace(x, r"""(?i)^@(?:import|use|forward)\s+""", ""), r"""(?i)^(?:url\(\s*)?["']?|["'\s)]+$""", ""))
    return F.array_distinct(F.filter(inner, lambda x: x != ""))
