"""Reading of search queries: what kind each is, and its parts. All are column functions, so that a table of queries can be read at once."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import ascii_lower, is_identifier

# Extensions that make what follows a dot a file's, names of files without one, and characters that a backslash makes a pattern of.
FILE_EXTENSIONS = (
    "rs", "go", "py", "pyi", "ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "java", "kt", "kts", "scala", "swift", "rb", "php", "cs", "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx", "m", "mm", "lua", "dart", "ex", "exs",
    "erl", "hrl", "elm", "hs", "clj", "cljs", "cljc", "ml", "mli", "fs", "fsi", "fsx", "vb", "pas", "pl", "pm", "r", "jl", "nim", "zig", "v", "sh", "bash", "zsh", "fish", "ps1", "bat", "cmd", "html", "htm", "css", "scss", "sass",
    "less", "vue", "svelte", "astro", "md", "mdx", "rst", "adoc", "txt", "tex", "yaml", "yml", "toml", "json", "jsonc", "json5", "xml", "ini", "cfg", "conf", "env", "proto", "graphql", "gql", "sql", "prisma", "wasm", "lock",
)
FILE_NAMES = (
    "README", "LICENSE", "Makefile", "GNUmakefile", "Dockerfile", "Containerfile", "Vagrantfile", "Rakefile", "Gemfile", "Procfile", "Justfile", "Taskfile", "CHANGELOG", "CONTRIBUTING", "AUTHORS", "CODEOWNERS",
)
ESCAPED = r"\\[().\[{bwsd]"
_WORD = r"[A-Za-z0-9_$@.-]+"


def _holds(q: Column, part: str) -> Column:
    return F.contains(q, F.lit(part))


def is_exact_symbol(q: Column) -> Column:
    """An identifier that its form shows to be a name: a capital, a mark, or a capital after a small letter."""
    return q.rlike(r"^[A-Z$@]|::|\.|_|-|^[a-z].*[A-Z]")


def has_glob(q: Column) -> Column:
    return q.rlike(r"[*?{\[]")


def looks_like_file_glob(q: Column) -> Column:
    ext = F.regexp_replace(F.regexp_replace(F.regexp_extract(q, r"\.([^.]*)$", 1), r"\}+$", ""), r"\]+$", "")
    return q.rlike(r"[/\\]|^\*\.|\*\.\{|\?\.") | (_holds(q, ".") & ext.isin(*FILE_EXTENSIONS))


def looks_like_path(q: Column) -> Column:
    return q.rlike(r"[/\\]")


def looks_like_file_name(q: Column) -> Column:
    return ~q.rlike("[ /]") & (q.rlike(r"^.+\.[^.]+$") | q.isin(*FILE_NAMES))


def is_dotted_symbol(q: Column) -> Column:
    after = F.regexp_extract(q, r"^.+\.([^.]+)$", 1)
    before = F.regexp_extract(q, r"^(.+)\.[^.]+$", 1)
    return is_identifier(before) & is_identifier(after) & ~ascii_lower(after).isin(*FILE_EXTENSIONS)


def line_range(value: Column) -> Column:
    """N or A-B as a struct of first and last; null unless A is positive and B at least A."""
    one, both = value.rlike(r"^\+?[0-9]{1,9}$"), value.rlike(r"^\+?[0-9]{1,9}-\+?[0-9]{1,9}$")
    first = F.regexp_extract(value, r"^\+?([0-9]+)", 1).try_cast("long")
    last = F.when(one, first).otherwise(F.regexp_extract(value, r"-\+?([0-9]+)$", 1).try_cast("long"))
    return F.when((one | both) & (first > 0) & (last >= first), F.struct(first.alias("first"), last.alias("last")))


def path_section(q: Column) -> Column:
    """The path and the section of path:N or path:A-B; null for other queries."""
    path, section = F.regexp_extract(q, r"^(?s:(.*)):[^:]*$", 1), F.regexp_extract(q, r":([^:]*)$", 1)
    return F.when((path != "") & line_range(section).isNotNull(), F.struct(path.alias("path"), section.alias("section")))


def cooccurrence(q: Column) -> Column:
    """The first two terms of a.*b, or else of a.+b, if all parts are words; null else."""
    out = F.lit(None)
    for sep in (".+", ".*"):
        parts = F.transform(F.split(q, re.escape(sep)), lambda t: F.trim(t))
        good = (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(f"^{_WORD}$"))
        out = F.when(good, F.struct(F.get(parts, 0).alias("first"), F.get(parts, 1).alias("second"))).otherwise(out)
    return out


def de_escaped(q: Column) -> Column:
    return F.regexp_replace(q, r"\\([().\[{bwsd])", "$1")


def identifier_core(q: Column) -> Column:
    return F.regexp_replace(q, r"[^A-Za-z0-9_$@.-]", "")


def multi_symbols(q: Column) -> Column:
    """Two to five identifiers between commas; null else. More than five identifiers are an error: an empty array."""
    parts = F.filter(F.transform(F.split(q, ","), lambda t: F.trim(t)), lambda p: p != "")
    names = _holds(q, ",") & F.forall(parts, is_identifier)
    return F.when(names & F.size(parts).between(2, 5), parts).when(names & (F.size(parts) > 5), F.array().cast("array<string>"))


def numbered_terms(q: Column) -> Column:
    """The terms between commas with their places from 1 on; empty ones go and leave a gap."""
    parts = F.transform(F.split(q, ","), lambda t, i: F.struct((i + 1).alias("slot"), F.trim(t).alias("term")))
    return F.filter(parts, lambda p: p["term"] != "")


def relaxed_pattern(q: Column) -> Column:
    """A pattern for lines with the words of a query: both, in any order, for two; any of more."""
    quoted = F.transform(F.split(F.trim(q), r"\s+"), lambda w: F.regexp_replace(w, r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\$1"))
    a, b = F.get(quoted, 0), F.get(quoted, 1)
    return F.when(F.size(quoted) == 2, F.concat(a, F.lit(".*"), b, F.lit("|"), b, F.lit(".*"), a)).otherwise(F.array_join(quoted, "|"))


def classify(q: Column, there: Column, section_there: Column) -> Column:
    """The kind of a query. ``there``: whether it names an existing path; ``section_there``: whether what is before its last colon does."""
    section = path_section(q)
    words = F.split(F.trim(q), r"\s+")
    drive = q.rlike(r"^[A-Za-z]:\\")
    simple = _holds(q, " ") & (F.size(words) <= 4) & F.forall(words, lambda w: w.rlike("^[A-Za-z0-9_-]+$"))
    file_name = looks_like_file_name(q)
    return (
        F.when(~drive & ~there & cooccurrence(q).isNotNull(), "co-occurrence").when(~drive & ~there & q.rlike(ESCAPED), "pattern text")
        .when(section.isNotNull() & section_there, F.when(section["section"].rlike(r"^\+?[0-9]+$"), "path line").otherwise("path section"))
        .when(~_holds(q, " ") & has_glob(q), F.when(looks_like_file_glob(q), "glob").otherwise("symbol glob"))
        .when(looks_like_path(q), F.when(there, "path").otherwise("fallthrough")).when(F.startswith(q, F.lit(".")) & there, "path").when(q.rlike("^[0-9]*$"), "fallthrough")
        .when(file_name & there, "path").when(file_name & ~is_dotted_symbol(q), "glob")
        .when(is_identifier(q), F.when(is_exact_symbol(q), "symbol").otherwise("concept")).when(simple, "concept").otherwise("fallthrough")
    )
