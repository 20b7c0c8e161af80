"""Imports of source files: what a line imports, where that could be, and which file it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import code, paths
from corvane.functions.text import is_external_link

JS = ("typescript", "tsx", "javascript")
JVM = ("java", "scala", "kotlin")
# What is tried after a path, in order.
JS_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")
JS_SWAPS = {"js": ("ts", "tsx", "mts", "cts"), "jsx": ("tsx",), "mjs": ("mts",), "cjs": ("cts",)}
STYLE_EXTENSIONS = {"css": ("css",), "scss": ("scss", "css"), "less": ("less", "css")}
DOCUMENT_EXTENSIONS = {"html": ("html", "htm", "md"), "markdown": ("md", "mdx", "rst", "html", "htm")}
DOCUMENT_INDEXES = ("README.md", "index.md", "index.html", "index.htm")
#: Languages whose candidates must be one file alone; others take the first that exists.
UNIQUE = ("python", "c", "cpp")


def imports(lines: DataFrame) -> DataFrame:
    """path, line, language and source of import lines (path, name, line, text)."""
    maybe = lines.filter(F.col("text").rlike(r"\b(?:use|import|export|from|require)\b|^\s*#include"))  # one cheap look before the patterns by language
    told = maybe.withColumn("language", paths.language(F.col("name")))
    t, language = F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), ";+$", ""), F.col("language")
    part = lambda pattern: F.regexp_extract(t, pattern, 1)
    quotes = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "^[\"';]+|[\"';]+$", "")
    source = (
        F.when(language == "rust", F.regexp_replace(F.regexp_replace(part(r"^use ([^{]*)"), r"^\s+|\s+$", ""), "(?:::)+$", ""))
        .when(language.isin(*JS), F.coalesce(F.nullif(part(r"^(?:import|export)\b.*\bfrom\s*[\"']([^\"']+)"), F.lit("")), F.nullif(part(r"^import\s*[\"']([^\"']+)"), F.lit("")), part(r"\brequire\(\s*[\"']([^\"']+)")))
        .when(language == "python", F.when(t.rlike("^import "), quotes(part("^import (.*)$"))).otherwise(part(r"^from (\S+)")))
        .when(language == "go", quotes(part(r"^import\s(.*)$"))).when(language.isin(*JVM), part(r"^import\s+(?:static\s+)?(\S+)")).when(language.isin("c", "cpp"), F.trim(part("^#include(.*)$")))
    )
    return told.select("path", "line", "language", source.alias("source")).filter("source <> ''")


def normalized(path: Column) -> Column:
    """Without empty and . parts, and with .. taken with the folder before it; null where that leaves the tree."""
    start = F.array().cast("array<string>")
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(p)))
    return F.aggregate(F.split(path, "/"), start, step, lambda a: F.array_join(a, "/"))


def _with(base: Column, endings) -> Column:
    return F.array(*[F.concat(base, F.lit(e)) for e in endings])


def _swapped(base: Column, ext: Column) -> Column:
    """Sources that a runtime file may be made from."""
    plain = F.regexp_replace(base, r"\.[^./]*$", ".")
    return reduce(lambda out, kv: F.when(ext == kv[0], _with(plain, kv[1])).otherwise(out), JS_SWAPS.items(), F.array().cast("array<string>"))


def _rust(folder: Column, source: Column) -> Column:
    above = F.regexp_extract(folder, r"^(.*/)?src(?:/|$)", 0)
    base = F.when(F.startswith(source, F.lit("crate::")), F.regexp_replace(above, "/$", "")).when(F.startswith(source, F.lit("super::")), F.regexp_replace(folder, r"/?[^/]*$", "")).otherwise(folder)
    names = F.split(F.regexp_replace(source, "^(?:crate|self|super)::", ""), "::")
    lengths = F.reverse(F.sequence(F.lit(1), F.size(names)))
    tries = F.flatten(F.transform(lengths, lambda n: F.array(*[F.concat(base, F.lit("/"), F.array_join(F.slice(names, F.lit(1), n), "/"), F.lit(e)) for e in (".rs", "/mod.rs")])))
    return F.when(source.rlike("^(?:crate|self|super)::") & (~F.startswith(source, F.lit("crate::")) | (above != "")), tries)


def candidates(folder: Column, source: Column, language: Column) -> Column:
    """The paths that an import could mean, those tried first before others; not yet normalised, and none for what can't be a file."""
    clean = F.regexp_replace(F.split(source, "[?#]")[0], r"^\s+|\s+$", "")
    base, ext = F.concat(folder, F.lit("/"), clean), paths.extension(F.element_at(F.split(clean, "/"), -1))
    bare = ext == ""
    js = F.concat(F.array(base), _swapped(base, ext), F.when(ext.isin("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs"), F.array().cast("array<string>")).otherwise(_with(base, JS_EXTENSIONS)), _with(base, ["/index" + e for e in JS_EXTENSIONS]))
    dots = F.length(F.regexp_extract(source, r"^(\.*)", 1))
    up = F.when(dots > 1, F.concat(folder, F.repeat(F.lit("/.."), dots - 1))).when(dots == 1, folder).otherwise("")
    module = F.concat(up, F.lit("/"), F.replace(F.regexp_replace(source, r"^\.+|\.+$", ""), F.lit("."), F.lit("/")))
    python = F.when(~source.rlike(r"[/\\]|^\.*$"), _with(module, (".py", "/__init__.py")))
    quoted = F.regexp_replace(source, '^"+|"+$', "")
    c = F.when(F.startswith(source, F.lit('"')) & (quoted != ""), F.flatten(F.transform(paths.ancestors(folder), lambda a: F.array(F.concat(a, F.lit("/"), quoted), F.concat(a, F.lit("/include/"), quoted)))))
    at, leaf = F.regexp_replace(base, "[^/]*$", ""), F.regexp_extract(base, "([^/]*)$", 1)
    out = F.when(language.isin(*JS), js).when(language == "rust", _rust(folder, source)).when(language == "python", python).when(language.isin("c", "cpp"), c)
    for k, exts in STYLE_EXTENSIONS.items():
        tried = F.array(*[x for e in exts for x in (F.concat(base, F.lit("." + e)), F.concat(at, F.lit("_"), leaf, F.lit("." + e)), F.concat(base, F.lit("/index." + e)), F.concat(base, F.lit("/_index." + e)))])
        partial = F.array(F.concat(at, F.lit("_"), leaf)) if k == "scss" else F.array().cast("array<string>")
        out = out.when((language == k) & (clean != ""), F.concat(F.array(base), F.when(bare, tried).otherwise(partial)))
    for k, exts in DOCUMENT_EXTENSIONS.items():
        tried = F.concat(F.array(base), _with(base, ["/" + n for n in DOCUMENT_INDEXES]), F.when(bare, _with(base, ["." + e for e in exts])).otherwise(F.array().cast("array<string>")))
        out = out.when((language == k) & (clean != "") & ~is_external_link(clean), tried)
    return out


def resolved(found: DataFrame, files: DataFrame) -> DataFrame:
    """``found`` (path, dir, line, language, source) with ``target``: the file that each import is, null if none or, where one alone is asked for, several.

    A row for each candidate meets the files by equality; no import is compared with all files.
    """
    tries = found.select("dir", "language", "source").distinct().select("dir", "language", "source", F.posexplode(candidates(F.col("dir"), F.col("source"), F.col("language"))).alias("k", "path"))
    hits = tries.withColumn("path", normalized(F.col("path"))).join(files.select("path").distinct(), "path")
    best = hits.groupBy("dir", "language", "source").agg(F.min_by("path", "k").alias("first"), F.count_distinct("path").alias("n"))
    target = F.when(~F.col("language").isin(*UNIQUE) | (F.col("n") == 1), F.col("first"))
    return found.join(best.select("dir", "language", "source", target.alias("target")), ["dir", "language", "source"], "left")


def classified(found: DataFrame) -> DataFrame:
    """``resolved`` imports with ``kind``: local, standard library, external or unresolved."""
    source, language = F.col("source"), F.col("language")
    outside = F.when(language.isin("html", "markdown", "css", "scss", "less"), is_external_link(source)).otherwise(code.is_external_import(source, language))
    return found.withColumn("kind", F.when(F.col("target").isNotNull(), "local").when(code.is_stdlib(source, language), "standard library").when(outside, "external").otherwise("unresolved"))


def reverse_candidates(names: DataFrame, most: int = 25) -> DataFrame:
    """Exported names (path, name, strong) worth a search for dependents: for each file the first ``most``, strong ones, then longer ones; none that are placeholders."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("strong"), F.desc(F.octet_length("name")), "name"))
    return names.filter(~code.is_placeholder(F.col("name"))).distinct().withColumn("rank", rank).filter(F.col("rank") <= most)


def alias_match(specifiers: DataFrame, aliases: list[tuple[str, list[str]]]) -> DataFrame:
    """``specifiers`` (specifier, ...) with ``match`` (match, abstain, none) and ``targets``, by path aliases in order: an exact key, else an unsupported
    pattern that fits abstains, else of keys with a * at their end the longest, whose * takes the rest. ``aliases`` is one file's short list."""
    s = F.col("specifier")
    none = F.array().cast("array<string>")
    exact, odd, best, length = F.lit(None).cast("array<string>"), F.lit(False), none, F.lit(-1)
    for key, targets in reversed([a for a in aliases if "*" not in a[0]]):
        exact = F.when(s == key, F.array(*map(F.lit, targets))).otherwise(exact)
    for key, targets in aliases:
        stars = key.count("*")
        if stars == 1 and key.endswith("*"):
            prefix = key[:-1]
            fits = F.startswith(s, F.lit(prefix)) & (length < len(prefix))
            rest = F.substring(s, len(prefix) + 1, 1 << 30)
            best = F.when(fits, F.array(*[F.replace(F.lit(t), F.lit("*"), rest) for t in targets])).otherwise(best)
            length = F.when(fits, len(prefix)).otherwise(length)
        elif stars:
            odd = odd | s.like(key.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%"))
    kind = F.when(exact.isNotNull(), "match").when(odd, "abstain").when(length >= 0, "match").otherwise("none")
    return specifiers.withColumn("match", kind).withColumn("targets", F.when(exact.isNotNull(), exact).when(~odd & (length >= 0), best))


def related_files(found: DataFrame, most: int = 8) -> DataFrame:
    """For each folder the files that its ``resolved`` imports mean, relative ones before others, each once, the first ``most``."""
    ranked = found.filter("target is not null").withColumn("alias", ~F.startswith("source", F.lit("."))).groupBy("dir", "target").agg(F.min(F.struct("alias", "line", "source")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("dir").orderBy("first", "target"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= most).select("dir", "target", F.col("first.source").alias("source"), "rank")


def nearness(path: Column, source: Column) -> Column:
    """0 for the file itself, 1 for its folder, 2 for elsewhere."""
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    return F.when(path == source, 0).when(folder(path) == folder(source), 1).otherwise(2)


def anchors(lines: DataFrame) -> DataFrame:
    """path, kind (export or mod), name, the first line of each and how many lines name it, of bundles (path, line, text)."""
    named = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    maybe = lines.filter(F.col("text").rlike(r"\bexports?\b|define\("))
    found = maybe.select("path", "line", F.explode(F.concat(named("export", code.export_names(F.col("text"))), named("mod", code.module_names(F.col("text"))))).alias("a"))
    return found.groupBy("path", "a.kind", "a.name").agg(F.min("line").alias("line"), F.count("*").alias("n"))
