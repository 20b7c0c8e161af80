"""What the names of files and folders say. Paths have slashes and no leading one; ``name`` is a path's last part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by language, in the order of their file types.
LANGUAGES = {
    "typescript": ("ts", "mts", "cts"), "tsx": ("tsx",), "javascript": ("js", "jsx", "mjs", "cjs"), "python": ("py", "pyi"), "rust": ("rs",), "go": ("go",), "java": ("java",), "scala": ("scala", "sc"),
    "c": ("c", "h"), "cpp": ("cpp", "hpp", "cc", "cxx"), "ruby": ("rb",), "php": ("php", "phtml"), "swift": ("swift",), "kotlin": ("kt", "kts"), "csharp": ("cs",), "elixir": ("ex", "exs"), "css": ("css",), "scss": ("scss",), "less": ("less",),
}
DOCUMENT_LANGUAGES = {"html": ("html", "htm"), "markdown": ("md", "mdx", "rst")}
STRUCTURED = ("json", "yaml", "yml", "toml", "xml", "ini")
TABULAR = ("csv", "tsv")
NAMED = {"dockerfile": ("Dockerfile", "Containerfile"), "make": ("Makefile", "GNUmakefile"), "ruby": ("Vagrantfile", "Rakefile")}
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "composer.lock", "Gemfile.lock", "poetry.lock", "go.sum", "bun.lockb")
GENERATED_MARKERS = (
    "@generated", "DO NOT EDIT", "Do not edit", "do not edit", "auto-generated", "Auto-generated", "AUTO-GENERATED", "this file is generated", "This file is generated", "THIS FILE IS GENERATED",
    "automatically generated", "Automatically generated",
)
MANIFESTS = ("Cargo.toml", "package.json", "pyproject.toml", "setup.py", "go.mod", "pom.xml", "build.gradle", "build.sbt", "mix.exs")
TEXTUAL = (
    "rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "py", "go", "java", "kt", "kts", "scala", "rb", "ex", "exs", "erl", "hs", "c", "h", "cc", "cpp", "hpp", "swift", "m", "mm", "cs", "php", "lua", "sh", "bash", "zsh", "fish",
    "md", "rst", "txt", "toml", "yaml", "yml", "ini", "cfg", "sql", "graphql", "gql", "proto",
)
MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "ico": "image/x-icon", "pdf": "application/pdf", "zip": "application/zip",
    "gz": "application/gzip", "tgz": "application/gzip", "tar": "application/x-tar", "wasm": "application/wasm", "woff": "font/woff2", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/ttf", "mp3": "audio/mpeg", "mp4": "video/mp4",
}


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def parts(path: Column) -> Column:
    return F.split(path, "/")


def extension(name: Column) -> Column:
    """What follows the last dot; empty without one, or where the only dot is the first character."""
    return F.regexp_extract(name, r"^.+\.([^.]*)$", 1)


def stem(name: Column) -> Column:
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def has_part(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, names)))


def _lookup(value: Column, table: dict[str, str]) -> Column:
    """A look-up in a literal map: one expression, however long the table."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def _of(value: Column, table: dict[str, tuple[str, ...]]) -> Column:
    return _lookup(value, {v: k for k, values in table.items() for v in values})


def language(name: Column) -> Column:
    ext = extension(name)
    return F.coalesce(_of(ext, LANGUAGES | DOCUMENT_LANGUAGES), F.when(ext == "", _of(name, NAMED)))


def file_type(name: Column) -> Column:
    """code, document, structured, tabular, log or other: by extension, and by name where there is none."""
    ext = extension(name)
    by_name = F.when(_of(name, NAMED).isNotNull(), "code").when(F.startswith(name, F.lit(".env")), "structured").otherwise("other")
    return (
        F.when(_of(ext, LANGUAGES).isNotNull(), "code").when(_of(ext, DOCUMENT_LANGUAGES).isNotNull(), "document").when(ext.isin(*STRUCTURED), "structured")
        .when(ext.isin(*TABULAR), "tabular").when(ext == "log", "log").when(ext == "", by_name).otherwise("other")
    )


def is_generated_by_name(name: Column) -> Column:
    return name.isin(*LOCK_FILES)


def is_generated_by_content(content: Column) -> Column:
    """A marker in the first 512 bytes."""
    head = F.substring(content.cast("binary"), 1, 512)
    return _any(F.contains(head, F.lit(m.encode())) for m in GENERATED_MARKERS)


def is_generated(name: Column, content: Column) -> Column:
    return is_generated_by_name(name) | F.startswith(name, F.lit("zz_generated")) | F.contains(name, F.lit(".generated.")) | is_generated_by_content(content)


def is_minified_name(name: Column) -> Column:
    return name.rlike(r"(?i)^(.+\.min|.*-min)\.[^.]*$")


def looks_minified(content: Column, least: int = 100_000) -> Column:
    """Fewer than four line ends in the first 2048 bytes; smaller contents than ``least`` bytes never are."""
    head = F.substring(content.cast("binary"), 1, 2048).cast("string")
    return (F.octet_length(content) >= least) & (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) < 4)


def is_textual(name: Column) -> Column:
    return extension(name).isin(*TEXTUAL)


def mime(name: Column) -> Column:
    return F.coalesce(_lookup(extension(name), MIME), F.lit("application/octet-stream"))


# Five predicates for tests, each of its own command; they differ.


def is_test_file(path: Column) -> Column:
    return path.rlike(r"\.test\.|\.spec\.|__tests__/")


def is_test_place(path: Column) -> Column:
    """By path alone, as matches are faceted."""
    return path.rlike(r"_test\.|_spec\.") | has_part(path, ("test", "tests", "spec"))


def is_test_match(path: Column, name: Column, text: Column) -> Column:
    marked = text.rlike(r"#\[test\]|#\[cfg\(test\)\]|@Test|def test_|it\([\"']|describe\([\"']|func Test")
    return is_test_place(path) | (~file_type(name).isin("other", "log") & marked)


def is_test_path_of_terms(path: Column) -> Column:
    part = r"test|tests|spec|specs|__tests__|test_[^/]*|[^/]*_test|[^/]*_spec|[^/]*(?:_test|\.test|_spec|\.spec)\.[^/]*"
    return F.lower(path).rlike(f"(?:^|/)(?:{part})(?:/|$)")


def is_test_path_of_maps(path: Column) -> Column:
    return path.rlike(r"(?:^|/)(?:(?:test|tests|testing)(?:/|$)|[^/]*(?:_test|\.test|\.spec)\.)")


def ancestors(folder: Column) -> Column:
    """A folder and all above it, the root ("") included."""
    at = parts(folder)
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(at)), lambda k: F.array_join(F.slice(at, F.lit(1), k), "/")))


def relation_key(path: Column, depth: int = 2) -> Column:
    """The first folders of a path, or (root)."""
    at = parts(path)
    folders = F.slice(at, F.lit(1), F.least(F.size(at) - 1, F.lit(depth)))
    return F.when(F.size(at) == 1, "(root)").otherwise(F.array_join(folders, "/"))


def shared_depth(a: Column, b: Column) -> Column:
    """How many leading folders two paths share."""
    same = F.zip_with(parts(a), parts(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when((a == "") | (b == ""), 0).when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def common_folder(folders: Column) -> Column:
    """The longest folder that all of an array's folders are in; "." if there is none."""
    split = F.transform(folders, parts)
    shared = F.aggregate(F.slice(split, F.lit(2), F.greatest(F.lit(0), F.size(split) - 1)), F.get(split, 0), lambda a, b: F.slice(a, F.lit(1), F.greatest(F.lit(0), _same(a, b))))
    return F.when((F.size(folders) == 0) | (F.size(shared) == 0), ".").otherwise(F.array_join(shared, "/"))


def _same(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, (first - 1).cast("int")).otherwise(F.size(same))


def is_under(path: Column, folder: Column) -> Column:
    """A path is the folder or in it."""
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/"))) | (folder == "")


# Folders that hold no production code.
NON_PRODUCTION = ("tests", "test", "spec", "specs", "__tests__", "vendor", "node_modules", "override", "overrides", "fixtures", "examples", "docs", "build", "dist", "target")


def is_production(path: Column) -> Column:
    return ~has_part(path, NON_PRODUCTION)


def byte_range(section: Column) -> Column:
    """The numbers of bytes:A-B; null for anything else."""
    good = section.rlike(r"^bytes:\+?[0-9]{1,18}-\+?[0-9]{1,18}$")
    part = lambda p: F.regexp_extract(section, p, 1).try_cast("long")
    return F.when(good, F.struct(part(r"^bytes:\+?([0-9]+)").alias("first"), part(r"-\+?([0-9]+)$").alias("last")))
