"""A source tree made from the documents table, for queries on code: a file for each document, its lines drawn from a list by its number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources import adapters

DIRS = ("src", "src/api", "src/api/v2", "tests/unit", "docs/guide", "vendor/lib", "pkg/mock_data", "examples", "src/generated", "lib/__tests__", "handle")
NAMES = (
    "search.rs", "handle_auth.py", "auth.test.ts", "widget.spec.js", "README.md", "guide.rst", "main.go", "zz_generated.deepcopy.go", "bundle.min.js", "app-MIN.js", "package-lock.json", "Makefile", "Dockerfile",
    ".env.local", "data.csv", "config.yaml", "settings.toml", "index.tsx", "handle.java", "style.scss", "server.log", "notes.txt", "model_test.go", "user_spec.rb", "logo.png",
)
MANIFEST = "Cargo.toml"
NOW = 1_700_000_000
SNIPPETS = (
    "pub fn handle_auth(user: &User) -> Result<Token> {", "fn handle(req: Request) {", "class Handle:", "    def handle(self, request):", "export default function handle(event) {", "export class HandleError extends Error {",
    "struct Handle {", "pub struct HandleMap<T> {", "impl Handle {", "func (h *Handle) handle(w http.ResponseWriter) {", "interface Handle {", "type handle = string;",
    "    // handle the request here", "    /// Handles a request.", "    let token = handle(user); // handle it", "    let url = \"http://handle.example/x\";", "# handle comment", "<!-- handle -->",
    "    if user.is_none() {", "    } else {", "    return handle(user)", "    return", "    for item in items {", "    match token {",
    "    let x = 1;", "    const limit = 10", "    x += 2;", "    value", "}", "",
    "", "    println!(\"handle {}\", x);", "    print(\"debug\", x)", "    console.log(handle)", "    log::debug!(\"handle\");", "    logger.debug(\"x\")",
    "    // TODO: handle errors", "    # NOTE keep this", "    token.unwrap();", "    fetch(url)?;", "    panic!(\"no handle\");", "    except ValueError:",
    "import os, sys", "from .handle import Handle", "use crate::handle::Handle;", "#include \"handle.h\"", "import { handle } from './handle'", "require 'handle'",
    "# Title of a guide", "## Usage of `handle` ##", "### Deep {#deep-part}", "```rust", "```", "~~~~",
    "See [guide](guide.md) and [home](https://example.org/a).", "[ref]: ../docs/intro.md \"Intro\"", "key: value", "  nested: 12", "    deeper:", "- item: no",
    "#[test]", "it('handles', () => {", "describe(\"handle\", () => {", "@Test", "    mock_fixture_stub_fake_example(handle)", "    HANDLE = handle_all",
    "// Code generated by tool; DO NOT EDIT.", "    /* handle block */", "    * handle starred", "mod handle;", "pub(crate) fn handle_inner() {", "async fn handle_async() {",
)


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: The same tree in SQL: code_files (doc_id, path, dir, name, ext, mtime, l, content, byte_len) and code_lines (doc_id, path, line, text).
CODE = f"""code_named as (
    select doc_id, 'g' || (doc_id // 275) || '/' || ({_list(DIRS)})[(doc_id % 275) // 25 + 1] as dir,
        case when doc_id % 25 = 16 and doc_id // 25 % 3 = 0 then '{MANIFEST}' else ({_list(NAMES)})[doc_id % 25 + 1] end as name, {NOW} - doc_id * 7919 % 5000000 as mtime, 5 + doc_id % 97 as n from documents
), code_files as (
    select doc_id, dir || '/' || name as path, dir, name, regexp_extract(name, '^.+\\.([^.]*)$', 1) as ext, mtime, [({_list(SNIPPETS)})[(doc_id * 31 + i * i * 7 + i * 3) % {len(SNIPPETS)} + 1] for i in range(1, n + 1)] as l,
        array_to_string([({_list(SNIPPETS)})[(doc_id * 31 + i * i * 7 + i * 3) % {len(SNIPPETS)} + 1] for i in range(1, n + 1)], chr(10)) as content, strlen(array_to_string([({_list(SNIPPETS)})[(doc_id * 31 + i * i * 7 + i * 3) % {len(SNIPPETS)} + 1] for i in range(1, n + 1)], chr(10))) as byte_len from code_named
), code_lines as (select doc_id, path, dir, name, ext, unnest(range(1, len(l) + 1))::int as line, unnest(l) as text from code_files)"""


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _line(doc_id: Column, line: Column) -> Column:
    return pick(SNIPPETS, (doc_id * 31 + line * line * 7 + line * 3) % len(SNIPPETS))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.when((d % 25 == 16) & (F.floor(d / 25) % 3 == 0), MANIFEST).otherwise(pick(NAMES, d % 25))
    folder = F.concat(F.lit("g"), F.floor(d / 275).cast("string"), F.lit("/"), pick(DIRS, F.floor((d % 275) / 25)))
    named = adapters.table(spark, sf, "documents").select(d.cast("long").alias("doc_id")).select(d, folder.alias("dir"), name.alias("name"), (F.lit(NOW) - d * 7919 % 5_000_000).alias("mtime"), (5 + d % 97).alias("n"))
    return named.select("doc_id", F.concat_ws("/", "dir", "name").alias("path"), "dir", "name", F.regexp_extract("name", r"^.+\.([^.]*)$", 1).alias("ext"), "mtime", "n")


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, path, dir, name, ext, mtime (seconds), content and byte_len."""
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: _line(F.col("doc_id"), i)), "\n")
    files = _named(spark, sf).withColumn("content", content)
    return files.withColumn("byte_len", F.octet_length("content").cast("long")).drop("n")


def code_lines(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, path, dir, name, ext, line and text."""
    numbered = _named(spark, sf).select("doc_id", "path", "dir", "name", "ext", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line"))
    return numbered.select("doc_id", "path", "dir", "name", "ext", F.col("line").cast("int").alias("line"), _line(F.col("doc_id"), F.col("line")).alias("text"))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
