"""Relations of a corpus (files, lines, call sites, spans) from tables and from folders of source files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that a walk never enters, and those of them that it does for built artifacts.
SKIP_DIRS = (
    ".git", "node_modules", "target", "dist", "build", "__pycache__", ".pycache", "vendor", ".next", ".nuxt", "coverage", ".cache", ".tox", ".venv", ".eggs", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".turbo", ".parcel-cache",
    ".svelte-kit", "out", ".output", ".vercel", ".netlify", ".gradle", ".idea", ".scala-build", "target", ".bloop", ".metals",
)
ARTIFACT_DIRS = ("dist", "build", "out", ".next", ".nuxt", ".output")
SIZE_CAP = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_parts(files: DataFrame) -> DataFrame:
    """dir, name, ext, depth and byte_len from path and content."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.select(
        "path", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), name.alias("name"), F.regexp_extract(name, r"\.([^.]+)$", 1).alias("ext"),
        (F.size(parts) - 1).alias("depth"), F.octet_length("content").cast("long").alias("byte_len"), "content",
    )


def document_files(documents: DataFrame) -> DataFrame:
    """A file source/lang/doc_N.txt for each document."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return with_parts(documents.select(path.alias("path"), F.col("text").alias("content")))


def in_skipped(path: Column, artifacts: bool = False) -> Column:
    """A path with a folder that a walk doesn't enter."""
    skipped = [d for d in SKIP_DIRS if not (artifacts and d in ARTIFACT_DIRS)]
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, skipped)))


def walk(spark: SparkSession, root: str, glob: str = "*", artifacts: bool = False) -> DataFrame:
    """Files below a folder, without skipped folders, empty, over-large and binary files. Path and length prune before content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    below = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(re.sub("^(?:file:)?/*", "", root).rstrip("/")) + "/?", "")
    kept = found.filter((F.col("length") > 0) & (F.col("length") <= SIZE_CAP) & ~in_skipped(below, artifacts))
    text = kept.filter(~is_binary(F.col("content")))
    return with_parts(text.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("content").cast("string").alias("content")))


def is_binary(content: Column) -> Column:
    """A NUL among the first 512 bytes."""
    return F.hex(F.substring(content, 1, 512)).rlike("^(?:..)*?00")


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1) and text; the end of the last line makes no line of its own."""
    whole = F.regexp_replace("content", r"\r?\n\z", "")
    return files.select("path", F.posexplode(F.split(whole, r"\r?\n"))).select("path", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order tables as calls: a customer's nation calls a supplier's; path, receiver and args come from the order."""
    orders, customer, lineitem, supplier = (table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "supplier"))
    joined = (
        lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
    )
    return joined.select(
        F.col("o_orderpriority").alias("path"), F.col("l_orderkey").alias("line"), F.col("c_nationkey").alias("caller"), F.col("s_nationkey").alias("callee"),
        F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("receiver"), F.col("l_linenumber").alias("args"),
    )


def call_graph(calls: DataFrame) -> DataFrame:
    """Edges (src, dst, n)."""
    return calls.groupBy(F.col("caller").alias("src"), F.col("callee").alias("dst")).agg(F.count("*").alias("n"))
