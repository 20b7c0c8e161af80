"""Operators on files: package roots, entries of a folder, matches by facet, and noise within files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import code, paths


def nearest_above(files: DataFrame, holders: DataFrame) -> DataFrame:
    """``files`` (path, dir) with ``root``: the nearest folder at or above theirs that ``holders`` (dir) has; null if there is none.

    Folders, not files, meet the holders: a row for each folder and each one above it.
    """
    above = files.select("dir").distinct().select("dir", F.explode(paths.ancestors(F.col("dir"))).alias("above"))
    found = above.join(holders.select(F.col("dir").alias("above")).distinct(), "above").groupBy("dir").agg(F.max_by("above", F.length("above")).alias("root"))
    return files.join(found, "dir", "left")


def manifest_folders(files: DataFrame) -> DataFrame:
    return files.filter(F.col("name").isin(*paths.MANIFESTS)).select("dir").distinct()


def entries(files: DataFrame, folder: str) -> DataFrame:
    """name, is_folder, bytes and tokens of what is directly in a folder; folders come with what is in them."""
    inside = folder.rstrip("/") + "/" if folder else ""
    below = files.filter(F.startswith("path", F.lit(inside))).select(F.substring("path", len(inside) + 1, 1 << 30).alias("rest"), "byte_len")
    first = F.split("rest", "/")
    return below.groupBy(first[0].alias("name"), (F.size(first) > 1).alias("is_folder")).agg(F.sum("byte_len").alias("bytes"), F.sum(F.ceil(F.col("byte_len") / 4)).cast("long").alias("tokens"))


def facet(m: dict[str, Column], same_package: Column) -> Column:
    """implementations, bases, definitions, comments, tests, local or cross usages: the first that a match is."""
    return (
        F.when(m["is_definition"] & m["impl_target"].isNotNull(), "implementations").when(m["is_definition"] & m["base_target"].isNotNull(), "bases").when(m["is_definition"], "definitions")
        .when(m["in_comment"], "comments").when(paths.is_test_match(m["path"], m["name"], m["text"]), "tests").when(F.coalesce(same_package, F.lit(False)), "usages_local").otherwise("usages_cross")
    )


def match_label(m: dict[str, Column]) -> Column:
    plain = F.initcap(code.evidence_kind(F.lit(False), m["exact"], paths.file_type(m["name"])))
    return F.when(m["in_comment"], "comment occurrence").when(~m["is_definition"], F.lower(plain)).when(m["impl_target"].isNotNull(), "impl").when(m["base_target"].isNotNull(), "base").otherwise("definition")


def grouped(matches: DataFrame, key: str = "label") -> DataFrame:
    """Matches of a file by label: where the first is and how many there are."""
    return matches.groupBy("path", key).agg(F.min("line").alias("first_line"), F.count("*").alias("n"))


def most_frequent(rows: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """For each ``by`` the value that most rows have; of equally frequent ones that which comes first in ``order``."""
    counted = rows.groupBy(by, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first"))
    return counted.withColumn("k", rank).filter("k = 1").select(by, value, "n")


def noise(lines: DataFrame) -> DataFrame:
    """``lines`` (path, name, line, text) with ``why``: blank, debug, comment, or null for a line that stays. A blank line goes after another one."""
    told = lines.withColumn("__t", code.trimmed(F.col("text"))).withColumn("__family", code.strip_family(paths.language(F.col("name"))))
    marked = told.withColumn("__before", F.lag("__t").over(Window.partitionBy("path").orderBy("line")))
    t, family = F.col("__t"), F.col("__family")
    why = F.when(t == "", F.when(F.col("__before") == "", "blank")).when(code.is_debug_log(t, family), "debug").when(code.is_strippable_comment(t, family), "comment")
    return marked.withColumn("why", F.when(family.isNotNull(), why)).drop("__t", "__before", "__family")


def diverse(lines: DataFrame, span: int = 80, most: int = 40) -> DataFrame:
    """Lines (path, line, text) of whole files with their score; of those that reach ``span`` lines beyond their first, the ``most`` that tell most."""
    whole = Window.partitionBy("path")
    bounds = lines.withColumn("__first", F.min("line").over(whole)).withColumn("__last", F.max("line").over(whole))
    scored = bounds.withColumn("score", code.line_score(code.trimmed(F.col("text")), F.col("line"), F.col("__first"), F.col("__last")))
    ranked = scored.withColumn("__k", F.row_number().over(whole.orderBy(F.desc("score"), "line")))
    return ranked.filter((F.col("__last") - F.col("__first") < span) | (F.col("__k") <= most)).select("path", "line", "score")


def previews(lines: DataFrame) -> DataFrame:
    """For each textual file its first line that tells something, of 40: a comment that documents before any other, 80 characters without marks."""
    t = code.trimmed(F.col("text"))
    documents = code.begins(t, ("///", "//!", "/**", "/*!", '"""', "'''", "@doc", "# ", "## "))
    marks = r"""^(?:///)*(?://!)*(?://)*(?:/\*\*)*(?:/\*!)*(?:/\*)*(?:\*/)*\**(?:\"\"\")*(?:''')*#*"""
    plain = code.trimmed(F.regexp_replace(t, marks, ""))
    kept = lines.filter((F.col("line") <= 40) & paths.is_textual(F.col("name")) & (t != "") & ~F.startswith(t, F.lit("#!")) & plain.rlike(r"\p{L}"))
    return kept.select("path", F.struct((~documents).alias("other"), "line", F.substring(plain, 1, 80).alias("text")).alias("x")).groupBy("path").agg(F.min("x").alias("x")).select("path", "x.line", F.col("x.text").alias("preview"))
