"""Patches in the format of ``git diff`` as relations: the files that they change, and their hunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ \s*-(\d{1,9})(?:,(\d{1,9}))?\s+\+(\d{1,9})(?:,(\d{1,9}))?(?:\s.*)? @@"


def _after(c: Column, start: str) -> Column:
    return F.when(F.startswith(c, F.lit(start)), F.substring(c, len(start) + 1, 1 << 30))


def _clean(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"^\s+|\s+$", ""), "\\", "/")


def _named(c: Column) -> Column:
    """The path that a line of a file's head names; null for none and for no file at all."""
    path = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(path.rlike("^[ab]/"), _clean(F.substring(path, 3, 1 << 30))).when(path.rlike('^".*"$'), _clean(F.regexp_extract(path, '^"(.*)"$', 1)))


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` (patch, line, text) with ``file``: how many heads of files came so far. What is before the first goes."""
    upto = Window.partitionBy("patch").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("file", F.sum(F.startswith("text", F.lit("diff --git ")).cast("int")).over(upto)).filter("file > 0")


def files(lines: DataFrame) -> DataFrame:
    """patch, file, path, old_path and status (modified, added, deleted, renamed) of each changed file; later lines of its head win."""
    text = F.col("text")
    head = F.regexp_replace(_after(text, "diff --git "), r"^\s+|\s+$", "")
    plain, quoted = head.rlike("^a/.* b/"), head.rlike('^"a/.*" "b/')
    old = F.when(plain, _clean(F.regexp_extract(head, "^a/(.*) b/", 1))).when(quoted, _clean(F.regexp_extract(head, '^"a/(.*)" "b/', 1))).otherwise(_named(F.split(head, r"\s+")[0]))
    new = F.when(plain, _clean(F.regexp_extract(head, "^a/.* b/(.*)$", 1))).when(quoted, _clean(F.regexp_replace(F.regexp_extract(head, '^"a/.*" "b/(.*)$', 1), '"+$', "")))
    new = F.coalesce(new, _named(F.get(F.split(head, r"\s+"), 1)), old, F.when(head.isNotNull(), "?"))
    status = (
        F.when(F.startswith(text, F.lit("new file mode ")), "added").when(F.startswith(text, F.lit("deleted file mode ")), "deleted")
        .when(text.rlike("^rename (from|to) "), "renamed").when(head.isNotNull(), "modified")
    )
    told = numbered(lines).select("patch", "file", "line", F.coalesce(new, _clean(_after(text, "rename to ")), _named(_after(text, "+++ "))).alias("path"), F.coalesce(old, _clean(_after(text, "rename from "))).alias("old_path"), status.alias("status"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c)
    return told.groupBy("patch", "file").agg(last("path"), last("old_path"), last("status"))


def hunks(lines: DataFrame) -> DataFrame:
    """patch, file, line, and where each hunk begins and how many lines it has, before and after; a count left out is 1."""
    part = lambda k: F.regexp_extract("text", HUNK, k)
    count = lambda k: F.when(part(k) == "", 1).otherwise(part(k).try_cast("long"))
    found = numbered(lines).filter(F.col("text").rlike(HUNK))
    return found.select("patch", "file", "line", part(1).try_cast("long").alias("old_start"), count(2).cast("long").alias("old_lines"), part(3).try_cast("long").alias("new_start"), count(4).cast("long").alias("new_lines"))


def untracked(files_: DataFrame) -> DataFrame:
    """Files (path, n_lines) that no version has yet: added, with one hunk of all their lines."""
    return files_.select(F.translate("path", "\\", "/").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit("added").alias("status"), F.lit(0).cast("long").alias("old_start"), F.lit(0).cast("long").alias("old_lines"), F.lit(1).cast("long").alias("new_start"), F.col("n_lines").cast("long").alias("new_lines"))
