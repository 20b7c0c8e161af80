"""Interval operators. All have an equality on the file, so intervals are compared only within one.

Points meet the spans around them by bins instead of by a range join: a span lies in at most two bins of the least of WIDTHS that is as long as it
(one beyond the last in as many as it is long), and a point asks one bin of each width. So a point meets few spans but those around it, however
many a file has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Powers of two.
WIDTHS = (0, 2, 4, 6, 8, 10, 12)


def _width(first: str, last: str) -> Column:
    length = F.col(last) - F.col(first) + 1
    out = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        out = F.when(length <= 1 << w, w).otherwise(out)
    return out


def containing(points: DataFrame, spans: DataFrame, on: list[str], at: str = "at", first: str = "first", last: str = "last") -> DataFrame:
    """Each point with each span (first to last, both included) around it; ``on`` has the columns that both share. Spans that end before they begin hold nothing."""
    bin_of = lambda c: F.call_function("shiftright", F.col(c).cast("long"), F.col("__width"))
    binned = spans.filter(F.col(last) >= F.col(first)).withColumn("__width", _width(first, last)).withColumn("__bin", F.explode(F.sequence(bin_of(first), bin_of(last))))
    asked = points.withColumn("__width", F.explode(F.array(*map(F.lit, WIDTHS)))).withColumn("__bin", bin_of(at))
    met = asked.join(binned, [*on, "__width", "__bin"])
    return met.filter((F.col(first) <= F.col(at)) & (F.col(at) <= F.col(last))).drop("__width", "__bin")


def narrowest_owner(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Each point (path, at) with the one smallest span (path, id, first, last) around it; none if several are equally small.

    Where spans have a column ``named``, one that isn't is a barrier: a point whose smallest span it is has no owner.
    """
    size = F.col("last") - F.col("first")
    smallest = [F.min(F.struct(size.alias("size"), "id")).alias("a"), F.max(F.struct((-size).alias("size"), "id")).alias("b")]
    barrier = "named" in spans.columns
    if barrier:
        smallest.append(F.min_by("named", size).alias("named"))
    best = containing(points, spans, ["path"]).groupBy("path", "at").agg(*smallest).filter("a.id = b.id")
    return (best.filter("named") if barrier else best).select("path", "at", F.col("a.id").alias("owner"))


def enclosing(ranges: DataFrame, spans: DataFrame, latest: bool = True) -> DataFrame:
    """Each range (path, begin, end) with the smallest span (path, ord, first, last, ...) that holds all of it: of equally small ones the last by ``ord``, or the first."""
    order = F.struct(F.col("last") - F.col("first"), -F.col("ord") if latest else F.col("ord"))
    held = [c for c in spans.columns if c != "path"]
    found = containing(ranges, spans, ["path"], at="begin").filter(F.col("end") <= F.col("last"))
    return found.groupBy("path", "begin", "end").agg(F.min_by(F.struct(*held), order).alias("s")).select("path", "begin", "end", "s.*")


def cut_spans(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """For each range (path, begin, end) the smallest span that its begin cuts and the smallest that its end cuts, with the lines that the range lacks."""
    keys, size = ["path", "begin", "end"], F.col("last") - F.col("first")
    best = lambda found: found.groupBy(*keys).agg(F.min(F.struct(size.alias("size"), "first", "last")).alias("s"))
    before = best(containing(ranges, spans, ["path"], at="begin").filter("first < begin")).select(*keys, "s.first", "s.last", F.col("s.first").alias("missing_first"), (F.col("begin") - 1).alias("missing_last"))
    after = best(containing(ranges, spans, ["path"], at="end").filter("last > end")).select(*keys, "s.first", "s.last", (F.col("end") + 1).alias("missing_first"), F.col("s.last").alias("missing_last"))
    return before.unionByName(after).distinct()


def overlapping(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """Each range (path, begin, end) with each span that shares a position with it: one that holds its begin, or begins within it."""
    holds = containing(ranges, spans, ["path"], at="begin")
    starts = containing(spans.withColumnRenamed("first", "__at"), ranges, ["path"], at="__at", first="begin", last="end").withColumnRenamed("__at", "first").filter("first > begin and last >= first")
    return holds.unionByName(starts.select(*holds.columns))


def smallest(found: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the least last - first for their keys, all of equal ones."""
    return found.withColumn("__k", F.rank().over(Window.partitionBy(*keys).orderBy(F.col("last") - F.col("first")))).filter("__k = 1").drop("__k")


def merge_ranges(ranges: DataFrame, gap: int = 1) -> DataFrame:
    """Ranges (path, first, last) that overlap or are at most ``gap`` apart, as one."""
    order = Window.partitionBy("path").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(before.isNull() | (F.col("first") > before + gap), 1).otherwise(0))
    return marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("path", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n")).drop("island")


def covered(ranges: DataFrame, shown: DataFrame) -> DataFrame:
    """Ranges (path, first, last) all of whose lines are among ``shown`` (path, line)."""
    distinct = shown.select("path", "line").distinct()
    lines = containing(distinct, ranges.select("path", "first", "last").distinct(), ["path"], at="line")
    full = lines.groupBy("path", "first", "last").agg(F.count("*").alias("n")).filter("n = last - first + 1").drop("n")
    return ranges.join(full, ["path", "first", "last"], "left_semi")


def innermost_binding(points: DataFrame, bindings: DataFrame) -> DataFrame:
    """Each point (path, name, at) with the last binding (path, name, begin, scope_end) that begins before it and whose scope it is in."""
    seen = containing(points, bindings, ["path", "name"], first="begin", last="scope_end")
    return seen.groupBy("path", "name", "at").agg(F.max("begin").alias("begin"))


def owner_runs(hits: DataFrame, least: int = 3) -> DataFrame:
    """Neighbouring hits (path, line, owner) of one owner, in the order of lines, as runs; ``folded`` are those of ``least`` hits or more."""
    order = Window.partitionBy("path").orderBy("line")
    new = F.when(F.lag("owner").over(order).eqNullSafe(F.col("owner")) & (F.row_number().over(order) > 1), 0).otherwise(1)
    runs = hits.withColumn("__new", new).withColumn("run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("path", "owner", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n")).withColumn("folded", (F.col("n") >= least) & F.col("owner").isNotNull())
