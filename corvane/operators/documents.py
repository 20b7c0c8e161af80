"""Outlines of marked-up documents and of data files, from their lines. Code fences depend on the fence before, so their state is a fold over each file's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import ascii_lower, edit_distance

NAME_BYTES = 80


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fenced(lines: DataFrame) -> DataFrame:
    """``lines`` (path, line, text) with ``fence``: the line that opened the code block that a line is in (its own for that line), null outside; ``closes`` for the line that ends one.

    Only lines that look like fences go through the fold: a row for each file with its fence lines in order.
    """
    text = F.col("text")
    mark = F.regexp_extract("text", r"^ {0,3}(`{3,}|~{3,})", 1)
    bare = text.rlike(r"^ {0,3}(?:`{3,}|~{3,})[ \t]*$")
    marks = lines.filter(mark != "").select("path", F.struct("line", F.substring(mark, 1, 1).alias("char"), F.length(mark).alias("n"), bare.alias("bare")).alias("m")).groupBy("path").agg(F.sort_array(F.collect_list("m")).alias("marks"))
    start = F.struct(F.lit(0).alias("open"), F.lit("").alias("char"), F.lit(0).alias("n"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))

    def step(acc: Column, m: Column) -> Column:
        closes = (acc["open"] > 0) & m["bare"] & (m["char"] == acc["char"]) & (m["n"] >= acc["n"])
        opens = acc["open"] == 0
        block = F.struct(acc["open"].cast("int").alias("first"), m["line"].cast("int").alias("last"))
        return F.struct(
            F.when(closes, 0).when(opens, m["line"].cast("int")).otherwise(acc["open"]).alias("open"), F.when(opens, m["char"]).otherwise(acc["char"]).alias("char"),
            F.when(opens, m["n"]).otherwise(acc["n"]).alias("n"), F.when(closes, F.concat(acc["done"], F.array(block))).otherwise(acc["done"]).alias("done"),
        )

    to_end = lambda acc: F.when(acc["open"] > 0, F.concat(acc["done"], F.array(F.struct(acc["open"].cast("int").alias("first"), F.lit(None).cast("int").alias("last"))))).otherwise(acc["done"])
    blocks = marks.select("path", F.explode(F.aggregate("marks", start, step, to_end)).alias("b")).select("path", "b.first", "b.last")
    # Blocks of a file don't overlap: each line looks at the last that began, which a running maximum gives.
    opened = blocks.select("path", F.col("first").alias("line"), F.lit(True).alias("__open"), F.coalesce("last", F.lit(2**31 - 1)).alias("__last"))
    marked = lines.join(opened, ["path", "line"], "left")
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    state = marked.withColumn("__s", F.last(F.when(F.col("__open"), F.struct(F.col("line").alias("first"), F.col("__last").alias("last"))), ignorenulls=True).over(upto))
    inside = F.col("line") <= F.col("__s.last")
    return state.withColumn("fence", F.when(inside, F.col("__s.first"))).withColumn("closes", F.coalesce(F.col("line") == F.col("__s.last"), F.lit(False))).drop("__s", "__open", "__last")


def heading_text(raw: Column) -> Column:
    """Without closing marks; an attribute at the end stays as an anchor."""
    text = F.regexp_replace(_trim(raw), r"(?:\s*#)+$", "")
    body, attribute = F.regexp_extract(text, r"^(.*)\{#[^{]*\}$", 1), F.regexp_extract(text, r"^.*\{#([^{]*)\}$", 1)
    anchor = F.regexp_replace(F.split(_trim(attribute), r"\s+")[0], "^#+", "")
    has = text.rlike(r"\{#[^{]*\}$")
    return F.when(has & (anchor != ""), F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit(" #"), anchor)).when(has, F.regexp_replace(body, r"\s+$", "")).otherwise(text)


def headings(lines: DataFrame) -> DataFrame:
    """path, line, level and text of headings outside code blocks."""
    found = F.regexp_extract("text", r"^ {0,3}(#{1,6})(?:\s|$)", 1)
    rest = F.regexp_extract("text", r"^ {0,3}#{1,6}(?:\s(.*))?$", 1)
    marked = fenced(lines).filter("fence is null").select("path", "line", F.length(found).alias("level"), heading_text(rest).alias("text"))
    return marked.filter((F.col("level") > 0) & (F.col("text") != ""))


def sections(lines: DataFrame) -> DataFrame:
    """path, line, level, text and last line of each heading's section: up to the next heading of its level or a higher one.

    For each of the six levels the next line with a heading at most that deep is a running minimum from the end, so no heading meets others of its file.
    """
    total = lines.groupBy("path").agg(F.max("line").alias("total"))
    after = Window.partitionBy("path").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    at = headings(lines)
    for k in range(1, 7):
        at = at.withColumn(f"__next{k}", F.min(F.when(F.col("level") <= k, F.col("line"))).over(after))
    following = F.get(F.array(*[F.col(f"__next{k}") for k in range(1, 7)]), F.col("level") - 1)
    return at.select("path", "line", "level", "text", following.alias("__after")).join(total, "path").select("path", "line", "level", "text", F.greatest("line", F.coalesce(F.col("__after") - 1, F.col("total"))).cast("int").alias("last"))


def code_blocks(lines: DataFrame) -> DataFrame:
    """path, line, last line and name (the first word of what follows the opening fence, or "code") of code blocks."""
    inside = fenced(lines).filter("fence is not null")
    info = F.regexp_extract("text", r"^ {0,3}(?:`{3,}|~{3,})\s*(\S*)", 1)
    first = F.max(F.when(F.col("line") == F.col("fence"), F.when(info == "", "code").otherwise(info)))
    return inside.groupBy("path", F.col("fence").alias("line")).agg(F.max("line").alias("last"), first.alias("name"))


def links(lines: DataFrame) -> DataFrame:
    """path, line, source: targets of links, images and reference definitions outside code blocks."""
    definition = F.regexp_extract("text", r"^\s*\[[^\]]+\]:\s*<?([^\s>]+)", 1)
    inline = F.transform(F.regexp_extract_all("text", F.lit(r"\]\(([^)]*)\)"), F.lit(1)), lambda x: F.regexp_extract(x, r"^\s*<?([^\s>]*)", 1))
    every = F.filter(F.concat(F.array(definition), inline), lambda x: x != "")
    return fenced(lines).filter("fence is null").select("path", "line", F.explode(every).alias("source"))


def nearest_headings(lines: DataFrame, wanted: str, most: int) -> DataFrame:
    """For each file the ``most`` headings whose text is closest to the wanted one, by bytes; of equally close ones the first."""
    query = ascii_lower(F.lit(wanted.rstrip().lstrip("#").strip()))
    clean = _trim(F.regexp_replace(F.split(_trim(F.regexp_replace(_trim(F.col("text")), "^#+", "")), r"\{")[0], "#+$", ""))
    toggles = F.sum(F.startswith("text", F.lit("```")).cast("int")).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    found = lines.withColumn("__in", toggles % 2 == 1).filter(F.startswith("text", F.lit("#")) & ~F.startswith("text", F.lit("```")) & ~F.col("__in") & (_trim(F.regexp_replace(F.col("text"), "^#+", "")) != ""))
    scored = found.select("path", "line", F.regexp_replace("text", r"\s+$", "").alias("heading"), edit_distance(query, ascii_lower(clean)).alias("distance"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy("distance", "line"))).filter(F.col("rank") <= most)


def keys_of_yaml(lines: DataFrame, most: int = 1000) -> DataFrame:
    """path, line, depth, key and value of the keys of a YAML file to depth 2, by indentation of two; values from 41 bytes on are cut to 37."""
    t = F.regexp_replace("text", r"^\s+", "")
    key = F.regexp_extract(t, "^([^:]*):", 1)
    value = _trim(F.regexp_extract(t, "^[^:]*:(.*)$", 1))
    depth = F.floor((F.length("text") - F.length(t)) / 2).cast("int")
    found = lines.filter(~t.rlike("^(?:$|#|-)") & F.contains(t, F.lit(":")) & ~F.contains(key, F.lit(" ")) & (depth <= 2))
    shown = F.when(F.octet_length(value) > 40, F.concat(F.substring(value, 1, 37), F.lit("..."))).otherwise(value)
    first = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    return found.select("path", "line", depth.alias("depth"), key.alias("key"), shown.alias("value")).withColumn("__k", first).filter(F.col("__k") <= most).drop("__k")


def table_preview(lines: DataFrame) -> DataFrame:
    """path, line, text and part of a table's file: its columns, the first five rows, and the last three where there are over eight."""
    whole = Window.partitionBy("path")
    n = F.max("line").over(whole)
    part = F.when(F.col("line") == 1, "columns").when(F.col("line") <= 6, "head").when((F.col("n") <= 9) | (F.col("line") > F.col("n") - 3), "tail")
    return lines.withColumn("n", n).withColumn("part", part).filter("part is not null").select("path", "line", "text", "part", (F.col("n") - 1).alias("rows"))


def around_anchor(lines: DataFrame, anchor: int, cap: int) -> DataFrame:
    """Of each file's lines (path, line) ``cap``: a head of one to three and those around the anchor, if it is beyond the cap; else the first."""
    whole = Window.partitionBy("path")
    head = max(1, min(3, cap // 3))
    around = max(1, cap - head)
    index, n = F.col("line") - 1, F.col("__n")
    at = F.least(F.lit(anchor - 1), n - 1)
    begin = F.least(F.greatest(F.lit(0), at - around // 2), F.greatest(F.lit(0), n - around))
    keep = F.when((n <= cap) | (at < cap), index < cap).otherwise((index < head) | ((index >= begin) & (index < begin + around)))
    return lines.withColumn("__n", F.max("line").over(whole)).filter(keep).drop("__n")


def section_of(lines: DataFrame, heading: str) -> DataFrame:
    """path, first and last of the section of the first line that is the heading, as far as it is given, outside ``` blocks: to the next heading of its level or a higher one."""
    wanted = heading.rstrip()
    level = len(wanted) - len(wanted.lstrip("#"))
    if not level:
        return lines.select("path", F.lit(0).alias("first"), F.lit(0).alias("last")).limit(0)
    t = F.regexp_replace("text", r"\s+$", "")
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    told = lines.select("path", "line", t.alias("t"), F.max("line").over(Window.partitionBy("path")).alias("total")).withColumn("inside", F.sum(F.startswith("t", F.lit("```")).cast("int")).over(upto) % 2 == 1)
    outside = told.filter(~F.col("inside") & F.startswith("t", F.lit("#")))
    is_it = (F.col("t") == wanted) | (F.startswith("t", F.lit(wanted)) & F.substring("t", len(wanted) + 1, 1).isin(" ", "\t", "{", "#"))
    first = F.min(F.when(is_it, F.col("line"))).over(Window.partitionBy("path"))
    deep = F.length(F.regexp_extract("t", "^(#*)", 1))
    found = outside.withColumn("first", first).filter(F.col("first").isNotNull())
    return found.groupBy("path", "first").agg(F.min(F.when((F.col("line") > F.col("first")) & (deep <= level), F.col("line") - 1)).alias("next"), F.max("total").alias("total")).select("path", "first", F.coalesce("next", "total").cast("int").alias("last"))


def data_keys(files: DataFrame, most: int = 1000) -> DataFrame:
    """path, ord, depth, key and value of TOML files (path, content) to depth 2, by the standard library's parser; a file that doesn't parse gives its error as value."""
    import tomllib

    def walk(table: dict, depth: int, out: list) -> None:
        for key, value in table.items():
            if isinstance(value, dict):
                out.append((depth, key, f"{{{len(value)} keys}}" if depth >= 2 else None))
                if depth < 2:
                    walk(value, depth + 1, out)
            else:
                shown = f"[{len(value)} items]" if isinstance(value, list) else f'"{value}"' if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)
                raw = shown.encode()
                out.append((depth, key, shown if len(raw) <= 40 or isinstance(value, list) else raw[:37].decode(errors="ignore") + "..."))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found: list = []
                try:
                    walk(tomllib.loads(content or ""), 0, found)
                except tomllib.TOMLDecodeError as error:
                    found = [(0, None, f"parse error: {error}")]
                rows += [{"path": path, "ord": k, "depth": d, "key": key, "value": v} for k, (d, key, v) in enumerate(found[:most], 1)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("ord", pa.int32()), ("depth", pa.int32()), ("key", pa.string()), ("value", pa.string())]))

    return files.select("path", "content").mapInArrow(run, "path string, ord int, depth int, key string, value string")
