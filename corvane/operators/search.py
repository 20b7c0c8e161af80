"""Selections over lines: literal and word search, co-occurrence, match-all, suggestions, windows and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import code
from corvane.functions.text import ascii_lower, edit_distance, in_order, normalize_ident, path_contains, word_match


def literal(lines: DataFrame, term: str) -> DataFrame:
    return lines.filter(F.contains("text", F.lit(term)))


def regex(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.filter(F.col("text").rlike(pattern))


def usages(lines: DataFrame, term: str) -> DataFrame:
    return lines.filter(F.contains("text", F.lit(term)) & word_match(F.col("text"), term))


def cooccurrence(lines: DataFrame, first: str, second: str) -> DataFrame:
    return lines.filter(in_order(F.col("text"), first, second))


def term_hits(lines: DataFrame, terms: list[str]) -> DataFrame:
    """path, line, text and term: a row for each term that a line has. One scan, whatever the number of terms."""
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.col("text"), t))
    return lines.select("path", "line", "text", F.explode(found).alias("term"))


def match_all(lines: DataFrame, terms: list[str]) -> DataFrame:
    """Lines with any term in files that have every term."""
    hits = term_hits(lines, terms)
    full = hits.groupBy("path").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(set(terms))).select("path")
    return hits.join(full, "path", "left_semi").select("path", "line", "text").distinct()


def term_stats(lines: DataFrame, terms: list[str], page: int) -> DataFrame:
    """Hits and files by term, and the hits that a page leaves out."""
    return term_hits(lines, terms).groupBy("term").agg(F.count("*").alias("total"), F.count_distinct("path").alias("files")).withColumn("omitted", F.greatest(F.lit(0), F.col("total") - page).cast("long"))


def term_rollup(lines: DataFrame, terms: list[str]) -> DataFrame:
    return term_hits(lines, terms).groupBy("path").agg(F.count_distinct("term").alias("n_terms"), F.count("*").alias("n_hits"))


def top_per_term(lines: DataFrame, terms: list[str], most: int) -> DataFrame:
    """The first ``most`` hits of each term by path and line."""
    order = Window.partitionBy("term").orderBy("path", "line")
    return term_hits(lines, terms).select("term", "path", "line").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def low_signal(lines: DataFrame, terms: list[str], hits: int = 400, files: int = 150) -> DataFrame:
    """Terms too common to search for: many hits in many files and in at least 1.5 % of all; whole numbers throughout."""
    eligible = lines.agg(F.count_distinct("path").alias("eligible"))
    found = term_hits(lines, terms).groupBy("term").agg(F.count("*").alias("total"), F.count_distinct("path").alias("files"))
    return found.crossJoin(F.broadcast(eligible)).filter((F.col("total") >= hits) & (F.col("files") >= files) & (F.col("files") * 1000 >= F.col("eligible") * 15))  # eligible is one row


def suggest(lines: DataFrame, query: str) -> DataFrame:
    """Spellings within one edit of the query, or two from six characters on, with their first place."""
    bound = 2 if len(query) >= 6 else 1
    wanted = normalize_ident(F.lit(query))
    tokens = lines.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("spelling"))
    near = tokens.groupBy("spelling").agg(F.min(F.struct("path", "line")).alias("first"))
    near = near.filter(F.abs(F.length(normalize_ident(F.col("spelling"))) - F.length(wanted)) <= bound).withColumn("distance", edit_distance(normalize_ident(F.col("spelling")), wanted))
    return near.filter((F.col("distance") <= bound) & (F.col("spelling") != query)).select("spelling", "distance", "first.path", "first.line")


def line_range(value: str) -> tuple[int, int]:
    """N or A-B, with A positive and B at least A."""
    if m := re.fullmatch("([0-9]+)(?:-([0-9]+))?", value):
        first, last = int(m[1]), int(m[2] or m[1])
        if 0 < first <= last:
            return first, last
    raise ValueError(f"{value!r} is no positive line number or range of lines")


def qualifiers(text: str, fields: tuple[str, ...]) -> list[tuple[str, str]]:
    """field:value pairs between white space; fields in any case."""
    out = []
    for part in text.split():
        field, colon, value = part.partition(":")
        if not colon or not field or not value:
            raise ValueError(f"{part!r} is no field:value")
        if field.lower() not in fields:
            raise ValueError(f"unknown field {field!r}; there are {', '.join(fields)}")
        out.append((field.lower(), value))
    return out


def filtered(matches: DataFrame, text: str) -> DataFrame:
    """Matches (path, name, line, text, is_definition, exact, file_type) that meet all qualifiers: path, file, text, kind, line."""
    out = matches
    for field, value in qualifiers(text, ("path", "file", "text", "kind", "line")):
        if field == "line":
            out = out.filter(F.col("line").between(*line_range(value)))
        elif field == "kind":
            out = out.filter(code.evidence_kind(F.col("is_definition"), F.col("exact"), F.col("file_type")) == value.replace("-", " "))
        else:
            out = out.filter(path_contains(F.col("path"), value) if field == "path" else F.contains("name" if field == "file" else "text", F.lit(value)))
    return out


def paged(found: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page under a total order. Only limit + offset rows leave each task."""
    return found.orderBy(*order).offset(offset).limit(limit)


def context(lines: DataFrame, term: str, around: int) -> DataFrame:
    """Lines at most ``around`` lines away from a hit, each once."""
    frame = Window.partitionBy("path").orderBy("line").rowsBetween(-around, around)
    return lines.withColumn("hit", F.contains("text", F.lit(term))).withColumn("near", F.max("hit").over(frame)).filter("near").select("path", "line", "text", "hit")


def hit_windows(hits: DataFrame, gap: int = 21, span: int = 80) -> DataFrame:
    """Hits merged while the next is at most ``gap`` lines on and the window at most ``span`` lines long. Where a window begins decides what it takes, so this is a fold."""
    state = F.struct(F.array().cast("array<struct<first:int,last:int,n:int>>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        joins = (acc["n"] > 0) & (x - acc["last"] <= gap) & (x - acc["first"] + 1 <= span)
        closed = F.when(acc["n"] > 0, F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"), acc["n"].alias("n"))))).otherwise(acc["done"])
        return F.struct(
            F.when(joins, acc["done"]).otherwise(closed).alias("done"), F.when(joins, acc["first"]).otherwise(x).alias("first"), x.alias("last"), F.when(joins, acc["n"] + 1).otherwise(F.lit(1)).alias("n")
        )

    finish = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"), acc["n"].alias("n"))))
    grouped = hits.groupBy("path").agg(F.sort_array(F.collect_set("line")).alias("at"))
    return grouped.select("path", F.explode(F.aggregate("at", state, step, finish)).alias("w")).select("path", F.col("w.first").alias("first_line"), F.col("w.last").alias("last_line"), F.col("w.n").alias("n_hits"))


def token_budget(lines: DataFrame, budget: int) -> DataFrame:
    """The lines of each file that fit a budget of tokens, less 50, at four bytes each."""
    upto = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("path").orderBy("line"))
    return lines.withColumn("bytes", upto.cast("long")).filter(F.col("bytes") <= (budget - 50) * 4)


def nearest_names(names: DataFrame, wanted: str, most: int) -> DataFrame:
    """For each path the ``most`` names (path, line, name) nearest to the wanted one; those that begin with it have distance 0; of equally near ones the first."""
    low = ascii_lower(F.col("name"))
    distance = F.when(F.startswith(low, F.lit(wanted.lower())), 0).otherwise(edit_distance(F.lit(wanted.lower()), low))
    scored = names.withColumn("distance", distance)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy("distance", "line"))).filter(F.col("rank") <= most)


def nearest_files(files: DataFrame, wanted: str, most: int = 3) -> DataFrame:
    """name and distance of the files nearest to the wanted name, within ``most`` bytes."""
    near = files.select("name").distinct().withColumn("distance", edit_distance(F.col("name"), F.lit(wanted))).filter(F.col("distance") <= most)
    return near.join(F.broadcast(near.agg(F.min("distance").alias("least"))), F.col("distance") == F.col("least")).drop("least")  # one row


def covering_windows(lines: DataFrame, terms: list[str], gap: int = 21, span: int = 80, most: int = 3) -> DataFrame:
    """For each file up to ``most`` windows of hits (path, first, last, n_hits, terms), chosen one by one: most terms that aren't covered yet, then most terms, most hits, the
    shortest, the first; as long as terms are uncovered or a window with several terms is left. Windows merge as in ``hit_windows``."""
    hits = term_hits(lines, terms).groupBy("path", "line").agg(F.sort_array(F.collect_set("term")).alias("ts"), F.count("*").alias("n"))
    window = "struct<first:int,last:int,n:long,terms:array<string>>"
    start = F.array().cast(f"array<{window}>")

    def merge(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joins = (F.size(acc) > 0) & (x["line"] <= last["last"] + gap) & (x["line"] - last["first"] + 1 <= span)
        own = F.struct(x["line"].cast("int").alias("first"), x["line"].cast("int").alias("last"), x["n"].alias("n"), x["ts"].alias("terms"))
        grown = F.struct(last["first"].alias("first"), x["line"].cast("int").alias("last"), (last["n"] + x["n"]).alias("n"), F.sort_array(F.array_union(last["terms"], x["ts"])).alias("terms"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(own)))

    held = hits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "n", "ts"))).alias("h"))
    told = held.select("path", F.aggregate("h", start, merge).alias("left"))
    told = told.select("path", "left", F.array_distinct(F.flatten(F.transform("left", lambda w: w["terms"]))).alias("every"))
    state = F.struct(F.col("left").alias("left"), start.alias("chosen"), F.array().cast("array<string>").alias("covered"))

    def choose(acc: Column, _: Column) -> Column:
        goes = (F.size(acc["left"]) > 0) & ((F.size(acc["covered"]) < F.size("every")) | F.exists(acc["left"], lambda w: F.size(w["terms"]) > 1))
        worth = lambda w: F.struct(F.size(F.array_except(w["terms"], acc["covered"])), F.size(w["terms"]), w["n"], w["first"] - w["last"], -w["first"], w.alias("w"))
        best = F.array_max(F.transform(acc["left"], worth))
        taken = lambda b: F.struct(
            F.filter(acc["left"], lambda w: w["first"] != b["w"]["first"]).alias("left"), F.concat(acc["chosen"], F.array(b["w"])).alias("chosen"), F.array_union(acc["covered"], b["w"]["terms"]).alias("covered")
        )
        return F.when(goes, F.transform(F.array(best), taken)[0]).otherwise(acc)  # an array of one, so that the best is found once

    chosen = told.select("path", F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, choose)["chosen"]).alias("w"))
    return chosen.select("path", "w.first", "w.last", F.col("w.n").alias("n_hits"), "w.terms")
