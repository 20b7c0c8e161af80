"""What is shown when not all can be: shares of a budget, first items of groups, and folds that skip what doesn't fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(wants: list[int], available: int) -> list[int]:
    """What each of several wants gets of a budget: small wants in full, the rest the same, and what can't be split to the first of them."""
    out, left, open_ = [0] * len(wants), available, list(range(len(wants)))
    while open_ and left:
        share = max(1, left // len(open_))
        settled = [i for i in open_ if wants[i] <= share]
        for i in settled:
            out[i] = wants[i]
            left = max(0, left - wants[i])
        open_ = [i for i in open_ if i not in settled]
        if not settled:
            base, extra = divmod(left, len(open_))
            for k, i in enumerate(open_):
                out[i] = base + (k < extra)
            break
    return out


def fitted(items: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """For each key how much of a budget its items take in turn, and how many of them; one that doesn't fit is skipped, and later, smaller ones may still."""
    held = items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(size).cast("long").alias("__size")))).alias("items"))
    fits = lambda acc, x: acc["used"] + x["__size"] <= budget
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("taken"))
    step = lambda acc, x: F.struct((acc["used"] + F.when(fits(acc, x), x["__size"]).otherwise(0)).alias("used"), (acc["taken"] + F.when(fits(acc, x), 1).otherwise(0)).alias("taken"))
    return held.select(key, F.aggregate("items", start, step).alias("r")).select(key, "r.used", "r.taken")


def first_of(rows: DataFrame, by: str, order: list[Column], most: int = 3) -> DataFrame:
    """The first ``most`` rows of each group, with ``more``: how many it has beyond them."""
    group = Window.partitionBy(by)
    ranked = rows.withColumn("__k", F.row_number().over(group.orderBy(*order))).withColumn("more", F.greatest(F.lit(0), F.count("*").over(group) - most).cast("long"))
    return ranked.filter(F.col("__k") <= most).drop("__k")


def best_then_fill(files: DataFrame, area: str, order: list[Column], most: int = 8) -> DataFrame:
    """The best file of each area, areas by name, then the best of what is left, until there are ``most``.

    Only the best of an area and the best ``most`` of all can be chosen, so one sort of few rows decides.
    """
    ranked = files.withColumn("__k", F.row_number().over(Window.partitionBy(area).orderBy(*order)))
    chosen = ranked.filter("__k = 1").orderBy(area).limit(most)
    rest = ranked.filter("__k > 1").orderBy(*order).limit(most)
    both = chosen.withColumn("__turn", F.lit(0)).unionByName(rest.withColumn("__turn", F.lit(1)))
    return both.orderBy("__turn", F.when(F.col("__turn") == 0, F.col(area)), *order).limit(most).drop("__k", "__turn")


def auto_depth(n_files: Column, wide: int = 100) -> Column:
    return F.when(n_files > wide, 2).otherwise(3)
