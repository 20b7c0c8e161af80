"""Quality rules: text statistics, fixed base rules and a learned decision list, all as Spark expressions.

The statistics, the base rules and the learned list are DataFrame functions; no Python runs on the executors. The
list is learned by sequential covering on statistics of labelled documents: a rule for bad documents
grows one threshold at a time on two thirds of the rows, is pruned from its end on the other third, and is kept while it is precise there; the
rows it covers leave, and the next rule is grown. ``verdict`` emits the rules as one ordered conditional.

Words are ``[^\\x20\\x09-\\x0D]+``. Edge cases: null or empty texts have no words and fail the base rules; labels that are null, or whose
document isn't there, aren't used; labels of one doc_id count once if they agree and not at all if they don't; rows with one doc_id and text
count once, with different texts each; without labels of both kinds the list is empty and the base rules alone decide. Every row gives a row.
Tables may have columns of any name: their rows travel as one struct beside the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: The list is fitted on about this many labelled rows at most, chosen by a hash of doc_id and text.
MAX_LABELLED = 20_000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A rule must be right on this share of the documents that it rejects, and cover this many.
PRECISION = 0.95
MIN_COVER = 5

_SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("symbols_per_word", "symbol_words", "upper_share", "bang_per_word", "repeat_share", "dup_line_share", "chars_per_word", "distinct_share", "n_words")


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs at least twice."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, e, i: F.coalesce(F.get(s, i)["h"] == e["h"], F.lit(False))
    places = lambda s: F.sort_array(F.transform(F.filter(s, lambda e, i: same(s, e, i - 1) | same(s, e, i + 1)), lambda e: e["i"]))
    total = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return _let(pairs, lambda s: _let(places(s), total))


def _repeated(words: Column) -> Column:
    """Words in windows of WINDOW words that the text has at least twice. A window is known by its 64-bit hash."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    count = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(hashes, lambda h: _let(windows(h), count)))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, which has none named ``__raw`` or ``__stats``, and its statistics in the struct ``__stats``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_word = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.size(F.filter(w, lambda x: x.rlike(r"[#*$%&|<>]"))).cast("long").alias("n_symbol_words"),
        ),
    )
    without = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    raw = F.struct(
        by_word.alias("w"), _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"), F.size(lines).cast("long").alias("n_lines"),
        without("[#*$%&|<>]+").alias("n_symbols"), without(r"\p{Lu}+").alias("n_upper"), without("!+").alias("n_bang"),
    )
    return docs.withColumn("__raw", raw).withColumn("__stats", _shares("__raw.")).drop("__raw")


def _shares(at: str) -> Column:
    s = lambda name: F.col(at + name)
    per = lambda a, b: (a / F.greatest(b, F.lit(1))).cast("double")
    n = s("w.n_words")
    return F.struct(
        n.alias("n_words"), s("w.word_chars").alias("word_chars"), s("n_symbols").alias("n_symbols"), s("n_dup_lines").alias("n_dup_lines"), s("w.n_repeat_words").alias("n_repeat_words"),
        per(s("n_symbols"), n).alias("symbols_per_word"), per(s("w.n_symbol_words"), n).alias("symbol_words"), per(s("n_upper"), s("w.word_chars")).alias("upper_share"), per(s("n_bang"), n).alias("bang_per_word"),
        per(s("w.n_repeat_words"), n).alias("repeat_share"), per(s("n_dup_lines"), s("n_lines")).alias("dup_line_share"), per(s("w.word_chars"), n).alias("chars_per_word"), per(s("w.n_distinct"), n).alias("distinct_share"),
    )


def base_failed() -> Column:
    n = F.col("__stats.n_words")
    return (n < MIN_WORDS) | (100 * F.col("__stats.n_repeat_words") > MAX_REPEAT_PERCENT * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.col(f"__stats.{self.feature}")
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _thresholds(rows: list[dict], feature: str, steps: int = 48) -> list[float]:
    values = sorted({r[feature] for r in rows})
    if len(values) < 2:
        return []
    picks = sorted({round(k * (len(values) - 2) / steps) for k in range(steps + 1)})
    return sorted({(values[k] + values[k + 1]) / 2 for k in picks})


def _counts(rows: list[dict]) -> tuple[int, int]:
    bad = sum(r["bad"] for r in rows)
    return bad, len(rows) - bad


def _grow(rows: list[dict], features: tuple[str, ...], most: int = 4) -> Rule:
    """Add the condition with the largest information gain until no good document is covered."""
    from bisect import bisect_left
    from math import log2

    rule: list[Condition] = []
    while len(rule) < most:
        bad, good = _counts(rows)
        if not bad or not good:
            break
        before, best = log2(bad / (bad + good)), (0.0, None)
        for f in features:
            bads, goods = sorted(r[f] for r in rows if r["bad"]), sorted(r[f] for r in rows if not r["bad"])
            for t in _thresholds(rows, f):
                b, g = bisect_left(bads, t), bisect_left(goods, t)  # thresholds lie between values
                for above, p, n in ((False, b, g), (True, bad - b, good - g)):
                    if p and (gain := p * (log2(p / (p + n)) - before)) > best[0]:
                        best = (gain, Condition(f, above, t))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if best[1].holds(r)]
    return tuple(rule)


def _worth(rule: Rule, rows: list[dict]) -> float:
    bad, good = _counts([r for r in rows if _covers(rule, r)])
    return (bad - good) / (bad + good) if bad + good else -1.0


def learn(rows: list[dict], features: tuple[str, ...] = FEATURES, most: int = 12) -> list[Rule]:
    """Rules for rows with ``bad`` true, in order, from dicts with the features, ``bad`` and ``fold`` (0, 1 or 2; 2 is for pruning)."""
    rules: list[Rule] = []
    left = rows
    while len(rules) < most:
        grown, held = [r for r in left if r["fold"] < 2], [r for r in left if r["fold"] == 2]
        rule = _grow(grown, features)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda x: _worth(x, held))
        bad, good = _counts([r for r in left if _covers(rule, r)])
        if bad < MIN_COVER or bad < PRECISION * (bad + good):
            break
        rules.append(rule)
        left = [r for r in left if not _covers(rule, r)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects: one ordered conditional, a branch for each rule."""
    out = F.lit(True)
    for rule in reversed(rules):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> list[Rule]:
    """Learn from ``labels`` (doc_id, quality: 0 is bad); about ``limit`` rows at most."""
    flagged = labels.select(F.col("doc_id").cast("long").alias("__label_id"), (F.col("quality") == 0).alias("__bad")).filter("__label_id is not null and __bad is not null")
    known = flagged.groupBy("__label_id").agg(F.min("__bad").alias("__bad"), F.max("__bad").alias("__too")).filter("__bad = __too").drop("__too")
    million = 1_000_000

    def share(n: int) -> int:
        return million if n <= limit else int(million * limit / n)

    # Bounded by about ``limit``, and small: an id and a flag for each.
    few = F.broadcast(known.filter(F.pmod(F.xxhash64("__label_id"), F.lit(million)) < share(known.count())))
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    rows = named.select("__id").join(few, F.col("__id") == F.col("__label_id")).count()  # an id may have any number of rows
    key = F.xxhash64("__id", "__text")
    chosen = named.join(few, F.col("__id") == F.col("__label_id"))
    if rows > limit:
        chosen = chosen.withColumn("__key", key).dropDuplicates(["__key"])
        chosen = chosen.filter(F.pmod(F.col("__key"), F.lit(million)) < share(chosen.count())).drop("__key")
    else:
        chosen = chosen.dropDuplicates(["__id", "__text"])
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("__id")), F.lit(3)).cast("int")
    # Rows that the base rules reject leave here, not by a filter, which would be pushed below the join and so need every text's statistics.
    found = with_statistics(chosen, "__text").select(F.col("__bad").alias("bad"), fold.alias("fold"), base_failed().alias("out"), *[F.col(f"__stats.{f}") for f in FEATURES])
    return learn(sorted((r.asDict() for r in found.collect() if not r.out), key=lambda r: tuple(r.values())))


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the statistics of the contract, base_failed and kept for every row."""
    stats = with_statistics(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    named = [F.col(f"__stats.{n}") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return stats.select("doc_id", *named, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    return with_statistics(rows, "__text").filter(~base_failed() & verdict(rules)).select("__row.*")
