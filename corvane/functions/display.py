"""Text as it is shown: cut, centred, counted and quoted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_CHARS = 360


def byte_prefix(c: Column, most: int) -> Column:
    """The longest prefix within ``most`` bytes that cuts no character."""
    raw = c.cast("binary")
    # A character has four bytes at most: of the cuts from most - 3 on, the last before which a character ends.
    starts = lambda k: ~F.hex(F.substring(raw, F.lit(k + 1), F.lit(1))).rlike("^[89AB]")
    at = F.lit(max(0, most - 3))
    for k in range(max(0, most - 3), most + 1):
        at = F.when(starts(k), k).otherwise(at)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.substring(raw, F.lit(1), at).cast("string"))


def compact_line(c: Column, term: str) -> Column:
    """A line of up to LINE_CHARS characters as it is; else the part of that size around the term's first place, or the beginning."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    n = F.length(c)
    hit = F.instr(F.lower(c), F.lit(term.lower())) - 1
    first = F.greatest(F.lit(0), hit - LINE_CHARS // 2)
    last = F.greatest(F.least(first + LINE_CHARS, n), F.least(hit + len(term), n))
    window = F.concat(F.when(first > 0, "…").otherwise(""), trim(F.substr(c, first + 1, last - first)), F.when(last < n, "…").otherwise(""))
    cut = F.concat(F.regexp_replace(F.substring(c, 1, LINE_CHARS), r"\s+$", ""), F.lit("…"))
    return F.when(n <= LINE_CHARS, c).when(hit >= 0, window).otherwise(cut)


def compact_argument(c: Column, limit: int = 120, head: int = 72, tail: int = 40) -> Column:
    """White space runs as one space; beyond the limit, the beginning and the end."""
    one = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " ")
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.substring(one, 1, head), F.lit(" … "), F.right(one, F.lit(tail))))


def grouped_count(n: Column) -> Column:
    """A whole number with a comma before each three digits."""
    return F.format_number(n.cast("decimal(20,0)"), 0)


def _tenths(n: Column, unit: int) -> Column:
    """n / unit as a double to one place: halves go by the double's exact value, an exact half to the even digit."""
    x = n.cast("double") / float(unit)
    # Twenty times x as a product and its rounding error: the upper and the lower half of x have few enough bits.
    upper = x * 134217729.0 - (x * 134217729.0 - x)
    twenty = x * 20.0
    error = (upper * 20.0 - twenty) + (x - upper) * 20.0
    low = F.floor(twenty / 2.0).cast("long")
    odd = twenty == low * 2 + 1
    up = (twenty > low * 2 + 1) | (odd & ((error > 0) | ((error == 0) & (low % 2 == 1))))
    t = low + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def token_count(n: Column) -> Column:
    """1234567 as 1.2M, 1234 as 1.2k, less as it is."""
    return F.when(n >= 1_000_000, F.concat(_tenths(n, 1_000_000), F.lit("M"))).when(n >= 1_000, F.concat(_tenths(n, 1_000), F.lit("k"))).otherwise(n.cast("string"))


def shell_quoted(c: Column) -> Column:
    """As one argument of a shell; null if it has control characters."""
    return F.when(c.rlike(r"\p{Cc}"), F.lit(None)).when(c.rlike(r"^[A-Za-z0-9_./:-]*$"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def escaped_term(c: Column) -> Column:
    """Backslashes, back quotes and line ends written out."""
    out = c
    for plain, shown in (("\\", "\\\\"), ("`", "\\`"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(shown))
    return out


def relative(path: Column, base: str) -> Column:
    """Below a folder, without it; else as it is."""
    inside = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(inside)), F.substring(path, len(inside) + 1, 1 << 30)).otherwise(path)


def split_dotted(c: Column) -> Column:
    """The two sides of exactly one dot, neither empty; null else."""
    good = c.rlike(r"^[^.]+\.[^.]+$")
    at = F.split(c, r"\.")
    return F.when(good, F.struct(F.get(at, 0).alias("qualifier"), F.get(at, 1).alias("name")))


def receiver_type(c: Column) -> Column:
    """Without stars before it and brackets after it."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return trim(F.regexp_extract(trim(F.regexp_replace(trim(c), r"^\*+", "")), r"^([^\[]*)", 1))


def basic_entities(c: Column) -> Column:
    out = c
    for entity, plain in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def is_newer_version(latest: Column, current: Column) -> Column:
    """By the first three numbers between dots and hyphens; what is no number counts as 0."""
    number = lambda c, k: F.coalesce(F.regexp_extract(F.coalesce(F.get(F.split(c, "[.-]"), k), F.lit("")), "^([0-9]+)$", 1).try_cast("long"), F.lit(0))
    triple = lambda c: F.struct(*[number(c, k).alias(f"v{k}") for k in range(3)])
    return triple(latest) > triple(current)


# What kinds of evidence are called.
CONFIDENCE = {"ast": "structural syntax", "text": "text evidence", "document": "document navigation", "artifact": "artifact-level"}


def confidence(source: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), source)
