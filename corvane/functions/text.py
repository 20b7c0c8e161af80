"""Column functions of text, paths and identifiers; all built in, none in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def estimate_tokens(c: Column) -> Column:
    """A token for each four bytes, rounded up."""
    return F.ceil(F.octet_length(c) / 4).cast("long")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of the bytes."""
    raw = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(raw(a), raw(b))


def normalize_ident(c: Column) -> Column:
    return ascii_lower(F.replace(c, F.lit("_"), F.lit("")))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def format_size(n: Column) -> Column:
    """Bytes, then whole KB, then MB and tenths of it, from whole-number arithmetic."""
    mega = 1024 * 1024
    tenths = F.concat(F.floor(n / mega).cast("string"), F.lit("."), F.floor(F.pmod(n, F.lit(mega)) * 10 / mega).cast("string"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < mega, F.concat(F.floor(n / 1024).cast("string"), F.lit("KB"))).otherwise(F.concat(tenths, F.lit("MB")))


def word_match(text: Column, word: str) -> Column:
    return text.rlike(rf"(?U)\b{re.escape(word)}\b")


def in_order(text: Column, first: str, second: str) -> Column:
    """``second`` begins after the leftmost ``first`` ends."""
    at = F.locate(first, text)
    return (at > 0) & (F.instr(F.substr(text, at + F.lit(len(first))), F.lit(second)) > 0)


def path_contains(path: Column, part: str) -> Column:
    """Slashes of either kind are the same."""
    return F.contains(F.translate(path, "\\", "/"), F.lit(part.replace("\\", "/")))


def glob_regex(glob: str) -> str:
    """* and ? cross slashes; {a,b} is a choice."""
    out, depth = "", 0
    for c in glob:
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        else:
            out += {"*": ".*", "?": "."}.get(c, "|" if c == "," and depth else re.escape(c))
    return f"^{out}$"


def is_identifier(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z_$@][A-Za-z0-9_$.-]*$")


def terminal_callable_key(c: Column) -> Column:
    """What follows the last . or ::; where it ends the text, what comes before it; a separator alone gives nothing."""
    return F.when(c.rlike(r"^(?s:.*)(?:\.|::)$"), F.regexp_extract(c, r"^((?s:.*?))(?:\.|::)$", 1)).when(c.rlike(r"\.|::"), F.regexp_extract(c, r"^(?s:.*)(?:\.|::)((?s:.+))$", 1)).otherwise(c)


def is_external_link(c: Column) -> Column:
    """A link of a document that leaves the tree: from the root, or with a scheme that names a place."""
    source = F.regexp_replace(c, r"^\s+|\s+$", "")
    nowhere = (source == "") | source.rlike(r"(?i)^(?:#|[a-z]:[/\\]|data:|javascript:|mailto:|tel:)")
    return ~nowhere & source.rlike(r"^(?:/|[A-Za-z][A-Za-z0-9+.-]+:)")
