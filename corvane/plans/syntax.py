"""Queries on Python source: blocks of code put together by each document's number, so that SQL can say what the parser must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import spans
from corvane.operators import syntax as S
from corvane.plans.registry import query
from corvane.plans.samples import pick
from corvane.sources import adapters

BLOCKS = (
    "import os, sys\nfrom a.b import c",
    'class Store:\n    """Keeps things."""\n\n    def put(self, key, value):\n        self.items[key] = value\n        self.count += 1\n        return self.find(key)\n\n    @property\n    def size(self):\n        return self.count\n\n    def clear(self):\n        self.count = 0\n        self.put("a", None)',
    "def load(path, mode=default()):\n    # a comment\n    data = open(path).read()\n    if check(data):\n        return parse(data)\n    return None",
    "async def outer(x):\n    def inner(y):\n        return helper(y, k=x)\n    f = lambda z: inner(z)\n    return f(x)",
    "@decorate(1)\ndef plain():\n    pass\n\nvalue = plain()",
    "class Outer:\n    class Inner:\n        def deep(self):\n            other.state = None\n            return self.state",
)
#: What each block has, with lines counted from its first: entries by (depth, kind, name, container, first, last).
_ENTRIES = (
    (0, 0, "import", "import os, sys", None, 1, 1), (0, 0, "import", "from a.b import c", None, 2, 2), (1, 0, "class", "Store", None, 1, 15), (1, 1, "function", "put", "Store", 4, 7), (1, 1, "function", "size", "Store", 10, 11), (1, 1, "function", "clear", "Store", 13, 15),
    (2, 0, "function", "load", None, 1, 6), (3, 0, "function", "outer", None, 1, 5), (4, 0, "function", "plain", None, 2, 3), (5, 0, "class", "Outer", None, 1, 5), (5, 1, "class", "Inner", "Outer", 2, 5), (5, 2, "function", "deep", "Inner", 3, 5),
)
_OWNERS = ((1, "Store.put", 4, 7, False), (1, "Store.size", 10, 11, False), (1, "Store.clear", 13, 15, False), (2, "load", 1, 6, False), (3, "outer", 1, 5, False), (3, "outer.inner", 2, 3, False), (3, None, 4, 4, True), (4, "plain", 2, 3, False), (5, "Outer.Inner.deep", 3, 5, False))
#: line, callee, receiver, number of arguments, caller, assigned, returned
_CALLS = (
    (1, 7, "find", "self", 1, "Store.put", None, True), (1, 15, "put", "self", 2, "Store.clear", None, False), (2, 1, "default", None, 0, "load", None, False), (2, 3, "read", "open(path)", 0, "load", "data", False), (2, 3, "open", None, 1, "load", None, False),
    (2, 4, "check", None, 1, "load", None, False), (2, 5, "parse", None, 1, "load", None, True), (3, 3, "helper", None, 2, "outer.inner", None, True), (3, 4, "inner", None, 1, "outer", "f", False), (3, 5, "f", None, 1, "outer", None, True),
    (4, 1, "decorate", None, 1, "<top-level>", None, False), (4, 5, "plain", None, 0, "<top-level>", "value", False),
)
#: line, base, member, access, role, function
_ACCESSES = (
    (1, 5, "self", "items", "read", "expression", "Store.put"), (1, 6, "self", "count", "write", "assignment left", "Store.put"), (1, 7, "self", "find", "read", "return", "Store.put"), (1, 11, "self", "count", "read", "return", "Store.size"), (1, 14, "self", "count", "reset", "assignment left", "Store.clear"),
    (1, 15, "self", "put", "read", "expression", "Store.clear"), (2, 3, "open(path)", "read", "read", "assignment right", "load"), (5, 4, "other", "state", "reset", "assignment left", "Outer.Inner.deep"), (5, 5, "self", "state", "read", "return", "Outer.Inner.deep"),
)


def _sql(value) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)


_SIZES = "[" + ", ".join(str(b.count("\n") + 1) for b in BLOCKS) + "]"
#: A block of each file with the line before its first; a blank line parts blocks.
PARTS = f"""parts as (select doc_id, 'py/m' || doc_id || '.py' as path, unnest([doc_id % 6, (doc_id + 1) % 6, (doc_id * 5 + 2) % 6]) as block, unnest([0, ({_SIZES})[doc_id % 6 + 1] + 1, ({_SIZES})[doc_id % 6 + 1] + ({_SIZES})[(doc_id + 1) % 6 + 1] + 2]) as before, unnest([0, 1, 2]) as nth from documents),
    e(block, depth, kind, name, container, first, last) as (values {_values(_ENTRIES)}), o(block, name, first, last, barrier) as (values {_values(_OWNERS)}), c(block, line, callee, receiver, args, caller, assigned, returned) as (values {_values(_CALLS)}), a(block, line, base, member, access, role, function) as (values {_values(_ACCESSES)}),
    entries as (select path, depth, kind, name, container, first + before as first, last + before as last from parts join e using (block)), sites as (select path, line + before as line, callee, receiver, args, caller, assigned, returned from parts join c using (block)),
    reads as (select path, line + before as line, base, member, access, role, function from parts join a using (block))"""


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    content = F.concat_ws("\n\n", pick(BLOCKS, d % 6), pick(BLOCKS, (d + 1) % 6), pick(BLOCKS, (d * 5 + 2) % 6))
    return adapters.table(spark, sf, "documents").select(F.concat(F.lit("py/m"), d.cast("string"), F.lit(".py")).alias("path"), content.alias("content"))


@query(f"with {PARTS} select path, depth, kind, name, container, first, last from entries")
def python_outline(spark, sf):
    return S.with_container(S.outline(python_files(spark, sf))).select("path", "depth", "kind", "name", "container", "first", "last")


@query(f"with {PARTS} select path, name, first + before as first, last + before as last, barrier from parts join o using (block)")
def python_owners(spark, sf):
    return S.owners(python_files(spark, sf)).drop("id")


@query(f"with {PARTS} select path, line, callee, receiver, args, caller, assigned, returned from sites")
def python_calls(spark, sf):
    return S.calls(python_files(spark, sf)).drop("arguments", "text")


@query(f"with {PARTS} select path, line, base, member, access, role, function from reads")
def python_accesses(spark, sf):
    return S.accesses(python_files(spark, sf))


@query(f"with {PARTS} select path, first, last, kind from entries where name = 'put' and container = 'Store'")
def python_definitions(spark, sf):
    """Store.put, wherever it is defined."""
    return S.definitions(S.outline(python_files(spark, sf)), "Store.put").select("path", "first", "last", "kind")


@query(f"""with {PARTS} select distinct path, first, last from entries where name = 'deep' and container = 'Inner' union select path, first, last from entries where false""")
def python_selected(spark, sf):
    return S.select(S.outline(python_files(spark, sf)), "Inner.deep")


@query(f"with {PARTS} select path, name, container || '.' || name as selector from entries where kind = 'function'")
def python_selectors(spark, sf):
    entries = S.with_container(S.outline(python_files(spark, sf))).filter("kind = 'function'")
    return entries.select("path", "name", S.selector(F.col("name"), F.col("container")).alias("selector"))


@query(f"with {PARTS} select path, string_agg(distinct callee, ' ' order by callee) as callees from sites group by path")
def python_callees(spark, sf):
    return S.callee_names(S.calls(python_files(spark, sf)))


@query(f"""with {PARTS}, d as (select path, name, kind, first, last, row_number() over (partition by path, name order by first) as k from entries where depth <= 1 and kind <> 'import')
    select s.path, callee, kind, first, last from (select distinct path, callee from sites) s join d on d.path = s.path and d.name = s.callee and k = 1""")
def python_callees_resolved(spark, sf):
    files = python_files(spark, sf)
    return S.resolved_callees(S.calls(files), S.outline(files))


@query(f"""with {PARTS}, u as (select distinct path, regexp_extract(function, '^(?:.*\\.)?([^.]+)\\.[^.]+$', 1) as container, member as name from reads where base = 'self'), d as (select *, row_number() over (partition by path, container, name order by first) as k from entries where container is not null)
    select path, container, name, kind, case name when 'put' then 'def put(self, key, value)' when 'size' then 'def size(self)' when 'clear' then 'def clear(self)' when 'deep' then 'def deep(self)' else name end as signature, first, last, row_number() over (partition by path, container order by kind <> 'function', name)::int as rank from d join u using (path, container, name) where k = 1""")
def python_siblings(spark, sf):
    """Members of a class that its own code uses."""
    files = python_files(spark, sf)
    uses = S.accesses(files).filter("base = 'self'").select("path", F.regexp_extract("function", r"^(?:.*\.)?([^.]+)\.[^.]+$", 1).alias("container"), F.col("member").alias("name"))
    return S.siblings(S.outline(files), uses)


@query(f"""with {PARTS} select path, function, member, string_agg(access || ':' || line, ' ' order by line, access) as steps, count(*) filter (where access = 'write') as n_write, count(*) filter (where access = 'reset') as n_reset, count(*) filter (where access = 'read') as n_read from reads group by all""")
def member_lifecycles(spark, sf):
    return S.lifecycles(S.accesses(python_files(spark, sf)))


@query(f"with {PARTS} select path, line, member, access from reads where access in ('write', 'reset') and contains(function, 'Store') and contains(path, '1')")
def accesses_filtered(spark, sf):
    return S.filtered_accesses(S.accesses(python_files(spark, sf)), ("write", "reset"), function="Store", path="1").select("path", "line", "member", "access")


@query(f"""with {PARTS}, r as (select path, name, first + before as first, last + before as last, barrier from parts join o using (block)), p as (select distinct path, line from sites),
    x as (select p.path, line, name, barrier, rank() over (partition by p.path, line order by last - first) as k, count(*) over (partition by p.path, line, last - first) as same from p join r on r.path = p.path and line between first and last) select path, line as "at", name as owner from x where k = 1 and same = 1 and not barrier""")
def python_call_owners(spark, sf):
    """The one function that each line with a call belongs to; lambdas own nothing and let nothing through."""
    files = python_files(spark, sf)
    points = S.calls(files).select("path", F.col("line").alias("at")).distinct()
    regions = S.owners(files).select("path", F.struct("name", "id").alias("id"), "first", "last", (~F.col("barrier")).alias("named"))
    return spans.narrowest_owner(points, regions).select("path", "at", F.col("owner.name").alias("owner"))
