"""Queries on spans of lines: what encloses a hit or a hunk, what a selection cuts, and what a patch changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import code
from corvane.operators import patches, search, spans
from corvane.plans.code import _starts
from corvane.plans.registry import query
from corvane.plans.samples import CODE, code_files, code_lines, pick

IMPORTS = ("import ", "from ", "use ", "require ", "#include ")
FUNCTIONS = ("fn ", "pub fn ", "pub(crate) fn ", "async fn ", "function ", "export default function ", "def ", "func ")
_NAME = "(?:fn|class|struct|interface|type|def|func|function|const) +([A-Za-z_][A-Za-z0-9_]*)"

#: What the lines of the sample tree outline: definitions and imports, with made-up ends.
OUTLINE = CODE + f""", outline as (
    select path, line as ord, line::bigint as first, least(5 + doc_id % 97, line + 4 + line * 7 % 23)::bigint as last, case when {_starts("trim(text)", IMPORTS)} then 'import' when {_starts("trim(text)", FUNCTIONS)} then 'function' else 'other' end as kind,
        nullif(regexp_extract(text, '{_NAME}', 1), '') as name from code_lines where {_starts("trim(text)", (*code.DEFINITION_BEGINS, *IMPORTS))}
), hunks as (select distinct path, "begin", "begin" + doc_id % 9 as "end" from (select doc_id, path, 2 + (doc_id * 3 + unnest([0, 1, 2, 3]) * 17) % 60 as "begin" from code_files))"""


def outline_of(spark: SparkSession, sf: str) -> DataFrame:
    """path, ord, first, last, kind and name."""
    t = code.trimmed(F.col("text"))
    lines = code_lines(spark, sf).filter(code.begins(t, (*code.DEFINITION_BEGINS, *IMPORTS)))
    last = F.least(5 + F.col("doc_id") % 97, F.col("line") + 4 + F.col("line") * 7 % 23).cast("long")
    kind = F.when(code.begins(t, IMPORTS), "import").when(code.begins(t, FUNCTIONS), "function").otherwise("other")
    return lines.select("path", F.col("line").alias("ord"), F.col("line").cast("long").alias("first"), last.alias("last"), kind.alias("kind"), F.nullif(F.regexp_extract("text", _NAME, 1), F.lit("")).alias("name"))


def hunks_of(spark: SparkSession, sf: str) -> DataFrame:
    """path, begin and end."""
    d = F.col("doc_id")
    at = code_files(spark, sf).select("doc_id", "path", F.explode(F.array(*[2 + (d * 3 + k * 17) % 60 for k in range(4)])).alias("begin"))
    return at.select("path", "begin", (F.col("begin") + d % 9).alias("end")).distinct()


@query(f"""with {OUTLINE}, p as (select path, line as "at" from code_lines where contains(text, 'handle')),
    i as (select p.path, "at", ord, name, rank() over (partition by p.path, "at" order by last - first) as k from p join outline o on o.path = p.path and "at" between first and last and kind <> 'import')
    select path, "at", min(ord) as owner from i where k = 1 group by path, "at" having count(*) = 1 and any_value(name) is not null""")
def named_owners(spark, sf):
    """The one smallest definition around each hit; none if that has no name."""
    points = search.literal(code_lines(spark, sf), "handle").select("path", F.col("line").alias("at"))
    regions = outline_of(spark, sf).filter("kind <> 'import'").select("path", F.col("ord").alias("id"), "first", "last", F.col("name").isNotNull().alias("named"))
    return spans.narrowest_owner(points, regions)


_HELD = """select h.path, "begin", "end", ord, first, last, kind, name, row_number() over (partition by h.path, "begin", "end" order by last - first, {order}) as k from hunks h join outline o on o.path = h.path and first <= "begin" and "end" <= last"""


@query(f"""with {OUTLINE}, x as ({_HELD.format(order="ord desc")} and kind <> 'import') select path, "begin", "end", ord, first, last, kind from x where k = 1""")
def hunk_symbols(spark, sf):
    """The smallest definition that holds a whole hunk, the last of equal ones; imports hold nothing."""
    return spans.enclosing(hunks_of(spark, sf), outline_of(spark, sf).filter("kind <> 'import'")).drop("name")


@query(f"""with {OUTLINE}, p as (select path, line::bigint as "begin", line::bigint as "end" from code_lines where contains(text, 'value')), hunks2 as (from p),
    x as ({_HELD.format(order="ord").replace("hunks h", "hunks2 h")} and kind = 'function') select path, "begin", "end", ord, first, last from x where k = 1""")
def enclosing_functions(spark, sf):
    """The tightest function around each hit, the first of equal ones."""
    at = F.col("line").cast("long")
    points = search.literal(code_lines(spark, sf), "value").select("path", at.alias("begin"), at.alias("end"))
    return spans.enclosing(points, outline_of(spark, sf).filter("kind = 'function'"), latest=False).drop("kind", "name")


@query(f"""with {OUTLINE}, f as (from outline where kind = 'function'),
    a as (select h.path, "begin", "end", first, last, row_number() over (partition by h.path, "begin", "end" order by last - first, first) as k from hunks h join f on f.path = h.path and first < "begin" and "begin" <= last),
    b as (select h.path, "begin", "end", first, last, row_number() over (partition by h.path, "begin", "end" order by last - first, first) as k from hunks h join f on f.path = h.path and first <= "end" and "end" < last)
    select path, "begin", "end", first, last, first as missing_first, "begin" - 1 as missing_last from a where k = 1 union select path, "begin", "end", first, last, "end" + 1, last from b where k = 1""")
def cut_functions(spark, sf):
    return spans.cut_spans(hunks_of(spark, sf), outline_of(spark, sf).filter("kind = 'function'").select("path", "first", "last"))


@query(f"""with {OUTLINE}, o as (select distinct h.path, "begin", "end", first, last, name from hunks h join outline f on f.path = h.path and kind = 'function' and first <= "end" and last >= "begin")
    select * exclude (k), first <= "begin" and "end" <= last as holds from (select *, rank() over (partition by path, "begin", "end" order by last - first) as k from o) where k = 1""")
def smallest_frames(spark, sf):
    """Of the functions that overlap a selection the smallest, all of equal ones, and whether each holds it."""
    found = spans.overlapping(hunks_of(spark, sf), outline_of(spark, sf).filter("kind = 'function'").select("path", "first", "last", "name")).distinct()
    return spans.smallest(found, ["path", "begin", "end"]).withColumn("holds", (F.col("first") <= F.col("begin")) & (F.col("end") <= F.col("last")))


@query(f"""with {OUTLINE}, shown as (select distinct l.path, l.line from code_lines l join code_lines h on h.path = l.path and contains(h.text, 'handle') and l.line between h.line - 3 and h.line + 3)
    select path, first, last from outline o where (select count(*) from shown s where s.path = o.path and s.line between first and last) = last - first + 1""")
def covered_spans(spark, sf):
    """Definitions all of whose lines are shown around hits."""
    shown = search.context(code_lines(spark, sf).select("path", "line", "text"), "handle", 3)
    return spans.covered(outline_of(spark, sf).select("path", "first", "last"), shown)


_OWNED = """owned as (select p.path, p.line, min(ord) as owner from (select path, line from code_lines where contains(text, 'handle')) p left join (
    select p2.path, p2.line, ord, rank() over (partition by p2.path, p2.line order by last - first) as k, count(*) over (partition by p2.path, p2.line, last - first) as same from (select path, line from code_lines where contains(text, 'handle')) p2 join outline o on o.path = p2.path and line between first and last and kind = 'function') x
    on x.path = p.path and x.line = p.line and k = 1 and same = 1 group by 1, 2)"""


def _owned(spark: SparkSession, sf: str, terms: list[str]) -> DataFrame:
    hits = search.term_hits(code_lines(spark, sf).select("path", "line", "text"), terms).select("path", "line", "term")
    functions = outline_of(spark, sf).filter("kind = 'function'").select("path", F.col("ord").alias("id"), "first", "last")
    owners = spans.narrowest_owner(hits.select("path", F.col("line").alias("at")).distinct(), functions).withColumnRenamed("at", "line")
    return hits.join(owners, ["path", "line"], "left")


@query(f"""with {OUTLINE}, {_OWNED}, b as (select *, case when row_number() over w > 1 and lag(owner) over w is not distinct from owner then 0 else 1 end as new from owned window w as (partition by path order by line)),
    r as (select *, sum(new) over (partition by path order by line rows unbounded preceding) as run from b) select path, owner, min(line) as first, max(line) as last, count(*) as n, count(*) >= 3 and owner is not null as folded from r group by path, owner, run""")
def owner_runs(spark, sf):
    return spans.owner_runs(_owned(spark, sf, ["handle"]).drop("term")).drop("run")


@query(f"""with {OUTLINE}, t(slot, term) as (values (1, 'handle'), (2, 'user'), (3, 'token')), hits as (select path, line, slot from code_lines, t where contains(text, term)),
    x as (select h.path, h.line, h.slot, ord, rank() over (partition by h.path, h.line, h.slot order by last - first) as k, count(*) over (partition by h.path, h.line, h.slot, last - first) as same from hits h join outline o on o.path = h.path and line between first and last and kind = 'function'),
    c as (select path, ord as owner, slot, count(*) as n from x where k = 1 and same = 1 group by all)
    select path, owner, string_agg('#' || slot || case when n > 1 then '*' || n else '' end, ',' order by slot) as terms from c group by all""")
def owner_rollup(spark, sf):
    """For each function the terms in it by number, with how many lines have them."""
    slots = {"handle": 1, "user": 2, "token": 3}
    slot = F.element_at(F.create_map(*[F.lit(x) for kv in slots.items() for x in kv]), F.col("term"))
    counted = _owned(spark, sf, list(slots)).filter("owner is not null").groupBy("path", "owner", slot.alias("slot")).agg(F.count("*").alias("n"))
    shown = F.concat(F.lit("#"), F.col("slot").cast("string"), F.when(F.col("n") > 1, F.concat(F.lit("*"), F.col("n").cast("string"))).otherwise(""))
    return counted.groupBy("path", "owner").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", shown.alias("s")))), lambda x: x["s"]), ",").alias("terms"))


# --- patches -------------------------------------------------------------------------------------------------------

TEMPLATES = (
    "diff --git a/{p} b/{p}\nindex 1..2 100644\n--- a/{p}\n+++ b/{p}\n@@ -{k},3 +{k},4 @@ fn x\n context\n+added\n@@ -{n} +{n},0 @@",
    "diff --git a/{p} b/{p}\nnew file mode 100644\n--- /dev/null\n+++ b/{p}\n@@ -0,0 +1,{n} @@", "diff --git a/{p} b/{p}\ndeleted file mode 100644\n--- a/{p}\n+++ /dev/null\n@@ -1,{n} +0,0 @@",
    "diff --git a/{p} b/{p}.new\nsimilarity index 90%\nrename from {p}\nrename to {p}.new\n@@ -{k} +{k} @@", 'diff --git "a/{p} x" "b/{p} x"\n--- "a/{p} x"\n+++ "b/{p} x"\n@@ -{k},2 +{k} @@ y', "diff --git a/{p} b/{p}\nBinary files differ\n@@ -a,1 +2 @@\n@@ 1 +2 @@",
)
_T = "[" + ", ".join("'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for t in TEMPLATES) + "]"
_FILLED = " || chr(10) || ".join(f"replace(replace(replace(({_T})[(doc_id + {k}) % 6 + 1], '{{p}}', path), '{{k}}', (doc_id % 40 + 3)::varchar), '{{n}}', (5 + doc_id % 97)::varchar)" for k in range(3))
PATCH = OUTLINE + f""", patch_lines as (select patch, unnest(range(1, len(l) + 1)) as line, unnest(l) as text from (select doc_id as patch, string_split('preamble' || chr(10) || {_FILLED}, chr(10)) as l from code_files)),
    in_files as (select * from (select *, sum(starts_with(text, 'diff --git ')::int) over (partition by patch order by line rows unbounded preceding)::bigint as file from patch_lines) where file > 0),
    told as (select *, case when starts_with(text, 'diff --git "') then regexp_extract(text, '^diff --git "a/(.*)" "b/', 1) when starts_with(text, 'diff --git ') then regexp_extract(text, '^diff --git a/(.*) b/', 1) when starts_with(text, 'rename from ') then text[13:] end as old,
        case when starts_with(text, 'diff --git "') then regexp_extract(text, '" "b/(.*)"$', 1) when starts_with(text, 'diff --git ') then regexp_extract(text, '^diff --git a/.* b/(.*)$', 1) when starts_with(text, 'rename to ') then text[11:]
            when starts_with(text, '+++ b/') then text[7:] when starts_with(text, '+++ "') then regexp_extract(text, '"(.*)"', 1) end as new,
        case when starts_with(text, 'new file') then 'added' when starts_with(text, 'deleted file') then 'deleted' when starts_with(text, 'rename ') then 'renamed' when starts_with(text, 'diff --git') then 'modified' end as st from in_files),
    patch_files as (select patch, file, arg_max(new, line) filter (where new is not null) as path, arg_max(old, line) filter (where old is not null) as old_path, arg_max(st, line) filter (where st is not null) as status from told group by patch, file),
    patch_hunks as (select patch, file, line, g[2]::bigint as old_start, coalesce(nullif(g[3], ''), '1')::bigint as old_lines, g[4]::bigint as new_start, coalesce(nullif(g[5], ''), '1')::bigint as new_lines
        from (select patch, file, line, [regexp_extract(text, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 0), regexp_extract(text, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 1), regexp_extract(text, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 2), regexp_extract(text, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 3), regexp_extract(text, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 4)] as g from in_files) where g[1] <> '')"""


def patch_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")

    def filled(k: int):
        out = pick(TEMPLATES, (d + k) % 6)
        for mark, value in (("{p}", F.col("path")), ("{k}", (d % 40 + 3).cast("string")), ("{n}", (5 + d % 97).cast("string"))):
            out = F.replace(out, F.lit(mark), value)
        return out

    text = F.concat_ws("\n", F.lit("preamble"), *[filled(k) for k in range(3)])
    return code_files(spark, sf).select(d.alias("patch"), F.posexplode(F.split(text, "\n"))).select("patch", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


@query(f"with {PATCH} select patch, file, path, old_path, status from patch_files")
def patch_files(spark, sf):
    return patches.files(patch_lines(spark, sf))


@query(f"with {PATCH} select patch, file, line, old_start, old_lines, new_start, new_lines from patch_hunks")
def patch_hunks(spark, sf):
    return patches.hunks(patch_lines(spark, sf))


_CHANGED = f"""{PATCH}, placed as (select patch, file, path, status, new_start as "begin", new_start + greatest(new_lines, 1) - 1 as "end" from patch_hunks join patch_files using (patch, file)),
    x as (select p.*, ord, name, kind, first, last, row_number() over (partition by patch, file, "begin", "end" order by last - first, ord desc) as k from placed p join outline o on o.path = p.path and first <= "begin" and "end" <= last and kind <> 'import')"""


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    lines = patch_lines(spark, sf)
    end = F.col("new_start") + F.greatest(F.col("new_lines"), F.lit(1)) - 1
    placed = patches.hunks(lines).join(patches.files(lines), ["patch", "file"]).select("patch", "file", "path", "status", F.col("new_start").alias("begin"), end.alias("end"))
    return placed.join(spans.enclosing(placed.select("path", "begin", "end").distinct(), outline_of(spark, sf).filter("kind <> 'import'")), ["path", "begin", "end"])


@query(f"with {_CHANGED} select patch, count(distinct path) as files, count(distinct (path, ord, first, last)) as symbols from x where k = 1 group by patch")
def changed_symbols(spark, sf):
    """For each patch how many files with changed definitions, and how many of those."""
    return _changed(spark, sf).groupBy("patch").agg(F.count_distinct("path").alias("files"), F.count_distinct(F.struct("path", "ord", "first", "last")).alias("symbols"))


@query(f"with {_CHANGED} select distinct patch, path, name, first, last from x where k = 1 and kind = 'function' and status <> 'deleted'")
def changed_functions(spark, sf):
    return _changed(spark, sf).filter("kind = 'function' and status <> 'deleted'").select("patch", "path", "name", "first", "last").distinct()


@query(f"with {CODE} select path, null::varchar as old_path, 'added' as status, 0::bigint as old_start, 0::bigint as old_lines, 1::bigint as new_start, len(l)::bigint as new_lines from code_files where starts_with(path, 'g0/')")
def untracked_files(spark, sf):
    files = code_files(spark, sf).filter(F.startswith("path", F.lit("g0/"))).select("path", F.size(F.split("content", "\n")).alias("n_lines"))
    return patches.untracked(files)
