"""Queries that ask a tree as a user does, through ``corvane.commands``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corvane import commands
from corvane.operators import documents
from corvane.plans.code import _starts
from corvane.plans.intervals import _CHANGED, outline_of, patch_lines
from corvane.plans.navigation import SITES, sites_of
from corvane.plans.registry import query
from corvane.plans.samples import CODE, code_files, code_lines
from corvane.plans.syntax import PARTS, python_files
from corvane.functions import code

_NAME = "(?:fn|class|struct|interface|type|def|func|function|const|trait|enum|mod) +([A-Za-z_][A-Za-z0-9_]*)"
_WORD = "regexp_matches(text, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')"
_DEF = _starts("trim(text)", code.DEFINITION_BEGINS)


def tree(spark: SparkSession, sf: str) -> commands.Tree:
    return commands.Tree(code_files(spark, sf).select("path", "dir", "name", "content"))


def python_tree(spark: SparkSession, sf: str) -> commands.Tree:
    files = python_files(spark, sf)
    return commands.Tree(files.select("path", F.lit("py").alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"), "content"))


def _symbol(w: str) -> str:
    return f"""with {CODE}, d as (select path, line, text from code_lines where {_DEF} and contains(text, '{w}') and regexp_extract(text, '{_NAME}', 1) = '{w}') select path, line, text, 'definition' as found from d
    union all select path, line, text, 'occurrence' from code_lines l where {_WORD.format(w=w)} and not exists (select 1 from d where d.path = l.path and d.line = l.line)"""


@query(_symbol("handle_auth"))
def find_symbol(spark, sf):
    return tree(spark, sf).find("handle_auth")


@query(_symbol("handle"))
def find_concept(spark, sf):
    """A word that is defined: definitions and occurrences."""
    return tree(spark, sf).find("handle")


@query(f"with {CODE} select path, line, text, 'text' as found from code_lines where contains(text, 'oken')")
def find_text(spark, sf):
    """A part of a word, which is no name: text."""
    return tree(spark, sf).find("oken")


@query(f"with {CODE} select path, line, text, 'relaxed' as found from code_lines where regexp_matches(text, 'user.*handle|handle.*user')")
def find_phrase(spark, sf):
    """Two words that are no phrase of the tree: lines with both."""
    return tree(spark, sf).find("user handle")


@query(f"with {CODE} select path, line, text, 'definition' as found from code_lines where {_DEF} and regexp_matches(regexp_extract(text, '{_NAME}', 1), '^handle_.*$') and starts_with(path, 'g0/')")
def find_symbol_glob(spark, sf):
    return tree(spark, sf).find("handle_*", "path:g0/")


@query(f"with {CODE} select path, null::int as line, null::varchar as text, 'path' as found from code_files where ends_with(name, '.py')")
def find_files(spark, sf):
    return tree(spark, sf).find("*.py")


@query(f"""with {CODE}, t as (select path, line, rtrim(text) as t, sum(starts_with(text, '```')::int) over (partition by path order by line rows unbounded preceding) % 2 = 1 as inside, max(line) over (partition by path) as total from code_lines),
    f as (select path, min(line) as first, any_value(total) as total from t where not inside and (t = '# Title' or starts_with(t, '# Title ')) group by path)
    select path, first, coalesce((select min(line) - 1 from t where t.path = f.path and t.line > f.first and not inside and starts_with(t.t, '#') and length(regexp_extract(t.t, '^(#*)', 1)) <= 1), total)::int as last from f""")
def heading_sections(spark, sf):
    """In each file the section of its first "# Title"."""
    return documents.section_of(code_lines(spark, sf).select("path", "line", "text"), "# Title")


@query(f"with {CODE} select path, line, text from code_lines where path = 'g0/src/search.rs' and (line between 2 and 4 or line = 1)")
def show_ranges(spark, sf):
    return tree(spark, sf).show("g0/src/search.rs", lines="1,2-4")


@query(f"""with {CODE}, a as (select string_split(dir, '/') as s, ceil(byte_len / 4)::bigint as t from code_files), p as (select unnest([array_to_string(s[:k], '/') for k in range(0, least(len(s), 3) + 1)]) as folder, t from a) select folder, sum(t)::bigint as tokens, count(*) as n_files from p group by folder""")
def overview(spark, sf):
    return tree(spark, sf).overview(3)


_T = "len(list_filter(string_split(lower(path), '/'), lambda x: x in ('test', 'tests', 'spec', 'specs', '__tests__'))) > 0"


@query(f"""with {SITES}, s as (select * from sites where callee = 'f26'), g as (select 'kind' as field, case when {_T} then 'test' else 'production' end as key, count(*) as n from s group by 2 union all select 'receiver', coalesce(receiver, '<none>'), count(*) from s group by 2 union all select 'file', path, count(*) from s group by 2)
    select field, key, n from (select *, row_number() over (partition by field order by n desc, key) as k from g) where k <= 10""")
def assess_sites(spark, sf):
    return commands.assessed(sites_of(spark, sf).filter("callee = 'f26'"))


@query(f"""with {_CHANGED}, {PARTS.replace("parts as", "pyparts as").replace("from parts", "from pyparts")}, n as (select callee as name, count(*) as n_calls from sites group by callee)
    select distinct patch, path, x.name, first, last, coalesce(n_calls, 0) as n_calls from x left join n on n.name = x.name where k = 1 and kind = 'function' and status <> 'deleted'""")
def review_patches(spark, sf):
    """Changed functions of patches, with the call sites that the Python files have of each name."""
    return python_tree(spark, sf).review(patch_lines(spark, sf), outline_of(spark, sf))


@query(f"""with {PARTS}, f as (select path, 'call ' || callee as feature, caller as fn from sites union all select path, access || ' ' || member, function from reads),
    l as (select feature, count(*) as l from f where path = 'py/m1.py' and fn = 'Store.put' group by feature), r as (select feature, count(*) as r from f where path = 'py/m2.py' and fn = 'load' group by feature)
    select feature, least(coalesce(l, 0), coalesce(r, 0)) as common, greatest(0, coalesce(l, 0) - coalesce(r, 0)) as left_only, greatest(0, coalesce(r, 0) - coalesce(l, 0)) as right_only from l full join r using (feature)""")
def compare_functions(spark, sf):
    return python_tree(spark, sf).compare(("py/m1.py", "Store.put"), ("py/m2.py", "load"))


@query(f"with {PARTS} select path, line, callee, caller, receiver, line > min(line) over (partition by path, caller) as repeated from sites where callee = 'parse'")
def callers_of(spark, sf):
    return python_tree(spark, sf).callers("module.parse").select("path", "line", "callee", "caller", "receiver", "repeated")


@query(f"""with {PARTS}, s as (select * from sites where path = 'py/m1.py' and caller = 'Store.clear'), d as (select name, kind, first, last, row_number() over (partition by name order by first) as k from entries where path = 'py/m1.py' and depth <= 1 and kind <> 'import')
    select line, callee, receiver, args, kind, first, last from s left join d on d.name = s.callee and k = 1""")
def callees_of(spark, sf):
    return python_tree(spark, sf).callees("py/m1.py", "clear")
