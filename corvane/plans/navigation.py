"""Queries on call sites, imports and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import code, paths
from corvane.functions import text as T
from corvane.operators import budget, search, trace
from corvane.operators import dependencies as deps
from corvane.plans.code import _LANG, MATCHES, _has, _in, _starts, matches_of
from corvane.plans.registry import query
from corvane.plans.samples import CODE, code_files, code_lines, pick
from corvane.sources import adapters

# --- call sites ----------------------------------------------------------------------------------------------------

RECEIVERS = ("self", "this", "&kernel", "*h", "", "(super)", "client")
SITES = f"""sites as (
    select 'd' || (l_partkey % 7) || '/' || case when l_suppkey % 3 = 0 then 'sub/' else '' end || 'm' || (l_partkey % 23) || '.rs' as path, l_orderkey::bigint as line, case when l_linenumber = 7 then '<top-level>' else 'T' || (l_partkey % 5) || '.f' || (l_partkey % 997) end as caller,
        'f' || (l_suppkey * 13 % 997) as callee, case when l_quantity > 45 then null else ({"[" + _in(RECEIVERS) + "]"})[l_partkey % 7 + 1] end as receiver, case when l_linenumber = 6 then null else l_linenumber end as args, 'call ' || l_suppkey || '(' || l_partkey || ')' as text from lineitem
)"""


def sites_of(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as call sites."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    word = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    return adapters.table(spark, sf, "lineitem").select(
        F.concat(word("d", p % 7, "/"), F.when(s % 3 == 0, "sub/").otherwise(""), word("m", p % 23, ".rs")).alias("path"), F.col("l_orderkey").cast("long").alias("line"), F.when(n == 7, trace.TOP_LEVEL).otherwise(word("T", p % 5, ".f", p % 997)).alias("caller"),
        word("f", s * 13 % 997).alias("callee"), F.when(F.col("l_quantity") <= 45, pick(RECEIVERS, p % 7)).alias("receiver"), F.when(n != 6, n).alias("args"), word("call ", s, "(", p, ")").alias("text"),
    )


def _traced(hops: int, edges: int, names: int, hub: int, skip: str) -> str:
    """The guarded search written out hop by hop."""
    parts = ["f0 as (select 'f13' as name)"]
    for k in range(1, hops + 1):
        before = " + ".join(["0", *(f"(select count(*) from h{j})" for j in range(1, k))])
        parts.append(f"h{k} as (select {k}::int as hop, caller, path, line, callee, text from sites where callee in (from f{k - 1}) order by path, line, callee, caller, text limit (select greatest(0, {edges} - ({before}))))")
        hubs = " union all ".join(f"select callee from h{j} group by callee having count(*) >= {hub}" for j in range(1, k + 1))
        visited = "".join(f" and not exists (select 1 from h{j} v where v.caller = h{k}.caller and v.path = h{k}.path)" for j in range(1, k))
        parts.append(f"f{k} as (select distinct string_split(caller, '.')[2] as name from h{k} where caller <> '<top-level>'{visited} and string_split(caller, '.')[2] <> '{skip}' and string_split(caller, '.')[2] not in ({hubs}) order by 1 limit {names})")
    return f"with {SITES}, " + ", ".join(parts) + " " + " union all ".join(f"select hop, caller, path, line, callee, text from h{k}" for k in range(1, hops + 1))


@query(_traced(3, 1500, 50, 200, "f26"))
def callers_traced(spark, sf):
    """Three hops from f13 with all guards on."""
    return trace.callers(sites_of(spark, sf), "T0.f13", 3, max_edges=1500, skip=("f26",)).frame(spark)


_COUNTS = " union all ".join(f"select '{k}' as field, {v} as key, count(*) as n from sites group by 2" for k, v in {"args": "coalesce(args::varchar, '?')", "caller": "caller", "receiver": "coalesce(receiver, '<none>')", "path": "path", "file": "string_split(path, '/')[-1]"}.items())


@query(f"with {SITES} {_COUNTS}")
def sites_counted(spark, sf):
    """Call sites counted by each field that they can be counted by."""
    sites = sites_of(spark, sf)
    out = None
    for name in ("args", "caller", "receiver", "path", "file"):
        one = trace.count_by(sites, name).select(F.lit(name).alias("field"), "key", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {SITES} select path, line, caller, callee from sites where args = 3 and receiver = 'self' and contains(path, 'd0/') and contains(path, 'm1') and contains(text, '1(')")
def sites_filtered(spark, sf):
    return trace.filtered(sites_of(spark, sf), "args:3 prefix:self path:d0\\ file:m1 text:1(").select("path", "line", "caller", "callee")


_SPECIFIC = "case when receiver is null or trim(receiver) = '' then 2 when trim(trim(receiver), '&*()') in ('this', '$this', 'self', 'Self', 'static', 'parent', 'super') then 1 else 0 end"


@query(f"""with {SITES}, t as (select distinct path, line, caller, receiver, line > min(line) over (partition by path, caller) as repeated, {_SPECIFIC} as specific from sites where callee = 'f13')
    select path, line, caller, receiver, repeated, specific from t order by path <> 'd3/m10.rs', caller = '<top-level>', repeated, specific, len(string_split(path, '/')), path, line, caller, receiver nulls first limit 200""")
def sites_ranked(spark, sf):
    """The first page of call sites of f13, with one file as context."""
    found = trace.repeated(sites_of(spark, sf).filter("callee = 'f13'")).select("path", "line", "caller", "receiver", "repeated").distinct().withColumn("specific", code.receiver_rank(F.col("receiver")))
    return search.paged(found, [*trace.order("d3/m10.rs"), F.col("caller"), F.col("receiver").asc_nulls_first()], 200)


@query(f"""with {SITES}, h(callee) as (values ('f13'), ('f26'), ('f39')), e as (select 1 as hop, path from sites where callee = 'f13' union all select 2, path from sites where callee = 'f26' and starts_with(path, 'd5/') union all select 3, path from sites where callee = 'f39'),
    d as (select hop, regexp_replace(path, '/[^/]*$', '') as dir from e), t as (select hop, count(*) as total, count(*) filter (where exists (select 1 from d p where p.hop = d.hop - 1 and p.dir = d.dir)) as related from d group by hop)
    select hop::int as hop, total, related from t where hop >= 2 and total >= 50 and related * 5 < total and exists (select 1 from d where d.hop = t.hop - 1)""")
def hops_in_doubt(spark, sf):
    """Of three hops those whose call sites are mostly far from the ones of the hop before; the second is in one folder only."""
    sites = sites_of(spark, sf)
    one = lambda hop, callee: sites.filter(F.col("callee") == callee).select(F.lit(hop).alias("hop"), "path")
    return trace.suspicious_hops(one(1, "f13").unionByName(one(2, "f26").filter(F.startswith("path", F.lit("d5/")))).unionByName(one(3, "f39")))


@query(f"""with {SITES}, s as (select * from sites where callee <> 'f13' or path = 'd1/m1.rs'), f as (select * from s where callee = 'f13'), names as (select distinct regexp_extract(caller, '([^.]*)$', 1) as n from f where caller <> '<top-level>'),
    ok as (select count(distinct caller) between 1 and 10 as few from f where caller <> '<top-level>'), h as (select s.* from s, ok where few and callee in (from names) and not exists (select 1 from f where f.path = s.path and f.line = s.line)),
    k as (select *, row_number() over (partition by caller, path order by line, callee, receiver nulls first, args nulls first) as k from h) select path, line, caller, callee from k where k = 1 order by path, line, caller limit 15""")
def impact_second_hop(spark, sf):
    """The second hop from f13, which one file alone calls."""
    sites = sites_of(spark, sf).filter("callee <> 'f13' or path = 'd1/m1.rs'")
    return trace.second_hop(sites, "f13").select("path", "line", "caller", "callee")


@query("""with recursive links as (select p_partkey as src, (p_partkey * 7 + p_size) % 2500 as dst from part), inc as (select dst, count(*) as n, min(src) as src from links group by dst),
    walk as (select distinct dst as node, dst as "at", 0 as hops, [dst] as seen, true as good, true as moved from links
        union all select node, coalesce(inc.src, "at"), hops + (inc.n is not null)::int, case when inc.n is null then seen else list_append(seen, inc.src) end, good and (inc.n is null or (inc.n = 1 and not list_contains(seen, inc.src))), inc.n is not null from walk left join inc on inc.dst = "at" where moved and good and hops < 3)
    select node, arg_max("at", hops) as start, max(hops) as hops from walk group by node having bool_and(good)""")
def unique_predecessors(spark, sf):
    part = adapters.table(spark, sf, "part")
    return trace.unique_predecessors(part.select(F.col("p_partkey").cast("long").alias("src"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 2500).cast("long").alias("dst")))


# --- imports -------------------------------------------------------------------------------------------------------

IMPORTS = (
    ("javascript", "./index"), ("javascript", "../handle"), ("tsx", "./auth.test"), ("javascript", "./widget.spec.js"), ("typescript", "./index.js"), ("typescript", "react"), ("javascript", "@/x"), ("rust", "crate::search::Search"), ("rust", "self::search"), ("rust", "super::search::x"),
    ("rust", "std::fs"), ("rust", "serde::Value"), ("python", ".handle_auth"), ("python", "..api.handle_auth"), ("python", "os.path"), ("python", "numpy"), ("c", '"search.rs"'), ("c", "<stdio.h>"), ("cpp", '"none.h"'), ("scss", "style"), ("scss", "./style.scss?v=1"),
    ("markdown", "README"), ("markdown", "../../README.md#a"), ("markdown", "guide"), ("markdown", "https://example.org/x"), ("markdown", "."), ("java", "java.util.List"), ("java", "javax.Y"), ("kotlin", "kotlin.io"), ("scala", "scala.Z"), ("go", "fmt"),
)
_JS_EXT = "['.ts', '.tsx', '.js', '.jsx', '.mts', '.cts', '.mjs', '.cjs']"
_JS_ALL = f"{{b}} || list_transform({_JS_EXT}, lambda x: {{p}} || x) || list_transform({_JS_EXT}, lambda x: {{p}} || '/index' || x)"
#: What each import could mean, written out; up is the folder above.
_TRIES = {
    "./index": _JS_ALL.format(b="[dir || '/index']", p="dir || '/index'"), "../handle": _JS_ALL.format(b="[up || '/handle']", p="up || '/handle'"), "./auth.test": _JS_ALL.format(b="[dir || '/auth.test']", p="dir || '/auth.test'"),
    "./widget.spec.js": "[dir || '/widget.spec.js', dir || '/widget.spec.ts']", "./index.js": "[dir || '/index.js', dir || '/index.ts', dir || '/index.tsx']", "crate::search::Search": "case when regexp_matches(dir, '(^|/)src(/|$)') then [regexp_extract(dir, '^(.*/)?src', 0) || '/search/Search.rs', regexp_extract(dir, '^(.*/)?src', 0) || '/search.rs'] end",
    "self::search": "[dir || '/search.rs', dir || '/search/mod.rs']", "super::search::x": "[up || '/search/x.rs', up || '/search.rs', up || '/search/mod.rs']", ".handle_auth": "[dir || '/handle_auth.py']", "..api.handle_auth": "[up || '/api/handle_auth.py']",
    '"search.rs"': "list_transform(range(1, len(string_split(dir, '/')) + 1), lambda k: array_to_string(string_split(dir, '/')[:k], '/') || '/search.rs')", "style": "[dir || '/style.scss']", "./style.scss?v=1": "[dir || '/style.scss']", "README": "[dir || '/README.md']",
    "../../README.md#a": "case when len(string_split(dir, '/')) >= 2 then [array_to_string(string_split(dir, '/')[:-3], '/') || '/README.md'] end", "guide": "[dir || '/guide', dir || '/guide.md', dir || '/guide.mdx', dir || '/guide.rst']", ".": "[dir || '/README.md']",
}
_PAIRS = ", ".join("('" + k + "', '" + s.replace("'", "''") + "')" for k, s in IMPORTS)
_CASES = " ".join(f"when '{k}' then {v}" for k, v in _TRIES.items())
RESOLVED = CODE + f""", meant(language, source) as (values {_PAIRS}), folders as (select distinct dir, array_to_string(string_split(dir, '/')[:-2], '/') as up from code_files),
    tries as (select dir, language, source, generate_subscripts(c, 1) as k, unnest(c) as path from (select *, case source {_CASES} end as c from folders, meant)),
    hits as (select t.* from tries t join code_files f on f.path = t.path), best as (select dir, language, source, arg_min(path, k) as target, count(distinct path) as n from hits group by all),
    found as (select f.dir, m.language, m.source, case when m.language not in ('python', 'c', 'cpp') or n = 1 then target end as target from folders f cross join meant m left join best b on b.dir = f.dir and b.language = m.language and b.source = m.source)"""


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    files = code_files(spark, sf).select("path", "dir")
    meant = F.array(*[F.struct(F.lit(k).alias("language"), F.lit(s).alias("source")) for k, s in IMPORTS])
    found = files.select("dir").distinct().select("dir", F.explode(meant).alias("m")).select("dir", "m.*")
    return deps.resolved(found, files)


@query(f"with {RESOLVED} select dir, language, source, target from found")
def imports_resolved(spark, sf):
    """A list of imports in each folder of the tree, and the file that each means there."""
    return _resolved(spark, sf).select("dir", "language", "source", "target")


@query(f"""with {RESOLVED} select dir, source, case when target is not null then 'local' when language = 'rust' and regexp_matches(source, '^(std|core|alloc)::') or language = 'python' and string_split(source, '.')[1] in ({_in(code.PYTHON_STDLIB)})
        or language in ('java', 'kotlin', 'scala') and starts_with(source, 'java.') or language = 'kotlin' and starts_with(source, 'kotlin.') or language = 'scala' and starts_with(source, 'scala.') then 'standard library'
    when case when language in ('markdown', 'scss') then starts_with(source, 'https:') when language = 'rust' then not regexp_matches(source, '^(crate|self|super)::') when language in ('javascript', 'typescript', 'tsx') then not regexp_matches(source, '^(\\.|@/|~/)')
        when language = 'python' then not starts_with(source, '.') when language in ('c', 'cpp') then not starts_with(source, '"') else true end then 'external' else 'unresolved' end as kind from found""")
def imports_classified(spark, sf):
    return deps.classified(_resolved(spark, sf)).select("dir", "source", "kind")


@query(f"""with {CODE}, t as (select path, line, case {_LANG} end as language, regexp_replace(trim(text), ';+$', '') as t from code_lines),
    s as (select path, line, language, case when language = 'rust' then regexp_replace(trim(regexp_extract(t, '^use ([^{{]*)', 1)), '(::)+$', '') when language in ('javascript', 'typescript', 'tsx') then regexp_extract(t, '^(?:import|export) .*from [''"]([^''"]+)', 1)
        when language = 'python' then case when starts_with(t, 'import ') then trim(trim(t[8:]), '"'';') else regexp_extract(t, '^from (\\S+)', 1) end when language = 'go' then trim(regexp_extract(t, '^import\\s(.*)$', 1), '"'' ;') when language = 'java' then regexp_extract(t, '^import\\s+(?:static\\s+)?(\\S+)', 1) end as source from t)
    select path, line, language, source from s where source <> ''""")
def import_lines(spark, sf):
    return deps.imports(code_lines(spark, sf))


@query(f"""with {MATCHES}, n as (select distinct path, def_name as name, starts_with(t, 'pub ') or starts_with(t, 'export ') as strong from matches where is_definition and not (starts_with(def_name, '<') or starts_with(def_name, 'impl ') or length(def_name) = 1)),
    r as (select *, row_number() over (partition by path order by strong desc, strlen(name) desc, name) as rank from n) select path, name, strong, rank from r where rank <= 3""")
def reverse_names(spark, sf):
    """The names of each file that are worth a search for dependents."""
    t = code.trimmed(F.col("text"))
    names = matches_of(spark, sf).filter("is_definition").select("path", F.col("def_name").alias("name"), code.begins(t, ("pub ", "export ")).alias("strong"))
    return deps.reverse_candidates(names, 3)


@query(f"""with {MATCHES}, d as (select distinct path, dir from matches where not is_definition and contains(text, 'handle('))
    select path, dir <> 'g0/src' as elsewhere, contains(path, '.test.') or contains(path, '.spec.') or contains(path, '__tests__/') as is_test, row_number() over (order by dir <> 'g0/src', contains(path, '.test.') or contains(path, '.spec.') or contains(path, '__tests__/'), path) as rank from d order by rank limit 40""")
def dependents_ranked(spark, sf):
    """The first files that call a name defined in g0/src: the folder's own, then others, tests after the rest."""
    from pyspark.sql import Window

    found = matches_of(spark, sf).filter(~F.col("is_definition") & F.contains("text", F.lit("handle("))).select("path", "dir").distinct()
    order = [F.col("elsewhere"), F.col("is_test"), F.col("path")]
    page = search.paged(found.select("path", (F.col("dir") != "g0/src").alias("elsewhere"), paths.is_test_file(F.col("path")).alias("is_test")), order, 40)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of one page


ALIASES = [("@app/*", ["src/app/*", "lib/*"]), ("@app/core/*", ["core/*"]), ("@app/core/main", ["core/entry"]), ("*/odd", ["x"]), ("~*", ["home/*"])]


@query("""with s as (select p_partkey, (['@app/' || p_size, '@app/core/' || p_size, '@app/core/main', 'a/odd', '@app/odd', '~' || p_brand, 'react', '@ap'])[p_partkey % 8 + 1] as specifier from part)
    select p_partkey, specifier, case when specifier = '@app/core/main' then 'match' when ends_with(specifier, '/odd') then 'abstain' when starts_with(specifier, '@app/') or starts_with(specifier, '~') then 'match' else 'none' end as match,
        case when specifier = '@app/core/main' then 'core/entry' when ends_with(specifier, '/odd') then null when starts_with(specifier, '@app/core/') then 'core/' || specifier[11:] when starts_with(specifier, '@app/') then 'src/app/' || specifier[6:] || ' lib/' || specifier[6:] when starts_with(specifier, '~') then 'home/' || specifier[2:] end as targets from s""")
def alias_matches(spark, sf):
    size = F.col("p_size").cast("string")
    forms = F.array(F.concat(F.lit("@app/"), size), F.concat(F.lit("@app/core/"), size), F.lit("@app/core/main"), F.lit("a/odd"), F.lit("@app/odd"), F.concat(F.lit("~"), F.col("p_brand")), F.lit("react"), F.lit("@ap"))
    told = adapters.table(spark, sf, "part").select("p_partkey", F.element_at(forms, (F.col("p_partkey") % 8 + 1).cast("int")).alias("specifier"))
    return deps.alias_match(told, ALIASES).withColumn("targets", F.array_join("targets", " "))


# --- budgets, pages and folders ------------------------------------------------------------------------------------


@query(f"with {MATCHES}, k as (select path, line, text, row_number() over (partition by path order by line) as k, count(*) over (partition by path) as n from matches) select path, line, text, greatest(0, n - 3) as more from k where k <= 3")
def collapsed_matches(spark, sf):
    """The first three matches of each file, and how many more it has."""
    return budget.first_of(matches_of(spark, sf).select("path", "line", "text"), "path", [F.col("line")])


@query(f"""with {CODE}, f as (select path, regexp_extract(path, '^[^/]*/[^/]*', 0) as area, name in ('package-lock.json') or starts_with(name, 'zz_generated') or contains(name, '.generated.') or {_has("content[1:512]", paths.GENERATED_MARKERS)} as generated, {"len(list_filter(string_split(path, '/'), lambda x: x in ('test', 'tests', 'testing') or ends_with(x, '_test.go') or contains(x, '_test.') or contains(x, '.test.') or contains(x, '.spec.'))) > 0"} as is_test, ceil(byte_len / 4)::bigint as tokens from code_files),
    k as (select *, row_number() over (partition by area order by generated, is_test, tokens desc, path) as k from f), a as (select * from k where k = 1 order by area limit 8), r as (select * from k where k > 1 order by generated, is_test, tokens desc, path limit (8 - (select count(*) from a)))
    select area, path, tokens from a union all select area, path, tokens from r""")
def orientation_files(spark, sf):
    """Eight files to begin with: the best of each area, then the best of all."""
    files = code_files(spark, sf)
    told = files.select(F.regexp_extract("path", "^[^/]*/[^/]*", 0).alias("area"), "path", paths.is_generated(F.col("name"), F.col("content")).alias("generated"), paths.is_test_path_of_maps(F.col("path")).alias("is_test"), T.estimate_tokens(F.col("content")).alias("tokens"))
    return budget.best_then_fill(told, "area", [F.col("generated"), F.col("is_test"), F.desc("tokens"), F.col("path")]).select("area", "path", "tokens")


@query(f"with {CODE} select regexp_extract(path, '^[^/]*', 0) as top, count(*) as n, case when count(*) > 100 then 2 else 3 end as depth from code_files group by top")
def overview_depths(spark, sf):
    return code_files(spark, sf).groupBy(F.split("path", "/")[0].alias("top")).agg(F.count("*").alias("n")).withColumn("depth", budget.auto_depth(F.col("n")))


@query(f"with {CODE} select dir || '/' as dir, count(*) as n, string_agg(name, ' ' order by name) as names from code_files where ext in ('rs', 'py') group by dir")
def files_by_folder(spark, sf):
    """Found files by folder."""
    found = code_files(spark, sf).filter(F.col("ext").isin("rs", "py"))
    return found.groupBy(F.concat("dir", F.lit("/")).alias("dir")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))


@query(f"with {CODE}, hits as (select count(*) as n from code_files where ext = 'zig') select distinct ext from code_files, hits where n = 0 and ext <> '' order by ext limit 10")
def extensions_there(spark, sf):
    """Where no file matches, the extensions that there are."""
    files = code_files(spark, sf).select("ext")
    none = files.agg(F.count_if(F.col("ext") == "zig").alias("n"))
    return files.filter("ext <> ''").distinct().orderBy("ext").limit(10).crossJoin(F.broadcast(none)).filter("n = 0").select("ext")  # none is one row


@query(f"""with {CODE}, c as (select path, ext, name, case when ext in ('ts', 'tsx') then 10 when ext in ('rs', 'go', 'py', 'rb', 'java', 'kt', 'scala', 'swift', 'c', 'cpp', 'h', 'cs', 'php') then 9 when ext in ('js', 'jsx', 'mjs', 'cjs') then 7 else 3 end as prio,
    lower(regexp_replace(name, '(.)\\.[^.]*$', '\\1')) as stem from code_files) select stem, path, prio from (select *, row_number() over (partition by stem order by prio desc, path) as k from c) where k = 1""")
def files_by_stem(spark, sf):
    """For each stem the file that a query of that name shows."""
    ext = F.col("ext")
    priority = F.when(ext.isin("ts", "tsx"), 10).when(ext.isin("rs", "go", "py", "rb", "java", "kt", "scala", "swift", "c", "cpp", "h", "cs", "php"), 9).when(ext.isin("js", "jsx", "mjs", "cjs"), 7).otherwise(3)
    files = code_files(spark, sf).select(F.lower(paths.stem(F.col("name"))).alias("stem"), "path", priority.alias("prio"))
    return files.groupBy("stem").agg(F.min(F.struct(-F.col("prio"), "path")).alias("b")).select("stem", "b.path", (-F.col("b.col1")).alias("prio"))


@query(f"""with {CODE}, t(term) as (values ('handle'), ('user'), ('token')), h as (select path, line, term from code_lines, t where contains(text, term)),
    r as (select path, count(distinct term) as n_terms, count(*) as n_hits, any_value(len(list_filter(string_split(lower(path), '/'), lambda x: x in ('test', 'tests', 'spec', 'specs', '__tests__') or starts_with(x, 'test_') or ends_with(x, '_test') or ends_with(x, '_spec') or contains(x, '_test.') or contains(x, '.test.') or contains(x, '_spec.') or contains(x, '.spec.'))) > 0) as is_test from h group by path)
    select path, n_terms, n_hits, is_test from r order by n_terms desc, is_test, n_hits desc, path limit 8""")
def terms_by_file(spark, sf):
    """The eight files with most terms, tests after others, then most hits."""
    rolled = search.term_rollup(code_lines(spark, sf).select("path", "line", "text"), ["handle", "user", "token"]).withColumn("is_test", paths.is_test_path_of_terms(F.col("path")))
    return search.paged(rolled, [F.desc("n_terms"), F.col("is_test"), F.desc("n_hits"), F.col("path")], 8)


@query(f"""with {CODE}, d as (select distinct dir from code_files), p as (select dir, regexp_extract(dir, '^[^/]*', 0) as top from d), b as (select top, list(dir order by dir) as l from p group by top)
    select top, len(list_filter(l, lambda x: len(list_filter(l, lambda y: x <> y and starts_with(y, x || '/'))) > 0)) > 0 as overlap, top as common from b where len(l) > 1
    union all select top, false, l[1] from b where len(l) = 1""")
def scopes_in_common(spark, sf):
    """For each top folder the folder that all of its folders share, and whether one of them is within another."""
    folders = code_files(spark, sf).select(F.split("path", "/")[0].alias("top"), "dir").distinct()
    held = folders.groupBy("top").agg(F.array_sort(F.collect_list("dir")).alias("l"))
    # Sorted, a folder comes before what is in it; some neighbour shows an overlap unless a name between sorts into it, so each is asked for its ancestors.
    above = F.exists("l", lambda x: F.exists(paths.ancestors(x), lambda a: (a != x) & (a != "") & F.array_contains("l", a)))
    return held.select("top", above.alias("overlap"), paths.common_folder(F.col("l")).alias("common"))
