"""Smaller queries on the source tree: style sheets, bundles, related files, folders' relations, and what is offered next."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import code, paths, styles
from corvane.operators import budget, documents, search, trace
from corvane.operators import dependencies as deps
from corvane.plans.code import MATCHES, _in, matches_of
from corvane.plans.navigation import RESOLVED, SITES, _resolved, sites_of
from corvane.plans.registry import query
from corvane.plans.samples import CODE, code_files, code_lines, pick
from corvane.plans.syntax import PARTS, python_files
from corvane.operators import syntax as S
from corvane.sources import adapters

SELECTORS = (".btn", "#main .btn:hover", "a.btn-big", "div > .a.b", "@keyframes spin", "$accent", "@media print", "--gap", "nav#top", "btn", "@keyframes btn slow", "$btn", "@btn", ".é")


@query(f"""with s as (select p_partkey, ([{_in(SELECTORS)}])[p_partkey % {len(SELECTORS)} + 1] as name from part)
    select p_partkey, name, name = 'btn' or len(list_filter(regexp_extract_all(name, '[.#][A-Za-z0-9_\\-\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x = 'btn' or x[2:] = 'btn')) > 0 as selector, name = 'btn' or regexp_replace(name, '^[$@]+', '') = 'btn' as variable,
        name = 'btn' or regexp_extract(name, '^@keyframes (\\S+)', 1) = 'btn' as at_rule from s""")
def style_names(spark, sf):
    name = F.col("name")
    told = adapters.table(spark, sf, "part").select("p_partkey", pick(SELECTORS, F.col("p_partkey") % len(SELECTORS)).alias("name"))
    return told.select("p_partkey", "name", styles.selector_matches(name, "btn").alias("selector"), styles.variable_matches(name, "btn").alias("variable"), styles.at_rule_matches(name, "btn").alias("at_rule"))


SHEETS = ('@import "theme.css";\n.a { background: url(img/x.png) }', "@use 'tokens';\n@forward \"all\";\n@import url(\"far.css\");", "/* url(no.png) */ .b { src: url( 'f.woff' ), url(img/x.png) url(img/x.png) }", ".c { color: red }")
_SHEETS = "[" + ", ".join("'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for s in SHEETS) + "]"


@query("""with t(k, ord, source) as (values (0, 0, 'theme.css'), (0, 1, 'img/x.png'), (1, 0, 'tokens'), (1, 1, 'all'), (1, 2, 'far.css'), (2, 0, 'f.woff'), (2, 1, 'img/x.png')) select doc_id, ord, t.source from documents join t on k = doc_id % 4""")
def style_sources(spark, sf):
    d = F.col("doc_id")
    sheets = adapters.table(spark, sf, "documents").select("doc_id", pick(SHEETS, d % 4).alias("content"))
    return sheets.select("doc_id", F.posexplode(styles.sources(F.col("content"))).alias("ord", "source"))


KINDS = ("function_item", "class", "impl_item", "label", "const_item", "module", "variable_declaration", "export_statement", "anything", "method")


@query(f"""select doc_id, ([{_in(KINDS)}])[doc_id % 10 + 1] as kind, ([100, 100, 90, 90, 80, 70, 40, 30, 50, 100])[doc_id % 10 + 1] as weight from documents""")
def definition_weights(spark, sf):
    return adapters.table(spark, sf, "documents").select("doc_id", pick(KINDS, F.col("doc_id") % 10).alias("kind")).withColumn("weight", code.definition_weight(F.col("kind")))


@query("""select p_partkey, case p_size % 4 when 0 then p_partkey end as first, case p_size % 4 when 0 then p_partkey + p_size end as last from part""")
def byte_ranges(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    word = F.concat(F.when(size % 4 == 1, "byte:").otherwise("bytes:"), key.cast("string"), F.when(size % 4 == 2, "+").otherwise("-"), F.when(size % 4 == 3, "x").otherwise((key + size).cast("string")))
    return adapters.table(spark, sf, "part").select("p_partkey", paths.byte_range(word).alias("r")).select("p_partkey", "r.first", "r.last")


@query(f"""with {CODE}, e as (select path, line, regexp_extract(text, '^ *export (?:default function |function |class |const |let |var )([A-Za-z0-9_$]+)', 1) as name from code_lines) select path, 'export' as kind, name, min(line) as line, count(*) as n from e where name <> '' group by path, name""")
def bundle_anchors(spark, sf):
    return deps.anchors(code_lines(spark, sf).select("path", "line", "text"))


@query(f"""with {RESOLVED}, e as (select distinct dir, target, array_to_string(string_split(dir, '/')[1:2], '/') as src, array_to_string(string_split(target, '/')[1:least(2, len(string_split(target, '/')) - 1)], '/') as dst from found where target is not null)
    select src, dst, count(*) as n, min(dir) as source from e where src <> dst group by src, dst""")
def folder_relations(spark, sf):
    """Imports between the first two folders of the tree."""
    edges = _resolved(spark, sf).filter("target is not null").select("dir", "target").distinct()
    keyed = edges.select(paths.relation_key(F.concat("dir", F.lit("/x"))).alias("src"), paths.relation_key(F.col("target")).alias("dst"), "dir")
    return keyed.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("dir").alias("source"))


@query(f"""with {RESOLVED}, f as (select dir, target, min(struct_pack(a := not starts_with(source, '.'), s := source)) as first from found where target is not null group by dir, target) select dir, target, first.s as source, rank from (select *, row_number() over (partition by dir order by first, target) as rank from f) where rank <= 3""")
def related_files(spark, sf):
    return deps.related_files(_resolved(spark, sf).withColumn("line", F.lit(1)), 3)


@query(f"""with {RESOLVED}, p as (select distinct dir || '/main.go' as source, target from found where target is not null), n as (select *, case when target = source then 0 when regexp_replace(target, '/[^/]*$', '') = regexp_replace(source, '/[^/]*$', '') then 1 else 2 end as near from p)
    select source, target, near, row_number() over (partition by source order by near, target) as rank from n""")
def targets_by_nearness(spark, sf):
    from pyspark.sql import Window

    pairs = _resolved(spark, sf).filter("target is not null").select(F.concat("dir", F.lit("/main.go")).alias("source"), "target").distinct()
    near = pairs.withColumn("near", deps.nearness(F.col("target"), F.col("source")))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("near", "target")))


@query(f"""with {CODE}, c as (select name, path from code_files where not list_has_any(string_split(path, '/'), [{_in(paths.NON_PRODUCTION)}])) select name, count(*) as n, case when count(*) = 1 then min(path) end as path from c group by name""")
def production_files(spark, sf):
    """For each name the one production file that has it; none where several do."""
    kept = code_files(spark, sf).filter(paths.is_production(F.col("path"))).select("name", "path")
    return kept.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("p")).select("name", "n", F.when(F.col("n") == 1, F.col("p")).alias("path"))


@query(f"""with {MATCHES}, d as (select path, line, line + 5 as last, row_number() over (partition by ext order by path, line) as k, ext from (select distinct ext, path, line from matches where is_definition)) select ext, path, line, last from d where k <= 3""")
def offered_targets(spark, sf):
    """The first three definitions of each kind of file, as ranges to read on."""
    found = matches_of(spark, sf).filter("is_definition").select("ext", "path", "line", (F.col("line") + 5).alias("last")).distinct()
    return budget.first_of(found, "ext", [F.col("path"), F.col("line")]).drop("more")


@query(f"with {SITES} select path, caller, line, receiver, args, min(text) as text, count(*) as n from sites where callee = 'f39' group by path, caller, line, receiver, args")
def site_groups(spark, sf):
    """Call sites that differ in nothing but their text as one."""
    return sites_of(spark, sf).filter("callee = 'f39'").groupBy("path", "caller", "line", "receiver", "args").agg(F.min("text").alias("text"), F.count("*").alias("n"))


@query(f"with {PARTS} select path, line, callee, args from sites where callee = 'parse' and starts_with(path, 'py/m1')")
def callees_filtered(spark, sf):
    found = S.calls(python_files(spark, sf)).filter("callee = 'parse'").filter(F.startswith("path", F.lit("py/m1")))
    return found.select("path", "line", "callee", "args")


@query(f"""with {CODE}, a as (select string_split(path, '/') as s from code_files), p as (select unnest(range(1, 4)) as depth), n as (select depth, count(distinct array_to_string(s[1:least(depth, len(s) - 1)], '/')) as folders from a, p group by depth)
    select max(depth)::int as depth, max(folders) as folders from n where folders <= 20""")
def overview_that_fits(spark, sf):
    """The largest depth to which an overview has at most 20 folders."""
    at = F.split("path", "/")
    keyed = code_files(spark, sf).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(at, F.lit(1), F.least(d, F.size(at) - 1)), "/").alias("folder")))).alias("k")).select("k.*")
    return keyed.groupBy("depth").agg(F.count_distinct("folder").alias("folders")).filter("folders <= 20").agg(F.max("depth").alias("depth"), F.max("folders").alias("folders"))


TOMLS = ('title = "x"\n[a]\nb = 1\n[a.c]\nd = [1, 2]\n[a.c.e]\nf = true', 'k = "' + "v" * 60 + '"\nn = 2.5', "bad = ")


@query("""with t(k, ord, depth, key, value) as (values (0, 1, 0, 'title', '"x"'), (0, 2, 0, 'a', null), (0, 3, 1, 'b', '1'), (0, 4, 1, 'c', null), (0, 5, 2, 'd', '[2 items]'), (0, 6, 2, 'e', '{1 keys}'), (1, 1, 0, 'k', '"' || repeat('v', 36) || '...'), (1, 2, 0, 'n', '2.5'))
    select 'f' || doc_id as path, ord, depth, key, value from documents join t on k = doc_id % 3""")
def toml_keys(spark, sf):
    files = adapters.table(spark, sf, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), pick(TOMLS, F.col("doc_id") % 3).alias("content"))
    return documents.data_keys(files).filter("key is not null")


@query()
def covering_windows(spark, sf):
    """Up to three windows of each file that cover its terms; the choice is greedy, so no SQL."""
    return search.covering_windows(code_lines(spark, sf).select("path", "line", "text"), ["handle", "user", "token"], gap=3, span=12)
