"""Queries over the test tables, by name, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

from corvane.functions import text as T
from corvane.operators import graph, rank, search, spans
from corvane.plans import registry
from corvane.plans.registry import Query, query
from corvane.sources import adapters

TERMS = ["the", "of the", "que", "und"]

FILES = """files as (
    select concat_ws('/', source, lang, 'doc_' || doc_id || '.txt') as path, concat_ws('/', source, lang) as dir, 'doc_' || doc_id || '.txt' as name, text as content, strlen(text) as byte_len from documents
)"""
LINES = FILES + """, split as (select path, string_split(regexp_replace(content, '\\r?\\n$', ''), chr(10)) as l from files),
lines as (select path, unnest(range(1, len(l) + 1))::int as line, unnest(l) as text from split)"""
TERM_HITS = LINES + ", terms(term) as (values " + ", ".join(f"('{t}')" for t in TERMS) + "), hits as (select path, line, text, term from lines, terms where contains(text, term))"
CALLS = """calls as (
    select o_orderpriority as path, l_orderkey as line, c_nationkey as caller, s_nationkey as callee, nullif(c_mktsegment, 'MACHINERY') as receiver, l_linenumber as args
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
)"""
#: A sparse graph with as many nodes as customers: each order is an edge.
EDGES = "edges as (select o_custkey as src, o_orderkey // 10 as dst, count(*) as n from orders group by 1, 2)"


def files_of(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.document_files(adapters.table(spark, sf, "documents"))


def lines_of(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.lines(files_of(spark, sf))


def edges_of(spark: SparkSession, sf: str) -> DataFrame:
    orders = adapters.table(spark, sf, "orders")
    return adapters.call_graph(orders.select(F.col("o_custkey").alias("caller"), F.floor(F.col("o_orderkey") / 10).alias("callee")))


# --- search over lines ---------------------------------------------------------------------------------------------


@query("with " + LINES + """ select path, line, text, 100 + case when starts_with(text, 'The') then 40 else 0 end - case when length(text) > 400 then 30 else 0 end as score
    from lines where contains(text, 'of the') order by score desc, path, line limit 50""")
def discover_text_literal(spark, sf):
    score = F.lit(100) + F.when(F.startswith("text", F.lit("The")), 40).otherwise(0) - F.when(F.length("text") > 400, 30).otherwise(0)
    found = search.literal(lines_of(spark, sf), "of the").withColumn("score", score)
    return search.paged(found, [F.desc("score"), F.col("path"), F.col("line")], 50)


@query("with " + LINES + r""" select path, line, text from lines where regexp_matches(text, '(^|[^\p{L}\p{M}\p{N}_])en([^\p{L}\p{M}\p{N}_]|$)')""")
def discover_text_word(spark, sf):
    return search.usages(lines_of(spark, sf), "en")


@query("with " + LINES + """ select path, line, text from lines where strpos(text, 'the') > 0 and strpos(substr(text, strpos(text, 'the') + 3), 'and') > 0""")
def discover_cooccurrence_line(spark, sf):
    return search.cooccurrence(lines_of(spark, sf), "the", "and")


@query("with " + LINES + """, h as (select path, line, text, term from lines, (values ('the'), ('of'), ('and')) t(term) where contains(text, term)),
    f as (select path from h group by path having count(distinct term) = 3) select distinct path, line, text from h where path in (select path from f)""")
def discover_match_all(spark, sf):
    return search.match_all(lines_of(spark, sf), ["the", "of", "and"])


@query("with " + TERM_HITS + " select term, count(*) as total, count(distinct path) as files, greatest(0, count(*) - 10) as omitted from hits group by term")
def text_or_term_stats(spark, sf):
    return search.term_stats(lines_of(spark, sf), TERMS, 10)


@query("with " + TERM_HITS + " select path, count(distinct term) as n_terms, count(*) as n_hits from hits group by path")
def discover_text_or_rollup(spark, sf):
    return search.term_rollup(lines_of(spark, sf), TERMS)


@query("with " + TERM_HITS + " select * from (select term, path, line, row_number() over (partition by term order by path, line) as rank from hits) where rank <= 10")
def text_or_top_per_term(spark, sf):
    return search.top_per_term(lines_of(spark, sf), TERMS, 10)


@query("with " + TERM_HITS + """, e as (select count(distinct path) as eligible from lines)
    select term, count(*) as total, count(distinct path) as files, any_value(eligible) as eligible from hits, e group by term having count(*) >= 400 and count(distinct path) >= 150 and count(distinct path) * 1000 >= any_value(eligible) * 15""")
def low_signal_terms(spark, sf):
    return search.low_signal(lines_of(spark, sf), TERMS)


@query("with " + LINES + r""", t as (select distinct path, line, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as spelling from lines),
    s as (select spelling, min(struct_pack(path := path, line := line)) as f from t group by spelling)
    select spelling, levenshtein(replace(lower(spelling), '_', ''), 'thing') as distance, f.path as path, f.line as line from s
    where levenshtein(replace(lower(spelling), '_', ''), 'thing') <= 1 and spelling <> 'thing'""")
def did_you_mean(spark, sf):
    return search.suggest(lines_of(spark, sf), "thing")


@query("with " + LINES + """, m as (select path, line, text, contains(text, 'Erreth') as hit from lines)
    select path, line, text, hit from (select *, max(hit) over (partition by path order by line rows between 2 preceding and 2 following) as near from m) where near""")
def context_lines(spark, sf):
    return search.context(lines_of(spark, sf), "Erreth", 2)


@query("with recursive " + LINES + """, h as (select path, line, row_number() over (partition by path order by line) as k from lines where contains(text, 'the')),
    w as (select path, k, line, line as first, 1 as win from h where k = 1
        union all select h.path, h.k, h.line, case when h.line - w.line <= 3 and h.line - w.first + 1 <= 9 then w.first else h.line end, case when h.line - w.line <= 3 and h.line - w.first + 1 <= 9 then w.win else w.win + 1 end
        from w join h on h.path = w.path and h.k = w.k + 1)
    select path, min(first) as first_line, max(line) as last_line, count(*) as n_hits from w group by path, win""")
def hit_windows(spark, sf):
    return search.hit_windows(search.literal(lines_of(spark, sf), "the"), gap=3, span=9)


@query("with " + LINES + """ select path, line, text, bytes from (select *, sum(strlen(text) + 1) over (partition by path order by line) as bytes from lines) where bytes <= (600 - 50) * 4""")
def token_budget_prefix(spark, sf):
    return search.token_budget(lines_of(spark, sf), 600)


@query("with " + LINES + """ select path, line, text from lines where line <= 2""")
def head_preview(spark, sf):
    return lines_of(spark, sf).filter("line <= 2")


@query("with " + TERM_HITS + """, n as (select *, count(*) over (partition by term) as total, row_number() over (partition by term order by path, line) as rank from hits)
    select term, path, line, total, rank from n where total <= 10 or rank <= 3""")
def multi_symbol_batch(spark, sf):
    from pyspark.sql import Window

    hits = search.term_hits(lines_of(spark, sf), TERMS).select("term", "path", "line")
    counted = hits.withColumn("total", F.count("*").over(Window.partitionBy("term"))).withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy("path", "line")))
    return counted.filter("total <= 10 or rank <= 3")


@query("with " + LINES + """ select distinct path, line, text from lines where (starts_with(path, 'src1/') or starts_with(path, 'src1')) and contains(text, 'was')""")
def multi_scope_union(spark, sf):
    found = search.literal(lines_of(spark, sf), "was")
    return found.filter(F.startswith("path", F.lit("src1/"))).unionByName(found.filter(F.startswith("path", F.lit("src1")))).dropDuplicates(["path", "line", "text"])


@query("with " + LINES + """, a as (select path, line, 1 as stage from lines where starts_with(text, 'zzzz')), b as (select path, line, 2 as stage from lines where contains(text, 'hehe')),
    u as (select * from a union all select * from b) select path, line, stage from u where stage = (select min(stage) from u)""")
def fallback_cascade(spark, sf):
    lines = lines_of(spark, sf)
    staged = lines.filter(F.startswith("text", F.lit("zzzz"))).select("path", "line", F.lit(1).alias("stage")).union(search.literal(lines, "hehe").select("path", "line", F.lit(2).alias("stage")))
    first = staged.agg(F.min("stage").alias("first"))
    return staged.join(F.broadcast(first), F.col("stage") == F.col("first")).select("path", "line", "stage")  # first is one row


# --- files and scalars ---------------------------------------------------------------------------------------------


@query("with " + FILES + """ select path, byte_len from files where contains(path, 'src1/en') order by path limit 20""")
def path_fragment(spark, sf):
    found = files_of(spark, sf).filter(T.path_contains(F.col("path"), "src1/en")).select("path", "byte_len", "depth")
    return search.paged(found, [F.col("depth"), F.col("path")], 20).drop("depth")


@query("with " + FILES + """ select path, byte_len from files where (regexp_full_match(name, 'doc_1.*[.]txt') or regexp_full_match(path, 'doc_1.*[.]txt')) and not regexp_full_match(path, '.*/fr/.*')""")
def path_glob(spark, sf):
    wanted, not_wanted = T.glob_regex("doc_1*.txt"), T.glob_regex("*/fr/*")
    return files_of(spark, sf).filter((F.col("name").rlike(wanted) | F.col("path").rlike(wanted)) & ~F.col("path").rlike(not_wanted)).select("path", "byte_len")


@query("with " + LINES + """ select path, line, text from lines where contains(path, '/de/') and contains(text, 'und') and line between 2 and 5""")
def filter_qualifiers(spark, sf):
    return lines_of(spark, sf).filter(T.path_contains(F.col("path"), "\\de\\") & F.contains("text", F.lit("und")) & F.col("line").between(2, 5))


@query("with " + FILES + """ select path, ceil(byte_len / 4)::bigint as tokens, greatest(1, byte_len // 40)::bigint as est_lines, levenshtein(name, 'doc_42.txt') as distance,
    case when byte_len < 1024 then byte_len || 'B' when byte_len < 1048576 then (byte_len // 1024) || 'KB' else (byte_len // 1048576) || '.' || ((byte_len % 1048576) * 10 // 1048576) || 'MB' end as size_text from files""")
def file_scalars(spark, sf):
    n = F.col("byte_len")
    return files_of(spark, sf).select("path", T.estimate_tokens(F.col("content")).alias("tokens"), F.greatest(F.lit(1), F.floor(n / 40)).cast("long").alias("est_lines"), T.edit_distance(F.col("name"), F.lit("doc_42.txt")).alias("distance"), T.format_size(n).alias("size_text"))


@query("with " + FILES + """, p as (select dir, byte_len, unnest([string_split(dir, '/')[1], dir]) as prefix from files) select prefix, sum(ceil(byte_len / 4))::bigint as tokens, count(*) as n_files from p group by prefix""")
def dir_rollup(spark, sf):
    parts = F.split("dir", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return files_of(spark, sf).select(F.explode(prefixes).alias("prefix"), T.estimate_tokens(F.col("content")).alias("t")).groupBy("prefix").agg(F.sum("t").alias("tokens"), F.count("*").alias("n_files"))


@query("with " + FILES + """ select dir, path, tokens from (select dir, path, ceil(byte_len / 4)::bigint as tokens, row_number() over (partition by dir order by ceil(byte_len / 4) desc, path) as k from files) where k = 1""")
def nav_candidates(spark, sf):
    files = files_of(spark, sf).select("dir", "path", T.estimate_tokens(F.col("content")).alias("tokens"))
    return files.groupBy("dir").agg(F.min(F.struct((-F.col("tokens")).alias("t"), "path")).alias("b")).select("dir", "b.path", (-F.col("b.t")).alias("tokens"))


# --- pages and documents -------------------------------------------------------------------------------------------


@query(r"""with l as (select page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) as href from pages)
    select page_id, href, case when starts_with(trim(href), '/') or (regexp_matches(trim(href), '^[A-Za-z][A-Za-z0-9+.-]+:') and not regexp_matches(lower(trim(href)), '^(data|javascript|mailto|tel):')) then 'external' else 'local' end as kind, count(*) as n from l group by all""")
def html_links(spark, sf):
    found = adapters.table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return found.groupBy("page_id", "href", F.when(T.is_external_link(F.col("href")), "external").otherwise("local").alias("kind")).agg(F.count("*").alias("n"))


@query(r"""select page_id, trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)', 1)), '[^\p{L}\p{N}]+', '-', 'g'), '-') as slug from pages""")
def slugify(spark, sf):
    return adapters.table(spark, sf, "pages").select("page_id", T.slugify(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("slug"))


@query("select key, count(*) as n from (select unnest(json_keys(props)) as key from events) group by key")
def json_outline(spark, sf):
    return adapters.table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("""with u as (select page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host from pages), p(prefix) as (values ('http'), ('https'), ('https://'), ('http://'))
    select page_id, prefix, host from (select *, row_number() over (partition by page_id order by length(prefix) desc) as k from u join p on starts_with(url, prefix)) where k = 1""")
def alias_longest_prefix(spark, sf):
    prefixes = F.array(*map(F.lit, ("http", "https", "https://", "http://")))
    best = F.array_max(F.transform(F.filter(prefixes, lambda p: F.startswith(F.col("url"), p)), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    return adapters.table(spark, sf, "pages").select("page_id", best["p"].alias("prefix"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).filter("prefix is not null")


@query(r"""with h as (select l_orderkey, l_linenumber, '@@ -' || l_partkey || case when l_linenumber % 2 = 0 then ',' || l_linenumber else '' end || ' +' || l_suppkey || ',7 @@' as header from lineitem)
    select l_orderkey, l_linenumber, regexp_extract(header, '-(\d+)', 1)::bigint as old_start, coalesce(nullif(regexp_extract(header, '-\d+,(\d+)', 1), ''), '1')::bigint as old_lines, regexp_extract(header, '\+(\d+)', 1)::bigint as new_start, coalesce(nullif(regexp_extract(header, '\+\d+,(\d+)', 1), ''), '1')::bigint as new_lines from h""")
def hunk_parse(spark, sf):
    l = adapters.table(spark, sf, "lineitem")  # noqa: E741
    header = F.concat(F.lit("@@ -"), F.col("l_partkey"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(","), F.col("l_linenumber"))).otherwise(""), F.lit(" +"), F.col("l_suppkey"), F.lit(",7 @@"))
    part = lambda pattern: F.regexp_extract("header", pattern, 1)
    count = lambda pattern: F.coalesce(F.nullif(part(pattern), F.lit("")), F.lit("1")).cast("long")
    return l.select("l_orderkey", "l_linenumber", header.alias("header")).select("l_orderkey", "l_linenumber", part(r"-(\d+)").cast("long").alias("old_start"), count(r"-\d+,(\d+)").alias("old_lines"), part(r"\+(\d+)").cast("long").alias("new_start"), count(r"\+\d+,(\d+)").alias("new_lines"))


# --- calls and graphs ----------------------------------------------------------------------------------------------


@query("with " + CALLS + " select coalesce(receiver, '<none>') as receiver, count(*) as n from calls group by 1")
def callers_count_by(spark, sf):
    return adapters.call_sites(spark, sf).groupBy(F.coalesce("receiver", F.lit("<none>")).alias("receiver")).agg(F.count("*").alias("n"))


@query("with " + CALLS + " select path, caller, callee, min(line) as first_line, count(*) as n from calls where callee = 7 and args = 3 group by all")
def callers_filtered(spark, sf):
    found = adapters.call_sites(spark, sf).filter("callee = 7 and args = 3")
    return found.groupBy("path", "caller", "callee").agg(F.min("line").alias("first_line"), F.count("*").alias("n"))


@query("with recursive " + EDGES + """, walk as (select 7 as node, 0 as hop union all select src, hop + 1 from walk join edges on dst = node where hop < 3), dist as (select node, min(hop) as hop from walk group by node)
    select (hop + 1)::int as hop, src, dst from edges join dist on dst = node where hop < 3""")
def callers_bfs(spark, sf):
    return graph.callers_bfs(edges_of(spark, sf).select("src", "dst"), [7], 3)


def _hops(n: int) -> str:
    """Guarded hops, one after the other: a frontier of the first five callers that aren't busy."""
    parts = ["busy as (select dst from edges group by dst having count(*) >= 12)", "f0 as (select 7 as node)"]
    for k in range(1, n + 1):
        parts.append(f"h{k} as (select {k} as hop, src, dst from edges where dst in (from f{k - 1}))")
        seen = " union all ".join(f"select node from f{j}" for j in range(k))
        parts.append(f"f{k} as (select distinct src as node from h{k} where src not in ({seen}) and src not in (from busy) order by 1 limit 5)")
    return "with " + EDGES + ", " + ", ".join(parts) + " " + " union all ".join(f"select hop, src, dst from h{k}" for k in range(1, n + 1))


@query(_hops(4))
def callers_bfs_guarded(spark, sf):
    return graph.callers_bfs(edges_of(spark, sf).select("src", "dst"), [7], 4, max_frontier=5, hub=12)


@query("with " + EDGES + """, f as (select distinct src from edges where dst = 7), n as (select count(*) <= 10 as few from f) select distinct src, dst from edges, n where few and dst in (select src from f) and dst <> 7""")
def callers_second_hop(spark, sf):
    return graph.second_hop(edges_of(spark, sf), 7)


@query("with " + EDGES + """ select a.src, b.dst, min(a.dst) as via from edges a join edges b on a.dst = b.src group by 1, 2 having count(*) = 1""")
def unique_chain(spark, sf):
    return graph.unique_chains(edges_of(spark, sf))


@query("""with d as (select p_brand as name, case p_size % 3 when 0 then 1 when 1 then 2 else 3 end as stage, p_partkey as ord, p_type as path from part)
    select name, stage, ord, path from (select *, row_number() over (partition by name order by stage, ord, path) as k from d) where k = 1""")
def callees_first_match(spark, sf):
    part = adapters.table(spark, sf, "part")
    stage = F.when(F.col("p_size") % 3 == 0, 1).when(F.col("p_size") % 3 == 1, 2).otherwise(3)
    return graph.first_match(part.select(F.col("p_brand").alias("name")).distinct(), part.select(F.col("p_brand").alias("name"), stage.alias("stage"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("path")))


@query("""with l as (select l_partkey, count(*) as l from lineitem where l_returnflag = 'A' group by 1), r as (select l_partkey, count(*) as r from lineitem where l_returnflag = 'R' group by 1)
    select l_partkey, least(coalesce(l, 0), coalesce(r, 0)) as common, greatest(0, coalesce(l, 0) - coalesce(r, 0)) as left_only, greatest(0, coalesce(r, 0) - coalesce(l, 0)) as right_only from l full join r using (l_partkey)""")
def compare_features(spark, sf):
    l = adapters.table(spark, sf, "lineitem").select("l_partkey", "l_returnflag")  # noqa: E741
    return graph.multiset_compare(l.filter("l_returnflag = 'A'"), l.filter("l_returnflag = 'R'"), "l_partkey")


@query("with " + CALLS + " select path, receiver, args, count(*) as n, count(distinct caller) as callers from calls group by grouping sets ((path), (receiver), (args))")
def assess_groups(spark, sf):
    return adapters.call_sites(spark, sf).groupingSets([["path"], ["receiver"], ["args"]], "path", "receiver", "args").agg(F.count("*").alias("n"), F.count_distinct("caller").alias("callers")).select("path", "receiver", "args", "n", "callers")


@query("with " + CALLS + " select caller as src, callee as dst, count(*) as n, min(path) as source_file from calls where caller <> callee group by 1, 2")
def relations(spark, sf):
    calls = adapters.call_sites(spark, sf).filter("caller <> callee")
    return calls.groupBy(F.col("caller").alias("src"), F.col("callee").alias("dst")).agg(F.count("*").alias("n"), F.min("path").alias("source_file"))


@query("with " + CALLS + """, visible as (select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE'))
    select caller as src, callee as dst, count(*) as n from calls where caller in (from visible) and callee not in (from visible) group by 1, 2""")
def outbound_relations(spark, sf):
    nations = adapters.table(spark, sf, "nation").join(adapters.table(spark, sf, "region").filter(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    calls = adapters.call_sites(spark, sf)
    inside = calls.join(nations.select(F.col("n_nationkey").alias("caller")), "caller", "left_semi").join(nations.select(F.col("n_nationkey").alias("callee")), "callee", "left_anti")
    return inside.groupBy(F.col("caller").alias("src"), F.col("callee").alias("dst")).agg(F.count("*").alias("n"))


@query("with " + CALLS + " select path, caller, min(line) as first_line from calls where callee in (3, 5, 8) group by 1, 2")
def reverse_dependents(spark, sf):
    return adapters.call_sites(spark, sf).filter(F.col("callee").isin(3, 5, 8)).groupBy("path", "caller").agg(F.min("line").alias("first_line"))


@query("select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def defs_minus_usages(spark, sf):
    used = adapters.table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return adapters.table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(used, "o_orderkey", "left_anti")


@query("select event_type, count(*) as total, count(distinct user_id) as users, count(*) filter (where value > 50) as high from events group by 1")
def access_counts(spark, sf):
    return adapters.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("total"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("high"))


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by event_type, event_id) as k from events) where k = 1")
def next_actions_dedupe(spark, sf):
    return adapters.table(spark, sf, "events").groupBy("user_id").agg(F.min(F.struct("event_type", "event_id")).alias("b")).select("user_id", "b.event_type", "b.event_id")


# --- intervals -----------------------------------------------------------------------------------------------------

SPANS = """spans as (select l_suppkey as path, l_orderkey * 10 + l_linenumber as id, l_partkey as first, l_partkey + l_linenumber * l_linenumber as last from lineitem),
points as (select distinct l_suppkey as path, l_partkey + 3 as "at" from lineitem)"""


def _spans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    l = adapters.table(spark, sf, "lineitem")  # noqa: E741
    held = l.select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("first"), (F.col("l_partkey") + F.col("l_linenumber") * F.col("l_linenumber")).alias("last"))
    return held, l.select(F.col("l_suppkey").alias("path"), (F.col("l_partkey") + 3).alias("at")).distinct()


@query("with " + SPANS + """, i as (select p.path, "at", id, last - first as size from points p join spans s on p.path = s.path and first <= "at" and "at" <= last),
    r as (select *, rank() over (partition by path, "at" order by size) as k from i) select path, "at", min(id) as owner from r where k = 1 group by path, "at" having count(distinct id) = 1""")
def narrowest_owner(spark, sf):
    held, points = _spans(spark, sf)
    return spans.narrowest_owner(points, held)


@query("with " + SPANS + """, m as (select *, case when max(last) over w is null or first > max(last) over w + 1 then 1 else 0 end as new from spans window w as (partition by path order by first, last, id rows between unbounded preceding and 1 preceding)),
    g as (select *, sum(new) over (partition by path order by first, last, id rows between unbounded preceding and current row) as island from m) select path, min(first) as first, max(last) as last, count(*) as n from g group by path, island""")
def range_merge(spark, sf):
    return spans.merge_ranges(_spans(spark, sf)[0])


@query("with " + SPANS + ' select p.path, "at", max(first) as begin from points p join spans s on p.path = s.path and first <= "at" and "at" <= last group by 1, 2')
def innermost_binding_asof(spark, sf):
    held, points = _spans(spark, sf)
    named = lambda df: df.withColumn("name", F.lit("x"))
    return spans.innermost_binding(named(points), named(held.select("path", F.col("first").alias("begin"), F.col("last").alias("scope_end")))).drop("name")


# --- ranking, counts and folds -------------------------------------------------------------------------------------

def _epoch(ts: Column, kind: DataType) -> Column:
    """Seconds since 1970 as SQL rounds them: through a double to the nearest, halves to the even one. A time without a zone is never taken for one of the session's zone, which may skip or repeat hours."""
    micros = (ts - F.expr("timestamp_ntz '1970-01-01'")).cast("decimal(20, 6)") * 1_000_000 if isinstance(kind, TimestampNTZType) else F.unix_micros(ts.cast("timestamp"))
    return F.rint(micros.cast("long").cast("double") / 1_000_000).cast("long")


@query("""with e as (select event_id, epoch((select max(ts) from events))::bigint - epoch(ts)::bigint as age from events)
    select event_id, case when age <= 3600 then 100 when age <= 86400 then 80 when age <= 604800 then 50 when age <= 2592000 then 20 else 0 end as points from e""")
def recency_points(spark, sf):
    events = adapters.table(spark, sf, "events")
    events = events.select("event_id", _epoch(F.col("ts"), events.schema["ts"].dataType).alias("at"))
    last = events.agg(F.max("at").alias("last"))
    return events.crossJoin(F.broadcast(last)).select("event_id", rank.recency(F.col("last") - F.col("at")).alias("points"))  # last is one row


@query("""with c as (select p_brand || '.' || p_size as callee, count(*) as n, min(p_partkey) as target from part group by 1)
    select callee, n, case when n = 1 then 'edge' else 'ambiguous' end as kind, case when n = 1 then target end as target from c""")
def direct_call_unique(spark, sf):
    part = adapters.table(spark, sf, "part").groupBy(F.concat_ws(".", "p_brand", "p_size").alias("callee")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("target"))
    return part.select("callee", "n", F.when(F.col("n") == 1, "edge").otherwise("ambiguous").alias("kind"), F.when(F.col("n") == 1, F.col("target")).alias("target"))


@query("""with p as (select p_partkey, string_split(p_name, ' ') as a, string_split(p_type, ' ') as b from part)
    select p_partkey, i::int as slot, a[i] as arg, b[i] as param from (select *, unnest(range(1, least(8, greatest(len(a), len(b))) + 1)) as i from p)""")
def arg_param_zip(spark, sf):
    zipped = F.arrays_zip(F.split("p_name", " ").alias("arg"), F.split("p_type", " ").alias("param"))
    part = adapters.table(spark, sf, "part").select("p_partkey", F.slice(zipped, 1, 8).alias("z"))
    return part.select("p_partkey", F.posexplode("z")).select("p_partkey", (F.col("pos") + 1).alias("slot"), F.col("col.arg").alias("arg"), F.col("col.param").alias("param"))


@query("""with recursive i as (select l_orderkey, l_linenumber, l_quantity::bigint as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as k from lineitem),
    w as (select l_orderkey, k, q, case when q <= 60 then q else 0 end as used, case when q <= 60 then 1 else 0 end as taken from i where k = 1
        union all select i.l_orderkey, i.k, i.q, w.used + case when w.used + i.q <= 60 then i.q else 0 end, w.taken + case when w.used + i.q <= 60 then 1 else 0 end from w join i on i.l_orderkey = w.l_orderkey and i.k = w.k + 1)
    select l_orderkey, max(used) as used, max(taken)::bigint as taken from w group by 1""")
def budget_fold(spark, sf):
    """Line items of an order in turn while a budget of 60 lasts; what doesn't fit is skipped and later, smaller ones may still."""
    items = adapters.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("items"))
    fits = lambda acc, x: acc["used"] + x["l_quantity"].cast("long") <= 60
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("taken"))
    step = lambda acc, x: F.struct((acc["used"] + F.when(fits(acc, x), x["l_quantity"].cast("long")).otherwise(0)).alias("used"), (acc["taken"] + F.when(fits(acc, x), 1).otherwise(0)).alias("taken"))
    return items.select("l_orderkey", F.aggregate("items", start, step).alias("r")).select("l_orderkey", "r.used", "r.taken")


def queries() -> dict[str, Query]:
    from corvane.plans import asked, code, details, intervals, navigation, syntax, texts  # noqa: F401  (they register their queries)

    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(registry.SQL)
