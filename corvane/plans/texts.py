"""Queries on queries, on marked-up and data files, and on how text is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import display
from corvane.functions import queries as Q
from corvane.functions import text as T
from corvane.operators import documents as D
from corvane.plans.code import _in
from corvane.plans.registry import query
from corvane.plans.samples import CODE, code_files, code_lines, pick
from corvane.sources import adapters

# --- queries -------------------------------------------------------------------------------------------------------

#: Forms of queries; % is a word from the part's name.
FORMS = (
    "%", "%_name", "%Name", "src/%.rs:12", "README.md:3-9", "README.md:9-3", "README.md:0", "%\\(", "a.*%", "a.+%", "a b.*%", "*.%", "*_%", "%*.rs", "src/%", "src/main.rs", ".%", ".gitignore", "1234", "%.py", "%.method", "Makefile",
    "two % words", "one two three % five", "what is %?", "$%", "@%", "%-case", "C:\\bin\\%", "\\b%\\b", "models\\.%", "a,%", "a,%,,c", "a,b,c,d,e,%", "a, % ,x.y", "%,", "%::new", "std::%", "x.*%.*y", "%{a,b}", "./%", "(%)", "%[0]", "a.b.%", "%.", "",
)
PATHS = ("README.md", "src/main.rs", ".gitignore", "Makefile")
_FORMS = "[" + ", ".join("'" + f.replace("'", "''") + "'" for f in FORMS) + "]"
ASKED = f"asked as (select p_partkey, replace(({_FORMS})[p_partkey % {len(FORMS)} + 1], '%', string_split(p_name, ' ')[1]) as q from part)"
_IDENT = "^[A-Za-z_$@][A-Za-z0-9_$.-]*$"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    part = adapters.table(spark, sf, "part")
    return part.select("p_partkey", F.replace(pick(FORMS, F.col("p_partkey") % len(FORMS)), F.lit("%"), F.split("p_name", " ")[0]).alias("q"))


_RANGE = "regexp_matches({c}, '^[0-9]+(-[0-9]+)?$') and regexp_extract({c}, '^([0-9]+)', 1)::bigint > 0 and coalesce(nullif(regexp_extract({c}, '-([0-9]+)$', 1), ''), regexp_extract({c}, '^([0-9]+)', 1))::bigint >= regexp_extract({c}, '^([0-9]+)', 1)::bigint"
_CO = "(len(string_split(q, '{sep}')) >= 2 and len(list_filter(string_split(q, '{sep}'), lambda x: not regexp_matches(trim(x), '^[A-Za-z0-9_$@.-]+$'))) = 0)"
_EXT_OF = "regexp_extract(regexp_extract(q, '\\.([^.]*)$', 1), '^(.*?)\\]*\\}*$', 1)"
_NAME_LIKE = f"not contains(q, ' ') and not contains(q, '/') and (regexp_matches(q, '^.+\\.[^.]+$') or q in ({_in(Q.FILE_NAMES)}))"
_DOTTED = f"(regexp_matches(regexp_extract(q, '^(.+)\\.[^.]+$', 1), '{_IDENT}') and regexp_matches(regexp_extract(q, '^.+\\.([^.]+)$', 1), '{_IDENT}') and lower(regexp_extract(q, '^.+\\.([^.]+)$', 1)) not in ({_in(Q.FILE_EXTENSIONS)}))"


@query(f"""with {ASKED}, t as (select *, q in ({_in(PATHS)}) as there, regexp_extract(q, '^(.*):[^:]*$', 1) in ({_in(PATHS)}) as section_there, regexp_extract(q, ':([^:]*)$', 1) as section, regexp_matches(q, '^[A-Za-z]:\\\\') as drive from asked)
    select p_partkey, q, case when not drive and not there and ({_CO.format(sep=".*")} or {_CO.format(sep=".+")}) then 'co-occurrence' when not drive and not there and regexp_matches(q, '\\\\[().\\[{{bwsd]') then 'pattern text'
        when section_there and section <> '' and {_RANGE.format(c="section")} then case when contains(section, '-') then 'path section' else 'path line' end
        when not contains(q, ' ') and regexp_matches(q, '[*?{{\\[]') then case when contains(q, '/') or contains(q, '\\') or starts_with(q, '*.') or contains(q, '*.{{') or contains(q, '?.') or (contains(q, '.') and {_EXT_OF} in ({_in(Q.FILE_EXTENSIONS)})) then 'glob' else 'symbol glob' end
        when contains(q, '/') or contains(q, '\\') then case when there then 'path' else 'fallthrough' end when starts_with(q, '.') and there then 'path' when regexp_matches(q, '^[0-9]*$') then 'fallthrough'
        when {_NAME_LIKE} and there then 'path' when {_NAME_LIKE} and not {_DOTTED} then 'glob'
        when regexp_matches(q, '{_IDENT}') then case when regexp_matches(q, '^[A-Z$@]|::|\\.|_|-|^[a-z].*[A-Z]') then 'symbol' else 'concept' end
        when contains(q, ' ') and len(string_split_regex(trim(q), '\\s+')) <= 4 and regexp_full_match(trim(q), '[A-Za-z0-9_-]+(\\s+[A-Za-z0-9_-]+)*') then 'concept' else 'fallthrough' end as kind from t""")
def classify_queries(spark, sf):
    """The kind of each query, where four paths exist."""
    before = F.regexp_extract("q", "^(?s:(.*)):[^:]*$", 1)
    return asked(spark, sf).select("p_partkey", "q", Q.classify(F.col("q"), F.col("q").isin(*PATHS), before.isin(*PATHS)).alias("kind"))


@query(f"""with {ASKED} select p_partkey, regexp_matches(q, '{_IDENT}') as identifier, regexp_matches(q, '^[A-Z$@]|::|\\.|_|-|^[a-z].*[A-Z]') as exact_symbol, regexp_matches(q, '[*?{{\\[]') as has_glob, {_NAME_LIKE} as file_name, {_DOTTED} as dotted,
    regexp_replace(q, '\\\\([().\\[{{bwsd])', '\\1', 'g') as plain, regexp_replace(q, '[^A-Za-z0-9_$@.-]', '', 'g') as core, case when regexp_extract(q, ':([^:]*)$', 1) <> '' and {_RANGE.format(c="regexp_extract(q, ':([^:]*)$', 1)")} and regexp_extract(q, '^(.*):[^:]*$', 1) <> '' then regexp_extract(q, ':([^:]*)$', 1) end as section,
    case when {_CO.format(sep=".*")} then trim(string_split(q, '.*')[1]) || ' ' || trim(string_split(q, '.*')[2]) when {_CO.format(sep=".+")} then trim(string_split(q, '.+')[1]) || ' ' || trim(string_split(q, '.+')[2]) end as pair from asked""")
def query_parts(spark, sf):
    """What queries are made of."""
    q = F.col("q")
    pair = Q.cooccurrence(q)
    return asked(spark, sf).select(
        "p_partkey", T.is_identifier(q).alias("identifier"), Q.is_exact_symbol(q).alias("exact_symbol"), Q.has_glob(q).alias("has_glob"), Q.looks_like_file_name(q).alias("file_name"), Q.is_dotted_symbol(q).alias("dotted"),
        Q.de_escaped(q).alias("plain"), Q.identifier_core(q).alias("core"), Q.path_section(q)["section"].alias("section"), F.when(pair.isNotNull(), F.concat(pair["first"], F.lit(" "), pair["second"])).alias("pair"),
    )


@query(f"""with {ASKED}, t as (select *, list_filter(list_transform(string_split(q, ','), lambda x: trim(x)), lambda x: x <> '') as parts from asked),
    n as (select *, contains(q, ',') and len(list_filter(parts, lambda x: not regexp_matches(x, '{_IDENT}'))) = 0 as names from t)
    select p_partkey, case when names and len(parts) between 2 and 5 then array_to_string(parts, ' ') when names and len(parts) > 5 then 'too many' end as symbols,
        array_to_string([i || ':' || trim(string_split(q, ',')[i]) for i in range(1, len(string_split(q, ',')) + 1) if trim(string_split(q, ',')[i]) <> ''], ' ') as terms,
        case len(string_split_regex(trim(q), '\\s+')) when 2 then w1 || '.*' || w2 || '|' || w2 || '.*' || w1 else array_to_string(list_transform(string_split_regex(trim(q), '\\s+'), lambda x: regexp_replace(x, '([\\\\.+*?()|\\[\\]{{}}^$#&~-])', '\\\\\\1', 'g')), '|') end as relaxed
    from (select *, regexp_replace(string_split_regex(trim(q), '\\s+')[1], '([\\\\.+*?()|\\[\\]{{}}^$#&~-])', '\\\\\\1', 'g') as w1, regexp_replace(string_split_regex(trim(q), '\\s+')[2], '([\\\\.+*?()|\\[\\]{{}}^$#&~-])', '\\\\\\1', 'g') as w2 from n)""")
def query_terms(spark, sf):
    """Several symbols, numbered terms, and the relaxed pattern of a query's words."""
    q = F.col("q")
    symbols = Q.multi_symbols(q)
    listed = F.array_join(F.transform(Q.numbered_terms(q), lambda x: F.concat(x["slot"].cast("string"), F.lit(":"), x["term"])), " ")
    return asked(spark, sf).select("p_partkey", F.when(F.size(symbols) == 0, "too many").otherwise(F.array_join(symbols, " ")).alias("symbols"), listed.alias("terms"), Q.relaxed_pattern(q).alias("relaxed"))


# --- how text is shown ---------------------------------------------------------------------------------------------


@query("""with t as (select doc_id, text from documents where text is not null)
    select doc_id, case when length(text) <= 360 then text when strpos(lower(text), 'the') > 0 then case when strpos(lower(text), 'the') - 1 > 180 then '…' else '' end || trim(text[greatest(0, strpos(lower(text), 'the') - 181) + 1 : least(greatest(0, strpos(lower(text), 'the') - 181) + 360, length(text))], ' ' || chr(10) || chr(9) || chr(13))
            || case when greatest(0, strpos(lower(text), 'the') - 181) + 360 < length(text) then '…' else '' end
        else rtrim(text[:360], ' ' || chr(10) || chr(9) || chr(13)) || '…' end as compact,
        case when length(one) <= 120 then one else one[:72] || ' … ' || one[-40:] end as argument
    from (select *, trim(regexp_replace(text, '[ \\t\\n\\r\\v\\f]+', ' ', 'g')) as one from t)""")
def compact_texts(spark, sf):
    """Whole texts cut as lines around a term, and as arguments of a call."""
    t = adapters.table(spark, sf, "documents").filter("text is not null")
    return t.select("doc_id", display.compact_line(F.col("text"), "the").alias("compact"), display.compact_argument(F.col("text")).alias("argument"))


@query("""with n as (select o_orderkey, o_orderkey::bigint * (o_custkey % 1000 + 1) as n, o_orderkey::bigint * 50 as h from orders)
    select o_orderkey, format('{:,}', n) as counted, case when n >= 1000000 then printf('%.1fM', n / 1000000.0::double) when n >= 1000 then printf('%.1fk', n / 1000.0::double) else n::varchar end as tokens,
        case when h >= 1000000 then printf('%.1fM', h / 1000000.0::double) when h >= 1000 then printf('%.1fk', h / 1000.0::double) else h::varchar end as halves from n""")
def shown_numbers(spark, sf):
    """Numbers with commas and as thousands or millions to one place; ``halves`` are numbers with many exact halves."""
    orders = adapters.table(spark, sf, "orders")
    n = F.col("o_orderkey").cast("long") * (F.col("o_custkey") % 1000 + 1)
    told = orders.select("o_orderkey", n.alias("n"), (F.col("o_orderkey").cast("long") * 50).alias("h"))
    return told.select("o_orderkey", display.grouped_count(F.col("n")).alias("counted"), display.token_count(F.col("n")).alias("tokens"), display.token_count(F.col("h")).alias("halves"))


@query(f"""with {ASKED} select p_partkey, case when regexp_matches(q, '^[A-Za-z0-9_./:-]*$') then q else chr(39) || replace(q, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) end as quoted,
    replace(q, chr(92), chr(92) || chr(92)) as escaped, case when starts_with(q, 'src/') then q[5:] else q end as relative, case when regexp_matches(q, '^[^.]+\\.[^.]+$') then string_split(q, '.')[1] || '|' || string_split(q, '.')[2] end as dotted,
    trim(regexp_extract(trim(regexp_replace('*' || q, '^\\*+', '')), '^([^\\[]*)', 1)) as receiver, case when regexp_matches(q, '(\\.|::)$') then regexp_replace(q, '(\\.|::)$', '') when regexp_matches(q, '\\.|::') then regexp_extract(q, '(\\.|::)([^.:]|:[^.:])*$', 0)[case when regexp_matches(regexp_extract(q, '(\\.|::)([^.:]|:[^.:])*$', 0), '^::') then 3 else 2 end:] else q end as callable,
    replace(replace(replace('&lt;' || q || '&amp;#39;', '&amp;', '&'), '&#39;', chr(39)), '&lt;', '<') as entities from asked""")
def shown_names(spark, sf):
    """Names quoted, escaped, relative, split at a dot, as receivers and callables, and without entities."""
    q = F.col("q")
    dotted = display.split_dotted(q)
    return asked(spark, sf).select(
        "p_partkey", display.shell_quoted(q).alias("quoted"), display.escaped_term(q).alias("escaped"), display.relative(q, "src").alias("relative"), F.when(dotted.isNotNull(), F.concat(dotted["qualifier"], F.lit("|"), dotted["name"])).alias("dotted"),
        display.receiver_type(F.concat(F.lit("*"), q)).alias("receiver"), T.terminal_callable_key(q).alias("callable"), display.basic_entities(F.concat(F.lit("&lt;"), q, F.lit("&amp;#39;"))).alias("entities"),
    )


@query("""with v as (select p_partkey, (p_size % 3) || '.' || (p_partkey % 11) || case when p_size % 5 = 0 then '' else '.' || (p_size % 13) || case when p_size % 7 = 0 then '-rc1' else '' end end as a, '1.' || (p_size % 11) || '.5' as b from part),
    n as (select *, [try_cast(x as bigint) for x in string_split_regex(a, '[.-]')] as x, [try_cast(x as bigint) for x in string_split_regex(b, '[.-]')] as y from v)
    select p_partkey, a, b, (coalesce(x[1], 0), coalesce(x[2], 0), coalesce(x[3], 0)) > (coalesce(y[1], 0), coalesce(y[2], 0), coalesce(y[3], 0)) as newer from n""")
def newer_versions(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    tail = F.when(size % 5 == 0, "").otherwise(F.concat(F.lit("."), (size % 13).cast("string"), F.when(size % 7 == 0, "-rc1").otherwise("")))
    a = F.concat((size % 3).cast("string"), F.lit("."), (key % 11).cast("string"), tail)
    told = adapters.table(spark, sf, "part").select("p_partkey", a.alias("a"), F.concat(F.lit("1."), (size % 11).cast("string"), F.lit(".5")).alias("b"))
    return told.withColumn("newer", display.is_newer_version(F.col("a"), F.col("b")))


# --- documents and data files --------------------------------------------------------------------------------------

#: Fences as the sample tree has them: the state of each file's lines by recursion.
FENCES = CODE + """, marks as (select path, line, regexp_extract(text, '^ {0,3}(`{3,}|~{3,})', 1)[1] as ch, length(regexp_extract(text, '^ {0,3}(`{3,}|~{3,})', 1)) as n, regexp_matches(text, '^ {0,3}(`{3,}|~{3,})[ \\t]*$') as bare,
        row_number() over (partition by path order by line) as k from code_lines where regexp_matches(text, '^ {0,3}(`{3,}|~{3,})')),
    state as (select path, k, line, line as opened, ch, n, true as opens, false as closes from marks where k = 1
        union all select m.path, m.k, m.line, case when s.closes or s.opened is null then m.line else s.opened end, case when s.closes then m.ch else s.ch end, case when s.closes then m.n else s.n end, s.closes,
            not s.closes and m.bare and m.ch = s.ch and m.n >= s.n from state s join marks m on m.path = s.path and m.k = s.k + 1),
    blocks as (select path, opened as first, coalesce(min(line) filter (where closes), 2147483647) as last from state group by path, opened),
    outside as (select l.* from code_lines l where not exists (select 1 from blocks b where b.path = l.path and l.line between b.first and b.last)),
    heads as (select path, line, length(regexp_extract(text, '^ {0,3}(#{1,6})(\\s|$)', 1)) as level, regexp_replace(trim(regexp_extract(text, '^ {0,3}#{1,6}\\s(.*)$', 1)), '(\\s*#)+$', '') as raw from outside where regexp_matches(text, '^ {0,3}#{1,6}(\\s|$)')),
    titled as (select path, line, level, case when regexp_matches(raw, '\\{#[^{]*\\}$') then rtrim(regexp_extract(raw, '^(.*)\\{#', 1)) || ' #' || regexp_extract(raw, '\\{#([^}]*)\\}$', 1) else raw end as text from heads where raw <> '')"""


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return code_lines(spark, sf).select("path", "line", "text")


@query(f"""with recursive {FENCES} select path, line, level, text, greatest(line, coalesce((select min(t.line) - 1 from titled t where t.path = h.path and t.line > h.line and t.level <= h.level), (select max(line) from code_lines l where l.path = h.path)))::int as last from titled h""")
def document_sections(spark, sf):
    """Headings outside code blocks, each with the end of its section."""
    return D.sections(_documents(spark, sf))


@query(f"""with recursive {FENCES} select b.path, b.first as line, least(b.last, (select max(line) from code_lines l where l.path = b.path))::int as last, coalesce(nullif(regexp_extract(text, '^ {{0,3}}(?:`{{3,}}|~{{3,}})\\s*(\\S*)', 1), ''), 'code') as name
    from blocks b join code_lines f on f.path = b.path and f.line = b.first""")
def document_code_blocks(spark, sf):
    return D.code_blocks(_documents(spark, sf))


@query(f"""with recursive {FENCES} select path, line, unnest(list_filter([regexp_extract(text, '^\\s*\\[[^\\]]+\\]:\\s*<?([^\\s>]+)', 1)] || regexp_extract_all(text, '\\]\\(([^)]*)\\)', 1), lambda x: x <> '')) as source from outside""")
def document_links(spark, sf):
    return D.links(_documents(spark, sf))


@query(f"""with {CODE}, i as (select *, sum(starts_with(text, '```')::int) over (partition by path order by line rows unbounded preceding) % 2 = 1 as inside from code_lines),
    h as (select path, line, rtrim(text) as heading, levenshtein('usage', lower(trim(regexp_replace(string_split(trim(regexp_replace(text, '^#+', '')), '{{')[1], '#+$', '')))) as distance from i where starts_with(text, '#') and not inside and trim(regexp_replace(text, '^#+', '')) <> '')
    select * from (select *, row_number() over (partition by path order by distance, line) as rank from h) where rank <= 3""")
def near_headings(spark, sf):
    return D.nearest_headings(_documents(spark, sf), "## Usage", 3)


@query(f"""with {CODE}, t as (select path, line, text, ltrim(text) as t from code_lines), k as (select path, line, ((length(text) - length(t)) // 2)::int as depth, regexp_extract(t, '^([^:]*):', 1) as key, trim(regexp_extract(t, '^[^:]*:(.*)$', 1)) as v, row_number() over (partition by path order by line) as k
        from t where not regexp_matches(t, '^($|#|-)') and contains(t, ':') and not contains(regexp_extract(t, '^([^:]*):', 1), ' ') and (length(text) - length(t)) // 2 <= 2)
    select path, line, depth, key, case when strlen(v) > 40 then v[:37] || '...' else v end as value from k where k <= 20""")
def yaml_keys(spark, sf):
    return D.keys_of_yaml(_documents(spark, sf), 20)


@query(f"""with {CODE}, n as (select path, line, text, max(line) over (partition by path) as n from code_lines),
    p as (select *, case when line = 1 then 'columns' when line <= 6 then 'head' when n <= 9 or line > n - 3 then 'tail' end as part from n) select path, line, text, part, n - 1 as rows from p where part is not null""")
def table_previews(spark, sf):
    return D.table_preview(_documents(spark, sf))


@query(f"""with {CODE}, n as (select path, line, max(line) over (partition by path) as n from code_lines), a as (select *, least(49, n - 1) as "at" from n), s as (select *, least(greatest(0, "at" - 8), greatest(0, n - 17)) as b from a)
    select path, line from s where case when n <= 20 or "at" < 20 then line <= 20 else line <= 3 or (line - 1 >= b and line - 1 < b + 17) end""")
def anchored_lines(spark, sf):
    return D.around_anchor(_documents(spark, sf).select("path", "line"), 50, 20)


@query(f"""with {CODE}, d as (select path, line, nullif(regexp_extract(text, '(?:fn|class|struct|interface|type|def|func|function|const) +([A-Za-z_][A-Za-z0-9_]*)', 1), '') as name from code_lines),
    s as (select path, line, name, case when starts_with(lower(name), 'handl') then 0 else levenshtein('handl', lower(name)) end as distance from d where name is not null)
    select * from (select *, row_number() over (partition by path order by distance, line) as rank from s) where rank <= 5""")
def near_symbols(spark, sf):
    """For each file the five names nearest to the beginning of one."""
    from corvane.operators import search

    name = F.nullif(F.regexp_extract("text", "(?:fn|class|struct|interface|type|def|func|function|const) +([A-Za-z_][A-Za-z0-9_]*)", 1), F.lit(""))
    return search.nearest_names(_documents(spark, sf).select("path", "line", name.alias("name")).filter("name is not null"), "handl", 5)


@query(f"""with {CODE}, f as (select 'a' || doc_id as k, name from code_files), s as (select name, levenshtein(name, 'searhc.rs') as d from (select distinct name from code_files)) select name, d as distance from s where d <= 3 and d = (select min(d) from s)""")
def near_files(spark, sf):
    """The names of files nearest to one that isn't there, within three bytes."""
    from corvane.operators import search

    return search.nearest_files(code_files(spark, sf).select("name"), "searhc.rs")
