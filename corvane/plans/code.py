"""Queries on a source tree: what its files and lines are, which matches come first, and how they are grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import code, display, paths
from corvane.operators import files as fl
from corvane.operators import rank, search
from corvane.plans.registry import query
from corvane.plans.samples import CODE, NOW, code_files, code_lines
from corvane.sources import adapters


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _starts(column: str, values) -> str:
    return "(" + " or ".join(f"starts_with({column}, '" + v.replace("'", "''") + "')" for v in values) + ")"


def _has(column: str, values) -> str:
    return "(" + " or ".join(f"contains({column}, '" + v.replace("'", "''") + "')" for v in values) + ")"


_LANG = " ".join(f"when ext in ({_in(v)}) then '{k}'" for k, v in (paths.LANGUAGES | paths.DOCUMENT_LANGUAGES).items()) + " " + " ".join(f"when ext = '' and name in ({_in(v)}) then '{k}'" for k, v in paths.NAMED.items())
_CODE_EXT = _in(e for v in paths.LANGUAGES.values() for e in v)
_TYPE = f"""case when ext in ({_CODE_EXT}) then 'code' when ext in ({_in(e for v in paths.DOCUMENT_LANGUAGES.values() for e in v)}) then 'document' when ext in ({_in(paths.STRUCTURED)}) then 'structured' when ext in ('csv', 'tsv') then 'tabular'
    when ext = 'log' then 'log' when ext = '' and name in ({_in(n for v in paths.NAMED.values() for n in v)}) then 'code' when ext = '' and starts_with(name, '.env') then 'structured' else 'other' end"""
_TEST_PLACE = "(contains(path, '_test.') or contains(path, '_spec.') or list_has_any(string_split(path, '/'), ['test', 'tests', 'spec']))"
_DEF = f"{_starts('trim(text)', code.DEFINITION_BEGINS)}"

#: Lines with "handle" in any case as matches: what they define, and how.
MATCHES = CODE + f""", matched as (
    select l.*, f.mtime, f.byte_len, trim(text) as t, lower(text) as low, contains(text, 'handle') as exact, {_TYPE} as file_type,
        nullif(regexp_extract(text, '(?:fn|class|struct|interface|type|def|func|function|const) +([A-Za-z_][A-Za-z0-9_]*)', 1), '') as d, nullif(regexp_extract(trim(text), '^impl ([A-Za-z_]+)', 1), '') as impl_target,
        nullif(regexp_extract(text, ' extends ([A-Za-z_]+)', 1), '') as base_target, {_starts("trim(text)", ("//", "#", "/*", "<!--", "* "))} as in_comment
    from code_lines l join (select path, mtime, byte_len from code_files) f using (path) where contains(lower(text), 'handle')
), matches as (
    select * exclude (d), {_DEF} and (d is not null or impl_target is not null) as is_definition, coalesce(d, impl_target) as def_name, case when starts_with(trim(text), 'impl ') then 90 when starts_with(trim(text), 'const ') then 80 else 100 end as def_weight from matched
)"""


def matches_of(spark: SparkSession, sf: str, about: DataFrame | None = None) -> DataFrame:
    """The matches; ``about`` has more of each path than when it was changed and its size."""
    text, t = F.col("text"), code.trimmed(F.col("text"))
    some = lambda pattern, of=text: F.nullif(F.regexp_extract(of, pattern, 1), F.lit(""))
    about = code_files(spark, sf).select("path", "mtime", "byte_len") if about is None else about
    found = code_lines(spark, sf).filter(F.contains(F.lower("text"), F.lit("handle"))).join(about, "path")
    named = some("(?:fn|class|struct|interface|type|def|func|function|const) +([A-Za-z_][A-Za-z0-9_]*)")
    told = found.select("*", F.contains("text", F.lit("handle")).alias("exact"), paths.file_type(F.col("name")).alias("file_type"), named.alias("d"), some("^impl ([A-Za-z_]+)", t).alias("impl_target"), some(" extends ([A-Za-z_]+)").alias("base_target"), code.begins(t, ("//", "#", "/*", "<!--", "* ")).alias("in_comment"))
    weight = F.when(F.startswith(t, F.lit("impl ")), 90).when(F.startswith(t, F.lit("const ")), 80).otherwise(100)
    return told.withColumn("is_definition", code.is_definition_line(text) & (F.col("d").isNotNull() | F.col("impl_target").isNotNull())).withColumn("def_name", F.coalesce("d", "impl_target")).withColumn("def_weight", weight).drop("d")


def columns(df: DataFrame) -> dict:
    return {c: df[c] for c in df.columns}


# --- files ---------------------------------------------------------------------------------------------------------


@query(f"""with {CODE}, p as (select *, string_split(path, '/') as s, lower(path) as low from code_files)
    select path, {_TYPE} as file_type, case {_LANG} end as language, regexp_replace(name, '(.)\\.[^.]*$', '\\1') as stem, name in ({_in(paths.LOCK_FILES)}) as lock_file, {_has("content[1:512]", paths.GENERATED_MARKERS)} as marked,
    name in ({_in(paths.LOCK_FILES)}) or starts_with(name, 'zz_generated') or contains(name, '.generated.') or {_has("content[1:512]", paths.GENERATED_MARKERS)} as generated, regexp_matches(lower(name), '^(.+\\.min|.*-min)\\.[^.]*$') as minified_name,
    byte_len >= 300 and length(content[1:2048]) - length(replace(content[1:2048], chr(10), '')) < 4 as minified, ext in ({_in(paths.TEXTUAL)}) as textual,
    case ext when 'png' then 'image/png' else 'application/octet-stream' end as mime, contains(path, '.test.') or contains(path, '.spec.') or contains(path, '__tests__/') as test_file, {_TEST_PLACE} as test_place,
    len(list_filter(string_split(low, '/'), lambda x: x in ('test', 'tests', 'spec', 'specs', '__tests__') or starts_with(x, 'test_') or ends_with(x, '_test') or ends_with(x, '_spec') or contains(x, '_test.') or contains(x, '.test.') or contains(x, '_spec.') or contains(x, '.spec.'))) > 0 as test_of_terms,
    len(list_filter(s, lambda x: x in ('test', 'tests', 'testing') or ends_with(x, '_test.go') or contains(x, '_test.') or contains(x, '.test.') or contains(x, '.spec.'))) > 0 as test_of_maps,
    list_has_any(s, [{_in(adapters.SKIP_DIRS)}]) as skipped, list_has_any(s, [{_in(d for d in adapters.SKIP_DIRS if d not in adapters.ARTIFACT_DIRS)}]) as skipped_artifacts, array_to_string(s[1:least(2, len(s) - 1)], '/') as relation from p""")
def file_facts(spark, sf):
    """What is known of a file by its name and its beginning. Contents from 300 bytes on are looked at for being minified, where the default is 100,000."""
    path, name, content = F.col("path"), F.col("name"), F.col("content")
    return code_files(spark, sf).select(
        "path", paths.file_type(name).alias("file_type"), paths.language(name).alias("language"), paths.stem(name).alias("stem"), paths.is_generated_by_name(name).alias("lock_file"), paths.is_generated_by_content(content).alias("marked"),
        paths.is_generated(name, content).alias("generated"), paths.is_minified_name(name).alias("minified_name"), paths.looks_minified(content, 300).alias("minified"), paths.is_textual(name).alias("textual"), paths.mime(name).alias("mime"),
        paths.is_test_file(path).alias("test_file"), paths.is_test_place(path).alias("test_place"), paths.is_test_path_of_terms(path).alias("test_of_terms"), paths.is_test_path_of_maps(path).alias("test_of_maps"),
        adapters.in_skipped(path).alias("skipped"), adapters.in_skipped(path, True).alias("skipped_artifacts"), paths.relation_key(path).alias("relation"),
    )


@query(f"""with {CODE}, roots as (select distinct dir from code_files where name in ({_in(paths.MANIFESTS)}))
    select path, f.dir, (select r.dir from roots r where r.dir = f.dir or starts_with(f.dir, r.dir || '/') or r.dir = '' order by length(r.dir) desc limit 1) as root from code_files f""")
def package_roots(spark, sf):
    files = code_files(spark, sf).select("path", "dir", "name")
    return fl.nearest_above(files.select("path", "dir"), fl.manifest_folders(files)).select("path", "dir", "root")


@query(f"""with {CODE}, b as (select string_split(path[4:], '/') as s, byte_len from code_files where starts_with(path, 'g0/'))
    select s[1] as name, len(s) > 1 as is_folder, sum(byte_len)::bigint as bytes, sum(ceil(byte_len / 4))::bigint as tokens from b group by all""")
def folder_entries(spark, sf):
    return fl.entries(code_files(spark, sf), "g0")


@query(f"""with {CODE}, l as (select path, ext, line, trim(text) as t from code_lines where line <= 40 and ext in ({_in(paths.TEXTUAL)})),
    c as (select path, line, not {_starts("t", ("///", "//!", "/**", "/*!", '"""', "'''", "@doc", "# ", "## "))} as other, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^(///)+', ''), '^(//)+', ''), '^(/\\*)+', ''), '^(\\*|#)+', '')) as plain from l where t <> ''),
    k as (select *, row_number() over (partition by path order by other, line) as n from c where regexp_matches(plain, '\\p{{L}}')) select path, line, plain[1:80] as preview from k where n = 1""")
def file_previews(spark, sf):
    return fl.previews(code_lines(spark, sf))


# --- lines ---------------------------------------------------------------------------------------------------------

_TEN = f"({_starts('t', code.CONTROL_BEGINS)} or t in ('else', 'loop', 'return') or ends_with(t, '?;') or ends_with(t, '?') or {_starts('t', code.ERROR_BEGINS)} or {_has('t', (*code.ERROR_PARTS, '('))})"


@query(f"""with {CODE}, s as (select path, line, trim(text) as t, count(*) over (partition by path) as n from code_lines),
    k as (select path, line, n, case when line in (1, n) then 100 when t = '' or {_starts("t", ("//", "#", "/*", "* "))} or t in ('*/', '*') then 0 when {_TEN} then 10 when ends_with(t, '{{') and length(t) > 1 then 5
        when contains(t, '=') or {_starts("t", code.VARIABLE_BEGINS)} then 1 else 0 end as score from s)
    select path, line, score from (select *, row_number() over (partition by path order by score desc, line) as k from k) where n - 1 < 80 or k <= 40""")
def diverse_lines(spark, sf):
    return fl.diverse(code_lines(spark, sf))


def _families(values: dict, test) -> str:
    return "case family " + " ".join(f"when '{k}' then {test(v)}" for k, v in values.items() if v) + " else false end"


@query(f"""with {CODE}, l as (select path, line, trim(text) as t, case case {_LANG} end {" ".join(f"when '{x}' then '{k}'" for k, v in code.STRIP_FAMILIES.items() for x in v)} end as family from code_lines),
    b as (select *, lag(t) over (partition by path order by line) as before from l)
    select path, line, case when t = '' then case when before = '' then 'blank' end when {_families(code.DEBUG_BEGINS, lambda v: _starts("t", v))} then 'debug'
        when case when family = 'python' then starts_with(t, '#') else starts_with(t, '//') end and not {_families(code.DOC_BEGINS, lambda v: _starts("t", v))} and not {_has("upper(t)", code.KEEP_MARKERS)} then 'comment' end as why
    from b where family is not null""")
def noise_lines(spark, sf):
    lines = code_lines(spark, sf)
    return fl.noise(lines).filter(code.strip_family(paths.language(F.col("name"))).isNotNull()).select("path", "line", "why")


@query(f"with {CODE} select path, line, rtrim(text) as text from code_lines where contains(text, 'andle') and {_DEF}")
def definition_lines(spark, sf):
    return search.literal(code_lines(spark, sf), "andle").filter(code.is_definition_line(F.col("text"))).select("path", "line", F.regexp_replace("text", r"\s+$", "").alias("text"))


@query(f"""with {MATCHES}, defs as (select path, line, text from matches where is_definition and def_name = 'handle'),
    uses as (select path, line, text from code_lines where regexp_matches(text, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])handle([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)'))
    select path, line, text, true as is_definition from defs union all select path, line, text, false from uses where not exists (select 1 from defs where defs.path = uses.path and defs.line = uses.line)""")
def symbol_search(spark, sf):
    """Definitions of a name, and its other occurrences as a word."""
    defs = matches_of(spark, sf).filter("is_definition and def_name = 'handle'").select("path", "line", "text")
    uses = search.usages(code_lines(spark, sf).select("path", "line", "text"), "handle").join(defs.select("path", "line"), ["path", "line"], "left_anti")
    return defs.withColumn("is_definition", F.lit(True)).unionByName(uses.withColumn("is_definition", F.lit(False)))


# --- ranking -------------------------------------------------------------------------------------------------------

_FIXTURES = " + ".join(f"case when contains(lower(path), '{w}') then 90 else 0 end + case when contains(low, '{w}') then 40 else 0 end" for w in ("mock", "fixture", "stub", "fake", "example"))
_STEM = "lower(regexp_replace(name, '(.)\\.[^.]*$', '\\1'))"
_TERMS = f"""case when is_definition then def_weight * 10 else 0 end as weight,
    case when not is_definition or def_name is null then 0 when def_name = 'handle' then 220 when lower(def_name) = 'handle' then 180 when impl_target = 'handle' then 120 when starts_with(lower(def_name), 'handle') then 80 when contains(lower(def_name), 'handle') then 40 else 0 end as definition,
    case when exact then 500 else 0 end as exact, case when {_starts("ltrim(text)", ("fn ", "pub fn ", "pub(crate) fn ", "async fn ", "pub async fn ", "function ", "export function ", "export default function ", "export async function "))} then 70 else 0 end as intent, 0 as words,
    greatest(0, 200 - 20 * len(string_split(path, '/'))) as proximity, case when age <= 3600 then 100 when age <= 86400 then 80 when age <= 604800 then 50 when age <= 2592000 then 20 else 0 end as recency,
    case when greatest(1, byte_len // 40) < 200 then 50 else 0 end as small, case when {_STEM} = 'handle' then 500 when starts_with({_STEM}, 'handle') and {_STEM}[7:7] in ('_', '.', '-') then 350 when ends_with({_STEM}, 'handle') then 250 when contains({_STEM}, 'handle') then 180
        when string_split(dir, '/')[-1] = 'handle' then 200 else 0 end as basename,
    case when starts_with(ltrim(text), 'export default ') then 90 when starts_with(ltrim(text), 'export ') then 75 when starts_with(ltrim(text), 'pub ') then 60 else 0 end as exported,
    -(case when ext in ('md', 'mdx', 'txt', 'rst') or list_has_any(string_split(path, '/'), ['docs', 'doc']) then 250 else 0 end + case when {_has("path", ("example", "sample", "template"))} and ext in ('md', 'txt', 'rst') then 80 else 0 end
        + case when contains(path, 'generated') then 150 else 0 end) as non_code,
    -(case when is_definition then 0 when (starts_with(t, '//') and not starts_with(t, '///')) or starts_with(t, '/*') or starts_with(t, '<!--') or (starts_with(t, '#') and ext in ('py', 'rb', 'sh', 'bash', 'zsh', 'yaml', 'yml', 'toml', 'pl', 'r', 'R')) then 150
        when strpos(t, '//') > 1 and t[strpos(t, '//') - 1] <> ':' and contains(lower(t)[strpos(t, '//'):], 'handle') and not contains(lower(t)[:strpos(t, '//') - 1], 'handle') then 100 else 0 end) as incidental,
    -(case when contains(path, '.test.') or contains(path, '.spec.') or contains(path, '__tests__/') then 120 else 0 end) as tests, -least(200, {_FIXTURES}) as fixtures,
    -(case when list_has_any(string_split(path, '/'), ['node_modules', 'vendor', 'dist', 'build', '.git', 'target', '__pycache__', '.venv', 'venv', 'pkg', 'out']) then 200 else 0 end) as vendor"""


def _ranked(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """Matches with the terms of their files."""
    files = code_files(spark, sf)
    terms = rank.file_terms(text, files["path"], files["ext"], F.greatest(F.lit(1), F.floor(files["byte_len"] / 40)), F.lit(NOW) - files["mtime"])
    return matches_of(spark, sf, files.select("path", *[c.alias(k) for k, c in terms.items()]))


@query(f"with {MATCHES}, aged as (select *, {NOW} - mtime as age from matches) select path, line, {_TERMS} from aged")
def rank_terms(spark, sf):
    """Each term of each match's score."""
    found = _ranked(spark, sf, "handle")
    return found.select("path", "line", *rank.FILE_TERMS, *[c.alias(k) for k, c in rank.line_terms("handle", columns(found)).items()])


@query(f"""with {MATCHES}, aged as (select *, {NOW} - mtime as age from matches), terms as (select path, line, {_TERMS} from aged)
    select path, line, weight + definition + exact + intent + words + proximity + recency + small + basename + exported + non_code + incidental + tests + fixtures + vendor as score from terms order by score desc, path, line limit 100""")
def rank_score(spark, sf):
    """The first page of matches by score, path and line."""
    found = _ranked(spark, sf, "handle")
    return search.paged(found.select("path", "line", rank.score("handle", columns(found)).alias("score")), [F.desc("score"), F.col("path"), F.col("line")], 100)


_WORDS = "(case when contains(lower(path || ' ' || text), 'handle') then 1 else 0 end + case when contains(lower(path || ' ' || text), 'user') then 1 else 0 end + case when contains(lower(path || ' ' || text), 'test') then 1 else 0 end)"


@query(f"""with {MATCHES} select path, line, case {_WORDS} when 3 then 300 when 2 then 120 else 0 end as words, 0 as tests,
    case when {_starts("ltrim(text)", code.TYPE_BEGINS)} then 90 else 0 end as type_intent from matches""")
def rank_words(spark, sf):
    """Terms that other queries have: several words, one of them about tests, and a capital."""
    found = _ranked(spark, sf, "Handle user test")
    words = rank.line_terms("Handle user test", columns(found))["words"]
    return found.select("path", "line", words.alias("words"), "tests", rank.query_intent(F.col("text"), "Handle").alias("type_intent"))


@query(f"""with {CODE}, roots as (select distinct dir from code_files where name in ({_in(paths.MANIFESTS)})),
    rooted as (select path, dir, (select r.dir from roots r where r.dir = f.dir or starts_with(f.dir, r.dir || '/') order by length(r.dir) desc limit 1) as root from code_files f)
    select path, case when dir = 'g0/src/api' then 100 when len(string_split(dir, '/')) >= 2 and string_split(dir, '/')[1:2] = ['g0', 'src'] then 40 else 0 end + case when root = 'g0/src' then 75 else 0 end as points from rooted""")
def rank_context(spark, sf):
    """What being near g0/src/api, in the package of g0/src, adds to a match's score."""
    files = code_files(spark, sf).select("path", "dir", "name")
    rooted = fl.nearest_above(files.select("path", "dir"), fl.manifest_folders(files))
    return rooted.select("path", rank.context_proximity(F.col("dir"), F.col("root"), "g0/src/api", "g0/src").alias("points"))


# --- groups of matches ---------------------------------------------------------------------------------------------

_KIND = "case when is_definition then 'definition' when not exact or file_type <> 'code' then 'text' else 'name occurrence' end"
_LABEL = "case when in_comment then 'comment occurrence' when not is_definition then case when not exact or file_type <> 'code' then 'text' else 'name occurrence' end when impl_target is not null then 'impl' when base_target is not null then 'base' else 'definition' end"


@query(f"""with {MATCHES} select path, count(*) filter (where in_comment) as comments, count(*) filter (where not in_comment and is_definition) as definitions,
    count(*) filter (where not in_comment and {_KIND} = 'name occurrence') as name_occurrences, count(*) filter (where not in_comment and {_KIND} = 'text') as text_matches from matches group by path""")
def page_evidence_counts(spark, sf):
    """Matches of each file by kind; a comment is that alone."""
    m = matches_of(spark, sf)
    kind = F.when(F.col("in_comment"), "comment").otherwise(code.evidence_kind(F.col("is_definition"), F.col("exact"), F.col("file_type")))
    n = lambda k: F.count_if(F.col("kind") == k)
    return m.select("path", kind.alias("kind")).groupBy("path").agg(n("comment").alias("comments"), n("definition").alias("definitions"), n("name occurrence").alias("name_occurrences"), n("text").alias("text_matches"))


@query(f"""with {MATCHES} select {_KIND} as kind, path, line as first, line as last, text as snippet, case when is_definition then 'ast' else 'text' end as source, case when is_definition then 'structural syntax' else 'text evidence' end as confidence from matches""")
def evidence_atoms(spark, sf):
    """Each match as a piece of evidence: kind, place, snippet, source and how sure it is."""
    m = matches_of(spark, sf)
    source = F.when(F.col("is_definition"), "ast").otherwise("text")
    kind = code.evidence_kind(F.col("is_definition"), F.col("exact"), F.col("file_type"))
    return m.select(kind.alias("kind"), "path", F.col("line").alias("first"), F.col("line").alias("last"), F.col("text").alias("snippet"), source.alias("source"), display.confidence(source).alias("confidence"))


@query(f"""with {MATCHES}, roots as (select distinct dir from code_files where name in ({_in(paths.MANIFESTS)})),
    rooted as (select distinct dir, (select r.dir from roots r where r.dir = f.dir or starts_with(f.dir, r.dir || '/') order by length(r.dir) desc limit 1) as root from code_files f),
    main as (select root from matches join rooted using (dir) where is_definition order by path, line limit 1)
    select path, line, case when is_definition and impl_target is not null then 'implementations' when is_definition and base_target is not null then 'bases' when is_definition then 'definitions' when in_comment then 'comments'
        when {_TEST_PLACE} or (file_type not in ('other', 'log') and {_has("text", ("#[test]", "#[cfg(test)]", "@Test", "def test_", 'it("', "it('", 'describe("', "describe('", "func Test"))}) then 'tests'
        when coalesce(root = (select root from main), false) then 'usages_local' else 'usages_cross' end as facet from matches join rooted using (dir)""")
def match_facets(spark, sf):
    """The facet of each match; local is what has the package of the first definition."""
    files = code_files(spark, sf).select("path", "dir", "name")
    roots = fl.nearest_above(files.select("path", "dir"), fl.manifest_folders(files)).select("dir", "root").distinct()
    found = matches_of(spark, sf).join(roots, "dir")
    main = found.filter("is_definition").agg(F.min_by("root", F.struct("path", "line")).alias("main_root"))
    told = found.crossJoin(F.broadcast(main))  # one row
    return told.select("path", "line", fl.facet(columns(told), F.col("root") == F.col("main_root")).alias("facet"))


@query(f"with {MATCHES}, g as (select *, {_LABEL} as label from matches) select path, label, min(line) as first_line, count(*) as n from g where not is_definition group by all")
def match_groups(spark, sf):
    m = matches_of(spark, sf)
    return fl.grouped(m.withColumn("label", fl.match_label(columns(m))).filter("not is_definition"))


@query(f"""with {MATCHES}, g as (select *, {_LABEL} as label from matches), c as (select ext, label, count(*) as n, min(struct_pack(path := path, line := line)) as f from g group by all)
    select ext, label, n from (select *, row_number() over (partition by ext order by n desc, f) as k from c) where k = 1""")
def usual_labels(spark, sf):
    """The label that most matches in files of an extension have."""
    m = matches_of(spark, sf)
    return fl.most_frequent(m.withColumn("label", fl.match_label(columns(m))), "ext", "label", ["path", "line"])


@query(f"""with {MATCHES}, a as (select path, line, text, is_definition, in_comment, def_name from matches where starts_with(path, 'g0/src') union all select path, line, text, is_definition, in_comment, def_name from matches where starts_with(path, 'g0/')) select distinct * from a""")
def scope_union(spark, sf):
    """Matches of two scopes, one within the other; what both find counts once, by six columns."""
    m = matches_of(spark, sf).select("path", "line", "text", "is_definition", "in_comment", "def_name")
    within = lambda scope: m.filter(paths.is_under(F.col("path"), F.lit(scope)))
    return within("g0/src").unionByName(within("g0")).dropDuplicates()


@query(f"""with {MATCHES} select path, line, text from matches where contains(path, 'src') and contains(name, 'handle') and contains(text, 'handle') and {_KIND} = 'definition' and line between 3 and 60""")
def filtered_matches(spark, sf):
    return search.filtered(matches_of(spark, sf), "path:src file:handle text:handle kind:definition line:3-60").select("path", "line", "text")
