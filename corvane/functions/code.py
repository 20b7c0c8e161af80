"""What a line of source code is, by its text. ``trimmed`` is a line without white space at its ends."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of lines, by what they say.
CONTROL_BEGINS = ("if ", "} else", "else ", "else{", "match ", "switch ", "case ", "for ", "while ", "loop ", "loop{", "return ", "return;")
CONTROL_LINES = ("else", "loop", "return")
ERROR_BEGINS = ("catch ", "catch(", "except ", "except:")
ERROR_PARTS = (".unwrap()", ".expect(", "panic!(", "bail!(", "anyhow!(")
VARIABLE_BEGINS = ("let ", "const ", "var ", "mut ")
TYPE_BEGINS = (
    "struct ", "pub struct ", "enum ", "pub enum ", "trait ", "pub trait ", "interface ", "export interface ", "type ", "export type ", "class ", "export class ", "impl ",
)
FUNCTION_BEGINS = ("fn ", "pub fn ", "pub(crate) fn ", "async fn ", "pub async fn ", "function ", "export function ", "export default function ", "export async function ")
HASH_COMMENT_EXTENSIONS = ("py", "rb", "sh", "bash", "zsh", "yaml", "yml", "toml", "pl", "r", "R")
DEBUG_BEGINS = {
    "rust": ("log::debug!", "log::trace!", "tracing::debug!", "tracing::trace!", "debug!(", "trace!(", "dbg!("),
    "python": ("logger.debug(", "logging.debug(", "print(", "pprint(", "pprint.pprint("),
    "go": ("log.Printf(", "log.Println(", "log.Print(", "fmt.Printf(", "fmt.Println(", "fmt.Print("),
    "js": ("console.log(", "console.debug(", "console.trace("),
    "jvm": ("System.out.print", "logger.debug(", "log.debug(", "Log.d(", "println("),
    "c": ("printf(", "std::cout", "cout ", "cout<<"),
}
DOC_BEGINS = {"rust": ("///", "//!", "/**", "#[doc"), "python": ('"""', "'''"), "go": (), "js": ("/**", "* "), "jvm": ("/**", "///"), "c": ("/**", "///", "//!")}
KEEP_MARKERS = ("TODO", "FIXME", "NOTE", "HACK", "SAFETY", "WARN")
STRIP_FAMILIES = {"rust": ("rust",), "python": ("python",), "go": ("go",), "js": ("typescript", "tsx", "javascript"), "jvm": ("java", "kotlin", "csharp"), "c": ("c", "cpp")}
PYTHON_STDLIB = (
    "os", "sys", "re", "json", "math", "time", "datetime", "pathlib", "typing", "collections", "functools", "itertools", "abc", "io", "logging", "unittest", "dataclasses", "enum", "copy", "hashlib", "subprocess", "threading", "asyncio",
)
STDLIB_BEGINS = {"rust": ("std::", "core::", "alloc::"), "java": ("java.",), "kotlin": ("java.", "kotlin."), "scala": ("java.", "scala.")}
SELF_NAMES = ("this", "$this", "self", "Self", "static", "parent", "super")


def begins(c: Column, beginnings: tuple[str, ...]) -> Column:
    return c.rlike("^(?:" + "|".join(map(re.escape, beginnings)) + ")") if beginnings else F.lit(False)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_comment_only(t: Column) -> Column:
    return begins(t, ("//", "#", "/*", "* ")) | t.isin("*/", "*")


def line_score(t: Column, line: Column, first: Column, last: Column) -> Column:
    """How much a line tells: 100 for the first and last of its span, 10 for control flow, errors and calls, 5 for an opening, 1 for an assignment, else 0."""
    ten = begins(t, CONTROL_BEGINS) | t.isin(*CONTROL_LINES) | F.endswith(t, F.lit("?;")) | F.endswith(t, F.lit("?")) | begins(t, ERROR_BEGINS) | t.rlike("|".join(map(re.escape, (*ERROR_PARTS, "("))))
    return (
        F.when((line == first) | (line == last), 100).when((t == "") | is_comment_only(t), 0).when(ten, 10)
        .when(F.endswith(t, F.lit("{")) & (F.length(t) > 1), 5).when(F.contains(t, F.lit("=")) | begins(t, VARIABLE_BEGINS), 1).otherwise(0)
    )


def strip_family(language: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in STRIP_FAMILIES.items() for one in v for x in (one, k)]), language)


def _by_family(family: Column, test) -> Column:
    out = F.lit(False)
    for k in STRIP_FAMILIES:
        out = F.when(family == k, test(k)).otherwise(out)
    return out


def is_debug_log(t: Column, family: Column) -> Column:
    return _by_family(family, lambda k: begins(t, DEBUG_BEGINS[k]))


def is_strippable_comment(t: Column, family: Column) -> Column:
    """A plain comment: no documentation, and without a marker that keeps it."""
    def plain(k: str) -> Column:
        documents = begins(t, DOC_BEGINS[k]) | (t == "*/" if k == "js" else F.lit(False))
        return begins(t, ("#",) if k == "python" else ("//",)) & ~documents

    return _by_family(family, plain) & ~F.upper(t).rlike("|".join(KEEP_MARKERS))


def is_placeholder(name: Column) -> Column:
    return F.startswith(name, F.lit("<")) | F.startswith(name, F.lit("impl ")) | (F.length(name) == 1)


def is_stdlib(source: Column, language: Column) -> Column:
    out = F.when(language == "python", F.split(source, r"\.")[0].isin(*PYTHON_STDLIB)).otherwise(F.lit(False))
    for k, v in STDLIB_BEGINS.items():
        out = F.when(language == k, begins(source, v)).otherwise(out)
    return out


def is_external_import(source: Column, language: Column) -> Column:
    """Whether an import can't be a file of the tree; for documents see ``is_external_link``."""
    return (
        F.when(language == "rust", ~begins(source, ("crate::", "self::", "super::"))).when(language.isin("typescript", "tsx", "javascript"), ~begins(source, (".", "@/", "~/")))
        .when(language == "python", ~F.startswith(source, F.lit("."))).when(language.isin("c", "cpp"), ~F.startswith(source, F.lit('"'))).otherwise(True)
    )


def receiver_rank(receiver: Column) -> Column:
    """0 for a receiver that says which, 1 for one's own object, 2 for none."""
    r = F.trim(receiver)
    core = F.regexp_replace(r, r"^[&*()]+|[&*()]+$", "")
    return F.when(receiver.isNull() | (r == ""), 2).when(core.isin(*SELF_NAMES), 1).otherwise(0)


# Beginnings of lines that define something.
DEFINITION_BEGINS = (
    "fn ", "pub fn ", "pub(crate) fn ", "async fn ", "pub async fn ", "function ", "export function ", "export default function ", "export async function ", "async function ", "const ", "export const ", "let ", "export let ", "var ",
    "export var ", "class ", "export class ", "interface ", "export interface ", "type ", "export type ", "struct ", "pub struct ", "enum ", "pub enum ", "trait ", "pub trait ", "impl ", "def ", "async def ", "func ",
)


def is_definition_line(text: Column) -> Column:
    return begins(trimmed(text), DEFINITION_BEGINS)


def evidence_kind(is_definition: Column, exact: Column, file_type: Column) -> Column:
    return F.when(is_definition, "definition").when(~exact | (file_type != "code"), "text").otherwise("name occurrence")


# How much a kind of definition weighs.
DEFINITION_WEIGHTS = {
    100: (
        "function_declaration", "function_definition", "function_item", "function_expression", "generator_function", "method_definition", "method_declaration", "class_declaration", "class_definition", "class_specifier", "struct_item",
        "struct_specifier", "union_specifier", "interface_declaration", "trait_declaration", "trait_item", "enum_item", "enum_declaration", "enum_specifier", "type_item", "type_declaration", "decorated_definition", "class", "method", "singleton_method",
    ),
    90: ("impl_item", "object_declaration", "label"), 80: ("const_item", "const_declaration", "static_item"), 70: ("mod_item", "namespace_definition", "property_declaration", "module"),
    40: ("lexical_declaration", "variable_declaration"), 30: ("export_statement",),
}


def definition_weight(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for weight, kinds in DEFINITION_WEIGHTS.items() for k in kinds for x in (k, weight)]), kind), F.lit(50))


def export_names(text: Column) -> Column:
    """The names that a line of a bundle exports: declarations, lists (a name's alias), and exports.name."""
    rest = F.regexp_extract(text, r"^\s*export (.*)$", 1)
    listed = F.transform(F.split(F.regexp_extract(rest, r"^\{([^}]*)", 1), ","), lambda p: F.regexp_extract(F.coalesce(F.nullif(F.regexp_extract(p, r" as (.*)$", 1), F.lit("")), F.trim(p)), r"^([A-Za-z0-9_$]+)", 1))
    declared = F.array(F.regexp_extract(rest, r"^(?:default function |function |class |const |let |var )([A-Za-z0-9_$]+)", 1))
    assigned = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_$.])(?:module\.)?exports\.([A-Za-z0-9_$]+)"), F.lit(1))
    return F.filter(F.concat(F.when(F.startswith(rest, F.lit("{")), listed).otherwise(declared), assigned), lambda x: x != "")


def module_names(text: Column) -> Column:
    """The names that define("name") and define('name') give modules."""
    found = F.regexp_extract_all(text, F.lit(r"""define\(["']([^"']*)["']"""), F.lit(1))
    return F.filter(found, lambda x: x.rlike(r"^[A-Za-z0-9_/.@-]{1,160}$"))
