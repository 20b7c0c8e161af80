"""Python source as relations: outlines, owners, call sites and member accesses, from the standard library's parser.

Parsing is the one thing here that no built-in function can do; files go through Arrow batches, each file alone, and what comes out are plain rows
that the other operators join and group. A file that doesn't parse gives one row of ``errors`` and none elsewhere; so does one beyond SOURCE_CAP bytes.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCE_CAP = 500_000
ZEROS = ("0", "false", "null", "nullptr", "nil", "none")
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)

OUTLINE = "path string, id int, parent int, depth int, kind string, name string, first int, last int, signature string, doc string"
OWNERS = "path string, id int, name string, first int, last int, barrier boolean"
CALLS = "path string, line int, callee string, receiver string, args int, arguments array<string>, caller string, assigned string, returned boolean, text string"
ACCESSES = "path string, line int, base string, member string, access string, role string, function string"
ERRORS = "path string, line int, message string"


def _parsed(source: str | None) -> tuple[ast.Module | None, tuple[int, str] | None]:
    try:
        if len((source or "").encode()) > SOURCE_CAP:
            return None, (0, "too long")
        return ast.parse(source or ""), None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return None, (getattr(error, "lineno", None) or 0, str(getattr(error, "msg", error)))


def _first_line(node: ast.AST, lines: list[str]) -> str:
    line = lines[node.lineno - 1].encode()[node.col_offset :].decode(errors="ignore").strip()
    return line[: line.rfind(":")].strip() if line.endswith(":") else line


def outline_rows(tree: ast.Module, source: str) -> list[tuple]:
    """Top-level functions, classes and imports, and what classes hold, in order; ids count from 1 on."""
    lines, out = source.splitlines(), []

    def visit(body: list[ast.stmt], parent: int, depth: int) -> None:
        for node in body:
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                out.append((len(out) + 1, parent, depth, "import", _first_line(node, lines), node.lineno, node.end_lineno, None, None))
            elif isinstance(node, _SCOPES):
                own = len(out) + 1
                kind = "class" if isinstance(node, ast.ClassDef) else "function"
                out.append((own, parent, depth, kind, node.name, node.lineno, node.end_lineno, None if kind == "class" else _first_line(node, lines), (ast.get_docstring(node) or "").split("\n")[0] or None))
                if kind == "class":
                    visit(node.body, own, depth + 1)

    visit(tree.body, 0, 0)
    return out


def _walk(tree: ast.AST) -> Iterator[tuple[ast.AST, list[ast.AST]]]:
    """Each node with those around it, outermost first."""
    stack: list[tuple[ast.AST, list[ast.AST]]] = [(tree, [])]
    while stack:
        node, around = stack.pop()
        yield node, around
        inner = [*around, node]
        stack += [(child, inner) for child in reversed(list(ast.iter_child_nodes(node)))]


def _owner(around: list[ast.AST], node: ast.AST) -> str:
    """The dotted name of the innermost function around a node, or <top-level>. Decorators run outside of what they decorate."""
    chain = [*around, node]
    scopes = [n for n, child in zip(chain, chain[1:], strict=False) if isinstance(n, _SCOPES) and child not in n.decorator_list]
    while scopes and not isinstance(scopes[-1], _FUNCTIONS):
        scopes.pop()
    return ".".join(n.name for n in scopes) or "<top-level>"


def owner_rows(tree: ast.Module, source: str) -> list[tuple]:
    """Functions by their dotted names, from def to the end of their bodies, and lambdas as barriers."""
    found = [(n, a) for n, a in _walk(tree) if isinstance(n, (*_FUNCTIONS, ast.Lambda))]
    return [(k + 1, None if isinstance(n, ast.Lambda) else ".".join([*(x.name for x in a if isinstance(x, _SCOPES)), n.name]), n.lineno, n.end_lineno, isinstance(n, ast.Lambda)) for k, (n, a) in enumerate(found)]


def call_rows(tree: ast.Module, source: str) -> list[tuple]:
    lines, out = source.splitlines(), []
    for node, around in _walk(tree):
        if not isinstance(node, ast.Call) or not isinstance(node.func, (ast.Name, ast.Attribute)):
            continue
        member = isinstance(node.func, ast.Attribute)
        arguments = [ast.unparse(a) for a in node.args] + [f"{k.arg}={ast.unparse(k.value)}" if k.arg else f"**{ast.unparse(k.value)}" for k in node.keywords]
        near = around[::-1][:2]
        returned = any(isinstance(n, ast.Return) for n in near[:2])
        target = next((n.targets[0] if isinstance(n, ast.Assign) else n.target for n in near if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign))), None)
        line = node.func.end_lineno if member else node.lineno
        text = lines[node.lineno - 1].strip() if node.lineno == node.end_lineno else (node.func.attr if member else node.func.id)
        out.append((line, node.func.attr if member else node.func.id, ast.unparse(node.func.value) if member else None, len(arguments), arguments, _owner(around, node), None if returned or target is None else ast.unparse(target), returned, text))
    out.sort(key=lambda r: r[0])
    return [r for k, r in enumerate(out) if not k or (r[0], r[8], r[1]) != (out[k - 1][0], out[k - 1][8], out[k - 1][1])]


def _role(node: ast.AST, around: list[ast.AST]) -> str:
    child = node
    for parent in reversed(around):
        if isinstance(parent, (*_FUNCTIONS, ast.Lambda)):
            break
        if isinstance(parent, (ast.If, ast.While, ast.IfExp, ast.Assert)) and child is parent.test:
            return "condition"
        if isinstance(parent, ast.keyword) or isinstance(parent, ast.Call) and child in parent.args:
            return "call argument"
        if isinstance(parent, (ast.Assign, ast.AugAssign, ast.AnnAssign)) and child is parent.value:
            return "assignment right"
        if isinstance(parent, ast.Return):
            return "return"
        if isinstance(parent, ast.Subscript) and child is parent.slice:
            return "index"
        if isinstance(parent, ast.Attribute):
            return "receiver"
        child = parent
    return "expression"


def access_rows(tree: ast.Module, source: str) -> list[tuple]:
    out = []
    for node, around in _walk(tree):
        if not isinstance(node, ast.Attribute):
            continue
        parent = around[-1]
        if isinstance(node.ctx, ast.Store):
            zero = isinstance(parent, (ast.Assign, ast.AnnAssign)) and parent.value is not None and ast.unparse(parent.value).strip("() ").lower() in ZEROS
            access, role = "reset" if zero else "write", "assignment left"
        else:
            access, role = "write" if isinstance(node.ctx, ast.Del) else "read", _role(node, around)
        out.append((node.end_lineno, ast.unparse(node.value), node.attr, access, role, _owner(around, node)))
    return sorted(out, key=lambda r: r[0])


def _table(files: DataFrame, schema: str, rows: Callable[[ast.Module, str], list[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, source in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                tree, error = _parsed(source)
                found = rows(tree, source or "") if tree else []
                if schema == ERRORS and error:
                    found = [error]
                out += [dict(zip(names, (path, *r), strict=True)) for r in found]
            yield pa.RecordBatch.from_pylist(out, _ARROW[schema])

    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


_ARROW = {s: _arrow(s) for s in (OUTLINE, OWNERS, CALLS, ACCESSES, ERRORS)}


def outline(files: DataFrame) -> DataFrame:
    """The outline of Python files (path, content), a row for each entry; ``parent`` is 0 for top-level ones."""
    return _table(files, OUTLINE, outline_rows)


def owners(files: DataFrame) -> DataFrame:
    return _table(files, OWNERS, owner_rows)


def calls(files: DataFrame) -> DataFrame:
    """Call sites by line; equal ones of a line count once."""
    return _table(files, CALLS, call_rows)


def accesses(files: DataFrame) -> DataFrame:
    return _table(files, ACCESSES, access_rows)


def errors(files: DataFrame) -> DataFrame:
    return _table(files, ERRORS, lambda tree, source: [])


# --- on outlines ---------------------------------------------------------------------------------------------------


def with_container(entries: DataFrame) -> DataFrame:
    """Outline entries with ``container``: the name of what holds them, null at the top."""
    parents = entries.select("path", F.col("id").alias("parent"), F.col("name").alias("container"))
    return entries.join(parents, ["path", "parent"], "left")


def definitions(entries: DataFrame, name: str) -> DataFrame:
    """Definitions of a name, or of Type.member."""
    qualifier, dot, plain = name.partition(".")
    if dot and qualifier and plain and "." not in plain:
        return with_container(entries).filter((F.col("name") == plain) & (F.col("container") == qualifier) & (F.col("kind") != "import")).drop("container")
    return entries.filter((F.col("name") == name) & (F.col("kind") != "import"))


def select(entries: DataFrame, selector: str) -> DataFrame:
    """path, first, last of what a selector means in each file: an exact name or signature, else Type.member; equal ranges once."""
    exact = entries.filter((F.col("name") == selector) | (F.col("signature") == selector)).select("path", "first", "last", F.lit(0).alias("stage"))
    both = exact.union(definitions(entries, selector).select("path", "first", "last", F.lit(1).alias("stage"))) if "." in selector else exact
    best = both.withColumn("__s", F.min("stage").over(Window.partitionBy("path"))).filter("stage = __s")
    return best.select("path", "first", "last").distinct()


def selector(name: Column, container: Column) -> Column:
    """What ``select`` finds a function with: Type.member; null without a type."""
    return F.when(container.isNotNull(), F.concat(container, F.lit("."), name))


def callee_names(sites: DataFrame) -> DataFrame:
    return sites.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("callee")), " ").alias("callees"))


def resolved_callees(sites: DataFrame, entries: DataFrame) -> DataFrame:
    """path, callee and the definition that each callee of a file has in it: at the top or one below, the first in order."""
    near = entries.filter("depth <= 1 and kind <> 'import'").select("path", F.col("name").alias("callee"), F.struct("id", "kind", "first", "last").alias("d"))
    best = near.groupBy("path", "callee").agg(F.min("d").alias("d"))
    return sites.select("path", "callee").distinct().join(best, ["path", "callee"]).select("path", "callee", "d.kind", "d.first", "d.last")


def siblings(entries: DataFrame, uses: DataFrame, most: int = 6) -> DataFrame:
    """For each class the members that its code uses (uses: path, container, name): the first of a name, functions before others, then by name."""
    held = with_container(entries).filter("container is not null").groupBy("path", "container", "name").agg(F.min(F.struct("id", "kind", "signature", "first", "last")).alias("d"))
    found = held.join(uses.distinct(), ["path", "container", "name"])
    rank = F.row_number().over(Window.partitionBy("path", "container").orderBy((F.col("d.kind") != "function"), "name"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).select("path", "container", "name", "d.kind", F.coalesce("d.signature", "name").alias("signature"), "d.first", "d.last", "rank")


def lifecycles(found: DataFrame) -> DataFrame:
    """For each file, function and member what happens to it in the order of lines, and how often it is written, reset and read."""
    n = lambda k: F.count_if(F.col("access") == k).alias(f"n_{k}")
    steps = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "access"))), lambda x: F.concat(x["access"], F.lit(":"), x["line"].cast("string"))), " ")
    return found.groupBy("path", "function", "member").agg(steps.alias("steps"), n("write"), n("reset"), n("read"))


def filtered_accesses(found: DataFrame, kinds: tuple[str, ...] = (), **parts: str) -> DataFrame:
    """Accesses of any of the kinds whose path, function or member has the given part."""
    out = found.filter(F.col("access").isin(*kinds)) if kinds else found
    for name, part in parts.items():
        out = out.filter(F.contains(name, F.lit(part)))
    return out
