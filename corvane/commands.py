"""What a user of a source tree asks for, composed from the operators: find, show, callers, dependencies, diff, overview, compare, assess.

A ``Tree`` is a relation of files (path, dir, name, content); everything else is derived from it when asked for. Results are DataFrames; where one step
decides whether the next is needed (a search that widens until it finds something), only whether there are rows comes to the driver.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import code, paths
from corvane.functions import queries as Q
from corvane.functions import text as T
from corvane.operators import dependencies, documents, graph, patches, search, spans, syntax, trace
from corvane.sources import adapters

NAME = r"(?:fn|class|struct|interface|type|def|func|function|const|trait|enum|mod) +([A-Za-z_][A-Za-z0-9_]*)"


def definition_lines(lines: DataFrame) -> DataFrame:
    """path, line, text and name of lines that define a name."""
    named = lines.filter(code.is_definition_line(F.col("text"))).select("path", "line", "text", F.regexp_extract("text", NAME, 1).alias("name"))
    return named.filter("name <> ''")


class Tree:
    def __init__(self, files: DataFrame):
        self.files = files
        self.spark = files.sparkSession

    @cached_property
    def lines(self) -> DataFrame:
        return adapters.lines(self.files.select("path", "content"))

    # --- find ------------------------------------------------------------------------------------------------------

    def kind(self, query: str) -> str:
        there = not self.files.filter(F.col("path") == query).isEmpty()
        before = query.rpartition(":")[0]
        section_there = bool(before) and not self.files.filter(F.col("path") == before).isEmpty()
        return self.spark.range(1).select(Q.classify(F.lit(query), F.lit(there), F.lit(section_there)).alias("k")).first().k

    def find(self, query: str, filters: str | None = None) -> DataFrame:
        """path, line, text and ``found`` (definition, occurrence, text, relaxed, path, file) of what a query means in the tree."""
        kind = self.kind(query)
        if kind == "path":
            return self.show(query).withColumn("found", F.lit("file"))
        if kind in ("path line", "path section"):
            path, _, section = query.rpartition(":")
            return self.show(path, lines=section).withColumn("found", F.lit("file"))
        if kind == "glob":
            return self.glob(query)
        if kind == "symbol glob":
            return self._kept(definition_lines(self.lines).filter(F.col("name").rlike(T.glob_regex(query))).drop("name").withColumn("found", F.lit("definition")), filters)
        if kind == "co-occurrence":
            first, second = (p.strip() for p in re.split(r"\.\*|\.\+", query)[:2])
            return self._kept(search.cooccurrence(self.lines, first, second).withColumn("found", F.lit("text")), filters)
        if kind == "pattern text":
            return self._kept(self._text(re.sub(r"\\([().\[{bwsd])", r"\1", query)), filters)
        several = kind == "concept" and " " in query
        defined = self._defined(query)
        used = self._used(query, defined)
        if kind == "symbol":
            return self._kept(defined.unionByName(used), filters)
        if several:
            stages = [defined, self._text(query), self._relaxed(query)]
        elif kind == "concept":
            stages = [(defined, defined.unionByName(used)), self._text(query), used]
        else:
            stages = [defined.unionByName(used), self._text(query), *([self.glob(f"*{query}*")] if "/" in query and not query.startswith(("./", "../")) else [])]
        for stage in stages:
            test, result = stage if isinstance(stage, tuple) else (stage, stage)
            if not self._kept(test, filters).isEmpty():
                return self._kept(result, filters)
        return stages[-1].limit(0)

    def _kept(self, found: DataFrame, filters: str | None) -> DataFrame:
        if not filters:
            return found
        name = F.element_at(F.split("path", "/"), -1)
        told = found.withColumns({"name": name, "is_definition": F.col("found") == "definition", "exact": F.col("found") == "occurrence", "file_type": paths.file_type(name)})
        return search.filtered(told, filters).select(*found.columns)

    def _defined(self, name: str) -> DataFrame:
        return definition_lines(search.literal(self.lines, name)).filter(F.col("name") == name).drop("name").withColumn("found", F.lit("definition"))

    def _used(self, name: str, defined: DataFrame) -> DataFrame:
        return search.usages(self.lines, name).join(defined.select("path", "line"), ["path", "line"], "left_anti").withColumn("found", F.lit("occurrence"))

    def _text(self, text: str) -> DataFrame:
        return search.literal(self.lines, text).withColumn("found", F.lit("text"))

    def _relaxed(self, query: str) -> DataFrame:
        words = [re.escape(w) for w in query.split()]
        pattern = f"{words[0]}.*{words[1]}|{words[1]}.*{words[0]}" if len(words) == 2 else "|".join(words)
        return search.regex(self.lines, pattern).withColumn("found", F.lit("relaxed"))

    def glob(self, pattern: str, without: str | None = None) -> DataFrame:
        """Files whose name or path fits the pattern; their first line that tells something as text."""
        wanted = T.glob_regex(pattern.removeprefix("**/"))
        found = self.files.filter(F.col("name").rlike(wanted) | F.col("path").rlike(wanted))
        if without:
            found = found.filter(~(F.col("name").rlike(T.glob_regex(without)) | F.col("path").rlike(T.glob_regex(without))))
        return found.select("path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("text"), F.lit("path").alias("found"))

    # --- show ------------------------------------------------------------------------------------------------------

    def show(self, path: str, lines: str | None = None, heading: str | None = None, symbol: str | None = None, around: int = 0) -> DataFrame:
        """path, line and text of a file, or of a line, a range, a heading's section or a symbol in it, with ``around`` lines more at both ends."""
        own = adapters.lines(self.files.filter(F.col("path") == path).select("path", "content"))
        if lines:
            spans_ = [search.line_range(part.strip()) for part in lines.split(",")]
            test = F.lit(False)
            for first, last in spans_:
                test = test | F.col("line").between(first - around, last + around)
            return own.filter(test)
        if heading:
            ranges = documents.section_of(own, heading)
        elif symbol:
            ranges = syntax.select(syntax.outline(self.files.filter(F.col("path") == path)), symbol).select("path", "first", "last")
        else:
            return own
        shown = spans.containing(own, ranges.select("path", (F.col("first") - around).alias("first"), (F.col("last") + around).alias("last")), ["path"], at="line")
        return shown.select("path", "line", "text").distinct()

    # --- relations -------------------------------------------------------------------------------------------------

    def imports(self) -> DataFrame:
        """Every import with the file that it means, and its kind."""
        about = self.files.select("path", "dir", "name")
        found = dependencies.imports(self.lines.join(about.select("path", "name"), "path")).join(about.select("path", "dir"), "path")
        return dependencies.classified(dependencies.resolved(found, about))

    def dependencies(self, path: str) -> tuple[DataFrame, DataFrame]:
        """What a file imports by kind, and which files import it."""
        every = self.imports()
        return every.filter(F.col("path") == path).select("source", "kind", "target", "line"), every.filter(F.col("target") == path).groupBy("path").agg(F.min("line").alias("first_line"))

    def relations(self, depth: int = 2) -> DataFrame:
        """Imports between the first folders of files, without those within one: how many, and the first file that has one."""
        edges = self.imports().filter("target is not null").select(paths.relation_key(F.col("path"), depth).alias("src"), paths.relation_key(F.col("target"), depth).alias("dst"), "path", "target").distinct()
        return edges.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("path").alias("source_file"))

    def overview(self, depth: int = 3) -> DataFrame:
        """Tokens and files of each folder to a depth, with what is below it; the root is ""."""
        at = F.split("dir", "/")
        prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(at), F.lit(depth))), lambda k: F.array_join(F.slice(at, F.lit(1), k), "/"))
        return self.files.select(F.explode(prefixes).alias("folder"), T.estimate_tokens(F.col("content")).alias("t")).groupBy("folder").agg(F.sum("t").alias("tokens"), F.count("*").alias("n_files"))

    def calls(self) -> DataFrame:
        """Call sites of the Python files."""
        return syntax.calls(self.files.filter(paths.language(F.col("name")) == "python"))

    def callers(self, symbol: str, depth: int = 1, filters: str | None = None, **caps) -> DataFrame | trace.Traced:
        """One hop: the call sites of a symbol, in the order to read them. More: the traced search."""
        if depth > 1:
            return trace.callers(self.calls(), symbol, depth, **caps)
        sites = self.calls().filter(F.col("callee") == trace.terminal(symbol))
        return trace.repeated(trace.filtered(sites, filters) if filters else sites).orderBy(*trace.order())

    def callees(self, path: str, symbol: str) -> DataFrame:
        """What a function calls, with the definition of each callee in the file."""
        own = self.files.filter(F.col("path") == path)
        sites = syntax.calls(own).filter(F.col("caller").rlike(rf"(^|\.){re.escape(symbol)}$"))
        return sites.join(syntax.resolved_callees(sites, syntax.outline(own)), ["path", "callee"], "left").select("line", "callee", "receiver", "args", "kind", "first", "last")

    def assess(self, symbol: str, most: int = 10) -> DataFrame:
        """Call sites of a symbol by kind of file, receiver and file, the ``most`` frequent of each."""
        return assessed(self.calls().filter(F.col("callee") == trace.terminal(symbol)), most)

    # --- changes ---------------------------------------------------------------------------------------------------

    def diff(self, patch: DataFrame, outline: DataFrame | None = None) -> DataFrame:
        """Files and hunks of a patch (patch, line, text) with the definition that holds each hunk."""
        changed = patches.hunks(patch).join(patches.files(patch), ["patch", "file"])
        changed = changed.withColumn("begin", F.col("new_start")).withColumn("end", F.col("new_start") + F.greatest(F.col("new_lines"), F.lit(1)) - 1)
        entries = syntax.outline(self.files.filter(paths.language(F.col("name")) == "python")).withColumn("ord", F.col("id")) if outline is None else outline
        held = spans.enclosing(changed.select("path", "begin", "end").distinct(), entries.filter("kind <> 'import'").select("path", "ord", "first", "last", "kind", "name"))
        return changed.join(held, ["path", "begin", "end"], "left").drop("ord")

    def review(self, patch: DataFrame, outline: DataFrame | None = None) -> DataFrame:
        """The changed functions of a patch, each once, without those of deleted files, and how many call sites there are by that name."""
        found = self.diff(patch, outline).filter("kind = 'function' and status <> 'deleted'").select("patch", "path", "name", "first", "last").distinct()
        return found.join(self.calls().groupBy(F.col("callee").alias("name")).agg(F.count("*").alias("n_calls")), "name", "left").na.fill(0, ["n_calls"])

    def compare(self, left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
        """What two functions (path, name) have in common and what only one has: their calls and member accesses, as often as each occurs."""
        def features(path: str, name: str) -> DataFrame:
            own = self.files.filter(F.col("path") == path)
            calls = syntax.calls(own).filter(F.col("caller") == name).select(F.concat(F.lit("call "), "callee").alias("feature"))
            return calls.unionByName(syntax.accesses(own).filter(F.col("function") == name).select(F.concat("access", F.lit(" "), "member").alias("feature")))

        return graph.multiset_compare(features(*left), features(*right), "feature")


def assessed(sites: DataFrame, most: int = 10) -> DataFrame:
    """field, key and n: call sites by kind of file (test or production), receiver and file."""
    kind = F.when(paths.is_test_path_of_terms(F.col("path")), "test").otherwise("production")
    told = sites.select(kind.alias("kind"), F.coalesce("receiver", F.lit("<none>")).alias("receiver"), F.col("path").alias("file"))
    counted = told.groupingSets([["kind"], ["receiver"], ["file"]], "kind", "receiver", "file").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    named = counted.select(F.when(F.col("g") == 3, "kind").when(F.col("g") == 5, "receiver").otherwise("file").alias("field"), F.coalesce("kind", "receiver", "file").alias("key"), "n")
    from corvane.operators import budget

    return budget.first_of(named, "field", [F.desc("n"), F.col("key")], most).drop("more")
