"""Callers of a symbol, hop by hop, and how call sites are filtered, ordered and counted.

A call site has path, line, caller, callee, receiver, args and text. A search is bounded by its caps (names followed a hop, edges in all), so the driver
holds at most that many rows: each hop is one filter and one top-k over the call sites.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import code, paths
from corvane.functions.text import path_contains
from corvane.operators.search import qualifiers

TOP_LEVEL = "<top-level>"
FIELDS = {"args": "args", "caller": "caller", "receiver": "receiver", "recv": "receiver", "prefix": "receiver", "qual": "receiver", "path": "path", "file": "file"}


def terminal(name: str) -> str:
    """What follows the last . or :: of a name; what comes before one at its end."""
    at, width, k = -1, 0, 0
    while k < len(name):
        step = 2 if name.startswith("::", k) else 1
        if step == 2 or name[k] == ".":
            at, width = k, step
        k += step
    if at < 0:
        return name
    return name[at + width :] or name[:at]


@dataclass
class Traced:
    edges: list[tuple] = field(default_factory=list)  # hop, caller, path, line, callee, text
    hubs_skipped: list[str] = field(default_factory=list)
    hubs_found: dict[str, int] = field(default_factory=dict)
    frontier_cuts: list[tuple[int, int]] = field(default_factory=list)
    edges_cut_at: int | None = None
    top_level: int = 0
    unresolved: int = 0
    depth: int = 0

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.edges, "hop int, caller string, path string, line long, callee string, text string")


def callers(calls: DataFrame, root: str, max_depth: int = 2, max_frontier: int = 50, max_edges: int = 500, skip: tuple[str, ...] = (), hub: int = 200) -> Traced:
    """Call sites of the root, of its callers and so on, for five hops at most.

    A caller in a file is followed once. From the second hop on names in ``skip``, and those that had ``hub`` call sites in a hop before, aren't followed;
    of what is left the first ``max_frontier`` by name are. The search ends with ``max_edges`` edges, taken by path, line, callee and caller.
    """
    if not 1 <= max_depth <= 5:
        raise ValueError("a search has one to five hops")
    out, visited, hubs = Traced(), set(), set()
    frontier = {terminal(root)}
    for hop in range(1, max_depth + 1):
        names = sorted(frontier)
        if hop > 1:
            out.hubs_skipped += [n for n in names if n in skip or n in hubs]
            names = [n for n in names if n not in skip and n not in hubs]
        if len(names) > max_frontier:
            out.frontier_cuts.append((hop, len(names)))
            names = names[:max_frontier]
        if not names:
            break
        left = max_edges - len(out.edges)
        found = calls.filter(F.col("callee").isin(*names)).select("path", "line", "callee", "caller", "text").orderBy("path", "line", "callee", "caller", "text").limit(left).collect()
        frontier, hit, tally = set(), set(), {}
        for r in found:
            hit.add(r.callee)
            tally[r.callee] = tally.get(r.callee, 0) + 1
            if r.caller == TOP_LEVEL:
                out.top_level += 1
            elif (r.caller, r.path) not in visited:
                visited.add((r.caller, r.path))
                frontier.add(terminal(r.caller))
            out.edges.append((hop, r.caller, r.path, r.line, r.callee, ((r.text or "").splitlines() or [""])[0].strip()))
        out.depth = hop
        if len(out.edges) >= max_edges:
            out.edges_cut_at = hop
            break
        for name, n in tally.items():
            if n >= hub and name not in hubs:
                hubs.add(name)
                out.hubs_found[name] = n
        out.unresolved += len(set(names) - hit)
    out.edges.sort(key=lambda e: (e[0], e[2], e[3], e[4], e[1]))
    return out


def suspicious_hops(edges: DataFrame, least: int = 50, share: tuple[int, int] = (1, 5)) -> DataFrame:
    """hop, total and related of hops from the second on with at least ``least`` edges, of which less than ``share`` are in a folder that the hop before has."""
    placed = edges.select("hop", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"))
    before = placed.select((F.col("hop") + 1).alias("hop"), "dir").distinct().withColumn("near", F.lit(1))
    told = placed.join(before, ["hop", "dir"], "left").groupBy("hop").agg(F.count("*").alias("total"), F.count("near").alias("related"))
    earlier = placed.select((F.col("hop") + 1).alias("hop")).distinct()
    return told.join(earlier, "hop", "left_semi").filter((F.col("hop") >= 2) & (F.col("total") >= least) & (F.col("related") * share[1] < F.col("total") * share[0]))


def shown_field(name: str) -> Column:
    """A call site's value of a field, as text; what isn't known has a name too."""
    name = FIELDS[name]
    file = F.element_at(F.split("path", "/"), -1)
    return {"args": F.coalesce(F.col("args").cast("string"), F.lit("?")), "caller": F.col("caller"), "receiver": F.coalesce("receiver", F.lit("<none>")), "path": F.col("path"), "file": F.when(file == "", "<unknown>").otherwise(file)}[name]


def count_by(calls: DataFrame, name: str) -> DataFrame:
    return calls.groupBy(shown_field(name).alias("key")).agg(F.count("*").alias("n"))


def filtered(calls: DataFrame, text: str) -> DataFrame:
    """Call sites that meet all qualifiers: args, caller, receiver (and its other names), path, file (a part of the path), text."""
    out = calls
    for name, value in qualifiers(text, (*FIELDS, "text")):
        name = FIELDS.get(name, name)
        if name == "args":
            out = out.filter(F.col("args") == int(value)) if value.isdigit() and int(value) < 256 else out.filter(F.lit(False))
        elif name in ("caller", "receiver"):
            out = out.filter(F.col(name) == value)
        else:
            out = out.filter(path_contains(F.col("path"), value) if name == "path" else F.contains("path" if name == "file" else "text", F.lit(value)))
    return out


def repeated(calls: DataFrame) -> DataFrame:
    """With ``repeated``: a later line of a caller in a file than its first."""
    return calls.withColumn("repeated", F.col("line") > F.min("line").over(Window.partitionBy("path", "caller")))


def order(context: str | None = None) -> list[Column]:
    """The order of call sites that ``repeated`` has marked: the context file, named callers, first lines, telling receivers, short paths."""
    first = [F.col("path") != context] if context else []
    return [*first, F.col("caller") == TOP_LEVEL, F.col("repeated"), code.receiver_rank(F.col("receiver")), F.size(paths.parts(F.col("path"))), F.col("path"), F.col("line")]


def second_hop(calls: DataFrame, root: str, few: int = 10, most: int = 15) -> DataFrame:
    """Call sites of the root's callers, if those are ``few`` at most: without places of the first hop, one for each caller and file, the first ``most`` by path and line."""
    first = calls.filter(F.col("callee") == root)
    names = [r[0] for r in first.filter(F.col("caller") != TOP_LEVEL).select("caller").distinct().limit(few + 1).collect()]
    if not names or len(names) > few:
        return calls.limit(0)
    found = calls.filter(F.col("callee").isin(*sorted({terminal(n) for n in names}))).join(first.select("path", "line"), ["path", "line"], "left_anti")
    ranked = found.withColumn("__k", F.row_number().over(Window.partitionBy("caller", "path").orderBy("line", "callee", "receiver", "args")))
    return ranked.filter("__k = 1").drop("__k").orderBy("path", "line", "caller").limit(most)


def unique_predecessors(links: DataFrame, hops: int = 3) -> DataFrame:
    """(node, start, hops): back from each node over single incoming links, ``hops`` at most; none where several come in or a node comes again."""
    hops = max(1, min(hops, 3))
    incoming = links.groupBy(F.col("dst").alias("__at")).agg(F.count("*").alias("__n"), F.min("src").alias("__from"))
    walk = links.select(F.col("dst").alias("node")).distinct().select("node", F.col("node").alias("at"), F.lit(0).alias("hops"), F.array("node").alias("seen"), F.lit(True).alias("good"))
    for _ in range(hops):
        met = walk.join(incoming, walk.at == F.col("__at"), "left")
        again = F.array_contains("seen", F.col("__from"))
        moves = F.col("good") & F.col("__n").isNotNull()
        walk = met.select(
            "node", F.when(moves, F.col("__from")).otherwise(F.col("at")).alias("at"), (F.col("hops") + moves.cast("int")).alias("hops"), F.when(moves, F.concat("seen", F.array("__from"))).otherwise(F.col("seen")).alias("seen"),
            F.when(moves, (F.col("__n") == 1) & ~again).otherwise(F.col("good")).alias("good"),
        )
    return walk.filter("good").select("node", F.col("at").alias("start"), "hops")
