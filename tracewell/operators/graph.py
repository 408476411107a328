"""Directed graphs as edge tables: closures, cycles, order."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.errors import LimitExceeded
from tracewell.session import cut_lineage

#: A graph that is worked on by the driver has at most so many edges; larger ones are refused, not cut.
DRIVER_EDGES = 1_000_000


def closure(edges: DataFrame, seeds: DataFrame | None = None, most_rounds: int = 64) -> DataFrame:
    """(origin, node): what each origin reaches along src -> dst, in one step or more.

    edges: src, dst; seeds: a column ``origin``, every source of an edge unless given. Only newly reached pairs are
    extended, so cycles end; each round's result is checkpointed, so plans stay short and a lost executor costs one
    round. More rounds than ``most_rounds`` are an error, not a cut result.
    """
    step = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    start = seeds.select("origin").distinct() if seeds is not None else step.select(F.col("src").alias("origin")).distinct()
    fresh = cut_lineage(start.join(step, F.col("origin") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct(), eager=True)
    known = fresh
    for _ in range(most_rounds):
        if fresh.isEmpty():
            return known
        reached = fresh.join(step, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        fresh = cut_lineage(reached.join(known, ["origin", "node"], "left_anti"), eager=True)
        known = known.unionByName(fresh)
    raise LimitExceeded(f"paths are longer than {most_rounds} steps")


def _settled(rows: DataFrame, most_rounds: int, step: Callable[[DataFrame], DataFrame], size: Callable[[DataFrame], object]) -> DataFrame:
    """step applied, with the lineage cut, until size stays the same."""
    was = size(rows)
    for _ in range(most_rounds):
        rows = cut_lineage(step(rows), eager=True)
        now = size(rows)
        if now == was:
            return rows
        was = now
    raise LimitExceeded(f"not settled after {most_rounds} rounds")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source is some edge's target and whose target is some edge's source."""
    into, from_ = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(into, "src", "left_semi").join(from_, "dst", "left_semi").select("src", "dst")


def mutual(edges: DataFrame, most_rounds: int = 256) -> DataFrame:
    """(component, node): nodes on a cycle; a component is named after its smallest node.

    Edges that no cycle can hold are trimmed; every node takes the greatest name that reaches it, and what reaches a
    node of its own name back, within that name, is that node's component; components are taken out and the rest goes
    on. A round is joins of edges and nodes, never of pairs of nodes. More rounds than ``most_rounds`` are an error.
    """
    rest = cut_lineage(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), eager=True)
    out: DataFrame | None = None
    for _ in range(most_rounds):
        rest = _settled(rest, most_rounds, _trimmed, lambda e: e.count())
        if rest.isEmpty():
            break
        nodes = rest.select(F.col("src").alias("node")).union(rest.select(F.col("dst").alias("node"))).distinct().withColumn("color", F.col("node"))

        def painted(n: DataFrame, rest: DataFrame = rest) -> DataFrame:
            brought = rest.join(n, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("brought"))
            return n.join(brought, "node", "left").select("node", F.greatest("color", F.coalesce("brought", "color")).alias("color"))

        colors = _settled(cut_lineage(nodes, eager=True), most_rounds, painted, lambda n: n.agg(F.bit_xor(F.xxhash64("node", "color")), F.count(F.lit(1))).first())
        a, b = (colors.select(F.col("node").alias(c), F.col("color").alias(f"color_{c}")) for c in ("src", "dst"))
        inner = cut_lineage(rest.join(a, "src").join(b, "dst").where("color_src = color_dst").select("src", "dst"), eager=True)
        heads = colors.where("node = color")

        def back(n: DataFrame, inner: DataFrame = inner) -> DataFrame:
            return n.union(inner.join(n, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "color")).distinct()

        found = _settled(cut_lineage(heads, eager=True), most_rounds, back, lambda n: n.count())
        loops = inner.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
        named = found.join(loops, "node", "left").groupBy("color").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n"), F.count("loop").alias("loops")).where("n > 1 OR loops > 0")
        part = found.join(named, "color").select("component", "node")
        out = part if out is None else out.unionByName(part)
        gone = found.select("node")
        rest = cut_lineage(rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), eager=True)
    else:
        raise LimitExceeded(f"components are not found in {most_rounds} rounds")
    return out if out is not None else rest.select(F.col("src").alias("component"), F.col("src").alias("node"))


def bounded_edges(edges: DataFrame, most: int = DRIVER_EDGES) -> list[tuple[str, str]]:
    """A bounded graph for the driver's algorithms; a larger one is refused."""
    rows = edges.select("src", "dst").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise LimitExceeded(f"more than {most} edges")
    return sorted((r[0], r[1]) for r in rows)


def components(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Cycles' members: strongly connected components of two nodes or more, and nodes with an edge to themselves."""
    out: dict[str, list[str]] = defaultdict(list)
    nodes = sorted({x for e in edges for x in e})
    for a, b in edges:
        out[a].append(b)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    path: list[str] = []
    found = []
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        path.append(root), on.add(root)
        while work:
            node, rest = work[-1]
            for n in rest:
                if n not in index:
                    index[n] = low[n] = len(index)
                    path.append(n), on.add(n)
                    work.append((n, iter(out[n])))
                    break
                if n in on:
                    low[node] = min(low[node], index[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while True:
                        n = path.pop()
                        on.discard(n)
                        group.append(n)
                        if n == node:
                            break
                    if len(group) > 1 or node in out[node]:
                        found.append(sorted(group))
    return sorted(found)


def cycle_path(edges: list[tuple[str, str]], members: list[str]) -> list[str]:
    """One cycle through the smallest member, its edges taken in sorted order; shortest by number of steps."""
    inside = set(members)
    out: dict[str, list[str]] = defaultdict(list)
    for a, b in sorted(edges):
        if a in inside and b in inside:
            out[a].append(b)
    start = members[0]
    came: dict[str, str] = {}
    wave = [start]
    while wave:
        following = []
        for node in wave:
            for n in out[node]:
                if n == start:
                    path = [start, node] if node != start else [start]
                    while path[-1] != start:
                        path.append(came[path[-1]])
                    return ([start] + path[1:-1][::-1] + [start]) if node != start else [start, start]
                if n not in came:
                    came[n] = node
                    following.append(n)
        wave = following
    return []


def topological(edges: list[tuple[str, str]], nodes: list[str] = ()) -> list[str] | None:
    """Nodes in an order that follows every edge, the largest name first among those that are free; None if cyclic."""

    class Largest(str):
        def __lt__(self, other: str) -> bool:
            return str.__gt__(self, other)

    waits: dict[str, int] = {n: 0 for n in nodes}
    out: dict[str, list[str]] = defaultdict(list)
    for a, b in set(edges):
        out[a].append(b)
        waits[b] = waits.get(b, 0) + 1
        waits.setdefault(a, 0)
    free = [Largest(n) for n, w in waits.items() if not w]
    heapq.heapify(free)
    order = []
    while free:
        n = str(heapq.heappop(free))
        order.append(n)
        for m in out[n]:
            waits[m] -= 1
            if not waits[m]:
                heapq.heappush(free, Largest(m))
    return order if len(order) == len(waits) else None
