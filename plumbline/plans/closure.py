"""Reachability over dependency edges, by condensation.

Nodes that reach each other are one component, and components are numbered so
that what one reaches by the edges of a spanning forest is one span of numbers.
A component's whole reach is then a few disjoint spans, however many nodes they
hold: one for a chain or a tree.  Pairs of nodes are made by Spark, and only for
the sources that are asked for; whether a source reaches a target is a join on
the source's component and a comparison with its spans.

A build graph's edges go to the driver behind a count (``LOCAL_EDGES``), which
keeps numbers for nodes and edges, never pairs, and at most ``LOCAL_SPANS`` spans.
Beyond either bound Spark closes the pairs by path doubling: each round joins what
is reached in fewer than 2**k steps with the walks of 2**k steps, so rounds grow with
the logarithm of the longest path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plumbline.runtime import Scratch

#: Edges and nodes of a build graph that are numbered on the driver at most, and spans that it may make of them.
LOCAL_EDGES, LOCAL_SPANS = 1_000_000, 4_000_000


@dataclass
class Reach:
    """members: (node, component, number), the number of its component; spans: (component, low, high), the numbers it reaches, both ends included."""

    members: DataFrame
    spans: DataFrame

    def pairs(self, sources: DataFrame | None = None) -> DataFrame:
        """(source, reached) of the asked nodes (one column), of all if none are given; nodes outside the graph reach nothing."""
        own = self.members.select(F.col("node").alias("source"), "component")
        if sources is not None:
            own = own.join(sources.toDF("source").distinct(), "source", "left_semi")
        numbers = own.join(self.spans, "component").select("source", F.explode(F.sequence("low", "high")).alias("number"))
        return numbers.join(self.members.select("number", F.col("node").alias("reached")), "number").select("source", "reached")

    def sees(self, rows: DataFrame, source: str, target: str) -> DataFrame:
        """The rows whose source reaches their target; no pair is made that is not asked for."""
        at = self.members.select(F.col("node").alias("#target"), F.col("number").alias("#number"))
        by = self.members.select(F.col("node").alias("#source"), "component").join(self.spans, "component").select("#source", "low", "high")
        met = rows.join(at, rows[target] == F.col("#target")).join(by, (rows[source] == F.col("#source")) & F.col("#number").between(F.col("low"), F.col("high")))
        return met.select(*(rows[c] for c in rows.columns))


def components(n: int, follow: list[list[int]]) -> tuple[list[int], list[int]]:
    """(component of each node, first node of each component), components in an order where each comes after all it reaches."""
    order, low, component = [0] * n, [0] * n, [-1] * n
    stack: list[int] = []
    firsts: list[int] = []
    clock = 0
    for root in range(n):
        if order[root]:
            continue
        clock += 1
        order[root] = low[root] = clock
        stack.append(root)
        path = [(root, iter(follow[root]))]
        while path:
            node, rest = path[-1]
            for x in rest:
                if not order[x]:
                    clock += 1
                    order[x] = low[x] = clock
                    stack.append(x)
                    path.append((x, iter(follow[x])))
                    break
                if component[x] < 0:
                    low[node] = min(low[node], order[x])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == order[node]:
                    firsts.append(node)
                    while component[node] < 0:
                        component[stack.pop()] = len(firsts) - 1
    return component, firsts


def merged(parts: list[np.ndarray]) -> np.ndarray:
    """Disjoint spans, sorted, of spans that may overlap or touch; one row each: low, high."""
    every = np.concatenate(parts)
    every = every[np.argsort(every[:, 0], kind="stable")]
    high = np.maximum.accumulate(every[:, 1])
    new = np.r_[True, every[1:, 0] > high[:-1] + 1]
    return np.column_stack([every[new, 0], high[np.r_[np.flatnonzero(new)[1:] - 1, len(every) - 1]]])


def numbered(size: int, follow: list[set[int]], most: int) -> tuple[list[int], list[np.ndarray]] | None:
    """(number, spans) of each component; follow: what each leads to, earlier ones only. None beyond ``most`` spans."""
    number, low = [-1] * size, [0] * size
    count = 0
    for root in reversed(range(size)):  # a component that others reach comes after them
        if number[root] >= 0:
            continue
        number[root] = -2
        path = [(root, iter(sorted(follow[root], reverse=True)))]
        low[root] = count
        while path:
            node, rest = path[-1]
            for x in rest:
                if number[x] == -1:
                    number[x], low[x] = -2, count
                    path.append((x, iter(sorted(follow[x], reverse=True))))
                    break
            else:
                number[node] = count
                count += 1
                path.pop()
    spans: list[np.ndarray] = []
    total = 0
    for k in range(size):
        own = np.array([[low[k], number[k]]], np.int64)
        spans.append(merged([own, *(spans[x] for x in follow[k])]) if follow[k] else own)
        total += len(spans[-1])
        if total > most:
            return None
    return number, spans


def condensed(nodes: DataFrame, edges: DataFrame, local: int = LOCAL_EDGES, most: int = LOCAL_SPANS) -> Reach | None:
    """The reach of all nodes (one column) over edges (from, to); None for graphs beyond the bounds. Edges with an end outside the nodes lead on like any other."""
    spark = nodes.sparkSession
    known, pairs = nodes.toDF("n").where("n is not null").distinct(), edges.toDF("a", "b").where("a is not null and b is not null").distinct()
    if pairs.limit(local + 1).count() > local or known.limit(local + 1).count() > local:
        return None
    given = [r[0] for r in known.collect()]  # LOCAL_EDGES at most
    ids = {x: k for k, x in enumerate(given)}
    follow: list[list[int]] = [[] for _ in given]
    for a, b in pairs.collect():  # LOCAL_EDGES at most
        for x in (a, b):
            if x not in ids:
                ids[x] = len(follow)
                follow.append([])
        follow[ids[a]].append(ids[b])
    component, firsts = components(len(follow), follow)
    after: list[set[int]] = [set() for _ in firsts]
    for k, to in enumerate(follow):
        after[component[k]].update(component[x] for x in to)
    for k, to in enumerate(after):
        to.discard(k)
    found = numbered(len(firsts), after, most)
    if found is None:
        return None
    number, spans = found
    field = StructField("node", known.schema["n"].dataType)
    schema = StructType([field, StructField("component", LongType()), StructField("number", LongType())])
    members = spark.createDataFrame([(x, component[k], number[component[k]]) for x, k in ids.items() if k < len(given)], schema)
    rows = np.concatenate([np.column_stack([np.full(len(s), k), s]) for k, s in enumerate(spans)]) if spans else np.zeros((0, 3), np.int64)
    return Reach(members, _frame(spark, rows))


def _frame(spark: SparkSession, rows: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(rows, columns=["component", "low", "high"]), "component long, low long, high long")


def doubled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(source, reached)`` by path doubling, all in Spark."""
    scratch = Scratch(nodes.sparkSession, "closure")
    walks = scratch.save(edges.toDF("a", "b").where("a is not null and b is not null and a <> b").distinct(), "walks-0")
    reached = scratch.save(nodes.toDF("n").where("n is not null").distinct().select(F.col("n").alias("source"), F.col("n").alias("reached")), "reached-0")
    size, k = reached.count(), 0
    while not walks.isEmpty():
        k += 1
        further = reached.join(walks, reached["reached"] == walks["a"]).select("source", F.col("b").alias("reached"))
        reached = scratch.save(reached.union(further).distinct(), f"reached-{k}")
        grown = reached.count()
        if grown == size:
            break
        size = grown
        ahead = walks.select(F.col("a").alias("b"), F.col("b").alias("c"))
        walks = scratch.save(walks.join(ahead, "b").select("a", F.col("c").alias("b")).where("a <> b").distinct(), f"walks-{k}")
        scratch.drop(f"reached-{k - 1}", f"walks-{k - 1}")
    return reached


def closure(nodes: DataFrame, edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """``(source, reached)`` for every node, itself included; cycles are allowed.

    nodes: one column; edges: (from, to).  What is reached is a node of the graph
    or the end of an edge.  Callers that ask for few sources, or for given pairs,
    use ``condensed`` and make no other pair.
    """
    ends = edges.toDF("a", "b")
    every = nodes.toDF("n").union(ends.select("b"))
    found = condensed(every, edges, local)
    asked = nodes.toDF("n").where("n is not null").distinct()
    if found is not None:
        return Scratch(nodes.sparkSession, "closure").save(found.pairs(asked), "pairs")
    return doubled(asked, edges)


def reverse(pairs: DataFrame) -> DataFrame:
    """Who reaches a node: the pairs turned round."""
    return pairs.select(F.col("reached").alias("source"), F.col("source").alias("reached"))
