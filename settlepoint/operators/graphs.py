"""Dependency graphs as edge tables (node depends on dep)."""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def levels(nodes: DataFrame, edges: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """node, level: the length of the longest chain of dependencies below each node; raises on a cycle.

    Each step moves the distinct frontier along the edges and writes it as one partition of a table, so a step's plan
    reads one table whatever the depth, a lost executor repeats one step, and work is bounded by nodes x depth.
    """
    spark, base = nodes.sparkSession, shared_path(nodes.sparkSession, "levels")
    edges = _written(edges.where("node <> dep").distinct(), f"{base}/edges")
    every = _written(nodes.select("node").distinct(), f"{base}/nodes")
    frontier, depth, n = _written(every.join(edges, "node", "left_anti"), f"{base}/found/level=0"), 0, every.count()
    while not frontier.isEmpty():
        depth += 1
        if depth > min(n, max_depth):
            raise ValueError("the graph has a cycle")
        above = edges.join(frontier.withColumnRenamed("node", "dep"), "dep", "left_semi").select("node").distinct()
        frontier = _written(above, f"{base}/found/level={depth}")
    found = spark.read.parquet(f"{base}/found")
    out = found.groupBy("node").agg(F.max("level").alias("level"))
    if out.count() < n:
        raise ValueError("the graph has a cycle")
    return out


def cycle_core(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, dep: the edges among nodes that are on a cycle or between two cycles; empty for a graph without cycles.

    Nodes without dependencies, and nodes that nothing depends on, are peeled off until none is left; what the peeling
    leaves is written each round. The graph is never in one task.
    """
    spark, step = nodes.sparkSession, 0
    base = shared_path(spark, "core")
    names = nodes.select("node")
    left = _written(edges.where("node <> dep").select("node", "dep").distinct().join(names, "node", "left_semi"), f"{base}/0")
    size = left.count()
    while size:
        step += 1
        kept = left.join(left.select(F.col("node").alias("dep")).distinct(), "dep", "left_semi")
        kept = kept.join(kept.select(F.col("dep").alias("node")).distinct(), "node", "left_semi")
        left = _written(kept.select("node", "dep"), f"{base}/{step}")
        now = left.count()
        if now == size:
            break
        size = now
    return left


def topological_order(edges: list[tuple], nodes: list | None = None) -> list:
    """Dependencies first, ties in sorted order, for a graph that fits the driver; raises on a cycle."""
    needs: dict = defaultdict(set)
    users: dict = defaultdict(set)
    every = set(nodes or [])
    for node, dep in edges:
        every |= {node, dep}
        if node != dep:
            needs[node].add(dep)
            users[dep].add(node)
    left = {n: len(needs[n]) for n in every}
    ready: list = []
    for n in every:
        if not left[n]:
            heappush(ready, n)
    out = []
    while ready:
        n = heappop(ready)
        out.append(n)
        for u in users[n]:
            left[u] -= 1
            if not left[u]:
                heappush(ready, u)
    if len(out) < len(every):
        raise ValueError(f"cycle: {find_cycle(edges)}")
    return out


def find_cycle(edges: list[tuple]) -> list | None:
    """One cycle as a list that begins and ends with the same node, or None; edges to itself are ignored."""
    needs: dict = defaultdict(list)
    for node, dep in edges:
        if node != dep:
            needs[node].append(dep)
    done: set = set()
    for start in sorted(needs):
        trail, at, walk = [start], {start: 0}, [iter(sorted(needs[start]))]
        while walk and start not in done:
            step = next(walk[-1], None)
            if step is None:
                done.add(trail[-1])
                del at[trail.pop()]
                walk.pop()
            elif step in at:
                return trail[at[step] :] + [step]
            elif step not in done:
                at[step] = len(trail)
                trail.append(step)
                walk.append(iter(sorted(needs.get(step, []))))
    return None


def _pairs(rows: pd.DataFrame) -> list[tuple]:
    """The edges with a dep; pandas holds whole numbers beside nulls as floats, so they get the nodes' type back."""
    rows = rows[rows["dep"].notna()]
    return list(zip(rows["node"].tolist(), rows["dep"].astype(rows["node"].dtype).tolist(), strict=True))


def topological_orders(edges: DataFrame, graph: str) -> DataFrame:
    """graph, node, position (from 0) for many graphs, each of which fits a task; raises on a cycle.

    edges has the graph, node and dep; a null dep names a node without dependencies.
    """
    kinds = dict(edges.dtypes)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order = topological_order(_pairs(rows), rows["node"].tolist())
        return pd.DataFrame({graph: [key[0]] * len(order), "node": order, "position": range(len(order))})

    return edges.select(graph, "node", "dep").distinct().groupBy(graph).applyInPandas(run, f"{graph} {kinds[graph]}, node {kinds['node']}, position bigint")


def cycles(edges: DataFrame, graph: str) -> DataFrame:
    """graph and one cycle (its first node is also its last) of each graph that has one; a graph fits a task."""
    kinds = dict(edges.dtypes)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = find_cycle(_pairs(rows))
        return pd.DataFrame([[key[0], found]] if found else [], columns=[graph, "cycle"])

    return edges.select(graph, "node", "dep").distinct().groupBy(graph).applyInPandas(run, f"{graph} {kinds[graph]}, cycle array<{kinds['node']}>")
