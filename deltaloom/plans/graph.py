"""Longest weighted paths of a call graph, settled from the leaves up.

A caller is settled once all its callees are: a round joins the edges with the nodes that the round
before settled, so each edge is used once and there are as many rounds as the deepest path has calls,
with no bound on it. Callers that are never settled lie on a cycle or call into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def settled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(start, depth, cost) of callers all whose paths end, and (caller) of the others; edges (caller, callee, w) with a null end are left out."""
    edges = written(edges.where("caller is not null and callee is not null").select("caller", "callee", F.col("w").cast("long").alias("w")), "edges")
    waiting = written(edges.groupBy("caller").agg(F.count("*").alias("left"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("cost")), "waiting")
    leaves = edges.select(F.col("callee").alias("node")).distinct().join(waiting.select(F.col("caller").alias("node")), "node", "left_anti")
    new, done = leaves.select("node", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("cost")), None
    while True:
        below = new.select(F.col("node").alias("callee"), F.col("depth").alias("d"), F.col("cost").alias("c"))
        met = edges.join(below, "callee").groupBy("caller").agg(F.count("*").alias("n"), F.max(F.col("d") + 1).alias("d"), F.max(F.col("c") + F.col("w")).alias("c"))
        step = waiting.join(met, "caller", "left")
        step = step.select("caller", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), F.greatest("depth", "d").alias("depth"), F.greatest("cost", "c").alias("cost"))
        step = written(step, "waiting")
        new, waiting = step.where("left = 0").select(F.col("caller").alias("node"), "depth", "cost"), step.where("left > 0")
        if new.isEmpty():
            empty = new.select(F.col("node").alias("start"), "depth", "cost")
            return empty if done is None else done, waiting.select("caller")
        rows = new.select(F.col("node").alias("start"), "depth", "cost")
        done = rows if done is None else done.unionByName(rows)


def longest_paths(edges: DataFrame) -> DataFrame:
    """(start, depth, cost) over edges (caller, callee, w): from each caller, the most calls and the greatest weight; a cycle is refused."""
    done, stuck = settled(edges)
    if not stuck.isEmpty():
        raise ValueError(f"calls come back to where they began, as from {stuck.first()['caller']}")
    return done


def has_cycle(edges: DataFrame) -> bool:
    """Whether some path comes back to a node that it left."""
    return not settled(edges)[1].isEmpty()
