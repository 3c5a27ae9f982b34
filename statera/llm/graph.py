"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.llm.common import release, table


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node of edges (u, v), which are longs.

    Each round points a node at its smallest neighbour or itself, follows the pointers three steps on, and replaces the ends
    of each edge by what they point at; edges inside one node vanish. Only pointers and contracted edges are ever stored, in
    tables; the driver sees whether edges are left.
    """
    e = table(edges.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    roots = None
    while True:
        if not e.limit(1).count():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to")).select(F.col("u").alias("node"), "to"), "step")
        old = [step]
        for _ in range(2):
            nxt = step.select(F.col("node").alias("to"), F.col("to").alias("on"))
            step = table(step.join(nxt, "to").select("node", F.col("on").alias("to")), "step")
            old.append(step)
        if roots is None:
            roots = step.select("node", F.col("to").alias("root"))
        else:
            nxt = step.select(F.col("node").alias("root"), F.col("to").alias("on"))
            roots = roots.join(nxt, "root", "left").select("node", F.coalesce("on", "root").alias("root"))
        was = roots = table(roots, "roots")
        a = step.select(F.col("node").alias("u"), F.col("to").alias("a"))
        b = step.select(F.col("node").alias("v"), F.col("to").alias("b"))
        shrunk = e.join(a, "u").join(b, "v").filter("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        shrunk = table(shrunk, "edges")
        release(e, *old)
        e, roots = shrunk, was
    if roots is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots
