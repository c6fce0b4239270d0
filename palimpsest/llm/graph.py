"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(ws: Workspace, edges: DataFrame, label: str = "cc") -> DataFrame:
    """``node, root`` for every end of ``edges(a long, b long)``; root is the component's smallest node.

    Loops and repeated edges are allowed; nulls are not.  Each round is written to the
    shared folder, so lineage stays short.  Minima are written before they are joined, so
    that adaptive execution can split the join of a hub's neighbours.
    """
    norm = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now = ws.save(norm(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), f"{label}_0")
    for turn in range(1, 100):
        # large star: every larger neighbour of a node is tied to the least of the node and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ws.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{label}_l{turn}")
        large = ws.save(norm(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))), f"{label}_x{turn}")
        # small star: a node and its smaller neighbours are tied to the least of them
        small = ws.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}_s{turn}")
        tied = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        after = ws.save(norm(tied), f"{label}_{turn}")
        ws.drop(f"{label}_{turn - 1}", f"{label}_l{turn}", f"{label}_x{turn}", f"{label}_s{turn}")
        now = after
        # done when every tie leads to a root: no end has two ties, none is both below and above
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root"))
        ends = ends.unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if ends.where("up > 1 or up = 1 and root = 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("b").alias("root")))
