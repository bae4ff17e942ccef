"""Connected components of a graph given as an edge table, by random contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.sources.storage import Scratch, written


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of the edges ``a, b``; two nodes share ``comp`` iff a path joins them.

    In each round a node moves to the neighbour (or itself) with the smallest hash of that round, and edges
    follow; a constant share of the nodes goes in each round, so chains and stars end after a
    logarithmic number. Loops and repeated edges do no harm; edges with a null end are left out.
    """
    scratch = Scratch(edges.sparkSession, "components")
    edges = scratch.write(edges.select("a", "b").where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = both.groupBy("a").agg(F.min(_rank("b", len(steps))).alias("near"))
        moved = scratch.write(moved.select(F.col("a").alias("node"), F.least("near", _rank("a", len(steps)))["to"].alias("to")), "moved")
        steps.append(moved)
        ends = moved.select(F.col("node").alias("a"), F.col("to").alias("x")), moved.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = edges.join(ends[0], "a").join(ends[1], "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = scratch.write(left.distinct(), "edges")
        scratch.drop(edges)
        edges = left
    out = steps[-1] if steps else edges.select(F.col("a").alias("node"), F.col("b").alias("to"))
    for moved in reversed(steps[:-1]):  # where a node moved to may have moved on
        later = out.select(F.col("node").alias("to"), F.col("to").alias("last"))
        out = moved.join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    out = written(out.withColumnRenamed("to", "comp"), "components")
    scratch.finish()
    return out


def _rank(column: str, round_: int) -> Column:
    return F.struct(F.xxhash64(F.col(column), F.lit(round_)).alias("h"), F.col(column).alias("to"))
