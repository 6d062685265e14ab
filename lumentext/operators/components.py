"""Connected components of an undirected graph, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 40) -> DataFrame:
    """(node, label) of every node on an edge; label: the smallest node of its component.

    Alternating large-star and small-star steps: each joins nothing but each edge with the least neighbour of
    one end, which is an aggregate with map-side combining, and the edges shrink to stars in a number of steps that
    grows with the logarithm of a component's size; it is an error if ``most`` do not suffice. Every step is written to the shared folder, and the last is known by
    the number and the hash of its edges. The centre of a large star is a hot key of the joins, which adaptive execution splits. Loops and repeated edges
    change nothing, NULL ends are left out, no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    now = materialize(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(now)
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of each node go to its least neighbour
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours of each node, and it, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, materialize(small, "star")
        discard(last)
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not found in {most} steps")
    labels = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct()).unionByName(
        e.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("label")).distinct().join(labels, "node", "left_anti").join(labels.select(F.col("label").alias("node")), "node", "left_anti")
    )
