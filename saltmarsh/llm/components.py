"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.scratch import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the smallest node that it reaches, for each node of ``links`` (a, b).

    Each round moves every node to its smallest neighbour (or itself) and keeps the
    links between different images; rounds needed grow with the logarithm of the
    longest way. A node of any number of links costs one row in each map: minima are
    combined before the shuffle, and the joins' sides are written tables, whose hot
    keys Spark splits at run time.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    whole = None
    while edges.take(1):
        ends = edges.select(F.col("a").alias("node"), F.col("a").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        moved = materialize(ends.groupBy("node").agg(F.min("to").alias("to")), "moves")
        left, right = moved.select(F.col("node").alias("a"), F.col("to").alias("u")), moved.select(F.col("node").alias("b"), F.col("to").alias("v"))
        following = edges.join(left, "a").join(right, "b").where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        following = materialize(following, "links")
        if whole is None:
            whole = moved.select("node", F.col("to").alias("comp"))
        else:
            step = moved.select(F.col("node").alias("comp"), "to")
            before = whole
            whole = materialize(before.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "components")
            discard(before)
            discard(moved)
        discard(edges)
        edges = following
    if whole is None:
        return links.sparkSession.createDataFrame([], "node long, comp long")
    return whole
