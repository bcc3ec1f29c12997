"""Connected components by repeated contraction, every round a written table."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .shared import written


def components(edges: DataFrame) -> DataFrame | None:
    """``node, comp`` for every node of ``edges (a, b)``; comp is the smallest node reachable.

    Each round every node points to its smallest neighbour (or itself), pointers
    are followed once more, and the edges are rewritten between what is pointed
    to; chains shrink geometrically. None if there is no edge.
    """
    edges = written(edges.where("a <> b").select("a", "b"), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        further = hop.select(F.col("a").alias("to"), F.col("to").alias("end"))
        hop = written(hop.join(further, "to").select("a", F.col("end").alias("to")), "hop")
        if labels is None:
            labels = hop.select(F.col("a").alias("node"), F.col("to").alias("comp"))
        else:
            labels = labels.join(hop.withColumnRenamed("a", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        labels = written(labels, "labels")
        edges = (
            edges.join(hop, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(hop, "a")
            .select(F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b")).where("a <> b").distinct()
        )
        edges = written(edges, "edges")
    return labels
