"""Candidates from all phases, none reported twice."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

#: Confidence 1.0 is for equal signatures alone.
MOST = 0.99


def assemble(exact: DataFrame, fuzzy: DataFrame, business: DataFrame, labels: DataFrame, usage: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """``master_id, slave_id, detection_type, confidence``.

    Phases in order: exact, fuzzy, business, labels, usage, semantic. A list that is a
    slave already is not reported again by a later phase; fuzzy pairs stay together
    as chains, unless their first list is an exact slave. ``fuzzy``: ``a, b, score``;
    ``semantic``: ``a, b, score, phase, rank`` (order of emission).
    """
    kind = lambda df, name, c: df.select("master_id", "slave_id", F.lit(name).alias("detection_type"), F.lit(c).cast("double").alias("confidence"))
    slaves = lambda df: df.select("slave_id").distinct()
    out = [kind(exact, "exact", 1.0)]
    used = slaves(out[0])
    free = fuzzy.join(used.withColumnRenamed("slave_id", "a"), "a", "left_anti")
    out.append(free.select(F.col("a").alias("master_id"), F.col("b").alias("slave_id"), F.lit("fuzzy").alias("detection_type"), F.least("score", F.lit(MOST)).alias("confidence")))
    used = used.unionByName(slaves(out[1])).distinct()
    for groups, name, c in ((business, "exact_business", 0.98), (labels, "labels", 0.95), (usage, "usage", 0.85)):
        out.append(kind(groups.join(used, "slave_id", "left_anti"), name, c))
        used = used.unionByName(slaves(out[-1])).distinct()
    if semantic is not None:
        free = semantic.join(used.withColumnRenamed("slave_id", "b"), "b", "left_anti")
        first = free.groupBy("b").agg(F.min_by(F.struct("a", "score", "phase"), "rank").alias("x"))
        out.append(first.select(
            F.col("x.a").alias("master_id"), F.col("b").alias("slave_id"), F.when(F.col("x.phase") == "direct", "semantic_list").otherwise("semantic_var").alias("detection_type"), F.least(F.round("x.score", 4), F.lit(MOST)).alias("confidence")
        ))
    return reduce(DataFrame.unionByName, out)
