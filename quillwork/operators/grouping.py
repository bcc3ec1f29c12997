"""Pairs to groups: fusion, connected components, parents, links."""

from __future__ import annotations

import tempfile
import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder of ``spark.checkpoint.dir``; where that is unset, a session in one process gets a temporary one, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillwork-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/quillwork-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition: list[str] | None = None, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path, partitionBy=partition)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges (a, b)``; comp is the smallest node reachable.

    Every round each node points to its smallest neighbour or itself, pointers are
    followed once more, and the edges are rewritten between what is pointed to.
    """
    edges = written(edges.where("a <> b").select("a", "b"), "edges")
    labels = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("comp", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        further = hop.select(F.col("a").alias("to"), F.col("to").alias("end"))
        hop = written(hop.join(further, "to").select("a", F.col("end").alias("to")), "hop")
        labels = written(labels.join(hop.withColumnRenamed("a", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        edges = written(
            edges.join(hop, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(hop, "a")
            .select(F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b")).where("a <> b").distinct(),
            "edges",
        )
    return labels


def fuse_pairs(candidates: DataFrame) -> DataFrame:
    """Per pair of ids, whatever their order: sorted types and the largest confidence."""
    return candidates.groupBy(F.least("master_id", "slave_id").alias("a"), F.greatest("master_id", "slave_id").alias("b")).agg(
        F.array_sort(F.collect_set("detection_type")).alias("types"), F.max("confidence").alias("confidence")
    )


def links(pairs: DataFrame) -> DataFrame:
    """Each member's fused pairs, both ways: ``id, links`` ordered by the other id."""
    ways = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "types", "confidence").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "types", "confidence"))
    return ways.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("other").alias("id"), "types", "confidence"))).alias("links"))


def choose_parent(members: DataFrame) -> DataFrame:
    """Per component: a registry list first, then a preferred one, then the first in order. ``comp, parent_id``."""
    rank = F.struct((F.col("origin") != "registry").alias("r"), (~F.col("preferred")).alias("p"), "ord")
    return members.groupBy("comp").agg(F.min_by("id", rank).alias("parent_id"))


def against_parent(members: DataFrame) -> DataFrame:
    """Types, confidence and ``via`` of members ``(parent_id, id, links)``.

    A direct pair with the parent decides alone; else all links together do, and
    ``via`` names what they lead to.
    """
    direct = F.filter("links", lambda x: x["id"] == F.col("parent_id"))
    is_direct = F.size(direct) > 0
    used = F.when(is_direct, direct).otherwise(F.col("links"))
    return members.withColumn("detection_types", F.array_sort(F.array_distinct(F.flatten(F.transform(used, lambda x: x["types"]))))).withColumn(
        "confidence", F.array_max(F.transform(used, lambda x: x["confidence"]))
    ).withColumn("via", F.when(is_direct, F.array().cast("array<long>")).otherwise(F.transform("links", lambda x: x["id"])))


def registry(candidates: DataFrame, lists: DataFrame) -> DataFrame:
    """One row per list: its parent (itself if it is one or unpaired), and how it was detected.

    ``lists (list_id, ord, origin, preferred)``; pairs with ids that are not in it are dropped.
    """
    known = lists.select(F.col("list_id").alias("id"), "ord", "origin", "preferred")
    ids = known.select("id")
    pairs = fuse_pairs(candidates.join(ids.withColumnRenamed("id", "master_id"), "master_id", "left_semi").join(ids.withColumnRenamed("id", "slave_id"), "slave_id", "left_semi"))
    pairs = written(pairs, "pairs")
    comps = components(pairs)
    members = written(known.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "members")
    placed = members.join(choose_parent(members), "comp").join(links(pairs), "id", "left")
    found = against_parent(placed.where(F.col("id") != F.col("parent_id"))).select("parent_id", "id", "ord", "detection_types", "confidence", "via")
    parents = placed.where(F.col("id") == F.col("parent_id")).select(
        "parent_id", "id", "ord", F.array().cast("array<string>").alias("detection_types"), F.lit(None).cast("double").alias("confidence"), F.array().cast("array<long>").alias("via")
    )
    return parents.unionByName(found)


def shared_vars(members: DataFrame) -> DataFrame:
    """Variables that all lists of a group share: ``group_id, shared_vars`` from ``group_id, list_id, vars``.

    Counted rather than intersected list by list: a variable is shared if as many
    lists of the group have it as the group has.
    """
    sizes = members.groupBy("group_id").agg(F.countDistinct("list_id").alias("n"))
    counts = members.select("group_id", "list_id", F.explode(F.array_distinct("vars")).alias("var")).distinct().groupBy("group_id", "var").agg(F.count("*").alias("m"))
    shared = counts.join(sizes, "group_id").where("m = n").groupBy("group_id").agg(F.array_sort(F.collect_list("var")).alias("shared_vars"))
    return sizes.select("group_id").join(shared, "group_id", "left").withColumn("shared_vars", F.coalesce("shared_vars", F.array().cast("array<string>")))
