"""K-d tree sharding: nearly equal bytes from distributed weighted medians.

What is dealt out are units: the rows of one text, which stay together. A text
whose rows outweigh a shard is dealt in pieces. The root holds all units. Every
level splits each node that is still too large along its widest metadata dimension
where the bytes on either side are in proportion to the shards to come, and writes
each unit's new node. A cut is found in two grouped sums: over bins of the dimension
and, in the bin where the sum crosses its goal, over a hash, which splits units that
the dimension does not tell apart. Units that weigh much of a shard are cut first,
at their own median; the others then fill both sides up to the goal. All of it is
tables: nodes, sums and splits are as many as shards, and none comes to the driver.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from .shared import join_small, rank_id, text_or_empty, written

BINS, FINE = 1024, 4096
#: A unit of more than this part of a shard is heavy; so are at most this many times the shards.
HEAVY = 64
#: Pieces of a text that outweighs a shard have about this part of a shard.
PIECE = 8
#: Rows whose slots are numbered in one go, about.
SPAN = 1 << 14
#: Texts with more than one in so many of all rows are fewer than this many; they are broadcast.
HOT = 4096


def _on(dimensions: list[str], chosen: Column, prefix: str = "") -> Column:
    """The value of the chosen dimension."""
    value = F.lit(None).cast("double")
    for i, name in enumerate(dimensions):
        value = F.when(chosen == i, F.col(f"{prefix}{name}")).otherwise(value)
    return value


def kd_leaves(units: DataFrame, dimensions: list[str], parts: int, target: float | None = None, heavy: float | None = None) -> DataFrame:
    """``unit, shard`` for each of ``units (unit, weight, dimensions...)``.

    ``unit`` is a distinct long, ``weight`` a positive long. Makes ``parts`` leaves
    of nearly equal weight, numbered from 0 in the order of the tree (one may be
    empty where units are too few); with ``target`` every node is split until it
    weighs at most that or has one unit, and leaves have numbers without gaps.
    """
    at = written(units.select("unit", "weight", *(F.col(c).cast("double").alias(c) for c in dimensions), F.lit(1).cast("long").alias("node")), "units")
    whole = at.agg(F.sum("weight").alias("w"), *(f(c).alias(f"{k}_{c}") for c in dimensions for k, f in (("lo", F.min), ("hi", F.max)))).first()
    if whole["w"] is None:
        return at.select("unit", F.lit(0).alias("shard"))
    heavy = heavy or whole["w"] / parts / HEAVY
    some_heavy = not at.where(F.col("weight") > heavy).isEmpty()
    plan = at.sparkSession.createDataFrame([(1, parts, 0)], "node long, parts long, first long")
    while True:
        # Exact weights and extents of the nodes of this level; closed ones stay as they are.
        extents = at.groupBy("node").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in dimensions for k, f in (("lo", F.min), ("hi", F.max))))
        cells = extents.join(F.broadcast(plan), "node")
        if target:  # a node asks for what it weighs
            cells = cells.withColumn("parts", F.ceil(F.col("w") / target))
        wide = [(F.col(f"hi_{c}") - F.col(f"lo_{c}")) / F.lit(float(whole[f"hi_{c}"] - whole[f"lo_{c}"]) or 1.0) for c in dimensions]
        cells = cells.withColumn("dim", F.array_position(F.array(*wide), F.array_max(F.array(*wide))).cast("int") - 1)
        cells = written(
            cells.select("node", "w", "n", "parts", "first", "dim", _on(dimensions, F.col("dim"), "lo_").alias("lo"), _on(dimensions, F.col("dim"), "hi_").alias("hi"), F.ceil(F.col("parts") / 2).alias("left_parts")), "cells"
        )
        opened = cells.where("parts > 1 and n > 1")
        count = opened.count()
        if not count:
            break
        x = _on(dimensions, F.col("dim"))
        placed = join_small(at, opened.select("node", "w", "dim", "lo", "hi", (F.col("left_parts") / F.col("parts")).alias("share")), "node", count)
        placed = placed.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BINS - 1), F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))).otherwise(0).cast("int"))
        placed = placed.withColumn("fine", F.pmod(F.xxhash64("unit", "node"), F.lit(FINE)).cast("int"))

        goals = opened.select("node", (F.col("w") * F.col("left_parts") / F.col("parts")).alias("goal"))
        sides = None
        if some_heavy:
            order = Window.partitionBy("node").orderBy("bin", "fine", "unit")
            sums = placed.where(F.col("weight") > heavy).select("node", "unit", "weight", "share", "bin", "fine", F.sum("weight").over(order).alias("upto"), F.sum("weight").over(Window.partitionBy("node")).alias("all"))
            sides = written(sums.select("node", "unit", "weight", (F.col("upto") - F.col("weight") / 2 < F.col("all") * F.col("share")).alias("left")), "heavy")
            taken = sides.where("left").groupBy("node").agg(F.sum("weight").alias("taken"))
            goals = goals.join(taken, "node", "left").select("node", F.greatest(F.lit(0.0), F.col("goal") - F.coalesce("taken", F.lit(0))).alias("goal"))

        light = placed.where(F.col("weight") <= heavy)
        by_bin = light.groupBy("node", "bin").agg(F.sum("weight").alias("s")).withColumn("upto", F.sum("s").over(Window.partitionBy("node").orderBy("bin")))
        crossing = by_bin.join(goals, "node").where(F.col("upto") >= F.col("goal")).groupBy("node").agg(F.min(F.struct("bin", F.col("upto") - F.col("s"), "goal")).alias("c"))
        crossing = written(crossing.select("node", F.col("c.bin").alias("cut"), F.col("c.col2").alias("before"), F.col("c.goal").alias("goal")), "crossing")
        inside = join_small(light.select("node", "bin", "fine", "weight"), crossing, "node", count).where(F.col("bin") == F.col("cut"))
        by_fine = inside.groupBy("node", "fine").agg(F.sum("weight").alias("s"), F.first("before").alias("before"), F.first("goal").alias("goal"))
        by_fine = by_fine.withColumn("upto", F.col("before") + F.sum("s").over(Window.partitionBy("node").orderBy("fine")))
        # On either side of the crossing, whichever is nearer to the goal.
        nearer = F.when(F.col("goal") - (F.col("upto") - F.col("s")) > F.col("upto") - F.col("goal"), F.col("fine") + 1).otherwise(F.col("fine"))
        fine_cut = by_fine.where(F.col("upto") >= F.col("goal")).groupBy("node").agg(F.min(F.struct("fine", nearer.alias("fine_cut")))["fine_cut"].alias("fine_cut"))
        # Where the light units are too few for their goal, all of them go left.
        splits = opened.select("node").join(crossing, "node", "left").join(fine_cut, "node", "left").select("node", F.coalesce("cut", F.lit(BINS)).alias("cut"), F.coalesce("fine_cut", F.lit(FINE)).alias("fine_cut"))

        went = (F.col("bin") < F.col("cut")) | ((F.col("bin") == F.col("cut")) & (F.col("fine") < F.col("fine_cut")))
        moved = join_small(placed, splits, "node", count)
        if sides is not None:
            moved = join_small(moved, sides.select("unit", "left"), "unit", 2 * HEAVY * parts, how="left")
            went = F.coalesce("left", went)
        moved = moved.select("unit", "weight", *dimensions, (F.col("node") * 2 + F.when(went, 0).otherwise(1)).alias("node"))
        at = written(join_small(at, opened.select("node"), "node", count, how="left_anti").unionByName(moved), "units")
        left = F.struct((F.col("node") * 2).alias("node"), F.col("left_parts").alias("parts"), F.col("first").alias("first"))
        right = F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("parts") - F.col("left_parts")).alias("parts"), (F.col("first") + F.col("left_parts")).alias("first"))
        plan = cells.where("parts <= 1 or n <= 1").select("node", "parts", "first").unionByName(opened.select(F.inline(F.array(left, right))))
    leaves = cells.select("node", F.col("first").cast("int").alias("shard"))
    if target:
        # The path from the root as a fraction is the order of the leaves, which are as many as shards.
        path = F.col("node") / F.pow(F.lit(2.0), F.floor(F.log2("node")))
        leaves = cells.select("node", (F.row_number().over(Window.orderBy(path, "node")) - 1).alias("shard"))
    return join_small(at, leaves, "node", cells.count()).select("unit", "shard")


def _deal(rows: DataFrame, found: DataFrame, on: list[str], total: int) -> DataFrame:
    """Rows with what was found for their text; texts with very many rows are broadcast, so that no task gets them all."""
    most = max(1, total // HOT)
    hot = F.broadcast(found.where(F.col("n") > most))
    rest = rows.join(F.broadcast(found.where(F.col("n") > most).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(found.where(F.col("n") <= most), on))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, text_split`` for each input row.

    Give ``shards`` or ``target_bytes``, the most that a leaf should hold. Size is
    the UTF-8 length plus 1; null text counts as empty. Rows with equal texts go to
    one shard; only a text whose rows outweigh an even share is split, by a hash of
    its rows, and has ``text_split`` true. ``slot`` runs from 0 without gaps in each
    shard, in no meaningful order. ``grown_shard`` is null: under the law ``bytes`` a
    shard more is a new tree. The dimensions of a text are its size, its smallest
    id, and the ``extra`` columns of the row that has it; null or missing ones count
    as one value. Whole rows may repeat. An empty table gives no rows.
    """
    if shards is not None and shards < 1 or shards is None and (target_bytes or 0) < 1:
        raise ValueError("give a number of shards or a target of at least 1")
    extra = tuple(c for c in extra if c in docs.columns)
    group = ["text_hash", "text_crc32", "size"]
    rows = written(
        docs.select(rank_id(id_col).alias("rank"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"x_{c}") for c in extra))
        .select(
            "doc_id", "rank", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("text_hash"),
            *(F.pmod(F.xxhash64(f"x_{c}"), F.lit(BINS)).alias(f"d_{c}") for c in extra), F.monotonically_increasing_id().alias("row_key"),
        ),
        "sized",
    )
    dimensions = ["d_size", "d_id", *(f"d_{c}" for c in extra)]
    point = F.struct("rank", *(f"d_{c}" for c in extra))
    values = [F.log2("size").alias("d_size"), F.when(F.col("point.rank") < (1 << 62), F.col("point.rank")).otherwise(0).alias("d_id"), *(F.col(f"point.d_{c}").alias(f"d_{c}") for c in extra)]
    texts = written(rows.groupBy(*group).agg(F.min(point).alias("point"), F.count("*").alias("n"), F.sum("size").alias("weight")).select(*group, "n", "weight", *values, F.monotonically_increasing_id().alias("text_key")), "texts")
    total = texts.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).first()
    parts = shards or max(1, -(-(total["weight"] or 0) // target_bytes))
    even = (total["weight"] or 0) / parts

    # Texts that outweigh a shard are fewer than shards.
    pieces = F.when((F.col("weight") > even) & (F.col("n") > 1), F.least("n", F.ceil(F.col("weight") * PIECE / F.lit(max(even, 1.0))))).otherwise(1)
    texts = texts.withColumn("pieces", pieces)
    split = texts.where("pieces > 1")
    keyed = _deal(rows.select("doc_id", "size", "text_crc32", "text_hash", "row_key"), texts.select(*group, "n", "text_key", "pieces"), group, total["n"] or 0)
    keyed = written(keyed.select("doc_id", "size", "text_crc32", "row_key", "text_key", "n", "pieces", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("row_key"), F.col("pieces"))).otherwise(0).alias("piece")), "keyed")
    whole = texts.where("pieces = 1").select("text_key", F.lit(0).cast("long").alias("piece"), "n", "weight", *dimensions)
    broken = keyed.where("pieces > 1").groupBy("text_key", "piece").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).join(F.broadcast(split.select("text_key", *dimensions)), "text_key")
    units = written(whole.unionByName(broken).withColumn("unit", F.monotonically_increasing_id()), "dealt")
    leaves = kd_leaves(units, dimensions, parts, float(target_bytes) if shards is None else None, even / HEAVY)
    sharded = written(units.select("unit", "text_key", "piece", "n").join(leaves, "unit").drop("unit"), "sharded")
    placed = _deal(keyed.drop("n"), sharded, ["text_key", "piece"], total["n"] or 0)
    largest = sharded.groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    placed = written(placed.withColumn("part", F.pmod(F.xxhash64("row_key", F.lit("slot")), F.lit(-(-largest // SPAN) or 1))), "placed")

    # Numbers within small parts of a shard, then where each part starts: no task holds a whole shard.
    parts_n = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    starts = parts_n.withColumn("start", F.sum("rows").over(Window.partitionBy("shard").orderBy("part")) - F.col("rows")).drop("rows")
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("row_key"))).join(starts, ["shard", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), (F.col("pieces") > 1).alias("text_split")
    )


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)
