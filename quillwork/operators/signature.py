"""Signatures of code lists and the groups of lists that share one.

Tables: ``lists (list_id, ord, ...)`` and ``codes (list_id, pos, value, label)`` with
normalised value and label. ``ord`` is document order: the first list of a group is
its master.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .grouping import written
from .quality import is_escape

PAIRS = "array<struct<value:string,label:string>>"


def signatures(lists: DataFrame, codes: DataFrame) -> DataFrame:
    """``lists`` with ``n_codes, sig, sig_business, sig_labels``: sorted sets, empty for lists without codes.

    A list flagged ``placeholder`` (column ``quality_flags``, if there is one) has its
    ``name_key`` as its only content and no business or label signature.
    """
    pair = F.struct("value", "label")
    business = ~is_escape(F.col("value"), F.col("label"))
    made = codes.groupBy("list_id").agg(
        F.count("*").alias("n_codes"),
        F.array_sort(F.collect_set(pair)).alias("sig"),
        F.array_sort(F.collect_set(F.when(business, pair))).alias("sig_business"),
        F.array_sort(F.collect_set(F.when(business, F.col("label")))).alias("sig_labels"),
    )
    out = lists.join(made, "list_id", "left")
    for name, kind in (("sig", PAIRS), ("sig_business", PAIRS), ("sig_labels", "array<string>")):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    out = out.withColumn("n_codes", F.coalesce("n_codes", F.lit(0).cast("long")))
    if "quality_flags" in lists.columns:
        held = F.array_contains("quality_flags", "placeholder")
        own = F.array(F.struct(F.lit("__placeholder__").alias("value"), F.col("name_key").alias("label")))
        out = out.withColumn("sig", F.when(held, own).otherwise(F.col("sig")))
        out = out.withColumn("sig_business", F.when(~held, F.col("sig_business")).otherwise(F.array().cast(PAIRS)))
        out = out.withColumn("sig_labels", F.when(~held, F.col("sig_labels")).otherwise(F.array().cast("array<string>")))
    return out


def usage_signature(variables: Column) -> Column:
    """Sorted distinct variable names."""
    return F.array_sort(F.array_distinct(variables))


def shown(sig: Column) -> Column:
    """A content signature as one string."""
    return F.array_join(F.transform(sig, lambda c: F.concat(c["value"], F.lit("="), c["label"])), ";")


#: Signatures with more than one in so many of all lists are fewer than this many; they are broadcast.
HOT = 4096


def stars(lists: DataFrame, key: str, least: int = 2) -> DataFrame:
    """``master_id, slave_id`` of each group of ``least`` lists or more that share ``key``.

    A group is reduced before it is shuffled (hash first, the key itself checked).
    Its members find their master by a join; signatures that very many lists share,
    which are few, are broadcast, so that none is a single task's work.
    """
    hashed = written(lists.select("list_id", "ord", key).withColumn("hash", F.xxhash64(key)), "hashed")
    first = hashed.groupBy("hash", key).agg(F.min(F.struct("ord", "list_id")).alias("first"), F.count("*").alias("n")).where(F.col("n") >= least)
    first = written(first, "first")
    most = max(1, (first.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.broadcast(first.where(F.col("n") > most))
    rest = hashed.join(F.broadcast(first.where(F.col("n") > most).select("hash", key)), ["hash", key], "left_anti")
    found = hashed.join(hot, ["hash", key]).unionByName(rest.join(first.where(F.col("n") <= most), ["hash", key]))
    return found.where(F.col("first.list_id") != F.col("list_id")).select(F.col("first.list_id").alias("master_id"), F.col("list_id").alias("slave_id"))


def representatives(lists: DataFrame, *keys: str) -> DataFrame:
    """The first list of each value of ``keys``."""
    hashed = lists.withColumn("_hash", F.xxhash64(*keys))
    first = hashed.groupBy("_hash", *keys).agg(F.min_by("list_id", "ord").alias("_first"))
    return lists.join(first.select(F.col("_first").alias("list_id")), "list_id", "left_semi")


def exact_groups(lists: DataFrame) -> DataFrame:
    return stars(lists, "sig")


def business_groups(lists: DataFrame, least_codes: int = 2) -> DataFrame:
    """Same business codes; of lists with equal full content only the first takes part."""
    return stars(representatives(lists.where(F.size("sig_business") >= least_codes), "sig_business", "sig"), "sig_business")


def label_groups(lists: DataFrame, least_labels: int = 2) -> DataFrame:
    """Same business labels; of lists with equal business codes only the first takes part."""
    return stars(representatives(lists.where(F.size("sig_labels") >= least_labels), "sig_labels", "sig_business"), "sig_labels")


def usage_groups(lists: DataFrame, least: int = 2) -> DataFrame:
    """Same variables."""
    return stars(lists.where(F.size("var_sig") > 0), "var_sig", least)
