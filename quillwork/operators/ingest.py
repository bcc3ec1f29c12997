"""Resolve what readers yield: versions, categories, variables, subsets."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


def latest_by_key(rows: DataFrame, key: str, ord_: str) -> DataFrame:
    """The last occurrence of each key; empty keys are dropped."""
    values = [c for c in rows.columns if c not in (key, ord_)]
    return (
        rows.where((F.col(key).isNotNull()) & (F.col(key).cast("string") != ""))
        .groupBy(key).agg(F.max_by(F.struct(ord_, *values), ord_).alias("row")).select(key, f"row.{ord_}", *(f"row.{c}" for c in values))
    )


def version_key(version: Column) -> Column:
    """Missing below numbers (as numbers) below other text."""
    version = F.coalesce(version, F.lit(""))
    number = F.when(version.rlike("^[0-9]+$"), version.try_cast("decimal(38,0)"))
    rank = F.when(version == "", 0).when(number.isNotNull(), 1).otherwise(2)
    return F.struct(rank.alias("rank"), F.coalesce(number, F.lit(0).cast("decimal(38,0)")).alias("number"), version.alias("text"))


def latest_version(lists: DataFrame, key: str = "list_id", version: str = "version", ord_: str = "ord") -> DataFrame:
    """One row per id, the latest version (the first of equals), at the id's first position."""
    values = [c for c in lists.columns if c not in (key, ord_)]
    k = version_key(F.col(version))
    keyed = lists.withColumn("_k", F.struct(k["rank"].alias("r"), k["number"].alias("n"), F.when(k["rank"] == 2, k["text"]).otherwise("").alias("t"), (-F.col(ord_)).alias("o")))
    found = keyed.groupBy(key).agg(F.max_by(F.struct(*values), "_k").alias("row"), F.min(ord_).alias(ord_), F.count("*").alias("n_versions"))
    return found.select(key, ord_, *(f"row.{c}" for c in values), "n_versions")


def resolve_labels(codes: DataFrame, categories: DataFrame) -> DataFrame:
    """Labels of codes from their categories; a missing one is empty."""
    return codes.join(categories.select("cat_id", F.col("label").alias("_label")), "cat_id", "left").withColumn("label", F.coalesce("_label", F.lit(""))).drop("_label")


def link_variables(lists: DataFrame, variables: DataFrame) -> DataFrame:
    """``vars`` (names in document order, repeats kept) and ``var_ids`` (sorted set) of each list.

    ``var_ids`` go by ``usage_id`` where ``variables`` has it, else by ``cl_id`` too.
    A list without linked variables keeps the ``vars`` it came with, if any.
    """
    usage = F.coalesce("usage_id", "cl_id") if "usage_id" in variables.columns else F.col("cl_id")
    names = variables.where("cl_id is not null").groupBy(F.col("cl_id").alias("list_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("_vars"))
    ids = variables.where(usage.isNotNull()).groupBy(usage.alias("list_id")).agg(F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("var_ids"))
    empty = F.array().cast("array<string>")
    own = F.col("vars") if "vars" in lists.columns else empty
    linked = lists.join(names, "list_id", "left").join(ids, "list_id", "left")
    return linked.withColumn("vars", F.coalesce("_vars", own, empty)).withColumn("var_ids", F.coalesce("var_ids", empty)).drop("_vars")


def inject_registry(lists: DataFrame, registry: DataFrame, replaced: DataFrame) -> DataFrame:
    """Registry lists first, then input lists that are neither in the registry nor replaced by it."""
    known = registry.select("list_id").unionByName(replaced.select("list_id")).distinct()
    rest = lists.join(known, "list_id", "left_anti").select("list_id", "ord", F.lit("xml").alias("origin"), F.lit(1).alias("_second"))
    both = registry.select("list_id", "ord", F.lit("registry").alias("origin"), F.lit(0).alias("_second")).unionByName(rest)
    # Order is a pair, as a shift of ord by an unknown maximum would need another pass.
    return both.select("list_id", F.col("_second").alias("section"), "ord", "origin")


def subset_closure(lists: DataFrame, codes: DataFrame, variables: DataFrame, wanted: DataFrame) -> dict[str, DataFrame]:
    """Chosen lists, the categories that they refer to, the variables that refer to them, and ids not found."""
    chosen = lists.join(wanted, "list_id", "left_semi")
    return {
        "lists": chosen,
        "categories": codes.join(chosen, "list_id", "left_semi").select("cat_id").distinct(),
        "variables": variables.join(chosen.select(F.col("list_id").alias("cl_id")), "cl_id", "left_semi"),
        "unknown": wanted.join(lists, "list_id", "left_anti"),
    }


def clone_lists(codes: DataFrame, suffix: str, relabel: dict[str, str]) -> DataFrame:
    """Codes under new list ids, some labels rewritten."""
    label = F.col("label")
    for old, new in relabel.items():
        label = F.when(F.col("label") == old, F.lit(new)).otherwise(label)
    return codes.withColumn("list_id", F.concat(F.col("list_id"), F.lit(suffix))).withColumn("label", label)


def pick_unique(lists: DataFrame, implicated: DataFrame, k: int, least: int = 3, most: int = 12) -> DataFrame:
    """The first k lists, in order, that are in no pair and have ``least`` to ``most`` codes."""
    return lists.join(implicated, "list_id", "left_anti").where(F.col("n_codes").between(least, most)).orderBy("ord").limit(k)


def current_definition(definitions: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per concept the definition with the highest version among those that are still valid and in French; label or ''."""
    valid = definitions.where(F.col("valid_until").isNull() & (F.col("lang") == "fr"))
    best = Window.partitionBy("concept").orderBy(F.desc("version"), "ord")
    found = valid.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return found.join(concepts.select("concept", "label"), "concept", "left").withColumn("label", F.coalesce("label", F.lit("")))
