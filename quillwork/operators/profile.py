"""Profiles of tables of lists."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

# Size classes with their bounds.
BUCKETS = [("1-10", 0, 10), ("11-50", 11, 50), ("51-100", 51, 100), ("101-500", 101, 500), ("501-1000", 501, 1000), ("1001-5000", 1001, 5000), ("5000+", 5001, None)]


def size_profile(lists: DataFrame, size: str = "n_codes") -> DataFrame:
    """Count, sum, distinct sizes, extremes, mean and exact interpolated percentiles."""
    p = lambda q: F.percentile(size, F.lit(q)).alias(f"p{round(q * 100)}")
    return lists.agg(
        F.count("*").alias("n_lists"), F.sum(size).alias("n_codes"), F.countDistinct(size).alias("n_sizes"), F.min(size).alias("least"), F.max(size).alias("most"), F.avg(size).alias("mean"), p(0.25), p(0.5), p(0.75), p(0.95)
    )


#: Size of a quantile sketch: ranks are off by less than one in a hundred (99 of 100 times).
SKETCH = 400


def size_sketch(lists: DataFrame, run_id: str, size: str = "n_codes") -> DataFrame:
    """One row that stands for a run's sizes: ``run_id, n_lists, n_codes, least, most, sketch``; a few kilobytes, to be kept."""
    return lists.agg(
        F.lit(run_id).alias("run_id"), F.count(size).alias("n_lists"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_codes"), F.min(size).alias("least"), F.max(size).alias("most"),
        F.kll_sketch_agg_bigint(F.col(size).cast("long"), SKETCH).alias("sketch"),
    )


def merged_profile(sketches: DataFrame) -> DataFrame:
    """The profile of several runs together out of their sketches: counts, extremes and mean exactly, percentiles (sizes that occur) within the sketch's error of rank."""
    whole = sketches.agg(F.sum("n_lists").alias("n_lists"), F.sum("n_codes").alias("n_codes"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_bigint("sketch", SKETCH).alias("sketch"))
    p = lambda q: F.when(F.col("n_lists") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(q))).alias(f"p{round(q * 100)}")
    return whole.select("n_lists", "n_codes", "least", "most", (F.col("n_codes") / F.nullif("n_lists", F.lit(0))).alias("mean"), p(0.25), p(0.5), p(0.75), p(0.95))


def size_histogram(lists: DataFrame, size: str = "n_codes") -> DataFrame:
    """``bucket, n`` for every size class, empty ones too."""
    spark = lists.sparkSession
    known = spark.createDataFrame([(b,) for b, _, _ in BUCKETS], "bucket string")
    bucket = F.lit(None).cast("string")
    for name, low, high in BUCKETS:
        bucket = F.when((F.col(size) >= low) & (F.lit(True) if high is None else F.col(size) <= high), name).otherwise(bucket)
    counts = lists.select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    return known.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def type_counts(objects: DataFrame, kind: str) -> DataFrame:
    return objects.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind)


def json_profile(rows: DataFrame, document: Column) -> DataFrame:
    """Per key of a JSON object: entries, distinct values, total length of the values."""
    entries = rows.select(F.explode(F.from_json(document, "map<string,string>")).alias("key", "value"))
    return entries.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.sum(F.length("value")).alias("chars"))


def top_lists(lists: DataFrame, size: str, k: int = 10) -> DataFrame:
    """The k largest, with their rank."""
    return lists.orderBy(F.desc(size), "ord").limit(k)


def minimal_records(lists: DataFrame, codes: DataFrame, escape: Column) -> DataFrame:
    """What a reviewer needs of each list: its own columns with nulls as empty, its codes in order, those that ``escape`` holds for, and their number."""
    pair = F.struct("pos", F.array("value", "label").alias("pair"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["pair"])
    held = codes.groupBy("list_id").agg(F.count("*").alias("codes_count"), in_order(pair).alias("codes"), in_order(F.when(escape, pair)).alias("escape_codes"))
    none = F.array().cast("array<array<string>>")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("name", "label", "agency", "version") if c in lists.columns]
    rest = [c for c in lists.columns if c not in ("list_id", "name", "label", "agency", "version")]
    return lists.join(held, "list_id", "left").select(
        "list_id", *texts, F.coalesce("codes_count", F.lit(0).cast("long")).alias("codes_count"), F.coalesce("codes", none).alias("codes"), F.coalesce("escape_codes", none).alias("escape_codes"), *rest
    )


def codes_preview(lists: DataFrame, codes: DataFrame, n_lists: int = 20, n_codes: int = 5) -> DataFrame:
    """The first lists with their first codes: ``list_id, name, codes_count, preview``, a report of fixed size."""
    first = lists.orderBy("ord", "list_id").limit(n_lists)
    own = codes.join(F.broadcast(first.select("list_id")), "list_id")
    held = own.groupBy("list_id").agg(F.count("*").alias("codes_count"), F.slice(F.array_sort(F.collect_list(F.struct("pos", "value", "label"))), 1, n_codes).alias("preview"))
    return first.join(held, "list_id", "left").select("list_id", "name", F.coalesce("codes_count", F.lit(0).cast("long")).alias("codes_count"), "preview")
