"""A pipeline over ``documents``: language, exact copies, near copies, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet
and read again for the next. All but the last return the columns of ``documents``.
An empty table stays empty. Ids may be null or shared, whole rows may repeat, extra
columns are carried along; null texts count as empty: language ID rejects them, as
texts without letters.
"""

from __future__ import annotations

import public_tokenizers
import pyspark.sql.functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from quillwork.llm import bpe, exact_dedup, jaccard, langid, mixing
from quillwork.llm.shared import rank_id, written


#: Tells the rows of a stage apart: ids may be null or shared, and whole rows may repeat.
KEY = "row_key_"


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a row key that stays as it is, whatever runs anew.

    Rows of files are known by their file and place in it; nothing is copied. Other
    rows are written with their keys. Only the names of files come to the driver.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.row_index").alias("row_"))
    except AnalysisException:
        return written(docs.withColumn(KEY, F.monotonically_increasing_id()), name)
    paths = sorted(r["file_"] for r in placed.select("file_").distinct().collect())
    files = docs.sparkSession.createDataFrame(list(zip(paths, range(len(paths)), strict=True)), "file_ string, number_ long")
    numbered = placed.join(F.broadcast(files) if len(paths) <= 100_000 else files, "file_")
    return numbered.withColumn(KEY, F.shiftleft("number_", 40).bitwiseOR(F.col("row_"))).drop("file_", "row_", "number_")


def _small(found: DataFrame, name: str) -> DataFrame:
    """``found``, written; up to two million rows are broadcast, more are shuffled."""
    found = written(found, name)
    return F.broadcast(found) if found.count() <= 2_000_000 else found


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows whose keys are in ``gone``, and without the key."""
    return docs.join(_small(gone.select(KEY), name), KEY, "left_anti").drop(KEY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is beyond doubt; texts without letters go."""
    docs = _keyed(docs, "language")
    found = langid.of_documents(docs, id_col=KEY).where(~F.col("kept"))
    return _without(docs, found.withColumnRenamed("doc_id", KEY), "no-language")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id; of several such rows one."""
    docs = _keyed(docs, "exact")
    return _without(docs, exact_dedup.DigestIndex(spark).absorb(docs, key_col=KEY).where(~F.col("kept")), "copies")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the one with the smallest id; of several such rows one."""
    docs = _keyed(docs, "near")
    found = jaccard.JaccardJoin(spark).classes(docs, id_col=KEY).select(F.col("doc_id").alias(KEY), F.col("component_id").alias("class"))
    ranked = written(found.join(docs.select(KEY, rank_id().alias("rank")), KEY), "classes")
    first = ranked.groupBy("class").agg(F.min(F.struct("rank", KEY))[KEY].alias(KEY)).select(KEY)
    return _without(docs, ranked.join(first, KEY, "left_anti"), "near-copies")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the rates that bring the domains to their target weights; at rates above 1 repeatedly."""
    docs = _keyed(docs, "mixing")
    rated = mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), key_col=KEY)
    other = rated.select(KEY, mixing.copies(rated, KEY).alias("copies_")).where("copies_ <> 1")
    times = docs.join(_small(other, "copies"), KEY, "left").withColumn("copies_", F.coalesce("copies_", F.lit(1))).where("copies_ > 0")
    return times.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_")))).drop(KEY, "copies_", "copy_")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Language ID and mixing rest on models that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
