"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import pyspark.sql.functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

#: Rank of a row without an id: after every row that has one.
LAST = 9223372036854775807


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, which all executors must see.

    Where that is unset, a session in a single process gets a temporary one; on a
    cluster it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillwork-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/quillwork-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_written(spark: SparkSession) -> None:
    """Delete all that this application's operators wrote. DataFrames they returned can't be read after that; an index kept elsewhere stays."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, name: str, key: str = "row_key_") -> DataFrame:
    """``docs`` with a key ``struct<file, row>`` that tells all rows apart and stays as it is, whatever runs anew.

    Rows of files are known by their file (its path as 64 bits) and place in it, and
    nothing is copied; other rows are written with their keys.
    """
    try:
        return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(key))
    except AnalysisException:
        return written(docs.withColumn(key, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))), name)


def bounded_batches(spark: SparkSession, rows: int = 250) -> None:
    """Keep Arrow batches small, so that very long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def rank_id(name: str = "doc_id") -> Column:
    """The id as a number to order by; rows without an id come last."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_small(left: DataFrame, right: DataFrame, on: str, rows: int, most: int = 2_000_000, how: str = "inner") -> DataFrame:
    """Join with a side of ``rows`` narrow rows: broadcast up to ``most`` of them, by a shuffle beyond."""
    return left.join(F.broadcast(right) if rows <= most else right, on, how)
