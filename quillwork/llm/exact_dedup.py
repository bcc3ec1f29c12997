"""Exact dedup over a persistent digest index, bucketed and sorted by digest.

The index is a table ``(digest, keep_id, group_size, batch)`` in buckets by
digest, each sorted by digest; the number of buckets lies beside it and holds for
every session that opens it. A batch of new rows is reduced to one row per digest
and anti-joined with what other batches left, by a sort-merge join along the
buckets. What survives is new and is appended; then the whole batch reads its
answer back from the index. Everything is DataFrame code.
"""

from __future__ import annotations

import string
import uuid

import pyspark.sql.functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

from .shared import fresh_path, text_or_empty, written

#: Digests with more than one in so many of a batch's rows are hot: fewer than this many can exist, so they are broadcast.
HOT = 4096


def normalised(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


class DigestIndex:
    """A digest index that outlives the batches that are deduplicated against it.

    ``path`` is where it lies; opened again under the same path, by any session, it
    goes on with what earlier batches left. ``buckets`` counts for a new index only
    (by default the session's shuffle partitions); asking for another number than
    an index has is an error.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or fresh_path(spark, "digest-index")).rstrip("/")
        stored = self._stored_buckets()
        if stored is None:
            stored = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(stored).alias("buckets")).write.parquet(f"{self.path}/about")
        elif buckets not in (None, stored):
            raise ValueError(f"the index at {self.path} has {stored} buckets, not {buckets}")
        self.buckets = stored
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/entries'"
            )

    def _stored_buckets(self) -> int | None:
        try:
            return self.spark.read.schema("buckets int").parquet(f"{self.path}/about").first()["buckets"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Take the index out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _along_buckets(self, df: DataFrame) -> DataFrame:
        """Dealt as the index is, so that joins with it move only this side."""
        return df.repartition(self.buckets, "digest")

    def absorb(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None, batch: str | None = None) -> DataFrame:
        """Deduplicate a batch against the index and itself, then append its new digests.

        Of equal new texts the largest id stays; a text that an earlier batch left
        stays with the entry it has. Returns one row per input row: ``doc_id,
        keep_id, group_size, kept, text_sha256``; ``group_size`` counts the batch and
        what the index had when the entry was made. Null text counts as empty. Rows
        without an id rank below all others. Of rows with the same id and text one
        is kept. ``key_col`` names a column that tells all rows apart; it is returned
        too and says which of such rows is kept. An empty batch gives no rows and
        leaves the index as it was.

        ``batch`` names the batch. Absorbed again under its name, with the same rows,
        it gets the same answer and adds nothing, whether the first attempt ended or
        not. Without a name every call is a batch of its own.
        """
        batch = batch or uuid.uuid4().hex
        key = F.col(key_col) if key_col else F.monotonically_increasing_id()
        rows = written(
            docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text_or_empty(text_col)), 256)).alias("digest"), key.alias("row_key")), "digests"
        )
        # Partial sums come before the shuffle: a hot digest sends one row a task.
        groups = written(rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row_key")).alias("top"), F.count("*").alias("n")), "groups")

        earlier = self.entries().where(F.col("batch") != batch).hint("merge")
        fresh = written(self._along_buckets(groups).join(earlier, "digest", "left_anti"), "fresh")
        # What an attempt that broke off has appended already is not appended again.
        own = self.entries().where(F.col("batch") == batch).hint("merge")
        missing = self._along_buckets(fresh).join(own, "digest", "left_anti")
        missing.select("digest", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(batch).alias("batch")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

        old = F.col("batch") != batch
        answers = written(
            self._along_buckets(groups).join(self.entries().hint("merge"), "digest").select(
                "digest", "keep_id", "n", (F.col("group_size") + F.when(old, F.col("n")).otherwise(0)).alias("group_size"), F.when(~old, F.col("top.row_key")).alias("kept_key")
            ),
            "answers",
        )
        return self._told(rows, answers).select(
            *([F.col("row_key").alias(key_col)] if key_col else []),
            "doc_id", "keep_id", "group_size", F.coalesce(F.col("row_key") == F.col("kept_key"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        )

    @staticmethod
    def _told(rows: DataFrame, answers: DataFrame) -> DataFrame:
        """Each row with its digest's answer. Hot digests, which are few by their size, are broadcast; no other one fills a task."""
        most = max(1, (answers.agg(F.sum("n")).first()[0] or 0) // HOT)
        hot = F.broadcast(answers.where(F.col("n") > most))
        some = rows.join(hot, "digest")
        rest = rows.join(F.broadcast(answers.where(F.col("n") > most).select("digest")), "digest", "left_anti").join(answers.where(F.col("n") <= most), "digest")
        return some.unionByName(rest)


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return DigestIndex(spark).absorb(docs)


OP5_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


def two_batches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches: those declared English, then the others, against an index opened anew."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    index = DigestIndex(spark)
    first = index.absorb(docs.where(english), batch="english")
    second = DigestIndex(spark, index.path).absorb(docs.where(~english), batch="others")
    return first.withColumn("batch", F.lit(1)).unionByName(second.withColumn("batch", F.lit(2)))


TWO_BATCHES_SQL = """
WITH t AS (
  SELECT doc_id, CASE WHEN coalesce(lang = 'en', false) THEN 1 ELSE 2 END AS batch,
    sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(batch) AS entered, coalesce(max(doc_id) FILTER (batch = 1), max(doc_id)) AS keep_id,
    count(*) FILTER (batch = 1) AS n1, count(*) FILTER (batch = 2) AS n2
  FROM t GROUP BY 1
)
SELECT doc_id, keep_id, CASE WHEN batch = 1 THEN n1 ELSE n1 + n2 END AS group_size, batch = entered AND doc_id = keep_id AS kept, text_sha256, batch
FROM t JOIN g USING (text_sha256)
"""
