"""Substring dedup by lines: normalise units, group digests, keep the earliest, remove the rest.

A unit is a line (or, with ``delimiter='\\n\\n'``, a paragraph). Its digest covers the
lower-cased unit with runs of white space as one space. Of all units with one
digest the one with the smallest (doc_id, row, position) stays. Every unit that is not
empty takes part, unless ``least_words`` sets a floor. Removed units are reported by
their character offsets in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .shared import LAST, bounded_batches, keyed, rank_id, text_or_empty, written

#: Digests with more than one in so many of all units are fewer than this many; they are broadcast.
HOT = 4096


def normalised(unit: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(unit, r"[ \t\x0B\f\r\n]+", " ")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", delimiter: str = "\n", least_words: int = 1) -> DataFrame:
    """``doc_id, n_units, n_removed, removed_spans, text`` for each input row.

    ``removed_spans``: ``start-end`` character offsets (end exclusive), joined by
    commas, in text order; ``text``: the kept units joined by the delimiter. Null
    text counts as empty (one empty unit). Rows without an id come last in rank. Rows
    that share an id, or lack one, are documents of their own, ranked by their place in
    the input; of rows that repeat as a whole the first keeps its units. Only keys of
    rows, digests and positions are shuffled to find repeats; a digest that very many
    units share is reduced before it is shuffled.
    """
    units = F.split(F.col("text"), "\\Q" + delimiter + "\\E", -1)
    texts = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), "line-rows", "key")
    each = (
        texts.select("key", rank_id().alias("rank"), F.posexplode(units).alias("pos", "unit"))
        .select("key", "rank", "pos", normalised(F.col("unit")).alias("unit"))
        .where((F.col("unit") != "") & (F.size(F.split("unit", " ")) >= least_words))
        .select("key", "rank", "pos", F.unhex(F.md5("unit")).alias("digest"))
    )
    each = written(each, "units")
    place = F.struct("rank", "key", "pos")
    first = written(each.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    # Copies of hot units, which are few by their size, find their first by a broadcast; no other digest fills a task.
    most = max(1, (first.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.broadcast(first.where(F.col("n") > most))
    rest = each.join(F.broadcast(first.where(F.col("n") > most).select("digest")), "digest", "left_anti").join(first.where(F.col("n") <= most), "digest")
    removed = each.join(hot, "digest").unionByName(rest).where(place != F.col("first")).groupBy("key").agg(F.collect_list("pos").alias("removed"))
    joined = texts.join(removed, "key", "left").select("doc_id", "text", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, spans, kept = [], [], [], []
            for text, removed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = text.split(delimiter)
                counts.append(len(parts))
                gone.append(len(removed))
                if removed:
                    out, at, left, drop = [], 0, [], set(removed)
                    for i, part in enumerate(parts):
                        if i in drop:
                            out.append(f"{at}-{at + len(part)}")
                        else:
                            left.append(part)
                        at += len(part) + len(delimiter)
                    text = delimiter.join(left)
                    spans.append(",".join(out))
                else:
                    spans.append("")
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.string()), pa.array(kept, pa.string())],
                ["doc_id", "n_units", "n_removed", "removed_spans", "text"],
            )

    bounded_batches(docs.sparkSession)
    return joined.mapInArrow(task, "doc_id long, n_units long, n_removed long, removed_spans string, text string")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_whole_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_query(spark, sf_dir)


OP2_SQL = rf"""
WITH d AS (SELECT coalesce(doc_id, {LAST}) AS rank, row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS units FROM documents),
u AS (SELECT rank, r, generate_subscripts(units, 1) AS pos, unnest(units) AS unit FROM d),
k AS (
  SELECT *, lower(trim(regexp_replace(unit, '[ \t\x0B\f\r\n]+', ' ', 'g'))) AS norm,
    coalesce(sum(length(unit) + 1) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM u
), f AS (
  SELECT *, CASE WHEN norm <> '' THEN row_number() OVER (PARTITION BY norm ORDER BY rank, r, pos) ELSE 1 END AS nth FROM k
)
SELECT d.doc_id, count(*) AS n_units, count(*) FILTER (nth > 1) AS n_removed,
  coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + length(unit) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (nth > 1), '') AS removed_spans,
  coalesce(string_agg(unit, chr(10) ORDER BY pos) FILTER (nth = 1), '') AS text
FROM d JOIN f USING (r) GROUP BY r, d.doc_id
"""

#: The name under which every unit took part before that became the rule.
OP2_WHOLE_SQL = OP2_SQL
