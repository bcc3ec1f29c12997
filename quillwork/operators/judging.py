"""Model calls that are made once: a ledger of texts and answers; judged pairs; the semantic phases of a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.text import concat_text, embed_text, normalize
from .semantic import UNREADABLE, cosine_pairs, judge_parse, prefix_pairs, with_embeddings

#: Texts in one call, and calls' texts in one append to a ledger: what an interrupted run loses at most.
BATCH, APPEND = 16, 50_000
# Thresholds of the phases, pairs that are judged, and what an answer that failed says.
DIRECT, VARIABLE, USER_ID, USER_ID_TEXT, JUDGED, FAILED = 0.90, 0.92, 0.50, 0.60, 20, "Erreur: "
ENTRY = "key binary, reply string, error string"


class Ledger:
    """Answers by the digest of model and text, kept as an append-only table at ``path``.

    A text is asked once, however many rows have it and whatever runs ask for it. A text
    whose call fails has an entry with the error, and is asked again only with
    ``retry``. A run that is interrupted has kept what it appended, and goes on from there.
    """

    def __init__(self, spark: SparkSession, path: str, model: str = ""):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model

    def key(self, text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(F.lit(f"{self.model}\n"), F.coalesce(text, F.lit(""))), 256))

    def entries(self) -> DataFrame:
        """One row for each text: an answer before an error, whichever of several runs wrote it."""
        try:
            held = self.spark.read.schema(ENTRY).parquet(f"{self.path}/entries")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ENTRY)
        best = F.min_by(F.struct("reply", "error"), F.struct(F.col("reply").isNull(), F.coalesce("reply", "error")))
        return held.groupBy("key").agg(best.alias("e")).select("key", "e.reply", "e.error")

    def ask(self, rows: DataFrame, call: Callable[[list[str]], list[str]], text: str, retry: bool = False) -> DataFrame:
        """``rows`` with ``reply`` and ``error``, one of them null; ``call`` takes texts and gives as many answers.

        Where a batch fails its texts are asked one by one, so an error stays with its text.
        """
        known = self.entries() if not retry else self.entries().where("reply is not null")
        asked = rows.select(self.key(F.col(text)).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
        missing = asked.dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
        turns = max(1, -(-missing.count() // APPEND))

        def answers(texts: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                found = list(call(texts))
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} answers for {len(texts)} texts")
                return [(f, None) if f is not None else (None, "no answer") for f in found]
            except Exception as error:  # whatever a model's client raises belongs into the ledger
                return [(None, str(error) or type(error).__name__)] if len(texts) == 1 else [a for t in texts for a in answers([t])]

        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = [a for at in range(0, len(frame), BATCH) for a in answers(frame["text"].iloc[at : at + BATCH].tolist())]
                yield pd.DataFrame({"key": frame["key"], "reply": [f[0] for f in found], "error": [f[1] for f in found]})

        for turn in range(turns):
            part = missing.where(F.pmod(F.xxhash64("key"), F.lit(turns)) == turn) if turns > 1 else missing
            part.mapInPandas(task, ENTRY).write.mode("append").parquet(f"{self.path}/entries")
        return rows.withColumn("_key", self.key(F.col(text))).join(self.entries().withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def with_judgements(pairs: DataFrame, ledger: Ledger, call: Callable[[list[str]], list[str]], prompt: str = "prompt", retry: bool = False) -> DataFrame:
    """``pairs`` with ``same_concept, confidence, reason``; a call that failed is a no with its error as the reason."""
    asked = ledger.ask(pairs, call, prompt, retry)
    verdict = judge_parse(F.col("reply"))
    failed = F.col("reply").isNull()
    return asked.withColumn("_v", verdict).select(
        *pairs.columns, F.when(failed, False).otherwise(F.col("_v.same_concept")).alias("same_concept"), F.when(failed, 0.0).otherwise(F.col("_v.confidence")).alias("confidence"),
        F.when(failed, F.concat(F.lit(FAILED), F.coalesce("error", F.lit(UNREADABLE)))).otherwise(F.col("_v.reason")).alias("reason"),
    )


def semantic_phases(lists: DataFrame, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """``a, b, score, phase, rank`` of all semantic phases, the earlier list first; ``rank`` is the order of emission.

    ``lists``: ``list_id, ord, name, label, description, codes, vars`` and, if there is
    one, ``user_id``; ``ord`` is a number. Phases in order: texts of lists, texts of
    their variables, common beginnings of user ids, texts of user ids; within a phase by
    score, then by ``ord``.
    """
    column = lambda c: F.col(c) if c in lists.columns else F.lit("")
    ids = lists.select(F.col("ord").cast("long").alias("ord"), "list_id")

    def near(text: Column, rows: DataFrame, least: float) -> DataFrame:
        texts = rows.select(F.col("ord").cast("long").alias("id"), embed_text(text)[0].alias("text")).where("text <> ''")
        return cosine_pairs(with_embeddings(texts, embed), least).select(F.col("a").alias("orda"), F.col("b").alias("ordb"), "score")

    phases = [("direct", near(concat_text(F.col("name"), column("label"), column("description"), F.col("codes")), lists, DIRECT))]
    phases.append(("variable", near(normalize(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.array_join("vars", " "))), lists.where(F.size("vars") > 0), VARIABLE)))
    if "user_id" in lists.columns:
        known = lists.where(F.coalesce("user_id", F.lit("")) != "")
        prefix = prefix_pairs(known, USER_ID).join(ids.select(F.col("list_id").alias("a"), F.col("ord").alias("orda")), "a").join(ids.select(F.col("list_id").alias("b"), F.col("ord").alias("ordb")), "b")
        phases += [("uid_prefix", prefix.select("orda", "ordb", "score")), ("uid_embed", near(normalize(F.col("user_id")), known, USER_ID_TEXT))]
    out = None
    for number, (name, found) in enumerate(phases):
        rank = F.struct(F.lit(number).alias("phase"), (-F.round("score", 4)).alias("score"), "orda", "ordb")
        found = found.select("orda", "ordb", F.round("score", 4).alias("score"), F.lit(name).alias("phase"), rank.alias("rank"))
        out = found if out is None else out.unionByName(found)
    side = lambda i: ids.select(F.col("ord").alias(f"ord{i}"), F.col("list_id").alias(i))
    return out.join(side("a"), "orda").join(side("b"), "ordb").select("a", "b", "score", "phase", "rank")


def to_judge(pairs: DataFrame, k: int = JUDGED) -> DataFrame:
    """Of each pair its first emission, and of these the ``k`` of the highest score."""
    first = pairs.groupBy("a", "b").agg(F.min_by(F.struct("score", "phase"), "rank").alias("p"), F.min("rank").alias("rank"))
    return first.orderBy(F.desc("p.score"), "rank").limit(k).select("a", "b", "p.score", "p.phase")
