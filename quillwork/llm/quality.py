"""Quality rules: a calibrated hashed n-gram classifier behind a few fixed base rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .hashed import Features, Model, labelled_sample
from .shared import bounded_batches, text_or_empty
from .words import Words, mix, slices

#: Labelled rows of each label that the classifier is fitted on at most.
ROWS_PER_LABEL = 2000
#: A document is kept at this calibrated probability of good quality.
THRESHOLD = 0.5
#: Base rules: fewer words than this, or a larger share of repeated words, fails.
LEAST_WORDS, MOST_REPEATED = 50, 50

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_p double"


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def base_features(words: Words) -> dict[str, np.ndarray]:
    """Counts per text, of words as they stand (case kept)."""
    buf = words.buf
    in_word = np.zeros(len(buf) + 1, np.int8)
    in_word[words.starts] += 1
    in_word[words.ends] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8)
    symbol = np.isin(buf, np.frombuffer(b"#*$%&|<>", np.uint8))
    lines = []
    for text in words.texts:
        own = [line for line in text.split(b"\n") if line and not line.isspace()]
        lines.append(len(own) - len(set(own)))
    window, at = words.windows(3)
    key = mix(window ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1)))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = at[count[inverse] > 1]
    covered = np.zeros(len(words.hash), bool)
    for j in range(3):
        covered[again + j] = True
    return {
        "n_words": np.diff(words.first),
        "word_chars": _per_text((in_word > 0) & ((buf & 0xC0) != 0x80), words.at),
        "n_symbols": _per_text(symbol, words.at),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": _per_text(covered, words.first),
    }


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_label: int = ROWS_PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, base verdict, probability and verdict of each whole text, one row per input row.

    ``labels``: ``doc_id, quality`` (1 good, 0 bad); null or other labels are left
    out. Null text counts as empty and fails the base rules. With fewer than two
    labels to learn from there is no classifier: ``quality_p`` is null and the base
    rules alone decide. Nothing but the bounded sample leaves its partition.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    bounded_batches(docs.sparkSession)
    sample, counts = labelled_sample(docs, labels.where("quality in (0, 1)").select("doc_id", F.col("quality").alias("label")), rows_per_label)
    both = len({r["label"] for r in sample}) == 2
    held = docs.sparkSession.sparkContext.broadcast(Model(sample, counts, level=True).state() if both else None)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.restored(held.value) if held.value else None
        for batch in batches:
            for row, texts in slices(batch):
                words = Words(texts, lower=False)
                base = base_features(words)
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
                p = model.probabilities(Features(words))[:, model.classes.index(1)] if model else None
                kept = ~failed if p is None else ~failed & (p >= threshold)
                columns = [batch.column(0).slice(row, len(texts)), *(pa.array(v.astype(np.int64)) for v in base.values()), pa.array(failed), pa.array(kept)]
                columns.append(pa.nulls(len(texts), pa.float64()) if p is None else pa.array(p))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *base, "base_failed", "kept", "quality_p"])

    return docs.mapInArrow(task, SCHEMA)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
