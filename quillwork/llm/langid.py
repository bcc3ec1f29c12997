"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

1. Byte-trigram counts of the texts, grouped by the language declared for them,
   give a likelihood of each text under each language. Every declared language is
   modelled, however rare, once its texts hold ``LEAST_GRAMS`` trigrams in all. A
   text that fits even its likeliest language far worse than that language's own
   texts do is in none of them: ``und``.
2. From the text-only posteriors of all rows, grouped aggregation gives
   P(declared | language), P(suffix | language) and P(language | host); a host's
   share is smoothed towards that of its site, a site's towards the whole.
3. The four are added up as logarithms. A row is rejected when its text has no
   letters, when it is in no modelled language, or when no language reaches the
   fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from . import html_text
from .hashed import trigrams
from .shared import bounded_batches, text_or_empty, written
from .words import slices

FEATURES = 1 << 14
#: A language is modelled when the texts declared to be in it hold so many trigrams.
LEAST_GRAMS = 100
#: Languages that can be modelled: a table of trigrams for each is broadcast (64 KB). More is an error.
MOST_LANGUAGES = 500
#: Trigrams of all texts that the smoothing of a language counts for.
SMOOTHING = 500.0
#: A text of n trigrams that lies this far below its language's own texts, in nats a trigram, is in no modelled language: APART + SHORT / sqrt(n).
APART, SHORT = 3.0, 8.0
#: Weight of one trigram: neighbours overlap, so each counts for a part.
TEMPER = 0.25
#: Most that the text may say for or against a language, in nats a document.
TEXT_NATS = 40.0
#: Rows that the next wider level counts for when a level is smoothed.
PRIOR_ROWS = 20.0
THRESHOLD = 0.7
#: Numbers of an evidence table that are broadcast at most; a larger one is joined by a shuffle.
BROADCAST = 2_000_000


def _letters_table() -> np.ndarray:
    """Letters in lower case (bytes beyond ASCII as they are), all else white space."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams with a letter in them: feature and text number."""
    letters = _letters_table()[np.frombuffer(b"   ".join(texts) + b"   ", np.uint8)]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 3 for t in texts])])
    is_letter = letters != 32
    feature = trigrams(letters)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))[: len(feature)]
    some = is_letter[:-2] | is_letter[1:-1] | is_letter[2:]
    # None that reaches into the next text: what a text has must not depend on its neighbours.
    for back in (1, 2):
        some[bounds[1:-1] - back] = False
    return feature[some], text[some]


def _count_task(languages: list[str]):
    number = {name: i for i, name in enumerate(languages)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), FEATURES), np.int64)
        for batch in batches:
            declared = batch.column(0).to_pylist()
            for row, texts in slices(batch):
                feature, text = _grams(texts)
                own = np.array([number.get(declared[row + d], -1) for d in range(len(texts))])[text]
                at = own[own >= 0] * FEATURES + feature[own >= 0]
                counts += np.bincount(at, minlength=counts.size).reshape(counts.shape)
        which, feature = np.nonzero(counts)
        if len(which):
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array(counts[which, feature])], ["which", "feature", "n"])

    return task


def _likelihood_task(table):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = table.value
        for batch in batches:
            for row, texts in slices(batch, 5):
                feature, text = _grams(texts)
                raw = np.stack([np.bincount(text, own[feature], len(texts)) for own in logs], 1)
                grams = np.bincount(text, minlength=len(texts))
                found = np.maximum((raw - raw.max(1, keepdims=True)) * TEMPER, -TEXT_NATS)
                offsets = pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32))
                keep = [batch.column(c).slice(row, len(texts)) for c in range(5)]
                sums = [pa.array(grams), pa.array(raw.argmax(1).astype(np.int32)), pa.array(raw.max(1))]
                yield pa.RecordBatch.from_arrays([*keep, *sums, pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["doc_id", "declared", "suffix", "host", "letters", "grams", "nearest", "fit", "text_log"])

    return task


def _site(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.substring_index(host, ".", -2)


def _softmax(values: Column) -> Column:
    top = F.array_max(values)
    powers = F.transform(values, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def _add(*arrays: Column) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), arrays)


def _sums(languages: int) -> list[Column]:
    return [F.sum(F.when(F.col("known"), F.col("text_p")[i]).otherwise(0.0)).alias(f"s{i}") for i in range(languages)]


def _counts(languages: int) -> Column:
    return F.array(*(F.col(f"s{i}") for i in range(languages)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, language, posterior, kept`` for each input row.

    ``declared``, ``suffix``, ``host``: string columns of ``docs``, each optional; a
    null or empty one is no evidence; of a declared tag such as ``en-GB`` the first
    part counts. A text without letters (null, empty, digits or dashes only) and one
    that fits no modelled language have language ``und``, posterior 0, and are
    rejected; so are texts of a language for which too little text is declared,
    unless they are too short to tell. Languages as close to a modelled one as its
    own texts are to each other are taken for it. Without any language to model there
    is nothing to learn from: every text is ``und`` and is kept if it has letters.
    Ties go to the language that comes first in the alphabet. Rows with the same id
    are judged each by itself.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    blank = F.lit(None).cast("string")
    clean = lambda c: F.nullif(F.lower(F.trim((blank if c is None else c).cast("string"))), F.lit(""))
    primary = F.nullif(F.split(clean(declared), "[-_]")[0], F.lit(""))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), primary.alias("declared"), clean(suffix).alias("suffix"), clean(host).alias("host"), text.rlike(r"\p{L}").alias("letters"), text.alias("text"))
    names = [r["declared"] for r in rows.where("declared is not null").select("declared").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} declared languages; clean the column first")
    languages, counts = sorted(names), np.zeros((len(names), FEATURES))
    if languages:
        counted = rows.select("declared", "text").mapInArrow(_count_task(languages), "which int, feature int, n long").groupBy("which", "feature").agg(F.sum("n").alias("n")).toArrow()
        counts[counted["which"].to_numpy(), counted["feature"].to_numpy()] = counted["n"].to_numpy()
    enough = counts.sum(1) >= LEAST_GRAMS
    everything = counts.sum(0) + 0.5
    languages, counts = [x for x, e in zip(languages, enough, strict=True) if e], counts[enough]
    if not languages:
        return rows.select("doc_id", F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.col("letters").alias("kept"))
    n = len(languages)
    logs = np.log((counts + SMOOTHING * everything / everything.sum()) / (counts.sum(1, keepdims=True) + SMOOTHING))
    likely = rows.mapInArrow(
        _likelihood_task(spark.sparkContext.broadcast(logs)),
        "doc_id long, declared string, suffix string, host string, letters boolean, grams long, nearest int, fit double, text_log array<double>",
    )
    likely = written(likely.withColumn("text_p", _softmax(F.col("text_log"))).withColumn("site", _site(F.col("host"))), "scored")
    # How well the texts that are nearest to a language fit it: one row a language.
    own = likely.where("grams > 0").groupBy("nearest").agg((F.sum("fit") / F.sum("grams")).alias("own"))
    near = F.col("fit") / F.col("grams") >= F.col("own") - APART - SHORT / F.sqrt("grams")
    likely = likely.join(F.broadcast(own), "nearest", "left").withColumn("known", F.col("letters") & F.coalesce(near, F.lit(True))).drop("nearest", "fit", "own", "grams")
    likely = written(likely, "likely")

    whole = likely.agg(*_sums(n)).first()
    whole = np.array([whole[f"s{i}"] or 0.0 for i in range(n)]) + 1.0
    base = F.array(*(F.lit(float(x)) for x in whole / whole.sum()))
    smoothed = lambda own, wider: F.zip_with(own, wider, lambda c, p: (c + PRIOR_ROWS * p) / (F.aggregate(own, F.lit(0.0), lambda a, x: a + x) + PRIOR_ROWS))
    hosts = written(likely.where("host is not null").groupBy("host", "site").agg(*_sums(n)), "hosts")
    sites = hosts.groupBy("site").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(n))).select("site", smoothed(_counts(n), base).alias("site_p"))
    host_p = hosts.select("host", "site", _counts(n).alias("own")).join(sites, "site").select("host", F.transform(smoothed(F.col("own"), F.col("site_p")), lambda x: F.log(x)).alias("host_log"))

    def evidence(name: str) -> DataFrame:
        """log P(value | language) from how the values fall on the text-only posteriors."""
        seen = written(likely.where(f"{name} is not null").groupBy(name).agg(*_sums(n)), "seen")
        totals = seen.agg(F.count("*").alias("kinds"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(n))).first()
        whole = [max(0.5, (totals[f"s{i}"] or 0.0) + 0.5 * totals["kinds"]) for i in range(n)]
        return seen.select(name, F.array(*(F.log((F.col(f"s{i}") + 0.5) / whole[i]) for i in range(n))).alias(f"{name}_log"))

    zero = F.array(*(F.lit(0.0) for _ in range(n)))
    fused = likely
    for name, found in (("declared", evidence("declared")), ("suffix", evidence("suffix")), ("host", host_p)):
        found = written(found, name)
        fused = fused.join(F.broadcast(found) if found.count() * (n + 2) <= BROADCAST else found, name, "left")
    prior = F.coalesce("host_log", F.transform(base, lambda x: F.log(x)))
    posterior = _softmax(_add(F.col("text_log"), F.coalesce("declared_log", zero), F.coalesce("suffix_log", zero), prior))
    some = F.col("known")
    best = F.array_max("posterior_all")
    names_column = F.array(*(F.lit(x) for x in languages))
    return (
        fused.withColumn("posterior_all", posterior)
        .withColumn("at", F.array_position("posterior_all", best).cast("int"))
        .select(
            "doc_id",
            F.when(some, F.element_at(names_column, F.col("at"))).otherwise("und").alias("language"),
            F.when(some, best).otherwise(0.0).alias("posterior"),
            (some & (best >= threshold)).alias("kept"),
        )
    )


def of_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``documents``: the declared language is ``lang``, the source stands for the host."""
    return identify(docs, id_col=id_col, declared=F.col("lang"), host=F.col("source"))


def _bare_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [html_text.plain(source) for source in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(texts, pa.string())], ["page_id", "said", "end", "at", "text"])


def of_pages(pages: DataFrame) -> DataFrame:
    """``pages``: all four kinds of evidence, from the markup and the address; the text is the page's own, references decoded."""
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)
    said = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\blang=[\"']?([a-z]{2,3})", 1)
    bounded_batches(pages.sparkSession)
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), said.alias("said"), F.substring_index(host, ".", -1).alias("end"), host.alias("at"), text_or_empty("html").alias("html"))
    parts = parts.mapInArrow(_bare_task, "page_id long, said string, end string, at string, text string")
    found = identify(parts, id_col="page_id", declared=F.col("said"), suffix=F.col("end"), host=F.col("at"))
    return found.withColumnRenamed("doc_id", "page_id")


def held_out_accuracy(docs: DataFrame, fold: int = 5, **evidence: Column) -> DataFrame:
    """``language, n, right, kept`` by declared language, over the one in ``fold`` rows whose declaration is hidden from the model.

    Rows are told apart by a key of their own; those without a declaration are left out.
    """
    docs = written(docs.withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    hidden = F.pmod(F.xxhash64("row_key"), F.lit(fold)) == 0
    truth = docs.where(hidden & F.col("lang").isNotNull()).select(F.col("row_key").alias("doc_id"), F.lower("lang").alias("truth"))
    found = identify(docs.withColumn("lang", F.when(~hidden, F.col("lang"))), id_col="row_key", declared=F.col("lang"), **evidence)
    joined = truth.join(found, "doc_id").groupBy("truth")
    return joined.agg(F.count("*").alias("n"), F.sum((F.col("language") == F.col("truth")).cast("long")).alias("right"), F.sum(F.col("kept").cast("long")).alias("kept")).withColumnRenamed("truth", "language")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
