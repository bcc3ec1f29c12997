"""Mixing to target weights by soft membership.

A classifier fitted on a labelled table gives each document posteriors over the
domains. With a = tokens x posteriors, document rates r >= 0 are sought whose
expected domain totals sum(r a) meet the targets, nearest to all-ones in the
least-squares sense: projected gradient on the squared gap. The gradient of a row's
rate is a times a few numbers that all rows share, so the unprojected point is
1 - a (sum of the steps) and its projection max(0, that): an expression of the row
and of one number a domain, however many steps there were. A step is measured in
the metric of the Gram matrix of the rows that are not at 0; gap and matrix are one
aggregation of a few numbers. Where the gap is closed, these rates are the nearest.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .hashed import Features, Model, labelled_sample
from .shared import bounded_batches, text_or_empty, written
from .words import Words, slices

#: Domains in the order of their labels, with the share of all tokens that each is to have.
TARGETS = {"clean": 0.96, "toxic": 0.015, "low_quality": 0.025}
ROWS_PER_LABEL = 1500


def domain_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, label`` from ``doc_id, quality, toxic``: 0 clean, 1 toxic, 2 of low quality; null where both are null."""
    domain = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).when((F.col("quality") == 1) | (F.col("toxic") == 0), 0)
    return labels.select("doc_id", domain.alias("label"))


def posteriors(docs: DataFrame, labelled: DataFrame, names: list[str], rows_per_label: int = ROWS_PER_LABEL, key_col: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, p`` for each row, and ``key_col`` if given; ``p`` is in the order of ``names``.

    A domain that no label names has posterior 0. With no labels at all every
    domain is as likely as any other.
    """
    bounded_batches(docs.sparkSession)
    sample, counts = labelled_sample(docs, labelled, rows_per_label)
    seen = sorted({r["label"] for r in sample})
    held = docs.sparkSession.sparkContext.broadcast(Model(sample, {c: counts[c] for c in seen}).state() if len(seen) > 1 else None)
    k, default = len(names), np.full(len(names), 1 / len(names))
    if len(seen) == 1:
        default = np.eye(len(names))[seen[0]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.restored(held.value) if held.value else None
        for batch in batches:
            for row, texts in slices(batch):
                words = Words(texts, lower=False)
                p = np.tile(default, (len(texts), 1))
                if model:
                    p = np.zeros((len(texts), k))
                    p[:, model.classes] = model.probabilities(Features(words))
                offsets = pa.array(np.arange(0, p.size + 1, k, dtype=np.int32))
                own = [batch.column(c).slice(row, len(texts)) for c in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([own[0], pa.array(np.diff(words.first)), pa.ListArray.from_arrays(offsets, pa.array(p.ravel())), *own[1:]], ["doc_id", "n_tokens", "p", *keys])

    keys = [key_col] if key_col else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *keys)
    return written(rows.mapInArrow(task, "doc_id long, n_tokens long, p array<double>" + "".join(f", `{c}` long" for c in keys)), "posteriors")


def fit_rates(scored: DataFrame, shares: list[float], tolerance: float = 1e-4, most_steps: int = 100) -> DataFrame:
    """``scored`` with a column ``rate``.

    The targets are the given shares of all tokens, met to ``tolerance`` (relative,
    of a thousandth of all tokens at least). Targets that no rates can meet, as of a
    domain that no document may belong to, are warned of with their gaps; the rates
    are then those of the smallest gap seen. Documents without tokens keep rate 1.
    An empty table stays empty.
    """
    k = len(shares)
    total = scored.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).first()
    if not total["t"]:
        return scored.withColumn("rate", F.lit(1.0))
    unit = total["t"] / total["n"]
    a = [F.col("n_tokens") / unit * F.col("p")[i] for i in range(k)]
    goal = np.array(shares) / sum(shares) * total["n"]
    rate = lambda steps: F.greatest(F.lit(0.0), F.lit(1.0) - sum((a[i] * F.lit(float(steps[i])) for i in range(k)), F.lit(0.0)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    steps, best, least, damped, before = np.zeros(k), np.zeros(k), np.inf, 1.0, np.inf
    for _ in range(most_steps):
        rated = scored.withColumn("rate", rate(steps))
        active = F.when(F.col("rate") > 0, 1.0).otherwise(0.0)
        sums = rated.agg(*(F.sum(F.col("rate") * a[i]).alias(f"s{i}") for i in range(k)), *(F.sum(active * a[i] * a[j]).alias(f"g{i}_{j}") for i, j in pairs)).first()
        gap = np.array([sums[f"s{i}"] for i in range(k)]) - goal
        relative = np.abs(gap / np.maximum(goal, 1e-3 * total["n"]))
        if before == np.inf:  # at the start all rows count: domains that no document may belong to have nothing to adjust
            open_ = np.array([sums[f"g{i}_{i}"] > 0 for i in range(k)])
        worst = float(relative[open_].max())
        if worst < least:
            best, least, missed = steps, worst, relative.max()
        if worst <= tolerance:
            break
        # A step that made the gap much worse went too far.
        damped = damped / 2 if worst > 2 * before else min(1.0, damped * 2)
        before = worst
        gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        steps = steps + damped * (np.linalg.pinv(gram, rcond=1e-10) @ gap)
    if missed > tolerance:
        warnings.warn(f"targets are missed by {missed:.2g} of their size; the last gaps were {(gap / total['n']).round(6).tolist()} of all tokens", stacklevel=2)
    return scored.withColumn("rate", rate(best))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, key_col: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, p, domain, rate`` for each row of ``docs``, and ``key_col`` (a long) if given.

    Tokens are words without white space. Null text has none and keeps rate 1.
    ``domain`` is the likeliest one (the first of equals).
    """
    targets = targets or TARGETS
    names = list(targets)
    scored = posteriors(docs, domain_labels(labels), names, key_col=key_col)
    rated = fit_rates(scored, list(targets.values()))
    best = F.array_position("p", F.array_max("p")).cast("int")
    return rated.withColumn("domain", F.element_at(F.array(*(F.lit(x) for x in names)), best))


def copies(rated: DataFrame, key_col: str | None = None) -> Column:
    """How often a document is drawn: the whole part of its rate, and once more by a hash of its id for the rest.

    Rows that share an id share the hash. Rows without an id are told apart by
    ``key_col`` only.
    """
    # Nulls leave the hash as it is.
    own = [F.when(F.col("doc_id").isNull(), F.col(key_col))] if key_col else []
    share = F.pmod(F.xxhash64("doc_id", F.lit("draw"), *own), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("rate")
    return (whole + (F.col("rate") - whole > share).cast("int")).cast("int")


def drawn(rated: DataFrame, key_col: str | None = None) -> Column:
    """Whether a document is drawn at least once: always at rate 1 or more, else by a hash of its id."""
    return copies(rated, key_col) > 0


def drawn_shares(rated: DataFrame, targets: dict[str, float] | None = None, key_col: str | None = None) -> DataFrame:
    """``domain, target, rate_share, drawn_share, gap`` for each domain, of the tokens that rates and copies give.

    ``gap``: what the drawn share lacks of its target, below 0 where it has too
    much. Shares are null where nothing is drawn.
    """
    targets = targets or TARGETS
    total, k = sum(targets.values()), len(targets)
    tokens = lambda weight, i: F.sum(weight * F.col("n_tokens") * F.col("p")[i])
    sums = rated.withColumn("copies", copies(rated, key_col)).agg(*(tokens(F.col(c), i).alias(f"{c}{i}") for c in ("rate", "copies") for i in range(k)))
    share = lambda c, i: F.col(f"{c}{i}") / F.nullif(sum(F.col(f"{c}{j}") for j in range(k)), F.lit(0.0))
    each = [F.struct(F.lit(name).alias("domain"), F.lit(t / total).alias("target"), share("rate", i).alias("rate_share"), share("copies", i).alias("drawn_share")) for i, (name, t) in enumerate(targets.items())]
    return sums.select(F.inline(F.array(*each))).withColumn("gap", F.col("target") - F.col("drawn_share"))


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rated.select("doc_id", "n_tokens", "domain", *(F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(TARGETS)), "rate", drawn(rated).alias("drawn"), copies(rated).alias("copies"))
