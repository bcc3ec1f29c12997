"""Texts that nearly agree, and the best concept for each variable, by the sequence ratio."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..functions.text import normalize_punct
from .grouping import written

GRAM = 2
#: Concepts in one block (more, where there would be too many blocks), blocks at most, and texts of variables in one slice.
BLOCK, MOST_BLOCKS, SLICE = 64, 4096, 250
#: Rows with one rare gram that meet in one task; more are dealt out by parts.
MEET = 2000
#: Counters of letters.
LETTERS = 64
# Weights of label and description, and the score from which a concept is accepted.
WEIGHTS, ACCEPT = (0.8, 0.2), 0.6


def near_candidates(texts: DataFrame, threshold: float) -> DataFrame:
    """``ida, idb``, the earlier first, of distinct texts ``(id, ord, text, n)`` of n characters that can reach the ratio.

    A ratio of t leaves ``(1 - t) (|a| + |b|)`` characters unmatched at most, and each
    spoils ``GRAM`` grams at most, so near texts share one of their rarest grams;
    repeated grams are told apart by number. Texts too short for that are joined by
    length.
    """
    # The longest partner has n (2 - t) / t characters.
    spoiled = F.floor(F.col("n") * (1 + (2 - threshold) / threshold) * (1 - threshold) + 1e-9) * GRAM
    whole = F.col("n") - GRAM + 1 > spoiled
    near = lambda n, m: F.least(n, m) * (2 - threshold) >= F.greatest(n, m) * threshold
    grams = texts.where(whole).select("id", "ord", "n", (spoiled + 1).alias("keep"), F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n") - GRAM + 1), lambda i: F.col("text").substr(i, F.lit(GRAM)))).alias("pos", "gram"))
    grams = grams.withColumn("nth", F.row_number().over(Window.partitionBy("id", "gram").orderBy("pos")))
    df = grams.groupBy("gram", "nth").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "gram", "nth"))
    prefix = grams.join(df, ["gram", "nth"]).withColumn("at", rank).where("at <= keep")
    side = lambda df, keys, i: df.select(*keys, *(F.col(c).alias(f"{c}{i}") for c in ("id", "ord", "n")))
    # A gram of very many texts is dealt out: every two of its parts meet in a task of their own.
    parts = F.ceil(F.col("df") / MEET).cast("int")
    dealt = prefix.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumn("first", F.least("part", "other")).withColumn("second", F.greatest("part", "other"))
    keys = ["gram", "nth", "first", "second"]
    meeting = side(dealt, [*keys, F.col("part").alias("parta")], "a").join(side(dealt, [*keys, F.col("part").alias("partb")], "b"), keys).where("first = second or parta <> partb")
    pairs = meeting.where("orda < ordb").where(near(F.col("na"), F.col("nb"))).select("ida", "idb")
    short = side(texts.where(~whole).withColumn("len", F.col("n")), ["len"], "a")
    reach = F.explode(F.sequence(F.ceil(F.col("n") * threshold / (2 - threshold)).cast("int"), F.floor(F.col("n") * (2 - threshold) / threshold).cast("int")))
    other = side(texts.withColumn("len", reach), ["len"], "b")
    extra = short.join(other, "len").where("ida <> idb").select(F.when(F.col("orda") < F.col("ordb"), F.col("ida")).otherwise(F.col("idb")).alias("ida"), F.when(F.col("orda") < F.col("ordb"), F.col("idb")).otherwise(F.col("ida")).alias("idb"))
    return pairs.unionByName(extra).distinct()


def near_texts(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``a, b, ratio`` of rows ``(id, ord, text)`` whose ratio reaches the threshold, the earlier one first.

    Equal texts are compared once. Empty texts match nothing.
    """
    texts = rows.where(F.coalesce("text", F.lit("")) != "").groupBy("text").agg(F.min(F.struct("ord", "id")).alias("first")).select("text", F.length("text").alias("n"), F.col("first.ord").alias("ord"), F.col("first.id").alias("id"))
    own = texts.select("id", "text")
    both = near_candidates(texts, threshold).join(own.select(F.col("id").alias("ida"), F.col("text").alias("ta")), "ida").join(own.select(F.col("id").alias("idb"), F.col("text").alias("tb")), "idb")

    @F.pandas_udf("double")
    def reached(a: pd.Series, b: pd.Series) -> pd.Series:
        """The ratio, or 0 where cheaper bounds already lie below the threshold."""
        out = []
        for x, y in zip(a, b, strict=True):
            m = SequenceMatcher(None, x, y)
            out.append(m.ratio() if m.quick_ratio() >= threshold else 0.0)
        return pd.Series(out)

    unequal = both.withColumn("ratio", reached("ta", "tb")).where(F.col("ratio") >= threshold).select("ta", "tb", "ratio")
    # Back to all rows: equal texts with each other, and every row of either text.
    ids = rows.select("id", "ord", "text")
    same = ids.join(texts.select("text", F.col("id").alias("head"), F.col("ord").alias("head_ord")), "text").where(F.col("id") != F.col("head"))
    heads = unequal.join(own.select(F.col("id").alias("a"), F.col("text").alias("ta")), "ta").join(own.select(F.col("id").alias("b"), F.col("text").alias("tb")), "tb")
    return heads.select("a", "b", "ratio").unionByName(same.select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("ratio")))


def near_values(values: DataFrame, threshold: float) -> DataFrame:
    """``value, near``, both ways: distinct unequal values ``(value)`` that can reach the ratio, by the characters they share."""

    @F.pandas_udf("boolean")
    def possible(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).quick_ratio() >= threshold for x, y in zip(a, b, strict=True)], dtype=bool)

    texts = values.where("value <> ''").select(F.col("value").alias("id"), F.col("value").alias("ord"), F.col("value").alias("text"), F.length("value").alias("n")).distinct()
    found = near_candidates(texts, threshold).where(possible("ida", "idb"))
    return found.select(F.explode(F.array(F.struct(F.col("ida").alias("value"), F.col("idb").alias("near")), F.struct(F.col("idb").alias("value"), F.col("ida").alias("near")))).alias("p")).select("p.*")


def letter_counts(texts: list[str]) -> np.ndarray:
    """Texts x LETTERS: how often each character occurs, characters by their number modulo LETTERS."""
    out = np.zeros((len(texts), LETTERS), np.int32)
    for i, text in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS, minlength=LETTERS)
    return out


def ratio_bound(counts: np.ndarray, n: int, others: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """What the ratio of a text of n characters can reach with each of some texts of ``least`` to ``most`` characters that have at most these counts."""
    shared = np.minimum(np.minimum(counts, others).sum(1), np.minimum(n, most))
    return 2 * shared / np.maximum(1, n + np.maximum(least, shared))


class Concepts:
    """A block of concepts: their texts in order, and how often each letter occurs."""

    def __init__(self, options):
        self.rows = [(c["ord"], c["concept"], c["l"], c["d"]) for c in options]
        self.texts = [[r[k] for r in self.rows] for k in (2, 3)]
        self.counts = [letter_counts(t) for t in self.texts]
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in self.texts]

    def summary(self) -> list[np.ndarray]:
        """For labels and definitions the largest counts, and the least and largest sizes."""
        return [x for c, n in zip(self.counts, self.sizes, strict=True) for x in (c.max(0), n.min(), n.max())]

    def best(self, texts: tuple[str, str], top: tuple, matchers: list[SequenceMatcher]) -> tuple:
        """The best of ``top`` (score, ord, concept, ratios computed; of another block only the score) and this block: concepts in the order of their bounds, until those stay below the best."""
        score, order, concept, calls = top
        bounds = [ratio_bound(letter_counts([t])[0], len(t), c, n, n) if t else np.zeros(len(self.rows)) for t, c, n in zip(texts, self.counts, self.sizes, strict=True)]
        total = WEIGHTS[0] * bounds[0] + WEIGHTS[1] * bounds[1]
        for m, t in zip(matchers, texts, strict=True):
            m.set_seq1(t)
        places = [{}, {}]
        for i in np.argsort(-total, kind="stable").tolist():
            if total[i] + 1e-9 < score or total[i] <= 0:
                break
            here, own = self.rows[i][0], self.rows[i][2:]
            # The common subsequence bounds the ratio more closely, label first; equal texts need neither.
            reach = [float(b[i]) for b in bounds]
            for k in (0, 1):
                if texts[k] == own[k]:
                    reach[k] = 1.0 if own[k] else 0.0
                elif reach[k]:
                    places[k] = places[k] or character_places(texts[k])
                    reach[k] = 2 * common_length(places[k], len(texts[k]), own[k]) / (len(texts[k]) + len(own[k]))
                if (least := WEIGHTS[0] * reach[0] + WEIGHTS[1] * reach[1]) + 1e-9 < score:
                    break
            if least + 1e-9 < score or least <= 0:
                continue
            found = []
            for k in (0, 1):
                if texts[k] == own[k] or not reach[k]:
                    found.append(reach[k])
                    continue
                matchers[k].set_seq2(own[k])
                found.append(matchers[k].ratio())
                calls += 1
            value = WEIGHTS[0] * found[0] + WEIGHTS[1] * found[1]
            if value > score or value == score and value > 0 and (order is None or here < order):
                score, order, concept = value, here, self.rows[i][1]
        return score, order, concept, calls


def character_places(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_length(places: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence; the rows of its table are bits."""
    row = full = (1 << n) - 1
    for c in other:
        here = row & places.get(c, 0)
        row = ((row + here) | (row - here)) & full
    return n - row.bit_count()


FOUND = "array<struct<score:double,ord:long,concept:string,calls:long>>"


def _blocks(concepts: DataFrame) -> DataFrame:
    """``block, concepts``: neighbours by label, at most MOST_BLOCKS blocks; no label fills more than its share."""
    held = concepts.select("concept", "ord", normalize_punct(F.col("label")).alias("l"), normalize_punct(F.col("definition")).alias("d")).where("l <> '' or d <> ''")
    n = min(MOST_BLOCKS, max(1, -(-held.count() // BLOCK)))
    dealt = held.repartitionByRange(n, "l", "concept").withColumn("block", F.spark_partition_id())
    return written(dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("ord", "concept", "l", "d"))).alias("concepts")), "concept-blocks")


def _reachable(texts: DataFrame, numbers: list[int], summaries: list[list], first: bool) -> DataFrame:
    """``l, d, score, block``: of each text the block of the highest bound, or all others that can still reach its score."""

    def task(frames):
        blocks = np.array(numbers)
        sides = [[np.array([s[3 * k + j] for s in summaries]) for j in range(3)] for k in (0, 1)]
        for frame in frames:
            kept, held = [], []
            for row, (label, text, score) in enumerate(zip(frame["l"], frame["d"], frame["score"], strict=True)):
                total = np.zeros(len(blocks))
                for w, t, side in zip(WEIGHTS, (label, text), sides, strict=True):
                    if t:
                        total += w * ratio_bound(letter_counts([t])[0], len(t), *side)
                best = int(np.argmax(total))
                go = [best] if first else [i for i in np.flatnonzero((total + 1e-9 >= score) & (total > 0)).tolist() if i != best]
                kept += [row] * len(go)
                held += blocks[go].tolist()
            yield frame.iloc[kept].assign(block=held)

    return texts.select("l", "d", "score").mapInPandas(task, "l string, d string, score double, block int")


def best_concepts(texts: DataFrame, concepts: DataFrame) -> DataFrame:
    """``l, d, score, ord, concept, calls`` of distinct pairs of texts ``(l, d)``: the best concept, and for how many texts the ratio was computed.

    A threshold search. Letters of a block of concepts bound what a text can score in it;
    the bounds of all blocks, some thousand at most, are what every task has. A text is
    compared with its most promising block first, and then only with those whose bounds
    reach its score.
    """
    blocks = _blocks(concepts)

    def summarise(frames):
        for frame in frames:
            yield pd.DataFrame({"block": frame["block"], "summary": [[np.atleast_1d(x).tolist() for x in Concepts(c).summary()] for c in frame["concepts"]]})

    found = blocks.mapInPandas(summarise, "block int, summary array<array<int>>").collect()
    start = texts.select("l", "d", F.lit(0.0).alias("score"))
    if not found:
        return start.select("*", F.lit(None).cast("long").alias("ord"), F.lit(None).cast(concepts.schema["concept"].dataType).alias("concept"), F.lit(0).cast("long").alias("calls"))
    numbers, summaries = [r["block"] for r in found], [[x if len(x) > 1 else x[0] for x in r["summary"]] for r in found]

    @F.pandas_udf(FOUND)
    def best(texts: pd.Series, options: pd.Series) -> pd.Series:
        matchers = [SequenceMatcher(), SequenceMatcher()]
        out = []
        for some, block in zip(texts, options, strict=True):
            held = Concepts(block)
            out.append([dict(zip(("score", "ord", "concept", "calls"), held.best((t["l"], t["d"]), (t["score"], None, None, 0), matchers), strict=True)) for t in some])
        return pd.Series(out)

    def searched(asked: DataFrame) -> DataFrame:
        slices = max(1, -(-asked.count() // SLICE))
        packed = asked.groupBy("block", F.pmod(F.xxhash64("l", "d"), F.lit(slices)).alias("slice")).agg(F.collect_list(F.struct("l", "d", "score")).alias("texts"))
        met = packed.join(blocks, "block").repartition("block", "slice")
        return met.select(F.explode(F.arrays_zip("texts", best("texts", "concepts").alias("found"))).alias("r")).select("r.texts.l", "r.texts.d", "r.found.*")

    first = written(searched(written(_reachable(start, numbers, summaries, True), "first-blocks")), "first-scores")
    others = written(_reachable(first, numbers, summaries, False), "other-blocks")
    every = first.unionByName(searched(others)) if others.count() else first
    top = every.groupBy("l", "d").agg(F.max_by(F.struct("score", "ord", "concept"), F.struct("score", -F.col("ord"))).alias("best"), F.sum("calls").alias("calls"))
    return top.select("l", "d", "best.*", "calls")


def align_best(variables: DataFrame, concepts: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``id, concept, score, status`` of each variable: its best concept by label (and definition).

    ``variables (id, label, description)``, ``concepts (concept, ord, label,
    definition)``. Status: accepted, rejected, or ``no_text`` for variables with
    neither text. The first concept wins ties; a score of 0 names none.
    """
    own = variables.select("id", normalize_punct(F.col("label")).alias("l"), normalize_punct(F.col("description")).alias("d"))
    chosen = best_concepts(own.where("l <> '' or d <> ''").select("l", "d").distinct(), concepts)
    out = own.join(chosen, ["l", "d"], "left")
    status = F.when((F.col("l") == "") & (F.col("d") == ""), "no_text").when(F.col("score") >= accept, "accepted").otherwise("rejected")
    return out.select("id", F.col("concept"), F.coalesce("score", F.lit(0.0)).alias("score"), status.alias("status"))


def alignment_report(aligned: DataFrame, rejected: int = 50) -> DataFrame:
    """``section, id, concept, score``: all accepted ones, the best of the rejected (a report), all without text. The caller sorts."""
    each = lambda status: aligned.where(F.col("status") == status)
    top = each("rejected").orderBy(F.desc("score"), "id").limit(rejected)
    rows = each("accepted").unionByName(top).unionByName(each("no_text"))
    return rows.select(F.col("status").alias("section"), "id", "concept", "score")
