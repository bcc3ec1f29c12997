"""Near-duplicate lists: blocked candidates, greedy code matching, hybrid score."""

from __future__ import annotations

from collections import defaultdict
from difflib import SequenceMatcher

import pandas as pd
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, Window

from ..functions.text import name_similarity
from .alignment import near_values
from .grouping import components, written
from .signature import representatives
from .valuesets import SMALL, overlapping_lists

#: Lists with more codes are not compared; leftover codes are compared pairwise up to PAIRWISE a side.
MOST_CODES, PAIRWISE = 5000, 100
LEAST_CODE_SIM, INSPECT, DETECT, MATCH = 0.75, 0.80, 0.90, 0.65
#: What of a score goes by the names of two lists; half of the last digit of scores, which are compared as rounded.
NAME_SHARE, HALF_DIGIT = 0.4, 0.00005
#: What to inspect from where detected pairs alone are wanted.
DETECTED = DETECT - HALF_DIGIT
#: Values of fewer characters match only when they are equal; unequal ones match from this ratio.
LONG_VALUE, NEAR_VALUE = 5, 0.9
#: Most values that one class of connected values stands for.
MOST_ALIKE = 32


def _ratio(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def _score(x, y) -> float:
    """How well two codes match: mostly by label if their values agree, hardly at all otherwise."""
    value = _ratio(x["value"], y["value"])
    label = _ratio(x["label"].lower(), y["label"].lower()) if value >= 0.6 else 0.0
    return value * 0.3 + label * 0.7 if value >= 0.9 else (value + label) * 0.2 if value >= 0.6 else 0.0


def _assign(codes, options, b, free: set[int]) -> list:
    """Give each code, in order, its best free partner (the first of equals); returns the codes left over."""
    over = []
    for code in codes:
        score, at = max(((_score(code, b[j]), -j) for j in options(code) if j in free), default=(0.0, 0))
        if score >= MATCH:
            free.discard(-at)
        else:
            over.append(code)
    return over


def match_codes(a, b) -> float:
    """Share of the larger list that finds a partner: first among equal values, then, if few are left, among all."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    by_value = defaultdict(list)
    for j, code in enumerate(b):
        by_value[code["value"]].append(j)
    free = set(range(len(b)))
    over = _assign(a, lambda code: by_value.get(code["value"], ()), b, free)
    if over and len(over) <= PAIRWISE and len(free) <= PAIRWISE:
        over = _assign(over, lambda _: sorted(free), b, free)
    return (len(a) - len(over)) / max(len(a), len(b))


@F.pandas_udf(T.DoubleType())
def code_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([match_codes(x, y) for x, y in zip(a, b, strict=True)])


def whole_classes(near: DataFrame) -> DataFrame:
    """``value, class``: values of ``near (value, near)`` that match each other, all of them and both ways, and no others; at most ``MOST_ALIKE`` of them."""

    @F.pandas_udf("boolean")
    def match(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([min(_ratio(x, y), _ratio(y, x)) >= NEAR_VALUE for x, y in zip(a, b, strict=True)], dtype=bool)

    few = near.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") < MOST_ALIKE)
    sure = near.join(few.select("value"), "value", "left_semi").withColumn("match", match("value", "near"))
    around = sure.groupBy("value").agg(F.collect_set("near").alias("others"), F.bool_and("match").alias("match")).where("match")
    around = around.select("value", F.array_sort(F.array_append("others", F.col("value"))).alias("alike"))
    # Values that are all around each other have the same values around them.
    whole = around.groupBy("alike").agg(F.count("*").alias("n")).where(F.col("n") == F.size("alike"))
    return around.join(whole, "alike", "left_semi").select("value", F.col("alike")[0].alias("class"))


def list_sides(lists: DataFrame, near: DataFrame) -> DataFrame:
    """What most pairs need of ``lists``: ``list_id, name, n_codes, plain, values, pairs``.

    ``values`` and ``pairs`` (with the label) are hashes, of a value that matches others
    those of its class. A list is ``plain`` if no two of its codes can be partners of the same
    code, so that there is nothing to assign: no two share a value or class, and no value is
    near others without a class of its own.
    """
    told = ["list_id", "name", "n_codes"]
    if near.isEmpty():
        values, pairs = F.transform("codes.value", lambda v: F.xxhash64(v)), F.transform("codes", lambda c: F.xxhash64(c["value"], F.lower(c["label"])))
        return lists.select(*told, (F.size(F.array_distinct("codes.value")) == F.size("codes")).alias("plain"), values.alias("values"), pairs.alias("pairs"))
    known = written(near.select("value").distinct().join(whole_classes(near), "value", "left").withColumn("near", F.lit(True)), "near-classes")
    known = F.broadcast(known) if known.count() <= SMALL else known
    codes = lists.select(*told, F.explode("codes").alias("c")).select(*told, "c.value", F.lower("c.label").alias("label")).join(known, "value", "left")
    # Leftover codes find near partners only up to PAIRWISE a side.
    settled = F.col("near").isNull() | (F.col("class").isNotNull() & (F.col("n_codes") <= PAIRWISE))
    codes = codes.select(*told, settled.alias("settled"), F.coalesce("class", "value").alias("value"), "label")
    return codes.groupBy(*told).agg(
        (F.bool_and("settled") & (F.count("value") == F.countDistinct("value"))).alias("plain"), F.collect_list(F.xxhash64("value")).alias("values"), F.collect_list(F.xxhash64("value", "label")).alias("pairs")
    )


def settled_similarity(side: str, other: str) -> Column:
    """Code similarity of two plain lists whose matching values have equal labels, null for others: what ``match_codes`` finds, without it.

    Columns of each side: ``plain``, ``values`` and ``pairs`` (values with lower-case labels) as hashes, ``n_codes``.
    """
    col = lambda c, s: F.col(f"{c}{s}")
    common = F.size(F.array_intersect(col("values", side), col("values", other)))
    agreed = F.size(F.array_intersect(col("pairs", side), col("pairs", other)))
    return F.when(col("plain", side) & col("plain", other) & (common == agreed), common / F.greatest(col("n_codes", side), col("n_codes", other)))


def near_size(n: Column, m: Column) -> Column:
    return F.least(n, m) >= F.greatest(n, m) * LEAST_CODE_SIM


def size_ratio_counts(lists: DataFrame) -> DataFrame:
    """How many pairs of lists pass the size test, by their sizes: ``small, large, n_pairs``. Sizes are counted, pairs are not listed."""
    sizes = lists.groupBy("n_codes").agg(F.count("*").alias("n"))
    x, y = sizes.select(F.col("n_codes").alias("small"), F.col("n").alias("p")), sizes.select(F.col("n_codes").alias("large"), F.col("n").alias("q"))
    # A size meets few others: those up to a third larger.
    reach = x.withColumn("large", F.explode(F.sequence(F.col("small"), F.floor(F.col("small") / LEAST_CODE_SIM))))
    both = reach.join(y, "large").where(near_size(F.col("small"), F.col("large")))
    pairs = F.when(F.col("small") == F.col("large"), F.expr("p * (p - 1) div 2")).otherwise(F.col("p") * F.col("q"))
    return both.select("small", "large", pairs.alias("n_pairs")).where("n_pairs > 0")


def list_near_values(lists: DataFrame) -> DataFrame:
    """``value, near``, both ways: the unequal values of all lists that can match."""
    values = lists.select(F.explode("codes.value").alias("value")).where(F.length("value") >= LONG_VALUE).distinct()
    return written(near_values(values, NEAR_VALUE), "near-values")


def value_classes(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes ``value, class`` of values connected by ``near (value, near)``, if they have at most ``MOST_ALIKE`` values; and ``near`` of the other values."""
    joined = components(near.select(F.col("value").alias("a"), F.col("near").alias("b")))
    joined = written(joined.select(F.col("node").alias("value"), F.col("comp").alias("class")), "value-classes")
    large = joined.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ALIKE)
    return joined.join(large, "class", "left_anti").select("value", "class"), written(near.join(joined.join(large, "class", "left_semi").select("value"), "value", "left_semi"), "alike")


def least_code_similarity(inspect: float) -> float:
    """The code similarity without which no name lifts a score to ``inspect``."""
    return max(LEAST_CODE_SIM, (inspect - NAME_SHARE) / (1 - NAME_SHARE) - 1e-9)


def candidate_pairs(lists: DataFrame, near: DataFrame | None = None, least: float = LEAST_CODE_SIM) -> DataFrame:
    """Pairs that can reach the ``least`` code similarity: ``ida, idb``, the earlier list first.

    ``lists``: ``list_id, ord, n_codes, codes`` (array of value and label in code order).
    A match needs equal values, unless both are long and near each other. So values
    that near ones connect are one class, and of the larger list's classes, repeats
    counted, three quarters must be in the other (``overlapping_lists``). Where very many
    values are connected, as numbered codes are, classes would tell nothing; lists that
    own such values have a second route: one of the ``n - ceil(0.75 n) + 1`` rarest
    values of the earlier list has an equal or near one anywhere in the other.
    """
    near = list_near_values(lists) if near is None else near
    codes = lists.select("list_id", "ord", "n_codes", F.explode("codes.value").alias("value"))
    if near.isEmpty():
        return overlapping_lists(codes, least)
    classes, near = value_classes(near)
    classes = F.broadcast(classes) if classes.count() <= SMALL else classes
    known = codes.where(F.length("value") >= LONG_VALUE).join(classes, "value", "left").withColumn("value", F.coalesce("class", "value")).select("list_id", "ord", "value")
    pairs = overlapping_lists(codes.where(F.length("value") < LONG_VALUE).select("list_id", "ord", "value").unionByName(known), least)
    if near.isEmpty():
        return pairs
    own = codes.distinct()
    own = own.join(own.join(near.select("value").distinct(), "value", "left_semi").select("list_id").distinct(), "list_id", "left_semi")
    reach = near.unionByName(own.select("value", F.col("value").alias("near")).distinct())
    held = own.groupBy(F.col("value").alias("near")).agg(F.count("*").alias("n"))
    spread = reach.join(held, "near").groupBy("value").agg(F.sum("n").alias("df"))
    # Distinct values stand for their repeats: the first codes hold no more distinct values than that.
    at = F.row_number().over(Window.partitionBy("list_id").orderBy("df", "value"))
    first = own.join(spread, "value").withColumn("at", at).where(F.col("at") <= F.col("n_codes") - F.ceil(F.col("n_codes") * LEAST_CODE_SIM) + 1)
    x = first.select("value", F.col("list_id").alias("ida"), F.col("ord").alias("orda"), F.col("n_codes").alias("na")).join(reach, "value")
    y = own.select(F.col("value").alias("near"), F.col("list_id").alias("idb"), F.col("ord").alias("ordb"), F.col("n_codes").alias("nb"))
    sized = x.join(y, "near").where("orda < ordb").where(near_size(F.col("na"), F.col("nb"))).select("ida", "idb")
    return pairs.unionByName(sized).distinct()


def fuzzy_pairs(lists: DataFrame, inspect: float = INSPECT, detect: float = DETECT) -> DataFrame:
    """``a, b, code_sim, name_sim, score, level`` of pairs at or above ``inspect``.

    One list for each full signature takes part, if it has codes, at most
    ``MOST_CODES`` of them, and is no placeholder. Pairs are bounded by their equal
    and near values before they are scored, the more so the higher ``inspect`` is.
    """
    least = least_code_similarity(inspect)
    lists = representatives(lists, "sig").where(F.col("n_codes").between(1, MOST_CODES))
    if "quality_flags" in lists.columns:
        lists = lists.where(~F.array_contains("quality_flags", "placeholder"))
    lists = written(lists.select("list_id", "ord", "name", "n_codes", "codes"), "fuzzy-lists")
    near = list_near_values(lists)
    values = lists.select("list_id", F.explode("codes.value").alias("value"))
    around = values.join(near, "value").groupBy("list_id").agg(F.collect_set("near").alias("near"))
    # What most pairs need is narrow: values and pairs as hashes. Codes are fetched for the pairs that those don't settle.
    own = written(list_sides(lists, near), "fuzzy-sides")
    side = lambda i: own.select(F.col("list_id").alias(f"id{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("name", "n_codes", "plain", "values", "pairs")))
    pairs = candidate_pairs(lists, near, least).join(side("a"), "ida").join(side("b"), "idb").withColumn("settled", settled_similarity("a", "b"))
    pairs = written(pairs.where(F.coalesce("settled", F.lit(1.0)) >= least).select("ida", "idb", "namea", "nameb", "settled"), "fuzzy-candidates")
    codes = lambda i: lists.select(F.col("list_id").alias(f"id{i}"), F.col("codes").alias(f"codes{i}"))
    open_ = pairs.where("settled is null").join(codes("a").join(around.withColumnRenamed("list_id", "ida"), "ida", "left"), "ida").join(codes("b"), "idb")
    # Each match uses up a code of b whose value is equal or near to one of a.
    met = F.size(F.filter(F.col("codesb.value"), lambda v: F.array_contains(F.array_union("codesa.value", F.coalesce("near", F.array().cast("array<string>"))), v)))
    likely = open_.where(met >= F.greatest(F.size("codesa"), F.size("codesb")) * LEAST_CODE_SIM)
    told = ["ida", "idb", "namea", "nameb"]
    scored = likely.select(*told, code_similarity("codesa", "codesb").alias("code_sim")).where(F.col("code_sim") >= LEAST_CODE_SIM)
    scored = scored.unionByName(pairs.where("settled is not null").select(*told, F.col("settled").alias("code_sim")))
    name, trusted = name_similarity(F.col("namea"), F.col("nameb"))
    scored = scored.withColumn("name_sim", name).withColumn("trusted", trusted)
    mixed = F.when(~F.col("trusted"), F.col("code_sim")).otherwise((1 - NAME_SHARE) * F.col("code_sim") + NAME_SHARE * F.col("name_sim"))
    lifted = F.when((F.col("code_sim") >= 0.95) & (F.col("name_sim") < 0.5) & F.col("trusted"), F.greatest(mixed, F.lit(0.95))).otherwise(mixed)
    return scored.withColumn("score", lifted).where(F.col("score") >= inspect).select(
        F.col("ida").alias("a"), F.col("idb").alias("b"), F.round("code_sim", 4).alias("code_sim"), F.round("name_sim", 4).alias("name_sim"), F.round("score", 4).alias("score"), F.when(F.round("score", 4) >= detect, "detected").otherwise("inspect").alias("level")
    )


def detected_pairs(lists: DataFrame) -> DataFrame:
    """The pairs of ``fuzzy_pairs`` whose level is detected, without looking for the others."""
    return fuzzy_pairs(lists, DETECTED).where("level = 'detected'")


def pair_details(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs with what a reviewer sees: names, numbers of codes, shared variables and categories (sorted). ``lists``: ``list_id, name, n_codes, var_ids, cat_ids``."""
    side = lambda i: lists.select(F.col("list_id").alias(i), F.col("name").alias(f"{i}_name"), F.col("n_codes").alias(f"{i}_codes"), F.col("var_ids").alias(f"_v{i}"), F.col("cat_ids").alias(f"_c{i}"))
    shared = lambda c: F.array_sort(F.array_intersect(F.coalesce(f"_{c}a", F.array().cast("array<string>")), F.coalesce(f"_{c}b", F.array().cast("array<string>"))))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select(*pairs.columns, "a_name", "a_codes", "b_name", "b_codes", shared("v").alias("shared_vars"), shared("c").alias("shared_cats"))


def fuzzy_excluded(lists: DataFrame, most: int = MOST_CODES) -> DataFrame:
    return lists.where(F.col("n_codes") > most).select("list_id", "n_codes")


def cross_check(pairs: DataFrame, variables: DataFrame) -> DataFrame:
    """Usage of the two lists of each pair: ``shared, only_a, only_b, usage, ratio``. ``variables``: ``list_id, vars``."""
    side = lambda i: variables.select(F.col("list_id").alias(i), F.array_distinct("vars").alias(f"v{i}"))
    empty = F.array().cast("array<string>")
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("va", F.coalesce("va", empty)).withColumn("vb", F.coalesce("vb", empty))
    shared, all_ = F.array_intersect("va", "vb"), F.array_union("va", "vb")
    same = (F.size(shared) == F.size(all_)) & (F.size(shared) > 0)
    return both.select(
        *pairs.columns, F.array_sort(shared).alias("shared"), F.array_sort(F.array_except("va", "vb")).alias("only_a"), F.array_sort(F.array_except("vb", "va")).alias("only_b"),
        F.when(same, "same").when(F.size(shared) > 0, "partial").otherwise("disjoint").alias("usage"), F.when(F.size(all_) > 0, F.size(shared) / F.size(all_)).otherwise(0.0).alias("ratio"),
    )


def compare_codes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer comparison by lower-case value, the last code of a value on each side: ``pair_id, value, side, same``."""
    side = lambda df, i: df.groupBy("pair_id", F.lower("value").alias("value")).agg(F.max_by("label", "pos").alias(f"label_{i}"))
    both = side(a, "a").join(side(b, "b"), ["pair_id", "value"], "full_outer")
    where = F.when(F.col("label_a").isNull(), "right").when(F.col("label_b").isNull(), "left").otherwise("common")
    return both.select("pair_id", "value", "label_a", "label_b", where.alias("side"), F.coalesce(F.col("label_a") == F.col("label_b"), F.lit(False)).alias("same"))
