"""Escape codes and quality flags of code lists."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

# How labels that stand for "no answer" begin, in lower case.
ESCAPE_PHRASES = [
    "sans objet",
    "non concerné",
    "non renseigné",
    "non réponse",
    "non répondu",
    "ne sait pas",
    "nsp",
    "refus",
    "indéterminé",
    "hors champ",
    "valeur manquante",
    "non disponible",
    "inconnu",
    "secret",
    "non déclaré",
    "non applicable",
]
# Patterns over normalised values and labels.
ESCAPE_VALUE = r"^(_[a-z]|/)$"
PLACEHOLDER_VALUE = r"^(cf|x{3,})$"
PLACEHOLDER_TEXT = r"(?U)^voir\b|cliquer ici|\bsur [0-9]+ positions\b|\bà [0-9]+ caractères\b"
PLACEHOLDER_SHORT = r"(?U)^code\b"
NUMERIC_RANGE = r"(?U)^(de\s+)?[0-9]+\s*(à|a|-)\s*([0-9]+|n)\b"


def is_escape(value: Column, label: Column) -> Column:
    """Over normalised columns: an escape value with a label, or a label that begins with an escape phrase."""
    begins = F.lit(False)
    for phrase in ESCAPE_PHRASES:
        begins = begins | F.startswith(label, F.lit(phrase))
    return (value.rlike(ESCAPE_VALUE) & (label != "")) | begins


def split_codes(codes: DataFrame) -> DataFrame:
    """``list_id, n_business, n_escape`` over normalised codes."""
    flag = is_escape(F.col("value"), F.col("label"))
    return codes.groupBy("list_id").agg(F.count_if(~flag).alias("n_business"), F.count_if(flag).alias("n_escape"))


def quality_flags(lists: DataFrame, codes: DataFrame) -> DataFrame:
    """``list_id, quality_flags`` (array, in fixed order) for every list, also those without business codes."""
    value, label = F.col("value"), F.col("label")
    business = ~is_escape(value, label)
    some = lambda test: F.coalesce(F.bool_or(business & test), F.lit(False))
    counts = codes.groupBy("list_id").agg(
        F.count_if(business).alias("n"),
        some(value.rlike(PLACEHOLDER_VALUE) | value.rlike(PLACEHOLDER_TEXT) | label.rlike(PLACEHOLDER_TEXT)).alias("refers"),
        some(value.rlike(PLACEHOLDER_SHORT) | label.rlike(PLACEHOLDER_SHORT)).alias("short"),
        some(value.rlike(NUMERIC_RANGE) | label.rlike(NUMERIC_RANGE)).alias("range"),
    )
    few = F.col("n") <= 2
    made = F.array(
        F.when(F.col("refers") | (F.col("short") & few), "placeholder"),
        F.when(F.col("range") & few, "numeric_range"),
        F.when(F.col("n") == 1, "single_code"),
    )
    return lists.select("list_id").join(counts, "list_id", "left").select(
        "list_id", F.coalesce(F.filter(made, lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("quality_flags")
    )
