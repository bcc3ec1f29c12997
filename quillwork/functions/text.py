"""Text columns: normalisation, keys, concatenation, similarity."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import Column

SPACE = r"(?U)\s+"


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Composed characters. Workers get null in place of texts that are ASCII, which stay as they are."""
    return F.coalesce(_nfc(F.when(F.length(text) != F.octet_length(text), text)), text)


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-match ratio 2 M / (|a| + |b|); depends on the order of its arguments; null counts as empty."""
    return pd.Series([1.0 if x == y else SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize(text: Column) -> Column:
    """Null to empty, NFC, white space to single spaces, trimmed, lower case."""
    return F.lower(squeeze(nfc(F.coalesce(text, F.lit("")))))


def normalize_punct(text: Column) -> Column:
    """Lower case, punctuation to spaces, squeezed, trimmed; no NFC."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " "))


def name_key(*names: Column) -> Column:
    """The first name that is not empty once separators are single spaces and letters lower case."""
    keyed = [F.nullif(F.lower(F.trim(F.regexp_replace(F.coalesce(n, F.lit("")), r"(?U)[\s_-]+", " "))), F.lit("")) for n in names]
    return F.coalesce(*keyed, F.lit(""))


def pair_key(a: Column, b: Column) -> Column:
    a, b = a.cast("string"), b.cast("string")
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def strip_prefix(tag: Column) -> Column:
    """Text after the first colon, or all of it."""
    at = F.instr(tag, ":")
    return F.when(at > 0, tag.substr(at + 1, F.length(tag))).otherwise(tag)


def schema_version(source: Column) -> Column:
    """Version of the schema that a document names: 6.0, 3.x or null."""
    found = F.regexp_extract(source, r"ddi:[a-z]+:(3_[0-9]+)", 1)
    return F.when(source.rlike("ddi:code:6"), F.lit("6.0")).when(found != "", F.replace(found, F.lit("_"), F.lit(".")))


def strip_bad_namespaces(source: Column) -> Column:
    """Without attributes of the malformed shape ``xmlns:=""...""``."""
    return F.regexp_replace(source, r'\s+xmlns:=""[^"]*""', "")


def concat_text(name: Column, label: Column, description: Column, codes: Column) -> Column:
    """Name, label, description (if any) and ``value: label`` of each code (array of structs), normalised."""
    parts = F.array_join(F.transform(codes, lambda c: F.concat(c["value"], F.lit(": "), c["label"])), " ")
    return normalize(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(label, F.lit("")), F.nullif(F.coalesce(description, F.lit("")), F.lit("")), parts))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the token sets of two punctuation-free texts; 0 if either is empty."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def uid_segments(uid: Column) -> Column:
    return F.split(F.replace(uid, F.lit("_"), F.lit("-")), "-")


def prefix_ratio(a: Column, b: Column) -> Column:
    """Common leading segments of two ids over the longer one's number of segments."""
    x, y = uid_segments(a), uid_segments(b)
    equal = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(equal, F.lit(False))
    return F.when(first == 0, F.size(equal)).otherwise(first - 1) / F.greatest(F.size(x), F.size(y))


def name_similarity(a: Column, b: Column) -> tuple[Column, Column]:
    """Similarity of two names and whether it can be trusted (both of three letters at least, or one empty)."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    both, one = (a == "") & (b == ""), (a == "") | (b == "")
    short = (F.length(a) < 3) | (F.length(b) < 3)
    # Workers see every row; those that the ratio does not decide come as null.
    decided = one | short
    score = F.when(both, 1.0).when(one, 0.0).when(short, 1.0).otherwise(seq_ratio(F.when(~decided, F.lower(a)), F.when(~decided, F.lower(b))))
    return score, both | one | ~short


def embed_text(text: Column, most: int = 8000) -> tuple[Column, Column]:
    return F.substring(text, 1, most), F.length(text) > most
