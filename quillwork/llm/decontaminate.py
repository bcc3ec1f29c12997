"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``WINDOW`` consecutive words of an item (all of them, if it has fewer); as
a set it consists of its shingles of ``SHINGLE`` words at their offsets. A document
holds a window when it holds all of these at consecutive places, so containment is
total and of the shingles in order of rarity the prefix that must be joined is one
long: the shingle that the fewest places of all documents hold. A window whose rarest
shingle occurs nowhere is settled by that count alone.

1. Every place of every document whose words are a shingle of some item is found by a
   hash join in the scan and compared by its words; only such places are written.
2. They are counted by shingle over all documents: the order of rarity.
3. Places of a window's rarest shingle are joined with the window; where the window
   would begin or end outside of the document (bounds by position and length), it goes.
4. What is left is verified: each other shingle must lie at its own offset.

Everything is DataFrame code; no row, window or place is left out at any size.
"""

from __future__ import annotations

import string

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .shared import join_small, table, text_or_empty, written

WINDOW, SHINGLE = 10, 5
#: Distinct shingles of items that one pass over the documents looks for (some 80 bytes each, broadcast); more take more passes.
BLOCK = 1_000_000

#: What separates words once A-Z are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS, -1), "")


def _key(k: int, at: Column) -> Column:
    """Hash of the k words from ``at`` on; equal hashes are compared by words later."""
    return F.xxhash64(*(F.get("words", at + j) for j in range(k)))


def _shingle(k: Column, at: Column) -> Column:
    # Words hold no spaces, so equal texts are equal words.
    return F.array_join(F.slice("words", at + 1, k), " ")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``wid, words, items`` of the distinct windows: the ids (as strings, sorted) of the items that have each."""
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(text_or_empty()).alias("all")).where(F.size("all") > 0)
    each = own.select("item", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))).alias("at"))
    distinct = each.select("item", F.slice("all", F.col("at") + 1, window).alias("words")).groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return written(distinct.select(F.monotonically_increasing_id().alias("wid"), "words", "items"), "windows")


def _places(docs: DataFrame, shingles: DataFrame, sizes: list[int], first: bool) -> DataFrame:
    """``key, doc_id, n_words, base, pos, sid``: where documents hold one of ``shingles``, and with ``first`` a row for each document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    each = texts.select("doc_id", "text", words(F.col("text")).alias("words")).select("*", F.posexplode_outer("words").alias("pos", "_"))
    # The array stays a variable of the generated code: rows are built only for places that match.
    each = each.withColumn("k", F.explode(F.array(*map(F.lit, sizes))) if len(sizes) > 1 else F.lit(sizes[0]))
    key = F.lit(None).cast("long")
    for k in sizes:
        key = F.when((F.col("k") == k) & (F.col("pos") + k <= F.size("words")), _key(k, F.col("pos"))).otherwise(key)
    each = each.withColumn("hash", key)
    found = each.join(F.broadcast(shingles), (F.col("hash") == F.col("shingle_hash")) & (_shingle(F.col("k"), F.col("pos")) == F.col("shingle")), "left")
    base = (F.coalesce("pos", F.lit(0)) == 0) & (F.col("k") == sizes[0]) if first else F.lit(False)
    kept = found.where(F.col("sid").isNotNull() | base)
    # Rows are told apart by id and text; what repeats as a whole is counted.
    return kept.select(F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), 256)).alias("key"), "doc_id", F.size("words").alias("n_words"), base.alias("base"), "pos", "sid")


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` for each row of ``docs (doc_id, text)``.

    ``spans``: ``start, n`` of every occurrence of a window of ``items (item_id,
    text)``, in words from 0, in order; ``n_hit``: words inside any of them; ``items``:
    ids of the items whose windows occur, sorted as strings. Words are runs of digits,
    letters a-z (A-Z in lower case) and characters beyond ASCII. Null text has no
    words; items without words have no window; an item without an id counts as the
    item ``''``; items that share an id count as one. Documents may share an id, lack
    it or repeat: each row has its own row. Extra columns are not looked at. Empty
    tables give no documents, or documents without hits.

    The shingles of items are broadcast, at most ``block`` in one pass over the
    documents; what later steps join is of the size of what occurs.
    """
    wins = item_windows(items, window)
    k = F.least(F.size("words"), F.lit(shingle))
    parts = wins.select("wid", "words", k.alias("k"), F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("off"))
    parts = written(parts.select("wid", "k", "off", _shingle(F.col("k"), F.col("off")).alias("shingle"), F.slice("words", F.col("off") + 1, F.col("k")).alias("words")), "parts")
    distinct = parts.groupBy("k", "shingle").agg(F.first("words").alias("words"))
    sizes = sorted((r["k"] for r in distinct.select("k").distinct().collect()), reverse=True) or [shingle]  # at most `shingle` numbers
    hashed = F.coalesce(*(F.when(F.col("k") == n, _key(n, F.lit(0))) for n in sizes))
    shingles = written(distinct.select(F.monotonically_increasing_id().alias("sid"), F.col("k").alias("shingle_k"), "shingle", hashed.alias("shingle_hash")), "shingles")
    passes = max(1, -(-shingles.count() // block))
    places = None
    for i in range(passes):
        part = shingles.where(F.pmod("shingle_hash", F.lit(passes)) == i).select("sid", "shingle", "shingle_hash")
        found = _places(docs, part, sizes, first=i == 0)
        places = found if places is None else places.unionByName(found)
    places = written(places, "places")
    found = places.where("sid is not null")

    # The order of rarity; what no document holds is not in it, and windows with such a part are settled.
    rarity = found.groupBy("sid").agg(F.count("*").alias("df"))
    numbered = parts.join(shingles.select(F.col("shingle_k").alias("k"), "shingle", "sid"), ["k", "shingle"]).join(rarity, "sid", "left")
    ordered = numbered.groupBy("wid").agg(F.min(F.struct("df", "sid", "off")).alias("rarest"), F.array_sort(F.collect_list(F.struct("off", "sid"))).alias("parts"), F.max(F.col("df").isNull()).alias("absent"))
    prefixes = written(
        ordered.where("not absent").join(wins.select("wid", F.size("words").alias("n"), "items"), "wid")
        .select(F.col("rarest.sid").alias("sid"), F.col("rarest.off").alias("off"), "wid", "n", "parts", "items"),
        "prefixes",
    )
    weight = prefixes.agg(F.sum(F.size("items") + F.size("parts"))).first()[0] or 0
    at = join_small(found.select("key", "n_words", "pos", "sid").distinct(), prefixes, "sid", weight)
    at = at.withColumn("start", F.col("pos") - F.col("off")).where("start >= 0 and start + n <= n_words").select("key", "start", "wid", "n", "parts", "items")
    wanted = at.select("key", "start", "wid", "n", F.explode("parts").alias("part"), F.size("parts").alias("of")).select("key", "start", "wid", "n", "of", (F.col("start") + F.col("part.off")).alias("pos"), F.col("part.sid").alias("sid"))
    verified = wanted.join(found.select("key", "pos", "sid").distinct(), ["key", "pos", "sid"]).groupBy("key", "start", "wid").agg(F.count("*").alias("held"), F.max("of").alias("of"), F.max("n").alias("n")).where("held = of")
    ids = prefixes.select("wid", "items")
    verified = join_small(verified, ids, "wid", weight)
    hits = verified.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["total"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a["end"], x["start"]))).alias("total"), F.greatest(a["end"], x["start"] + x["n"]).alias("end")),
        lambda a: a["total"].cast("long"),
    )
    each = places.where("base").groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.count("*").cast("int").alias("copies"))
    rows = each.join(hits.withColumn("n_hit", covered), "key", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = rf"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
d AS (SELECT r, doc_id, list_filter(regexp_split_to_array(t, '{SEPARATORS}'), lambda x: x <> '') AS w FROM low),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{SEPARATORS}'), lambda x: x <> '') AS w
  FROM benchmark
), starts AS (SELECT item_id, w, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[s + 1 : s + {WINDOW}], ' ') AS t FROM starts),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n),
grams AS (SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS t FROM spots),
hit AS (SELECT r, s, win.n, item_id FROM grams JOIN win ON grams.t = win.t AND grams.n = win.n),
marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN found USING (r)
"""
