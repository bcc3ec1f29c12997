"""Pairs of lists whose values overlap, found between value sets by a set trie over bit vectors.

Lists count by their set of tokens: each value (or class of values that can match),
numbered where it repeats. Two lists can match in a share ``t`` of the larger one only
if their sets share ``ceil(t max(n, m))`` tokens. With tokens in order of rarity the
first shared token lies in the first ``n - ceil(t n) + 1`` of both, which gives two
routes that together miss nothing:

* it is rare: an equality join on rare tokens of these prefixes, bounded by sizes and
  by what can follow; whole sets are then intersected;
* it is frequent, and so are all shared tokens: the frequent tokens of a set are a bit
  vector, and the vectors lie in a trie, by size and number of bits and then eight bits
  a level. Pairs of its nodes are walked level by level while the bits that they share
  and those that may still follow reach the overlap. At the leaves it is exact.

What comes out are pairs of sets with that overlap and no others; lists are put in
their place at the end, in blocks, so that a set of very many lists fills no task.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .grouping import written

#: Most tokens in a bit vector, of those in more than one in so many sets; the bits of one level.
FREQUENT, ONE_IN, LEVEL = 128, 64, 8
#: Lists of one set in one block. Keys of more lists are fewer than lists / BLOCK and are broadcast up to SMALL of them.
BLOCK, SMALL = 1000, 1_000_000


def needed(n: Column, m: Column, share: float) -> Column:
    """Tokens that two sets must share."""
    return F.ceil(F.greatest(n, m) * share - 1e-9).cast("int")


def token_sets(codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``list_id, ord, set`` and sets ``set, n, tokens`` of ``codes (list_id, ord, value)``; a set is known by a digest of its tokens."""
    counts = codes.groupBy("list_id", "value").agg(F.first("ord").alias("ord"), F.count("*").cast("int").alias("held"))
    numbered = F.transform(F.sequence(F.lit(1), F.col("held")), lambda i: F.concat(i.cast("string"), F.lit(":"), F.col("value")))
    lists = counts.select("list_id", "ord", numbered.alias("part")).groupBy("list_id").agg(F.first("ord").alias("ord"), F.array_sort(F.flatten(F.collect_list("part"))).alias("tokens"))
    lists = written(lists.withColumn("set", F.unhex(F.sha2(F.to_json("tokens"), 256))), "value-lists")
    sets = lists.groupBy("set").agg(F.first("tokens").alias("tokens")).select("set", F.size("tokens").alias("n"), "tokens")
    return lists.select("list_id", "ord", "set"), written(sets, "value-sets")


def _rare_pairs(sets: DataFrame, ordered: DataFrame, share: float) -> DataFrame:
    """``x, y`` of different sets whose first shared token is rare."""
    keep = F.col("n") - needed(F.col("n"), F.col("n"), share) + 1
    prefix = ordered.select("set", "n", F.posexplode(F.slice("ordered", F.lit(1), keep)).alias("at", "t")).where("not t.frequent").select("set", "n", "at", F.col("t.token").alias("token"))
    x, y = (prefix.select("token", F.col("set").alias(s), F.col("n").alias(f"n{s}"), F.col("at").alias(f"at{s}")) for s in "xy")
    need = needed(F.col("nx"), F.col("ny"), share)
    bound = 1 + F.least(F.col("nx") - F.col("atx") - 1, F.col("ny") - F.col("aty") - 1)
    # The place of the token bounds what can still be shared; of the first shared one it is exact, so pairs lost at a later one are found at the first.
    near = x.join(y, "token").where("x < y").where((F.least("nx", "ny") >= need) & (bound >= need)).select("x", "y").distinct()
    side = lambda s: sets.select(F.col("set").alias(s), F.col("n").alias(f"n{s}"), F.col("tokens").alias(f"tokens{s}"))
    both = near.join(side("x"), "x").join(side("y"), "y")
    return both.where(F.size(F.array_intersect("tokensx", "tokensy")) >= need).select("x", "y")


def _trie(ordered: DataFrame, levels: int, share: float) -> DataFrame:
    """``set, n, h, bits``: sets that frequent tokens alone can match, the number of these, and a level's eight bits in each place."""
    place = F.filter("ordered", lambda t: t["frequent"])
    own = ordered.select("set", "n", F.transform(place, lambda t: t["bit"]).alias("at")).withColumn("h", F.size("at")).where(F.col("h") >= needed(F.col("n"), F.col("n"), share))
    level = lambda k: F.aggregate(F.filter("at", lambda b: F.floor(b / LEVEL) == k), F.lit(0), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), b % LEVEL)))
    return own.select("set", "n", "h", F.array(*(level(k) for k in range(levels))).alias("bits"))


def _spread(pairs: DataFrame) -> DataFrame:
    """Pairs over all tasks: few bytes become many rows, which sizes of files and shuffles do not tell."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "y")


def _walk(leaves: DataFrame, levels: int, share: float) -> DataFrame:
    """``x, y``: pairs of leaves ``(leaf, n, h, bits)`` that share enough bits, a leaf with itself too."""
    paths = [F.concat_ws("|", "n", "h", *(F.col("bits")[k] for k in range(d))) for d in range(levels + 1)]
    roots = leaves.select(paths[0].alias("path"), "n", F.col("h").alias("left")).distinct()
    x, y = (roots.select(F.col("path").alias(s), F.col("n").alias(f"n{s}"), F.col("left").alias(f"left{s}")) for s in "xy")
    pairs = x.join(y, F.col("x") <= F.col("y")).withColumn("need", needed(F.col("nx"), F.col("ny"), share)).where(F.least("leftx", "lefty") >= F.col("need"))
    pairs = pairs.select("x", "y", F.lit(0).alias("shared"), "need", "leftx", "lefty")
    for d in range(1, levels + 1):
        nodes = leaves.select(paths[d - 1].alias("parent"), paths[d].alias("node"), F.col("bits")[d - 1].alias("bit")).distinct()
        side = lambda s: nodes.select(F.col("parent").alias(s), F.col("node").alias(f"to{s}"), F.col("bit").alias(f"bit{s}"))  # noqa: B023, E731
        below = _spread(pairs).join(side("x"), "x").join(side("y"), "y").where("x <> y or tox <= toy")
        below = below.withColumn("shared", F.col("shared") + F.bit_count(F.col("bitx").bitwiseAND(F.col("bity"))))
        for s in "xy":
            below = below.withColumn(f"left{s}", F.col(f"left{s}") - F.bit_count(f"bit{s}"))
        pairs = written(below.where(F.col("shared") + F.least("leftx", "lefty") >= F.col("need")).select(F.col("tox").alias("x"), F.col("toy").alias("y"), "shared", "need", "leftx", "lefty"), "trie-level")
    return pairs.select("x", "y")


def _lists(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """``ida, idb``, the earlier list first: lists in place of the keys of ``pairs (x, y)``; of a key with itself its lists with each other."""
    many = members.groupBy(key).agg(F.count("*").alias("lists")).where(F.col("lists") > BLOCK).select(key, F.ceil(F.col("lists") / BLOCK).cast("int").alias("blocks"))
    many = written(many, "many")
    many = F.broadcast(many) if many.count() <= SMALL else many
    dealt = members.join(many, key, "left").select(F.col(key).alias("key"), "list_id", "ord", F.pmod(F.xxhash64("list_id"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
    pairs = _spread(pairs)
    for s in "xy":
        pairs = pairs.join(many.select(F.col(key).alias(s), F.col("blocks").alias(f"blocks{s}")), s, "left")
        pairs = pairs.withColumn(f"block{s}", F.explode(F.sequence(F.lit(0), F.coalesce(f"blocks{s}", F.lit(1)) - 1)))
    pairs = pairs.where("x <> y or blockx <= blocky").select("x", "blockx", "y", "blocky")
    side = lambda s: dealt.select(F.col("key").alias(s), F.col("block").alias(f"block{s}"), F.col("list_id").alias(f"id{s}"), F.col("ord").alias(f"ord{s}"))
    both = pairs.join(side("x"), ["x", "blockx"]).join(side("y"), ["y", "blocky"]).where("x <> y or blockx <> blocky or ordx < ordy")
    first = F.col("ordx") < F.col("ordy")
    return both.select(F.when(first, F.col("idx")).otherwise(F.col("idy")).alias("ida"), F.when(first, F.col("idy")).otherwise(F.col("idx")).alias("idb"))


def overlapping_lists(codes: DataFrame, share: float, frequent: int = FREQUENT, one_in: int = ONE_IN) -> DataFrame:
    """``ida, idb``, the earlier one first: lists that share ``ceil(share max(n, m))`` of their tokens.

    ``codes``: ``list_id, ord, value``, a row for each code; ``ord`` tells all lists
    apart. Null values are left out. ``frequent`` and ``one_in`` say which tokens go
    into bit vectors; they cost or save time and change no result.
    """
    members, sets = token_sets(codes.where(F.col("value").isNotNull()))
    # Only the most frequent tokens, at most `frequent` of them, come to the driver.
    n_sets = sets.count()
    df = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    df = written(df, "token-counts")
    top = [r["token"] for r in df.where(F.col("df") > n_sets / one_in).orderBy(F.desc("df"), "token").limit(frequent).collect()]
    bits = F.broadcast(sets.sparkSession.createDataFrame([(t, i) for i, t in enumerate(top)], "token string, bit int"))
    each = sets.select("set", "n", F.explode("tokens").alias("token")).join(df, "token").join(bits, "token", "left")
    ordered = each.groupBy("set", "n").agg(F.array_sort(F.collect_list(F.struct(F.col("bit").isNotNull().alias("frequent"), "df", "token", "bit"))).alias("ordered"))
    ordered = written(ordered, "ordered-sets")
    same = sets.select(F.col("set").alias("x"), F.col("set").alias("y"))
    found = _lists(_rare_pairs(sets, ordered, share).unionByName(same), members, "set")
    if top:
        levels = -(-len(top) // LEVEL)
        trie = _trie(ordered, levels, share).withColumn("leaf", F.concat_ws("|", "n", "h", F.array_join(F.transform("bits", lambda b: b.cast("string")), "|")))
        trie = written(trie, "trie")
        leaves = trie.select("leaf", "n", "h", "bits").distinct()
        found = found.unionByName(_lists(_walk(leaves, levels, share), members.join(trie.select("set", "leaf"), "set"), "leaf"))
    return found.distinct()
