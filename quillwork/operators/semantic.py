"""Embedding pairs by blocked matrix products, judging hooks, semantic candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .grouping import written

#: Vectors in one block of the pairwise product, and most pivots.
BLOCK, PIVOTS = 2000, 256
#: Pairs that a task hands on at once.
ROWS = 100_000


def l2_normalize(vector: Column) -> Column:
    """Unit length in double precision; a zero vector stays as it is."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows (id, v)`` with ``cell``, the nearest pivot, and ``angles`` to all pivots."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                angle = np.arccos(np.clip(np.stack(frame["v"].to_numpy()) @ pivots.T, -1, 1))
                yield frame.assign(cell=angle.argmin(1).astype(np.int32), angles=list(angle.astype(np.float32)))

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(task, f"{own}, cell int, angles array<float>")


def cell_pairs(ranges: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of cells, each with itself too, that the triangle inequality leaves.

    ``ranges``: cells x pivots x (least, largest angle of the cell's vectors to the
    pivot). The angle of two vectors is at least the difference of their angles to any
    pivot, so two cells whose ranges lie further apart than the threshold's angle at one
    pivot have no pair. A threshold that is not above 0 leaves all.
    """
    n, reach = len(ranges), np.arccos(min(1.0, threshold)) + 1e-5
    out = []
    for i in range(n):
        gap = np.maximum(ranges[i, :, 0] - ranges[i:, :, 1], ranges[i:, :, 0] - ranges[i, :, 1]).max(1)
        out += [(i, i + int(j)) for j in (range(n - i) if threshold <= 0 else np.flatnonzero(gap <= reach))]
    return out


def metric_cells(vectors: DataFrame, threshold: float, block: int = BLOCK, carry: str | None = None) -> tuple[DataFrame, list[int], list[tuple[int, int]]]:
    """Vectors ``id, v, cell`` (and ``carry``) in unit length, written; how many each cell has; and the pairs of cells to compare.

    Pivots are vectors chosen by a hash of their ids, one for half a block of vectors, at
    most PIVOTS of them. They decide what is skipped, not what is found.
    """
    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), l2_normalize(F.col("embedding")).alias("v"), *([carry] if carry else []))
    if threshold > 0:  # zero vectors have no angle, and reach nothing above 0
        rows = rows.where(F.exists("v", lambda x: x != 0))
    rows = written(rows, "unit-vectors")
    wanted = min(PIVOTS, max(1, -(-2 * rows.count() // block)))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    if not chosen:
        return rows.withColumn("cell", F.lit(0)), [], []
    pivots = np.array([r["v"] for r in chosen])
    celled = written(_cells(rows, pivots), "cells")
    # Cells times pivots rows, however many vectors there are.
    spans = celled.select("cell", F.posexplode("angles").alias("pivot", "angle")).groupBy("cell", "pivot").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")).collect()
    sizes, ranges = [0] * len(pivots), np.full((len(pivots), len(pivots), 2), [np.inf, -np.inf])
    for r in spans:
        sizes[r["cell"]] = r["n"]
        ranges[r["cell"], r["pivot"]] = r["least"], r["most"]
    pairs = [(i, j) for i, j in cell_pairs(ranges, threshold) if sizes[i] and sizes[j]]
    return celled.drop("angles"), sizes, pairs


def _packed(celled: DataFrame, sizes: list[int], pairs: list[tuple[int, int]], block: int, carry: str | None) -> DataFrame:
    """``number, meets, cell, ids, v`` (and ``carried``): one row for each block of a cell, vectors as bytes; ``meets`` are the cells to compare it with."""
    spark = celled.sparkSession
    meets: dict[int, set[int]] = {}
    for i, j in pairs:
        meets.setdefault(i, set()).add(j)
        meets.setdefault(j, set()).add(i)
    # One row for each cell.
    cells = spark.createDataFrame([(i, max(1, -(-sizes[i] // block)), sorted(to)) for i, to in meets.items()], "cell int, blocks int, meets array<int>")
    dealt = celled.join(F.broadcast(cells), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"meets": [rows["meets"].iloc[0]], "cell": [key[0]], "block": [key[1]], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "v": [np.stack(rows["v"].to_numpy()).astype(np.float64).tobytes()]}
        return pd.DataFrame(out | ({"carried": [rows[carry].tolist()]} if carry else {}))

    own = f", carried array<{celled.schema[carry].dataType.simpleString()}>" if carry else ""
    blocks = dealt.groupBy("cell", "block").applyInPandas(pack, f"meets array<int>, cell int, block int, ids binary, v binary{own}")
    # As many files as there are tasks, so that the product has as many parts as its square.
    blocks = blocks.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "cell", "block")
    return written(blocks.withColumn("number", F.xxhash64("cell", "block")), "blocks")


def cosine_pairs(vectors: DataFrame, threshold: float, block: int = BLOCK, carry: str | None = None) -> DataFrame:
    """``a, b, score`` of all pairs ``a < b`` with unrounded cosine >= ``threshold``.

    ``vectors``: ``id, embedding``; null embeddings take no part. Vectors lie in cells
    around pivots, cells in blocks; pairs of cells that are too far apart are skipped,
    every other pair of blocks is a dense product. Blocks are shuffled once, into a table
    of one row each, and meet as they are read: what is shuffled and written, but for the
    pairs, grows with the vectors. With ``carry``, a column of ``vectors``, pairs have it of both: ``carry_a, carry_b``.
    """
    celled, sizes, pairs = metric_cells(vectors, threshold, block, carry)
    spark = vectors.sparkSession
    kind = celled.schema[carry].dataType.simpleString() if carry else ""
    schema = "a long, b long, score double" + (f", `{carry}_a` {kind}, `{carry}_b` {kind}" if carry else "")
    if not pairs:
        return spark.createDataFrame([], schema)
    blocks = _packed(celled, sizes, pairs, block, carry)
    side = lambda s: blocks.select(*(F.col(c).alias(f"{c}_{s}") for c in blocks.columns))
    earlier = F.struct("number_x", "cell_x", "block_x") <= F.struct("number_y", "cell_y", "block_y")
    told = [f"{c}_{s}" for s in "xy" for c in ("number", "cell", "block", "ids", "v", *(["carried"] if carry else []))]
    met = side("x").join(side("y"), earlier & F.array_contains("meets_x", F.col("cell_y"))).select(*told)
    names = ["a", "b", "score"] + ([f"{carry}_a", f"{carry}_b"] if carry else [])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(name) for name in told}
            for r in range(batch.num_rows):
                of = lambda name: column[name][r]  # noqa: B023, E731
                x, y = (np.frombuffer(of(f"ids_{s}").as_buffer(), np.int64) for s in "xy")
                vx, vy = (np.frombuffer(of(f"v_{s}").as_buffer(), np.float64).reshape(len(ids), -1) for s, ids in (("x", x), ("y", y)))
                score = vx @ vy.T
                i, j = np.nonzero(score >= threshold)
                within = (of("cell_x"), of("block_x")) == (of("cell_y"), of("block_y"))
                keep = x[i] < y[j] if within else x[i] != y[j]
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                first = x[i] < y[j]
                out = [np.where(first, x[i], y[j]), np.where(first, y[j], x[i]), score[i, j]]
                out = [pa.array(o) for o in out]
                if carry:
                    both = pa.concat_arrays([of("carried_x").values, of("carried_y").values])
                    j = j + len(x)
                    out += [both.take(pa.array(np.where(first, i, j))), both.take(pa.array(np.where(first, j, i)))]
                made = pa.RecordBatch.from_arrays(out, names)
                yield from (made.slice(at, ROWS) for at in range(0, made.num_rows, ROWS))

    return met.mapInArrow(product, schema)


def list_pairs(pairs: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Best score of each pair of different lists from pairs of their members. ``owners``: ``id, list_id``; unknown ids drop out. Without it ``pairs`` have carried ``list_id_a, list_id_b``."""
    if owners is None:
        both = pairs.select("score", F.col("list_id_a").alias("la"), F.col("list_id_b").alias("lb")).where("la <> lb")
    else:
        side = lambda i: owners.select(F.col("id").alias(i), F.col("list_id").alias(f"l{i}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").where("la <> lb")
    return both.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.max("score").alias("score"))


def top_pairs(pairs: DataFrame, k: int = 20) -> DataFrame:
    """The k best pairs, which are to be judged."""
    return pairs.orderBy(F.desc("score"), "a", "b").limit(k)


def prefix_pairs(lists: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of lists whose user ids share leading segments: ``a, b, score`` at or above the threshold, the earlier list first.

    Exact by an equality join: of the longer id the prefix of ``ceil(t n)`` segments
    must be a prefix of the shorter one.
    """
    segments = F.split(F.replace("user_id", F.lit("_"), F.lit("-")), "-")
    own = lists.where(F.coalesce("user_id", F.lit("")) != "").select("list_id", "ord", segments.alias("s")).withColumn("n", F.size("s"))
    need = F.ceil(F.col("n") * threshold - 1e-9).cast("int")
    long_ = own.withColumn("prefix", F.array_join(F.slice("s", 1, F.greatest(need, F.lit(1))), "-")).select("prefix", *(F.col(c).alias(f"{c}1") for c in ("list_id", "ord", "s", "n")))
    short = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("prefix", F.array_join(F.slice("s", 1, F.col("k")), "-")).select("prefix", *(F.col(c).alias(f"{c}2") for c in ("list_id", "ord", "s", "n")))
    both = long_.join(short, "prefix").where("n1 > n2 or (n1 = n2 and ord1 < ord2)")
    equal = F.array_position(F.zip_with("s1", "s2", lambda p, q: F.coalesce(p == q, F.lit(False))), F.lit(False))
    common = F.when(equal == 0, F.col("n2")).otherwise(equal - 1)
    first = F.col("ord1") < F.col("ord2")
    return both.withColumn("score", common / F.col("n1")).where(F.col("score") >= threshold).select(
        F.when(first, F.col("list_id1")).otherwise(F.col("list_id2")).alias("a"), F.when(first, F.col("list_id2")).otherwise(F.col("list_id1")).alias("b"), "score"
    ).distinct()


def pairs_to_candidates(pairs: DataFrame, judgements: DataFrame | Column | None = None) -> DataFrame:
    """Candidates from ``a, b, score, phase``; judgements ``a, b, confidence`` count by pair, user-id pairs at most 0.80.

    Judgements that ``pairs`` already hold are given as a column, null where there is none; then nothing is joined.
    """
    rows = pairs
    if judgements is None or isinstance(judgements, Column):
        rows = rows.withColumn("_judged", F.lit(None).cast("double") if judgements is None else judgements)
    else:
        rows = rows.join(judgements.select("a", "b", F.col("confidence").alias("_judged")), ["a", "b"], "left")
    by_id = F.col("phase").isin("uid_prefix", "uid_embed")
    kind = F.when(by_id, "semantic_userid").when(F.col("phase") == "direct", "semantic_list").otherwise("semantic_var")
    confidence = F.when(by_id, F.least("score", F.lit(0.8))).otherwise(F.coalesce("_judged", "score"))
    return rows.select(F.col("a").alias("master_id"), F.col("b").alias("slave_id"), kind.alias("detection_type"), F.round(confidence, 4).alias("confidence"))


def judge_prompt(side_a: dict[str, Column], side_b: dict[str, Column]) -> Column:
    """Name (or the start of the id), label and the first ten codes of two lists."""

    def one(tag: str, s: dict[str, Column]) -> Column:
        name = F.coalesce(F.nullif(s["name"], F.lit("")), F.substring(s["id"].cast("string"), 1, 12))
        codes = F.array_join(F.transform(F.slice(s["codes"], 1, 10), lambda c: F.concat(c["value"], F.lit("="), c["label"])), ", ")
        return F.concat(F.lit(f"CodeList {tag} ("), name, F.lit("): "), s["label"], F.lit("\nCodes: "), codes)

    return F.concat(one("A", side_a), F.lit("\n\n"), one("B", side_b))


# What an answer that can't be read says, and (below) the names of an answer's fields.
UNREADABLE = "Réponse non parseable"


def judge_parse(reply: Column) -> Column:
    """``same_concept, confidence, reason`` from the first object in a reply; what cannot be read is a no."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "meme_concept boolean, confiance double, raison string")
    fine = (body != "") & parsed.isNotNull() & F.coalesce(parsed["meme_concept"], parsed["confiance"].cast("boolean"), parsed["raison"].cast("boolean"), F.lit(False)).isNotNull()
    readable = fine & F.from_json(body, "map<string,string>").isNotNull()
    return F.struct(
        F.when(readable, F.coalesce(parsed["meme_concept"], F.lit(False))).otherwise(False).alias("same_concept"),
        F.when(readable, F.coalesce(parsed["confiance"], F.lit(0.0))).otherwise(0.0).alias("confidence"),
        F.when(readable, F.coalesce(parsed["raison"], F.lit(""))).otherwise(UNREADABLE).alias("reason"),
    )


def with_embeddings(rows: DataFrame, embed: Callable[[list[str]], np.ndarray], text: str = "text", batch: int = 128) -> DataFrame:
    """``rows`` with ``embedding`` from a batch function that the caller supplies."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for at in range(0, len(frame), batch):
                found.extend(np.asarray(embed(frame[text].iloc[at : at + batch].fillna("").tolist()), np.float32).tolist())
            yield frame.assign(embedding=found)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(task, f"{schema}, embedding array<float>")


def hash_embed(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder for tests: signed counts of hashed words."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), size), np.float32)
        for i, text in enumerate(texts):
            for word in text.split():
                h = zlib.crc32(word.encode())
                out[i, h % size] += 1 if h >> 31 else -1
        return out

    return embed
