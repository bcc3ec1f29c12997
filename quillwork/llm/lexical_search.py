"""Ranked lexical search as inner products: norm buckets with bounds by length and coordinate.

An item is a vector of term weights, a document the vector of its impacts on the
terms of the items, and a score is their inner product. Documents lie in buckets by
the length (norm) of their vectors, which are searched from the longest on, in
rounds. Within a bucket, for each item and the score ``least`` that its k-th best
document so far has:

* Cauchy-Schwarz: if ``|item| * longest`` is below ``least``, the bucket is out for
  the item, and with it every later one. Buckets that are out for all items are not
  read.
* Coordinate bounds: with the item's coordinates from the largest on, the shortest
  row of them is taken whose rest cannot reach ``least`` alone; documents without any
  of these terms are out. For the others the products of those coordinates, plus the
  norm of the rest of the item times the norm of the rest of the document, bound the
  score.
* What survives is scored exactly, in 64-bit integers.

Bounds are in doubles with room for their rounding and drop only what lies strictly
below ``least``, so ties are kept and the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from .shared import LAST, bounded_batches, table, text_or_empty, written
from .words import Words, slices

TOP = 10
#: Characters of items that are searched for at once; more take more turns over the documents.
ITEM_CHARS = 32 << 20
#: Documents that a task searches at once; most and least documents for which there is a part of each bucket.
TOGETHER, PART, SMALL_PART = 16_384, 200_000, 2_000
#: Room for the rounding of bounds.
SLACK = 1 + 1e-9

#: Terms are runs of digits, letters and bytes beyond ASCII.
TERM_BYTES = frozenset([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Fixed values of the impact: scale, saturation in thousandths, and the shares of length in hundredths.
SCALE, PER_TF, PER_LENGTH, FLOOR, SLOPE = 1_000_000_000, 1000, 8, 10, 90


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Terms(Words):
    """Words whose separators are all ASCII characters but digits and letters."""

    separates = np.array([b not in TERM_BYTES for b in range(256)])


class Vocabulary:
    """The terms of a block of items, sorted by hash. Matches are compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        own = Terms(sorted(set(terms)), lower=False)
        order = np.argsort(own.hash, kind="stable")
        self.hash, self.terms = own.hash[order], [own.texts[i] for i in order]
        self.sizes = np.array([len(t) for t in self.terms], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.terms), np.uint8)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words that are terms, and their terms."""
        if not len(self.hash) or not len(words.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        term = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        size = words.ends - words.starts
        at = np.flatnonzero((self.hash[term] == words.hash) & (self.sizes[term] == size))
        term, size = term[at], size[at]
        if len(at):
            first = np.cumsum(size) - size
            inside = np.arange(int(size.sum())) - np.repeat(first, size)
            same = words.buf[np.repeat(words.starts[at], size) + inside] == self.bytes[np.repeat(self.begin[term], size) + inside]
            equal = np.logical_and.reduceat(same, first)
            at, term = at[equal], term[equal]
        return at, term


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a column of lists."""
    bounds = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(np.int64), bounds - bounds[0]


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, tfs``: number of terms of each document, and which of the vocabulary it holds how often."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(vocabulary)
        for batch in batches:
            for row, texts in slices(batch):
                words = Terms(texts)
                at, term = known.find(words)
                keys, tfs = np.unique(words.doc[at] * max(1, len(known.hash)) + term, return_counts=True)
                doc, term = np.divmod(keys, max(1, len(known.hash)))
                bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), pa.array(np.diff(words.first).astype(np.int64)), _lists(term, bounds), _lists(tfs, bounds)], ["doc_id", "n", "terms", "tfs"]
                )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(task, "doc_id long, n long, terms array<int>, tfs array<int>")


def impact_vectors(counts: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``doc_id, bucket, part, norm, terms, impacts`` of documents with a term of the items; buckets are half octaves of the norm."""
    # A bucket may hold nearly all documents, as where most are copies; its parts keep all tasks busy.
    parts = max(1, n_docs // PART, min(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_docs // SMALL_PART))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            terms, bounds = _flat(batch.column(2))
            tf, n = _flat(batch.column(3))[0], batch.column(1).to_numpy()
            m = FLOOR + (SLOPE * n * n_docs) // n_terms
            impact = (SCALE * tf) // (PER_TF * tf + PER_LENGTH * np.repeat(m, np.diff(bounds)))
            norm = np.sqrt(np.add.reduceat(impact.astype(float) ** 2, bounds[:-1])) if len(impact) else np.zeros(len(n))
            bucket = np.floor(2 * np.log2(np.maximum(norm, 1))).astype(np.int32)
            # Dealt in turn: equal texts have equal norms and may be very many.
            part = (np.arange(at, at + len(n)) % parts).astype(np.int32)
            at += len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bucket), pa.array(part), pa.array(norm), _lists(terms, bounds), _lists(impact, bounds)], ["doc_id", "bucket", "part", "norm", "terms", "impacts"]
            )

    rows = counts.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs")
    return rows.mapInArrow(task, "doc_id long, bucket int, part int, norm double, terms array<int>, impacts array<int>")


class Query:
    """An item's coordinates, largest first, and the norm of what follows each."""

    def __init__(self, number: int, terms: list[int], weights: list[int], least: int = 0):
        order = sorted(range(len(terms)), key=lambda i: (-weights[i], terms[i]))
        self.number, self.least = number, least
        self.terms, self.weights = (np.array([v[i] for i in order], np.int64) for v in (terms, weights))
        squares = self.weights.astype(float) ** 2
        self.rest = np.sqrt(np.append(np.cumsum(squares[::-1])[::-1], 0.0))

    def state(self) -> tuple:
        return self.number, self.terms.tolist(), self.weights.tolist(), self.least


class Block:
    """Vectors of some documents, by document and by term."""

    def __init__(self, doc_id: np.ndarray, norm: np.ndarray, terms: np.ndarray, impacts: np.ndarray, bounds: np.ndarray):
        self.doc_id, self.norm, self.terms, self.impacts, self.bounds = doc_id, norm, terms, impacts, bounds
        self.longest = float(norm.max())
        order = np.argsort(terms, kind="stable")
        self.rows = np.repeat(np.arange(len(norm)), np.diff(bounds))[order]
        self.by_term, self.held = impacts[order], terms[order]

    def survivors(self, query: Query) -> np.ndarray:
        """Rows that the bounds leave."""
        # rest falls, so the coordinates whose rest can still reach the least score come first; with none reached all count.
        focus = int(np.count_nonzero(query.rest[:-1] * self.longest * SLACK >= query.least))
        if focus == 0:
            return np.zeros(0, np.int64)
        known, square, seen = np.zeros(len(self.norm)), np.zeros(len(self.norm)), np.zeros(len(self.norm), bool)
        begin, end = (np.searchsorted(self.held, query.terms[:focus], side) for side in ("left", "right"))
        for w, i, j in zip(query.weights[:focus].tolist(), begin.tolist(), end.tolist(), strict=True):
            rows, impact = self.rows[i:j], self.by_term[i:j].astype(float)
            known[rows] += w * impact
            square[rows] += impact * impact
            seen[rows] = True
        rows = np.flatnonzero(seen)
        bound = known[rows] + query.rest[focus] * np.sqrt(np.maximum(self.norm[rows] ** 2 * SLACK - square[rows], 0))
        return rows[bound * SLACK >= query.least]

    def scores(self, query: Query, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores; ``dense`` has a zero for each term and is left so."""
        dense[query.terms] = query.weights
        size = self.bounds[rows + 1] - self.bounds[rows]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first - self.bounds[rows], size)
        out = np.add.reduceat(dense[self.terms[at]] * self.impacts[at], first) if len(rows) else np.zeros(0, np.int64)
        dense[query.terms] = 0
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Batches ``doc_id, norm, terms, impacts`` put together to blocks, in their order."""

    def block(held: list[pa.RecordBatch]) -> Block:
        all_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        terms, bounds = _flat(all_.column(2))
        ids = all_.column(0).fill_null(LAST).to_numpy()
        return Block(ids, all_.column(1).to_numpy(), terms, _flat(all_.column(3))[0], bounds)

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= TOGETHER:
            yield block(held)
            held, rows = [], 0
    if held:
        yield block(held)


def search(vectors: DataFrame, queries: list[tuple], n_vocabulary: int, top: int) -> DataFrame:
    """``query, doc_id, score``: of every task the documents that can be among the ``top`` of a query, ids as ranked (missing ones last)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, dense = [Query(*q) for q in queries], np.zeros(n_vocabulary, np.int64)
        best = {q.number: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for q in asked}
        for block in _blocks(batches):
            for query in asked:
                rows = block.survivors(query)
                if not len(rows):
                    continue
                score = block.scores(query, rows, dense)
                ids, scores = (np.concatenate(v) for v in zip(best[query.number], (block.doc_id[rows[score > 0]], score[score > 0]), strict=True))
                first = np.lexsort((ids, -scores))[:top]
                best[query.number] = ids[first], scores[first]
                if len(first) == top:
                    query.least = max(query.least, int(scores[first[-1]]))
        number = np.repeat(np.array(list(best), np.int32), [len(ids) for ids, _ in best.values()]) if best else np.zeros(0, np.int32)
        columns = [number, *(np.concatenate([np.zeros(0, np.int64), *(b[i] for b in best.values())]) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "doc_id", "score"])

    return vectors.select("doc_id", "norm", "terms", "impacts").mapInArrow(task, "query int, doc_id long, score long")


def _best(found: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= top)


def _rounds(buckets: list[int]) -> Iterator[list[int]]:
    """The longest vectors first, and each time twice as many buckets."""
    buckets, n = sorted(buckets, reverse=True), 1
    while buckets:
        yield buckets[:n]
        buckets, n = buckets[n:], 2 * n


def _items(items: DataFrame) -> DataFrame:
    """``item_id, terms, block``: the distinct terms of each item, in blocks that bound what is held at once."""
    rows = items.select("item_id", text_or_empty().alias("text")).distinct()
    blocks = max(1, -(-int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS))
    return written(rows.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int").alias("block")), "items")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0.

    ``docs (doc_id, text)``, ``items (item_id, text)``. Terms are runs of digits,
    letters and characters beyond ASCII, A-Z in lower case; null text has none. Equal
    scores are ranked by id, rows without an id last. Each row of ``docs`` is a document
    of its own, rows that share an id too. Items that share an id are ranked each for
    itself; equal ones count once. Items without terms, and all items where no document
    has a term, have no rows. Extra columns are not looked at.

    Items are searched for in blocks of some ``ITEM_CHARS`` characters, which is what
    the driver and every task hold.
    """
    spark = docs.sparkSession
    asked = _items(items)
    out = None
    for number in sorted(r["block"] for r in asked.select("block").distinct().collect()):
        found = _rank_block(docs, asked.where(F.col("block") == number).select("item_id", "text").collect(), asked.schema["item_id"].dataType.simpleString(), top)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long") if out is None else out


def _rank_block(docs: DataFrame, items: list, id_type: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    split = []
    for row in items:
        words = Terms([row["text"].encode()])
        split.append({words.buf[i:j].tobytes() for i, j in zip(words.starts, words.ends, strict=True)})
    terms = Vocabulary([t for each in split for t in each]).terms
    place = {t: i for i, t in enumerate(terms)}
    counts = written(term_counts(docs, terms), "term-counts")
    total = counts.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    best = spark.createDataFrame([], "query int, doc_id long, score long")
    if total["docs"]:
        df = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect())
        weights = [weight(total["docs"], df.get(i, 0)) for i in range(len(terms))]
        # Terms of no weight, or of no document, add nothing to any score.
        queries = [Query(q, used, [weights[t] for t in used]) for q, each in enumerate(split) if (used := [place[t] for t in each if df.get(place[t]) and weights[place[t]] > 0])]
        vectors = impact_vectors(counts, total["docs"], total["terms"]).repartition("bucket", "part")
        path = written(vectors.sortWithinPartitions(F.desc("norm")), "vectors", partition="bucket")
        sizes = {r["bucket"]: r["longest"] for r in path.groupBy("bucket").agg(F.max("norm").alias("longest")).collect()}
        for buckets in _rounds(list(sizes)):
            longest = max(sizes[b] for b in buckets)
            live = [q.state() for q in queries if q.rest[0] * longest * SLACK >= q.least]
            if not live:
                break
            found = search(path.where(F.col("bucket").isin(buckets)), live, len(terms), top)
            best = written(_best(best.unionByName(found), top), "best")
            least = {r["query"]: r["score"] for r in best.where(F.col("rank") == top).collect()}
            for q in queries:
                q.least = least.get(q.number, 0)
            best = best.drop("rank")
    names = spark.createDataFrame([(q, row["item_id"]) for q, row in enumerate(items)], f"query int, item_id {id_type}")
    ranked = _best(best, top).join(F.broadcast(names), "query")
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "score")


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM d WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
t AS (SELECT DISTINCT q, unnest(w) AS term FROM i),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
p AS (SELECT r, term, ({SCALE} * tf) // ({PER_TF} * tf + {PER_LENGTH} * ({FLOOR} + CAST(({SLOPE} * len(w) * n_docs) // n_terms AS BIGINT))) AS impact FROM tf JOIN d USING (r), s),
score AS (SELECT q, r, CAST(sum(w * impact) AS BIGINT) AS score FROM t JOIN w USING (term) JOIN p USING (term) GROUP BY q, r),
ranked AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN i USING (q) WHERE rank <= {TOP}
"""
