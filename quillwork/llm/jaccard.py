"""n-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct 5-word shingles; documents with equal sets
are one node. Tokens are ordered by class (rare, then frequent) and hash.

* Rare tokens are indexed singly, within the first ``n - ceil(t n) + 1`` tokens.
* Frequent tokens are indexed as combinations of two: a pair at or above the
  threshold whose common tokens are all frequent has two of them that stand side
  by side in both sets, within an extended prefix. Proof: let the sets have s
  tokens together, o >= t s / (1 + t) of them common. The first k common tokens
  lie in the first n - o + k tokens of either set, so their gaps in both add up
  to at most s - 2 o + 2 k - 2. If all k - 1 gaps were 3 or more (1 + 1 is the
  least), that sum would be 3 (k - 1) at least; it is less for k = s - 2 o + 2.

If the first common token is rare, the single index has it; else all common
tokens are frequent and the combination index has one. Nothing else is pruned,
so no link is lost. Frequent is what more than ``frequent`` documents have, by
counts over all documents, at most ``most_frequent`` tokens, which bounds what is
broadcast; a token beyond that bound counts as rare, which costs time only.

Candidates are checked in two rounds against whole sets: first each node against
the one it shares most index entries with, then all candidates that still lie in
different components. A bitmap of a few bits a token rules out most pairs before
their sets are fetched; it proves what it rules out.

The links of each document are counted on demand: every link lies within a
component, so the whole sets of each component's nodes are compared, block by
block, in one pass that emits counts and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .components import components
from .shared import bounded_batches, join_small, rank_id, text_or_empty, written
from .words import Words, from_planes, mix, planes, slices

#: Tokens or index entries that a task gathers before it packs and passes them on.
GATHER = 700_000


def node_of(tokens: np.ndarray) -> int:
    """One 64-bit name for a set of tokens, 0 for the empty set."""
    if not len(tokens):
        return 0
    k = np.arange(1, len(tokens) + 1, dtype=np.uint64)
    return int(mix(np.array([mix(tokens * (k * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(dtype=np.uint64)], np.uint64))[0].astype(np.int64))


def _parts(order_key: np.ndarray, buckets: int):
    """Row numbers of each bucket, in the order of the 64-bit keys within it."""
    bucket = (order_key % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((order_key, bucket))
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, order[bounds[b] : bounds[b + 1]]) for b in range(buckets) if bounds[b] < bounds[b + 1]]


def _count_task(shingle: int, buckets: int):
    def flush(held):
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        parts = _parts(tokens, buckets)
        high = (tokens >> np.uint64(32)).astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, _ in parts], pa.int32()),
                pa.array([planes(high[rows]) for _, rows in parts], pa.binary()),
                pa.array([planes(counts[rows].astype(np.uint32)) for _, rows in parts], pa.binary()),
            ],
            ["bucket", "tokens", "counts"],
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, texts in slices(batch, 0):
                for tokens in Words(texts).shingle_sets(shingle):
                    held.append(tokens)
                    size += len(tokens)
                if size > GATHER:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return task


def _frequent_in_bucket(least: int):
    def reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tokens = np.concatenate([from_planes(x.as_py(), np.uint32) for x in table["tokens"]])
        counts = np.concatenate([from_planes(x.as_py(), np.uint32) for x in table["counts"]])
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        total = np.add.reduceat(counts.astype(np.int64), at)
        keep = total > least
        code = (tokens[at][keep].astype(np.int64) << 20) | key[0].as_py()
        return pa.table({"code": pa.array(code, pa.int64()), "df": pa.array(total[keep], pa.int64())})

    return reduce


def _codes(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)).astype(np.int64) << 20) | (tokens % np.uint64(buckets)).astype(np.int64)


def _index_task(shingle: int, threshold: float, buckets: int, frequent):
    def keys_of(tokens: np.ndarray, often: np.ndarray) -> np.ndarray:
        n = len(tokens)
        rare, common = tokens[~often], tokens[often]
        need = -int(-threshold * n // 1)
        singles = rare[: n - need + 1]
        extended = min(n, int(np.ceil(n - (n + need) * (3 * threshold / (1 + threshold) - 1))) + 3)
        # All common tokens of a pair found by combinations are frequent, so there must be enough of them.
        common = common[: max(0, extended - len(rare))] if len(common) >= need else common[:0]
        return np.concatenate([singles, mix(common[:-1] * np.uint64(0x9E3779B97F4A7C15) + common[1:])])

    def flush(keys, nodes, sizes, rares):
        which = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
        keys, nodes, sizes, rares = np.concatenate(keys), np.array(nodes, np.int64), np.array(sizes, np.uint32), np.array(rares, np.uint32)
        parts = _parts(keys, buckets)
        high = (keys >> np.uint64(32)).astype(np.uint32)
        out = {"bucket": [], "tokens": [], "which": [], "nodes": [], "sizes": [], "rares": []}
        for b, rows in parts:
            used, index = np.unique(which[rows], return_inverse=True)
            out["bucket"].append(b)
            out["tokens"].append(planes(high[rows]))
            out["which"].append(planes(index.astype(np.uint16 if len(used) < 65536 else np.uint32)))
            out["nodes"].append(nodes[used].tobytes())
            out["sizes"].append(planes(sizes[used]))
            out["rares"].append(planes(rares[used]))
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        keys, nodes, sizes, rares, seen, size = [], [], [], [], set(), 0

        def rows(ids, own_nodes, own_sizes, packs):
            n, m = len(ids), len(packs["bucket"]) if packs else 0
            packs = packs or {k: [] for k in ("bucket", "tokens", "which", "nodes", "sizes", "rares")}
            columns = [pa.array([*ids, *[None] * m], pa.int64()), pa.array([*own_nodes, *[None] * m], pa.int64()), pa.array([*own_sizes, *[None] * m], pa.int64())]
            columns += [pa.array([*[None] * n, *packs[k]], kind) for k, kind in (("bucket", pa.int32()), ("tokens", pa.binary()), ("which", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("rares", pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n_shingles", "bucket", "tokens", "which", "nodes", "sizes", "rares"])

        for batch in batches:
            ids, own_nodes, own_sizes = batch.column(0).to_pylist(), [], []
            for _, texts in slices(batch):
                sets = Words(texts).shingle_sets(shingle)
                flat = np.concatenate(sets)
                code = _codes(flat, buckets)
                at = np.minimum(np.searchsorted(often, code), max(0, len(often) - 1))
                is_often = often[at] == code if len(often) else np.zeros(len(flat), bool)
                end = 0
                for tokens in sets:
                    start, end = end, end + len(tokens)
                    node = node_of(tokens)
                    own_nodes.append(node)
                    own_sizes.append(len(tokens))
                    if len(tokens) and node not in seen:
                        seen.add(node)
                        keys.append(keys_of(tokens, is_often[start:end]))
                        nodes.append(node)
                        sizes.append(len(tokens))
                        rares.append(len(tokens) - int(is_often[start:end].sum()))
                        size += len(keys[-1])
            packs = None
            if size > GATHER:
                packs = flush(keys, nodes, sizes, rares)
                keys, nodes, sizes, rares, seen, size = [], [], [], [], set(), 0
            yield rows(ids, own_nodes, own_sizes, packs)
        if size:
            yield rows([], [], [], flush(keys, nodes, sizes, rares))

    return task


def _groups_in_bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Index entries that two nodes or more share, each with the hub among them.

    The hub is the node with the fewest rare tokens: what near copies were copied
    from has hardly a token of its own.
    """
    tokens, nodes, sizes, rares = [], [], [], []
    for row in table.select(["tokens", "which", "nodes", "sizes", "rares"]).to_pylist():
        token, own = from_planes(row["tokens"], np.uint32), np.frombuffer(row["nodes"], np.int64)
        which = from_planes(row["which"], np.uint16 if len(own) < 65536 else np.uint32)
        tokens.append(token)
        nodes.append(own[which])
        sizes.append(from_planes(row["sizes"], np.uint32)[which])
        rares.append(from_planes(row["rares"], np.uint32)[which])
    token, node, size, rare = (np.concatenate(x) for x in (tokens, nodes, sizes, rares))
    order = np.lexsort((node, rare, token))
    token, node, size = token[order], node[order], size[order]
    # Equal nodes have equal counts of rare tokens and stand side by side.
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
    token, node, size = token[new], node[new], size[new]
    at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([at, [len(token)]]))
    keep = np.repeat(length > 1, length)
    hub = np.repeat(at, length)[keep]
    return pa.table(
        {
            "gid": pa.array((token[keep].astype(np.int64) << 20) | key[0].as_py(), pa.int64()),
            "node": pa.array(node[keep], pa.int64()),
            "n": pa.array(size[keep].astype(np.int64), pa.int64()),
            "rep": pa.array(node[hub], pa.int64()),
            "rep_n": pa.array(size[hub].astype(np.int64), pa.int64()),
        }
    )


def _bitmap(tokens: np.ndarray) -> bytes:
    """One bit for each token's hash, four bits a token at least; the length is a power of two."""
    size = max(64, 1 << (4 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = 1
    return len(tokens).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def _may_reach(a: bytes, b: bytes, percent: int) -> bool:
    """False only if the bits prove that the sets have too little in common.

    A bit that is set for one set alone stands for a token of that set alone.
    """
    n, m = int.from_bytes(a[:8], "little"), int.from_bytes(b[:8], "little")
    x, y = np.frombuffer(a, np.uint8, offset=8), np.frombuffer(b, np.uint8, offset=8)
    size = min(len(x), len(y))
    x, y = _folded(x, size), _folded(y, size)
    common = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return 100 * common >= percent * (n + m - common)


def _reach(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _sets_task(shingle: int, pack):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, 0):
                sets = Words(texts).shingle_sets(shingle)
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([pack(s) for s in sets], pa.binary())], ["node", "packed"])

    return task


def _compare_task(percent: int, reach):
    """Rows come sorted: a node's own packed set first, then those it is to be compared with."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, None
        for batch in batches:
            left, right = [], []
            for a, b, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b is None:
                    current, own = a, packed.as_py()
                elif a != current:
                    raise ValueError("a set to compare with is missing")
                elif reach(own, packed.as_py(), percent):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return task


def _bits(packed: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of sets and their bitmaps, folded to ``size`` bytes, as rows of 64-bit words."""
    rows = np.stack([_folded(np.frombuffer(x, np.uint8, offset=8), size) for x in packed])
    return np.array([int.from_bytes(x[:8], "little") for x in packed]), rows.view(np.uint64)


def _family_task(percent: int):
    """Pairs of two blocks of a family, from different components, that their bitmaps do not rule out."""

    def reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("block", "comp", "node", "packed")), strict=True))
        first, second = key[1].as_py(), key[2].as_py()
        left, right = [], []
        by_size: dict[int, list] = {}
        for row in rows:
            by_size.setdefault(len(row[3]), []).append(row)
        for small in sorted(by_size):
            for large in sorted(by_size):
                if small > large:
                    continue
                a = [r for r in by_size[small] if small != large or r[0] == first]
                b = [r for r in by_size[large] if small != large or r[0] == second]
                if not a or not b:
                    continue
                (n, x), (m, y) = _bits([r[3] for r in a], small - 8), _bits([r[3] for r in b], small - 8)
                px, py = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
                ca, cb = np.array([r[1] for r in a]), np.array([r[1] for r in b])
                na, nb = np.array([r[2] for r in a]), np.array([r[2] for r in b])
                for i in range(len(a)):
                    # Each pair once: within a block, or between sizes, it turns up twice.
                    j = np.flatnonzero((cb != ca[i]) & ((na[i] < nb) if small == large and first == second else True))
                    if not len(j):
                        continue
                    both = np.bitwise_count(y[j] & x[i]).sum(1, dtype=np.int64)
                    common = np.minimum(n[i] - (px[i] - both), m[j] - (py[j] - both))
                    j = j[100 * common >= percent * (n[i] + m[j] - common)]
                    left.append(np.minimum(na[i], nb[j]))
                    right.append(np.maximum(na[i], nb[j]))
        join = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(join(left), pa.int64()), "b": pa.array(join(right), pa.int64())})

    return reduce


#: Tokens held by one set in this many, or by more, are counted as a dense product; columns of it at a time; postings at a time.
DENSE, COLUMNS, POSTINGS = 16, 4096, 4_000_000


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set in ``a`` with each in ``b``."""
    size_a, size_b = [len(x) for x in a], [len(x) for x in b]
    row_a, row_b = np.repeat(np.arange(len(a)), size_a), np.repeat(np.arange(len(b)), size_b)
    _, number = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    of_a, of_b = number[: len(row_a)], number[len(row_a) :]
    tokens = int(number.max(initial=-1)) + 1
    in_a, in_b = np.bincount(of_a, minlength=tokens), np.bincount(of_b, minlength=tokens)
    order_a, order_b = np.argsort(of_a, kind="stable"), np.argsort(of_b, kind="stable")
    of_a, row_a, of_b, row_b = of_a[order_a], row_a[order_a], of_b[order_b], row_b[order_b]
    out = np.zeros((len(a), len(b)), np.int64)
    both, dense = (in_a > 0) & (in_b > 0), in_b * DENSE >= len(b)
    column = np.cumsum(both & dense) - 1
    kept_a, kept_b = (both & dense)[of_a], (both & dense)[of_b]
    col_a, dense_a, col_b, dense_b = column[of_a[kept_a]], row_a[kept_a], column[of_b[kept_b]], row_b[kept_b]
    for first in range(0, int((both & dense).sum()), COLUMNS):
        x, y = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
        for matrix, col, row in ((x, col_a, dense_a), (y, col_b, dense_b)):
            lo, hi = np.searchsorted(col, [first, first + COLUMNS])
            matrix[row[lo:hi], col[lo:hi] - first] = 1
        out += (x @ y.T).astype(np.int64)
    kept_a = (both & ~dense)[of_a]
    start, rows = (np.cumsum(in_b) - in_b)[of_a[kept_a]], row_a[kept_a]
    length = in_b[of_a[kept_a]]
    total = np.concatenate([[0], np.cumsum(length)])
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(total, total[at] + POSTINGS, "right")) - 1)
        count = length[at:end]
        where = np.arange(total[end] - total[at]) - np.repeat(total[at:end] - total[at], count) + np.repeat(start[at:end], count)
        out += np.bincount(np.repeat(rows[at:end], count) * len(b) + row_b[where], minlength=out.size).reshape(out.shape)
        at = end
    return out


def _degrees_task(percent: int):
    """Rows that each set of two blocks of a component is linked with, by whole sets."""

    def reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, node = table["block"].to_numpy(), table["node"].to_numpy()
        copies = table["copies"].to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["packed"]]
        n = np.array([len(x) for x in sets])
        same = key[1].as_py() == key[2].as_py()
        a, b = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        if not len(a) or not len(b):
            return pa.table({"node": pa.array([], pa.int64()), "near": pa.array([], pa.int64())})
        common = common_counts([sets[i] for i in a], [sets[i] for i in b])
        linked = 100 * common >= percent * (n[a][:, None] + n[b][None, :] - common)
        if same:
            np.fill_diagonal(linked, False)
        nodes, near = node[a], linked @ copies[b]
        if not same:
            nodes, near = np.concatenate([nodes, node[b]]), np.concatenate([near, copies[a] @ linked])
        return pa.table({"node": pa.array(nodes, pa.int64()), "near": pa.array(near.astype(np.int64), pa.int64())})

    return reduce


#: Nodes that share an index entry: from this many on, pairs are not listed for each entry but found once for all entries with one hub.
FAMILY = 32
#: Nodes of a family that one task compares with as many others.
BLOCK = 2000
#: Tokens of a component's nodes in one block, when links are counted.
BLOCK_TOKENS = 1_000_000


class JaccardJoin:
    """Links between documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more."""

    def __init__(self, spark: SparkSession, shingle: int = 5, percent: int = 75, frequent: int = 20, most_frequent: int = 1_000_000):
        if not 75 <= percent <= 100:
            raise ValueError("the combination prefixes are proved for thresholds from 0.75 to 1")
        self.spark, self.shingle, self.percent = spark, shingle, percent
        self.frequent, self.most_frequent = frequent, most_frequent
        self.buckets = max(16, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def frequent_tokens(self, texts: DataFrame) -> np.ndarray:
        counts = (
            texts.select("text")
            .mapInArrow(_count_task(self.shingle, self.buckets), "bucket int, tokens binary, counts binary")
            .groupBy("bucket")
            .applyInArrow(_frequent_in_bucket(self.frequent), "code long, df long")
        )
        top = counts.orderBy(F.desc("df"), "code").limit(self.most_frequent).select("code").toArrow()
        return np.sort(top["code"].to_numpy())

    def _compared(self, pairs: DataFrame, packed: DataFrame, reach) -> DataFrame:
        """The pairs ``(a, b)`` that pass; a node with many partners is dealt out by parts."""
        degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
        dealt = written(
            pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / 500)).alias("part")), "pairs"
        )
        other = dealt.join(packed.withColumnRenamed("node", "b"), "b").select("a", "b", "packed", "part")
        own = dealt.select("a", "part").distinct().join(packed.withColumnRenamed("node", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "packed", "part")
        rows = own.unionByName(other).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return written(rows.select("a", "b", "packed").mapInArrow(_compare_task(self.percent, reach), "a long, b long"), "passed")

    def _packed(self, texts: DataFrame, by_node: DataFrame, nodes: DataFrame, pack, name: str) -> DataFrame:
        """``node, packed`` for the given nodes, from the whole text of one document of each."""
        members = written(nodes.join(by_node, "node").select("node", "rank"), "members")
        chosen = join_small(texts.withColumn("rank", rank_id()), members.select("rank").distinct(), "rank", members.count())
        return written(
            chosen.select("text").mapInArrow(_sets_task(self.shingle, pack), "node long, packed binary").join(members.select("node"), "node", "left_semi").dropDuplicates(["node"]),
            name,
        )

    def links(self, likely: DataFrame, texts: DataFrame, by_node: DataFrame) -> DataFrame:
        """The pairs that reach the threshold, by whole sets."""
        nodes = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
        return self._compared(likely, self._packed(texts, by_node, nodes, np.ndarray.tobytes, "sets"), _reach)

    def _across(self, label: DataFrame, bitmaps: DataFrame, near) -> DataFrame:
        """Candidates ``(a, b)`` that share an index entry and lie in different components."""
        mixed = label.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("gid", "m")
        open_ = written(label.join(mixed, "gid"), "open")
        x, y = (open_.where(F.col("m") < FAMILY).select("gid", *(F.col(c).alias(f"{c}{i}") for c in ("node", "n", "comp"))) for i in "xy")
        pairs = (
            x.join(y, "gid").where("compx < compy").where(near(F.col("nx"), F.col("ny")))
            .select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct()
        )
        small = self._compared(written(pairs, "cross"), bitmaps, _may_reach)
        members = written(open_.where(F.col("m") >= FAMILY).select("rep", "node", "comp").distinct(), "families")
        blocks = members.groupBy("rep").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = (
            members.join(blocks, "rep").join(bitmaps, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("rep", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "comp", "node", "packed")
        )
        large = dealt.groupBy("rep", "first", "second").applyInArrow(_family_task(self.percent), "a long, b long")
        return written(small.unionByName(large).distinct(), "likely")

    def degrees(self, comps: DataFrame, texts: DataFrame, by_node: DataFrame) -> DataFrame:
        """``node, near``: how many rows with another set each node of a component is linked with."""
        members = written(comps.join(by_node, "node").select("node", "comp", "copies", "n"), "members")
        sets = self._packed(texts, by_node, members.select("node"), np.ndarray.tobytes, "sets")
        blocks = members.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
        dealt = (
            members.join(blocks, "comp").join(sets, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("comp", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node", "copies", "packed")
        )
        counted = dealt.groupBy("comp", "first", "second").applyInArrow(_degrees_task(self.percent), "node long, near long")
        return written(counted.groupBy("node").agg(F.sum("near").alias("near")), "degrees")

    def classes(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
        """``doc_id, n_shingles, component_id`` for each input row, and ``n_links`` with ``count_links``.

        ``n_links`` counts the other rows that the row is linked with, copies included.

        ``component_id`` is the smallest id that links reach, the own one included.
        Null or wordless texts have no shingles and are linked with nothing. Rows
        that share an id and differ in text each take part; rows without an id take
        part too and give their class no id. An empty table gives an empty result.
        """
        spark, t = self.spark, self.percent / 100
        bounded_batches(spark)
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
        often = spark.sparkContext.broadcast(self.frequent_tokens(texts))
        index = written(
            texts.mapInArrow(
                _index_task(self.shingle, t, self.buckets, often),
                "doc_id long, node long, n_shingles long, bucket int, tokens binary, which binary, nodes binary, sizes binary, rares binary",
            ),
            "index",
        )
        rows = index.where("bucket is null").select("doc_id", "node", "n_shingles")
        groups = written(
            index.where("bucket is not null").select("bucket", "tokens", "which", "nodes", "sizes", "rares").groupBy("bucket")
            .applyInArrow(_groups_in_bucket, "gid long, node long, n long, rep long, rep_n long"),
            "groups",
        )
        by_node = rows.where("n_shingles > 0").groupBy("node").agg(
            F.min("doc_id").alias("least"), F.min(rank_id()).alias("rank"), F.count("*").alias("copies"), F.max("n_shingles").alias("n")
        )
        comps = None
        near = lambda n, m: F.least(n, m) * 100 >= F.greatest(n, m) * self.percent
        star = groups.where(F.col("node") != F.col("rep")).where(near(F.col("n"), F.col("rep_n"))).groupBy("node", "rep").agg(F.count("*").alias("shared"))
        star = written(
            star.groupBy("node").agg(F.max(F.struct("shared", "rep")).alias("best")).select(F.col("best.rep").alias("a"), F.col("node").alias("b")), "star"
        )
        if not groups.isEmpty():
            bitmaps = self._packed(texts, by_node, groups.select("node").distinct(), _bitmap, "bitmaps")
            links = self.links(self._compared(star, bitmaps, _may_reach), texts, by_node)
            comps = components(links)
            label = groups.select("gid", "node", "n", "rep")
            if comps is not None:
                label = label.join(comps, "node", "left")
            else:
                label = label.withColumn("comp", F.lit(None).cast("long"))
            label = written(label.withColumn("comp", F.coalesce("comp", "node")), "labelled")
            more = self.links(self._across(label, bitmaps, near), texts, by_node)
            comps = components(links.unionByName(more))
        if comps is None:
            least = by_node.select("node", F.col("least").alias("component_id"), (F.col("copies") - 1).alias("n_links"))
        else:
            named = by_node.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            least = named.join(named.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "component_id", "copies")
            if count_links:
                least = least.join(self.degrees(comps, texts, by_node), "node", "left")
                least = least.select("node", "component_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
        columns = ["doc_id", "n_shingles", "component_id", *(["n_links"] if count_links else [])]
        least = written(least.select("node", *columns[2:]), "least")
        found = rows.where("n_shingles > 0").join(least, "node").select(columns)
        alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("long"))
        return found.unionByName(alone.select(columns))


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(spark).classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), count_links=True)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (nx + ny - c)),
d AS (SELECT x AS doc_id, count(*) AS links FROM l GROUP BY 1),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.other = l.x)
SELECT doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(other) AS component_id, CAST(coalesce(any_value(links), 0) AS BIGINT) AS n_links
FROM r JOIN s USING (doc_id) LEFT JOIN d USING (doc_id) GROUP BY doc_id
"""
