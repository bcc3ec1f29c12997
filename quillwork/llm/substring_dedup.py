"""Suffix-array dedup: repeated substrings from merged Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts earlier.
Each such string (a window) is filed under its anchor, the smallest hash of its
``anchor``-byte strings, so that equal windows share anchor and offset, and all
work on an anchor meets in one place, whatever its documents. Neighbouring windows
with one anchor form a context.

1. Anchors are counted over all documents. A context whose bytes all occur in an
   earlier one is a repeat as it stands; anchors with one occurrence are done.
2. Anchors with several different contexts remain. Every task sorts the suffixes
   of its own contexts (the anchor is one letter) and passes on just their
   Burrows-Wheeler transform. Where the transforms of all shards meet, they are
   merged by interleave refinement: in each round every row moves to that of the
   suffix one letter longer, by the transform's own last-to-first mapping, and a
   stable sort by that single letter refines the interleave. Blocks that a round
   splits have common prefixes of just that many letters; blocks that are whole
   after the last round are the repeated intervals. No suffix is sorted again.
3. In each repeated interval the earliest window stays, the others are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .shared import LAST, bounded_batches, rank_id, text_or_empty, written
from .words import BASE_INVERSE, SLICE, from_planes, mix, planes, powers, prefix_sums

LENGTH, ANCHOR = 100, 50
#: Anchors, or letters of contexts, that a task gathers before it passes them on.
GATHER = 1_500_000
#: Bits of a position in a slice; longer texts are handled in overlapping parts.
BITS = 24
PART = 1 << 23


def _parts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Keys, offsets and bytes of whole texts, about a slice at a time; very long ones in parts that overlap."""
    keys, offsets, held, size = [], [], [], 0
    for key, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
        raw = value.as_py() or b""
        for at in range(0, max(1, len(raw) - length + 1), PART):
            part = raw[at : at + PART + length - 1]
            if held and size + len(part) > SLICE:
                yield np.array(keys, np.int64), np.array(offsets, np.int64), held
                keys, offsets, held, size = [], [], [], 0
            keys.append(key)
            offsets.append(at)
            held.append(part)
            size += len(part)
    if held:
        yield np.array(keys, np.int64), np.array(offsets, np.int64), held


def contexts(parts: list[bytes], length: int, anchor: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: part, first window, number of windows, left bytes, anchor hash, context hash."""
    lengths = np.array([len(p) for p in parts])
    at = np.concatenate([[0], np.cumsum(lengths)])
    buf = np.frombuffer(b"".join(parts), np.uint8)
    n, width = len(buf), length - anchor + 1
    if n < length:
        return {k: np.zeros(0, np.int64) for k in ("part", "start", "windows", "left", "anchor", "context")}
    sums, inverse = prefix_sums(buf), powers(BASE_INVERSE, n + 1)
    h = mix((sums[anchor:] - sums[:-anchor]) * inverse[: n + 1 - anchor])
    low = np.uint64((1 << BITS) - 1)
    least, reach = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * reach <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    part = np.repeat(np.arange(len(parts)), lengths)
    window = np.flatnonzero(part[: n - length + 1] == part[length - 1 :])
    chosen = (least[window] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1)])[: len(window)])
    start, windows = window[new], np.diff(np.concatenate([new, [len(window)]]))
    end = start + windows + length - 1
    return {
        "part": part[start],
        "start": start - at[part[start]],
        "windows": windows,
        "left": chosen[new] - start,
        "anchor": h[chosen[new]],
        "context": mix((sums[end] - sums[start]) * inverse[start]),
    }


def _anchor_task(length: int, anchor: int, buckets: int):
    def flush(held, keys):
        a = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        doc, keys = a["doc"], np.concatenate(keys)
        bucket = (a["anchor"] % np.uint64(buckets)).astype(np.int32)
        high = (a["anchor"] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((high, bucket))
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out: dict[str, list] = {k: [] for k in ("bucket", "anchor", "context", "doc", "start", "windows", "left", "keys")}
        for b in range(buckets):
            rows = order[bounds[b] : bounds[b + 1]]
            if not len(rows):
                continue
            used, own = np.unique(doc[rows], return_inverse=True)
            out["bucket"].append(b)
            out["anchor"].append(planes(high[rows]))
            out["context"].append(planes(a["context"][rows] >> np.uint64(16)))
            out["doc"].append(planes(own.astype(np.uint32)))
            out["start"].append(planes(a["start"][rows].astype(np.uint32)))
            out["windows"].append(a["windows"][rows].astype(np.uint8).tobytes())
            out["left"].append(a["left"][rows].astype(np.uint8).tobytes())
            out["keys"].append(keys[used].tobytes())
        kinds = [pa.int32(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, docs, size = [], [], 0, 0
        for batch in batches:
            for own, offsets, parts in _parts(batch, length):
                found = contexts(parts, length, anchor)
                part = found.pop("part")
                found["start"] = found["start"] + offsets[part] if len(part) else found["start"]
                found["doc"] = part + docs
                held.append(found)
                keys.append(own)
                docs += len(parts)
                size += len(part)
                if size > GATHER:
                    yield flush(held, keys)
                    held, keys, docs, size = [], [], 0, 0
        if size:
            yield flush([h for h in held if len(h["doc"])], keys)

    return task


ANCHORS = "bucket int, anchor binary, context binary, doc binary, start binary, windows binary, left binary, keys binary"
REPEATS = "kind int, key long, a array<int>, b array<int>, c array<int>, anchor array<long>"


def _lists(key: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """Columns as one list for each key; rows must be sorted by key."""
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate([at, [len(key)]]).astype(np.int32))
    return [pa.array(key[at], pa.int64()), *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns)]


def _repeats_in_bucket(length: int):
    def reduce(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        gathered: dict[str, list] = {k: [] for k in ("anchor", "context", "key", "start", "windows", "left")}
        for row in table.to_pylist():
            gathered["anchor"].append(from_planes(row["anchor"], np.uint32))
            gathered["context"].append(from_planes(row["context"], np.uint64))
            gathered["key"].append(np.frombuffer(row["keys"], np.int64)[from_planes(row["doc"], np.uint32)])
            gathered["start"].append(from_planes(row["start"], np.uint32).astype(np.int32))
            gathered["windows"].append(np.frombuffer(row["windows"], np.uint8).astype(np.int32))
            gathered["left"].append(np.frombuffer(row["left"], np.uint8).astype(np.int32))
        a = {k: np.concatenate(v) for k, v in gathered.items()}
        # Most anchors occur once; they need no sorting by all columns.
        order = np.argsort(a["anchor"], kind="stable")
        own = a["anchor"][order]
        edge = np.concatenate([[True], own[1:] != own[:-1], [True]])
        order = order[~(edge[:-1] & edge[1:])]
        order = order[np.lexsort((a["start"][order], a["key"][order], a["context"][order], a["anchor"][order]))]
        a = {k: v[order] for k, v in a.items()}
        n = len(order)
        new_anchor = np.ones(n, bool)
        new_anchor[1:] = a["anchor"][1:] != a["anchor"][:-1]
        new_context = new_anchor.copy()
        new_context[1:] |= a["context"][1:] != a["context"][:-1]
        number = np.cumsum(new_anchor) - 1
        several = np.bincount(number, new_context, minlength=1)[number] > 1 if n else np.zeros(0, bool)
        out = []
        for kind, chosen in ((0, ~new_context), (1, new_context & several)):
            rows = np.flatnonzero(chosen)
            rows = rows[np.argsort(a["key"][rows], kind="stable")]
            start, windows = a["start"][rows], a["windows"][rows]
            code = (a["anchor"][rows].astype(np.int64) << 20) | group[0].as_py()
            lists = _lists(a["key"][rows], start, start + windows + length - 1 if kind == 0 else windows, a["left"][rows], code)
            if kind == 0:  # spans need no more than start and end
                lists[3:] = [pa.nulls(len(lists[0]), pa.list_(pa.int32())), pa.nulls(len(lists[0]), pa.list_(pa.int64()))]
            out.append(pa.table([pa.array(np.full(len(lists[0]), kind, np.int32)), *lists], ["kind", "key", "a", "b", "c", "anchor"]))
        return pa.concat_tables(out)

    return reduce


def sorted_suffixes(letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and Burrows-Wheeler transform of several strings, by prefix doubling.

    ``letters`` has the strings one after the other, each with a 0 at its end that
    differs from all others: earlier strings' ends are smaller. In the transform 0
    stands before the whole of a string.
    """
    ends = np.cumsum(lengths) - 1
    rank = letters.astype(np.int64) + len(lengths) - 1
    rank[ends] = np.arange(len(lengths))
    last = np.repeat(ends, lengths)
    where, n, reach = np.arange(len(letters)), len(letters), 1
    while True:
        key = rank * (n + rank.max() + 1) + rank[np.minimum(where + reach, last)]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        step = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1 or reach > int(lengths.max()):
            break
        reach *= 2
    before = np.concatenate([[0], letters[:-1]])
    before[ends[:-1] + 1] = 0
    return order, before[order]


def _shard_task(length: int, anchor: int, buckets: int):
    """Contexts asked for, as the Burrows-Wheeler transform of this task's share of each bucket."""

    def flush(held):
        out: dict[str, list] = {k: [] for k in ("bucket", "transform", "anchors", "keys", "start", "windows")}
        for b, strings in held.items():
            anchors = np.unique(np.array([s[0] for s in strings], np.int64))
            number = {a: i for i, a in enumerate(anchors.tolist())}
            lines = []
            for code, raw, left, *_ in strings:
                line = np.zeros(len(raw) - anchor + 2, np.uint32)
                letters = np.frombuffer(raw, np.uint8)
                line[:left] = letters[:left]
                line[left + 1 : -1] = letters[left + anchor :]
                line[:-1] += 1
                line[left] = 257 + number[code]
                lines.append(line)
            _, transform = sorted_suffixes(np.concatenate(lines), np.array([len(x) for x in lines]))
            out["bucket"].append(b)
            out["transform"].append(planes(transform.astype(np.uint32)))
            out["anchors"].append(anchors.tobytes())
            out["keys"].append(np.array([s[3] for s in strings], np.int64).tobytes())
            out["start"].append(planes(np.array([s[4] for s in strings], np.uint32)))
            out["windows"].append(np.array([s[5] for s in strings], np.uint8).tobytes())
        kinds = [pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].cast(pa.binary()).as_py()
                key = batch.column(0)[i].as_py()
                for start, windows, left, code in zip(*(batch.column(c)[i].as_py() for c in range(2, 6)), strict=True):
                    held.setdefault(code & 0xFFFFF, []).append((code, raw[start : start + windows + length - 1], left, key, start, windows))
                    size += windows + length - anchor
                if size > GATHER:
                    yield flush(held)
                    held, size = {}, 0
        if size:
            yield flush(held)

    return task


SHARDS = "bucket int, transform binary, anchors binary, keys binary, start binary, windows binary"
SPANS = "key long, a array<int>, b array<int>"


def merge_transforms(transforms: list[np.ndarray], windows: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave refinement over shards. Returns (block, string, offset) of all windows in merged order.

    ``transforms`` are the shards' transforms over one alphabet, ``windows`` the
    number of windows of each of their strings; strings are numbered through all
    shards. A window is the suffix at an offset below that number, to ``rounds``
    letters. Two windows have the same block if and only if those letters are equal.
    """
    jump, letters, rows, strings, offsets = [], [], [], [], []
    base = first = 0
    for transform, own in zip(transforms, windows, strict=True):
        order = np.argsort(transform, kind="stable")
        ahead = np.zeros(len(transform), np.int64)
        ahead[order[len(own) :]] = np.arange(len(own), len(transform))
        # The suffixes that lie `rounds` letters behind the windows: from each string's end leftwards.
        at, alive = np.arange(len(own)), np.arange(len(own))
        for back in range(int(own.max(initial=0))):
            keep = own[alive] > back
            at, alive = at[keep], alive[keep]
            rows.append(at + base)
            strings.append(alive + first)
            offsets.append(own[alive] - 1 - back)
            at = ahead[at]
        jump.append(ahead + base)
        letters.append(transform)
        base += len(transform)
        first += len(own)
    ahead, letter = np.concatenate(jump), np.concatenate(letters)
    letter = letter.astype(np.uint16 if letter.max(initial=0) < 1 << 16 else np.uint32)
    row, string, offset = np.concatenate(rows), np.concatenate(strings), np.concatenate(offsets)
    order = np.argsort(row, kind="stable")
    row, string, offset = row[order], string[order], offset[order]
    block = np.zeros(len(row), np.int64)
    for _ in range(rounds):
        here = letter[row]
        order = np.argsort(here, kind="stable")
        here, block = here[order], block[order]
        row, string, offset = ahead[row[order]], string[order], offset[order]
        split = (here[1:] != here[:-1]) | (block[1:] != block[:-1])
        block = np.concatenate([[0], np.cumsum(split)]) if len(row) else block
    return block, string, offset


def _merge_in_bucket(length: int, anchor: int):
    def reduce(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shards = table.to_pylist()
        codes = [np.frombuffer(s["anchors"], np.int64) for s in shards]
        alphabet = np.unique(np.concatenate(codes))
        transforms, windows = [], []
        for s, own in zip(shards, codes, strict=True):
            letters = from_planes(s["transform"], np.uint32).astype(np.int64)
            special = letters > 256
            letters[special] = 257 + np.searchsorted(alphabet, own)[letters[special] - 257]
            transforms.append(letters)
            windows.append(np.frombuffer(s["windows"], np.uint8).astype(np.int64))
        block, string, offset = merge_transforms(transforms, windows, length - anchor + 1)
        key = np.concatenate([np.frombuffer(s["keys"], np.int64) for s in shards])[string]
        start = np.concatenate([from_planes(s["start"], np.uint32) for s in shards]).astype(np.int64)[string] + offset
        several = np.bincount(block, minlength=1)[block] > 1
        key, start, block = key[several], start[several], block[several]
        order = np.lexsort((start, key, block))
        key, start, block = key[order], start[order], block[order]
        later = np.zeros(len(block), bool)
        later[1:] = block[1:] == block[:-1]
        key, start = key[later], start[later]
        order = np.lexsort((start, key))
        key, start = key[order], start[order]
        # Neighbouring windows of a document become one span.
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [len(key)]])[: len(at)] - 1
        return pa.table(_lists(key[at], start[at].astype(np.int32), (start[last] + length).astype(np.int32)), ["key", "a", "b"])

    return reduce


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        for key, value, starts, ends in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            raw, spans = value.as_py(), []
            for s, e in sorted(zip((x for y in starts or () for x in y), (x for y in ends or () for x in y), strict=True)):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            at, kept = 0, []
            for s, e in spans:
                kept.append(raw[at:s])
                at = e
            rest = b"".join([*kept, raw[at:]])
            for name, x in zip(out, (key, len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [x for s in spans for x in s], rest), strict=True):
                out[name].append(x)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int32()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept`` for each input row.

    ``spans``: start, end, start, end ... of the maximal removed runs, in bytes;
    ``kept``: the bytes that are left, which may cut a character. Null text counts
    as empty, texts shorter than ``length`` lose nothing. Rows without an id come
    last. Rows that share an id are ordered by a hash of their texts; equal ones
    count as one row and lose the same. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if not 0 < anchor < length <= 250 + anchor:
        raise ValueError("the anchor must be shorter than the length, by 250 at most")
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(rank_id(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    ids, judged = None, texts
    if not texts.groupBy("key").agg(F.count("*").alias("n")).where(f"n > 1 or key = {LAST}").isEmpty():
        texts = texts.withColumnRenamed("key", "rank").withColumn("hash", F.xxhash64("text"))
        ids = written(
            texts.select("rank", "hash").distinct().repartitionByRange("rank", "hash").sortWithinPartitions("rank", "hash").withColumn("key", F.monotonically_increasing_id()), "keys"
        )
        texts = texts.join(ids, ["rank", "hash"]).select("key", "text")
        judged = texts.dropDuplicates(["key"])
        ids = ids.select("key", F.nullif("rank", F.lit(LAST)).alias("doc_id"))
    repeats = written(
        judged.mapInArrow(_anchor_task(length, anchor, buckets), ANCHORS).groupBy("bucket").applyInArrow(_repeats_in_bucket(length), REPEATS), "repeats"
    )
    joined = lambda c: F.flatten(F.collect_list(c)).alias(c)
    asked = repeats.where("kind = 1").groupBy("key").agg(*(joined(c) for c in ("a", "b", "c", "anchor")))
    merged = (
        judged.join(asked, "key").select("key", "text", "a", "b", "c", "anchor").mapInArrow(_shard_task(length, anchor, buckets), SHARDS)
        .groupBy("bucket").applyInArrow(_merge_in_bucket(length, anchor), SPANS)
    )
    spans = repeats.where("kind = 0").select("key", "a", "b").unionByName(merged).groupBy("key").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    found = texts.join(spans, "key", "left").select("key", "text", "a", "b").mapInArrow(
        _cut_task, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>, kept binary"
    )
    if ids is not None:
        return found.join(ids, "key").drop("key").select("doc_id", *[c for c in found.columns if c != "key"])
    return found.withColumnRenamed("key", "doc_id")


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
