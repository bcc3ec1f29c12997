import hashlib
import random

from quillwork.llm.substring_dedup import dedup_substrings


def brute(rows, length):
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, length):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randrange(1, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = [(0, None), (1, ""), (2, "x" * (length - 1)), (3, "y" * (3 * length)), (4, "ab" * (2 * length)), (5, "y" * (length + 1))]
    for i in range(6, 70):
        text = " ".join(word() for _ in range(r.randrange(1, 120)))
        if r.random() < 0.4:
            a = r.randrange(len(passage))
            text = text[: len(text) // 2] + passage[a : a + r.randrange(10, 300)] + text[len(text) // 2 :]
        if r.random() < 0.3:
            text = rows[r.randrange(6, len(rows))][1] or "" if len(rows) > 7 else text
        if r.random() < 0.3:
            k = r.randrange(len(text) + 1)
            text = text[:k] + "#" + text[k + 1 :]
        rows.append((i, text))
    return rows


def test_against_brute_force(spark):
    for seed, length, anchor in ((1, 100, 50), (2, 20, 7), (3, 40, 39)):
        rows = corpus(seed, length)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = dedup_substrings(docs, length=length, anchor=anchor).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted(map(tuple, got.collect())) == brute(rows, length), seed


def test_repeated_rows_missing_ids_and_clashing_columns(spark):
    a, b = "q" + "ab c" * 40, "zz" + "ab c" * 40
    docs = spark.createDataFrame([(5, a, 1), (5, a, 1), (None, b, 1), (7, None, 2)], "doc_id long, text string, key int")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in dedup_substrings(docs).collect()}
    own = brute([(5, a), (9, b)], 100)
    assert got == {(5, len(a)): own[0][2], (None, len(b)): own[1][2], (7, 0): 0}
    assert dedup_substrings(docs.limit(0)).collect() == []
