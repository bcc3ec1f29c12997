import hashlib
import random
import re

import duckdb

from quillwork.llm import decontaminate
from quillwork.llm.decontaminate import find_windows

SCHEMA = "doc_id long, text string"


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = split(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, ids, spans = split(text), set(), set(), []
        for s in range(len(w)):
            for n in sorted(lengths):
                found = windows.get(tuple(w[s : s + n])) if s + n <= len(w) else None
                if found:
                    hit.update(range(s, s + n))
                    ids |= found
                    spans.append((s, n))
        out.append((doc, len(w), len(hit), spans, sorted(ids)))
    return sorted(out, key=str)


def tables(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["É", "straße", "Σας", "7"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 4, 9, 10, 11, 30]))) for i in range(12)] + [(3, text(14)), (None, text(12)), (50, None), (51, " .,! "), (52, "")]
    docs = [(0, None), (1, ""), (2, " \t!"), (3, "w1"), (None, text(20)), (None, text(30))]
    for i in range(4, 60):
        w = text(r.choice([3, 12, 40, 120])).split(" ")
        for _ in range(r.choice([0, 1, 3])):
            passage = split(r.choice(items)[1])
            cut = passage[r.choice([0, 0, 1]) : len(passage) - r.choice([0, 0, 1])]
            at = r.randrange(len(w) + 1)
            w[at:at] = [p.upper() if p.isascii() else p for p in cut]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    return docs + docs[10:13] + [(7, "another text under a known id w1 w2")], items


def run(spark, docs, items, **more):
    found = find_windows(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string"), **more)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"]) for r in found.collect()), key=str)


def test_against_brute_force(spark):
    for seed, more in ((1, {}), (2, {"block": 7})):
        docs, items = tables(seed)
        assert run(spark, docs, items, **more) == brute(docs, items), seed
        docs, items = docs, [x for x in items if x[0] in (5, 6)]
        assert run(spark, docs, items) == brute(docs, items)


def test_windows_of_one_item_reach_over_its_repeats(spark):
    item = "a b c d e f g h i j k l a b c d e f g h i j"
    docs = [(1, f"x {item} y"), (2, "a b c d e f g h i"), (3, "a b c d e f g h i j " * 300), (4, "A-B-C-D-E-F-G-H-I-J"), (5, "a b c d e x f g h i j")]
    assert run(spark, docs, [(1, item), (2, item)]) == brute(docs, [(1, item), (2, item)])


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "x", 1), (None, None, 3, "x", 1)], "doc_id long, text string, pos int, words string, sid int")
    items = spark.createDataFrame([(1, "b", "y", 2)], "item_id long, text string, words string, k int")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in find_windows(docs, items).collect()), key=str)
    assert got == [(1, 2, 1, ["1"]), (None, 0, 0, [])]
    assert find_windows(docs.limit(0), items).collect() == []
    assert sorted(r["n_hit"] for r in find_windows(docs, items.limit(0)).collect()) == [0, 0]


def test_sql_says_the_same(spark):
    docs, items = tables(5)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", items)
    got = sorted(con.execute(decontaminate.OP12_SQL).fetchall(), key=str)
    sha = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert got == sorted(((d, n, h, len(ids), sha(ids), h > 0) for d, n, h, _, ids in brute(docs, items)), key=str)


def test_the_scan_is_native(spark):
    shingles = spark.createDataFrame([(1, "a b c d e", 5)], "sid long, shingle string, shingle_hash long")
    plan = decontaminate._places(spark.createDataFrame([(1, "a")], SCHEMA), shingles, [5], True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
