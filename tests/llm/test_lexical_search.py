import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillwork.llm import lexical_search as search
from quillwork.llm.lexical_search import rank_documents

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    bags = [Counter(split(t)) for _, t in docs]
    held = [sum(b.values()) for b in bags]
    n_docs, n_terms, df = sum(n > 0 for n in held), sum(held), Counter(t for b in bags for t in b)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        found = []
        for (doc, _), bag, n in zip(docs, bags, held, strict=True):
            score = 0
            for t in set(split(text)):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))
            if score > 0:
                found.append((-score, math.inf if doc is None else doc))
        out += [(item, r, None if doc == math.inf else doc, -s) for r, (s, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def tables(seed, n=150):
    r = random.Random(seed)
    vocab = [f"t{i}" for i in range(80)] + ["É", "naïve", "ß", "9"]
    words = lambda k: [vocab[int(len(vocab) * r.random() ** 2)] for _ in range(k)]
    items = [(i, " ".join(words(r.choice([1, 3, 8, 30])))) for i in range(10)] + [(1, "t1 T1 again"), (1, "t1 T1 again"), (20, None), (21, "--"), (None, "t5 t6"), (22, "nowhere known")]
    docs = [(i, r.choice([" ", "-", "\n"]).join(words(r.choice([1, 5, 20, 60, 400])))) for i in range(n)]
    for i in range(n, n + 20):
        docs.append((i, docs[3][1] if r.random() < 0.5 else " ".join(words(5)) + " " + r.choice(items[:10])[1]))
    return docs + [(None, docs[3][1]), (3, docs[3][1]), (3, "T1 t2"), (n + 50, None), (n + 51, ""), (n + 52, "!!")], items


def run(spark, docs, items, **more):
    return sorted(map(tuple, rank_documents(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS), **more).collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    for seed, together, chars in ((1, 16384, 1 << 25), (2, 7, 1 << 25), (3, 20, 200)):
        monkeypatch.setattr(search, "ITEM_CHARS", chars)
        monkeypatch.setattr(search, "TOGETHER", together)
        docs, items = tables(seed)
        assert run(spark, docs, items) == brute(docs, items), seed


def test_ties_by_id_over_many_copies(spark, monkeypatch):
    monkeypatch.setattr(search, "TOGETHER", 10)
    docs = [(i, "rare words here") for i in range(100, 0, -1)] + [(200 + i, f"other {i}") for i in range(100)]
    assert run(spark, docs, [(1, "rare")], top=3) == brute(docs, [(1, "rare")], 3)
    assert [r[2] for r in brute(docs, [(1, "rare")], 3)] == [1, 2, 3]


def test_bounds_leave_every_document_that_can_reach_the_least_score():
    r = np.random.default_rng(5)
    terms, impacts, bounds = [], [], [0]
    for _ in range(400):
        t = np.sort(r.choice(60, r.integers(1, 25), replace=False))
        terms.append(t)
        impacts.append(r.integers(0, 1_000_000, len(t)))
        bounds.append(bounds[-1] + len(t))
    norm = np.array([np.sqrt((i.astype(float) ** 2).sum()) for i in impacts])
    block = search.Block(np.arange(400), norm, np.concatenate(terms), np.concatenate(impacts), np.array(bounds))
    pruned = 0
    for _ in range(50):
        used = r.choice(60, r.integers(1, 12), replace=False)
        query = search.Query(0, used.tolist(), r.integers(1, 9000, len(used)).tolist())
        score = block.scores(query, np.arange(400), np.zeros(60, np.int64))
        assert score.tolist() == [sum(int(w) * int(i) for t, i in zip(ts, im, strict=True) for u, w in zip(query.terms, query.weights, strict=True) if t == u) for ts, im in zip(terms, impacts, strict=True)]
        for at in (1, 10, 100):
            query.least = int(np.sort(score)[-at])
            left = block.survivors(query)
            assert set(np.flatnonzero(score >= max(1, query.least))) <= set(left.tolist())
            pruned += 400 - len(left)
    assert pruned > 50 * 3 * 100


@pytest.mark.parametrize("empty", ["docs", "items", "terms"])
def test_empty_tables(spark, empty):
    docs = spark.createDataFrame([(1, "!" if empty == "terms" else "a b", 2, "x")], "doc_id long, text string, score int, terms string")
    items = spark.createDataFrame([(1, "a", "y", 4)], "item_id long, text string, query string, rank int")
    found = rank_documents(docs.limit(0) if empty == "docs" else docs, items.limit(0) if empty == "items" else items)
    assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 2, "x"), (2, "c", 2, "x"), (4, "d", 2, "x")], "doc_id long, text string, score int, terms string")
    items = spark.createDataFrame([(1, "a", "y", 4)], "item_id long, text string, query string, rank int")
    assert [tuple(r) for r in rank_documents(docs, items).collect()] == brute([(1, "a b"), (2, "c"), (4, "d")], [(1, "a")])


def test_sql_says_the_same():
    docs, items = tables(7)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", items)
    assert sorted(con.execute(search.OP11_SQL).fetchall(), key=str) == brute(docs, items)
