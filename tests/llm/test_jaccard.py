import random
import re

import duckdb
import numpy as np

from quillwork.llm import jaccard
from quillwork.llm.jaccard import JaccardJoin


def brute(rows, k=5, percent=75):
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passage = [r.choice(vocab) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "one two three")]
    for i in range(6, 120):
        kind = r.random()
        if kind < 0.55 and len(rows) > 8:  # a near copy of an earlier text
            w = (rows[r.randrange(6, len(rows))][1] or "a b c d e f g").split()
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                w = w[: max(1, len(w) - r.randrange(6))]
        else:
            w = [r.choice(vocab) for _ in range(r.choice([3, 6, 9, 12, 40, 90]))]
        if r.random() < 0.3:
            at = r.randrange(len(w) + 1)
            w = w[:at] + passage + w[at:]
        rows.append((i, " ".join(w)))
    return rows


def test_against_brute_force_with_rare_and_frequent_classes(spark):
    for seed, frequent in ((1, 100), (2, 1), (3, 3), (4, 0)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted(map(tuple, JaccardJoin(spark, frequent=frequent).classes(docs).collect()))
        assert got == brute(rows), (seed, frequent)


def test_families_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAMILY", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    for seed, frequent in ((5, 2), (6, 100)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sorted(map(tuple, JaccardJoin(spark, frequent=frequent).classes(docs).collect())) == brute(rows), seed


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, node long, n_shingles string, comp int")
    assert JaccardJoin(spark).classes(docs).collect() == []
    docs = spark.createDataFrame([(7, "a b c d e f", 1, "x", 2), (None, "a b c d e f", 1, "x", 2)], "doc_id long, text string, node long, n_shingles string, comp int")
    assert sorted(JaccardJoin(spark).classes(docs).collect(), key=str) == [(7, 2, 7), (None, 2, 7)]


def test_sql_says_the_same(spark):
    rows = corpus(9)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    found = sorted((r[con_i], r[con_n], r[con_c]) for con_i, con_n, con_c in [(0, 1, 2)] for r in con.execute(jaccard.OP10_SQL).fetchall())
    assert found == brute(rows)


def brute_links(rows, k=5, percent=75):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    linked = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= percent * len(x | y)
    return {d: sum(linked(sets[i], sets[j]) for j in range(len(rows)) if j != i) for i, (d, _) in enumerate(rows)}


def test_links_are_counted_as_by_brute_force(spark, monkeypatch):
    for seed, block in ((7, 2000), (8, 3)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = JaccardJoin(spark).classes(docs, count_links=True).collect()
        assert {r["doc_id"]: r["n_links"] for r in got} == brute_links(rows), seed
        assert sorted(tuple(r)[:3] for r in got) == brute(rows), seed
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert dict(con.execute(f"select doc_id, n_links from ({jaccard.OP10_SQL})").fetchall()) == brute_links(rows)
    alone = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "A b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, JaccardJoin(spark).classes(alone, count_links=True).collect())) == [(1, 2, 1, 1), (2, 0, 2, 0), (3, 2, 1, 1)]
    assert JaccardJoin(spark).classes(docs.limit(0), count_links=True).collect() == []


def test_common_counts(monkeypatch):
    r = np.random.default_rng(3)
    for dense, columns, postings in ((16, 4096, 4_000_000), (2, 3, 5), (1, 1, 1)):
        monkeypatch.setattr(jaccard, "DENSE", dense)
        monkeypatch.setattr(jaccard, "COLUMNS", columns)
        monkeypatch.setattr(jaccard, "POSTINGS", postings)
        a, b = ([np.unique(r.integers(0, high, r.integers(0, 30)).astype(np.uint64)) for high in (20, 60, 1000) for _ in range(9)] for _ in range(2))
        assert jaccard.common_counts(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
