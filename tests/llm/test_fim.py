import hashlib
import random
import re

import duckdb
import numpy as np
import pyspark.sql.functions as F

from quillwork.llm import fim

ODD = [None, "", "a", "é", "ab", "1", "€", "😀", "abcdefgh", "abcdefghi", "abcdefg ", "aé€😀z", "[`{@\x00\x7f", "a\x00b", "x<P>y", "<S>", "<", "<S", "a<M", ">", "P>", "ab<" * 9, "Zz" * 4 + "é" * 8, "\n" * 17, "é" + "a" * 16 + "é"]


def texts(seed, n=300):
    r = random.Random(seed)
    parts = ["a", "Z", "bcd", "é", "€", "😀", " ", "\n", "1", "<", "[", "{", "`", "@", "\x00", "\x7f", "word" * 5]
    return [*ODD, *("".join(r.choice(parts) for _ in range(r.choice([1, 2, 5, 9, 40, 400]))) for _ in range(n)), "long é text " * 200_000]


def brute(doc_id, text):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, len(u), "plain", None, None, text
    return (doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_every_unit_end_is_found():
    for seed in (1, 2):
        raw = [(t or "").encode() for t in texts(seed, 60)[:-1]]
        units = fim.Units(raw)
        for d, text in enumerate(raw):
            ends = np.cumsum([0] + [len(u.encode()) for u in re.findall("[A-Za-z]+|[^A-Za-z]", text.decode())])
            assert units.n[d] == len(ends) - 1
            for k, end in enumerate(ends):
                ask = np.zeros(len(raw), np.int64)
                ask[d] = k
                assert units.end(ask)[d] == end


def test_against_brute_force_and_back(spark):
    rows = [(i, t) for i, t in enumerate(texts(3))] + [(None, "no id"), (None, "none either"), (5, "shared id"), (5, "shared id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in made), key=str) == sorted((brute(*r) for r in rows), key=str)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["back"]) for r in made) == sorted((i is None, i or 0, t or "") for i, t in rows)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_seed_and_rate(spark):
    docs = spark.createDataFrame([(i, f"some text {i} of words") for i in range(200)], "doc_id long, text string")
    forms = lambda **more: [r["form"] for r in fim.fill_in_middle(docs, **more).collect()]
    assert set(forms(rate=0)) == {"plain"} and set(forms(rate=100, spm=100)) == {"spm"} and forms(seed=2) != forms()


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, n int, output string")
    assert [tuple(r) for r in fim.fill_in_middle(docs).collect()] == [brute(1, "a b")]
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_sql_says_the_same():
    rows = [(i, t) for i, t in enumerate(texts(4)) if "\x00" not in (t or "")] + [(None, "no id")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*brute(*r)[:5], sha(brute(*r)[5]), sha(r[1] or "")) for r in rows]
    assert sorted(con.execute(fim.OP13_SQL).fetchall(), key=str) == sorted(want, key=str)
