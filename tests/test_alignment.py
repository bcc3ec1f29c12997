import random
from difflib import SequenceMatcher

from quillwork.operators import alignment
from quillwork.operators.alignment import align_best, best_concepts, near_texts


def test_blocked_pairs_are_all_pairs(spark):
    r = random.Random(2)
    base = ["".join(r.choice("abc d") for _ in range(r.randrange(1, 40))).strip() for _ in range(60)]
    rows = []
    for i in range(150):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            if t:
                t[r.randrange(len(t))] = r.choice("abcx")
        rows.append((i, i, "".join(t)))
    docs = spark.createDataFrame(rows, "id long, ord long, text string").repartition(3)
    first = {}
    for i, _, t in rows:
        first.setdefault(t, i)
    want = {(first[t], i, 1.0) for i, _, t in rows if t and first[t] != i}
    heads = sorted((i, t) for t, i in first.items() if t)
    for x, (i, a) in enumerate(heads):
        for j, b in heads[x + 1 :]:
            ratio = SequenceMatcher(None, a, b).ratio()
            if ratio >= 0.9:
                want.add((i, j, ratio))
    assert {(x.a, x.b, x.ratio) for x in near_texts(docs).collect()} == want


def test_best_concept(spark):
    variables = spark.createDataFrame([(1, "Age in years", "x"), (2, None, ""), (3, "zzz", None), (4, "Sex", None)], "id long, label string, description string")
    concepts = spark.createDataFrame([("c1", 1, "age, in years", "x"), ("c2", 2, "sex", ""), ("c3", 3, "SEX", "")], "concept string, ord long, label string, definition string")
    got = {r.id: (r.concept, round(r.score, 3), r.status) for r in align_best(variables, concepts).collect()}
    assert got == {1: ("c1", 1.0, "accepted"), 2: (None, 0.0, "no_text"), 3: (None, 0.0, "rejected"), 4: ("c2", 0.8, "accepted")}


def test_best_concepts_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 7)
    monkeypatch.setattr(alignment, "SLICE", 5)
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(30)]
    text = lambda: " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 5])))
    concepts = [(f"c{i}", i * 7 % 101, text(), text()) for i in range(100)]
    variables = [(i, text(), text()) for i in range(120)]
    variables += [(200 + i, concepts[i][2], concepts[i][3]) for i in range(20)]
    want = {}
    for i, label, about in variables:
        best = (0.0, None, None)
        for name, order, own, meaning in sorted(concepts, key=lambda c: c[1]):
            each = [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in ((label, own), (about, meaning))]
            if (score := 0.8 * each[0] + 0.2 * each[1]) > best[0]:
                best = (score, order, name)
        want[i] = (best[2], best[0])
    got = align_best(spark.createDataFrame(variables, "id long, label string, description string").repartition(3), spark.createDataFrame(concepts, "concept string, ord long, label string, definition string"))
    assert {x.id: (x.concept, x.score) for x in got.collect()} == want
    texts = spark.createDataFrame([v[1:] for v in variables if v[1] or v[2]], "l string, d string").distinct()
    found = best_concepts(texts, spark.createDataFrame(concepts, "concept string, ord long, label string, definition string")).collect()
    assert sum(x.calls for x in found) < 0.2 * len(found) * len(concepts)
    assert best_concepts(texts, spark.createDataFrame([], "concept string, ord long, label string, definition string")).count() == texts.count()
