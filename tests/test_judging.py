import sys

import numpy as np
from pyspark import cloudpickle

from quillwork.operators import judging
from quillwork.operators.judging import Ledger, semantic_phases, to_judge, with_judgements
from quillwork.plans import operation

# Workers can't import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def answer(texts):
    if any("bad" in t for t in texts):
        raise OSError("too bad")
    return [f'{{"meme_concept": true, "confiance": 0.9, "raison": "{len(t)}"}}' if "odd" not in t else "no object" for t in texts]


def never(texts):
    raise AssertionError(texts)


def told(df):
    return sorted((r.id, r.same_concept, r.confidence, r.reason) for r in df.collect())


def test_a_second_run_makes_no_call_and_errors_are_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(judging, "BATCH", 2)
    monkeypatch.setattr(judging, "APPEND", 2)
    rows = spark.createDataFrame([(1, "one"), (2, "one"), (3, "bad"), (4, "odd"), (5, None), (6, "")], "id long, prompt string").repartition(2)
    want = [(1, True, 0.9, "3"), (2, True, 0.9, "3"), (3, False, 0.0, "Erreur: too bad"), (4, False, 0.0, "Réponse non parseable"), (5, True, 0.9, "0"), (6, True, 0.9, "0")]
    path = f"file://{tmp_path}/ledger"
    assert told(with_judgements(rows, Ledger(spark, path, "m"), answer)) == want
    assert told(with_judgements(rows, Ledger(spark, path, "m"), never)) == want
    # Only what is new is asked; another model's answers are its own.
    more = rows.unionByName(spark.createDataFrame([(7, "seven")], rows.schema))
    asked = with_judgements(more, Ledger(spark, path, "m"), lambda texts: answer(texts) if texts == ["seven"] else never(texts))
    assert told(asked) == [*want, (7, True, 0.9, "5")]
    other = told(with_judgements(rows, Ledger(spark, path, "n"), lambda texts: ["{}"] * len(texts)))
    assert {r[1:] for r in other} != {r[1:] for r in want}
    # An error is asked again on demand, and an answer then counts before it.
    again = told(with_judgements(rows, Ledger(spark, path, "m"), lambda texts: answer(["good"] * len(texts)) if set(texts) == {"bad"} else never(texts), retry=True))
    assert again[2] == (3, True, 0.9, "4")


def test_no_rows_make_no_call(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, prompt string")
    assert told(with_judgements(rows, Ledger(spark, f"file://{tmp_path}/ledger"), never)) == []


def embed(texts):
    out = np.zeros((len(texts), 26), np.float32)
    for i, t in enumerate(texts):
        for c in t:
            if "a" <= c <= "z":
                out[i, ord(c) - 97] += 1
    return out


LISTS = [
    ("p", 1, "abc", ["x"], "u-v-w"), ("q", 2, "bca", ["x"], "u-v-z"), ("r", 3, "zzz", [], "k"), ("s", 4, "cab", ["y"], ""), ("t", 5, "mnopq", ["abcabc"], "u-v"),
]


def test_phases_come_in_the_order_of_emission(spark):
    code = "array<struct<value:string,label:string>>"
    lists = spark.createDataFrame([(*r, []) for r in LISTS], f"list_id string, ord long, name string, vars array<string>, user_id string, codes {code}")
    found = semantic_phases(lists, embed).orderBy("rank").collect()
    by_phase = {}
    for r in found:
        by_phase.setdefault(r.phase, []).append((r.a, r.b, r.score))
    assert list(by_phase) == ["direct", "variable", "uid_prefix", "uid_embed"]
    assert by_phase["direct"] == [("p", "q", 1.0), ("p", "s", 1.0), ("q", "s", 1.0)]
    assert by_phase["variable"] == [("p", "q", 1.0)]
    assert by_phase["uid_prefix"] == [("p", "q", 0.6667), ("p", "t", 0.6667), ("q", "t", 0.6667)]
    judged = [(r.a, r.b, r.score, r.phase) for r in to_judge(semantic_phases(lists, embed), 4).collect()]
    # A pair counts by its first emission, whatever a later phase says of it.
    assert judged == [("p", "q", 1.0, "direct"), ("p", "s", 1.0, "direct"), ("q", "s", 1.0, "direct"), ("p", "t", 0.6667, "uid_prefix")]


def test_a_run_reports_semantic_pairs_or_says_that_it_has_none(spark):
    lists = spark.createDataFrame([r[:4] for r in LISTS], "list_id string, ord long, name string, vars array<string>")
    codes = spark.createDataFrame([(r[0], 0, r[0] * 2, f"label {r[0]}") for r in LISTS] + [(r[0], 1, r[0] * 3, r[2]) for r in LISTS], "list_id string, pos int, value string, label string")
    found = operation.detect(lists, codes, lambda texts: np.ones((len(texts), 3), np.float32))
    kinds = {(r.master_id, r.slave_id, r.detection_type) for r in found["candidates"].collect()}
    assert any(k.startswith("semantic") for *_, k in kinds) and found["warnings"].collect() == []
    plain = operation.detect(lists, codes)
    assert [tuple(r) for r in plain["warnings"].collect()] == [("semantic", "skipped", "no function to embed texts")]
