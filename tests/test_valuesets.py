import math
import random
from collections import Counter

import pyspark.sql.functions as F
import pytest

from quillwork.operators import valuesets
from quillwork.operators.valuesets import overlapping_lists


def brute(lists, share):
    bags = {i: Counter(v for v in values if v is not None) for i, values in lists.items()}
    out = set()
    for i in lists:
        for j in lists:
            if i < j and bags[i] and bags[j]:
                need = math.ceil(share * max(bags[i].total(), bags[j].total()) - 1e-9)
                if (bags[i] & bags[j]).total() >= need:
                    out.add((i, j))
    return out


def run(spark, lists, share, **more):
    rows = [(i, i, v) for i, values in lists.items() for v in values]
    codes = spark.createDataFrame(rows, "list_id long, ord long, value string").repartition(3)
    found = [tuple(r) for r in overlapping_lists(codes, share, **more).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("seed,share,frequent,one_in", [(1, 0.75, 128, 64), (2, 0.75, 4, 2), (3, 0.5, 11, 8), (4, 0.9, 0, 64)])
def test_against_all_pairs(spark, seed, share, frequent, one_in):
    r = random.Random(seed)
    common, rare = [str(i) for i in range(14)], [f"r{i}" for i in range(300)]
    lists = {}
    for i in range(140):
        kind = r.random()
        values = r.sample(common, r.randrange(1, 14)) if kind < 0.5 else r.sample(rare, r.randrange(1, 20)) if kind < 0.6 else r.sample(common, r.randrange(1, 9)) + r.sample(rare[:12], r.randrange(0, 5))
        if r.random() < 0.2:
            values += [r.choice(values)] * r.randrange(1, 4)
        if r.random() < 0.3 and i > 5:
            values = list(lists[r.randrange(i)])
            values[r.randrange(len(values))] = r.choice(rare)
        lists[i] = values + ([None] if r.random() < 0.05 else [])
    assert run(spark, lists, share, frequent=frequent, one_in=one_in) == brute(lists, share)


def test_a_set_of_many_lists_is_split(spark, monkeypatch):
    monkeypatch.setattr(valuesets, "BLOCK", 7)
    lists = {i: ["1", "2"] for i in range(40)} | {100 + i: ["1", "2", "3"] for i in range(20)} | {200: ["9"]}
    assert run(spark, lists, 0.6, one_in=64) == brute(lists, 0.6)
    assert run(spark, lists, 0.6, frequent=0) == brute(lists, 0.6)


def test_no_lists(spark):
    assert run(spark, {}, 0.75) == set()
    assert run(spark, {1: [None], 2: [None]}, 0.75) == set()


def test_one_value_in_all_lists_makes_no_pairs_of_its_own(spark):
    """The walk ends at nodes that can't reach the overlap: what it writes is of the size of the result."""
    lists = {i: ["all", *(f"v{i}-{k}" for k in range(7))] for i in range(300)}
    codes = spark.createDataFrame([(i, i, v) for i, values in lists.items() for v in values], "list_id long, ord long, value string")
    members, sets = valuesets.token_sets(codes)
    assert sets.count() == 300 and overlapping_lists(codes, 0.75).count() == 0
    assert members.select(F.countDistinct("set")).first()[0] == 300
