import re

import numpy as np
import pyspark.sql.functions as F
import pytest

from quillwork.operators import semantic
from quillwork.operators.semantic import cell_pairs, cosine_pairs, metric_cells

SCHEMA = "id long, embedding array<float>"


def brute(rows, threshold):
    held = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None]
    unit = [(i, v / (np.linalg.norm(v) or 1.0)) for i, v in held]
    return {(min(i, j), max(i, j)) for k, (i, a) in enumerate(unit) for j, b in unit[k + 1 :] if i != j and float(a @ b) >= threshold}


def clustered(seed, n=300, clusters=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, 16))
    rows = [(i, (centres[r.integers(clusters)] + r.normal(size=16) * 0.12).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(n, None), (n + 1, [0.0] * 16), (n + 2, rows[0][1]), (n + 3, [2 * x for x in rows[1][1]])]


@pytest.mark.parametrize("threshold", [0.9, 0.3, 0.0, -0.5])
def test_pairs_are_those_of_all_vectors(spark, threshold):
    rows = clustered(1)
    found = [(r.a, r.b) for r in cosine_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold, block=20).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, threshold)


def test_far_cells_are_skipped(spark):
    _, sizes, pairs = metric_cells(spark.createDataFrame(clustered(2), SCHEMA), 0.9, block=20)
    held = sum(n > 0 for n in sizes)
    assert sum(sizes) == 302 and len(pairs) < 0.5 * held * (held + 1) / 2


def test_the_triangle_inequality_decides():
    ranges = np.array([[[0.0, 0.2], [1.0, 1.3]], [[1.1, 1.4], [0.0, 0.1]]])
    assert cell_pairs(ranges, 0.9) == [(0, 0), (1, 1)]
    assert cell_pairs(ranges, 0.3) == cell_pairs(ranges, 0.0) == [(0, 0), (0, 1), (1, 1)]


def test_no_vectors(spark):
    assert cosine_pairs(spark.createDataFrame([(1, None)], SCHEMA), 0.5).collect() == []
    assert semantic.PIVOTS > 0


def exchanges(df):
    """Names of the shuffles in the plan of what is not yet written."""
    return re.findall(r"Exchange (?:hash|range|round)\w*", df._jdf.queryExecution().executedPlan().toString())


def test_vectors_are_shuffled_before_their_blocks_meet(spark):
    """What pairs of blocks read is a written table with one row for each block, so it does not grow with their square."""
    rows = clustered(3)
    found = cosine_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.3, block=20)
    assert exchanges(found) == [] and {(r.a, r.b) for r in found.collect()} == brute(rows, 0.3)


def test_a_column_goes_with_its_vectors(spark):
    rows = clustered(4, n=120)
    vectors = spark.createDataFrame([(i, v, None if i % 5 == 0 else f"list {i % 7}") for i, v in rows], SCHEMA + ", list_id string").repartition(3)
    found = cosine_pairs(vectors, 0.5, block=20, carry="list_id")
    got = found.collect()
    name = lambda i: None if i % 5 == 0 else f"list {i % 7}"
    assert {(r.a, r.b) for r in got} == brute(rows, 0.5) and all((r.list_id_a, r.list_id_b) == (name(r.a), name(r.b)) for r in got)
    owners = vectors.select("id", "list_id")
    best = lambda df: {(r.a, r.b): r.score for r in df.collect()}
    by_join = best(semantic.list_pairs(cosine_pairs(vectors, 0.5), owners))
    by_carrying = best(semantic.list_pairs(found))
    assert by_join.keys() == by_carrying.keys() and all(abs(by_join[k] - by_carrying[k]) < 1e-12 for k in by_join)


def test_judgements_that_pairs_hold_are_not_joined(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5, "direct"), (1, 3, 0.6, "variable"), (2, 4, 0.95, "uid_embed")], "a long, b long, score double, phase string")
    judged = F.when(F.col("b") % 2 == 0, 0.91)
    found = semantic.pairs_to_candidates(pairs, judged)
    by_join = semantic.pairs_to_candidates(pairs, pairs.select("a", "b", judged.alias("confidence")))
    assert exchanges(found) == [] and sorted(found.collect()) == sorted(by_join.collect())
