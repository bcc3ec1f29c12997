import random

import pyspark.sql.functions as F

from quillwork.operators import profile
from quillwork.plans import operation


def test_merged_sketches_are_one_pass_within_their_error(spark):
    r = random.Random(4)
    runs = [[int(r.paretovariate(1.1)) for _ in range(n)] for n in (4000, 1, 0, 2500, 300)]
    tables = [spark.createDataFrame([(x,) for x in run], "n_codes long").repartition(3) for run in runs]
    kept = tables[0].limit(0).transform(lambda df: profile.size_sketch(df, "none"))
    for i, df in enumerate(tables):
        kept = kept.unionByName(profile.size_sketch(df, f"r{i}"))
    found = profile.merged_profile(kept).first()
    every = sorted(x for run in runs for x in run)
    assert (found.n_lists, found.n_codes, found.least, found.most, found.mean) == (len(every), sum(every), every[0], every[-1], sum(every) / len(every))
    for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95)):
        value = found[name]
        below, upto = sum(x < value for x in every) / len(every), sum(x <= value for x in every) / len(every)
        assert below - 0.01 <= q <= upto + 0.01, name
    nothing = profile.merged_profile(kept.where("run_id = 'none'")).first()
    assert (nothing.n_lists, nothing.p50) == (0, None)


def test_counters_are_observed_while_tables_are_written(spark):
    lists = spark.createDataFrame([(i, i, f"n{i}", []) for i in range(6)], "list_id long, ord long, name string, vars array<string>")
    codes = spark.createDataFrame([(i, k, str(k), f"label {k}" if i != 5 else "voir dictionnaire") for i in range(6) for k in range(3)], "list_id long, pos int, value string, label string")
    found = operation.run_operation(lists, codes)
    got = found["summary"].first().asDict()
    want = operation.run_summary(found["lists"], found["candidates"], members=found["members"]).first().asDict()
    assert got == want and got["codelists"] == 6 and got["placeholder"] == 1 and got["candidates"] > 0
    assert found["members"].agg(F.count("*")).first()[0] > 0
