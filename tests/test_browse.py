from quillwork.operators import review


def test_pages_names_and_totals(spark):
    groups = spark.createDataFrame([("g1", "Alpha", 1, list("abcdefg")), ("g2", "", 2, []), ("third-group-id", None, 3, ["x"]), ("g4", "Beta", 4, [])], "parent_id string, name string, ord long, vars array<string>")
    members = spark.createDataFrame([("g1", "m1", "Gamma", "pending"), ("g1", "m2", "", "approve"), ("g2", "m3", "Delta", "reject")], "parent_id string, id string, name string, decision string")
    page = lambda *a, **k: [(r.parent_id, r.n_duplicates) for r in review.browse(groups, members, *a, **k).collect()]
    total = lambda *a, **k: tuple(review.browse_total(groups, members, *a, **k).first())
    assert page(per_page=2) == [("g1", 2), ("g2", 1)] and page(per_page=2, page=2) == [("third-group-id", 0), ("g4", 0)]
    assert page("reject") == [("g2", 1)] and page(["approve", "reject"]) == [("g1", 2), ("g2", 1)]
    assert page(["approve", "reject", "pending"]) == page()
    # Names of members, their ids where they have none, and ids of groups without a name.
    assert page(search="GAMMA") == page(search="m2") == [("g1", 2)] and page(search="m1") == [] and page(search="third-grou") == [("third-group-id", 0)] and page(search="third-group") == []
    assert [r.parent_id for r in review.browse(groups, members, by="name").collect()][-2:] == ["g1", "g4"]
    first = review.browse(groups, members).first()
    assert (first.n_vars, first.vars) == (7, list("abcde"))
    assert total() == (4, 1) and total(per_page=3) == (4, 2) and total(search="nothing") == (0, 1)
