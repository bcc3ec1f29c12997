import pyspark.sql.functions as F
import pytest

from quillwork.operators import similarity
from quillwork.plans import operation
from quillwork.sources.snapshots import Conflict, Snapshots


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def rows(tables, name="t"):
    return sorted(r.id for r in tables[name].collect())


def test_versions_follow_each_other_and_readers_keep_theirs(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/state")
    assert store.current() is None and store.read() is None and store.unreferenced() == []
    first = store.commit("r1", {"t": table(spark, "a"), "empty": table(spark)}, None)
    old = store.read()
    second = store.commit("r2", {"t": table(spark, "b", "c")}, first)
    assert (rows(old), rows(old, "empty"), rows(store.read()), rows(store.read(first))) == (["a"], [], ["b", "c"], ["a"])
    assert store.versions() == [1, 2] and store.current() == second and Snapshots(spark, store.path).current().run_id == "r2"


def test_of_two_runs_from_one_state_the_second_is_refused(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/state")
    base = store.commit("r0", {"t": table(spark, "a")}, None)
    store.commit("r1", {"t": table(spark, "b")}, base)
    with pytest.raises(Conflict):
        store.commit("r2", {"t": table(spark, "c")}, base)
    with pytest.raises(Conflict):
        store.commit("r3", {"t": table(spark, "c")}, None)
    assert rows(store.read()) == ["b"]


def test_a_pointer_that_appears_meanwhile_is_not_overwritten(spark, tmp_path, monkeypatch):
    store = Snapshots(spark, f"file://{tmp_path}/state")
    base = store.commit("r0", {"t": table(spark, "a")}, None)
    monkeypatch.setattr(store, "_still", lambda _: None)  # both runs have looked already
    store.commit("r1", {"t": table(spark, "b")}, base)
    with pytest.raises(Conflict):
        store.commit("r2", {"t": table(spark, "c")}, base)
    assert rows(store.read()) == ["b"] and len(store.unreferenced()) == 1


def test_a_run_that_dies_between_tables_and_pointer_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = Snapshots(spark, f"file://{tmp_path}/state")
    base = store.commit("r0", {"t": table(spark, "a")}, None)
    looked = []

    def die(_):
        looked.append(1)
        if len(looked) == 2:  # tables are written, the pointer is not
            raise KeyboardInterrupt

    monkeypatch.setattr(store, "_still", die)
    with pytest.raises(KeyboardInterrupt):
        store.commit("r1", {"t": table(spark, "b"), "u": table(spark, "x")}, base)
    again = Snapshots(spark, store.path)
    assert again.current() == base and rows(again.read()) == ["a"] and len(again.unreferenced()) == 1
    again.commit("r1", {"t": table(spark, "b")}, base)
    assert rows(again.read()) == ["b"]


def test_operations_over_stored_state(spark, tmp_path):
    codes = {"a": "12", "b": "12", "c": "12", "d": "123456789", "e": "12345678", "f": "x"}
    lists = spark.createDataFrame([(k, i, f"list {k}", []) for i, k in enumerate(codes)], "list_id string, ord long, name string, vars array<string>")
    each = spark.createDataFrame([(k, p, v, f"label {v}") for k, values in codes.items() for p, v in enumerate(values)], "list_id string, pos int, value string, label string")
    store = Snapshots(spark, f"file://{tmp_path}/state")
    decide = lambda m: m.withColumn("decision", F.when(F.col("id") == "b", "approve").when(F.col("id") == "c", "reject").otherwise("pending"))
    first = operation.stored_operation(store, "one", lists, each, decide, "2026-01-01")
    assert {("a", "b"), ("a", "c")} <= {(r.parent_id, r.id) for r in first["members"].collect()}
    state = store.read()
    assert [(r.parent_id, r.id) for r in state["replaces"].collect()] == [("a", "b")] and [r.list_id for r in state["cleaned"].collect()] == ["a"]

    def fail(members):
        raise ZeroDivisionError

    with pytest.raises(ZeroDivisionError):
        operation.stored_operation(store, "broken", lists, each, fail, "2026-01-02")
    assert store.versions() == [1]
    second = operation.stored_operation(store, "two", lists, each, lambda m: m, "2026-02-01")
    found = {(r.parent_id, r.id): (r.decision, r.decision_carried) for r in second["members"].collect()}
    assert found["a", "c"] == ("reject", True) and ("a", "b") not in found and store.versions() == [1, 2]


def test_a_run_makes_its_codes_once_and_candidates_need_detected_pairs_alone(spark):
    alike = {f"l{i}": "abcdefghijkl"[: 7 + i % 6] for i in range(12)}
    lists = spark.createDataFrame([(k, i, "list", []) for i, k in enumerate(alike)], "list_id string, ord long, name string, vars array<string>")
    made = spark.sparkContext.accumulator(0)

    def label(rows):
        for batch in rows:
            made.add(len(batch))
            yield batch

    each = [(k, p, v, f"label {v}") for k, values in alike.items() for p, v in enumerate(values)]
    shape = "list_id string, pos int, value string, label string"
    codes = spark.createDataFrame(each, shape).mapInPandas(label, shape)
    tables = [operation.detect(lists, codes, inspect=inspect) for inspect in (similarity.INSPECT, similarity.DETECTED)]
    assert made.value == 2 * len(each)
    whole, detected = (sorted(tuple(r) for r in t["candidates"].collect()) for t in tables)
    assert whole == detected and any(r[2] == "fuzzy" for r in whole)
    levels = [{r.level for r in t["fuzzy"].collect()} for t in tables]
    assert levels == [{"inspect", "detected"}, {"detected"}]
