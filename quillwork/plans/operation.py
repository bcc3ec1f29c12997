"""A whole run: lists in, registry and new state out; summary and sinks."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ..operators import candidates, grouping, judging, quality, review, signature, similarity
from ..sources.snapshots import Snapshots


class Counters:
    """Counters of tables that a run writes anyway: observed while they are written, in the stage that writes, with no scan of their own."""

    def __init__(self, spark: SparkSession):
        self.spark, self._held = spark, []

    def written(self, df: DataFrame, name: str, **counters: Column) -> DataFrame:
        seen = Observation()
        out = grouping.written(df.observe(seen, *(c.alias(k) for k, c in counters.items())), name)
        self._held.append(seen)
        return out

    def summary(self) -> DataFrame:
        """One row of all counters so far."""
        values = {k: v or 0 for seen in self._held for k, v in seen.get.items()}
        return self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} long" for k in values))


WARNING = "phase string, status string, reason string"


def detect(lists: DataFrame, codes: DataFrame, embed: Callable | None = None, counters: Counters | None = None, inspect: float = similarity.INSPECT) -> dict[str, DataFrame]:
    """Signatures, all detection phases and candidates of ``lists (list_id, ord, name, vars)`` and normalised ``codes``.

    ``embed``, texts to vectors, is what the semantic phases need; without it they are
    left out, which ``warnings (phase, status, reason)`` says. Lists with too many codes
    for the fuzzy phase are warned of too. ``fuzzy`` has the pairs from ``inspect`` on; candidates need
    the detected ones alone (``similarity.DETECTED``). ``summary`` has the counters of ``run_summary``.
    """
    counters = counters or Counters(lists.sparkSession)
    most = similarity.MOST_CODES
    codes = grouping.written(codes, "codes")  # read three times below
    flagged = lists.join(quality.quality_flags(lists, codes), "list_id").withColumn("name_key", F.lower(F.coalesce("name", F.lit(""))))
    signed = signature.signatures(flagged, codes).withColumn("var_sig", signature.usage_signature(F.col("vars")))
    ordered = codes.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value", "label"))).alias("c")).select("list_id", F.transform("c", lambda x: F.struct(x["value"].alias("value"), x["label"].alias("label"))).alias("codes"))
    signed = signed.join(ordered, "list_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast(signature.PAIRS)))
    signed = counters.written(signed, "signed", codelists=F.count("*"), placeholder=F.count_if(F.array_contains("quality_flags", "placeholder")), excluded_over_max_codes=F.count_if(F.col("n_codes") > most))
    fuzzy = grouping.written(similarity.fuzzy_pairs(signed, inspect), "fuzzy")
    semantic = None if embed is None else grouping.written(judging.semantic_phases(signed, embed), "semantic")
    found = candidates.assemble(
        signature.exact_groups(signed), fuzzy.where("level = 'detected'").select("a", "b", "score"), signature.business_groups(signed), signature.label_groups(signed), signature.usage_groups(signed), semantic
    )
    large = similarity.fuzzy_excluded(signed).agg(F.count("*").alias("n")).where("n > 0")
    warnings = large.select(F.lit("fuzzy").alias("phase"), F.lit("partial").alias("status"), F.format_string(f"%d lists of more than {most} codes left out", "n").alias("reason"))
    if semantic is None:
        warnings = warnings.unionByName(lists.sparkSession.createDataFrame([("semantic", "skipped", "no function to embed texts")], WARNING))
    found = counters.written(found, "candidates", candidates=F.count("*"))
    return {"lists": signed, "fuzzy": fuzzy, "candidates": found, "warnings": warnings, "summary": counters.summary()} | ({} if semantic is None else {"semantic": semantic})


def run_operation(lists: DataFrame, codes: DataFrame, state: dict[str, DataFrame] | None = None, embed: Callable | None = None, inspect: float = similarity.INSPECT) -> dict[str, DataFrame]:
    """One run: earlier cleaned lists first, then detection, registry, carried decisions, new state.

    ``state``: ``cleaned (list_id)``, ``replaces (parent_id, id)``, ``store (key,
    decision, updated_at)``. Lists that a cleaned list replaces do not come up again.
    """
    if state:
        gone = state["replaces"].select(F.col("id").alias("list_id")).distinct()
        lists, codes = lists.join(gone, "list_id", "left_anti"), codes.join(gone, "list_id", "left_anti")
        known = state["cleaned"].select("list_id", F.lit("registry").alias("origin"))
        lists = lists.join(known, "list_id", "left").withColumn("origin", F.coalesce("origin", F.lit("xml")))
    else:
        lists = lists.withColumn("origin", F.lit("xml"))
    counters = Counters(lists.sparkSession)
    found = detect(lists, codes, embed, counters, inspect)
    ranked = found["lists"].select("list_id", "ord", "origin", F.lit(False).alias("preferred"))
    registry = grouping.written(grouping.registry(found["candidates"], ranked), "registry")
    members = registry.where("id <> parent_id").withColumn("decision", F.lit("pending"))
    if state:
        members = review.apply_decisions(members, state["store"])
    else:
        members = members.withColumn("decision_carried", F.lit(False))
    members = counters.written(members, "run-members", decisions_carried=F.count_if("decision_carried"))
    return found | {"registry": registry, "members": members, "summary": counters.summary()}


def close_review(members: DataFrame, state: dict[str, DataFrame], as_of: str) -> dict[str, DataFrame]:
    """The state after a review of ``members``."""
    cleaned, replaces = review.sync_cleaned(state["cleaned"], state["replaces"], members)
    return {
        "cleaned": grouping.written(cleaned, "cleaned"),
        "replaces": grouping.written(replaces, "replaces"),
        "store": grouping.written(review.update_decisions(state["store"], members, F.lit(as_of)), "store"),
    }


NO_STATE = {"cleaned": "list_id {id}", "replaces": "parent_id {id}, id {id}", "store": "key string, decision string, updated_at string"}


def stored_operation(store: Snapshots, run_id: str, lists: DataFrame, codes: DataFrame, judge: Callable[[DataFrame], DataFrame], as_of: str, inspect: float = similarity.INSPECT) -> dict[str, DataFrame]:
    """One run on stored state: read, detect, review with ``judge`` (members to members with decisions), commit.

    Returns the run's tables. The store is as it was until the last step, and stays so if
    any step fails; if another run has committed in between, this one raises
    ``Conflict`` and can be run again. The registry and the members are kept with the
    state, by run.
    """
    base = store.current()
    state = store.read(base) if base else None
    if state is None:
        kind = lists.schema["list_id"].dataType.simpleString()
        state = {name: store.spark.createDataFrame([], shape.format(id=kind)) for name, shape in NO_STATE.items()}
    found = run_operation(lists, codes, {name: state[name] for name in NO_STATE}, inspect=inspect)
    members = grouping.written(judge(found["members"]), "judged")
    after = close_review(members, state, as_of)
    store.commit(run_id, after | {"registry": found["registry"], "members": members}, base)
    return found | {"members": members}


def run_summary(lists: DataFrame, found: DataFrame, versions: DataFrame | None = None, members: DataFrame | None = None, most_codes: int = similarity.MOST_CODES) -> DataFrame:
    """One row of counters over a run's tables."""
    parts = [
        lists.agg(F.count("*").alias("codelists"), F.count_if(F.array_contains("quality_flags", "placeholder")).alias("placeholder"), F.count_if(F.col("n_codes") > most_codes).alias("excluded_over_max_codes")),
        found.agg(F.count("*").alias("candidates")),
    ]
    if versions is not None:
        parts.append(versions.agg(F.coalesce(F.sum(F.col("n_versions") - 1), F.lit(0)).alias("older_versions_ignored")))
    if members is not None:
        parts.append(members.agg(F.count_if("decision_carried").alias("decisions_carried")))
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def summarised(spark: SparkSession, path: str, run_id: str, job: Callable[[], DataFrame]) -> DataFrame | None:
    """Run ``job`` and write its one-row summary with a status; on failure the status is ``error`` and the error goes on."""
    try:
        row = job()
        row.withColumn("status", F.lit("success")).withColumn("run_id", F.lit(run_id)).write.mode("append").json(path)
        return row
    except Exception as e:
        spark.range(1).select(F.lit("error").alias("status"), F.lit(run_id).alias("run_id"), F.lit(str(e)[:500]).alias("message")).write.mode("append").json(path)
        raise


PREFIXES = ["@prefix skos: <http://www.w3.org/2004/02/skos/core#> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> ."]


def turtle_lines(pairs: DataFrame, base: str) -> DataFrame:
    """``line`` for each pair ``a, b, score``; pairs without an id are left out."""
    full = pairs.where(F.coalesce(F.col("a").cast("string"), F.lit("")) != "").where(F.coalesce(F.col("b").cast("string"), F.lit("")) != "")
    return full.select(F.format_string("<%s/%s> skos:closeMatch <%s/%s> ; rdfs:comment \"%.4f\" .", F.lit(base), F.col("a").cast("string"), F.lit(base), F.col("b").cast("string"), F.col("score")).alias("line"))


def write_turtle(pairs: DataFrame, base: str, path: str) -> None:
    spark = pairs.sparkSession
    turtle_lines(pairs, base).write.text(path)
    spark.createDataFrame([(p,) for p in PREFIXES], "line string").coalesce(1).write.mode("append").text(path)
