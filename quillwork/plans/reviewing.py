"""Queries of decisions and the cleaned registry, over events seen as a registry under review.

A user is a group, each ``k`` of its events a member; the latest event decides.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from ..operators import review
from .views import read


def _latest(spark, sf, least: int = 0):
    e = read(spark, sf, "events").where(F.col("event_id") % 10 >= least)
    k = F.get_json_object("props", "$.k").cast("long")
    last = e.groupBy(F.col("user_id").alias("parent_id"), k.alias("id")).agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("x"), F.array_sort(F.collect_set("event_type")).alias("detection_types"))
    decision = F.when(F.col("x.event_type") == "purchase", "approve").when(F.col("x.event_type") == "error", "reject").otherwise("pending")
    return last.where("id is not null").select("parent_id", "id", decision.alias("decision"), F.col("x.value").alias("confidence"), "detection_types")


def members(spark, sf):
    """Members; every user that is divisible by 4 has none."""
    return _latest(spark, sf).where("parent_id % 4 <> 0")


def groups(spark, sf):
    users = read(spark, sf, "events").groupBy(F.col("user_id").alias("parent_id")).agg(F.min("event_id").alias("ord"))
    return users.withColumn("name", F.concat(F.lit("User "), "parent_id")).withColumn("dismissed", F.col("parent_id") % 3 == 0).withColumn("origin", F.when(F.col("parent_id") % 5 == 0, "registry").otherwise("xml")).withColumn(
        "quality_flags", F.when(F.col("parent_id") % 7 == 0, F.array(F.lit("single_code"))).otherwise(F.array().cast("array<string>"))
    )


def cleaned(spark, sf):
    return read(spark, sf, "customer").where("c_custkey % 6 = 0").select(F.col("c_custkey").alias("list_id"))


def replaces(spark, sf):
    return _latest(spark, sf, 5).where("parent_id % 6 = 0 or parent_id % 4 = 1").select("parent_id", F.when(F.col("id") % 9 == 0, F.col("id") + 1000).otherwise(F.col("id")).alias("id")).distinct()


def store(spark, sf):
    old = _latest(spark, sf, 4).where("decision <> 'pending'")
    key = F.concat_ws("|", F.least(F.col("parent_id").cast("string"), F.col("id").cast("string")), F.greatest(F.col("parent_id").cast("string"), F.col("id").cast("string")))
    return old.groupBy(key.alias("key")).agg(F.min("decision").alias("decision")).withColumn("updated_at", F.lit("2025-01-01"))


def ids(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))


def set_decisions(spark, sf):
    updates = members(spark, sf).where("id % 3 = 0").select("parent_id", "id", F.lit("approve").alias("decision"))
    return review.set_decisions(members(spark, sf), updates).select("parent_id", "id", "decision")


def bulk_decisions(spark, sf):
    return review.bulk_decisions(members(spark, sf), "high-confidence", "approve").select("parent_id", "id", "decision")


def group_decisions(spark, sf):
    return review.group_decisions(groups(spark, sf), members(spark, sf))


def registry_stats(spark, sf):
    return review.registry_stats(groups(spark, sf), members(spark, sf))


def stats_by_type(spark, sf):
    return review.stats_by_type(members(spark, sf))


def entry_lookup(spark, sf):
    return review.entry(groups(spark, sf), members(spark, sf), 5).select("parent_id", "name", "id", "decision")


def browse_lists(spark, sf):
    return review.browse(groups(spark, sf), members(spark, sf), "approve", "1", page=2, per_page=10).select("parent_id", "name", "n_duplicates")


def browse_total(spark, sf):
    return review.browse_total(groups(spark, sf), members(spark, sf), ["approve", "pending"], "1", 10)


def browse_filters(spark, sf):
    g, m = groups(spark, sf), members(spark, sf)
    out = None
    for which in ("none", "dismissed", "registry", "suspect"):
        part = review.browse_filters(g, m, which).select(F.lit(which).alias("which"), "parent_id")
        out = part if out is None else out.unionByName(part)
    return out


def dismiss(spark, sf):
    return review.dismiss(groups(spark, sf), members(spark, sf), ids(spark, sf))


def add_unique(spark, sf):
    return review.add_unique(groups(spark, sf), members(spark, sf), cleaned(spark, sf), ids(spark, sf))


def remove_manual(spark, sf):
    return review.remove_manual(cleaned(spark, sf), replaces(spark, sf), ids(spark, sf))


def eligible_unique(spark, sf):
    return review.eligible_unique(groups(spark, sf), members(spark, sf), cleaned(spark, sf)).select("parent_id", (F.size("quality_flags") > 0).alias("suspect"))


def update_decisions(spark, sf):
    return review.update_decisions(store(spark, sf), members(spark, sf).where("id % 2 = 0"), F.lit("2026-01-01"))


def apply_decisions(spark, sf):
    return review.apply_decisions(members(spark, sf), store(spark, sf)).select("parent_id", "id", "decision", "decision_carried")


def sync_cleaned(spark, sf):
    entries, new = review.sync_cleaned(cleaned(spark, sf), replaces(spark, sf), members(spark, sf))
    return entries.select(F.lit("entry").alias("kind"), F.col("list_id").alias("parent_id"), F.lit(None).cast("long").alias("id")).unionByName(new.select(F.lit("replaces").alias("kind"), "parent_id", "id"))


def member_codes(spark, sf):
    """Event types as the codes of members, numbers of events as their labels."""
    e = read(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("long").alias("list_id"), "event_type")
    counts = e.groupBy("list_id", "event_type").agg(F.count("*").cast("string").alias("label")).join(members(spark, sf).select(F.col("id").alias("list_id")).distinct(), "list_id", "left_semi")
    at = F.row_number().over(Window.partitionBy("list_id").orderBy("event_type")) - 1
    return counts.select("list_id", at.cast("long").alias("pos"), F.col("event_type").alias("value"), "label")


def replaced_codes(spark, sf):
    return review.replaced_codes(replaces(spark, sf), member_codes(spark, sf))


def set_dismissed(spark, sf):
    g = groups(spark, sf)
    return review.set_dismissed(g, review.dismiss(g, members(spark, sf), ids(spark, sf).where("id % 2 = 0"))).select("parent_id", "dismissed")


def add_entries(spark, sf):
    g, c = groups(spark, sf), cleaned(spark, sf)
    results = review.add_unique(g, members(spark, sf), c, ids(spark, sf))
    return review.add_entries(c, g.select(F.col("parent_id").alias("list_id")), results)


def drop_entries(spark, sf):
    c = cleaned(spark, sf)
    return review.drop_entries(c, review.remove_manual(c, replaces(spark, sf), ids(spark, sf)))


def update_marks(spark, sf):
    """Dismissed groups; earlier marks on every third customer."""
    g = groups(spark, sf).select(F.col("parent_id").alias("id"), "dismissed")
    held = read(spark, sf, "customer").where("c_custkey % 5 < 2").select(F.col("c_custkey").alias("id"), F.lit("2025-01-01").alias("updated_at"))
    return review.update_marks(held, g, g.where("dismissed"), F.lit("2026-01-01"))


def sync_counters(spark, sf):
    c, r = cleaned(spark, sf), replaces(spark, sf)
    entries, new = review.sync_cleaned(c, r, members(spark, sf))
    return review.sync_counters(c, r, entries, new)


def sync_moved(spark, sf):
    """As ``sync_cleaned``, with groups whose parent was the one two ids before."""
    moved = groups(spark, sf).where("parent_id % 4 = 3").select("parent_id", (F.col("parent_id") - 2).alias("previous_parent"))
    entries, new = review.sync_cleaned(cleaned(spark, sf), replaces(spark, sf), members(spark, sf), moved)
    return entries.select(F.lit("entry").alias("kind"), F.col("list_id").alias("parent_id"), F.lit(None).cast("long").alias("id")).unionByName(new.select(F.lit("replaces").alias("kind"), "parent_id", "id"))


def edit_entries(spark, sf):
    entries = read(spark, sf, "customer").select(F.col("c_custkey").alias("list_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label"))
    o = read(spark, sf, "orders")
    op = F.when(F.col("o_orderkey") % 50 == 0, "delete").otherwise("set")
    edits = o.select(F.col("o_custkey").alias("list_id"), op.alias("op"), F.when(F.col("o_orderkey") % 2 == 0, "name").otherwise("label").alias("field"), F.concat(F.lit("order "), "o_orderkey").alias("new_value"), F.col("o_orderkey").alias("seq"))
    return review.edit_entries(entries, edits)


def swap_parent(spark, sf):
    m, g = members(spark, sf), groups(spark, sf)
    swaps = m.groupBy("parent_id").agg(F.min("id").alias("new_parent_id")).where("parent_id % 2 = 1")
    links = m.where("id % 5 <> 0").select("id").distinct()
    after, refused = review.swap_parent(m, g, links, swaps)
    return after.unionByName(refused.select("parent_id", F.col("new_parent_id").alias("id"), F.concat(F.lit("refused: "), "reason").alias("decision")))


def validate_cleaned(spark, sf):
    p = read(spark, sf, "part")
    value = F.when(F.col("p_size") % 9 == 0, " ").otherwise(F.col("p_type"))
    code = F.when(F.col("p_size") % 7 == 0, F.array(value)).otherwise(F.array(value, "p_name"))
    key = F.when(F.col("p_partkey") % 11 == 0, "other").otherwise(F.col("p_partkey").cast("string"))
    return review.validate_cleaned(p.select(F.col("p_partkey").cast("string").alias("list_id"), key.alias("key"), F.array(code).alias("codes")))


def migrate_v1(spark, sf):
    p = read(spark, sf, "part")
    first, second = F.when(F.col("p_size") % 2 == 0, F.array("p_brand")), F.when(F.col("p_size") % 3 == 0, F.array("p_type", "p_name"))
    return review.migrate_v1(p.select("p_partkey", first.alias("replaces"), second.alias("merged_duplicates"))).select("p_partkey", F.array_join("replaces", ";").alias("replaces"))


def edit_cleaned(spark, sf):
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag")))
    codes = lines.select(F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_partkey").cast("string").alias("value"), F.col("l_returnflag").alias("label"))
    op = F.when(F.col("l_suppkey") % 5 == 0, "delete").when(F.col("l_suppkey") % 5 == 1, "append").when(F.col("l_suppkey") % 5 == 2, "set")
    edits = lines.select(F.col("l_orderkey").alias("list_id"), op.alias("op"), F.col("l_linenumber").cast("long").alias("pos"), F.lit("label").alias("field"), F.concat(F.lit("new "), "l_suppkey").alias("new_value"), F.col("l_linenumber").cast("long").alias("seq")).where("op is not null")
    return review.edit_cleaned(codes, edits).select("list_id", "pos", "value", "label")


LATEST = """SELECT parent_id, id, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'pending' END AS decision, value AS confidence, types FROM (
    SELECT user_id AS parent_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id, event_type, value, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts DESC, event_id DESC) AS n,
      list(event_type) OVER (PARTITION BY user_id, json_extract_string(props, '$.k')) AS types FROM events WHERE event_id % 10 >= {0}) WHERE n = 1 AND id IS NOT NULL"""
KEY = "least(CAST(parent_id AS VARCHAR), CAST(id AS VARCHAR)) || '|' || greatest(CAST(parent_id AS VARCHAR), CAST(id AS VARCHAR))"
BASE = f"""WITH m AS (SELECT * FROM ({LATEST.format(0)}) WHERE parent_id % 4 <> 0),
  g AS (SELECT user_id AS parent_id, min(event_id) AS ord, 'User ' || CAST(user_id AS VARCHAR) AS name FROM events GROUP BY user_id),
  cl AS (SELECT c_custkey AS list_id FROM customer WHERE c_custkey % 6 = 0), i AS (SELECT c_custkey AS id FROM customer),
  rp AS (SELECT DISTINCT parent_id, CASE WHEN id % 9 = 0 THEN id + 1000 ELSE id END AS id FROM ({LATEST.format(5)}) WHERE parent_id % 6 = 0 OR parent_id % 4 = 1),
  st AS (SELECT {KEY} AS key, min(decision) AS decision, '2025-01-01' AS updated_at FROM ({LATEST.format(4)}) WHERE decision <> 'pending' GROUP BY 1)"""
NONE = "parent_id NOT IN (SELECT parent_id FROM m)"

MANAGED = "SELECT parent_id, id FROM m"
SYNCED = """, ap AS (SELECT DISTINCT parent_id, id FROM m WHERE decision = 'approve'), mg AS ({0}),
  nw AS (SELECT parent_id, id FROM rp WHERE (parent_id, id) NOT IN (SELECT (parent_id, id) FROM mg) UNION SELECT parent_id, id FROM ap),
  em AS (SELECT DISTINCT parent_id FROM rp WHERE (parent_id, id) IN (SELECT (parent_id, id) FROM mg) AND parent_id NOT IN (SELECT parent_id FROM nw)),
  en AS (SELECT list_id FROM cl WHERE list_id NOT IN (SELECT parent_id FROM em) UNION SELECT parent_id FROM ap)"""

ORACLES = {
    "set_decisions": BASE + " SELECT parent_id, id, CASE WHEN id % 3 = 0 THEN 'approve' ELSE decision END AS decision FROM m",
    "bulk_decisions": BASE + " SELECT parent_id, id, CASE WHEN confidence >= 0.95 THEN 'approve' ELSE decision END AS decision FROM m",
    "group_decisions": BASE + " SELECT g.parent_id, count(*) FILTER (decision = 'approve') AS approved, count(*) FILTER (decision = 'reject') AS rejected, count(*) FILTER (decision = 'pending') AS pending, count(id) AS total FROM g LEFT JOIN m USING (parent_id) GROUP BY 1",
    "registry_stats": BASE + " SELECT (SELECT count(*) FROM g) AS n_lists, count(*) AS n_duplicates, count(*) FILTER (decision = 'approve') AS approved, count(*) FILTER (decision = 'reject') AS rejected, count(*) FILTER (decision = 'pending') AS pending FROM m",
    "stats_by_type": BASE + " SELECT t AS detection_type, count(*) AS n FROM m, unnest(list_distinct(types)) AS x(t) GROUP BY 1",
    "entry_lookup": BASE + " SELECT parent_id, name, id, decision FROM g LEFT JOIN m USING (parent_id) WHERE parent_id = 5",
    "browse_lists": BASE + """ SELECT parent_id, name, n AS n_duplicates FROM (SELECT g.parent_id, g.name, g.ord, count(*) AS n, bool_or(decision = 'approve') AS d, bool_or(contains(CAST(id AS VARCHAR), '1')) AS h FROM g JOIN m USING (parent_id) GROUP BY ALL)
        WHERE d AND (h OR contains(lower(name), '1')) ORDER BY n DESC, ord LIMIT 10 OFFSET 10""",
    "browse_total": BASE + """ SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 10) AS BIGINT)) AS pages
        FROM (SELECT g.parent_id, g.name, bool_or(decision IN ('approve', 'pending')) AS d, bool_or(contains(CAST(id AS VARCHAR), '1')) AS h FROM g JOIN m USING (parent_id) GROUP BY ALL) WHERE d AND (h OR contains(lower(name), '1'))""",
    "browse_filters": BASE + f""" SELECT 'none' AS which, parent_id FROM g WHERE {NONE} AND parent_id % 3 <> 0 UNION ALL SELECT 'dismissed', parent_id FROM g WHERE parent_id % 3 = 0
        UNION ALL SELECT 'registry', parent_id FROM g WHERE parent_id % 5 = 0 UNION ALL SELECT 'suspect', parent_id FROM g WHERE parent_id % 7 = 0""",
    "dismiss": BASE + " SELECT id, CASE WHEN id NOT IN (SELECT parent_id FROM g) THEN 'not_found' WHEN id IN (SELECT parent_id FROM m) THEN 'skipped' ELSE 'updated' END AS result FROM i",
    "add_unique": BASE + " SELECT id, CASE WHEN id NOT IN (SELECT parent_id FROM g) THEN 'not_found' WHEN id IN (SELECT list_id FROM cl) THEN 'already_present' WHEN id IN (SELECT parent_id FROM m) THEN 'skipped' ELSE 'added' END AS result FROM i",
    "remove_manual": BASE + " SELECT id, CASE WHEN id NOT IN (SELECT list_id FROM cl) THEN 'not_found' WHEN id IN (SELECT parent_id FROM rp) THEN 'skipped' ELSE 'removed' END AS result FROM i",
    "eligible_unique": BASE + f" SELECT parent_id, parent_id % 7 = 0 AS suspect FROM g WHERE {NONE} AND parent_id % 3 <> 0 AND parent_id NOT IN (SELECT list_id FROM cl)",
    "update_decisions": BASE + f""", n AS (SELECT {KEY} AS key, max(decision) AS d FROM m WHERE id % 2 = 0 GROUP BY 1)
        SELECT * FROM (SELECT coalesce(n.key, st.key) AS key, coalesce(d, decision) AS decision, CASE WHEN d IS NULL OR d = decision THEN updated_at ELSE '2026-01-01' END AS updated_at FROM st FULL JOIN n ON st.key = n.key) WHERE decision IN ('approve', 'reject')""",
    "apply_decisions": BASE + f" SELECT parent_id, id, coalesce(st.decision, m.decision) AS decision, st.decision IS NOT NULL AS decision_carried FROM m LEFT JOIN st ON st.key = {KEY}",
    "sync_cleaned": BASE + """, ap AS (SELECT DISTINCT parent_id, id FROM m WHERE decision = 'approve'), nw AS (SELECT parent_id, id FROM rp WHERE (parent_id, id) NOT IN (SELECT (parent_id, id) FROM m) UNION SELECT parent_id, id FROM ap),
        em AS (SELECT DISTINCT parent_id FROM rp WHERE (parent_id, id) IN (SELECT (parent_id, id) FROM m) AND parent_id NOT IN (SELECT parent_id FROM nw))
        SELECT 'entry' AS kind, list_id AS parent_id, CAST(NULL AS BIGINT) AS id FROM (SELECT list_id FROM cl WHERE list_id NOT IN (SELECT parent_id FROM em) UNION SELECT parent_id FROM ap) UNION ALL SELECT 'replaces', parent_id, id FROM nw""",
    "replaced_codes": BASE + """, k AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS list_id, event_type AS value, CAST(count(*) AS VARCHAR) AS label FROM events GROUP BY 1, 2),
        q AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY value) - 1 AS pos FROM k WHERE list_id IN (SELECT id FROM m)) SELECT rp.parent_id, rp.id, pos, value, label FROM rp LEFT JOIN q ON q.list_id = rp.id""",
    "set_dismissed": BASE + f" SELECT parent_id, parent_id % 3 = 0 OR (parent_id IN (SELECT id FROM i WHERE id % 2 = 0) AND {NONE}) AS dismissed FROM g",
    "add_entries": BASE + f" SELECT list_id FROM cl UNION ALL SELECT parent_id FROM g WHERE parent_id IN (SELECT id FROM i) AND parent_id NOT IN (SELECT list_id FROM cl) AND {NONE}",
    "drop_entries": BASE + " SELECT list_id FROM cl WHERE list_id IN (SELECT parent_id FROM rp) OR list_id NOT IN (SELECT id FROM i)",
    "update_marks": BASE + """, o AS (SELECT c_custkey AS id, '2025-01-01' AS updated_at FROM customer WHERE c_custkey % 5 < 2), d AS (SELECT parent_id AS id FROM g WHERE parent_id % 3 = 0)
        SELECT id, updated_at FROM o WHERE id IN (SELECT id FROM d) OR id NOT IN (SELECT parent_id FROM g) UNION ALL SELECT id, '2026-01-01' FROM d WHERE id NOT IN (SELECT id FROM o)""",
    "sync_counters": BASE + SYNCED.format(MANAGED) + """ SELECT 'entries_created' AS counter, count(*) AS n FROM en WHERE list_id NOT IN (SELECT list_id FROM cl) UNION ALL SELECT 'entries_deleted', count(*) FROM cl WHERE list_id NOT IN (SELECT list_id FROM en)
        UNION ALL SELECT 'replaces_added', count(*) FROM (SELECT parent_id, id FROM nw EXCEPT SELECT parent_id, id FROM rp) UNION ALL SELECT 'replaces_removed', count(*) FROM (SELECT parent_id, id FROM rp EXCEPT SELECT parent_id, id FROM nw)""",
    "sync_moved": BASE + SYNCED.format(MANAGED + " UNION SELECT parent_id - 2, id FROM m WHERE parent_id % 4 = 3 UNION SELECT parent_id - 2, parent_id FROM g WHERE parent_id % 4 = 3")
    + " SELECT 'entry' AS kind, list_id AS parent_id, CAST(NULL AS BIGINT) AS id FROM en UNION ALL SELECT 'replaces', parent_id, id FROM nw",
    "edit_entries": """WITH e AS (SELECT o_custkey AS list_id, o_orderkey % 50 = 0 AS gone, o_orderkey % 2 = 0 AS named, 'order ' || CAST(o_orderkey AS VARCHAR) AS v, o_orderkey AS seq FROM orders),
        w AS (SELECT list_id, max_by(v, seq) FILTER (named AND NOT gone) AS n, max_by(v, seq) FILTER (NOT named AND NOT gone) AS l, bool_or(gone) AS gone FROM e GROUP BY 1)
        SELECT c_custkey AS list_id, coalesce(n, c_name) AS name, coalesce(l, c_mktsegment) AS label FROM customer LEFT JOIN w ON list_id = c_custkey WHERE NOT coalesce(gone, false)""",
    "swap_parent": BASE + """, w AS (SELECT parent_id, min(id) AS np FROM m WHERE parent_id % 2 = 1 GROUP BY 1), ok AS (SELECT * FROM w WHERE parent_id % 5 <> 0 AND np % 5 <> 0)
        SELECT coalesce(np, parent_id) AS parent_id, id, decision FROM m LEFT JOIN ok USING (parent_id) WHERE np IS NULL OR id <> np UNION ALL SELECT np, parent_id, 'pending' FROM ok
        UNION ALL SELECT parent_id, np, CASE WHEN parent_id % 5 = 0 THEN 'refused: registry' ELSE 'refused: no links' END FROM w WHERE parent_id % 5 = 0 OR np % 5 = 0""",
    "validate_cleaned": """SELECT CAST(p_partkey AS VARCHAR) AS list_id, 'codes[0]' AS path, CASE WHEN p_size % 7 = 0 THEN 'not a pair' ELSE 'blank value' END AS message FROM part WHERE p_size % 7 = 0 OR p_size % 9 = 0
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'id', 'id is not the key' FROM part WHERE p_partkey % 11 = 0""",
    "migrate_v1": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand WHEN p_size % 3 = 0 THEN p_type || ';' || p_name ELSE '' END AS replaces FROM part",
    "edit_cleaned": """WITH li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2), x AS (SELECT l_orderkey AS list_id, 0 AS s, l_linenumber AS p, CAST(l_partkey AS VARCHAR) AS value, CASE WHEN l_suppkey % 5 = 2 THEN 'new ' || CAST(l_suppkey AS VARCHAR) ELSE l_returnflag END AS label FROM li WHERE l_suppkey % 5 <> 0
        UNION ALL SELECT l_orderkey, 1, l_linenumber, 'new ' || CAST(l_suppkey AS VARCHAR), '' FROM li WHERE l_suppkey % 5 = 1)
        SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY s, p, value, label) - 1 AS pos, value, label FROM x""",
}

QUERIES = {f.__name__: f for f in (
    set_decisions, bulk_decisions, group_decisions, registry_stats, stats_by_type, entry_lookup, browse_lists, browse_total, browse_filters, dismiss, add_unique, remove_manual, eligible_unique,
    update_decisions, apply_decisions, sync_cleaned, replaced_codes, swap_parent, validate_cleaned, migrate_v1, edit_cleaned,
    set_dismissed, add_entries, drop_entries, update_marks, sync_counters, sync_moved, edit_entries,
)}
