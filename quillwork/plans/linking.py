"""Queries of near duplicates, candidates and groups."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..functions import text
from ..operators import candidates as assembly
from ..operators import alignment, grouping, neardocs, profile, review, similarity, signature
from . import views
from .listing import _sig
from .views import read


def _lists(spark, sf):
    """Customers with their codes in order and all signatures; years and states of orders as usage."""
    codes = views.customer_codes(spark, sf)
    signed = signature.signatures(views.customers(spark, sf), codes)
    ordered = codes.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("value", "label"))).alias("codes"))
    usage = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("list_id")).agg(F.array_sort(F.collect_set(F.concat(F.year("o_orderdate"), "o_orderstatus"))).alias("var_sig"))
    empty = F.array()
    return signed.join(ordered, "list_id", "left").join(usage, "list_id", "left").withColumn("codes", F.coalesce("codes", empty.cast(signature.PAIRS))).withColumn("var_sig", F.coalesce("var_sig", empty.cast("array<string>")))


def fuzzy_excluded(spark, sf):
    return similarity.fuzzy_excluded(_lists(spark, sf), 11)


def size_ratio_pairs(spark, sf):
    lists = signature.representatives(_lists(spark, sf).where("n_codes > 0"), "sig")
    return similarity.size_ratio_counts(lists)


def code_similarity(spark, sf):
    """Every fifth list against its neighbours by id: the bare score."""
    own = _lists(spark, sf).select("list_id", "codes")
    other = own.select((F.col("list_id") - 1).alias("list_id"), F.col("codes").alias("codes_b"))
    return own.join(other, "list_id").select("list_id", F.round(similarity.code_similarity("codes", "codes_b"), 6).alias("score"))


def fuzzy_pairs(spark, sf):
    return similarity.fuzzy_pairs(_lists(spark, sf)).select("a", "b", "score", "level")


def fuzzy_pairs_text(spark, sf):
    """Lists whose values are long, spelt otherwise in every other list: no two of those are equal, only near."""
    codes = views.customer_codes(spark, sf).withColumn("value", F.concat(F.substring(F.md5("value"), 1, 12), F.when(F.col("list_id") % 2 == 1, "x").otherwise("")))
    signed = signature.signatures(views.customers(spark, sf), codes)
    ordered = codes.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("value", "label"))).alias("codes"))
    lists = signed.join(ordered, "list_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast(signature.PAIRS)))
    return similarity.fuzzy_pairs(lists).select("a", "b", "score", "level")


def filter_pairs(spark, sf):
    return fuzzy_pairs(spark, sf).where(F.coalesce("score", F.lit(0.0)) >= 0.85).select("a", "b")


def cross_check(spark, sf):
    pairs = fuzzy_pairs(spark, sf).select("a", "b")
    found = similarity.cross_check(pairs, _lists(spark, sf).select("list_id", F.col("var_sig").alias("vars")))
    return found.select("a", "b", F.array_join("shared", ",").alias("shared"), F.array_join("only_a", ",").alias("only_a"), F.array_join("only_b", ",").alias("only_b"), "usage", F.round("ratio", 6).alias("ratio"))


def pair_details(spark, sf):
    """Pairs with the usage of both as shared variables and their values as shared categories."""
    lists = _lists(spark, sf).select("list_id", "name", "n_codes", F.col("var_sig").alias("var_ids"), F.transform("codes", lambda c: c["value"]).alias("cat_ids"))
    found = similarity.pair_details(fuzzy_pairs(spark, sf).select("a", "b"), lists)
    return found.select("a", "b", "a_name", "a_codes", "b_name", "b_codes", F.array_join("shared_vars", ",").alias("shared_vars"), F.array_join("shared_cats", ",").alias("shared_cats"))


def minimal_records(spark, sf):
    """Customers as records under review; codes of urgent orders count as escapes."""
    codes = views.customer_codes(spark, sf).withColumn("pos", F.col("value"))
    found = profile.minimal_records(views.customers(spark, sf).select("list_id", "name", "label"), codes, F.col("value").startswith("1"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.array_join(x, "=")), ";").alias(c)
    return found.select("list_id", "name", "label", "codes_count", joined("codes"), joined("escape_codes"))


def codes_preview(spark, sf):
    codes = views.customer_codes(spark, sf).withColumn("pos", F.col("value"))
    found = profile.codes_preview(views.customers(spark, sf), codes)
    return found.select("list_id", "name", "codes_count", F.coalesce(F.array_join(F.transform("preview", lambda c: c["value"]), ","), F.lit("")).alias("preview"))


def context_link(spark, sf):
    lists = _lists(spark, sf).select("list_id", "var_sig")
    side = lambda i: lists.select(F.col("list_id").alias(i), F.col("var_sig").alias(f"v{i}"))
    return fuzzy_pairs(spark, sf).select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", F.arrays_overlap("va", "vb").alias("linked"))


def compare_codes(spark, sf):
    """Each customer's codes against those of the next id."""
    codes = views.customer_codes(spark, sf).withColumn("pos", F.lit(1))
    a = codes.select(F.col("list_id").alias("pair_id"), "value", "label", "pos")
    b = codes.select((F.col("list_id") - 1).alias("pair_id"), F.upper("value").alias("value"), F.when(F.col("list_id") % 3 == 0, F.upper("label")).otherwise(F.col("label")).alias("label"), "pos")
    return similarity.compare_codes(a, b).select("pair_id", "value", "side", "same")


def _candidates(spark, sf):
    lists = _lists(spark, sf)
    fuzzy = similarity.detected_pairs(lists).select("a", "b", "score")
    return assembly.assemble(signature.exact_groups(lists), fuzzy, signature.business_groups(lists), signature.label_groups(lists), signature.usage_groups(lists))


def candidates(spark, sf):
    return _candidates(spark, sf)


def _links(spark, sf):
    """Exact groups and detected near copies alone: many components."""
    lists = grouping.written(_lists(spark, sf), "lists")
    fuzzy = similarity.detected_pairs(lists).select(F.col("a").alias("master_id"), F.col("b").alias("slave_id"), F.lit("fuzzy").alias("detection_type"), F.least("score", F.lit(0.99)).alias("confidence"))
    exact = signature.exact_groups(lists).select("master_id", "slave_id", F.lit("exact").alias("detection_type"), F.lit(1.0).alias("confidence"))
    return exact.unionByName(fuzzy)


def fuse_pairs(spark, sf):
    return grouping.fuse_pairs(_links(spark, sf)).withColumn("types", F.array_join("types", ","))


def components(spark, sf):
    return grouping.components(_links(spark, sf).select(F.col("master_id").alias("a"), F.col("slave_id").alias("b")))


def _ranked(spark, sf):
    return views.customers(spark, sf).select("list_id", "ord", F.when(F.col("list_id") % 10 == 3, "registry").otherwise("xml").alias("origin"), (F.col("list_id") % 7 == 2).alias("preferred"))


def choose_parent(spark, sf):
    members = components(spark, sf).withColumnRenamed("node", "id").join(_ranked(spark, sf).withColumnRenamed("list_id", "id"), "id")
    return grouping.choose_parent(members)


def links(spark, sf):
    found = grouping.links(grouping.fuse_pairs(_links(spark, sf)))
    return found.select("id", F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["id"], F.array_join(x["types"], "+"))), ";").alias("links"))


def registry(spark, sf):
    found = grouping.registry(_links(spark, sf), _ranked(spark, sf))
    via = F.array_join(F.array_sort(F.col("via").cast("array<string>")), ",").alias("via")
    return found.select("parent_id", "id", F.array_join("detection_types", ",").alias("detection_types"), F.round("confidence", 4).alias("confidence"), via)


def vs_parent(spark, sf):
    """Members alone: how each was detected against its parent."""
    return registry(spark, sf).where("id <> parent_id").select("id", "detection_types", "confidence")


def _swapped(spark, sf):
    """Every group's member with the largest id is chosen as its parent; a third of the members is approved, a third rejected."""
    pairs = grouping.written(_links(spark, sf), "links")
    found = grouping.registry(pairs, _ranked(spark, sf))
    decision = F.when(F.col("id") % 3 == 0, "approve").when(F.col("id") % 3 == 1, "reject").otherwise("pending")
    members = grouping.written(found.where("id <> parent_id").withColumn("decision", decision), "members")
    groups = found.where("id = parent_id").select("parent_id", "ord").join(_ranked(spark, sf).select(F.col("list_id").alias("parent_id"), "origin"), "parent_id")
    swaps = members.groupBy("parent_id").agg(F.max("id").alias("new_parent_id"))
    return review.swapped_registry(members, groups, grouping.links(grouping.fuse_pairs(pairs)), swaps)


def swap_members(spark, sf):
    via = F.array_join(F.array_sort(F.col("via").cast("array<string>")), ",").alias("via")
    return _swapped(spark, sf)[0].select("parent_id", "id", "decision", F.array_join("detection_types", ",").alias("detection_types"), F.round("confidence", 4).alias("confidence"), via)


def swap_groups(spark, sf):
    return _swapped(spark, sf)[1].select("parent_id", "ord", "master_chosen", "previous_parent")


def shared_vars(spark, sf):
    members = components(spark, sf).select(F.col("comp").alias("group_id"), F.col("node").alias("list_id")).join(_lists(spark, sf).select("list_id", F.col("var_sig").alias("vars")), "list_id")
    return grouping.shared_vars(members).select("group_id", F.array_join("shared_vars", ",").alias("shared_vars"))


def uid_prefix(spark, sf):
    """User ids of pages against that of the page before."""
    uid = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[^A-Za-z0-9]+", "-")
    own = read(spark, sf, "pages").select("page_id", uid.alias("uid"))
    other = own.select((F.col("page_id") + 1).alias("page_id"), F.col("uid").alias("before"))
    return own.join(other, "page_id").select("page_id", F.round(text.prefix_ratio(F.col("before"), F.col("uid")), 6).alias("ratio"))


def variable_dups(spark, sf):
    """Parts whose names and types nearly agree."""
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), text.normalize_punct(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("text"))
    return alignment.near_texts(rows)


def text_near_dups(spark, sf):
    """Documents whose whole normalised texts nearly agree."""
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), text.normalize(F.col("text")).alias("text"))
    return neardocs.near_documents(rows).select("a", "b", F.round("ratio", 6).alias("ratio"))


def _aligned(spark, sf):
    variables = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 10 != 0, F.col("p_name")).alias("label"), F.when(F.col("p_size") % 20 != 0, F.col("p_type")).alias("description"))
    concepts = read(spark, sf, "part").groupBy("p_type").agg(F.min("p_partkey").alias("ord"), F.min("p_name").alias("label")).select(F.col("p_type").alias("concept"), "ord", "label", F.col("p_type").alias("definition"))
    return alignment.align_best(variables, concepts)


def align_best(spark, sf):
    return _aligned(spark, sf)


def align_stats(spark, sf):
    return _aligned(spark, sf).agg(F.count("*").alias("analysed"), *(F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "rejected", "no_text")))


BASE = f"""WITH RECURSIVE customer_codes AS ({views.SQL['customer_codes']}),
  s AS (SELECT list_id, {_sig()} AS sig, string_agg(DISTINCT label, ';' ORDER BY label) AS labels, count(*) AS n FROM customer_codes GROUP BY 1),
  vs AS (SELECT c_custkey AS list_id, coalesce(list_sort(list(DISTINCT CAST(year(o_orderdate) AS VARCHAR) || o_orderstatus) FILTER (o_custkey IS NOT NULL)), []) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
  a AS (SELECT c_custkey AS list_id, coalesce(sig, '') AS sig, coalesce(labels, '') AS labels, coalesce(n, 0) AS n FROM customer LEFT JOIN s ON list_id = c_custkey),
  r AS (SELECT min(list_id) AS list_id, any_value(n) AS n FROM a WHERE n > 0 GROUP BY sig),
  k AS (SELECT r.list_id, n, value FROM r JOIN customer_codes USING (list_id)),
  f AS (SELECT x.list_id AS a, y.list_id AS b, round(count(*) / greatest(any_value(x.n), any_value(y.n)), 4) AS score FROM k x JOIN k y ON x.value = y.value AND x.list_id < y.list_id GROUP BY 1, 2
    HAVING count(*) / greatest(any_value(x.n), any_value(y.n)) >= 0.8),
  e AS (SELECT master_id, list_id AS slave_id FROM (SELECT list_id, first_value(list_id) OVER (PARTITION BY sig ORDER BY list_id) AS master_id FROM a) WHERE master_id <> list_id)"""
LINKS = BASE + """, c AS (SELECT master_id, slave_id, 'exact' AS detection_type, CAST(1.0 AS DOUBLE) AS confidence FROM e UNION ALL SELECT a, b, 'fuzzy', least(score, 0.99) FROM f WHERE score >= 0.9),
  p AS (SELECT least(master_id, slave_id) AS a, greatest(master_id, slave_id) AS b, string_agg(DISTINCT detection_type, ',' ORDER BY detection_type) AS types, max(confidence) AS confidence FROM c GROUP BY 1, 2),
  w AS (SELECT a AS id, b AS other, types, confidence FROM p UNION ALL SELECT b, a, types, confidence FROM p),
  reach AS (SELECT DISTINCT id, id AS other FROM w UNION SELECT reach.id, w.other FROM reach JOIN w ON reach.other = w.id),
  comp AS (SELECT id, min(other) AS comp FROM reach GROUP BY 1),
  rk AS (SELECT c_custkey AS id, c_custkey % 10 = 3 AS reg, c_custkey % 7 = 2 AS pref, coalesce(comp, c_custkey) AS comp FROM customer LEFT JOIN comp ON id = c_custkey),
  par AS (SELECT comp, first(id ORDER BY CASE WHEN reg THEN 0 ELSE 1 END, CASE WHEN pref THEN 0 ELSE 1 END, id) AS parent_id FROM rk GROUP BY 1)"""

ORACLES = {
    "fuzzy_excluded": BASE + " SELECT list_id, n AS n_codes FROM a WHERE n > 11",
    "code_similarity": BASE + """ SELECT x.list_id, round(CASE WHEN x.n = 0 AND y.n = 0 THEN 1.0 WHEN x.n = 0 OR y.n = 0 THEN 0.0 ELSE
        (SELECT count(*) FROM customer_codes p JOIN customer_codes q ON p.value = q.value WHERE p.list_id = x.list_id AND q.list_id = y.list_id) / greatest(x.n, y.n) END, 6) AS score FROM a x JOIN a y ON y.list_id = x.list_id + 1""",
    "fuzzy_pairs": BASE + " SELECT a, b, score, CASE WHEN score >= 0.9 THEN 'detected' ELSE 'inspect' END AS level FROM f",
    "fuzzy_pairs_text": BASE + """, r2 AS (SELECT min(list_id) AS list_id, any_value(n) AS n FROM a WHERE n > 0 GROUP BY sig, list_id % 2), k2 AS (SELECT r2.list_id, n, value FROM r2 JOIN customer_codes USING (list_id)),
        f2 AS (SELECT x.list_id AS a, y.list_id AS b, count(*) / greatest(any_value(x.n), any_value(y.n)) AS score FROM k2 x JOIN k2 y ON x.value = y.value AND x.list_id < y.list_id GROUP BY 1, 2)
        SELECT a, b, round(score, 4) AS score, CASE WHEN round(score, 4) >= 0.9 THEN 'detected' ELSE 'inspect' END AS level FROM f2 WHERE score >= 0.8""",
    "filter_pairs": BASE + " SELECT a, b FROM f WHERE score >= 0.85",
    "cross_check": BASE + """ SELECT f.a, f.b, array_to_string(list_sort(list_intersect(x.v, y.v)), ',') AS shared, array_to_string(list_sort(list_filter(x.v, lambda z: NOT list_contains(y.v, z))), ',') AS only_a,
        array_to_string(list_sort(list_filter(y.v, lambda z: NOT list_contains(x.v, z))), ',') AS only_b,
        CASE WHEN x.v = y.v AND len(x.v) > 0 THEN 'same' WHEN len(list_intersect(x.v, y.v)) > 0 THEN 'partial' ELSE 'disjoint' END AS usage,
        round(CASE WHEN len(x.v) + len(y.v) = 0 THEN 0 ELSE len(list_intersect(x.v, y.v)) / len(list_distinct(list_concat(x.v, y.v))) END, 6) AS ratio FROM f JOIN vs x ON x.list_id = f.a JOIN vs y ON y.list_id = f.b""",
    "pair_details": BASE + """ SELECT f.a, f.b, substr(p.c_mktsegment, 1, 2) AS a_name, x.n AS a_codes, substr(q.c_mktsegment, 1, 2) AS b_name, y.n AS b_codes, array_to_string(list_sort(list_intersect(vx.v, vy.v)), ',') AS shared_vars,
        (SELECT coalesce(string_agg(c.value, ',' ORDER BY c.value), '') FROM customer_codes c JOIN customer_codes d USING (value) WHERE c.list_id = f.a AND d.list_id = f.b) AS shared_cats
        FROM f JOIN customer p ON p.c_custkey = f.a JOIN customer q ON q.c_custkey = f.b JOIN a x ON x.list_id = f.a JOIN a y ON y.list_id = f.b JOIN vs vx ON vx.list_id = f.a JOIN vs vy ON vy.list_id = f.b""",
    "minimal_records": BASE + """ SELECT c_custkey AS list_id, substr(c_mktsegment, 1, 2) AS name, c_name AS label, count(value) AS codes_count, coalesce(string_agg(value || '=' || k.label, ';' ORDER BY value), '') AS codes,
        coalesce(string_agg(value || '=' || k.label, ';' ORDER BY value) FILTER (value LIKE '1%'), '') AS escape_codes FROM customer LEFT JOIN customer_codes k ON k.list_id = c_custkey GROUP BY ALL""",
    "codes_preview": BASE + """, t AS (SELECT c_custkey, substr(c_mktsegment, 1, 2) AS name FROM customer ORDER BY c_custkey LIMIT 20), z AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY value) AS nth FROM customer_codes)
        SELECT c_custkey AS list_id, name, count(value) AS codes_count, coalesce(string_agg(value, ',' ORDER BY value) FILTER (nth <= 5), '') AS preview FROM t LEFT JOIN z ON list_id = c_custkey GROUP BY ALL""",
    "context_link": BASE + " SELECT f.a, f.b, len(list_intersect(x.v, y.v)) > 0 AS linked FROM f JOIN vs x ON x.list_id = f.a JOIN vs y ON y.list_id = f.b",
    "compare_codes": BASE + """, x AS (SELECT list_id AS pair_id, value, label FROM customer_codes), y AS (SELECT list_id - 1 AS pair_id, value, CASE WHEN list_id % 3 = 0 THEN upper(label) ELSE label END AS label FROM customer_codes)
        SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, coalesce(x.value, y.value) AS value, CASE WHEN x.value IS NULL THEN 'right' WHEN y.value IS NULL THEN 'left' ELSE 'common' END AS side, coalesce(x.label = y.label, false) AS same
        FROM x FULL JOIN y ON x.pair_id = y.pair_id AND x.value = y.value""",
    "candidates": BASE + """, fz AS (SELECT a, b, score FROM f WHERE score >= 0.9 AND a NOT IN (SELECT slave_id FROM e)),
        u1 AS (SELECT slave_id FROM e UNION SELECT b FROM fz),
        lb AS (SELECT list_id, labels FROM (SELECT *, row_number() OVER (PARTITION BY labels, sig ORDER BY list_id) AS nth FROM a WHERE len(string_split(labels, ';')) >= 2) WHERE nth = 1),
        l AS (SELECT master_id, list_id AS slave_id FROM (SELECT list_id, first_value(list_id) OVER (PARTITION BY labels ORDER BY list_id) AS master_id FROM lb) WHERE master_id <> list_id AND list_id NOT IN (SELECT slave_id FROM u1)),
        u2 AS (SELECT slave_id FROM u1 UNION SELECT slave_id FROM l),
        ug AS (SELECT master_id, list_id AS slave_id FROM (SELECT list_id, first_value(list_id) OVER (PARTITION BY v ORDER BY list_id) AS master_id FROM vs WHERE len(v) > 0) WHERE master_id <> list_id AND list_id NOT IN (SELECT slave_id FROM u2))
        SELECT master_id, slave_id, 'exact' AS detection_type, CAST(1.0 AS DOUBLE) AS confidence FROM e UNION ALL SELECT a, b, 'fuzzy', least(score, 0.99) FROM fz UNION ALL SELECT master_id, slave_id, 'labels', 0.95 FROM l UNION ALL SELECT master_id, slave_id, 'usage', 0.85 FROM ug""",
    "fuse_pairs": LINKS + " SELECT a, b, types, confidence FROM p",
    "components": LINKS + " SELECT id AS node, comp FROM comp",
    "choose_parent": LINKS + " SELECT comp, parent_id FROM par WHERE comp IN (SELECT comp FROM comp)",
    "links": LINKS + " SELECT id, string_agg(CAST(other AS VARCHAR) || ':' || replace(types, ',', '+'), ';' ORDER BY other) AS links FROM w GROUP BY 1",
    "registry": LINKS + """, m AS (SELECT parent_id, id FROM rk JOIN par USING (comp)), d AS (SELECT m.parent_id, m.id, w.types, w.confidence FROM m JOIN w ON w.id = m.id AND w.other = m.parent_id)
        SELECT parent_id, id, '' AS detection_types, CAST(NULL AS DOUBLE) AS confidence, '' AS via FROM m WHERE id = parent_id
        UNION ALL SELECT parent_id, id, types, round(confidence, 4), '' FROM d
        UNION ALL SELECT m.parent_id, m.id, string_agg(DISTINCT t, ',' ORDER BY t), round(max(w.confidence), 4), string_agg(DISTINCT CAST(w.other AS VARCHAR), ',' ORDER BY CAST(w.other AS VARCHAR)) FROM m JOIN w ON w.id = m.id, unnest(string_split(w.types, ',')) AS x(t)
          WHERE m.id <> m.parent_id AND m.id NOT IN (SELECT id FROM d) GROUP BY 1, 2""",
    "swap_members": LINKS + """, m AS (SELECT parent_id, id, CASE id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'pending' END AS decision FROM rk JOIN par USING (comp) WHERE id <> parent_id),
        ok AS (SELECT parent_id, max(id) AS np FROM m WHERE parent_id % 10 <> 3 GROUP BY 1),
        t AS (SELECT coalesce(np, m.parent_id) AS parent_id, id, decision FROM m LEFT JOIN ok USING (parent_id) WHERE np IS NULL OR id <> np UNION ALL SELECT np, parent_id, 'pending' FROM ok),
        d AS (SELECT t.id, w.types, w.confidence FROM t JOIN w ON w.id = t.id AND w.other = t.parent_id)
        SELECT parent_id, t.id, decision, types AS detection_types, round(confidence, 4) AS confidence, '' AS via FROM t JOIN d USING (id)
        UNION ALL SELECT t.parent_id, t.id, decision, string_agg(DISTINCT z, ',' ORDER BY z), round(max(w.confidence), 4), string_agg(DISTINCT CAST(w.other AS VARCHAR), ',' ORDER BY CAST(w.other AS VARCHAR))
          FROM t JOIN w ON w.id = t.id, unnest(string_split(w.types, ',')) AS x(z) WHERE t.id NOT IN (SELECT id FROM d) GROUP BY 1, 2, 3""",
    "swap_groups": LINKS + """, g AS (SELECT parent_id, max(id) FILTER (id <> parent_id) AS np FROM rk JOIN par USING (comp) GROUP BY 1), sg AS (SELECT parent_id, CASE WHEN parent_id % 10 <> 3 THEN np END AS np FROM g)
        SELECT coalesce(np, parent_id) AS parent_id, parent_id AS ord, np IS NOT NULL AS master_chosen, CASE WHEN np IS NOT NULL THEN parent_id END AS previous_parent FROM sg""",
    "size_ratio_pairs": BASE + """, h AS (SELECT n, count(*) AS c FROM r GROUP BY 1) SELECT x.n AS small, y.n AS large, CASE WHEN x.n = y.n THEN x.c * (x.c - 1) // 2 ELSE x.c * y.c END AS n_pairs
        FROM h x JOIN h y ON x.n <= y.n AND x.n >= 0.75 * y.n WHERE x.n < y.n OR x.c > 1""",
    "vs_parent": LINKS + """, m AS (SELECT parent_id, id FROM rk JOIN par USING (comp) WHERE id <> parent_id), d AS (SELECT m.id, w.types, w.confidence FROM m JOIN w ON w.id = m.id AND w.other = m.parent_id)
        SELECT id, types AS detection_types, round(confidence, 4) AS confidence FROM d
        UNION ALL SELECT m.id, string_agg(DISTINCT t, ',' ORDER BY t), round(max(w.confidence), 4) FROM m JOIN w ON w.id = m.id, unnest(string_split(w.types, ',')) AS x(t) WHERE m.id NOT IN (SELECT id FROM d) GROUP BY 1""",
    "shared_vars": LINKS + """, g AS (SELECT comp, count(*) AS n FROM comp GROUP BY 1), q AS (SELECT comp, z, count(*) AS c FROM comp JOIN vs ON list_id = id, unnest(v) AS x(z) GROUP BY 1, 2)
        SELECT g.comp AS group_id, coalesce(string_agg(z, ',' ORDER BY z) FILTER (c = n), '') AS shared_vars FROM g LEFT JOIN q USING (comp) GROUP BY 1""",
    "uid_prefix": """WITH u AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[^A-Za-z0-9]+', '-', 'g'), '-') AS s FROM pages)
        SELECT x.page_id, round((SELECT count(*) FROM range(1, least(len(x.s), len(y.s)) + 1) AS i(i) WHERE x.s[1:i] = y.s[1:i]) / greatest(len(x.s), len(y.s)), 6) AS ratio FROM u x JOIN u y ON y.page_id = x.page_id - 1""",
}

QUERIES = {f.__name__: f for f in (pair_details, minimal_records, codes_preview, fuzzy_excluded, size_ratio_pairs, code_similarity, fuzzy_pairs, fuzzy_pairs_text, swap_members, swap_groups, filter_pairs, cross_check, context_link, compare_codes, candidates, fuse_pairs, components, choose_parent, links, registry, vs_parent, shared_vars, uid_prefix, variable_dups, text_near_dups, align_best, align_stats)}
