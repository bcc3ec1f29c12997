"""Queries of ingest, text, quality, signatures and profiles."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..functions import text
from ..operators import ingest, profile, quality, signature
from . import views
from .views import read, sql

ESCAPE_SQL = "((regexp_matches(value, '^(_[a-z]|/)$') AND label <> '') OR " + " OR ".join(f"starts_with(label, '{p}')" for p in quality.ESCAPE_PHRASES) + ")"
SIG = "array_to_string(list_transform(list_sort(list(DISTINCT {{'v': value, 'l': label}}){where}), lambda x: x.v || '=' || x.l), ';')"


def _sig(where: str = "") -> str:
    return SIG.format(where=where)


def _signed(codes, lists):
    def make(spark, sf):
        return signature.signatures(lists(spark, sf), codes(spark, sf))

    return make


_orders = _signed(views.order_codes, views.orders)
_flags = _signed(views.flag_codes, views.orders)
_parts = _signed(views.part_codes, views.part_lists)


def _usage(spark, sf):
    linked = ingest.link_variables(views.orders(spark, sf), views.order_variables(spark, sf))
    return linked.withColumn("var_sig", signature.usage_signature(F.col("vars")))


def _stars_sql(sig: str, frame: str, order: str = "list_id") -> str:
    return f"""{frame}, g AS (SELECT list_id, {sig} AS sig FROM c GROUP BY list_id),
      m AS (SELECT *, first_value(list_id) OVER (PARTITION BY sig ORDER BY {order}) AS master_id FROM g)
      SELECT master_id, list_id AS slave_id FROM m WHERE master_id <> list_id"""


def latest_by_key(spark, sf):
    rows = views.user_versions(spark, sf).where("version is not null").select(F.col("version").alias("id"), "ord", "list_id", "name")
    return ingest.latest_by_key(rows, "id", "ord")


def latest_version(spark, sf):
    return ingest.latest_version(views.user_versions(spark, sf))


def resolve_labels(spark, sf):
    codes = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") * 2).alias("cat_id"))
    return ingest.resolve_labels(codes, read(spark, sf, "part").select(F.col("p_partkey").alias("cat_id"), F.col("p_name").alias("label")))


def usage_ids(spark, sf):
    linked = ingest.link_variables(views.orders(spark, sf), views.order_variables(spark, sf))
    return linked.select("list_id", F.array_join("var_ids", ",").alias("var_ids"))


def link_variables(spark, sf):
    # Repeated (ord, name) pairs cannot tell ids apart; line numbers are unique in an order.
    linked = ingest.link_variables(views.orders(spark, sf), views.order_variables(spark, sf))
    return linked.select("list_id", F.array_join("vars", ",").alias("vars"))


def inject_registry(spark, sf):
    lists = views.orders(spark, sf)
    registry = lists.where("list_id % 10 = 0")
    replaced = lists.where("list_id % 10 = 1").select("list_id")
    return ingest.inject_registry(lists, registry, replaced)


def subset_closure(spark, sf):
    codes, lists = views.part_codes(spark, sf), views.part_lists(spark, sf)
    variables = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.concat_ws("|", "p_brand", "p_type").alias("cl_id"))
    wanted = lists.where("ord % 3 = 0").select("list_id")
    found = ingest.subset_closure(lists, codes, variables, wanted)
    return (
        found["lists"].select(F.lit("list").alias("kind"), F.col("list_id").alias("id"))
        .unionByName(found["categories"].select(F.lit("category").alias("kind"), F.col("cat_id").cast("string").alias("id")))
        .unionByName(found["variables"].select(F.lit("variable").alias("kind"), F.col("id").cast("string").alias("id")))
    )


def clone_lists(spark, sf):
    return ingest.clone_lists(views.part_codes(spark, sf), "-copy", {"sans objet": "sans objet ici"}).select("list_id", "pos", "value", "label")


def pick_unique(spark, sf):
    lists = _signed(views.customer_codes, views.customers)(spark, sf)
    pairs = signature.exact_groups(lists)
    implicated = pairs.select(F.col("master_id").alias("list_id")).unionByName(pairs.select(F.col("slave_id").alias("list_id"))).distinct()
    return ingest.pick_unique(lists, implicated, 20).select("list_id", "n_codes")


def current_definition(spark, sf):
    e = read(spark, sf, "events")
    definitions = e.select(
        F.col("user_id").alias("concept"), F.col("event_id").alias("ord"), F.get_json_object("props", "$.k").cast("long").alias("version"),
        F.when(F.col("event_type") == "purchase", F.col("ts")).alias("valid_until"), F.when(F.col("event_id") % 4 == 0, "en").otherwise("fr").alias("lang"),
    )
    concepts = read(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("concept"), F.col("c_name").alias("label"))
    return ingest.current_definition(definitions, concepts).select("concept", "ord", "version", "label")


def ddi_version(spark, sf):
    source = F.concat(F.lit('<r xmlns:d="ddi:'), F.when(F.col("p_size") % 3 == 0, "code:6_0").when(F.col("p_size") % 3 == 1, F.concat(F.lit("reusable:3_"), F.col("p_size") % 4)).otherwise("other"), F.lit('"/>'))
    return read(spark, sf, "part").select("p_partkey", text.schema_version(source).alias("version"))


def strip_prefix(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.strip_prefix(F.col("url")).alias("tag"))


def strip_bad_xmlns(spark, sf):
    html = F.replace("html", F.lit("<html lang="), F.lit('<html xmlns:=""x"" lang='))
    return read(spark, sf, "pages").select("page_id", F.md5(text.strip_bad_namespaces(html)).alias("repaired"))


def normalize_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.normalize(F.col("text")).alias("norm"))


def normalize_punct(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.normalize_punct(F.col("url")).alias("norm"))


def concat_text(spark, sf):
    codes = views.customer_codes(spark, sf).groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("value", "label"))).alias("codes"))
    rows = views.customers(spark, sf).join(codes, "list_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast(signature.PAIRS)))
    return rows.select("list_id", text.concat_text(F.col("name"), F.col("label"), F.lit(""), F.col("codes")).alias("text"))


def concat_variable(spark, sf):
    return read(spark, sf, "part").select("p_partkey", text.normalize(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("text"))


def embed_text(spark, sf):
    cut, truncated = text.embed_text(F.coalesce("text", F.lit("")))
    return read(spark, sf, "documents").select("doc_id", F.md5(cut).alias("cut"), truncated.alias("truncated"))


def escape_codes(spark, sf):
    return views.part_codes(spark, sf).select("list_id", "pos", quality.is_escape(F.col("value"), F.col("label")).alias("is_escape"))


def split_codes(spark, sf):
    return quality.split_codes(views.part_codes(spark, sf))


def quality_flags(spark, sf):
    found = quality.quality_flags(views.part_lists(spark, sf), views.part_codes(spark, sf))
    return found.select("list_id", F.array_join("quality_flags", ",").alias("quality_flags"))


def name_key(spark, sf):
    return read(spark, sf, "part").select("p_partkey", text.name_key(F.when(F.col("p_size") % 5 == 0, " _- ").otherwise(F.col("p_type")), F.concat_ws("-", "p_brand", "p_name")).alias("key"))


def pair_key(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", text.pair_key(F.col("o_orderkey"), F.col("o_custkey")).alias("key"))


def token_jaccard(spark, sf):
    d = read(spark, sf, "documents")
    norm = text.normalize_punct(F.col("text"))
    first = F.substring_index("text", "\n", 1)
    return d.select("doc_id", F.round(text.token_jaccard(text.normalize_punct(first), norm), 9).alias("score"))


def name_similarity(spark, sf):
    p = read(spark, sf, "part")
    score, trusted = text.name_similarity(F.col("p_name"), F.col("p_type"))
    return p.select("p_partkey", score.alias("score"), trusted.alias("trusted"))


def seq_ratio(spark, sf):
    return read(spark, sf, "part").select("p_partkey", text.seq_ratio("p_name", "p_type").alias("ratio"))


def signatures(spark, sf):
    return _orders(spark, sf).select("list_id", "n_codes", signature.shown(F.col("sig")).alias("sig"))


def signatures_business(spark, sf):
    found = _parts(spark, sf)
    return found.select("list_id", signature.shown(F.col("sig_business")).alias("sig_business"), F.array_join("sig_labels", ";").alias("sig_labels"))


def signatures_placeholder(spark, sf):
    lists, codes = views.part_lists(spark, sf), views.part_codes(spark, sf)
    flagged = lists.join(quality.quality_flags(lists, codes), "list_id").withColumn("name_key", text.name_key(F.col("list_id")))
    found = signature.signatures(flagged, codes)
    return found.select("list_id", F.md5(signature.shown(F.col("sig"))).alias("sig"), F.size("sig_business").alias("n_business"), F.size("sig_labels").alias("n_labels"))


def exact_groups(spark, sf):
    return signature.exact_groups(_orders(spark, sf))


def exact_groups_skewed(spark, sf):
    return signature.exact_groups(_flags(spark, sf))


def business_groups(spark, sf):
    return signature.business_groups(_flag_parts(spark, sf))


def label_groups(spark, sf):
    return signature.label_groups(_flag_parts(spark, sf))


def _flag_codes_escaped(spark, sf):
    return views.flag_codes(spark, sf).withColumn("label", F.when(F.col("value") == "r", "refus").otherwise(F.col("label"))).withColumn("value", F.concat("value", F.col("pos") % 2))


def _flag_parts(spark, sf):
    return signature.signatures(views.orders(spark, sf), _flag_codes_escaped(spark, sf))


FLAG_ESCAPED = "SELECT list_id, pos, value || CAST(pos % 2 AS VARCHAR) AS value, CASE WHEN value = 'r' THEN 'refus' ELSE label END AS label FROM flag_codes"


def _group_sql(by: str, then: str, least: str) -> str:
    return sql("flag_codes", then=f"""SELECT 1""").removesuffix("SELECT 1") + f""", c AS ({FLAG_ESCAPED}),
      s AS (SELECT list_id, {_sig()} AS full_,
        coalesce(string_agg(DISTINCT value || '=' || label, ';' ORDER BY value || '=' || label) FILTER (NOT {ESCAPE_SQL}), '') AS business,
        coalesce(string_agg(DISTINCT label, ';' ORDER BY label) FILTER (NOT {ESCAPE_SQL}), '') AS labels,
        count(DISTINCT value || '=' || label) FILTER (NOT {ESCAPE_SQL}) AS nb, count(DISTINCT label) FILTER (NOT {ESCAPE_SQL}) AS nl FROM c GROUP BY list_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY {by}, {then} ORDER BY list_id) AS nth FROM s WHERE {least}),
      m AS (SELECT *, first_value(list_id) OVER (PARTITION BY {by} ORDER BY list_id) AS master_id FROM r WHERE nth = 1)
      SELECT master_id, list_id AS slave_id FROM m WHERE master_id <> list_id"""


def usage_signature(spark, sf):
    return _usage(spark, sf).select("list_id", F.array_join("var_sig", ",").alias("var_sig"))


def usage_groups(spark, sf):
    return signature.usage_groups(_usage(spark, sf))


def representatives(spark, sf):
    return signature.representatives(_orders(spark, sf), "sig").select("list_id")


def var_records(spark, sf):
    linked = ingest.link_variables(views.orders(spark, sf), views.order_variables(spark, sf)).where(F.size("vars") > 0)
    return linked.select("list_id", text.normalize(F.concat_ws(" ", F.concat(F.lit("Order "), F.col("list_id")), F.array_join("vars", " "))).alias("text"))


def size_profile(spark, sf):
    found = profile.size_profile(_orders(spark, sf))
    return found.select(*(F.round(F.col(c).cast("double"), 6).alias(c) for c in found.columns))


def size_histogram(spark, sf):
    return profile.size_histogram(_parts(spark, sf))


def type_counts(spark, sf):
    return profile.type_counts(read(spark, sf, "events"), "event_type")


def json_profile(spark, sf):
    return profile.json_profile(read(spark, sf, "events"), F.col("props"))


def topk_lists(spark, sf):
    return profile.top_lists(_parts(spark, sf), "n_codes").select("list_id", "n_codes")


NORM = "lower(trim(regexp_replace(nfc_normalize(coalesce({0}, '')), '\\s+', ' ', 'g')))"
PUNCT = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
BUSINESS_STRUCTS = f"list(DISTINCT {{'v': value, 'l': label}}) FILTER (NOT {ESCAPE_SQL})"

ORACLES = {
    "latest_by_key": sql("user_versions", then="""SELECT id, ord, list_id, name FROM (SELECT version AS id, ord, list_id, name, row_number() OVER (PARTITION BY version ORDER BY ord DESC) AS n FROM user_versions WHERE version <> '') WHERE n = 1"""),
    "latest_version": sql("user_versions", then="""SELECT list_id, first_ord AS ord, version, name, n_versions FROM (
        SELECT *, min(ord) OVER (PARTITION BY list_id) AS first_ord, count(*) OVER (PARTITION BY list_id) AS n_versions,
          row_number() OVER (PARTITION BY list_id ORDER BY CASE WHEN coalesce(version, '') = '' THEN 0 ELSE 1 END DESC, TRY_CAST(version AS HUGEINT) DESC NULLS LAST, ord) AS n FROM user_versions) WHERE n = 1"""),
    "resolve_labels": "SELECT l_orderkey AS list_id, l_linenumber AS pos, l_partkey * 2 AS cat_id, coalesce(p_name, '') AS label FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2",
    "usage_ids": sql("order_variables", then="SELECT cl_id AS list_id, array_to_string(list_sort(list(DISTINCT CAST(id AS VARCHAR))), ',') AS var_ids FROM order_variables GROUP BY 1"),
    "link_variables": sql("order_variables", then="SELECT cl_id AS list_id, string_agg(name, ',' ORDER BY ord, name) AS vars FROM order_variables GROUP BY 1"),
    "inject_registry": sql("orders_", then="""SELECT list_id, 0 AS section, ord, 'registry' AS origin FROM orders_ WHERE list_id % 10 = 0 UNION ALL SELECT list_id, 1, ord, 'xml' FROM orders_ WHERE list_id % 10 > 1"""),
    "subset_closure": sql("part_codes", then="""SELECT 1""").removesuffix("SELECT 1") + """, w AS (SELECT list_id FROM part_codes GROUP BY 1 HAVING min(pos) % 3 = 0)
        SELECT 'list' AS kind, list_id AS id FROM w UNION ALL SELECT 'category', CAST(cat_id AS VARCHAR) FROM (SELECT DISTINCT cat_id FROM part_codes SEMI JOIN w USING (list_id))
        UNION ALL SELECT 'variable', CAST(l_orderkey AS VARCHAR) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand || '|' || p_type IN (SELECT list_id FROM w)""",
    "clone_lists": sql("part_codes", then="SELECT list_id || '-copy' AS list_id, pos, value, CASE WHEN label = 'sans objet' THEN 'sans objet ici' ELSE label END AS label FROM part_codes"),
    "pick_unique": sql("customer_codes", "customers", then=f"""SELECT 1""").removesuffix("SELECT 1") + f""", s AS (SELECT list_id, {_sig()} AS sig, count(*) AS n_codes FROM customer_codes GROUP BY list_id)
        SELECT list_id, n_codes FROM (SELECT *, count(*) OVER (PARTITION BY sig) AS c FROM s) WHERE c = 1 AND n_codes BETWEEN 3 AND 12 ORDER BY list_id LIMIT 20""",
    "current_definition": """WITH d AS (SELECT user_id AS concept, event_id AS ord, CAST(json_extract_string(props, '$.k') AS BIGINT) AS version FROM events WHERE event_type <> 'purchase' AND event_id % 4 <> 0)
        SELECT concept, ord, version, coalesce(c_name, '') AS label FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY version DESC NULLS LAST, ord) AS n FROM d) LEFT JOIN customer ON c_custkey * 2 = concept WHERE n = 1""",
    "ddi_version": "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '6.0' WHEN p_size % 3 = 1 THEN '3.' || CAST(p_size % 4 AS VARCHAR) END AS version FROM part",
    "strip_prefix": "SELECT page_id, CASE WHEN strpos(url, ':') > 0 THEN substr(url, strpos(url, ':') + 1) ELSE url END AS tag FROM pages",
    "strip_bad_xmlns": "SELECT page_id, md5(html) AS repaired FROM pages",
    "normalize_text": f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents",
    "normalize_punct": f"SELECT page_id, {PUNCT.format('url')} AS norm FROM pages",
    "concat_text": sql("customer_codes", "customers", then=f"""SELECT c.list_id, {NORM.format("any_value(c.name) || ' ' || any_value(c.label) || ' ' || coalesce(string_agg(k.value || ': ' || k.label, ' ' ORDER BY k.value, k.label), '')")} AS text
        FROM customers c LEFT JOIN customer_codes k USING (list_id) GROUP BY c.list_id"""),
    "concat_variable": f"SELECT p_partkey, {NORM.format("p_name || ' ' || p_brand || ' ' || p_type")} AS text FROM part",
    "embed_text": "SELECT doc_id, md5(substr(coalesce(text, ''), 1, 8000)) AS cut, length(coalesce(text, '')) > 8000 AS truncated FROM documents",
    "escape_codes": sql("part_codes", then=f"SELECT list_id, pos, {ESCAPE_SQL} AS is_escape FROM part_codes"),
    "split_codes": sql("part_codes", then=f"SELECT list_id, count(*) FILTER (NOT {ESCAPE_SQL}) AS n_business, count(*) FILTER ({ESCAPE_SQL}) AS n_escape FROM part_codes GROUP BY 1"),
    "quality_flags": sql("part_codes", then=f"""SELECT list_id, concat_ws(',', CASE WHEN bool_or(starts_with(label, 'voir ') AND NOT {ESCAPE_SQL}) THEN 'placeholder' END, CASE WHEN count(*) FILTER (NOT {ESCAPE_SQL}) = 1 THEN 'single_code' END) AS quality_flags FROM part_codes GROUP BY 1"""),
    "name_key": "SELECT p_partkey, lower(trim(regexp_replace(CASE WHEN p_size % 5 = 0 THEN p_brand || '-' || p_name ELSE p_type END, '[\\s_-]+', ' ', 'g'))) AS key FROM part",
    "pair_key": "SELECT o_orderkey, least(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)) || '|' || greatest(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)) AS key FROM orders",
    "token_jaccard": f"""WITH n AS (SELECT doc_id, string_split({PUNCT.format("split_part(text, chr(10), 1)")}, ' ') AS a, string_split({PUNCT.format('text')}, ' ') AS b FROM documents)
        SELECT doc_id, CASE WHEN a = [''] OR b = [''] THEN 0.0 ELSE round(len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))), 9) END AS score FROM n""",
    "signatures": sql("order_codes", then=f"SELECT list_id, count(*) AS n_codes, {_sig()} AS sig FROM order_codes GROUP BY 1"),
    "signatures_business": sql("part_codes", then=f"""SELECT list_id, coalesce(array_to_string(list_transform(list_sort({BUSINESS_STRUCTS}), lambda x: x.v || '=' || x.l), ';'), '') AS sig_business,
        coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (NOT {ESCAPE_SQL})), ';'), '') AS sig_labels FROM part_codes GROUP BY 1"""),
    "signatures_placeholder": sql("part_codes", then=f"""SELECT list_id, md5(CASE WHEN held THEN '__placeholder__=' || lower(trim(regexp_replace(list_id, '[\\s_-]+', ' ', 'g'))) ELSE sig END) AS sig,
        CASE WHEN held THEN 0 ELSE nb END AS n_business, CASE WHEN held THEN 0 ELSE nl END AS n_labels FROM (
        SELECT list_id, bool_or(starts_with(label, 'voir ') AND NOT {ESCAPE_SQL}) AS held, {_sig()} AS sig, count(DISTINCT value || '=' || label) FILTER (NOT {ESCAPE_SQL}) AS nb, count(DISTINCT label) FILTER (NOT {ESCAPE_SQL}) AS nl FROM part_codes GROUP BY 1)"""),
    "exact_groups": _stars_sql(_sig(), f"WITH c AS ({views.SQL['order_codes']})"),
    "exact_groups_skewed": _stars_sql(_sig(), f"WITH c AS ({views.SQL['flag_codes']})"),
    "business_groups": _group_sql("business", "full_", "nb >= 2"),
    "label_groups": _group_sql("labels", "business", "nl >= 2"),
    "usage_signature": sql("order_variables", then="SELECT cl_id AS list_id, string_agg(DISTINCT name, ',' ORDER BY name) AS var_sig FROM order_variables GROUP BY 1"),
    "usage_groups": _stars_sql("string_agg(DISTINCT name, ',' ORDER BY name)", f"WITH c AS (SELECT cl_id AS list_id, name FROM ({views.SQL['order_variables']}))"),
    "representatives": sql("order_codes", then=f"SELECT min(list_id) AS list_id FROM (SELECT list_id, {_sig()} AS sig FROM order_codes GROUP BY 1) GROUP BY sig"),
    "var_records": sql("order_variables", then=f"""SELECT cl_id AS list_id, {NORM.format("'Order ' || CAST(cl_id AS VARCHAR) || ' ' || string_agg(name, ' ' ORDER BY ord, name)")} AS text FROM order_variables GROUP BY cl_id"""),
    "size_profile": sql("order_codes", then="""SELECT CAST(count(*) AS DOUBLE) AS n_lists, CAST(sum(n) AS DOUBLE) AS n_codes, CAST(count(DISTINCT n) AS DOUBLE) AS n_sizes, CAST(min(n) AS DOUBLE) AS least, CAST(max(n) AS DOUBLE) AS most, round(avg(n), 6) AS mean,
        round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.95), 6) AS p95 FROM (SELECT list_id, count(*) AS n FROM order_codes GROUP BY 1)"""),
    "size_histogram": sql("part_codes", then="SELECT 1").removesuffix("SELECT 1") + ", s AS (SELECT count(*) AS k FROM part_codes GROUP BY list_id), b(bucket, lo, hi) AS (VALUES " + ", ".join(f"('{b}', {lo}, {hi or 10**18})" for b, lo, hi in profile.BUCKETS) + ") SELECT bucket, count(k) AS n FROM b LEFT JOIN s ON k BETWEEN lo AND hi GROUP BY 1",
    "type_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "json_profile": "SELECT 'k' AS key, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS n_values, sum(length(json_extract_string(props, '$.k'))) AS chars FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "topk_lists": sql("part_codes", then="SELECT list_id, count(*) AS n_codes FROM part_codes GROUP BY 1 ORDER BY 2 DESC, min(pos) LIMIT 10"),
}

QUERIES = {f.__name__: f for f in (
    latest_by_key, latest_version, resolve_labels, usage_ids, link_variables, inject_registry, subset_closure, clone_lists, pick_unique, current_definition, ddi_version, strip_prefix, strip_bad_xmlns,
    normalize_text, normalize_punct, concat_text, concat_variable, embed_text, escape_codes, split_codes, quality_flags, name_key, pair_key, token_jaccard, name_similarity, seq_ratio,
    signatures, signatures_business, signatures_placeholder, exact_groups, exact_groups_skewed, business_groups, label_groups, usage_signature, usage_groups, representatives, var_records,
    size_profile, size_histogram, type_counts, json_profile, topk_lists,
)}
