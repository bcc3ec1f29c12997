"""Registries, decisions and concepts kept as JSON documents."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

ENTRY = "struct<id:string,name:string,label:string,codes:array<array<string>>,vars:array<string>,replaces:array<string>,merged_duplicates:array<string>>"
CONCEPT = "map<string,map<string,array<struct<value:string,lang:string,type:string>>>>"


def _document(spark: SparkSession, path: str, missing_ok: bool) -> DataFrame:
    """``value``: the whole text of each file; none if the path is missing and may be."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if missing_ok and not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path, wholetext=True)


def read_cleaned(spark: SparkSession, path: str, missing_ok: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(lists, replaces)`` of a cleaned registry, first or second version: an object with ``codelists`` by id.

    Lists: ``list_id, name, label, codes, vars, origin``; an entry's own id counts
    before its key, a code of one text has an empty label, one of none is left out.
    Replaced ids: ``parent_id, id``, given as objects with an id or as plain texts.
    A missing file is an error unless ``missing_ok``; a document that can't be read
    has no entries.
    """
    text = _document(spark, path, missing_ok)
    entries = text.select(F.from_json("value", f"struct<codelists:map<string,{ENTRY}>>").alias("d")).select(F.explode("d.codelists").alias("key", "e"))
    entries = entries.select(F.coalesce("e.id", "key").alias("list_id"), "e")
    empty = F.lit("")
    pairs = F.filter(F.coalesce("e.codes", F.array().cast("array<array<string>>")), lambda c: F.size(c) > 0)
    codes = F.transform(pairs, lambda c: F.struct(F.get(c, 0).alias("value"), F.coalesce(F.get(c, 1), empty).alias("label")))
    lists = entries.select("list_id", F.coalesce("e.name", empty).alias("name"), F.coalesce("e.label", empty).alias("label"), codes.alias("codes"), F.coalesce("e.vars", F.array().cast("array<string>")).alias("vars"), F.lit("registry").alias("origin"))
    held = F.when(F.size("e.replaces") > 0, F.col("e.replaces")).otherwise(F.col("e.merged_duplicates"))
    # Elements are read as texts; an object's text is its JSON.
    ids = F.transform(held, lambda r: F.when(F.startswith(r, F.lit("{")), F.get_json_object(r, "$.id")).otherwise(r))
    return lists, entries.select(F.col("list_id").alias("parent_id"), F.explode(ids).alias("id")).where("id <> ''")


def cleaned_json(lists: DataFrame, replaces: DataFrame) -> DataFrame:
    """``list_id, entry``: each entry of a cleaned registry as JSON, in the form that ``read_cleaned`` takes.

    ``lists (list_id, name, label, codes, vars)``, ``replaces (parent_id, id)`` and, if
    it has one, ``name``.
    """
    named = F.col("name") if "name" in replaces.columns else F.lit("")
    held = replaces.groupBy(F.col("parent_id").alias("list_id")).agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce(named, F.lit("")).alias("name")))).alias("replaces"))
    whole = lists.join(held, "list_id", "left")
    pairs = F.transform("codes", lambda c: F.array(c["value"], c["label"]))
    fields = [F.col("list_id").alias("id"), "name", "label", pairs.alias("codes"), F.size("codes").alias("codes_count"), "vars", F.coalesce("replaces", F.array().cast("array<struct<id:string,name:string>>")).alias("replaces")]
    return whole.select("list_id", F.to_json(F.struct(*fields)).alias("entry"))


def decisions_json(pairs: DataFrame, dismissed: DataFrame, masters: DataFrame) -> DataFrame:
    """``section, key, entry`` of a decision store, in the form that ``read_decisions`` takes."""
    own = pairs.select(F.lit("pairs").alias("section"), "key", F.to_json(F.struct("decision", "updated_at")).alias("entry"))
    for section, marks in (("dismissed", dismissed), ("masters", masters)):
        own = own.unionByName(marks.select(F.lit(section).alias("section"), F.col("id").alias("key"), F.to_json(F.struct("updated_at")).alias("entry")))
    return own


def write_document(entries: DataFrame, path: str, sections: list[str]) -> None:
    """One JSON object with ``sections`` of entries ``(section, key, entry)``, as text in the folder ``path``.

    A document is read whole, so it is written as one file; its entries come in
    order of section and key, a line each. Sections may be empty.
    """
    spark = entries.sparkSession
    place = F.element_at(F.create_map(*(x for i, name in enumerate(sections) for x in (F.lit(name), F.lit(i)))), F.col("section"))
    lines = entries.select(place.alias("at"), F.lit(1).alias("kind"), "key", F.concat(F.to_json(F.array("key")), F.lit(": "), "entry").alias("line"))
    # The key as JSON, without the brackets of its array.
    lines = lines.withColumn("line", F.concat(F.regexp_replace(F.element_at(F.split("line", r"\]: ", 2), 1), r"^\[", ""), F.lit(": "), F.element_at(F.split("line", r"\]: ", 2), 2)))
    comma = F.when(F.lead("key").over(Window.partitionBy("at").orderBy("key")).isNotNull(), ",").otherwise("")
    lines = lines.withColumn("line", F.concat("line", comma))
    edges = [(i, 0, "", ("{" if i == 0 else "") + f'"{name}": {{') for i, name in enumerate(sections)] + [(i, 2, "", "}" + ("}" if i == len(sections) - 1 else ",")) for i in range(len(sections))]
    whole = lines.unionByName(spark.createDataFrame(edges, "at int, kind int, key string, line string"))
    whole.orderBy("at", "kind", "key").coalesce(1).select("line").write.text(path)


def read_decisions(spark: SparkSession, path: str, missing_ok: bool = True) -> dict[str, DataFrame]:
    """``pairs (key, decision, updated_at)``, ``dismissed`` and ``masters (id, updated_at)``."""
    text = _document(spark, path, missing_ok)
    shape = "struct<pairs:map<string,struct<decision:string,updated_at:string>>,dismissed:map<string,struct<updated_at:string>>,masters:map<string,struct<updated_at:string>>>"
    whole = text.select(F.from_json("value", shape).alias("d"))
    out = {"pairs": whole.select(F.explode("d.pairs").alias("key", "v")).select("key", "v.decision", "v.updated_at")}
    for name in ("dismissed", "masters"):
        out[name] = whole.select(F.explode(f"d.{name}").alias("id", "v")).select("id", "v.updated_at")
    return out


def read_concepts(spark: SparkSession, path: str, lang: str = "fr") -> DataFrame:
    """``concept, label, definition`` from RDF as JSON: the preferred label, and of the definitions still valid the one of the highest version."""
    triples = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", CONCEPT)).alias("uri", "p"))
    ending = lambda name: F.map_filter("p", lambda k, _: F.endswith(k, F.lit(name)))
    values = lambda name: F.flatten(F.map_values(ending(name)))
    local = lambda name: F.get(F.filter(values(name), lambda v: v["lang"] == lang), 0)["value"]
    labels = triples.select(F.col("uri").alias("concept"), local("prefLabel").alias("label")).where("label is not null")
    definitions = triples.where(F.col("uri").contains("/definition")).select(
        F.regexp_extract("uri", "^(.*?)/definition", 1).alias("concept"), F.coalesce(F.get(values("version"), 0)["value"].try_cast("long"), F.lit(0).cast("long")).alias("version"), local("content").alias("definition"), (F.size(values("validUntil")) > 0).alias("expired"), "uri"
    ).where("not expired and definition is not null")
    best = definitions.groupBy("concept").agg(F.max_by("definition", F.struct("version", "uri")).alias("definition"))
    return best.join(labels, "concept", "left").select("concept", F.coalesce("label", F.lit("")).alias("label"), "definition")
