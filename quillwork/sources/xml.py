"""Code lists, categories and variables out of XML fragments.

Files are read as text cut where fragments end, so large files are split over tasks;
each fragment is parsed by itself, the prefixes of its names
dropped. ``ord`` is document order: file, block, line. Fragments that can't be parsed
are rows of their own, not errors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from ..operators.ingest import latest_by_key, latest_version, link_variables, resolve_labels

#: Kind of the row that stands for a fragment that can't be parsed; its description is the error.
REJECT = "reject"
KINDS = ("CodeList", "Category", "Variable", "RepresentedVariable")
OBJECTS = """ord long, part int, kind string, id string, name string, label string, description string, user_id string, agency string, version string,
  based_on array<string>, cl_id string, usage_id string, codes array<struct<pos:int,value:string,cat_id:string>>"""


_PREFIX = r"(?:[\w.-]+:)?"
_OBJECT = rf"<{_PREFIX}(?:{'|'.join(KINDS)})[\s>]"


def fragments(spark: SparkSession, path: str, tag: str = "Fragment") -> DataFrame:
    """``ord, source``: one row for each fragment.

    Files may use any prefix (``ddi:Fragment``) or none, also side by side: rows end
    where a tag of that name does, and those that end with a closing one are fragments.
    ``tag`` is its local name; a prefix before it is not looked at. A file with objects
    but without any fragment is an error, and so is a missing path; what follows the
    last closing tag and holds objects is a torn fragment, which can't be parsed. Paths
    are Hadoop's (local, object store, globs).
    """
    tag = tag.rsplit(":", 1)[-1]
    lines = spark.read.option("lineSep", f"{tag}>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    closed = F.col("value").rlike(f"</{_PREFIX}$")
    # A file that is cut nowhere is one row, which begins with its head or root and not with an object, as what is torn does.
    whole = (F.col("start") == 0) & F.col("value").rlike(rf"^\uFEFF?\s*<(?!{_OBJECT[1:]})[?!\w]") & ~F.col("value").rlike(f"<{_PREFIX}{tag}[\\s>]")
    lost = F.when(whole, F.raise_error(F.concat(F.lit(f"no {tag} around the objects of "), "file")))
    torn = ~closed & F.col("value").rlike(_OBJECT)
    # Only the closed ones and what is torn go on; an error is raised where a torn row is looked at.
    rows = lines.where(closed | torn).withColumn("source", F.when(closed, F.regexp_replace("value", f"</{_PREFIX}$", "")).otherwise(F.coalesce(lost.cast("string"), F.concat("value", F.lit("<")))))
    rows = rows.withColumn("source", F.regexp_replace("source", f"(?s)^.*?<{_PREFIX}{tag}\\s[^>]*>", ""))
    # Starts of blocks first (few rows), then positions within a block: no single task sorts the whole.
    counts = rows.groupBy("file", "start").agg(F.count("*").alias("rows"))
    before = counts.select("file", "start", (F.sum("rows").over(Window.orderBy("file", "start")) - F.col("rows")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("file", "start").orderBy("n")) - 1
    return rows.withColumn("nth", nth).join(before, ["file", "start"]).select((F.col("before") + F.col("nth")).cast("long").alias("ord"), "source")


HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<FragmentInstance>'


def write_fragments(source: DataFrame, path: str, head: str = HEAD, foot: str = "</FragmentInstance>", tag: str = "Fragment", parts: int | None = None) -> None:
    """A document rebuilt from fragments ``(ord, source)``, as the folder ``path``: its files in the order of their names are the document.

    ``00-head``, ``50-body-...`` written by as many tasks as there is text for (or
    ``parts``), each with a range of ``ord``, and ``99-foot``. The folder appears when all of it is written; a
    path that exists is an error. ``head`` declares the prefixes that the fragments use.
    """
    spark = source.sparkSession
    files = spark._jvm.org.apache.hadoop.fs
    where = files.Path(path.rstrip("/"))
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where):
        raise FileExistsError(path)
    building = files.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    body = files.Path(building, "body")
    lines = source.repartitionByRange(*([parts] if parts else []), "ord").sortWithinPartitions("ord").select(F.concat(F.lit(f"<{tag}>"), "source", F.lit(f"</{tag}>")).alias("value"))
    lines.write.text(body.toString())
    for f in fs.listStatus(body):  # names alone change; a body has as many files as it had tasks
        if (name := f.getPath().getName()).startswith("part-"):
            fs.rename(f.getPath(), files.Path(building, f"50-body-{int(name.split('-')[1]):010d}"))
    fs.delete(body, True)
    for name, text in (("00-head", head), ("99-foot", foot)):
        stream = fs.create(files.Path(building, name), False)
        stream.write(bytearray(f"{text}\n".encode()))
        stream.close()
    if not fs.rename(building, where):
        raise FileExistsError(path)


def _parsed(source: str) -> ElementTree.Element:
    """The elements of a fragment under one root, names without their prefixes (which the fragment need not declare)."""
    builder, parser = ElementTree.TreeBuilder(), expat.ParserCreate()
    local = lambda name: name.rsplit(":", 1)[-1]
    parser.buffer_text = True
    parser.StartElementHandler = lambda name, attributes: builder.start(local(name), {local(k): v for k, v in attributes.items()})
    parser.EndElementHandler = lambda name: builder.end(local(name))
    parser.CharacterDataHandler = builder.data
    parser.Parse(f"<x>{source}</x>", True)
    return builder.close()


def _bare(source: str) -> ElementTree.Element:
    """As parsed; where that fails, once more without namespace declarations of a malformed shape."""
    try:
        return _parsed(source)
    except expat.ExpatError:
        return _parsed(re.sub(r"\s+xmlns(?::[\w.-]*)?=\"\"[^\"]*\"\"", "", source))


def _text(node: ElementTree.Element | None) -> str:
    """Text of the first child element, else the element's own."""
    if node is None:
        return ""
    child = next(iter(node), None)
    return ((child if child is not None else node).text or "").strip()


def _first(node: ElementTree.Element, *paths: str) -> str:
    return next((t for p in paths if (t := _text(node.find(p)))), "")


def _row(ord_: int, part: int, node: ElementTree.Element) -> dict:
    kind = node.tag
    row = {"ord": ord_, "part": part, "kind": kind, "id": (node.findtext("ID") or "").strip(), "codes": None, "based_on": [], "cl_id": None, "usage_id": None}
    row |= {k: (node.findtext(t) or "").strip() for k, t in (("agency", "Agency"), ("version", "Version"), ("user_id", "UserID"))}
    row |= {"label": _first(node, "Label"), "description": _first(node, "Description")}
    if kind == "CodeList":
        row["name"] = _first(node, "CodeListName")
        row["based_on"] = [i.text.strip() for r in node.iter("BasedOnReference") if (i := r.find("ID")) is not None and i.text]
        row["codes"] = [
            {"pos": pos, "value": (c.findtext("Value") or "").strip(), "cat_id": (c.findtext("CategoryReference/ID") or "").strip()} for pos, c in enumerate(node.iter("Code"))
        ]
    elif kind == "Category":
        row["name"] = _first(node, "CategoryName")
        row["label"] = row["label"] or row["name"]
    else:
        row["name"] = _first(node, "VariableName", "RepresentedVariableName") or row["id"]
        row["label"] = row["label"] or row["description"]
        found = [(node.findtext(p) or "").strip() or None for p in ("VariableRepresentation/CodeRepresentation/CodeListReference/ID", "CodeRepresentation/CodeListReference/ID")]
        # A variable's list is looked up within its representation first, a list's usage the other way round.
        row["cl_id"], row["usage_id"] = found[0] or found[1], found[1] or found[0]
    return row


def _fragment_rows(ord_: int, source: str) -> list[dict]:
    try:
        return [_row(ord_, part, node) for part, node in enumerate(_bare(source)) if node.tag in KINDS]
    except expat.ExpatError as error:
        return [{"ord": ord_, "part": 0, "kind": REJECT, "description": str(error)}]


def objects(source: DataFrame) -> DataFrame:
    """One row for each object of the four kinds; a fragment may hold several, or be a ``reject``."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for o, text in zip(frame["ord"], frame["source"], strict=True) for row in _fragment_rows(o, text)]
            if rows:
                names = ["ord", "part", "kind", "id", "name", "label", "description", "user_id", "agency", "version", "based_on", "cl_id", "usage_id", "codes"]
                # Rejects lack most columns; pandas fills those with NaN, which is no list or text.
                yield pd.DataFrame(rows, columns=names).astype(object).where(lambda f: f.notna(), None)

    return source.mapInPandas(task, OBJECTS)


def extract(spark: SparkSession, path: str, tag: str = "Fragment", last_wins: bool = False, name_fallback_label: bool = False) -> dict[str, DataFrame]:
    """``lists``, ``codes``, ``categories``, ``variables`` of the files, labels resolved, and ``rejects (ord, error)``.

    Of several versions of a list the latest counts; with ``last_wins`` the last one
    read, whatever its version. With ``name_fallback_label`` a list without a name
    is called by its label. ``ord`` is a number for fragment and place in it.
    """
    found = objects(fragments(spark, path, tag))
    rejects = found.where(F.col("kind") == REJECT).select("ord", F.col("description").alias("error"))
    # One number for fragment and place, wide enough for any of both.
    found = found.withColumn("ord", F.col("ord").cast("decimal(20,0)") * F.lit(1 << 31) + F.col("part"))
    name = F.coalesce(F.nullif("name", F.lit("")), "label") if name_fallback_label else F.col("name")
    lists = found.where("kind = 'CodeList' and id <> ''").select(F.col("id").alias("list_id"), "ord", name.alias("name"), "label", "description", "user_id", "agency", "version", "based_on", "codes")
    lists = latest_by_key(lists, "list_id", "ord") if last_wins else latest_version(lists)
    categories = latest_by_key(found.where("kind = 'Category'").select(F.col("id").alias("cat_id"), "ord", "label"), "cat_id", "ord")
    variables = found.where("kind in ('Variable', 'RepresentedVariable') and cl_id is not null").select("id", "ord", "name", "label", "cl_id", "usage_id")
    codes = resolve_labels(lists.select("list_id", F.explode("codes").alias("c")).select("list_id", "c.pos", "c.value", "c.cat_id"), categories)
    return {"lists": link_variables(lists.drop("codes"), variables), "codes": codes, "categories": categories, "variables": variables, "rejects": rejects}


def counts(found: dict[str, DataFrame]) -> DataFrame:
    """``table, n`` of lists, categories and variables."""
    parts = [found[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name in ("lists", "categories", "variables")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
