import pyspark.sql.functions as F
import pytest

from quillwork.functions import text
from quillwork.operators import signature
from quillwork.sources import xml

CRATE = """<?xml version="1.0"?><ddi:Instance xmlns:ddi="ddi:instance:3_3" xmlns:r="ddi:reusable:3_3">
<Fragment xmlns:r="x"><Category><r:ID>hue-b</r:ID><r:Label><r:Content xml:lang="fr">bleu, voir http:page=1</r:Content></r:Label></Category><Category><ID>hue-g</ID><CategoryName><String>vert</String></CategoryName></Category></Fragment>
<Fragment><CodeList><r:Agency>port</r:Agency><r:ID>hues</r:ID><r:Version>3</r:Version><CodeListName><r:String>HUES</r:String></CodeListName><r:Label><r:Content>Paint of a crate</r:Content></r:Label>
<Code><r:Value>B</r:Value><r:CategoryReference><r:ID>hue-b</r:ID></r:CategoryReference><Code><r:Value>BX</r:Value></Code></Code><Code><r:Value>G</r:Value><r:CategoryReference><r:ID>hue-g</r:ID></r:CategoryReference></Code></CodeList></Fragment>
<Fragment><CodeList><ID>paints</ID><Version>11</Version><Label><Content>Paint shop</Content></Label><Code><Value>B</Value><CategoryReference><ID>hue-b</ID></CategoryReference></Code><Code><Value>BX</Value></Code><Code><Value>G</Value><CategoryReference><ID>hue-g</ID></CategoryReference></Code></CodeList></Fragment>
<Fragment><CodeList><ID>paints</ID><Version>2</Version><CodeListName><String>OLD</String></CodeListName><BasedOnObject><BasedOnReference><ID>hues</ID></BasedOnReference></BasedOnObject><Code><Value>Q</Value></Code></CodeList></Fragment>
<Fragment><Category><ID>torn</ID><Label><Content>salt & pepper</Content></Label></Category></Fragment>
<Fragment xmlns:s=""ddi:other""><Category><ID>hue-g</ID><Label><Content>vert tendre</Content></Label></Category></Fragment>
<Fragment><Variable><ID>w1</ID><VariableName><String>lid</String></VariableName><VariableRepresentation><CodeRepresentation><CodeListReference><ID>hues</ID></CodeListReference></CodeRepresentation></VariableRepresentation><CodeRepresentation><CodeListReference><ID>paints</ID></CodeListReference></CodeRepresentation></Variable></Fragment>
<Fragment><Variable><ID>w2</ID></Variable></Fragment></ddi:Instance>"""


def test_fragments_to_tables(spark, tmp_path):
    (tmp_path / "a.xml").write_text(CRATE)
    found = xml.extract(spark, f"file://{tmp_path}/a.xml")
    lists = {r.list_id: r for r in found["lists"].collect()}
    assert set(lists) == {"hues", "paints"}
    assert (lists["hues"].name, lists["hues"].label, lists["hues"].agency) == ("HUES", "Paint of a crate", "port")
    assert (lists["paints"].version, lists["paints"].based_on, lists["paints"].n_versions, lists["paints"].name) == ("11", [], 2, "")
    # Names of variables go by the nested reference first, ids by the direct one.
    assert (lists["hues"].vars, lists["hues"].var_ids, lists["paints"].vars, lists["paints"].var_ids) == (["lid"], [], [], ["w1"])
    assert lists["hues"].ord < lists["paints"].ord
    codes = sorted((r.list_id, r.pos, r.value, r.label) for r in found["codes"].collect())
    assert codes == [(i, p, v, x) for i in ("hues", "paints") for p, v, x in ((0, "B", "bleu, voir http:page=1"), (1, "BX", ""), (2, "G", "vert tendre"))]
    assert {(r.table, r.n) for r in xml.counts(found).collect()} == {("lists", 2), ("categories", 2), ("variables", 1)}
    assert [r.ord for r in found["rejects"].collect()] == [4] and all(r.error for r in found["rejects"].collect())
    normal = found["codes"].select("list_id", "pos", text.normalize(F.col("value")).alias("value"), text.normalize(F.col("label")).alias("label"))
    groups = signature.exact_groups(signature.signatures(found["lists"].select("list_id", "ord"), normal)).collect()
    assert [(g.master_id, g.slave_id) for g in groups] == [("hues", "paints")]
    other = {r.list_id: (r.name, r.version) for r in xml.extract(spark, f"file://{tmp_path}/a.xml", last_wins=True, name_fallback_label=True)["lists"].collect()}
    assert other == {"hues": ("HUES", "3"), "paints": ("OLD", "2")}
    named = {r.list_id: r.name for r in xml.extract(spark, f"file://{tmp_path}/a.xml", name_fallback_label=True)["lists"].collect()}
    assert named == {"hues": "HUES", "paints": "Paint shop"}


def test_more_than_a_thousand_objects_in_one_fragment_keep_their_order(spark, tmp_path):
    body = "".join(f"<Category><ID>c{i % 1200}</ID><CategoryName><String>n{i}</String></CategoryName></Category>" for i in range(2400))
    (tmp_path / "w.xml").write_text(f"<root><Fragment>{body}</Fragment></root>")
    found = {r.cat_id: r.label for r in xml.extract(spark, f"file://{tmp_path}/w.xml")["categories"].collect()}
    assert found == {f"c{i}": f"n{i + 1200}" for i in range(1200)}


def test_document_order_over_many_blocks_and_files(spark, tmp_path):
    for k in range(2):
        body = "".join(f"<Fragment><Category><ID>{k}-{i}</ID><CategoryName><String>{'x' * 50}</String></CategoryName></Category></Fragment>\n" for i in range(3000))
        (tmp_path / f"{k}.xml").write_text(f"<root>{body}</root>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = xml.objects(xml.fragments(spark, f"file://{tmp_path}")).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.id for r in rows] == [f"{k}-{i}" for k in range(2) for i in range(3000)]


def test_missing_path_is_an_error(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        xml.extract(spark, "file:///tmp/no-such-file.xml")


def test_prefixed_bare_and_mixed_files_are_read_alike(spark, tmp_path):
    bare = CRATE.replace("ddi:Instance", "Instance")
    for name, text_ in (("a", bare), ("b", bare.replace("<Fragment", "<ddi:Fragment").replace("</Fragment", "</ddi:Fragment")), ("c", bare.replace("<Fragment>", "<x.y-z:Fragment a='1'\n b='2'>").replace("</Fragment", "</x.y-z:Fragment"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.xml").write_text(text_)
    rows = {n: xml.objects(xml.fragments(spark, f"file://{tmp_path}/{n}")).orderBy("ord", "part").collect() for n in "abc"}
    assert len(rows["a"]) == 9 and rows["a"] == rows["b"]
    assert [(r.kind, r.id) for r in rows["a"] if r.kind != "reject"] == [(r.kind, r.id) for r in rows["c"] if r.kind != "reject"]
    mixed = xml.objects(xml.fragments(spark, f"file://{tmp_path}/[abc]/f.xml")).orderBy("ord", "part").collect()
    assert [r.id for r in mixed] == [r.id for n in "abc" for r in rows[n]]
    assert xml.objects(xml.fragments(spark, f"file://{tmp_path}/b", tag="ddi:Fragment")).count() == 9


def test_objects_outside_of_fragments_are_an_error_and_torn_ones_rejects(spark, tmp_path):
    (tmp_path / "n.xml").write_text("<root><Category><ID>a</ID></Category></root>")
    with pytest.raises(Exception, match="no Fragment around the objects"):
        xml.extract(spark, f"file://{tmp_path}/n.xml")["categories"].collect()
    one = "<Fragment><Category><ID>a</ID></Category></Fragment>"
    for head in ("<Fragment>", "<Fragment a='1'>"):
        (tmp_path / "t.xml").write_text(f"<root>{one}{head}<Category><ID>b</ID>")
        found = xml.extract(spark, f"file://{tmp_path}/t.xml")
        assert [r.cat_id for r in found["categories"].collect()] == ["a"] and found["rejects"].count() == 1


def test_a_document_rebuilt_from_fragments_reads_the_same(spark, tmp_path):
    body = "".join(f"<ddi:Fragment><Category><ID>c{i}</ID><CategoryName><String>{'n' * (i % 50)}</String></CategoryName></Category></ddi:Fragment>\n" for i in range(500))
    (tmp_path / "a.xml").write_text(CRATE.replace("</ddi:Instance>", "") + body + "</ddi:Instance>")
    source = xml.fragments(spark, f"file://{tmp_path}/a.xml")
    head = CRATE[: CRATE.index("<Fragment")].strip()
    xml.write_fragments(source.repartition(5), f"file://{tmp_path}/out", head, "</ddi:Instance>", parts=3)
    again = xml.fragments(spark, f"file://{tmp_path}/out")
    assert again.orderBy("ord").select("source").collect() == source.orderBy("ord").select("source").collect()
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert names[0] == "00-head" and names[-1] == "99-foot" and len(names) > 3
    whole = "".join((tmp_path / "out" / n).read_text() for n in names)
    assert whole.startswith(head) and whole.rstrip().endswith("</ddi:Instance>") and whole.count("<Fragment>") == 508
    one, two = (xml.extract(spark, f"file://{tmp_path}/{n}") for n in ("a.xml", "out"))
    for name in ("codes", "variables", "categories"):
        drop = [c for c in one[name].columns if c != "ord"]
        assert sorted(map(tuple, one[name].select(drop).collect()), key=str) == sorted(map(tuple, two[name].select(drop).collect()), key=str)
    with pytest.raises(FileExistsError):
        xml.write_fragments(source, f"file://{tmp_path}/out")


def test_empty_document(spark, tmp_path):
    (tmp_path / "e.xml").write_text("<root></root>")
    assert xml.extract(spark, f"file://{tmp_path}/e.xml")["lists"].collect() == []


def test_cleaned_registry_and_decisions(spark, tmp_path):
    import json

    from quillwork.sources import registry

    new = {"codelists": {
        "p1": {"id": "p1", "name": "TIDES", "label": "Marées", "codes": [["1", "haute"], ["2"], []], "vars": ["t"], "replaces": [{"id": "d1", "name": "x"}, {"name": "no id"}]},
        "p2": {"id": "p2", "merged_duplicates": ["d2", "d3"]}, "p3": {"name": "keyed", "replaces": ["d4"]}, "p4": {"id": "own", "replaces": [], "merged_duplicates": [{"id": "d5"}]},
    }}
    (tmp_path / "c.json").write_text(json.dumps(new, indent=1, ensure_ascii=False))
    lists, replaces = registry.read_cleaned(spark, f"file://{tmp_path}/c.json")
    got = {r.list_id: r for r in lists.collect()}
    assert set(got) == {"p1", "p2", "p3", "own"}
    assert [tuple(c) for c in got["p1"].codes] == [("1", "haute"), ("2", "")] and got["p2"].name == "" and got["p1"].origin == "registry"
    assert sorted(map(tuple, replaces.collect())) == [("own", "d5"), ("p1", "d1"), ("p2", "d2"), ("p2", "d3"), ("p3", "d4")]
    # Out and in again.
    out = registry.cleaned_json(lists, replaces).select(F.lit("codelists").alias("section"), F.col("list_id").alias("key"), "entry")
    registry.write_document(out, f"file://{tmp_path}/out", ["codelists"])
    again = registry.read_cleaned(spark, f"file://{tmp_path}/out/part-*.txt")
    assert sorted(again[0].collect(), key=str) == sorted(lists.collect(), key=str)
    assert sorted(map(tuple, again[1].collect())) == sorted(map(tuple, replaces.collect()))
    none = registry.read_cleaned(spark, f"file://{tmp_path}/none.json", missing_ok=True)
    assert none[0].collect() == [] and none[1].collect() == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        registry.read_cleaned(spark, f"file://{tmp_path}/none.json")[0].collect()
    (tmp_path / "d.json").write_text(json.dumps({"pairs": {"a|b": {"decision": "reject", "updated_at": "t"}}, "dismissed": {"z": {"updated_at": "t"}}}))
    found = registry.read_decisions(spark, f"file://{tmp_path}/d.json")
    assert [tuple(r) for r in found["pairs"].collect()] == [("a|b", "reject", "t")]
    assert [r.id for r in found["dismissed"].collect()] == ["z"] and found["masters"].collect() == []
    registry.write_document(registry.decisions_json(found["pairs"], found["dismissed"], found["masters"]), f"file://{tmp_path}/store", ["pairs", "dismissed", "masters"])
    held = json.loads(next((tmp_path / "store").glob("part-*.txt")).read_text())
    assert held == {"pairs": {"a|b": {"decision": "reject", "updated_at": "t"}}, "dismissed": {"z": {"updated_at": "t"}}, "masters": {}}


def test_concepts(spark, tmp_path):
    import json

    from quillwork.sources import registry

    ns, lit = "http://x/", lambda v, lang=None: [{"value": v, "type": "literal"} | ({"lang": lang} if lang else {})]
    doc = {
        f"{ns}c1": {"skos#prefLabel": lit("Age", "fr") + lit("Age en", "en")},
        f"{ns}c1/definition/1/fr": {"pav/version": lit("1"), "content": lit("vieux", "fr")},
        f"{ns}c1/definition/2/fr": {"pav/version": lit("2"), "content": lit("actuel", "fr")},
        f"{ns}c1/definition/3/fr": {"pav/version": lit("3"), "content": lit("fini", "fr"), "validUntil": lit("2020")},
        f"{ns}c2/definition/1/fr": {"content": lit("seul", "fr")}, f"{ns}c3/definition/1/en": {"content": lit("only", "en")},
    }
    (tmp_path / "s.json").write_text(json.dumps(doc))
    got = {r.concept: (r.label, r.definition) for r in registry.read_concepts(spark, f"file://{tmp_path}/s.json").collect()}
    assert got == {f"{ns}c1": ("Age", "actuel"), f"{ns}c2": ("", "seul")}


def test_summary_is_written_either_way(spark, tmp_path):
    from quillwork.plans import operation

    path = f"file://{tmp_path}/runs"
    operation.summarised(spark, path, "r1", lambda: spark.range(1).select(F.lit(3).alias("codelists")))
    with pytest.raises(ZeroDivisionError):
        operation.summarised(spark, path, "r2", lambda: 1 / 0)
    assert {(r.run_id, r.status) for r in spark.read.json(path).collect()} == {("r1", "success"), ("r2", "error")}
