"""Facts about small lists, pairs, registries and decisions."""

import pyspark.sql.functions as F

from quillwork.functions import text
from quillwork.operators import candidates, grouping, ingest, quality, review, semantic, signature, similarity


def cl(name, n, extra=0):
    """``n`` berths that all lists share, and ``extra`` ones of its own."""
    return [(f"q{3 * i}", f"berth {i} of the pier") for i in range(n)] + [(f"{name}.{i}", f"only in {name}: {i}") for i in range(extra)]


def code_sim(a, b):
    as_rows = lambda codes: [{"value": v, "label": x} for v, x in codes]
    return similarity.match_codes(as_rows(a), as_rows(b))


def test_code_similarity_facts():
    assert code_sim(cl("a", 7), cl("b", 7)) == 1.0
    assert code_sim(cl("a", 11), cl("b", 11, 6)) == code_sim(cl("b", 11, 6), cl("a", 11)) == 11 / 17
    assert code_sim(cl("a", 60), cl("b", 60, 2)) == 60 / 62
    assert code_sim([("n", "North mole"), ("s", "South mole")], [("n", "North mole"), ("s", "Zzz")]) == 0.5
    assert code_sim([("quay-7", "x"), ("dock-7", "y")], [("quay-7 ", "x"), ("dock-7 ", "y")]) == 1.0
    assert code_sim([], []) == 1.0 and code_sim([], [("k", "a")]) == 0.0
    many = lambda s: [(f"bollard{i:03d}{s}", f"no. {i}") for i in range(130)]
    assert code_sim(many(""), many(" ")) == 0.0


def lists_of(spark, named, names=None):
    rows = [(k, i, p, v, x) for i, (k, codes) in enumerate(named.items()) for p, (v, x) in enumerate(codes)]
    codes = spark.createDataFrame(rows, "list_id string, ord long, pos int, value string, label string")
    lists = spark.createDataFrame([(k, i, (names or {}).get(k, k)) for i, k in enumerate(named)], "list_id string, ord long, name string")
    normal = codes.select("list_id", "pos", text.normalize(F.col("value")).alias("value"), text.normalize(F.col("label")).alias("label"))
    signed = signature.signatures(lists, normal)
    ordered = codes.groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value", "label"))), lambda c: F.struct(c["value"].alias("value"), c["label"].alias("label"))).alias("codes"))
    return signed.join(ordered, "list_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast(signature.PAIRS)))


def test_fuzzy_pairs_by_blocking_are_all_pairs(spark):
    named = {f"l{i}": cl(f"l{i}", 4 + i % 9, i % 4) for i in range(40)} | {f"v{i}": [(f"valeur{j:03d}{'x' * (i % 2)}", f"lib {j}") for j in range(5 + i % 3)] for i in range(8)}
    lists = lists_of(spark, named)
    got = {(r.a, r.b): r.score for r in similarity.fuzzy_pairs(lists).collect()}
    reps = [r.list_id for r in signature.representatives(lists, "sig").orderBy("ord").collect()]
    want = {}
    for i, a in enumerate(reps):
        for b in reps[i + 1 :]:
            n, m = len(named[a]), len(named[b])
            if min(n, m) < 0.75 * max(n, m) or (code := code_sim(named[a], named[b])) < 0.75:
                continue
            from difflib import SequenceMatcher

            short = min(len(a), len(b)) < 3
            name = 1.0 if short else SequenceMatcher(None, a, b).ratio()
            score = code if short else 0.6 * code + 0.4 * name
            if not short and code >= 0.95 and name < 0.5:
                score = max(score, 0.95)
            if score >= 0.8:
                want[a, b] = round(score, 4)
    assert got == want and len(want) > 10


def test_near_values_of_a_class_of_their_own_are_settled_without_workers(spark, monkeypatch):
    def never(*_):
        raise AssertionError("codes assigned one by one")

    word = lambda j: "".join(chr(97 + (j * 7 + k * k) % 26) for k in range(14))
    named = {f"l{i}": [(word(j) + "x" * (i % 2), f"label {j}") for j in range(i % 3, i % 3 + 6 + i % 4)] for i in range(14)}
    lists = lists_of(spark, named)
    near = similarity.list_near_values(lists)
    whole = {r.value: r["class"] for r in similarity.whole_classes(near).collect()}
    assert whole and all(c == v.removesuffix("x") if v.endswith("x") else c == v for v, c in whole.items())
    want = {(a, b): code_sim(named[a], named[b]) for a in named for b in named if a != b}
    monkeypatch.setattr(similarity, "code_similarity", F.pandas_udf(never, "double"))
    found = similarity.fuzzy_pairs(lists).collect()
    assert len(found) > 5 and any((int(r.a[1:]) + int(r.b[1:])) % 2 for r in found) and all(r.code_sim == round(want[r.a, r.b], 4) for r in found)


def test_values_that_match_some_of_their_class_are_no_class(spark):
    """The middle one matches both others, which do not match: codes have to be assigned."""
    named = {"a": [("abcdefghijkl", "x"), ("q", "y")], "b": [("abcdefghijklmn", "x"), ("q", "y")], "c": [("abcdefghijklmnop", "x"), ("q", "y")]}
    near = similarity.list_near_values(lists_of(spark, named))
    assert near.count() == 4 and similarity.whole_classes(near).count() == 0
    own = {r.list_id: r.plain for r in similarity.list_sides(lists_of(spark, named), near).collect()}
    assert own == {"a": False, "b": False, "c": False}


def test_detected_pair_of_long_lists(spark):
    lists = lists_of(spark, {"a": cl("a", 170), "b": cl("b", 170, 5)}, {"a": "BERTHS OF 1987, DRAFT", "b": "BERTHS OF 1987"})
    rows = similarity.fuzzy_pairs(lists).collect()
    assert [(r.a, r.b, r.level, r.code_sim) for r in rows] == [("a", "b", "detected", round(170 / 175, 4))]


def test_business_and_label_groups(spark):
    wood = [("o", "Oak"), ("b", "Beech"), ("e", "Elm")]
    named = {
        "trees": [*wood, ("zz", "Non concerné")], "logs": [*wood, ("_Z", "Sans objet")], "planks": [*wood, ("p", "Pine")],
        "glow": [("1", "Lit"), ("0", "Dark"), ("_Z", "Sans objet")], "lamp": [("y", "Lit"), ("n", "Dark")], "lamp2": [("1", "Lit"), ("0", "Dark")],
        "same": [(x, x) for x in ("Early", "Late")], "coded": [("E", "Early"), ("L", "Late")],
    }
    lists = lists_of(spark, named)
    pairs = lambda df: {(r.master_id, r.slave_id) for r in df.collect()}
    assert pairs(signature.business_groups(lists)) == {("trees", "logs"), ("glow", "lamp2")}
    assert pairs(signature.label_groups(lists)) == {("glow", "lamp"), ("same", "coded")}
    assert pairs(signature.exact_groups(lists)) == set()


def test_quality_flags(spark):
    named = {"p": [("q", "Voir le registre du port")], "r": [("a", "3 à 12")], "s": [("k", "quai"), ("_y", "hors service")], "n": [("a", "quai"), ("b", "môle"), ("c", "code du phare")], "c": [("a", "code du bassin"), ("b", "x")], "e": [("/", "vide")]}
    rows = [(k, v, x) for k, codes in named.items() for v, x in codes]
    codes = spark.createDataFrame([(k, v.lower(), x.lower()) for k, v, x in rows], "list_id string, value string, label string")
    lists = spark.createDataFrame([(k,) for k in [*named, "none"]], "list_id string")
    got = {r.list_id: r.quality_flags for r in quality.quality_flags(lists, codes).collect()}
    assert got == {"p": ["placeholder", "single_code"], "r": ["numeric_range", "single_code"], "s": ["single_code"], "n": [], "c": ["placeholder"], "e": [], "none": []}


def test_latest_version_and_keys(spark):
    rows = spark.createDataFrame([("cl-1", 0, "5", "old"), ("cl-2", 1, None, "x"), ("cl-1", 2, "12", "new"), ("cl-2", 3, "2", "y"), ("cl-2", 4, "2", "z"), ("cl-3", 5, "b", "t"), ("cl-3", 6, "10", "n")], "list_id string, ord long, version string, name string")
    got = {r.list_id: (r.ord, r.name) for r in ingest.latest_version(rows).collect()}
    assert got == {"cl-1": (0, "new"), "cl-2": (1, "y"), "cl-3": (5, "t")}
    keys = spark.createDataFrame([("N-categorie_juridique",), ("N-CATEGORIE-JURIDIQUE",), ("é  A",)], "x string").select(text.name_key(F.col("x")), text.normalize(F.col("x"))).collect()
    assert keys[0][0] == keys[1][0] == "n categorie juridique" and keys[2][1] == "é a"


def test_candidates_are_not_reported_twice(spark):
    pair = lambda *rows: spark.createDataFrame(list(rows), "master_id string, slave_id string")
    fuzzy = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.94), ("x", "z", 0.9)], "a string, b string, score double")
    semantic_ = spark.createDataFrame([("a", "q", 0.97, "direct", 1), ("b", "q", 0.99, "variable", 2), ("a", "b", 1.0, "direct", 0)], "a string, b string, score double, phase string, rank long")
    got = {(r.master_id, r.slave_id, r.detection_type, r.confidence) for r in candidates.assemble(pair(("m", "x")), fuzzy, pair(("k", "x"), ("k", "y")), pair(("k", "y"), ("k", "w")), pair(("a", "b"), ("a", "u")), semantic_).collect()}
    assert got == {("m", "x", "exact", 1.0), ("a", "b", "fuzzy", 0.99), ("b", "c", "fuzzy", 0.94), ("k", "y", "exact_business", 0.98), ("k", "w", "labels", 0.95), ("a", "u", "usage", 0.85), ("a", "q", "semantic_list", 0.97)}


def test_registry_parents_links_and_via(spark):
    found = spark.createDataFrame([(1, 2, "exact", 1.0), (2, 3, "fuzzy", 0.94), (9, 8, "fuzzy", 0.95), (7, 8, "exact", 1.0), (9, 7, "fuzzy", 0.93)], "master_id long, slave_id long, detection_type string, confidence double")
    lists = spark.createDataFrame([(i, i, "registry" if i == 9 else "xml", i == 8) for i in (1, 2, 3, 5, 7, 8, 9)], "list_id long, ord long, origin string, preferred boolean")
    got = {r.id: (r.parent_id, r.detection_types, r.confidence, r.via) for r in grouping.registry(found, lists).collect()}
    assert got[2] == (1, ["exact"], 1.0, []) and got[3] == (1, ["fuzzy"], 0.94, [2])
    assert got[8] == (9, ["fuzzy"], 0.95, []) and got[9][0] == 9 and got[5][0] == 5


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (502, 501)], "a long, b long").repartition(4)
    got = {r.node: r.comp for r in grouping.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 500}
    assert grouping.components(edges.limit(0)).collect() == []


def test_decisions_and_cleaned_registry(spark):
    members = spark.createDataFrame([("a", "b", "approve"), ("a", "c", "pending"), ("d", "e", "reject")], "parent_id string, id string, decision string")
    store = spark.createDataFrame([("a|b", "approve", "old"), ("a|c", "reject", "old"), ("x|y", "reject", "old")], "key string, decision string, updated_at string")
    got = {r.key: (r.decision, r.updated_at) for r in review.update_decisions(store, members, F.lit("new")).collect()}
    assert got == {"a|b": ("approve", "old"), "d|e": ("reject", "new"), "x|y": ("reject", "old")}
    cleaned = spark.createDataFrame([("d",), ("m",)], "list_id string")
    replaces = spark.createDataFrame([("d", "e"), ("a", "foreign")], "parent_id string, id string")
    entries, new = review.sync_cleaned(cleaned, replaces, members)
    assert {r.list_id for r in entries.collect()} == {"a", "m"}
    assert {(r.parent_id, r.id) for r in new.collect()} == {("a", "b"), ("a", "foreign")}


def test_judge_replies_and_vectors(spark):
    replies = ['text {"meme_concept": true, "confiance": 0.9, "raison": "r"} end', "nothing", "{ broken", None, "{}"]
    got = [tuple(r.j) for r in spark.createDataFrame([(i, x) for i, x in enumerate(replies)], "i int, x string").select("i", semantic.judge_parse(F.col("x")).alias("j")).orderBy("i").collect()]
    no = (False, 0.0, semantic.UNREADABLE)
    assert got == [(True, 0.9, "r"), no, no, no, (False, 0.0, "")]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, embedding array<float>")
    assert [(r.a, r.b, r.score) for r in semantic.cosine_pairs(vectors, 0.5, block=2).collect()] == [(1, 2, 1.0)]


def test_swapped_groups_are_detected_anew(spark):
    found = spark.createDataFrame([(1, 2, "exact", 1.0), (2, 3, "fuzzy", 0.93), (5, 6, "exact", 1.0)], "master_id long, slave_id long, detection_type string, confidence double")
    members = spark.createDataFrame([(1, 2, "approve", ["exact"], 1.0, []), (1, 3, "reject", ["fuzzy"], 0.93, [2]), (5, 6, "pending", ["exact"], 1.0, [])], "parent_id long, id long, decision string, detection_types array<string>, confidence double, via array<long>")
    groups = spark.createDataFrame([(1, 10, "xml"), (5, 50, "registry")], "parent_id long, ord long, origin string")
    swaps = spark.createDataFrame([(1, 3), (5, 6)], "parent_id long, new_parent_id long")
    links = grouping.links(grouping.fuse_pairs(found))
    after, moved, refused = review.swapped_registry(members, groups, links, swaps)
    got = {(r.parent_id, r.id): (r.decision, r.detection_types, r.confidence, r.via) for r in after.collect()}
    assert got == {(3, 1): ("pending", ["exact"], 1.0, [2]), (3, 2): ("approve", ["fuzzy"], 0.93, []), (5, 6): ("pending", ["exact"], 1.0, [])}
    assert {(r.parent_id, r.ord, r.master_chosen, r.previous_parent) for r in moved.collect()} == {(3, 10, True, 1), (5, 50, False, None)}
    assert [(r.parent_id, r.reason) for r in refused.collect()] == [(5, "registry")]
