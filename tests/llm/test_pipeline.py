import hashlib
import random

import public_tokenizers
import pyspark.sql.functions as F
import pytest
import tiktoken

import corpus_pipeline
from quillwork.llm import bpe, exact_dedup, langid, mixing
from quillwork.llm.jaccard import JaccardJoin


def test_stages_follow_from_their_operators(spark, tmp_path):
    r = random.Random(5)
    vocab = {"en": "the of and that with from this have".split(), "fr": "le la les des une dans pour avec".split()}
    rows, labels = [], []
    for i in range(150):
        lang = r.choice(["en", "fr"])
        w = [r.choice(vocab[lang]) + r.choice("abcdefgh") for _ in range(r.randrange(20, 60))]
        kind = i % 5
        if kind == 1:
            w = [x + "***" for x in w]
        if kind == 2:
            w.insert(3, "idiot")
        text = " ".join(w)
        if i in (40, 41, 42):
            text = rows[10][1].upper()
        if i in (50, 51):
            text = rows[20][1] + " more"
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
        labels.append((i, int(kind != 1), int(kind == 2)))
    rows += [(150, "12 34 --", "en", "s1", 8), (151, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    first = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    ids = {x.doc_id for x in first.collect()}
    assert ids == {x[0] for x in rows} - {150, 151} == {x.doc_id for x in langid.of_documents(docs).where("kept").collect()}

    second = corpus_pipeline.exact_copies(spark, first, "")
    groups = {}
    for d, text, *_ in rows:
        if d in ids:
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            groups.setdefault(key, []).append(d)
    ids = {max(g) for g in groups.values()}
    assert {x.doc_id for x in second.collect()} == ids

    third = corpus_pipeline.near_copies(spark, second, "")
    classes = {x.doc_id: x.component_id for x in JaccardJoin(spark).classes(second).collect()}
    ids = {d for d, c in classes.items() if d == c}
    assert {x.doc_id for x in third.collect()} == ids

    fourth = corpus_pipeline.mixed(spark, third, str(tmp_path))
    rated = mixing.mix(third, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert fourth.columns == docs.columns
    assert {x.doc_id for x in fourth.collect()} == {x.doc_id for x in rated.where(mixing.drawn(rated)).collect()}

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {x.doc_id: x.text for x in fourth.collect()}
    want = {d: (len(e := own.encode_ordinary(t)), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in texts.items()}
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_exact_dedup_goes_on_with_its_index(spark):
    index = exact_dedup.DigestIndex(spark)
    one = {r.doc_id: r for r in index.absorb(spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "x"), (3, "x"), (None, None)], "doc_id long, text string")).collect()}
    assert (one[2].kept, one[1].kept, one[1].keep_id, one[1].group_size) == (True, False, 2, 2)
    again = exact_dedup.DigestIndex(spark, index.path)
    rows = spark.createDataFrame([(9, "a b"), (8, "new"), (7, ""), (8, "É"), (8, "é")], "doc_id long, text string")
    two = {(r.doc_id, r.keep_id): (r.kept, r.group_size) for r in again.absorb(rows).collect()}
    assert two[9, 2] == (False, 3) and two[7, None] == (False, 2)
    assert sum(k for k, _ in two.values()) == 1 and again.entries().count() == 6


@pytest.mark.parametrize(("made", "opened"), [("4", "7"), ("7", "4")])
def test_an_index_keeps_its_buckets_and_batches_can_be_replayed(spark, tmp_path, made, opened):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    rows = [(i, f"text {i % 500} " + "é" * (i % 3)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    answer = lambda df: sorted(map(tuple, df.collect()))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", made)
        index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index")
        one = answer(index.absorb(docs, batch="one"))
        size = index.entries().count()
        assert sum(x[3] for x in one) == size == len({t for _, t in rows})
        index.close()
        spark.conf.set("spark.sql.shuffle.partitions", opened)
        index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index")
        assert index.buckets == int(made)
        # The same batch under another name is known; under its own name it gets its answer again.
        assert not any(x[3] for x in answer(index.absorb(docs, batch="two")))
        assert answer(index.absorb(docs, batch="one")) == one and index.entries().count() == size
        # An attempt that broke off in the middle of its append.
        more = docs.select((docs.doc_id + 5000).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text"))
        whole = answer(exact_dedup.DigestIndex(spark).absorb(more))
        done = more.where("doc_id % 3 = 0").select(F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(1).cast("long"), F.lit(1).cast("long"), F.lit("three"))
        done = done.dropDuplicates(["digest"])
        kept = {x[4]: x for x in whole if x[3]}
        want = spark.createDataFrame([(x[4], x[1], x[2]) for x in kept.values()], "hex string, keep_id long, group_size long")
        want.join(done.select(F.lower(F.hex("digest")).alias("hex")), "hex").select(F.unhex("hex"), "keep_id", "group_size", F.lit("three")).write.insertInto(index.name)
        assert answer(index.absorb(more, batch="three")) == whole and index.entries().count() == 2 * size
        with pytest.raises(ValueError, match="buckets"):
            exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=int(made) + 1)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_exact_dedup_with_a_hot_text_clashing_columns_and_very_long_texts(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 1999}", "x", 1, True) for i in range(9000)] + [(9001, "long " * 400_000, None, None, None), (9002, "LONG " * 400_000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n int, kept boolean").repartition(5)
    groups = {}
    for d, text, *_ in rows:
        groups.setdefault(text.lower(), []).append(d)
    got = {r.doc_id: r for r in exact_dedup.DigestIndex(spark).absorb(docs).collect()}
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for d in ids:
            assert (got[d].keep_id, got[d].group_size, got[d].kept) == (max(ids), len(ids), d == max(ids))
            assert got[d].text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_repeated_rows_keep_one(spark):
    rows = spark.createDataFrame([(3, "x"), (3, "x"), (3, "X")], "doc_id long, text string")
    assert sorted(r.kept for r in exact_dedup.DigestIndex(spark).absorb(rows).collect()) == [False, False, True]
    assert exact_dedup.DigestIndex(spark).absorb(rows.limit(0)).collect() == []


def _rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def test_stages_judge_rows_and_not_ids(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    a, b, c, d, e = (" ".join(word() for _ in range(60)) for _ in range(5))
    got = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=str)
    want = lambda *rows: sorted(rows, key=str)

    # Language: of rows that share an id, or have none, only those without letters go.
    rows = [(1, a), (1, "12 34"), (None, b), (None, "56 78"), (2, c), (2, c)]
    found = corpus_pipeline.language(spark, _rows(spark, [(i, t, "en", "s", 1) for i, t in rows]), "")
    assert got(found) == want((1, a), (None, b), (2, c), (2, c))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    # Exact copies: whole rows repeated, an id with two texts of which one is a copy, copies without an id.
    rows = [(1, a), (1, a), (2, b), (3, b.upper()), (2, c), (None, d), (None, d), (None, e), (4, e)]
    found = corpus_pipeline.exact_copies(spark, _rows(spark, [(i, t, "en", "s", 1) for i, t in rows]), "")
    assert got(found) == want((1, a), (3, b.upper()), (2, c), (None, d), (4, e))

    # Near copies: two that share the smallest id, some without an id, an id that is in two classes.
    rows = [(1, a), (1, a + " more"), (2, a + " again"), (None, b), (None, b + " more"), (None, c), (2, c + " more"), (3, d), (3, d), (None, ""), (None, "")]
    found = got(corpus_pipeline.near_copies(spark, _rows(spark, [(i, t, "en", "s", 1) for i, t in rows]), ""))
    assert [x[0] for x in found if x[1].startswith(a)] == [1]
    assert [x[0] for x in found if x[1].startswith(b)] == [None]
    assert [x for x in found if x[1].startswith((c, d))] == want((2, c + " more"), (3, d))
    assert len(found) == 6  # texts without words are linked with nothing

    # Mixing: of rows that share an id and differ in their rates, those that are not drawn go alone.
    docs = [(i, (a if i % 2 else "idiot moron " * 30) + " " + word(), "en", "s", 1) for i in range(60)] + [(1, "idiot moron " * 40, "en", "s", 1)]
    spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(2, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {x[1] for x in got(corpus_pipeline.mixed(spark, _rows(spark, docs), str(tmp_path)))}
    assert docs[1][1] in found and docs[-1][1] not in found


def test_empty_documents_and_clashing_columns_go_through(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, rank long, p double, class int, rate double, row_key long"
    for name, rows in (("none", []), ("few", [(i, f"some words number {i} of the many that this text has", "en", "s", 1, "x", 1, 0.5, 2, 3.0, 7) for i in range(40)])):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:3]:
            found = stage(spark, docs, f"{tmp_path}/{name}")
            assert found.columns == docs.columns
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_mixing_draws_repeatedly_where_rates_exceed_one(spark, tmp_path):
    r = random.Random(9)
    kinds = ["clean", "clean", "toxic", "low"]
    extra = {"clean": "garden river window letter", "toxic": "idiot moron scum filth", "low": "*** $$$ ### %%%"}
    rows = []
    for i in range(600):
        kind = extra[kinds[i % 4]].split()
        rows.append((i, " ".join(r.choice(kind) + str(r.randrange(9)) for _ in range(r.randrange(20, 60))), "en", "s", 1))
    docs = _rows(spark, rows)
    spark.createDataFrame([(i, int(i % 4 != 3), int(i % 4 == 2)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    times = {}
    for x in corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect():
        times[x.doc_id] = times.get(x.doc_id, 0) + 1
    rated = mixing.mix(docs, labels)
    found = rated.withColumn("copies", mixing.copies(rated)).collect()
    assert {x.doc_id: x.copies for x in found if x.copies} == times and max(times.values()) > 1
    assert all(x.copies in (int(x.rate), int(x.rate) + 1) for x in found)
    sums = [sum(times.get(x.doc_id, 0) * x.n_tokens * x.p[i] for x in found) for i in range(3)]
    assert abs(sum(sums) / sum(x.n_tokens for x in found) - 1) < 0.1
    gaps = {x.domain: x for x in mixing.drawn_shares(rated).collect()}
    for i, (name, target) in enumerate(mixing.TARGETS.items()):
        assert abs(sums[i] / sum(sums) - target) < 0.015
        assert abs(gaps[name].rate_share - target) < 2e-3 and abs(gaps[name].drawn_share - sums[i] / sum(sums)) < 1e-9
        assert abs(gaps[name].gap - (target - gaps[name].drawn_share)) < 1e-12
