"""Line dedup, BPE, quality rules, sharding, mixing and language ID against plain versions and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quillwork.llm import bpe, hashed, langid, line_dedup, mixing, quality, sharding

ODD = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "x"), (None, "no id here at all"), (5, "é" * 3000 + "\n" + "long " * 20000), (6, "same line of words that is long enough to be judged here"), (6, "same line of words that is long enough to be judged here")]
CLASH = "doc_id long, text string, rank long, key int, lang string, source string, digest string, quality_p double"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, 1, 2, None, None, "x", 0.1) for d, t in ODD], CLASH).repartition(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocab = {"en": "the of and that with from this have".split(), "fr": "le la les des une dans pour avec".split()}
    rows = []
    for i in range(240):
        lang = "en" if r.random() < 0.6 else "fr"
        lines = [" ".join(r.choice(vocab[lang]) + r.choice(["", "s", "ed", "x"]) for _ in range(r.randrange(4, 30))) for _ in range(r.randrange(1, 6))]
        if r.random() < 0.3:
            lines.insert(0, "The  licence line of these texts is this and it is long")
        if r.random() < 0.2:
            lines.append(lines[0])
        if i % 6 == 1:
            lines = [x.replace(" ", "*** ") + "%%%" for x in lines]
        if i % 6 == 2:
            lines = [(x + " ") * 6 for x in lines]
        rows.append((i, "\n".join(lines), lang, f"src{i % 4}"))
    return rows


def test_lines_against_plain_version(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: (r.n_units, r.n_removed, r.removed_spans, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    seen = set()
    for d, text, *_ in sorted(texts):
        at, kept, spans = 0, [], []
        for line in text.split("\n"):
            norm = re.sub(r"[ \t\x0B\f\r\n]+", " ", line).strip(" ").lower()
            if norm and norm in seen:
                spans.append(f"{at}-{at + len(line)}")
            else:
                kept.append(line)
                seen.add(norm)
            at += len(line) + 1
        assert got[d] == (text.count("\n") + 1, len(spans), ",".join(spans), "\n".join(kept))


def test_a_floor_leaves_short_lines_alone(spark):
    rows = [(1, "a b c\nd e"), (2, "a b c\nd e\na  B c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, least_words=3).collect()} == {1: "a b c\nd e", 2: "d e"}


def test_short_lines_are_deduplicated_without_a_floor(spark, tmp_path):
    rows = [(1, "Chapter one\n\ntext of the first\n \t"), (2, "chapter  ONE\n\nmore"), (3, "more\nmore\nmore"), (None, "text of the first\nlast"), (4, None), (5, ""), (6, "Chapter one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.removed_spans, r.text) for r in line_dedup.dedup_lines(docs, least_words=1).collect()}
    assert got == {1: (0, "", rows[0][1]), 2: (1, "0-12", "\nmore"), 3: (3, "0-4,5-9,10-14", ""), None: (1, "0-17", "last"), 4: (0, "", ""), 5: (0, "", ""), 6: (1, "0-11", "")}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns = ("doc_id", "n_units", "n_removed", "removed_spans", "text")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = db.execute(f"SELECT {', '.join(columns)} FROM ({line_dedup.OP2_WHOLE_SQL})").fetchall()
    assert sorted(map(tuple, line_dedup.op2_whole_query(spark, str(tmp_path)).select(*columns).collect()), key=str) == sorted(want, key=str)


def test_lines_on_odd_rows(odd, empty):
    got = sorted(((r.doc_id, r.n_units, r.n_removed) for r in line_dedup.dedup_lines(odd).collect()), key=str)
    assert got == sorted([(1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 1, 0), (None, 1, 0), (5, 2, 0), (6, 1, 0), (6, 1, 1)], key=str)
    assert line_dedup.dedup_lines(empty).collect() == []


def test_rows_that_share_an_id_or_lack_one_are_documents_of_their_own(spark, tmp_path):
    rows = [(None, "one alpha\ntwo beta"), (None, "unique gamma\nunique delta"), (1, "two beta"), (5, "x\ntwo beta"), (5, "y\nonly here"), (None, "one alpha\ntwo beta")]
    want = [(None, 2, 1, "10-18", "one alpha"), (None, 2, 0, "", "unique gamma\nunique delta"), (1, 1, 0, "", "two beta"), (5, 2, 1, "2-10", "x"), (5, 2, 0, "", "y\nonly here"), (None, 2, 2, "0-9,10-18", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns = ("doc_id", "n_units", "n_removed", "removed_spans", "text")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({line_dedup.OP2_SQL})").fetchall(), key=str) == sorted(want, key=str)
    for found in (line_dedup.dedup_lines(docs), line_dedup.op2_query(spark, str(tmp_path))):
        assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_the_sample_of_labelled_rows_has_a_true_bound(spark):
    docs = spark.createDataFrame([(7, f"text {i} of one id") for i in range(400)] + [(8, "the same")] * 50 + [(9, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (9, 0), (None, 1), (7, None)], "doc_id long, label int")
    sample, counts = hashed.labelled_sample(docs, labels, 10)
    assert counts == {0: 2, 1: 2} and Counter(r["label"] for r in sample) == {1: 10, 0: 2}
    assert hashed.labelled_sample(docs, labels.limit(0), 10) == ([], {})


def test_bpe_is_what_tiktoken_does(spark, odd, empty, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    more = ["a\r\n b", "🙂日本語 ½", "<|endoftext|>", "\x00\x7f", "don't I'LL", " " * 50 + "x"]
    rows = [(d, t) for d, t, *_ in texts] + [(1000 + i, t) for i, t in enumerate(more)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in bpe.round_trip(docs, path).collect():
        text = dict(rows)[r.doc_id]
        ids = own.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert back == dict(rows)
    nothing = hashlib.sha256(b"").hexdigest()
    odd_rows = {r.doc_id: r for r in bpe.round_trip(odd, path).collect()}
    assert (odd_rows[1].n_tokens, odd_rows[1].ids_sha256, odd_rows[1].decoded_sha256) == (0, nothing, nothing)
    assert bpe.round_trip(empty, path).collect() == [] and bpe.encode(empty, path).collect() == []


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_base_counts_and_verdict(spark, odd, empty, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 6 != 1), 0) for i in range(0, 240, 2)] + [(i, int(i % 6 != 1), 0) for i in range(1, 120, 6)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    right = total = 0
    for r in quality.quality_rules(docs, labels).collect():
        base = plain_base(texts[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        if not r.base_failed and r.doc_id % 2 and r.doc_id > 120:  # rows without labels
            total += 1
            right += r.kept == (r.doc_id % 6 != 1)
        assert not (r.base_failed and r.kept)
    assert total > 5 and right >= 0.9 * total
    for r in quality.quality_rules(odd, labels.limit(0)).collect():
        assert r.quality_p is None and r.kept == (not r.base_failed)
        if r.doc_id in (1, 2, 3):
            assert (r.n_words, r.base_failed) == (0, True)
    assert quality.quality_rules(empty, labels).collect() == []


def test_probabilities_allow_for_wrong_labels():
    r = np.random.default_rng(5)

    def row(i):
        good = r.random() < 0.7
        wrong = r.random() < (0.05 if good else 0.2)
        numbers = np.unique(np.concatenate([r.integers(0, 200, 12), r.integers(300, 340, 12) + 40 * good])).astype(np.uint16)
        values = np.full(len(numbers), 1 / len(numbers), np.float32)
        return {"label": int(good != wrong), "fold": i % 5, "numbers": numbers.tobytes(), "values": values.tobytes()}

    rows = [row(i) for i in range(3000)]
    fit, hidden = rows[:2000], rows[2000:]
    model = hashed.Model(fit, dict(Counter(x["label"] for x in fit)), level=True)
    held = hashed._Sample(hidden, model.classes)
    raw, good = held.scores(model.weights) + model.bias, held.target[:, 1]
    p, bare = model.calibrated(raw)[:, 1], hashed._shares(raw)[:, 1]
    for side in (p < 0.5, p >= 0.5):
        assert side.sum() > 200 and abs(p[side].mean() - good[side].mean()) < 0.06
    assert ((p - good) ** 2).mean() < 0.9 * ((bare - good) ** 2).mean()
    assert model.calibrated(np.array([[1e9, -1e9]]))[0, 0] < 0.99  # no text is beyond doubt


def plain_tree(points, parts, first=0):
    """Shard of each (x, y, weight): split along the widest side where the weights are nearest to their share."""
    if parts == 1:
        return {p[:2]: first for p in points}
    dim = max((0, 1), key=lambda d: (max(p[d] for p in points) - min(p[d] for p in points), -d))
    points = sorted(points, key=lambda p: p[dim])
    left_parts = -(-parts // 2)
    goal, sums = sum(p[2] for p in points) * left_parts / parts, [0]
    for p in points:
        sums.append(sums[-1] + p[2])
    cut = next(i for i, s in enumerate(sums) if s >= goal)
    if goal - sums[cut - 1] <= sums[cut] - goal:
        cut -= 1
    return plain_tree(points[:cut], left_parts, first) | plain_tree(points[cut:], parts - left_parts, first + left_parts)


@pytest.mark.parametrize("parts", [5, 16])
def test_kd_tree_is_the_plain_one_where_bins_tell_units_apart(spark, parts):
    r = random.Random(parts)
    xs, ys = r.sample(range(997), 400), r.sample(range(997), 400)
    xs[0], xs[1], ys[2], ys[3] = 0, 1000, 0, 1000  # both sides are as wide
    points = [(x, y, r.randrange(50, 60)) for x, y in zip(xs, ys, strict=True)]
    units = spark.createDataFrame([(i, w, x, y) for i, (x, y, w) in enumerate(points)], "unit long, weight long, x long, y long")
    got = {points[r.unit][:2]: r.shard for r in sharding.kd_leaves(units, ["x", "y"], parts, heavy=1e9).collect()}
    assert got == plain_tree(points, parts)


def test_shards_are_even_texts_stay_together_and_slots_are_gapless(spark, odd, empty, texts):
    # Sparse ids, one text in a third of all rows but less than a shard in bytes, copies of other texts.
    rows = [(i * 10**12, t, *x) for i, t, *x in texts] + [(7 + i * 10**9, "short hot text", "en", "src0") for i in range(180)] + [(3 * 10**15 + i, texts[i % 9][1], "fr", None) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    text = dict((r[0], r[1]) for r in rows)
    weight = Counter()
    for t in text.values():
        weight[t] += len(t.encode()) + 1
    for shards in (1, 6, 16):
        size, slots, where = Counter(), {}, {}
        for r in sharding.kd_shards(docs, shards=shards).collect():
            size[r["shard"]] += r["size"]
            slots.setdefault(r.shard, []).append(r.slot)
            where.setdefault(text[r.doc_id], set()).add(r.shard)
            assert (r["size"], r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()))
            assert (r.law, r.grown_shard, r.text_split) == ("bytes", None, False)
        assert sum(map(len, slots.values())) == len(rows) and sorted(size) == list(range(shards))
        assert max(size.values()) - min(size.values()) <= 2 * max(weight.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(s) == 1 for s in where.values())
    target = sum(size.values()) // 7
    found = Counter()
    for r in sharding.kd_shards(docs, target_bytes=target).collect():
        found[r.shard] += r["size"]
    assert sorted(found) == list(range(len(found))) and max(found.values()) <= target and len(found) <= 14


def test_a_text_that_outweighs_a_shard_is_split_and_odd_rows_are_dealt(spark, odd, empty, texts):
    rows = texts + [(1000 + i, texts[0][1] * 3, "en", "src0") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    size, split = Counter(), Counter()
    for r in sharding.kd_shards(docs, shards=8).collect():
        size[r.shard] += r["size"]
        split[r.text_split] += 1
    assert split == {True: 900, False: 240} and max(size.values()) - min(size.values()) < 0.2 * sum(size.values()) / 8
    found = sharding.kd_shards(odd, shards=4).collect()
    assert len(found) == len(ODD) and all(0 <= r.shard < 4 for r in found)
    assert len({r.shard for r in found if r.doc_id == 6}) == 1
    assert sharding.kd_shards(empty, shards=8).collect() == []
    with pytest.raises(ValueError, match="shards"):
        sharding.kd_shards(empty, shards=0)


def test_mixing_meets_its_targets(spark, odd, empty, texts):
    rows = [(i, t if i % 6 != 3 else t + "\nidiot moron idiot", *x) for i, t, *x in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 6 != 1), int(i % 6 == 3)) for i in range(200)], "doc_id long, quality int, toxic int")
    found = mixing.mix(docs, labels).collect()
    a = np.array([[r.n_tokens * p for p in r.p] for r in found])
    rate = np.array([r.rate for r in found])
    share = (rate @ a) / a.sum()
    assert (rate >= 0).all() and np.allclose(share, list(mixing.TARGETS.values()), rtol=1e-3)
    # Of all rates that meet the targets, those nearest to 1 are max(0, 1 - a x) for one x: the optimality conditions.
    x = np.linalg.lstsq(a[rate > 0], 1 - rate[rate > 0], rcond=None)[0]
    assert np.allclose(rate, np.maximum(0, 1 - a @ x), atol=1e-6)
    # Plain projected gradient, by small steps from the same start, ends no nearer to 1.
    b, goal = a / a.sum(), np.array(list(mixing.TARGETS.values()))
    r = np.ones(len(found))
    for _ in range(20000):
        r = np.maximum(0, r - b @ (r @ b - goal) / np.linalg.norm(b, 2) ** 2)
    assert np.allclose(r @ b, goal, rtol=1e-2) and ((rate - 1) ** 2).sum() <= ((r - 1) ** 2).sum() * 1.01
    with pytest.warns(UserWarning, match="missed"):
        none = mixing.mix(docs, labels, {**mixing.TARGETS, "unknown": 0.2}).collect()
    assert len(none) == len(found) and all(np.isfinite(x.rate) and x.rate >= 0 for x in none)
    assert {x.rate for x in mixing.mix(odd, labels.limit(0)).where("n_tokens = 0").collect()} == {1.0}
    assert mixing.mix(empty, labels).collect() == []


def test_language_id_on_held_out_rows_and_without_evidence(spark, odd, empty, texts):
    rows = [(i, t, None if i % 3 == 0 else lang, s) for i, t, lang, s in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    found = {r.doc_id: r for r in langid.of_documents(docs).collect()}
    held = [i for i in range(240) if i % 3 == 0]
    assert sum(found[i].language == texts[i][2] for i in held) >= 0.97 * len(held)
    assert all(r.kept for r in found.values())
    one = langid.of_documents(odd.drop("lang").withColumn("lang", odd["source"]))
    assert {(r.doc_id, r.kept) for r in one.collect() if r.doc_id in (1, 2, 3, 4)} == {(1, False), (2, False), (3, False), (4, True)}
    assert langid.of_documents(empty).collect() == []
    mixed = spark.createDataFrame([(1, "12 34", "en", "a"), (2, "the of and that", "en", "a"), (3, None, "fr", None), (4, "le la les des", "fr", "b")] * 3, "doc_id long, text string, lang string, source string")
    got = {(r.doc_id, r.language, r.kept) for r in langid.of_documents(mixed).collect()}
    assert {(1, "und", False), (3, "und", False)} <= got and len(langid.of_documents(mixed).collect()) == 12


def test_language_id_of_pages_uses_markup_suffix_and_host(spark):
    rows = [(i, f"http://h{i % 3}.example.{'fr' if i % 2 else 'com'}/x", f"<html lang=\"{'fr' if i % 2 else 'en'}\"><script>var the</script><p>{'le la les des une' if i % 2 else 'the of and that with'}</p>") for i in range(30)]
    rows += [(30, None, None), (31, "http://h1.example.fr/x", "<p>zz</p>")]
    found = {r.page_id: r for r in langid.of_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i].language == ("fr" if i % 2 else "en") for i in range(30))
    assert found[31].language == "fr" and (found[30].language, found[30].kept) == ("und", False)


def test_rare_languages_are_modelled_and_unknown_ones_rejected(spark):
    r = random.Random(12)
    vocab = {"en": "the of and that with from this have", "fr": "le la les des une dans pour avec", "de": "der die und das nicht ein zu ist", "fi": "hyv\u00e4\u00e4 yll\u00e4 ty\u00f6 mutta joka niin kuin kyll\u00e4"}
    text = lambda lang, n: " ".join(r.choice(vocab[lang].split()) for _ in range(n))
    rows = [(i, text("en" if i % 4 else "fr", 80), "en" if i % 4 else "fr-CA", f"s{i % 5}") for i in range(4000)]
    rows += [(5000 + i, text("de", 120), "de", "s1") for i in range(3)] + [(5003, text("de", 40), None, "s1")]
    rows += [(6000 + i, text("fi", 100), None if i else "fi", "s1") for i in range(4)]  # declared once, in too short a text
    rows[-4] = (6000, text("fi", 8), "fi", "s1")
    rows += [(7000, "\u2014 \u2014 \u2026 \u00ab\u00bb", "en", "s1"), (7001, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059 " * 9, None, "s1")]
    found = {x.doc_id: x for x in langid.of_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)).collect()}
    assert all(found[i].language == ("en" if i % 4 else "fr") and found[i].kept for i in range(4000))
    assert all(found[5000 + i].language == "de" and found[5000 + i].kept for i in range(4))
    assert [(found[i].language, found[i].kept) for i in (6001, 6002, 6003, 7000, 7001)] == [("und", False)] * 5


def plain_posteriors(rows):
    """Language ID in plain Python over (text, declared, host) rows: posterior of each language for each row."""
    grams = lambda t: [x for x in langid._grams([t.encode()])[0].tolist()]
    names = sorted({d for _, d, _ in rows if d})
    counts = {x: Counter() for x in names}
    for t, d, _ in rows:
        if d:
            counts[d].update(grams(t))
    every = sum(counts.values(), Counter())
    total = sum(every.values()) + 0.5 * langid.FEATURES
    like = lambda x, g: np.log((counts[x][g] + langid.SMOOTHING * (every[g] + 0.5) / total) / (sum(counts[x].values()) + langid.SMOOTHING))
    logs, fits = [], []
    for t, _, _ in rows:
        raw = np.array([sum(like(x, g) for g in grams(t)) for x in names])
        fits.append((int(raw.argmax()), raw.max(), len(grams(t))))
        logs.append(np.maximum((raw - raw.max()) * langid.TEMPER, -langid.TEXT_NATS))
    logs = np.array(logs)
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    own = {k: sum(f for j, f, _ in fits if j == k) / max(1, sum(n for j, _, n in fits if j == k)) for k in range(len(names))}
    known = np.array([f / n >= own[k] - langid.APART - langid.SHORT / n**0.5 for k, f, n in fits])
    p = np.array([soft(v) for v in logs]) * known[:, None]
    whole = p.sum(0) + 1
    base = whole / whole.sum()
    smooth = lambda own, wider: (own + langid.PRIOR_ROWS * wider) / (own.sum() + langid.PRIOR_ROWS)
    site = lambda h: ".".join(h.split(".")[-2:])
    out = []
    kinds = sorted({d for _, d, _ in rows if d})
    fell = {d: sum(q for q, row in zip(p, rows, strict=True) if row[1] == d) for d in kinds}
    for v, (_, d, h) in zip(logs, rows, strict=True):
        prior = base
        if h:
            prior = smooth(sum(q for q, row in zip(p, rows, strict=True) if row[2] and site(row[2]) == site(h)), base)
            prior = smooth(sum(q for q, row in zip(p, rows, strict=True) if row[2] == h), prior)
        v = v + np.log(prior)
        if d:
            v = v + np.log((fell[d] + 0.5) / np.maximum(0.5, sum(fell.values()) + 0.5 * len(kinds)))
        out.append(dict(zip(names, soft(v), strict=True)))
    return [x if k else {"und": 0.0} for x, k in zip(out, known, strict=True)]


def test_language_id_against_a_plain_version(spark):
    r = random.Random(13)
    vocab = {"en": "the of and that with from this have", "fr": "le la les des une dans pour avec", "nl": "de het een van en is dat met"}
    rows = []
    for i in range(90):
        lang = r.choice(list(vocab))
        words = [r.choice(vocab[lang if r.random() < 0.8 else "en"].split()) for _ in range(r.randrange(1, 12))]
        rows.append((" ".join(words), r.choice([lang, lang, "fr", None]), r.choice(["a.x.org", "b.x.org", "c.net", None])))
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "doc_id long, text string, said string, host string").repartition(3)
    want = plain_posteriors(rows)
    for x in langid.identify(docs, declared=docs.said, host=docs.host).collect():
        best = max(sorted(want[x.doc_id]), key=want[x.doc_id].get)
        assert x.language == best and abs(x.posterior - want[x.doc_id][best]) < 1e-9
    assert sum(x.language == "und" for x in langid.identify(docs, declared=docs.said, host=docs.host).collect()) < 5
