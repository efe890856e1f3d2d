"""Toxicity, quality, language and decontamination against brute force and edge rows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkwright.llm import decontam, langid, quality, toxicity
from chunkwright.llm.queries import fold

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30000), (None, "one two"), (5, "same text here"), (5, "same text here"), (6, "!!! ... ###")]


def brute_segments(scores):
    """Ruzzo and Tompa's definition: the best segment, then the same on either side of it."""
    if not len(scores):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    best = max(((total[j] - total[i], -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    _, _, _, i, j = best
    return brute_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(scores[j:])]


def test_segments():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = np.round(rng.normal(-0.2, 1, rng.integers(0, 14)), 3) + rng.random() * 1e-6
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute_segments(s)


@pytest.fixture(scope="module")
def toxic_model(spark):
    rng = np.random.default_rng(1)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        own = list(rng.choice(plain, 40))
        if i % 4 == 0:
            own[10:13] = ["vile", "rotten", "vile"]
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), fold(3) != 1), docs


def test_toxicity(spark, toxic_model, docs_of):
    model, docs = toxic_model
    got = {r["doc_id"]: r for r in toxicity.assess(docs, model).collect()}
    assert all((got[i]["predicted"] == 1) == (i % 4 == 0) for i in range(400))
    text = docs.where("doc_id = 0").first()["text"]
    p = got[0]["passages"][0]
    assert "vile rotten vile" in text.encode()[p["begin"] : p["end"]].decode()
    odd = docs_of([*ODD, (7, "so vile rotten vile people")])
    rows = toxicity.assess(odd, model).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in rows) and sum(r["predicted"] for r in rows) == 1
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert toxicity.assess(odd.limit(0), model).count() == 0


def test_scan_by_brute_force(toxic_model):
    """Scores and passages of whole texts from the model's weights, token by token."""
    model, _ = toxic_model
    key = lambda t: int(toxicity.tokens(*pair(t))[3][0])
    pair = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
    stem = lambda t: int(toxicity.stems(pair(t)[0], np.array([0]), np.array([len(t.encode())]))[0])
    weights, begins = dict(zip(model.hashes.tolist(), model.weights, strict=True)), dict(zip(model.stems.tolist(), model.stem_weights, strict=True))
    rng = np.random.default_rng(6)
    words = ["vile", "rotten", "Rottenish", "VILE", "w1", "w2", "w150", "é", "x"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 25))) + str(rng.choice(["", "!", " ?é."])) for _ in range(150)]
    x, found = model.scan(pa.array(texts))
    for i, t in enumerate(texts):
        at = [(m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", t.encode())]
        own = [t.encode()[a:b].decode() for a, b in at]
        score = np.array([(weights.get(key(w)) or begins.get(stem(w), 0.0)) - toxicity.DRIFT for w in own])
        sums = [(a, b, model.decay * score[a:b].sum() - np.log(model.scale * len(own) / toxicity.EXPECT)) for a, b in brute_segments(score)]
        want = [(at[a][0], at[b - 1][1], e) for a, b, e in sums if e > 0]
        assert [f[:2] for f in found[i]] == [w[:2] for w in want] and np.allclose([f[2] for f in found[i]], [w[2] for w in want])
        assert np.allclose(x[i], [np.log1p(max(w[2] for w in want)), np.log1p(sum(w[2] for w in want))] if want else 0)
    assert any(found) and begins and weights


def test_chance_parameters(toxic_model):
    """lambda solves its equation; K makes as many chance rows as there are: of these clean rows none has a passage."""
    model, docs = toxic_model
    values, shares = np.array([2.0, -0.5, -1.0]), np.array([0.05, 0.75, 0.2])
    assert abs((shares * np.exp(toxicity._decay(values, shares) * values)).sum() - 1) < 1e-6
    assert 0 < model.scale < 1 and model.decay > 0
    clean = [r["n"] for r in toxicity.assess(docs, model).where("doc_id % 4 <> 0").select(F.size("passages").alias("n")).collect()]
    assert sum(n > 0 for n in clean) <= 0.1 * len(clean)


def test_few_labels_and_repeated_identifiers(spark):
    """A few dozen labels are enough for scores that differ; of an identifier with very many rows one is learned from."""
    rng = np.random.default_rng(7)
    plain = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*rng.choice(plain, 30), *(["vile"] * 2 if i % 6 == 0 else [])])) for i in range(60)]
    docs = spark.createDataFrame(rows + [(1, rows[1][1])] * 500 + [(1, f"other {k}") for k in range(500)], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in toxicity.assess(docs, model).collect()}
    assert min(got[i] for i in range(0, 60, 6)) > 0.5 > max(got[i] for i in range(60) if i % 6)


def test_toxicity_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(docs_of(ODD), none, F.lit(True))
    assert {r["predicted"] for r in toxicity.assess(docs_of(ODD), model).collect()} == {0}
    one_kind = spark.createDataFrame([(5, 1), (None, 0), (2, None)], "doc_id bigint, toxic int")
    assert toxicity.assess(docs_of(ODD), toxicity.fit(docs_of(ODD), one_kind, F.lit(True))).count() == len(ODD)


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)]


def test_quality_counts():
    texts = [t for _, t in ODD] + ["a b c d e f a b c d e\na b\na b\n\n é#|ü \x0b x", "\n\n", "x\n", "x\nx", " lead", "trail ", "ä b c"]
    s = quality.statistics(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [int(s[c][i]) for c in quality.COUNTS] == brute_counts(t), repr(t)[:60]


def test_quality(spark, docs_of):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(300):
        own = [f"w{k}" for k in rng.integers(0, 999, 50)]
        if i % 3 == 0:
            own = [w + "###" for w in own]
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 3 != 0)))
    got = quality.judge(docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert all(r["kept"] == (r["doc_id"] % 3 != 0) for r in got)
    odd = quality.judge(docs_of(ODD), spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert len(odd) == len(ODD) and sum(r["kept"] for r in odd) == 0
    assert quality.judge(docs_of([]), spark.createDataFrame(labels, "doc_id bigint, quality int")).count() == 0


def test_whole_query_by_brute_force(spark, docs_of):
    """Counts by plain Python, the verdict by walking each tree node by node."""
    rng = np.random.default_rng(9)
    rows = [(i, "\n".join(" ".join(str(w) for w in rng.choice(["ab", "c#d", "Efg", "12", "é!", "|"], rng.integers(0, 9))) for _ in range(rng.integers(0, 12)))) for i in range(120)]
    labels = spark.createDataFrame([(i, int(t.count("#") < 6)) for i, t in rows if i % 5], "doc_id bigint, quality int")
    docs = docs_of([*ODD[:4], *rows])
    model = quality.train(docs, labels)

    def walk(x):
        total = model.bias
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] if x[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        return 1 / (1 + np.exp(-total))

    got = quality.judge(docs, labels)
    assert got.columns[:8] == ["doc_id", *quality.COUNTS, "base_failed", "kept"]
    for r in got.collect():
        t = [t for i, t in [*ODD[:4], *rows] if i == r["doc_id"] and brute_counts(t) == [r[c] for c in quality.COUNTS]][0]
        x = quality.statistics(pa.array([t], pa.string()))["features"][0]
        n, repeated = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n)
        assert abs(r["score"] - walk(x)) < 1e-12 and r["kept"] == (not r["base_failed"] and walk(x) >= 0.5)


def test_repeated_identifiers_fit_once(spark, docs_of):
    """More rows of one labelled identifier than the bound: each identifier is fitted on once, none is lost."""
    rows = [(1, f"text number {k} of one document with words enough") for k in range(50)] + [(i, "bad ### ### ### " * 5 if i % 2 else "fine words of a good text here " * 4) for i in range(2, 42)]
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1) for i in range(1, 42)], "doc_id bigint, quality int")
    model = quality.train(docs_of(rows), labels, bound=41)
    bad, good = (quality.statistics(pa.array([t]))["features"] for t in (rows[51][1], rows[50][1]))
    assert model.score(bad)[0] < 0.5 < model.score(good)[0]


@pytest.mark.parametrize("texts", [[], [None], [""], [None, "", None], [" "], ["", "a"], ["a", ""]])
def test_kernels_on_empty_columns(texts, toxic_model):
    """A slice may hold nothing but empty texts."""
    from chunkwright.llm import order_minhash
    from chunkwright.llm.tokens import WordEncoder

    col = pa.array(texts, pa.string())
    assert quality.statistics(col)["features"].shape == (len(texts), len(quality.FEATURES))
    assert len(toxic_model[0].scan(col)[0]) == len(list(langid.vectors(col))) == len(order_minhash.sketches(col)) == len(order_minhash.brief(col)) == len(texts)
    assert len(WordEncoder().encode(col)[1]) == len(texts) + 1
    assert decontam.Items.of([1], ["some words of an item"], {}).hits(col) == []


def test_monotone_trees():
    rng = np.random.default_rng(3)
    x = rng.random((2000, len(quality.FEATURES)))
    y = (x[:, 2] + 0.3 * rng.normal(size=2000) > 0.5).astype(float)  # against the constraint on symbol_share
    model = quality.fit(x, y)
    probe = np.repeat(x[:50], 20, axis=0)
    probe[:, 2] = np.tile(np.linspace(0, 1, 20), 50)
    assert (np.diff(model.score(probe).reshape(50, 20), axis=1) <= 1e-12).all()


def test_language(spark, docs_of):
    en, fr = "the house and the garden with many old trees ", "la maison et le jardin avec beaucoup de vieux arbres "
    rows = [(i, (en if i % 2 else fr) * (1 + i % 4), "en" if i % 2 else "fr") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, fold(4) != 2)
    got = {r["doc_id"]: r["nearest"] for r in langid.identify(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    odd = {(r["doc_id"], r["nearest"]): r["score"] for r in langid.identify(docs_of(ODD), model).collect()}
    assert odd[1, "und"] == odd[2, "und"] == odd[3, "und"] == odd[6, "und"] == 0
    assert all(0 <= s <= 1 for s in odd.values())
    far = langid.identify(docs_of([(1, "zzqq xxkk wwvv jjqq")]), model).first()
    assert far["rejected"] and far["lang"] == "und" and far["nearest"] in ("en", "fr")
    empty = langid.fit(docs.limit(0), F.lit(True))
    assert {r["nearest"] for r in langid.identify(docs_of(ODD), empty).collect()} == {"und"}


def test_language_by_brute_force(spark, docs_of):
    """The nearest centroid of each text by plain sums over its trigrams, and what is farther than the sample's own texts."""
    said = {"en": "the house and a garden with many old trees near water", "fr": "la maison et le jardin avec beaucoup de vieux arbres près", "de": "das haus und der garten mit vielen alten bäumen öde Überfluß"}
    rng = np.random.default_rng(10)
    rows = [(i, " ".join(rng.choice(said[lang].split(), rng.integers(1, 40))), lang) for i in range(240) for lang in [list(said)[i % 3]]]
    docs = spark.createDataFrame(rows + [(999, rows[0][1], "en")] * 300, "doc_id bigint, text string, lang string").repartition(3)
    model = langid.fit(docs, F.lit(True), per_lang=60)
    dims = len(model.idf)
    far = 0
    for r in langid.identify(docs.where("doc_id < 240"), model).collect():
        raw = f" {rows[r['doc_id']][1]} ".encode()
        # ASCII and Latin-1 capitals in lower case, other ASCII than letters as spaces
        low = bytearray(b + 32 if 65 <= b < 91 else b if b > 127 or 97 <= b < 123 else 32 for b in raw)
        for k in range(1, len(raw)):
            if raw[k - 1] == 0xC3 and 0x80 <= raw[k] <= 0x9E:
                low[k] += 32
        grams = Counter(bytes(low[k : k + 3]) for k in range(len(low) - 2))
        tf = Counter()
        for g, n in grams.items():
            if g != b"   ":
                tf[(int.from_bytes(g, "little") * 2654435761 % (1 << 32)) >> 18] += n
        v = {k: np.log1p(n) * model.idf[k] for k, n in tf.items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        sims = [sum(x * model.centroids[k, c] for k, x in v.items()) / norm for c in range(len(model.langs))]
        best = int(np.argmax(sims))
        assert r["nearest"] == model.langs[best] and abs(r["score"] - sims[best]) < 1e-4 and max(tf) < dims
        far += r["rejected"]
        assert r["rejected"] == (r["score"] < model.reach[best]) and r["lang"] == ("und" if r["rejected"] else r["nearest"])
    assert 0 < far < 24
    assert langid.identify(docs_of([]), model).count() == 0


def test_more_languages_than_ever(spark):
    """No language vanishes, however many there are."""
    rows = [(i, " ".join(chr(97 + i // 26**e % 26) * 4 for e in range(3)), f"l{i}") for i in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.lit(True), centroids=1)
    assert len(set(model.langs)) == 1100


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(4)
    for _ in range(100):
        a, b = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(1, 15))
        score, begin, end = decontam.align(a, b)
        assert score == brute_align(a, b)
        assert not score or brute_align(a, b[begin:end]) == score


def test_decontamination(spark, docs_of):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(5)]
    prose = [word() for _ in range(300)]
    noise = lambda: " ".join(rng.choice(prose, 60))
    edited = items[1][1].split()
    edited[::7] = ["changed"] * len(edited[::7])
    rows = [(i, noise()) for i in range(40)]
    rows += [(100, f"{noise()} {items[0][1].upper()} {noise()}"), (101, f"{noise()} {' '.join(edited)}."), (102, items[2][1]), (102, items[2][1]), (103, f"{items[3][1]} {items[4][1]}"), *ODD]
    bench = spark.createDataFrame([*items, (9, None), (10, ""), (None, items[0][1])], "item_id bigint, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_of(rows), bench).collect())
    assert got == Counter({(100, 0): 1, (100, None): 1, (101, 1): 1, (102, 2): 2, (103, 3): 1, (103, 4): 1})
    kept = decontam.clean(docs_of(rows), bench)
    assert kept.count() == 40 + len(ODD) and kept.columns == docs_of(rows).columns
    assert decontam.contaminated(docs_of(rows), bench.limit(0)).count() == 0
    assert decontam.contaminated(docs_of([]), bench).count() == 0


def test_items_without_rare_words_are_found_word_for_word(spark, docs_of):
    filler = "to be or not hello world and so on " * 400  # every word is common
    docs = docs_of([(1, "hello world"), (2, "say to be or not to be now"), (3, filler), (4, "hello there world"), (5, None)])
    benchmark = spark.createDataFrame([(1, "hello world"), (2, "to be or not to be"), (3, ""), (4, None)], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"], r["score"]) for r in decontam.contaminated(docs, benchmark).collect())
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (3, 1, 1.0)]
    assert sorted(r["doc_id"] for r in decontam.clean(docs, benchmark).collect()) == [4, 5]
