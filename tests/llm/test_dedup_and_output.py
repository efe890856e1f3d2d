"""Near-duplicates, repeated passages, packing, token tables, archives and page text against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkwright.llm import order_minhash, packing, sstable, suffix_dedup, warc
from chunkwright.llm.common import filesystem, work_dir
from chunkwright.llm.components import components
from chunkwright.llm.tokens import WordEncoder, vocabulary_path

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30000), (None, "one two"), (5, "same text here"), (5, "same text here"), (6, "!!! ... ###")]


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def near_rows():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = []
    for base in range(6):
        own = [word() for _ in range(200)]
        rows.append((base * 10, " ".join(own)))
        for k in range(1, 4):
            new = list(own)
            for p in rng.choice(200, 2, replace=False):
                new[p] = word()
            rows.append((base * 10 + k, " ".join(new)))
        rows.append((base * 10 + 4, " ".join(own)))
    rows += [(1000 + i, " ".join(word() for _ in range(100))) for i in range(30)]
    return rows


def test_near_duplicates(spark, docs_of, monkeypatch):
    monkeypatch.setattr(order_minhash, "SALT", 2)
    rows = near_rows()
    got = {r["doc_id"]: r for r in order_minhash.near_duplicates(docs_of(rows)).collect()}
    for i, _ in rows:
        assert got[i]["class_id"] == (i // 10 * 10 if i < 1000 else i)
    assert got[0]["n_copies"] == 2 and got[1]["n_verified"] >= 1 and got[1000]["n_verified"] == 0
    kept = order_minhash.one_of_each(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["class_id"] for r in got.values()})
    odd = order_minhash.near_duplicates(docs_of(ODD)).collect()
    assert len(odd) == len(ODD) and {r["class_id"] for r in odd if r["doc_id"] in (1, 2)} == {1}
    assert order_minhash.one_of_each(docs_of(ODD)).count() == 6
    assert order_minhash.near_duplicates(docs_of([])).count() == 0


@pytest.mark.parametrize("rest", [0, 200])
def test_failed_members_meet_again(spark, docs_of, monkeypatch, rest):
    """Two groups share a bucket: those far from its leader are still linked with each other."""
    monkeypatch.setattr(order_minhash, "REST", rest)
    monkeypatch.setattr(order_minhash, "sketches", lambda col, count=1, ell=1: [np.array([7], np.int64) for _ in range(len(col))])
    rows = [r for r in near_rows() if r[0] < 30]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs_of(rows)).collect()}
    assert all(got[i] == i // 10 * 10 for i, _ in rows)


def brute_classes(rows):
    """Least doc_id of each text's class, and its number of similar texts, by comparing all pairs."""
    lists = order_minhash._shingles_of(pa.array([t for _, t in rows]))
    root, near = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if order_minhash.aligned(lists[i], lists[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
                near.update((i, j))
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}, {rows[i][0]: near[i] for i in range(len(rows))}


def test_short_texts_are_exact(spark, docs_of):
    """Texts of few words and the same with words added or changed, whose sketches differ in length or symbols."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = []
    for n in [*range(1, 32)] * 4:
        own = [word() for _ in range(n)]
        rows.append((len(rows), " ".join(own)))
        rows.append((len(rows), " ".join([word(), *own] if len(rows) % 4 == 1 else [*own, word()])))
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs_of(rows)).collect()}
    brief = {i for i, t in rows if len(t.split()) <= 29}
    want, _ = brute_classes(rows)
    assert any(want[i] != i and len(t.split()) in (9, 10) for i, t in rows)
    assert {i: got[i] for i in brief} == {i: want[i] for i in brief}


@pytest.mark.parametrize("rest, leaders", [(0, 4), (0, 1), (6, 4), (200, 4)])
def test_links_through_passed_members(spark, docs_of, monkeypatch, rest, leaders):
    """Chains in one bucket whose ends are similar to the middle only: every leader leaves a link behind it."""
    monkeypatch.setattr(order_minhash, "REST", rest)
    monkeypatch.setattr(order_minhash, "LEADERS", leaders)
    monkeypatch.setattr(order_minhash, "SALT", 3)
    monkeypatch.setattr(order_minhash, "SHORT", 0)
    monkeypatch.setattr(order_minhash, "sketches", lambda col, count=1, ell=1: [np.array([7], np.int64) for _ in range(len(col))])
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(3):
        words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(150)]
        rows += [(len(rows) + k, " ".join(words[k * 8 : k * 8 + 80])) for k in range(7)]
    want, _ = brute_classes(rows)
    assert sorted(set(want.values())) == [0, 7, 14]
    assert {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs_of(rows)).collect()} == want


def test_recall_against_all_pairs(spark, docs_of):
    """Many pairs of every similarity from 0.6 on, most of longer texts: those of 0.8 or more are in one class, the others apart."""
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = []
    for _ in range(400):
        own = [word() for _ in range(int(rng.integers(20, 250)))]
        other = list(own)
        for at in sorted(rng.integers(0, len(own), max(1, int(len(own) * rng.uniform(0.005, 0.05)))), reverse=True):
            kind = rng.integers(3)
            other[at : at + (kind != 0)] = [] if kind == 1 else [word()]  # a word more, one less, or another one
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(other))]
    lists = order_minhash._shingles_of(pa.array([t for _, t in rows]))
    similarity = [order_minhash.aligned(lists[k], lists[k + 1], 0.5) for k in range(0, len(rows), 2)]
    near = [k for k, s in enumerate(similarity) if s >= 0.8]
    assert len(near) > 100 and sum(0.8 <= s < 0.85 for s in similarity) > 25 and len(near) < 390
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs_of(rows)).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in near) >= 0.995 * len(near)
    assert all(got[2 * k + 1] == 2 * k + 1 for k, s in enumerate(similarity) if s < 0.8) and all(got[2 * k] == 2 * k for k in range(400))


def test_unlike_members_of_one_bucket(spark, docs_of, monkeypatch):
    """Texts of one template that share most of what a sketch sees, but no pair is similar save a few: rounds stay few, links stay."""
    monkeypatch.setattr(order_minhash, "REST", 10)
    monkeypatch.setattr(order_minhash, "SHORT", 0)
    monkeypatch.setattr(order_minhash, "sketches", lambda col, count=1, ell=1: [np.array([7], np.int64) for _ in range(len(col))])
    monkeypatch.setattr(order_minhash, "LEADERS", 2)
    seen = []
    verify = order_minhash._verify
    monkeypatch.setattr(order_minhash, "_verify", lambda *a: seen.append(1) or verify(*a))
    rng = np.random.default_rng(14)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    common = [word() for _ in range(50)]
    rows = []
    for k in range(150):
        own = [word() for _ in range(60)]
        rows.append((k, " ".join(common + own)))
        if k % 10 == 0:
            rows.append((1000 + k, " ".join(common + own[:-1] + ["end"])))
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs_of(rows)).collect()}
    assert got == {i: i % 1000 for i, _ in rows} and len(seen) <= 3  # two rounds of leaders, and one in the finer buckets


def test_index_finds_what_shares_enough(monkeypatch):
    """All pairs that alignment passes are candidates, and none that share too little; over several indexes and cut counts."""
    rng = np.random.default_rng(3)
    lists = [rng.permutation(80)[: rng.integers(1, 80)].astype(np.uint64) for _ in range(60)]
    lists += [np.concatenate([x[: len(x) - len(x) // 20], [np.uint64(900)]]) for x in lists[:30]] + [np.zeros(0, np.uint64)]
    for most in (1, 100, 1 << 20):
        monkeypatch.setattr(order_minhash, "INDEX", most)
        held = order_minhash.Held(lists)
        for own in lists:
            shared = [len(np.intersect1d(own, x)) for x in lists]
            assert held.near(own, 0.8) == [k for k, (c, x) in enumerate(zip(shared, lists, strict=True)) if c and c >= 0.8 * (len(x) + len(own) - c)]
    assert order_minhash.Held([]).near(lists[0], 0.8) == []


def test_packed_shingles_are_the_texts():
    texts = pa.array([None, "", " ", "eins zwei", "a b c d e f g a b c d e f g", "É è " * 9])
    batch = pa.RecordBatch.from_arrays([pa.array([b"%d" % k for k in range(6)]), texts], ["cls", "text"])
    own = pa.concat_arrays([b.column(1) for b in order_minhash._packed(iter([batch]))])
    assert [x.tolist() for x in order_minhash._listed(own)] == [x.tolist() for x in order_minhash._shingles_of(texts)]


def test_aligned():
    a = np.arange(100, dtype=np.uint64)
    assert order_minhash.aligned(a, a) == 1
    assert order_minhash.aligned(a, np.concatenate([a[:50], a[55:]])) == 95 / 100
    assert order_minhash.aligned(a, np.concatenate([a[50:], a[:50]])) < 0.8
    assert order_minhash.aligned(a, a[:70]) == 0


def brute_removed(texts, length, keep):
    """Marks of removed bytes by counting every window."""
    where = defaultdict(list)
    for i, b in enumerate(texts):
        for k in range(len(b) - length + 1):
            where[b[k : k + length]].append((i, k))
    marks = [bytearray(len(b)) for b in texts]
    for places in where.values():
        for i, k in places if keep == "none" and len(places) > 1 else places[1:] if keep == "first" else []:
            marks[i][k : k + length] = b"\1" * length
    return marks


def repeat_rows():
    rng = np.random.default_rng(2)
    prose = lambda n: "".join(rng.choice(list("abcdeé \n"), n))
    shared, longer = prose(70), prose(400)
    rows = [(i, prose(rng.integers(20, 300))) for i in range(20)]
    rows += [(100 + i, prose(40) + shared + prose(60)) for i in range(25)]
    rows += [(200 + i, prose(30) + longer[i * 20 : 300 + i * 7] + prose(10)) for i in range(6)]
    rows += [(300, longer), (301, longer), (302, "ab" * 300), (303, "ab" * 40 + prose(50)), (304, shared + shared), (305, prose(50) + "z" * 90)]
    return rows


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("most", [3, 3000])
def test_repeats(spark, docs_of, monkeypatch, keep, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rows = repeat_rows()
    texts = [t.encode() for _, t in rows]
    want = brute_removed(texts, 48, keep)
    for r in suffix_dedup.removals(docs_of(rows), 48, keep).collect():
        i = [k for k, (d, _) in enumerate(rows) if d == r["doc_id"]][0]
        marks = bytearray(len(texts[i]))
        for s in r["removed"]:
            marks[s["begin"] : s["end"]] = b"\1" * (s["end"] - s["begin"])
        assert marks == want[i], r["doc_id"]
        assert (r["n_bytes"], r["n_removed"]) == (len(texts[i]), sum(marks))
        assert r["kept_sha256"] == hashlib.sha256(bytes(c for c, x in zip(texts[i], marks, strict=True) if not x)).hexdigest()


def test_repeats_odd_rows(spark, docs_of):
    got = {r["doc_id"]: r for r in suffix_dedup.removals(docs_of(ODD), 400).collect()}
    assert got[1]["n_bytes"] == 0 and got[4]["n_removed"] == got[4]["n_bytes"] == 150000 and got[5]["n_removed"] == 0
    rest = suffix_dedup.without_repeats(docs_of([*ODD, *repeat_rows()]), 48, "first")
    assert rest.columns == docs_of(ODD).columns and rest.where("doc_id = 1").first()["text"] is None
    assert rest.where("doc_id = 300").first()["text"] != "" and rest.where("doc_id = 301").first()["text"] == ""
    assert suffix_dedup.removals(docs_of([]), 400).count() == 0


def test_factors_by_brute_force():
    """Previous and next factors, up to a length, of every position of random texts."""
    rng = np.random.default_rng(11)
    for length in (1, 3, 8, 13):
        text = rng.integers(0, 2, 120).astype(np.uint8) if length > 3 else rng.integers(0, 9, 60).astype(np.uint8)
        raw = text.tobytes()
        starts = np.arange(len(text) - length + 1)
        order, ranks = suffix_dedup.equal_windows(text, starts, length)
        previous, following = np.zeros(len(starts), int), np.zeros(len(starts), int)
        previous[order] = suffix_dedup.previous_factors(order, ranks, length)
        following[order] = suffix_dedup.next_factors(order, ranks, length)
        at = lambda i: raw[i : i + length]
        assert [p >= length for p in previous] == [any(at(j) == at(i) for j in range(i)) for i in starts]
        assert [p >= length for p in following] == [any(at(j) == at(i) for j in range(i + 1, len(starts))) for i in starts]
        if length > 3:
            assert order.tolist() == sorted(order.tolist(), key=lambda i: (at(i), i)) and previous.any() and not previous.all()


def test_only_windows_that_meet_are_sorted():
    """Of a block's windows those with an equal one go to the suffix sort, no others."""
    rng = np.random.default_rng(21)
    text = rng.integers(0, 256, 3000).astype(np.uint8)
    text[2000:2300] = text[500:800]
    for length in (1, 5, 48, 240):
        starts = np.concatenate([np.arange(0, 1400 - length + 1), np.arange(1400, 3000 - length + 1)])
        held = Counter(text[i : i + length].tobytes() for i in starts)
        want = [k for k, i in enumerate(starts.tolist()) if held[text[i : i + length].tobytes()] > 1]
        assert suffix_dedup._met(text, starts, length).tolist() == want == sorted(suffix_dedup.equal_windows(text, starts, length)[0].tolist())
        assert len(suffix_dedup.equal_windows(text, starts[:1], length)[0]) == 0


def test_sketch_keys_are_made_for_all_texts_at_once(monkeypatch):
    rng = np.random.default_rng(22)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd", "ee"], n)) for n in [*range(40), *range(100, 160)]]
    alone = [order_minhash.sketches(pa.array([t]))[0].tolist() for t in texts]
    calls, mix = [], order_minhash.mix
    monkeypatch.setattr(order_minhash, "mix", lambda x: (calls.append(1), mix(x))[1])
    together = order_minhash.sketches(pa.array(texts))
    assert [k.tolist() for k in together] == alone and len(calls) < len(texts)


@pytest.mark.parametrize("most", [2, 3000])
def test_repeated_rows_keep_their_first(spark, docs_of, monkeypatch, most):
    """A row that occurs twice, beside others that share some of its passages: as the first holder it loses nothing."""
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rng = np.random.default_rng(12)
    prose = lambda n: "".join(rng.choice(list("abcdefg "), n))
    one, two = prose(80), prose(80)
    rows = [(1, one + prose(30) + two), (1, None), (2, prose(20) + one), (3, two + prose(25)), (3, one[:60] + prose(9)), (4, prose(200)), (6, one), (7, "")]
    rows += [rows[0], rows[5]]
    docs = docs_of(rows)
    got = sorted(((r["doc_id"], r["text"]) for r in suffix_dedup.without_repeats(docs, 48).collect()), key=repr)
    order = sorted({(i, t) for i, t in rows if t}, key=lambda r: r[0])
    marks = {}
    texts = [t.encode() for _, t in order]
    for (i, t), own in zip(order, brute_removed(texts, 48, "first"), strict=True):
        marks[i, t] = bytes(c for c, m in zip(t.encode(), own, strict=True) if not m).decode()
    same = sorted(((i, marks.get((i, t), t)) for i, t in rows), key=repr)
    assert [g for g in got if g[0] != 3] == [w for w in same if w[0] != 3]  # of document 3 the hash of the text decides which row is first
    left = suffix_dedup.without_repeats(docs, 48, emptied=False)
    assert left.where("doc_id = 6").count() == 0 and left.where("doc_id = 7 or text is null").count() == 2 and left.count() == len(rows) - 1


def test_regions_made_to_collide(spark, docs_of):
    """Texts of 400 bytes that differ and had one 64-bit region hash lose nothing; their copies fall by their bytes."""
    fill = "".join(np.random.default_rng(0).choice(list("abcdefgh "), 400))
    one, two = (fill[:192] + x + fill[208:] for x in ("vgcxtefxunpttbai", "sjiwkwghtowjqtqd"))
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.removals(docs_of([(1, one), (2, two)])).collect()}
    assert got == {1: 0, 2: 0}
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.removals(docs_of([(1, one), (2, two), (3, "x" + one), (4, one)])).collect()}
    assert got == {1: 400, 2: 0, 3: 400, 4: 400}


def test_documents_made_to_collide(spark, docs_of):
    """Of two texts without a doc_id that have one xxhash64 only the repeated one loses bytes."""
    begin, wide = "".join(np.random.default_rng(1).choice(list("abcdefgh "), 192)), "k" * 24
    one, two = (begin + a + wide + b + wide + "q" * 200 for a, b in (("gojpqbav", "ggzmvmqd"), ("iarbfiay", "Oi~HX(Rn")))
    assert len({r[0] for r in spark.createDataFrame([(one,), (two,)], "text string").select(F.xxhash64("text")).collect()}) == 1
    got = suffix_dedup.removals(docs_of([(None, one), (None, two), (5, "zz" + one)])).collect()
    assert sorted((r["kept_sha256"], r["n_removed"]) for r in got) == sorted((hashlib.sha256(t.encode()).hexdigest(), n) for t, n in (("", len(one)), (two, 0), ("zz", len(one))))


def test_unlike_regions_of_one_digest():
    """What hashes tie together and bytes do not is refused."""
    own = {"blk": 1, "gid": 1, "reg": b"r", "key": 0, "place": 0, "lo": 0, "hi": 0, "m": 2}
    block = [{**own, "did": 1, "last": 0, "body": b"abcd"}, {**own, "did": 2, "last": 1, "body": b"abcd"}]
    assert list(suffix_dedup._solve(block, 4, False)) == [(1, b"r", True, 1, 0, 0, 0, 4)]
    block[1]["body"] = b"abce"
    with pytest.raises(RuntimeError):
        list(suffix_dedup._solve(block, 4, False))


def test_text_that_is_left(spark, docs_of):
    rows = [(1, "é" * 30 + "abc" * 20), (2, "x" + "é" * 30), (3, None)]
    for r in suffix_dedup.removals(docs_of(rows), 21).collect():
        body = (dict(rows)[r["doc_id"]] or "").encode()
        at, kept = 0, b""
        for s in r["removed"]:
            kept, at = kept + body[at : s["begin"]], s["end"]
        kept += body[at:]
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest() and r["text"] == kept.decode(errors="ignore")


ODD_TEXTS = [None, "", "it's we'll DON'T", "naïve Éclair straße İstanbul", "日本語 テキスト", "á é", "<|endoftext|> x<|startoftext|>y", "tab\tand nbsp em", "x" * 3000, "1234 ½ ²³ ª", "Σίσυφος ΟΔΥΣΣΕΥΣ", "\n\n a\n", "don't\n'tis <b> ''s", "ŉ ſ ǅ", " lead trail "]


def test_token_ids():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path())
    rng = np.random.default_rng(3)
    texts = ODD_TEXTS + ["".join(rng.choice(list("aeZ'. ,é\n1ß<"), rng.integers(1, 40))) for _ in range(300)]
    ids, offsets = WordEncoder().encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_vocabularies(name):
    """A file with another pre-tokenizer gives the library's ids too."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    whole, coder = Tokenizer.from_file(path), WordEncoder(path)
    assert coder.by_words == (name == "word_bpe_49k.json")
    for texts in (ODD_TEXTS, [None, ""], []):
        ids, offsets = coder.encode(pa.array(texts, pa.string()))
        for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
            assert ids[a:b].tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def test_full_word_cache(monkeypatch):
    from chunkwright.llm import tokens

    texts = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)} x" for k in range(300)]
    want = WordEncoder().encode(pa.array(texts))[0]
    monkeypatch.setattr(tokens, "CACHE_WORDS", 10)
    coder = WordEncoder()
    assert np.array_equal(np.concatenate([coder.encode(pa.array(texts[k : k + 7]))[0] for k in range(0, 300, 7)]), want)


def test_pieces_are_encoded_once_per_worker():
    """A piece goes to the model once, whatever stands around it and whichever task it is in; a later task reads no vocabulary."""
    from chunkwright.llm import tokens

    class Counting:
        def __init__(self, model):
            self.model, self.seen = model, []

        def tokenize(self, piece):
            self.seen.append(piece)
            return self.model.tokenize(piece)

    tokens._coders.clear()
    coder = tokens.word_encoder()
    coder.model = Counting(coder.model)
    want = coder.whole.encode("Éclair (word) word, WORD. éclair/word 77 x×y", add_special_tokens=False).ids
    for _ in range(2):
        ids, _ = tokens.word_encoder().encode(pa.array(["Éclair (word) word,", None, "WORD. éclair/word 77 x×y"]))
        assert ids.tolist() == want
    assert sorted(coder.model.seen) == sorted(["éclair".encode().decode("latin-1").translate(coder.signs), "word", "(", ")", ",", ".", "/", "7"])
    tokens._coders.clear()


def test_token_tables(spark, docs_of):
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(ODD_TEXTS)), (-7, "negative")]
    folder = f"{work_dir(spark)}/tables"
    shards = sstable.write_tables(docs_of(rows), folder)
    got = sstable.read_tables(spark, folder, shards, with_ids=True).orderBy("start").collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        raw = np.array(ids, "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (i, at, len(ids), zlib.crc32(raw), raw)
        at += len(ids)
    store, path = filesystem(folder)
    found = 0
    for name, _, _ in shards:
        with store.open_input_file(f"{path}/{name}") as source:
            table = sstable.TableReader(source)
            found += len(table.get(5)) + len(table.get(-7))
            assert table.get(123456) == []
    assert found == 3
    assert sstable.token_tables(docs_of([])).count() == 0


def test_packing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    rng = np.random.default_rng(4)
    rows = [*ODD, *((100 + i, "w " * int(n)) for i, n in enumerate(rng.integers(0, 3000, 60)))]
    got = packing.pack_documents(docs_of(rows).repartition(7)).collect()
    assert Counter(r["doc_id"] for r in got)[5] == 2
    assert sum(r["length"] for r in got if r["doc_id"] == 4) == 30001
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    central = packing.best_fit(np.array([r["length"] for r in got]), 2048)[2]
    assert len(bins) <= 1.05 * len(central) + 1
    assert packing.pack_documents(docs_of([])).count() == 0


@pytest.mark.parametrize("parts", [1, 9])
def test_nodes_larger_than_a_task(spark, monkeypatch, parts):
    """More underfull bins than one task takes, in groups of one partition or of many: all still meet."""
    monkeypatch.setattr(packing, "FAN", 3)
    monkeypatch.setattr(packing, "GROUP", 20)
    monkeypatch.setattr(packing, "NODE", 25)
    rng = np.random.default_rng(5)
    sizes = [int(n) for n in rng.integers(500, 1000, 400)]
    items = spark.createDataFrame(list(enumerate(sizes)), "k int, length bigint").repartition(parts)
    got = packing.pack(items).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(got) == len({r["k"] for r in got}) == 400
    for own in bins.values():
        assert [a for a, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) <= 2048
    assert sum(sum(n for _, n in own) <= 1024 for own in bins.values()) <= 4
    assert len(bins) <= 1.06 * len(packing.best_fit(np.array(sizes), 2048)[2])


def test_bins_that_cannot_merge(spark, monkeypatch):
    monkeypatch.setattr(packing, "NODE", 10)
    items = spark.createDataFrame([(k, 1100) for k in range(200)], "k int, length bigint").repartition(4)
    assert packing.pack(items).select("sequence_id").distinct().count() == 200


@pytest.mark.parametrize("size", [200, 1 << 24])
def test_archives(spark, size):
    big = "<p>" + "é" * 800 + "\x1f\x8b\x08" + "</p>"
    rows = [(1, "http://a/ b", big), (9, None, big), (5, "http://c", big), (2, "u", "small"), (3, "u", "small"), (4, "u", None), (None, "n", big), (9, None, big), (7, "z", "q" * 300000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    folder = f"{work_dir(spark)}/warc"
    got = warc.read_archives(spark, folder, warc.write_archives(pages, folder), size, with_payload=True).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == Counter(
        {(1, "revisit", 9): 1, (5, "revisit", 9): 1, (None, "revisit", 9): 1, (9, "response", None): 2, (2, "response", None): 1, (3, "response", None): 1, (4, "response", None): 1, (7, "response", None): 1}
    )
    for r in got:
        html = (next(h for i, _, h in rows if i == r["page_id"]) or "").encode()
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == hashlib.sha1(html).hexdigest()
    assert warc.round_trip(pages.limit(0)).count() == 0
    more = pages.selectExpr("*", "'d' AS digest", "7L AS refers_to", "'r' AS record_type", "1L AS n", "'u' AS urls")
    pick = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert pick(warc.round_trip(more)) == pick(warc.round_trip(pages))


def test_work_folder(spark, monkeypatch):
    from types import SimpleNamespace

    where = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        where.sparkContext.master = master
        with pytest.raises(RuntimeError):
            work_dir(where)
    where.sparkContext.master = "local[4]"
    assert work_dir(where).startswith("file:/")
    where.sparkContext.getCheckpointDir = lambda: "hdfs://shared"
    assert work_dir(where).startswith("hdfs://shared/cw-")


def test_damaged_archive(tmp_path):
    import pyarrow.fs as pafs

    def member(k):
        p = zlib.compressobj(3, zlib.DEFLATED, 31)
        return p.compress(warc.record(k, "u", b"x" * 50 * k, None, "d")) + p.flush()

    parts = [member(k) for k in range(6)]
    parts[2] = parts[2][:40] + b"\0\0\0\0" + parts[2][44:]
    (tmp_path / "a.gz").write_bytes(b"junk\x1f\x8b\x08junk" + b"".join(parts))
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "a.gz")) as source:
        size = source.size()
        for step in (37, 100, size):
            found = [warc.parse(c)["page_id"] for a in range(0, size, step) for _, c in warc.members(source, a, a + step)]
            assert found == [0, 1, 3, 4, 5]
