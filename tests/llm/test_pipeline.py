"""The pipeline's stages chain, keep their columns, and give the rows that brute force gives on a corpus with planted cases."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, cls string, did bigint, row string, spans string, part bigint"


def test_pipeline(spark):
    from chunkwright.llm.common import materialise

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.select("doc_id").distinct().count() == counts[-1]


def write(spark, folder, docs, labels, items):
    rows = [(i, t, "en", "s", None if t is None else len(t), "c", 1, "r", "s", 2) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def without_later_copies(texts, length):
    """Texts without each byte of a window that started earlier, window by window."""
    seen, out = set(), []
    for t in texts:
        marks = bytearray(len(t))
        for k in range(len(t) - length + 1):
            own = t[k : k + length]
            if own in seen:
                marks[k : k + length] = b"\1" * length
            seen.add(own)
        out.append("".join(c for c, m in zip(t, marks, strict=True) if not m))
    return out


def pieces(doc_id, text):
    from tokenizers import Tokenizer

    from chunkwright.llm.tokens import vocabulary_path

    ids = [*Tokenizer.from_file(vocabulary_path()).encode(text or "", add_special_tokens=False).ids, 0]
    for k in range(0, len(ids), 2048):
        own = np.array(ids[k : k + 2048], "<u4")
        yield doc_id, k // 2048, k, len(own), zlib.crc32(own.tobytes())


def test_planted_cases(spark, tmp_path):
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(words, n))
    clean, gone = [], []
    for i in range(160):
        own = prose(int(rng.integers(60, 120)))
        (gone if i % 4 == 0 else clean).append((i, own if i % 4 else own.replace(" ", " vile rotten scum ", 1)))
    labels = [(i, 1, int(i % 4 == 0)) for i in range(160)]
    gone += [(200 + i, t.rsplit(" ", 1)[0] + " changed") for i, t in clean[:12]]  # near copies
    gone += [(300 + i, t) for i, t in clean[12:20]] + [clean[0], clean[30]]  # copies, repeated rows
    passage = prose(70)
    clean += [(400 + i, f"{prose(50)} {passage} {prose(50)}") for i in range(6)]
    gone.append((450, passage[20:-20]))  # nothing is left of it
    items = [(k, prose(30)) for k in range(4)] + [(9, None), (10, "")]
    edited = items[3][1].split()
    edited[7] = "other"
    gone += [(500 + k, f"{prose(20)} {t} {prose(20)}") for k, t in items[:3]] + [(503, f"{prose(40)} {' '.join(edited)}")]
    clean += [(600, None), (602, " \n"), (603, "x"), (700, prose(20000)), (None, prose(40))]
    gone += [(601, "")]
    write(spark, str(tmp_path), clean + gone, labels, items)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    order = sorted((r for r in clean if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0))
    left = dict(zip([i for i, _ in order], without_later_copies([t for _, t in order], corpus_pipeline.PASSAGE_BYTES), strict=True)) | {600: None}
    assert sum(len(left[i] or "") < len(t or "") for i, t in clean) == 5
    want = Counter(p for i, t in left.items() for p in pieces(i, t))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        assert [a for a, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) <= 2048


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_labels_and_no_benchmark(spark, tmp_path):
    write(spark, str(tmp_path), [(1, "some words"), (1, "some words"), (2, None), (3, "")], [], [])
    assert sorted((r["doc_id"], r["piece"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [(1, 0), (2, 0)]
