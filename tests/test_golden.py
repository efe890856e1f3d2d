"""Known results: segments and their evaluation, byte-pair merges, and hand-made edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwright.operators import features, models, temporal, text
from chunkwright.operators.attention import attention_kernel
from chunkwright.operators.evaluate import evaluate
from chunkwright.sources import files

# Smoothed scores (start second, score) of three recordings.
SCORES = {
    "a": [
        (50, 0.8683661952004929), (55, 0.8919167303014994), (60, 0.8495854338602508), (70, 0.8850683744350847),
        (75, 0.9245503536734576), (90, 0.9170290037807592), (105, 0.8596763005406358), (110, 0.8597303097837584),
        (115, 0.8490217445986971), (155, 0.9153031110504333), (180, 0.8575103149087493), (185, 0.8588396635700025),
        (205, 0.8647908516799728), (210, 0.901087339362362), (215, 0.9120366254615369), (220, 0.9121659327914534),
        (225, 0.8875350203086771), (235, 0.8728223488457716), (240, 0.8592125820671805), (245, 0.8659156550136627),
        (250, 0.901060758179425), (255, 0.9295465009117425), (260, 0.981680007828236), (265, 0.9811098275051304),
        (270, 0.9292892353917646), (275, 0.9119075385649706), (280, 0.9122207511441892), (285, 0.9297859379685294),
        (290, 0.9646656484296019), (295, 0.9051308913510367), (300, 0.8554203818224253), (305, 0.9222894355280544),
        (310, 0.8612432980840362),
    ],
    "b": [
        (15, 0.760131600148103), (20, 0.9095532617710236), (25, 0.9585051222342614), (30, 0.9072481625224135),
        (40, 0.906449349160811), (45, 0.8780966982819727), (55, 0.7597882456146821),
    ],
    "c": [
        (45, 0.8421446217307461), (50, 0.8687730443534933), (55, 0.8918283677048898), (60, 0.9131291195229605),
        (65, 0.8834570439055572), (70, 0.8033636329813894), (75, 0.9151853861185612), (80, 0.9283908094341732),
        (85, 0.8431350833875755), (90, 0.9487074954941539), (95, 0.9995892703753106), (100, 0.9994667378692158),
        (105, 0.9993063945815371), (110, 0.9993096876293212), (115, 0.9508586180710987), (120, 0.8058223720668213),
        (140, 0.7913723618309321), (145, 0.8880887721838256), (200, 0.7641210234169546), (205, 0.7793838100126576),
    ],
}
# Durations, and the segments that the planner must give.
DURATIONS = [('a', 395.04), ('b', 70.01), ('c', 244.46)]
SEGMENTS = {
    "a": [(75.0, 80.0), (90.0, 95.0), (155.0, 160.0), (215.0, 225.0), (255.0, 300.0), (305.0, 310.0)],
    "b": [(15.0, 35.0), (40.0, 50.0)],
    "c": [(60.0, 65.0), (75.0, 85.0), (90.0, 120.0)],
}
# The evaluation of these segments.
EVALUATION = {
    "a": {'original_duration_sec': 395.04, 'summary_duration_sec': 75.0, 'compression_ratio': 0.19, 'segments': 6, 'timeline_span_sec': 235.0, 'timeline_coverage': 0.595, 'diversity_score': 0.08, 'highlight_density': 0.0152, 'importance_coverage': 0.187, 'avg_importance': 0.92, 'redundancy_score': 0.0, 'temporal_precision': 0.467, 'temporal_recall': 1.0, 'temporal_f1': 0.636},
    "b": {'original_duration_sec': 70.01, 'summary_duration_sec': 30.0, 'compression_ratio': 0.429, 'segments': 2, 'timeline_span_sec': 35.0, 'timeline_coverage': 0.5, 'diversity_score': 0.067, 'highlight_density': 0.0286, 'importance_coverage': 0.274, 'avg_importance': 0.833, 'redundancy_score': 0.0, 'temporal_precision': 0.333, 'temporal_recall': 1.0, 'temporal_f1': 0.5},
    "c": {'original_duration_sec': 244.46, 'summary_duration_sec': 45.0, 'compression_ratio': 0.184, 'segments': 3, 'timeline_span_sec': 60.0, 'timeline_coverage': 0.245, 'diversity_score': 0.067, 'highlight_density': 0.0123, 'importance_coverage': 0.156, 'avg_importance': 0.926, 'redundancy_score': 0.0, 'temporal_precision': 0.444, 'temporal_recall': 1.0, 'temporal_f1': 0.615},
}


@pytest.fixture()
def scores(spark):
    return spark.createDataFrame([(v, float(t), s) for v, own in SCORES.items() for t, s in own], "video string, start_time double, score double")


def test_segments_and_evaluation(spark, scores):
    durations = spark.createDataFrame(DURATIONS, "video string, duration double")
    plan = temporal.plan_segments(scores, durations, "video", "start_time", "score").cache()
    assert sorted((r["video"], r["start_time"], r["end_time"], r["duration"]) for r in plan.collect()) == sorted((v, a, b, b - a) for v, own in SEGMENTS.items() for a, b in own)
    for r in evaluate(plan, scores, durations, "video").collect():
        for c, v in EVALUATION[r["video"]].items():
            assert r[c] == pytest.approx(v, abs=1e-9), (r["video"], c)


def naive_merges(data, vocab_size):
    """The most frequent pair, the first seen among equals, over and over, on plain lists."""
    ids, merges = list(data), {}
    for new in range(260, vocab_size):
        pairs = list(zip(ids, ids[1:]))
        if not pairs:
            break
        best = min(set(pairs), key=lambda p: (-pairs.count(p), pairs.index(p)))
        merges[best] = new
        out = []
        while ids:
            if len(ids) > 1 and (ids[0], ids[1]) == best:
                out.append(new)
                ids = ids[2:]
            else:
                out.append(ids[0])
                ids = ids[1:]
        ids = out
    return merges


def test_merges(spark):
    lines = ["low lower lowest .", "new newer newest .", "wide é wider ."]
    got = text.train_bpe(text.synthetic_corpus(spark, lines, 3), "pos", "text", 280)
    assert got == naive_merges(("\n".join(lines * 3) + "\n").encode(), 280)
    document = text.tokenizer_document(spark, got, 280)
    assert {(r["left"], r["right"]): r["id"] for r in text.parse_merges(document, "value").collect()} == got
    for s in ("low newest .", "é ünïcode", ""):
        assert text.decode_ids(text.encode_ids(s, got), got) == s
    assert text.decode_ids([255, text.EOS], got) == "\ufffd"


def test_captions(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"v": {"text": ["a", "b"], "start": [1.0, 2.0], "end": [3.0, 4.5]}, "w": {"text": [], "start": [], "end": []}}')
    table = files.caption_table(files.caption_rows(spark, str(tmp_path / "c.json")))
    assert sorted(map(tuple, table.collect())) == [("v", "a b", 1, 1.0, 4.5), ("w", "", 0, 0.0, 0.0)]
    pieces = spark.createDataFrame([("v", [("a", 1.0, 2.0)])], "video_id string, pieces array<struct<text:string,start:double,duration:double>>")
    arrays = files.caption_arrays(pieces)
    assert arrays.first()["end"] == [3.0]
    assert files.caption_document(arrays).first()["value"] == '{"v":{"text":["a"],"start":[1.0],"end":[3.0]}}'


def test_headers_inside(spark, tmp_path):
    (tmp_path / "t.csv").write_text('file,start_time,text\na,0.0,"one ""two"", three"\nfile,start_time,text\na,5.0,next\n')
    rows = files.transcripts_csv(spark, str(tmp_path / "t.csv"))
    assert text.ordered_concat(rows, "file", "start_time", "text").first()["text"] == 'one "two", three next'


def test_chunk_tail():
    assert features.chunk_signal(np.arange(1, 13), 5).tolist() == [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10], [11, 12, 0, 0, 0]]


def test_mfcc_edges():
    assert not features.mfcc_vector(np.zeros(0)).any()
    assert np.isfinite(features.mfcc_vector(np.random.default_rng(0).normal(size=100))).all()


def test_sharpness():
    flat = np.full((4, 5), 7, np.uint8)
    assert features.laplacian_variance(flat) == 0 and features.laplacian_variance(None) == 0
    image = features.read_pgm(b"P5 5 4 255\n" + bytes(range(20)))
    assert image.shape == (4, 5) and image[3, 4] == 19
    assert features.read_pgm(b"junk") is None


def chunks(spark, rows):
    return spark.createDataFrame(rows, "g string, t double, score double")


def test_smoothing_edges(spark):
    assert temporal.smooth(chunks(spark, [("a", 0.0, 1.0)]), "g", "t", "score").first()["smooth"] == pytest.approx(0.6)
    kept = temporal.percentile_gate(chunks(spark, [("a", 0.0, 0.35), ("a", 5.0, 0.36)]), "g", "score", 0.1)
    assert [r["t"] for r in kept.collect()] == [5.0]


def test_bridge_and_cap(spark):
    rows = chunks(spark, [("a", 0.0, 1.0), ("a", 6.0, 1.0), ("a", 12.01, 1.0)])
    assert sorted((r["start_time"], round(r["end_time"], 9)) for r in temporal.merge_islands(rows, "g", "t").collect()) == [(0.0, 11.0), (12.01, 17.01)]
    segments = spark.createDataFrame([("a", 10.0 * i, 10.0 * i + 5) for i in range(5)], "g string, start_time double, end_time double").withColumn("d", F.lit(0.0))
    assert sorted(r["start_time"] for r in temporal.cap_segments(segments, "g", "d").collect()) == [0.0, 10.0, 20.0]
    cut = temporal.cut_plan(spark.createDataFrame([("a", 0.1, 5.1)], "g string, start_time double, end_time double"), "g").first()
    assert (cut["seek"], round(cut["length"], 9)) == (0.0, 5.5)


def test_overlap_sweep_equals_pairs(spark):
    rng = np.random.default_rng(1)
    make = lambda: [("g", float(s), float(s + w)) for s, w in zip(rng.integers(0, 50, 20), rng.integers(1, 9, 20), strict=True)]
    a, b = make(), make()
    schema = "g string, start_time double, end_time double"
    got = temporal.interval_overlap(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "g").first()
    want = sum(max(0.0, min(x[2], y[2]) - max(x[1], y[1])) for x in a for y in b)
    assert got["overlap_sec"] == want and got["a_sec"] == sum(x[2] - x[1] for x in a)


def test_kernel_small_group():
    import pandas as pd

    pdf = pd.DataFrame({"t": [0.0, 5.0], "score": [0.2, -1.0], "features": [[1.0], [2.0]]})
    assert attention_kernel(pdf)["hybrid_score"].tolist() == [0.2, -1.0]


def test_readers(spark, tmp_path):
    import wave

    for name, channels in (("a.wav", 1), ("b.wav", 2)):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(channels), w.setsampwidth(2), w.setframerate(1000)
            w.writeframes(np.arange(12 * channels, dtype="<i2").tobytes())
    (tmp_path / "c.wav").write_bytes(b"broken")
    rows = features.audio_chunks(files.media_files(spark, str(tmp_path)), 0.005).collect()
    assert sorted((r["file"], r["start_time"] is None) for r in rows) == [("a.wav", False)] * 3 + [("b.wav", False)] * 3 + [("c.wav", True)]
    assert files.folder_size(spark, str(tmp_path)).first()[0] > 0
    wanted = spark.createDataFrame([("a.wav",), ("z.wav",)], "name string")
    assert files.missing_from(wanted, files.existing(spark, str(tmp_path)), "name").collect() == [("z.wav",)]


def test_sampling_rules():
    rng = np.random.default_rng(0)
    logits = np.zeros(260)
    logits[259] = 100
    assert models.sample_next(logits, [], 0, rng) != 259
    assert models.sample_next(logits, [], 60, rng, top=1) == 259
    out = models.generate(lambda ids: logits, seed=3)
    assert out[0] == 258 and out[-1] == 259 and len(out) == 62
    x = np.random.default_rng(1).normal(size=(4, 8))
    masked = models.attend(x, x, x, models.causal_mask(4))
    assert np.allclose(masked[0], x[0])


def test_begin_mark_is_penalised_once_something_follows():
    seen = []

    class Watch(np.random.Generator):
        def choice(self, best, p):
            seen.append(dict(zip(best.tolist(), p, strict=True)))
            return best[0]

    logits = np.zeros(260)
    rng = Watch(np.random.PCG64(0))
    models.sample_next(logits, [], 0, rng, top=260)
    models.sample_next(logits, [258], 1, rng, top=260)
    assert seen[0][258] == seen[0][0] and seen[1][258] == pytest.approx(seen[1][0] * np.exp(-2 / 0.9))
    asked = []
    real, models.sample_next = models.sample_next, lambda z, recent, step, rng, end: asked.append(list(recent)) or 7
    try:
        models.generate(lambda ids: logits, most=3)
    finally:
        models.sample_next = real
    assert asked == [[], [258, 7], [258, 7, 7]]


def test_sequence_model():
    config = models.ModelConfig(vocab_size=270, max_seq_len=40, width=16, heads=4, layers=2, inner=24)
    model = models.Seq2Seq.random(config)
    source, target = [258, 5, 6, 7, 259], [258, 9, 10, 11]
    memory = model.encode(source)
    whole = model.decode(target, memory, source)
    assert memory.shape == (5, 16) and whole.shape == (4, 270)
    # a place sees nothing behind it, and padding changes nothing before it
    assert np.allclose(model.decode(target[:2], memory, source), whole[:2])
    padded = source + [256] * 3
    assert np.allclose(model.encode(padded)[:5], memory) and np.allclose(model.decode(target, model.encode(padded), padded), whole)
    assert np.allclose(memory.mean(-1), 0, atol=1e-9) and np.allclose(memory.std(-1), 1, atol=1e-3)
    # several heads are single heads beside each other
    rng = np.random.default_rng(2)
    w = {k: rng.normal(size=(16, 16)) for k in "qkv"} | {f"{k}0": rng.normal(size=16) for k in "qkv"} | {"o": np.eye(16), "o0": np.zeros(16)}
    x, y = rng.normal(size=(3, 16)), rng.normal(size=(5, 16))
    parts = []
    for h in range(4):
        q, k, v = (z @ w[n][:, 4 * h : 4 * h + 4] + w[n + "0"][4 * h : 4 * h + 4] for n, z in (("q", x), ("k", y), ("v", y)))
        e = np.exp(q @ k.T / 2)
        parts.append(e / e.sum(1, keepdims=True) @ v)
    assert np.allclose(models.heads_attend(w, x, y, 4), np.hstack(parts))
    with pytest.raises(ValueError):
        model.encode([1] * 41)
    first = model.summary_ids(list(range(30)), most=12, longest=20)
    assert first == model.summary_ids([*range(20), 99], most=12, longest=20) and len(first) == 13 and 259 not in first


def test_sharpness_by_hand():
    """One bright point on black: the Laplacian is 4 times it at the point and once at its neighbours."""
    image = np.zeros((5, 5), np.uint8)
    image[2, 2] = 10
    values = [-40.0] + [10.0] * 4 + [0.0] * 20
    assert features.laplacian_variance(image) == pytest.approx(np.var(values))
    corner = np.zeros((2, 2), np.uint8)
    corner[0, 0] = 3  # mirrored edges: its neighbours see it from both sides
    assert features.laplacian_variance(corner) == pytest.approx(np.var([-12.0, 6.0, 6.0, 0.0]))


def test_blur_scores_of_files(spark, tmp_path):
    image = np.zeros((5, 5), np.uint8)
    image[2, 2] = 100
    (tmp_path / "a.pgm").write_bytes(b"P5 5 5 255\n" + image.tobytes())
    (tmp_path / "b.pgm").write_bytes(b"broken")
    got = {r["image_name"]: (r["blur_score"], r["status"]) for r in features.blur_scores(files.media_files(spark, str(tmp_path), "*.pgm")).collect()}
    assert got["a.pgm"] == (pytest.approx(np.var([-400.0] + [100.0] * 4 + [0.0] * 20)), "SHARP") and got["b.pgm"] == (0.0, "BLURRY")


def test_mfcc_step_by_step():
    """Frames, spectrum, filters and cosines one after the other, by their formulas."""
    rate, size, hop, n_fft = 16000, 400, 160, 512
    x = np.sin(2 * np.pi * 1000 * np.arange(1000) / rate) + 0.1 * np.cos(np.arange(1000))
    y = [x[0]] + [x[i] - 0.97 * x[i - 1] for i in range(1, 1000)]
    frames = int(np.ceil((1000 - size) / hop))
    y += [0.0] * max(0, frames * hop + size - 1000)
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    points = [700 * (10 ** (mel(rate / 2) * i / 27 / 2595) - 1) for i in range(28)]
    bins = [int((n_fft + 1) * hz / rate) for hz in points]
    rows = []
    for f in range(frames):
        cut = [y[f * hop + i] * (0.54 - 0.46 * np.cos(2 * np.pi * i / (size - 1))) for i in range(size)]
        power = [abs(sum(c * np.exp(-2j * np.pi * k * i / n_fft) for i, c in enumerate(cut))) ** 2 / n_fft for k in range(257)]
        energy = []
        for m in range(1, 27):
            up = sum(power[k] * (k - bins[m - 1]) / (bins[m] - bins[m - 1]) for k in range(bins[m - 1], bins[m]))
            down = sum(power[k] * (bins[m + 1] - k) / (bins[m + 1] - bins[m]) for k in range(bins[m], bins[m + 1]))
            energy.append(20 * np.log10((up + down) or np.finfo(float).eps))
        rows.append([sum(e * np.cos(np.pi * (i + 0.5) * k / 26) for i, e in enumerate(energy)) * np.sqrt((1 if k == 0 else 2) / 26) for k in range(13)])
    assert np.allclose(features.mfcc_vector(x), np.mean(rows, axis=0), atol=1e-6)


def test_commit_marker(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.write_parquet(spark.range(5), path)
    assert files.committed(spark, path, lambda: spark.read.parquet(path)).count() == 5
    (tmp_path / "t" / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        files.committed(spark, path, lambda: None)


def test_attention_on_ties_and_nulls(spark):
    from chunkwright.operators.attention import band_attention

    rows = [("a", 0.0, 1, [1.0, 0.0]), ("a", 0.0, 1, [1.0, 0.0]), ("a", 0.0, 2, [0.0, 2.0]), ("a", 90.0, 3, [3.0, 0.0]), ("a", 200.0, 4, [1.0, 1.0]), (None, 0.0, 5, [1.0, 0.0]), ("a", None, 6, [1.0, 0.0]), ("a", 0.0, 7, None)]
    got = sorted((r["k"], round(r["local"], 6)) for r in band_attention(spark.createDataFrame(rows, "g string, t double, k int, v array<double>"), "g", "t", "v").collect())
    far = float(np.exp(-2))
    assert got == [(1, round(2 + far, 6)), (1, round(2 + far, 6)), (2, 1.0), (3, round(1 + 2 * far, 6)), (4, 1.0)]


@pytest.mark.parametrize("rows", [[(i, 1, "x") for i in range(500)], [(7, 1, "x")] * 300 + [(i, 2, "y") for i in range(100)], [(None, 5, "n"), (None, None, "m"), (3, None, "q"), (3, 2, "r"), (1, 4, "s")], []])
def test_running_budget_on_ties_and_nulls(spark, rows):
    got = temporal.running_budget(spark.createDataFrame(rows, "o bigint, n bigint, k string"), "o", "n", 40).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0, r[2]))
    want, before = [], 0
    for r in order:
        if before < 40:
            want.append((*r, before))
        before += r[1] or 0
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_concat_of_null_orders(spark):
    rows = [("a", "2", "two"), ("a", None, "none"), ("a", "t", "head"), ("a", "2", "again"), ("a", "1", None), ("b", "t", "head")]
    got = {r["g"]: r["text"] for r in text.ordered_concat(spark.createDataFrame(rows, "g string, t string, x string"), "g", "t", "x").collect()}
    assert got == {"a": "none again two"}


def test_best_pair_is_the_first_of_equal_ones(spark):
    rows = [(3, "zz ab"), (1, "é"), (2, "cdcd ab xx"), (4, None), (5, "")]
    got = text.most_frequent_pair(spark.createDataFrame(rows, "k int, t string").repartition(3), "k", "t").collect()
    assert [(chr(r["left"]) + chr(r["right"]), r["n"]) for r in got] == [("cd", 2)]
    assert text.most_frequent_pair(spark.createDataFrame([], "k int, t string"), "k", "t").count() == 0


def test_merges_of_runs():
    from itertools import product

    for n in range(8):
        for own in product((1, 2), repeat=n):
            for left, right in product((1, 2), repeat=2):
                out, i = [], 0
                while i < n:
                    hit = own[i : i + 2] == (left, right)
                    out.append(9 if hit else own[i])
                    i += 1 + hit
                assert text.merge_pair(np.array(own, np.int64), left, right, 9).tolist() == out


def test_models_route_errors(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "bad")], "file string, text string")

    def load():
        def model(t):
            if t == "bad":
                raise ValueError("no")
            return t.upper()

        return model

    assert sorted(map(tuple, models.summarise(rows, load).collect())) == [("a", "X", None), ("b", None, "no")]
