"""Wav files by ranges against whole files."""

import io
import wave

import numpy as np

from chunkwright.operators import features
from chunkwright.sources import audio, files


def wav(x, rate, channels, width):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(x.tobytes())
    return out.getvalue()


def test_ranges_as_whole_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    made = {
        "a.wav": wav(rng.integers(-30000, 30000, 1003).astype("<i2"), 100, 1, 2), "b.wav": wav(rng.integers(-30000, 30000, 2 * 777).astype("<i2"), 50, 2, 2), "c.wav": wav(rng.integers(0, 256, 90).astype(np.uint8), 10, 1, 1),
        "d.wav": wav(np.zeros(0, "<i2"), 100, 1, 2), "e.wav": b"RIFF", "f.wav": b"", "g.txt": b"no",
    }
    extra = made["a.wav"]
    made["h.wav"] = extra[:4] + (len(extra) - 8 + 14).to_bytes(4, "little") + extra[8:36] + b"LIST" + (5).to_bytes(4, "little") + b"abcde\0" + extra[36:]  # a chunk of odd length before the samples
    made["i.wav"] = extra[:-300]  # shorter than its header says
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = audio.wav_chunks(spark, str(tmp_path), 0.7, most=400).collect()
    key = lambda r: (r["file"], r["start_time"])
    whole = [r for r in features.audio_chunks(files.media_files(spark, str(tmp_path)), 0.7).collect() if r["error"] is None and r["file"] != "i.wav"]
    assert sorted([tuple(r) for r in got if r["error"] is None and r["file"] != "i.wav"], key=lambda r: r[:2]) == sorted(map(tuple, whole), key=lambda r: r[:2])
    assert sorted(r["file"] for r in got if r["error"]) == ["e.wav"]  # Spark doesn't list an empty file
    assert sum(len(r["samples"]) for r in got if r["file"] == "i.wav") == -(-(1003 - 150) // 70) * 70
    assert len({key(r) for r in got}) == len(got)
