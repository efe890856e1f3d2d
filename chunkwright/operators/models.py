"""Places for models and media tools: callables loaded once per partition, errors in a column of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ModelConfig:
    """One record shared by whatever fits and whatever applies a model."""

    vocab_size: int = 350
    max_seq_len: int = 512
    width: int = 128
    heads: int = 4
    layers: int = 2
    inner: int = 512


def transcribe(files: DataFrame, load: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """(file, start_time, text, error): `load` runs once per partition and gives a function from bytes to text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows.append((path.rsplit("/", 1)[-1], 0.0, model(bytes(content)).strip(), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path.rsplit("/", 1)[-1], 0.0, None, str(e)))
            yield pd.DataFrame(rows, columns=["file", "start_time", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "file string, start_time double, text string, error string")


def summarise(texts: DataFrame, load: Callable[[], Callable[[str], str]], key: str = "file") -> DataFrame:
    """(key, summary, error) by a model that `load` gives once per partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            rows = []
            for k, text in zip(part[key], part["text"], strict=True):
                try:
                    rows.append((k, model(text), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((k, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "summary", "error"])

    return texts.select(key, "text").mapInPandas(run, f"{key} string, summary string, error string")


def probe_durations(files: DataFrame, probe: Callable[[str], float]) -> DataFrame:
    """(video, duration) by an external tool; 0 where it fails."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for path in part["path"]:
                try:
                    found.append(float(probe(path)))
                except Exception:  # noqa: BLE001
                    found.append(0.0)
            yield pd.DataFrame({"video": [p.rsplit("/", 1)[-1] for p in part["path"]], "duration": found})

    return files.select("path").mapInPandas(run, "video string, duration double")


def positional_encoding(length: int, width: int) -> np.ndarray:
    """Sines and cosines of geometrically spaced wavelengths, interleaved."""
    angle = np.arange(length)[:, None] / 10000 ** (np.arange(0, width, 2)[None, :] / width)
    out = np.empty((length, width))
    out[:, 0::2], out[:, 1::2] = np.sin(angle), np.cos(angle[:, : width // 2])
    return out


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Scaled dot-product attention; masked places (False) get no weight."""
    weight = q @ np.swapaxes(k, -1, -2) / np.sqrt(q.shape[-1])
    if mask is not None:
        weight = np.where(mask, weight, -1e9)
    weight = np.exp(weight - weight.max(-1, keepdims=True))
    return weight / weight.sum(-1, keepdims=True) @ v


def causal_mask(n: int) -> np.ndarray:
    return np.tril(np.ones((n, n), bool))


def padding_mask(ids: np.ndarray, pad: int = 256) -> np.ndarray:
    """Places that hold a token: (1, n), to be met with any number of queries."""
    return (np.asarray(ids) != pad)[None, :]


def heads_attend(w: dict[str, np.ndarray], x: np.ndarray, memory: np.ndarray, heads: int, mask: np.ndarray | None = None) -> np.ndarray:
    """Multi-head attention of x over memory; w holds (matrix, bias) for q, k, v and o as "q", "q0", ..."""
    split = lambda name, y: (y @ w[name] + w[name + "0"]).reshape(len(y), heads, -1).swapaxes(0, 1)
    got = attend(split("q", x), split("k", memory), split("v", memory), mask)
    return got.swapaxes(0, 1).reshape(len(x), -1) @ w["o"] + w["o0"]


def layer_norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * gain + bias


def feed_forward(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.maximum(x @ w["in"] + w["in0"], 0) @ w["out"] + w["out0"]


@dataclass
class Seq2Seq:
    """Forward pass of an encoder-decoder whose sublayers add to their input and are normalised after that.

    `weights` names arrays by "part/layer/sublayer/name", part being encoder or decoder; beside these there are "embed",
    "project" and "project0". `random` gives untrained ones: training is outside of this engine.
    """

    config: ModelConfig
    weights: dict[str, np.ndarray]

    @classmethod
    def random(cls, config: ModelConfig, seed: int = 0) -> Seq2Seq:
        rng, d = np.random.default_rng(seed), config.width
        w = {"embed": rng.normal(size=(config.vocab_size, d)) * d**-0.5, "project": rng.normal(size=(d, config.vocab_size)) * d**-0.5, "project0": np.zeros(config.vocab_size)}
        for part, sublayers in (("encoder", ("self", "inner")), ("decoder", ("self", "cross", "inner"))):
            for layer in range(config.layers):
                for sub in sublayers:
                    at = f"{part}/{layer}/{sub}/"
                    shapes = {"in": (d, config.inner), "out": (config.inner, d)} if sub == "inner" else dict.fromkeys("qkvo", (d, d))
                    for name, shape in shapes.items():
                        w[at + name], w[at + name + "0"] = rng.normal(size=shape) * shape[0] ** -0.5, np.zeros(shape[1])
                    w[at + "gain"], w[at + "bias"] = np.ones(d), np.zeros(d)
        return cls(config, w)

    def _sublayer(self, at: str, x: np.ndarray, memory: np.ndarray | None = None, mask: np.ndarray | None = None) -> np.ndarray:
        own = {k.removeprefix(at): v for k, v in self.weights.items() if k.startswith(at)}
        y = feed_forward(own, x) if memory is None else heads_attend(own, x, memory, self.config.heads, mask)
        return layer_norm(x + y, own["gain"], own["bias"])

    def _embedded(self, ids: list[int]) -> np.ndarray:
        if len(ids) > self.config.max_seq_len:
            raise ValueError(f"{len(ids)} ids; the model takes {self.config.max_seq_len}")
        return self.weights["embed"][np.asarray(ids, int)] * self.config.width**0.5 + positional_encoding(len(ids), self.config.width)

    def encode(self, source: list[int]) -> np.ndarray:
        x, mask = self._embedded(source), padding_mask(source)
        for layer in range(self.config.layers):
            x = self._sublayer(f"encoder/{layer}/self/", x, x, mask)
            x = self._sublayer(f"encoder/{layer}/inner/", x)
        return x

    def decode(self, target: list[int], memory: np.ndarray, source: list[int]) -> np.ndarray:
        """Scores of the next id at each place of the target."""
        x, own = self._embedded(target), causal_mask(len(target)) & padding_mask(target)
        for layer in range(self.config.layers):
            x = self._sublayer(f"decoder/{layer}/self/", x, x, own)
            x = self._sublayer(f"decoder/{layer}/cross/", x, memory, padding_mask(source))
            x = self._sublayer(f"decoder/{layer}/inner/", x)
        return x @ self.weights["project"] + self.weights["project0"]

    def summary_ids(self, ids: list[int], begin: int = 258, end: int = 259, most: int = 200, longest: int = 254, seed: int = 0) -> list[int]:
        """Sampled ids for a text's ids, which are cut to `longest` and framed."""
        source = [begin, *ids[:longest], end]
        memory = self.encode(source)
        return generate(lambda out: self.decode(out, memory, source)[-1], begin, end, most, seed)


def sample_next(logits: np.ndarray, recent: list[int], step: int, rng: np.random.Generator, end: int = 259, temperature: float = 0.9, top: int = 20, least_steps: int = 60, penalty: float = 2.0) -> int:
    """One sampled id: the last eight of `recent` are penalised, the end is barred for a while, the `top` likeliest compete."""
    z = logits.astype(float).copy()
    if recent:
        z[list(set(recent[-8:]))] -= penalty
    if step < least_steps:
        z[end] = -1e9
    z /= temperature
    best = np.argsort(-z, kind="stable")[:top]
    p = np.exp(z[best] - z[best].max())
    return int(rng.choice(best, p=p / p.sum()))


def generate(next_logits: Callable[[list[int]], np.ndarray], begin: int = 258, end: int = 259, most: int = 200, seed: int = 0) -> list[int]:
    """Ids from a model's next-token scores, seeded."""
    rng, out = np.random.default_rng(seed), [begin]
    for step in range(most):
        out.append(sample_next(next_logits(out), out if step else [], step, rng, end))  # the begin mark counts once something follows it
        if out[-1] == end:
            break
    return out
