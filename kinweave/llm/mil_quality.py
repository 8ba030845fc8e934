"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage of the whole text is encoded by what its bytes and words
look like, a small network turns that into a vector, gated attention weighs the passages, and the weighted vector
is scored. Only documents are labelled; the attention is learned from their labels.

Defined results: a null or empty text is one passage without words; repeated rows get equal scores; without labels
of both kinds (or an empty table) every score is 1, since nothing is known against a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import labelled

PASSAGE = 64
HIDDEN, GATES = 16, 12
EPOCHS = 160
#: Byte classes: 0 other, 1 a-z, 2 A-Z, 3 digits, 4 white space, 5 '!', 6 '|', 7 symbols, 8 plain punctuation, 9 further punctuation, 10 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _number, _bytes in enumerate((b"", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b"!", b"|", b"#*$%&<>", b".,;:?'\"-", b"()/\\@[]^_`{}~+=")):
    _CLASS[list(_bytes)] = _number
_CLASS[128:] = 10
CLASSES = 11
FEATURES = CLASSES + 7


def encode(text: str | None) -> np.ndarray:
    """A row for each passage: shares of byte classes, bytes per word, words that are new in the passage and in the document, repeated lines, and sizes."""
    data = (text or "").encode()
    words = data.split()
    n = max(1, -(-len(words) // PASSAGE))
    codes = _CLASS[np.frombuffer(data, np.uint8)]
    blank = codes == 4
    start = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1]))) if len(codes) else np.empty(0, np.int64)
    ends = np.append(start[PASSAGE::PASSAGE], len(codes))
    at = np.repeat(np.arange(n), np.diff(np.concatenate(([0], ends))))
    counts = np.bincount(at * CLASSES + codes, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    size = np.maximum(counts.sum(1) - counts[:, 4], 1)
    held = np.minimum(PASSAGE, len(words) - PASSAGE * np.arange(n)).clip(0)
    fresh = np.array([len(set(words[i : i + PASSAGE])) for i in range(0, n * PASSAGE, PASSAGE)], float)
    lines = [x for x in data.split(b"\n") if x.strip()]
    out = np.empty((n, FEATURES))
    out[:, :CLASSES] = counts / size[:, None]
    out[:, CLASSES] = np.log1p(size / np.maximum(held, 1))
    out[:, CLASSES + 1] = fresh / np.maximum(held, 1)
    out[:, CLASSES + 2] = len(set(words)) / max(len(words), 1)
    out[:, CLASSES + 3] = 1 - len(set(lines)) / len(lines) if lines else 0
    out[:, CLASSES + 4] = np.log1p(held)
    out[:, CLASSES + 5] = np.log1p(len(words))
    out[:, CLASSES + 6] = np.minimum(len(words), 20) / 20
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Passage vectors, gated attention, score. Parameters are a dict of arrays."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def fresh(cls, rng: np.random.Generator, mean: np.ndarray, scale: np.ndarray) -> Network:
        d = len(mean)
        return cls({"mean": mean, "scale": scale, "E": rng.normal(0, d**-0.5, (d, HIDDEN)), "e": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "w": rng.normal(0, GATES**-0.5, GATES), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "c0": np.zeros(1)})

    def forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict:
        """x: encoded passages of several documents one after the other; starts: each document's first; bag: each passage's document."""
        p, s = self.p, {}
        s["x"] = (x - p["mean"]) / p["scale"]
        s["h"] = np.tanh(s["x"] @ p["E"] + p["e"])
        s["t"], s["u"] = np.tanh(s["h"] @ p["V"]), _sigmoid(s["h"] @ p["U"])
        g = (s["t"] * s["u"]) @ p["w"]
        g = np.exp(g - np.maximum.reduceat(g, starts)[bag])
        s["a"] = g / np.add.reduceat(g, starts)[bag]
        s["z"] = np.add.reduceat(s["a"][:, None] * s["h"], starts)
        s["y"] = _sigmoid(s["z"] @ p["c"] + p["c0"])
        return s

    def gradient(self, s: dict, y: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        p = self.p
        d = (s["y"] - y) / len(y)
        out = {"c": s["z"].T @ d, "c0": d.sum(keepdims=True)}
        dz = d[:, None] * p["c"]
        da = (dz[bag] * s["h"]).sum(1)
        dg = s["a"] * (da - np.add.reduceat(s["a"] * da, starts)[bag])
        out["w"] = (s["t"] * s["u"]).T @ dg
        dt = dg[:, None] * p["w"] * s["u"] * (1 - s["t"] ** 2)
        du = dg[:, None] * p["w"] * s["t"] * s["u"] * (1 - s["u"])
        out["V"], out["U"] = s["h"].T @ dt, s["h"].T @ du
        dh = (s["a"][:, None] * dz[bag] + dt @ p["V"].T + du @ p["U"].T) * (1 - s["h"] ** 2)
        out["E"], out["e"] = s["x"].T @ dh, dh.sum(0)
        return out


def _bags(encoded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in encoded])
    return np.concatenate(encoded), np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(sizes)), sizes)


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-4, balance: float = 1.0, seed: int = 1) -> dict | None:
    """Parameters by Adam over the whole sample; None where a label is missing."""
    y = np.array([float(v) for _, v in rows])
    if not len(y) or y.min() == y.max():
        return None
    x, starts, bag = _bags([encode(t) for t, _ in rows])
    net = Network.fresh(np.random.default_rng(seed), x.mean(0), x.std(0) + 1e-3)
    first, second = {}, {}
    for step in range(1, epochs + 1):
        grads = net.gradient(net.forward(x, starts, bag), y, starts, bag)
        for k, g in grads.items():
            g = g + decay * net.p[k]
            first[k] = 0.9 * first.get(k, 0) + 0.1 * g
            second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
            net.p[k] = net.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net.p


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", target: str = "quality", bound: dict[int, int] | None = None) -> dict | None:
    return train(labelled.sample(docs, labels, target, key, text, bound))


def score_texts(model: dict, texts: list[str | None]) -> np.ndarray:
    """Scores, over groups of texts with a bounded number of passages."""
    net, out, group, size = Network(model), [], [], 0

    def flush():
        nonlocal group, size
        if group:
            out.append(net.forward(*_bags(group))["y"])
        group, size = [], 0

    for t in texts:
        group.append(encode(t))
        size += len(group[-1])
        if size >= 20_000:
            flush()
    flush()
    return np.concatenate(out) if out else np.empty(0)


def score(docs: DataFrame, model: dict | None, text: str = "text", into: str = "score") -> DataFrame:
    """The rows with their scores, 0 to 1. Only the text goes to Python."""
    if model is None:
        return docs.withColumn(into, F.lit(1.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(score_texts(sent.value, part.tolist()))

    return docs.withColumn(into, of(F.col(text)))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """key, held_out, score, predicted for each row."""
    model = learn(docs, labels, key, text)
    rows = score(docs.select(key, text), model, text, "score")
    return rows.select(key, labelled.held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
