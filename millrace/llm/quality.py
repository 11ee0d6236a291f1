"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded (rates of
character classes, lengths, repeats, hashed letter pairs), a layer makes it a hidden vector,
gated attention weighs the passages, and the weighted sum is scored. Only document labels
are known; the attention learns which passages decide.

Learned from a bounded sample: at most ``PER_CLASS`` labelled rows of each class by the
order of a hash of the id, and of these as many as have ``MOST_PASSAGES`` passages together (at
least one). Bags are whole: every passage of a row is encoded, in training as in scoring.

Defined results: null and empty texts are one empty passage; null labels are not learned
from; of repeated labels of an id the highest counts; without rows of both classes every
score is the share of good rows (0.5 without any); extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, id_and_text, slices, stored
from .toxicity import class_counts, learnable, sample

PASSAGE = 64
PER_CLASS = 2_500
MOST_PASSAGES = 60_000
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 14, 64, 0.01, 1e-4
_PAIRS = 32
_MARKS = b"#&$*%!|.,;:?\"'()-/@<>=_+~^[]{}\\`"
_N_PLAIN = len(_MARKS) + 12
WIDTH = _N_PLAIN + _PAIRS


def _classes() -> np.ndarray:
    """256 x classes: which byte counts for which class."""
    out = np.zeros((256, len(_MARKS) + 5), dtype=np.float32)
    for k, mark in enumerate(_MARKS):
        out[mark, k] = 1
    base = len(_MARKS)
    out[0x41:0x5B, base] = 1
    out[0x61:0x7B, base + 1] = 1
    out[0x30:0x3A, base + 2] = 1
    out[0x80:, base + 3] = 1
    out[:0x20, base + 4] = 1
    return out


_CLASSES = _classes()


def encode(words: list[str]) -> np.ndarray:
    """Features of one passage."""
    out = np.zeros(WIDTH, dtype=np.float32)
    if not words:
        out[-1] = 1.0
        return out
    data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    rates = np.bincount(data, minlength=256).astype(np.float32) @ _CLASSES / len(data)
    lengths = [len(w) for w in words]
    n = len(words)
    mean = sum(lengths) / n
    repeats = sum(a == b for a, b in zip(words, words[1:])) / n
    extra = (
        mean / 10, math.sqrt(sum((x - mean) ** 2 for x in lengths) / n) / 10, max(lengths) / 50,
        len(set(words)) / n, repeats, sum(w[-1] in ".!?" for w in words) / n, n / PASSAGE,
    )
    out[: len(rates)] = np.sqrt(rates)
    out[len(rates) : _N_PLAIN] = extra
    if len(data) > 1:
        low = data | 0x20
        pairs = (low[:-1].astype(np.uint32) * 31 + low[1:]) * np.uint32(2654435761) >> np.uint32(27)
        out[_N_PLAIN:] = np.sqrt(np.bincount(pairs, minlength=_PAIRS) / len(pairs))
    return out


def passages(text: str) -> np.ndarray:
    """Encoded passages of the whole text."""
    words = text.split()
    return np.stack([encode(words[at : at + PASSAGE]) for at in range(0, max(1, len(words)), PASSAGE)])


@dataclass
class Model:
    prior: float
    shift: float = 0.0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    parts: dict[str, np.ndarray] | None = None

    def score(self, bag: np.ndarray) -> float:
        if self.parts is None:
            return self.prior
        logit = _forward(self.parts, (bag - self.mean) / self.scale, np.zeros(len(bag), dtype=np.int64), 1)["logit"][0]
        return float(1 / (1 + np.exp(-np.clip(logit + self.shift, -30, 30))))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Rows of one bag lie together; ``bag`` numbers them."""
    h = np.tanh(x @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
    e = (t * s) @ p["a"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, bag, e)
    weight = np.exp(e - top[bag])
    weight /= np.bincount(bag, weight, n)[bag]
    z = np.zeros((n, h.shape[1]))
    np.add.at(z, bag, weight[:, None] * h)
    return {"h": h, "t": t, "s": s, "weight": weight, "z": z, "logit": z @ p["c"] + p["d"][0]}


def _gradients(p, x, bag, n, y) -> dict[str, np.ndarray]:
    f = _forward(p, x, bag, n)
    d_logit = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) / n
    d_z = d_logit[:, None] * p["c"]
    inner = np.einsum("ij,ij->i", f["h"], d_z[bag])
    d_e = f["weight"] * (inner - np.bincount(bag, f["weight"] * inner, n)[bag])
    d_ts = d_e[:, None] * p["a"]
    d_v, d_u = d_ts * f["s"] * (1 - f["t"] ** 2), d_ts * f["t"] * f["s"] * (1 - f["s"])
    d_h = f["weight"][:, None] * d_z[bag] + d_v @ p["v"].T + d_u @ p["u"].T
    d_x = d_h * (1 - f["h"] ** 2)
    return {
        "w": x.T @ d_x, "b": d_x.sum(0), "v": f["h"].T @ d_v, "u": f["h"].T @ d_u,
        "a": (f["t"] * f["s"]).T @ d_e, "c": f["z"].T @ d_logit, "d": np.array([d_logit.sum()]),
    }


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Model:
    """Gated-attention network by Adam over mini-batches of whole bags."""
    rng, share = np.random.default_rng(seed), float(labels.mean())
    every = np.concatenate(bags)
    model = Model(share, mean=every.mean(0), scale=every.std(0) + 1e-3)
    bags = [(b - model.mean) / model.scale for b in bags]
    shapes = {"w": (WIDTH, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
    p = {k: rng.normal(0, 1 / math.sqrt(s[0]), s) for k, s in shapes.items()}
    p["b"], p["d"] = np.zeros(HIDDEN), np.zeros(1)
    m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for epoch in range(EPOCHS):
        rate = RATE * (0.5 + 0.5 * math.cos(math.pi * epoch / EPOCHS))
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in chosen])
            bag = np.repeat(np.arange(len(chosen)), [len(bags[i]) for i in chosen])
            g = _gradients(p, x, bag, len(chosen), labels[chosen])
            step += 1
            for k in p:
                grad = g[k] + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.parts = p
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_passages: int = MOST_PASSAGES) -> Model:
    """Learn from labelled rows whose crc32 of the id is not 1 mod 3."""
    keep = F.pmod(crc_of_id(), F.lit(3)) != 1
    rows = sample(docs, labels, "quality", keep, per_class)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bags = [passages(t).astype("<f4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(bags, pa.binary())], names=["doc_id", "y", "bag"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = stored(rows.mapInArrow(work, f"doc_id {kind}, y int, bag binary"))
    size = F.octet_length("bag") / (4 * WIDTH)
    before = F.sum(size).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "bag").rowsBetween(Window.unboundedPreceding, 0)) - size
    within = encoded.withColumn("before", before).where(F.col("before") < most_passages).drop("before")  # PER_CLASS rows a class at most
    kept = sorted(within.toLocalIterator(), key=lambda r: (r["doc_id"], r["bag"]))
    y = np.array([r["y"] for r in kept], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.5)
    model = train([np.frombuffer(r["bag"], "<f4").reshape(-1, WIDTH).astype(np.float64) for r in kept], y)
    # The sample is balanced; the scores are for the shares among all rows that may be learned from.
    n_good, n_bad = class_counts(learnable(labels, "quality", keep))
    model.shift = math.log(n_good / n_bad) - math.log(y.sum() / (len(y) - y.sum()))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score between 0 and 1, predicted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [model.score(passages(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = id_and_text(docs).mapInArrow(work, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
