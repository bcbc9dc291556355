"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded as a vector: hashed byte trigrams (1 + log counts
at unit length) and measures of its characters and words. A hidden layer, gated attention over the passages of a document
(tanh times sigmoid, softmax within the document) and a logistic output on the weighted mean are learned together from
document labels, by Adam on a bounded sample: SAMPLE documents at most, about, by hash of the id, and of a longer one TAUGHT
passages, evenly spread over it. All documents are then scored by all their passages, in one pass without a shuffle.

Measures without a bound of their own count by their logarithm, so a token of any length has a finite vector. A document
without words is one empty passage; a null text counts as empty. Without labels the score is 0.5. Repeated rows are scored
each, a column that has the name of the result is replaced, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import column_slices, text_buffers, trimmed, words

PASSAGE = 128
GRAMS = 256
MEASURES = 12
HIDDEN = 24
#: Labelled documents that are learned from, about.
SAMPLE = 5000
#: Passages of a document that are learned from, at most: with SAMPLE and half-precision vectors, 43 MB come to the driver.
TAUGHT = 16
EPOCHS = 40

_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[[*range(0x41, 0x5B)]] = 1  # capitals
_CLASS[[*range(0x61, 0x7B)]] = 2
_CLASS[[*range(0x30, 0x3A)]] = 3
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 4
_CLASS[0x80:] = 5


def passages(data: np.ndarray, offsets: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of the rows, float32, and per row the offset of its first passage (each row has one at least)."""
    hashes, begins, ends, rows = words(data, offsets)
    n_rows, n_words = len(offsets) - 1, np.diff(rows)
    counts = np.maximum(1, -(-n_words // size))
    at = np.concatenate(([0], np.cumsum(counts)))
    n = int(at[-1])
    out = np.zeros((n, GRAMS + MEASURES), dtype=np.float32)
    row = np.repeat(np.arange(n_rows), n_words)
    of_word = at[row] + (np.arange(len(hashes)) - rows[row]) // size
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    # A byte belongs to the passage of the last word of its row that began before it, or to the row's first.
    of_byte = np.repeat(at[:-1], np.diff(offsets))
    if len(hashes):
        starts = np.zeros(len(part), dtype=bool)
        starts[begins - base] = True
        of_byte = np.maximum(np.concatenate(([0], of_word))[np.cumsum(starts)], of_byte)
    b = part.astype(np.uint32)
    if len(b) > 2:
        gram = ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(24)
        same = of_byte[2:] == of_byte[:-2]
        grams = np.bincount((of_byte[:-2] * GRAMS + gram)[same], minlength=n * GRAMS).reshape(n, GRAMS).astype(np.float32)
        grams = np.where(grams > 0, 1 + np.log(np.maximum(grams, 1)), 0)
        out[:, :GRAMS] = grams / np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
    kinds = np.bincount(of_byte * 6 + _CLASS[part], minlength=n * 6).reshape(n, 6).astype(np.float64)
    total = np.maximum(kinds.sum(axis=1), 1)
    each = np.maximum(np.bincount(of_word, minlength=n), 1)
    lengths = (ends - begins).astype(np.float64)
    key = np.sort((of_word.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    marked = _CLASS[data[ends - 1]] == 4
    lines = np.bincount(of_byte[part == 10], minlength=n)
    mean = np.bincount(of_word, weights=lengths, minlength=n) / each
    m = [kinds[:, k] / total for k in range(1, 6)]
    spread = np.sqrt(np.maximum(0, np.bincount(of_word, weights=lengths**2, minlength=n) / each - mean**2))
    m += [np.log1p(mean) / 3, np.log1p(spread) / 3, distinct / each]
    m += [np.bincount(of_word[again], minlength=n) / each, np.bincount(of_word[marked], minlength=n) / each, lines / each, np.log1p(each) / 5]
    out[:, GRAMS:] = np.stack(m, axis=1)
    return out, at


class GatedAttention:
    """The network: hidden layer, gated attention, logistic output."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 0):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": g(inputs, hidden), "b": np.zeros(hidden, np.float32), "V": g(hidden, hidden), "U": g(hidden, hidden), "w": g(hidden), "c": g(hidden), "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(inputs, np.float32), np.ones(inputs, np.float32)

    def forward(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict]:
        p, bag = self.p, np.repeat(np.arange(len(at) - 1), np.diff(at))
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        e = np.exp(a - np.maximum.reduceat(a, at[:-1])[bag])
        weight = e / np.add.reduceat(e, at[:-1])[bag]
        z = np.add.reduceat(h * weight[:, None], at[:-1], axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return y, {"x": x, "at": at, "bag": bag, "h": h, "t": t, "s": s, "weight": weight, "z": z}

    def gradient(self, y: np.ndarray, target: np.ndarray, k: dict) -> dict[str, np.ndarray]:
        p, bag = self.p, k["bag"]
        dy = (y - target) / len(y)
        out = {"c": k["z"].T @ dy, "d": dy.sum(keepdims=True)}
        dz = (dy[:, None] * p["c"])[bag]
        dweight = (dz * k["h"]).sum(axis=1)
        inner = np.add.reduceat(dweight * k["weight"], k["at"][:-1])[bag]
        da = k["weight"] * (dweight - inner)
        gate = k["t"] * k["s"]
        out["w"] = gate.T @ da
        dgate = da[:, None] * p["w"]
        dt, ds = dgate * k["s"] * (1 - k["t"] ** 2), dgate * k["t"] * k["s"] * (1 - k["s"])
        out["V"], out["U"] = k["h"].T @ dt, k["h"].T @ ds
        dh = (dz * k["weight"][:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - k["h"] ** 2)
        out["W"], out["b"] = k["x"].T @ dh, dh.sum(axis=0)
        return out

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) * self.scale

    def fit(self, x: np.ndarray, at: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, rate: float = 0.005, decay: float = 1e-4, batch: int = 128, seed: int = 0) -> None:
        self.mean = x.mean(axis=0)
        self.scale = (1 / np.maximum(x.std(axis=0), 0.02)).astype(np.float32)
        x, r = self.scaled(x), np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(target))
            for lo in range(0, len(order), batch):
                bags = order[lo : lo + batch]
                rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in bags])
                own = np.concatenate(([0], np.cumsum([at[i + 1] - at[i] for i in bags])))
                y, kept = self.forward(x[rows], own)
                step += 1
                for name, g in self.gradient(y, target[bags], kept).items():
                    g = g + decay * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v2[name] = 0.999 * v2[name] + 0.001 * g * g
                    self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.forward(self.scaled(x), at)[0].astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", epochs: int = EPOCHS) -> GatedAttention | None:
    """Learns from about `sample` documents that have a label 0 or 1; None without any. A document with several labels takes the least."""
    known = labels.filter(F.col(target).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(target).alias("y"))
    n = known.count()
    if not n:
        return None
    share = min(1_000_000, -(-1_000_000 * sample // n))
    known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).groupBy("id").agg(F.min("y").cast("long").alias("y"))
    # About `sample` rows, whatever the size of labels.
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("id", "y", "text")
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in column_slices(batch.column(2), 1 << 19, 1024):
                x, at = passages(*text_buffers(batch.column(2).slice(lo, hi - lo)))
                chosen = [np.linspace(at[i], at[i + 1] - 1, min(TAUGHT, at[i + 1] - at[i])).astype(np.int64) for i in range(hi - lo)]
                blobs = [x[c].astype(np.float16).tobytes() for c in chosen]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(blobs, pa.binary())], names=["id", "y", "x"])

    rows = sorted(chosen.mapInArrow(trimmed(encode), f"id {id_type}, y long, x binary").toLocalIterator(), key=lambda r: (r["id"], bytes(r["x"])))
    if not rows:
        return None
    bags = [np.frombuffer(r["x"], dtype=np.float16).reshape(-1, GRAMS + MEASURES) for r in rows]
    at = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    network = GatedAttention(GRAMS + MEASURES)
    network.fit(np.concatenate(bags).astype(np.float32), at, np.array([r["y"] for r in rows], dtype=np.float32), epochs)
    return network


def score(docs: DataFrame, model: GatedAttention | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`, 0 to 1."""
    docs = docs.drop(out)
    names, at_column = [*docs.columns], docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for lo, hi in column_slices(batch.column(at_column), 1 << 19, 1024):
                x, at = passages(*text_buffers(batch.column(at_column).slice(lo, hi - lo)))
                parts.append(model.score(x, at) if model is not None else np.full(hi - lo, 0.5))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts))], names=[*names, out])

    return docs.mapInArrow(trimmed(run), f"{schema}, `{out}` double")
