"""Quality classifier: gated-attention multiple-instance learning over the passages of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.common import add_columns, as_bytes, fold, struct_type

PAIRS, KINDS = 256, 8
FEATURES = PAIRS + KINDS + 4
#: The kind of each byte: small letter, capital, digit, symbol, sign, other, start of a longer code point, rest of one.
KIND = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in b"#*$%&|<>" else 4 if 33 <= b <= 126 else 5 if b < 128 else 6 if b >= 192 else 7 for b in range(256)])


def passages(words: list[bytes], size: int) -> np.ndarray:
    """A row of features for each passage of `size` words: hashed pairs of bytes, kinds of bytes, and words: how many,
    how many different, how many like the one before, how long."""
    count = -(-len(words) // size)
    text = np.frombuffer(b" ".join(words), np.uint8).astype(np.int64)
    blank = text == 32
    at = np.cumsum(blank) // size
    total = np.bincount(at, minlength=count).astype(np.float32)[:, None]
    pairs = np.bincount(at[:-1] * PAIRS + ((text[:-1] * 37 + text[1:] * 101) & (PAIRS - 1)), minlength=count * PAIRS).reshape(count, PAIRS)
    kinds = np.bincount(at * KINDS + KIND[text], minlength=count * KINDS).reshape(count, KINDS)
    rows = np.empty((count, FEATURES), np.float32)
    rows[:, :PAIRS] = np.sqrt(pairs / total)
    rows[:, PAIRS : PAIRS + KINDS] = np.sqrt(kinds / total)
    for i in range(count):
        some = words[i * size : (i + 1) * size]
        n = len(some)
        rows[i, -4:] = n / size, len(set(some)) / n, sum(map(bytes.__eq__, some, some[1:])) / n, min(2.0, float(total[i, 0]) / n / 8)
    return rows


@dataclass
class Model:
    """encode, then attend: passage h = tanh(x W + b); weight = softmax of w (tanh(h V) * sigmoid(h U)); score of the sum."""

    weights: dict[str, np.ndarray]
    size: int = 64
    block: int = 2048

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.weights
        h = np.tanh(x @ p["W"] + p["b"])
        return h, (np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"]

    def score(self, text: bytes) -> float:
        """Of a whole text, encoded in blocks of passages; only the encodings are kept together."""
        words = text.split()
        step = self.size * self.block
        parts = [self.encode(passages(words[i : i + step], self.size)) for i in range(0, len(words), step)] or [self.encode(np.zeros((1, FEATURES), np.float32))]
        h, e = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        a = np.exp(e - e.max())
        return float(sigmoid((a / a.sum()) @ h @ self.weights["u"] + self.weights["c"][0]))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[bytes], labels: list[int], width: int = 24, gate: int = 12, epochs: int = 60, batch: int = 128, seed: int = 7) -> Model:
    """Adam on the cross-entropy of the labels, each label weighing the same; without labels of both kinds, scores are 0.5."""
    draw = np.random.default_rng(seed)
    p = {"W": draw.normal(0, FEATURES**-0.5, (FEATURES, width)), "b": np.zeros(width), "V": draw.normal(0, width**-0.5, (width, gate)), "U": draw.normal(0, width**-0.5, (width, gate)), "w": draw.normal(0, gate**-0.5, gate), "u": np.zeros(width), "c": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    model = Model(p)
    if len(set(labels)) < 2:
        return model
    bags = [passages(t.split(), model.size) if t.split() else np.zeros((1, FEATURES), np.float32) for t in texts]
    y = np.array(labels, np.float32)
    each = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = draw.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            x = np.concatenate([bags[i] for i in some])
            sizes = np.array([len(bags[i]) for i in some])
            begins, of = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(some)), sizes)
            h = np.tanh(x @ p["W"] + p["b"])
            t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
            e = (t * s) @ p["w"]
            a = np.exp(e - np.maximum.reduceat(e, begins)[of])
            a = a / np.add.reduceat(a, begins)[of]
            z = np.add.reduceat(a[:, None] * h, begins)
            d = (sigmoid(z @ p["u"] + p["c"]) - y[some]) * each[some] / len(some)
            dz = (d[:, None] * p["u"])[of]
            da = (h * dz).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, begins)[of])
            dg = de[:, None] * p["w"]
            dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
            dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            slopes = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "u": z.T @ d, "c": d.sum(keepdims=True)}
            step += 1
            for k, g in slopes.items():
                g = g + 1e-5 * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= np.float32(0.01) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, per_label: int = 1500, max_chars: int = 20_000) -> Model:
    """A model from at most per_label documents of each label (those of the least id hash), of at most max_chars each.

    Only rows whose crc32(id as text) mod folds is not 0 are used. Labels other than 0 and 1 and null ids are not used; an
    id that repeats counts each time, within the bound. The sample of ids is bounded, so it is broadcast.
    """
    known = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & (fold("_id", folds) != 0)).distinct()
    some = [known.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(2 * per_label) for y in (0, 1)]
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(some[0].union(some[1])), "_id").where(F.length("_text") <= max_chars)
    picked = [rows.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).limit(per_label) for y in (0, 1)]
    got = picked[0].union(picked[1]).select("_text", "_label").collect()
    return train([r[0].encode() for r in got], [r[1] for r in got])


def score(df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds quality_score, between 0 and 1, higher where label 1 is likelier, from every passage of the whole text. A null,
    empty or blank text is one empty passage. No shuffle; an input column of that name is replaced."""
    at = df.columns.index(text)

    def start():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([model.score(b) for b in as_bytes(batch.column(at))], pa.float64())]

        return work

    return add_columns(df, struct_type(quality_score=T.DoubleType()), start, carry)
