"""The language model learns from all training rows, its gradient is that of the likelihood, and its score is the softmax's."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import maxent_lm as M
from lexquarry.llm.common import fold


def brute(model, tokens, counts):
    """log10 probability of a text, token by token, in plain Python."""
    bias, total, codes = model.bias(), 0.0, [M.leaf(t) for t in tokens]
    for at, (token, code) in enumerate(zip(tokens, codes)):
        one, two = (codes[at - k] if at >= k else M.START for k in (1, 2))
        known, family = {"one": one, "two": two, "pair": (one * (M.LEAVES + 1) + two) % 2**32}, 0
        for i, families in enumerate(M.FAMILIES):
            prefix, outcome = code >> 4 * (M.FACTORS - i), code >> 4 * (M.FACTORS - 1 - i) & 15
            z = [float(x) for x in bias[i][prefix]]
            for name, bits in families:
                x = (known[name] * 0x9E3779B1 + prefix * 0x85EBCA77) % 2**32
                x = ((x ^ x >> 15) * 0xC2B2AE3D) % 2**32
                row = model.weights[M.BEGINS[family] + (x >> 32 - bits)]
                z = [a + float(b) for a, b in zip(z, row)]
                family += 1
            total += z[outcome] - math.log(sum(map(math.exp, z)))
        total += math.log((counts.get(token, 0) + 1) / (model.sizes[code] + model.kinds[code] + 1))
    return total / math.log(10)


def some_model(tokens, draw):
    counts = {t: tokens.count(t) for t in set(tokens)}
    sizes, kinds = np.zeros(M.LEAVES), np.zeros(M.LEAVES)
    for t, c in counts.items():
        sizes[M.leaf(t)] += c
        kinds[M.leaf(t)] += 1
    model = M.Model(len(tokens), sizes, kinds)
    model.weights = draw.normal(0, 0.5, model.weights.shape).astype(np.float32)
    return model, counts


def test_score_is_the_softmax():
    draw, words = np.random.default_rng(1), random.Random(1)
    texts = [M.tokens_of(" ".join(words.choice(["a", "The", "dog", "cats", "x9"]) for _ in range(n)).encode()) for n in (0, 1, 2, 9, 30)]
    model, counts = some_model(sum(texts[:4], []), draw)
    codes, begins = M.joined([np.array([M.leaf(t) for t in x], np.uint16) for x in texts])
    got = M.Scorer(model).score(codes, np.array([counts.get(t, 0) for x in texts for t in x], float), begins, step=7)
    assert got == pytest.approx([brute(model, x, counts) for x in texts], abs=1e-3)


def test_gradient_is_that_of_the_likelihood():
    draw = np.random.default_rng(2)
    model, _ = some_model([b"a", b"b", b"a", M.END], draw)
    codes, begins = M.joined([draw.integers(0, 300, n).astype(np.uint16) for n in (40, 25)])
    bias, weights = model.bias(), model.weights.astype(np.float64)
    for i, (outcome, prefix, rows) in enumerate(M.features(codes, begins)):

        def likelihood():
            z = M.logits(weights, bias, i, prefix, rows).astype(np.float64)
            return (z[np.arange(len(z)), outcome] - np.log(np.exp(z).sum(1))).sum()

        for where, times, sums in list(M.gradient(model.weights, bias, i, outcome, prefix, rows)):
            assert times.sum() == len(codes)
            for r in (0, len(where) - 1):
                for j in (0, 7):
                    values = []
                    for step in (0.05, -0.05):
                        weights[where[r], j] += step
                        values.append(likelihood())
                        weights[where[r], j] -= step
                    assert sums[r, j] == pytest.approx((values[0] - values[1]) / 0.1, abs=2e-3)


def test_mixing_weighs_by_what_a_task_saw():
    parts = [(np.array(n, np.float32).tobytes(), np.full((2, M.WIDE), w, np.float16).tobytes()) for n, w in (([1, 0], 2.0), ([3, 0], 6.0))]
    seen, weights = M.mixed(iter(parts))
    assert seen.tolist() == [4, 0] and (weights[0] == 5).all() and (weights[1] == 0).all()


def test_every_row_is_in_one_round(spark, monkeypatch):
    docs = [(i, f"w{i % 5} x{i % 3} w{i % 2}") for i in range(30)] + [(None, "w1 x1")] * 4
    df = spark.createDataFrame(docs, "doc_id long, text string")
    training = sorted("" if r.text is None else r.text for r in df.where(fold(F.col("doc_id"), 7) != 2).collect())
    seen, real = [], M.train_round

    def watched(codes, model, *rest):
        seen.extend(sorted(np.frombuffer(r.codes, np.uint16).tolist()) for r in codes.collect())
        out = real(codes, model, *rest)
        assert (out.seen >= model.seen).all() and not (out.weights == model.weights).all()
        return out

    monkeypatch.setattr(M, "train_round", watched)
    assert M.score(df, block_chars=100).count() == len(docs)
    assert sorted(seen) == sorted(sorted(M.leaf(t) for t in M.tokens_of(x.encode())) for x in training)
