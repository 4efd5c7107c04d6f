"""The near-duplicate stage against all pairs by plain Python."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from lexquarry.llm import near_copies, simhash
from lexquarry.llm.common import add_columns, struct_type
from tests.llm.test_llm_corpus import fingerprint, roots, words


def shingles(text):
    w = words(text)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(docs, threshold=0.8):
    sets = [shingles(t) for _, t in docs]
    like = lambda a, b: a == b or len(a & b) >= threshold * len(a | b)
    root = roots(len(docs), [(j, i) for i in range(len(docs)) for j in range(i) if like(sets[i], sets[j])])
    least = {}
    for (i, _), r in zip(docs, root):
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    return sorted(least.values())


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


def edited(draw, text, n):
    w = text.split()
    for at in draw.sample(range(len(w)), n):
        w[at] = f"q{draw.randrange(10**6)}"
    return " ".join(w)


def test_stage_drops_edited_copies(spark):
    """Copies with a few changed words, most of them further apart than two bits of op9's fingerprint, leave one row."""
    draw = random.Random(7)
    docs = []
    for i in range(40):
        text = " ".join(f"w{draw.randrange(400)}" for _ in range(draw.randint(150, 400)))
        docs += [(2 * i, text), (2 * i + 1, edited(draw, text, draw.randint(1, 3)))]
    far = sum((fingerprint(a) ^ fingerprint(b)).bit_count() > 2 for (_, a), (_, b) in zip(docs[::2], docs[1::2]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert far > 10 and got(out) == kept(docs) == [(False, 2 * i) for i in range(40)]


@pytest.mark.parametrize("small", [1, 8, 1000])
def test_keep_first(spark, small):
    """Small and large buckets; copies below the threshold stay; a chain joins texts that are not alike themselves."""
    draw = random.Random(8)
    base = " ".join(f"w{draw.randrange(400)}" for _ in range(200))
    docs = [(100 + i, edited(draw, base, draw.choice([1, 2, 3, 5, 8, 14]))) for i in range(60)]
    other = edited(draw, base, 12)
    docs += [(200 + i, edited(draw, other, 1)) for i in range(12)]
    for i in range(12):
        docs.append((300 + i, base := edited(draw, base, 2)))
    docs += [(1, "One two"), (2, "one  TWO"), (3, ""), (4, None), (5, " "), (None, docs[0][1]), (6, "a b c d e"), (6, "a b c d e"), (6, "f g h i j k")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, NODE int")
    out = near_copies.keep_first(df, small=small)
    assert out.columns == df.columns and got(out) == kept(docs)
    assert near_copies.keep_first(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_strays_of_a_hub(spark, seed):
    """Cut and edited copies, many too far from the text they come from, but alike among themselves."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(300)}" for _ in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(60):
        text = " ".join(base[: draw.choice([120, 100, 92, 88, 84, 80, 76])])
        docs.append((1 + i, edited(draw, text, draw.choice([0, 1, 2, 4, 6]))))
    for family in range(4):
        other = edited(draw, " ".join(base), 5)
        docs += [(100 + 10 * family + i, edited(draw, other, 1)) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(near_copies.keep_first(df, small=2)) == kept(docs)


def test_repeated_rows_leave_one(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(1, text), (1, text), (2, text + " i"), (3, "x")], "doc_id long, text string")
    assert got(near_copies.keep_first(df, threshold=0.8)) == [(False, 1), (False, 3)]


def test_fingerprints_give_candidates(spark):
    """What op9's rule links by five-word fingerprints is found without any band: edited copies, and many of one fingerprint."""
    draw = random.Random(9)
    docs = []
    for i in range(30):
        text = " ".join(f"w{draw.randrange(400)}" for _ in range(400))
        docs += [(2 * i, text), (2 * i + 1, text + " end")]
    near = [i for (i, a), (_, b) in zip(docs[::2], docs[1::2]) if (simhash.simhash(a.encode(), 5) ^ simhash.simhash(b.encode(), 5)).bit_count() <= 2]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = {i for _, i in got(near_copies.keep_first(df, bands=1, rows=3000))}
    assert len(near) > 20 and not {i + 1 for i in near} & left and {i for i, _ in docs[::2]} <= left


def test_batches_are_bounded(spark):
    """An operator's Python code is given a bounded number of rows at a time, however large Spark's batches are."""
    df = spark.range(2500).coalesce(1)
    rows = add_columns(df, struct_type(n=T.LongType()), lambda: lambda batch: [pa.array([batch.num_rows] * batch.num_rows, pa.int64())]).collect()
    assert sorted(r.id for r in rows) == list(range(2500)) and max(r.n for r in rows) <= 1000
