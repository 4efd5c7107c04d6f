"""The range coder's round trips, and datasets against the tokenizer."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexquarry.llm import id_coder, packing, token_files
from lexquarry.llm.queries import queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def blocks(draw):
    words = [draw.randrange(49408) for _ in range(300)]
    return [
        [], [1], [49407] * 3000, [0] * 70, list(range(2000)), [draw.randrange(65536) for _ in range(1500)], [draw.choice(words) for _ in range(4096)],
        [words[int(draw.paretovariate(0.8)) % 300] for _ in range(4000)], (words * 9)[:2600],
    ]


def test_coder_round_trip():
    some = [np.array(b, np.uint32) for b in blocks(random.Random(4))]
    packed = id_coder.pack(some)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(id_coder.unpack(packed), some))
    # a block stands alone: others beside it, and the order, change nothing
    assert [id_coder.pack([b])[0] for b in some] == packed
    assert all((id_coder.unpack([p])[0] == b).all() for p, b in zip(packed, some))
    assert id_coder.pack([]) == [] and id_coder.unpack([]) == []
    size = {i: 8 * len(p) / max(1, len(b)) for i, (p, b) in enumerate(zip(packed, some))}
    assert size[2] < 0.3 and size[8] < 6 and size[6] < 11 and size[5] < 18.5  # repeats are learnt, and noise costs little more than its bits


def test_wide_ids():
    draw = random.Random(5)
    some = [np.array([draw.randrange(1 << 20) for _ in range(900)], np.uint32), np.array([7, (1 << 20) - 1], np.uint32)]
    assert all((a == b).all() for a, b in zip(id_coder.unpack(id_coder.pack(some, 20), 20), some))
    with pytest.raises(ValueError, match="bits"):
        id_coder.pack(some, 16)


@pytest.mark.parametrize("bad", [b"", b"IDX1", lambda p: p[:-4], lambda p: b"XXXX" + p[4:], lambda p: p[:40] + bytes([p[40] ^ 1]) + p[41:], lambda p: p[:4] + bytes([p[4] ^ 1]) + p[5:]])
def test_damage_is_found(bad):
    block = np.array(random.Random(6).choices(range(49408), k=500), np.uint32)
    packed = id_coder.pack([block])[0]
    with pytest.raises(ValueError):
        id_coder.unpack([bad(packed) if callable(bad) else bad])


def test_joined_crc():
    draw = random.Random(7)
    for n in (0, 1, 5, 1000):
        a, b = draw.randbytes(37), draw.randbytes(n)
        assert token_files.joined_crc(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_joined_crcs():
    draw = random.Random(9)
    some = [(draw.randbytes(11), draw.randbytes(n)) for n in (0, 1, 5, 4096, 100_000)]
    joined = token_files.joined_crc(*([f(a, b) for a, b in some] for f in (lambda a, b: zlib.crc32(a), lambda a, b: zlib.crc32(b), lambda a, b: len(b))))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in some]


def test_batch_of_texts(tokenizer):
    """Texts tokenized at once have the ids of each alone, whatever is kept from others."""
    odd = ["", " ", "a", "don't stop", "Ünï ÀÞß÷× é×b ×", "x1y 22", "日本 語 word", "\x00 \x1f a\x7fb \x85 \xa0 \xad", "<|endoftext|> !!a", "e\u0301 \u212a ſ İ", "ends in blank \n", "A" * 500, "Ã\xa0", "\u2028a\u3000b"]
    draw = random.Random(10)
    odd += ["".join(draw.choices("aZ É÷×!?'\n\t9ß語\x00-", k=draw.randrange(40))) for _ in range(400)]
    tokens = packing.WordTokens(PATH, most=20)
    for texts in (odd, odd[::-1], odd[:1], [], odd[5:9]):
        ids, ends = tokens.encode_all([t.encode() for t in texts], 1)
        got = [x.tolist() for x in np.split(ids, ends)[:-1]]
        assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts] and len(ids) == sum(map(len, got))
    with pytest.raises(ValueError):
        tokens.encode_all([b"a\xffb"], 1)


def test_long_runs_and_long_blocks():
    """Runs of one id, after which another comes, do not upset the mixer; blocks may have more ids than frequencies sum to."""
    draw = random.Random(11)
    some = [np.array(b, np.uint32) for b in ([7] * 40_000 + [8, 7, 9] * 50, [draw.randrange(4096) for _ in range(9000)], list(range(4096)), [5])]
    packed = id_coder.pack(some)
    assert all((a == b).all() for a, b in zip(id_coder.unpack(packed), some))
    assert len(packed[0]) < 500
    with pytest.raises(ValueError, match="different ids"):
        id_coder.pack([np.arange(4097, dtype=np.uint32)])


def expected(docs, tokenizer):
    """Rows in order of id; those of one id in any order, so as sets of lengths and checksums."""
    out, start = [], 0
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_query(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries()["op13_token_files"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == expected(docs, tokenizer)


def test_odd_rows(spark, tokenizer):
    long = "é<|endoftext|> word " * 5000
    docs = [(5, "b"), (1, None), (3, ""), (None, "nameless"), (9, long), (7, "tie"), (7, "tie"), (8, "\x00 ﷐"), (2, long[:9000])]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, start int, part string")
    got = sorted((tuple(r) for r in token_files.round_trip(df, PATH).collect()), key=lambda r: r[1])
    assert got == expected(docs, tokenizer)
    assert token_files.round_trip(df.where("false"), PATH).count() == 0


def test_ids_and_many_parts(spark, tokenizer, tmp_path):
    """String ids, ids read back as such, and a table in several parts that are no longer than a few blocks."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    draw = random.Random(8)
    docs = [(f"d{i:04}", " ".join(draw.choices(words, k=draw.randrange(300)))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(df, str(tmp_path / "set"), PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = token_files.blocks(spark, str(tmp_path / "set"))
    assert found.select("part").distinct().count() > 1
    rows = token_files.decode(found, ids=True).orderBy("part", "begin", "at").collect()
    read = {}
    for r in rows:
        read.setdefault(r.id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert read == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in docs}
    assert [r.id for r in rows] == sorted(r.id for r in rows)
    damaged = found.withColumn("data", F.when(F.col("block") == 0, F.concat(F.expr("substring(data, 1, 20)"), F.unhex(F.lit("FF")), F.expr("substring(data, 22)"))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="damaged: one of part"):
        token_files.documents(damaged).collect()
