"""Alignments against whole texts, tokenized in one piece and compared byte by byte."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from lexquarry.llm import token_alignment
from lexquarry.llm.queries import queries

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return token_alignment.Pair(*PATHS)


def whole(both, text):
    """Tokens of both with the bytes that they cover, None if a text has none."""
    raw = (" " + text).encode()
    out = []
    for ids, table in ((both.a.encode(" " + text, add_special_tokens=False).ids, both.bytes_a), (both.b.encode(text), both.bytes_b)):
        at, tokens = 0, []
        for i in ids:
            tokens.append((i, at, at + len(table[i])))
            at += len(table[i])
        if b"".join(table[i] for i in ids) != raw:
            return None
        out.append(tokens)
    return out


def plain(both, docs):
    found = [(i, whole(both, t) if t else None) for i, t in docs]
    links = [[(x, y) for x, s, e in f[0] for y, p, q in f[1] if s < q and p < e] if f else [] for _, f in found]
    counts = Counter(pair for own in links for pair in own)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    rows = []
    for (i, f), own in zip(found, links):
        if f is None:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = f
        groups, last = [], 0
        for end in sorted({e for _, _, e in a} & {e for _, _, e in b}):
            groups.append("|".join(",".join(str(x) for x, s, _ in side if last <= s < end) for side in (a, b)))
            last = end
        rows.append((i, len(a), len(b), len(groups), len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(rows, key=repr)


ODD = [
    " ", "  ", "a  b", " a", "a ", "a   ", "\n", " \n x", "x \n\n y\t z ", "a  b", "a　 b  c", "tab\t end", "\x1c x\x85 y", "<|endoftext|> <s> </s> <0x41> [INST]", "ﬁ ① é é ñ", "日本語 テキスト。 中文",
    "🙂🙂 🙂", "it's we'll I'd 've", "don 't stop", "1234567890 12 ,,, ...", "x" * 300, "a b " * 200, "\r\n\r\n a", "\x00 \x01", "﻿ bom", "mixed▁sign stays out", "after▁ it the words stay", "word", "of the of the of", "ü ö ä ß",
]


def test_segments_give_whole_texts(both):
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choices([" ", " ", "a", "the", "\n", "\t", "é", "▁", " ", "'s", "12", "日"], k=draw.randrange(1, 40))) for _ in range(3000)]
    assert both.cuttable
    for text in texts:
        parts = both.segments(text)
        assert " ".join(parts) == text
        of_a = [i for p in parts for i in both.a.encode(" " + p, add_special_tokens=False).ids]
        assert of_a == both.a.encode(" " + text, add_special_tokens=False).ids, text
        assert [i for p in parts for i in both.b.encode(p)] == both.b.encode(text), text


def test_vocabularies_that_reach_across_are_not_cut(both):
    class Wide(token_alignment.Pair):
        def parts_at_spaces(self):
            self.bytes_b.append(b"of the")
            return super().parts_at_spaces()

    assert Wide(*PATHS).segments("a b c") == ["a b c"]


def test_odd_rows(spark, both, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_CHARS", 200)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, ""), (3, ODD[3]), (None, "nameless row"), (102, "mixed▁sign of the stays out")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_a int, segment string").repartition(3)
    got = token_alignment.align(df, *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(both, docs)
    assert token_alignment.align(df.where("false"), *PATHS).count() == 0


def test_query(spark, both):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    docs = [(r.doc_id, r.text) for r in rows if len(r.text) < 4000]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in token_alignment.align(df, *PATHS).collect()), key=repr) == plain(both, docs)
    got = queries()["op12_token_alignment"](spark, SF)
    assert got.count() == len(rows) and dict(got.dtypes)["count_sum"] == "bigint"


def test_ranks_are_the_tokenizer(both):
    """The encoder by ranks gives the ids of the tokenizer's own library."""
    draw = random.Random(2)
    signs = [chr(c) for c in [*range(32, 127), 9, 10, 13, 0x1C, 0x85, 0xA0, 0xE9, 0x301, 0x3000, 0x65E5, 0x1F642, 0x0660, 0x2160, 0x200B, 0xFEFF]] + ["'s", "'ll", " the", "ing", "12"]
    texts = ODD + ["".join(draw.choices(signs, k=draw.randrange(60))) for _ in range(3000)]
    assert both.ranked is not None
    assert both.encoded_a(texts) == [both.a.encode(" " + t, add_special_tokens=False).ids for t in texts]
