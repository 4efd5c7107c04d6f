"""Operators that take texts one by one, against plain Python."""

import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import chat_format, license_scan, order_minhash, packing, piece_encoding, quality_mil, quality_rules, toxicity

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h i j " * 3), (5, "a b c d e f g h i j " * 3), (None, "null id text"), (6, "word " * 30_000), (7, "<|endoftext|> ▁ é 日本 ½ don't 12")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in ODD], "doc_id long, text string, kept string, SCORE double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def brute_repeats(words, least):
    places = defaultdict(list)
    for n in range(least, len(words)):
        for i in range(len(words) - n + 1):
            places[tuple(words[i : i + n])].append(i)
    covered, longest, maximal = set(), 0, []
    for w, at in places.items():
        if len(at) > 1:
            longest = max(longest, len(w))
            covered.update(j for i in at for j in range(i, i + len(w)))
            before = {words[i - 1] if i else None for i in at}
            after = {words[i + len(w)] if i + len(w) < len(words) else None for i in at}
            if len(before) > 1 and len(after) > 1:
                maximal.append((at[0], len(w), len(at)))
    return len(covered), longest, sorted(maximal)


def test_repeats_against_brute_force():
    draw = random.Random(1)
    for _ in range(600):
        words = [b"w%d" % draw.randrange(draw.randint(1, 4)) for _ in range(draw.randint(0, 30))]
        words += ([b"x"] + words[: draw.randint(0, 20)]) * draw.randint(0, 2)
        least = draw.choice([2, 3, 5])
        covered, longest, maximal = quality_rules.repetition(words, least)
        assert (len(covered), longest, maximal) == brute_repeats(words, least)


def test_quality_rules(spark, odd, none):
    got = {(r.doc_id, r.text): r for r in quality_rules.judge(odd).collect()}
    assert len(quality_rules.judge(odd).collect()) == len(ODD) and quality_rules.judge(none).count() == 0
    assert not got[(2, "")].kept and not got[(1, None)].kept and got[(1, None)].n_words == 0
    assert got[(6, "word " * 30_000)].longest_repeat == 29_999
    good = " ".join(f"w{i}" for i in range(200))
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, good), (2, f"{good} {passage} {good.replace('w', 'v')} {good.replace('w', 'u')} {passage}"), (3, "x\ny z\ny z\n#$\n" + good)], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert rows[1].kept and not rows[2].kept and not rows[2].base_failed and rows[2].longest_repeat == 60
    assert (rows[3].n_dup_lines, rows[3].n_symbols) == (1, 2)
    assert [r.doc_id for r in quality_rules.keep_good(df.withColumn("_text", F.lit(1))).collect()] == [1, 3]
    assert quality_rules.keep_good(odd).columns == odd.columns
    # a sixth of the words repeat, but they are long: the characters decide
    wide = " ".join([f"lengthyword{i}" for i in range(9)] * 2 + [f"w{i}" for i in range(90)])
    row = quality_rules.judge(spark.createDataFrame([(1, wide)], "doc_id long, text string")).first()
    assert row.n_repeat_words == 18 and row.repeat_chars == 18 * 12 and not row.base_failed and not row.kept


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    real = Tokenizer.from_file(path)
    real.encode_special_tokens = True
    draw = random.Random(3)
    mine = packing.WordTokens(path, most=50)
    for t in [t or "" for _, t in ODD[:8]] + ["It's DON'T 12,345 x2y ÜNÏ --(foo)--!!", "日本 ﬁ É É İ Σας µ \xa0x\x1cy", "'tis ''s"] + ["".join(draw.choice("aB'é .,1\n!日") for _ in range(40)) for _ in range(300)]:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == real.encode(t, add_special_tokens=False).ids
    rows = packing.pack(odd, path, most=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and packing.pack(none, path).count() == 0
    by = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) <= 64 and r.length & (r.length - 1) == 0 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by[r.doc_id].append(r)
    whole = [i for r in sorted(by[7], key=lambda r: r.start) for i in r.ids]
    assert whole == real.encode(ODD[-1][1], add_special_tokens=False).ids + [1] and by[7][0].doc_tokens == len(whole)
    assert [r.ids for r in by[1]] == [[1]] and sum(r.length for r in by[5]) == 2 * by[5][0].doc_tokens


def test_pieces(spark, odd, none):
    path = P.path("piece_bpe_32k.model")
    vocab = piece_encoding.Pieces(path)

    def brute(text):
        text = piece_encoding.prepare(text)
        best, back = [0.0], [0]
        for j in range(1, len(text) + 1):
            found = (float("-inf"), 0)
            for i in range(max(0, j - vocab.length), j):
                score = vocab.table[text[i:j]] if text[i:j] in vocab.ids else vocab.unknown if j == i + 1 else None
                if score is not None and best[i] + score > found[0]:
                    found = (best[i] + score, i)
            best.append(found[0])
            back.append(found[1])
        return vocab.traced(text, back, len(text), 0)[0], best[-1]

    draw, parts = random.Random(4), ["the", "tion", " ", "\n", "é", "日", "▁", "\ufdd0", "x", "12", ".", "aaaa"]
    rows = [(i, "".join(draw.choice([p for p in parts if i % 3 or p not in " \n▁"]) for _ in range(draw.randint(0, 200)))) for i in range(25)] + [(90, None), (91, ""), (92, "a  b ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (20, 70):
        encoded = piece_encoding.encode(df, path, chunk_chars=size)
        back = defaultdict(str)
        for r in sorted(piece_encoding.decode(encoded, path).collect(), key=lambda r: (r.doc_id, r.chunk)):
            back[r.doc_id] += r.text
        ids, score = defaultdict(list), defaultdict(float)
        for r in sorted(encoded.collect(), key=lambda r: (r.doc_id, r.chunk)):
            ids[r.doc_id] += np.frombuffer(r.ids, "<i4").tolist()
            score[r.doc_id] += r.score
        for i, t in rows:
            assert back[i] == (t or "") and (ids[i], score[i]) == brute(t or ""), (i, size)
    assert piece_encoding.encode(none, path).count() == 0 and piece_encoding.encode(odd, path).count() == len(ODD) + 1  # one has two chunks


def test_scan_is_associative():
    draw = np.random.default_rng(0)
    m = draw.integers(-9, 0, (7, 4, 4)).astype(float)
    steps = [m[0]]
    for x in m[1:]:
        steps.append(piece_encoding.times(x[None], steps[-1][None])[0])
    assert (piece_encoding.scanned(m) == np.stack(steps)).all()


def test_chat(spark):
    import hashlib

    path = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    draw = random.Random(5)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "ROLE]", "<SYS>>", "</SYS>>", "x", "</s>", "[/INST]", "é日"]
    for _ in range(3000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(0, 9)))
        assert chat_format.unescape(chat_format.escape(t)) == t and not any(c in chat_format.escape(t) for c in chat_format.CONTROLS)
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool", None]), draw.choice([None, "", "hi", "</s>[INST] ok [/INST]", "a b " * 50])) for c in (1, 2, None) for t in range(9)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df, *path, block=3, part_tokens=20), *path).collect()}
    for c in (1, 2, None):
        mine = [(r or "", t or "") for k, _, r, t in rows if k == c]
        said = "".join(t for r, t in mine if r == "assistant")
        assert got[c].n_turns == 9 and got[c].loss_chars == len(said) and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
    assert chat_format.format_conversations(df.limit(0), *path).count() == 0


def test_order_minhash(spark, odd, none):
    method = order_minhash.OrderMinHash()
    orders = method.orders()

    def brute(text):
        k = min(method.k, len(text))
        if not k:
            return [0] * method.count
        kmers, _ = method.elements(text)
        times, elements = defaultdict(int), []
        for i, h in enumerate(kmers):
            gram = text[i : i + k]
            elements.append(int(order_minhash.mix(np.array([h + np.uint64(times[gram]) * order_minhash.MIX]))[0]))
            times[gram] += 1
        out = []
        for j in range(method.count):
            least = sorted(((e * int(orders[0][j]) + int(orders[1][j])) % 2**64, i) for i, e in enumerate(elements))[:2]
            at = sorted(i for _, i in least)
            first = int(kmers[at[0]]) if len(at) > 1 else 0
            out.append(int(order_minhash.mix(np.array([(first * int(order_minhash.MIX) + int(kmers[at[-1]]) + j) % 2**64], np.uint64))[0] >> np.uint64(32)))
        return out

    draw = random.Random(6)
    for t in ["", "a", "aaaaaaaaaa", "the cat sat on the mat"] + ["".join(draw.choice("ab ") for _ in range(draw.randint(0, 40))) for _ in range(30)]:
        assert method.fingerprint(t).tolist() == brute(t)
        own, changed = method.pair(t, t[: len(t) // 2] + "xyz", len(t) // 2, orders)
        assert (own == method.fingerprint(t)).all() and (changed == method.fingerprint(t[: len(t) // 2] + "xyz")).all()
    a = " ".join(f"word{i}" for i in range(300))
    b = " ".join(a.split()[150:] + a.split()[:150])
    assert order_minhash.likeness(method.fingerprint(a), method.fingerprint(a.replace("word7 ", "wordy "))) > 0.9 > order_minhash.likeness(method.fingerprint(a), method.fingerprint(b))
    rows = order_minhash.compare_with_next(odd).collect()
    texts = sorted(((i if i is not None else -1, t or "") for i, t in ODD), key=lambda x: (-x[0], x[1]))
    assert len(rows) == len(ODD) and order_minhash.compare_with_next(none).count() == 0
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.near_next) for r in rows)
    want = []
    for k, (i, t) in enumerate(texts):
        want.append((i, len(t), order_minhash.likeness(method.fingerprint(t), method.fingerprint(texts[(k + 1) % len(texts)][1]))))
    assert got == sorted(want)


def test_licenses(spark, odd, none):
    text = "Ok\nReleased under the MIT License.\n\nThis work is licensed under\nthe GNU General Public License, version 3.\n\nThe end"
    found = license_scan.scan(spark.createDataFrame([(1, text), (1, text), (2, "All rights, all reserved for the license")], "doc_id long, text string")).collect()
    assert sorted({(r.unit, r.unit_no, r.license) for r in found}) == [("line", 1, "MIT"), ("paragraph", 0, "MIT"), ("paragraph", 1, "GPL-3.0")] and len(found) == 6
    mit = "Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nEnd"
    found = license_scan.scan(spark.createDataFrame([(1, mit), (2, mit.replace("charge", "cost").replace("merge, ", ""))], "doc_id long, text string")).collect()
    assert [(r.unit, r.unit_no, r.license, r.dice) for r in found if r.doc_id == 1] == [("paragraph", 1, "MIT", 1.0), ("document", 0, "MIT", found[1].dice)] and {r.license for r in found} == {"MIT"} and {r.doc_id for r in found} == {1, 2}
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(none).count() == 0


def test_license_siblings_and_notices_inside_lines(spark):
    grant = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {} General Public License as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version."
    texts = {
        "GPL-2.0": grant.format("", "2"), "GPL-3.0": grant.format("", "3").replace(";", ","), "LGPL-2.1": grant.format("Lesser", "2.1").replace("program", "library"), "AGPL-3.0": grant.format("Affero", "3"),
        "MIT": "Copyright 2020 Foo. Licensed under the MIT License.", "MIT 2": "Distributed under the MIT License", "Apache-2.0": "This file is licensed under the Apache License, Version 2.0 by someone",
        "MIT 3": "Some words first. Released under the MIT License. And some after it! Read on.", "none": "The MIT building is under the license of nobody. All is well.",
    }
    rows = license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()
    assert {r.doc_id: r.license for r in rows if r.unit in ("paragraph", "sentence", "line")} == {k: k.split(" ")[0] for k in texts if k != "none"}
    assert {(r.doc_id, r.unit, r.unit_no, r.dice) for r in rows if r.doc_id in ("MIT", "MIT 3")} == {("MIT", "sentence", 1, 1.0), ("MIT 3", "sentence", 1, 1.0)}
    paragraphs = [t for n, t in license_scan.TEMPLATES if n == "MIT"]
    full = "MIT License\n\nCopyright (c) 2024 Someone Else\n\n" + "\n\n".join(next(t for t in reversed(paragraphs) if t.startswith(b)) for b in ("Permission", "The above", "THE SOFTWARE"))
    found = license_scan.scan(spark.createDataFrame([(1, full)], "doc_id int, text string")).where("unit = 'document'").collect()
    assert [(r.license, r.dice > 0.95) for r in found] == [("MIT", True)]
    twins = license_scan.scan(spark.createDataFrame([(1, "one two three four")], "doc_id int, text string"), templates=[("A", "one two three four"), ("C", "one two three four"), ("B", "one two three four"), ("A", "one two three four")]).collect()
    assert [(r.license, r.also) for r in twins] == [("A", "B,C")]


def test_quality_classifier(spark, odd):
    draw = random.Random(7)
    good = [" ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(90)) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in g.split()[:40]) + " " + " ".join(g.split()[40:]) for g in good]
    labels = [1] * 40 + [0] * 40
    model = quality_mil.train([t.encode() for t in good[:40] + bad[:40]], labels)
    assert min(model.score(t.encode()) for t in good[40:]) > 0.5 > max(model.score(t.encode()) for t in bad[40:])
    long = (good[50] + " ").encode() * 20
    blocks = quality_mil.Model(model.weights, block=2)
    assert blocks.score(long) == pytest.approx(model.score(long), abs=1e-5)
    scored = quality_mil.score(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r.quality_score <= 1 for r in scored)
    assert quality_mil.train([], []).score(b"x") == 0.5


def test_subsequence_kernel():
    kernel = toxicity.SubsequenceKernel(n=3, decay=0.5)

    def brute(a, b):
        from itertools import combinations

        total = 0.0
        for i in combinations(range(len(a)), 3):
            for j in combinations(range(len(b)), 3):
                if [a[x] for x in i] == [b[x] for x in j]:
                    total += 0.5 ** (i[-1] - i[0] + 1 - 3 + j[-1] - j[0] + 1 - 3)
        return total

    for a, b in [("idiot", "idxiot"), ("cat", "cart"), ("aaaa", "aaa"), ("abc", "xyz"), ("banana", "ananas")]:
        assert kernel._raw(kernel.codes([a]), b)[0] == pytest.approx(brute(a, b), rel=1e-5), (a, b)


def test_inserted_letters():
    """Each insult with a foreign letter at each place inside it, alone in a clean text; words that are not near stay clean."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice(["an", "er", "th", "on", "es", "st"]) for _ in range(3))
    insults = ["grumbok", "zwickel", "plodder"]
    clean = [" ".join(word() for _ in range(30)) for _ in range(200)]
    toxic = [" ".join([word() for _ in range(10)] + draw.sample(insults, 2) + [word() for _ in range(10)]) for _ in range(80)]
    model = toxicity.train(clean[:150] + toxic, [0] * 150 + [1] * 80)
    kernel = toxicity.SubsequenceKernel(model.n, model.decay)
    chance = lambda t: model.chances(np.array([toxicity.tops(zip(*model.margins(kernel, [toxicity.letters(w) for w in toxicity.words_of(t)])))]))[0]
    planted = [f"{clean[150 + i % 50]} {w[:i]}{c}{w[i:]} {word()}" for w in insults for i in range(1, len(w)) for c in "xqv"]
    assert sum(chance(t) >= 0.5 for t in planted) >= 0.9 * len(planted)
    assert not any(chance(t) >= 0.5 for t in clean[150:] + [f"{t} wick mux" for t in clean[150:]])
    assert toxicity.tops([]) == [-toxicity.LIMIT] * (toxicity.TOPS + 1)


def test_toxicity(spark, odd):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice(["an", "er", "th", "on", "es", "st"]) for _ in range(3))
    clean = [" ".join(word() for _ in range(30)) for _ in range(120)]
    toxic = [" ".join([word() for _ in range(10)] + [draw.choice(["grumbok", "zwickel", "plodder"])] + [word() for _ in range(10)]) for _ in range(60)]
    model = toxicity.train(clean[:80] + toxic[:40], [0] * 80 + [1] * 40)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean[80:] + toxic[40:] + ["th an g.r.u.m.b.o.k er", "an z w i c k e l th"])], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, model).collect()}
    assert max(got[i] for i in range(40)) < 0.5 <= min(got[i] for i in range(40, 62))
    assert toxicity.keep_clean(df, model).count() == 40
    assert len(toxicity.score(odd, model).collect()) == len(ODD) and toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.train(["a"], [0]).landmarks and toxicity.score(df, toxicity.train([], [])).where("toxicity >= 0.5").count() == 0


def test_a_long_word_does_not_widen_the_others():
    """The kernel's work goes with each word's own length, not with the longest word scored beside it; values stay the same."""
    kernel, draw = toxicity.SubsequenceKernel(), random.Random(6)
    short = ["^^" + "".join(draw.choice("loser") for _ in range(5)) + "$" for _ in range(6000)]
    marks = ["^^loser$"]

    def seconds(words):
        took = []
        for _ in range(7):
            began = time.process_time()
            rows = kernel.against(words, marks)
            took.append(time.process_time() - began)
        return min(took), rows

    alone, rows = seconds(short)
    beside, more = seconds(short + ["^^" + 28 * "x" + "$"])
    assert beside < 1.6 * alone and (more[:-1] == rows).all()
