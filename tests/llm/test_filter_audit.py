"""The filter audit against a plain walk over every order."""

import re
from itertools import permutations

from lexquarry.llm import filter_audit


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = []
    for k, (i, text, part) in enumerate(docs):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        fails["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        rows.append((part or "", i, {x for x, f in fails.items() if f}))
    out = {}
    for part in {p for p, _, _ in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[2]]
                fail = [r for r in own if x in r[2]]
                left = [r for r in left if x not in r[2]]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(fail) - len(gone), sum(r[2] == {x} for r in own), sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [
        (1, long, "a"), (2, long, "a"), (3, long, "b"), (3, long, "b"), (4, "SHORT $", "a"), (5, None, None), (6, "", "a"), (7, "", ""), (None, long, "a"), (None, long, "c"), (8, long.upper(), "b"),
        (9, "x " * 80, "b"), (10, "x " * 80 + "#", "a"), (11, long + " |", "c"), (12, long + " é" * 40, "a"), (1, long, "a"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, 0, 0), (4, None, 1), (8, 1, 0), (9, None, None), (None, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, n int")
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = got.collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.NUMBERS] for r in rows} == plain(docs, labels)
    assert len(rows) == 600 * 4
    assert dict(got.dtypes)["step"] == "int" and dict(got.dtypes)["shapley"] == "bigint"


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
