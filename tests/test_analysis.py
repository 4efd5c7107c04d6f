"""Quotes of any JSON result, found and marked wherever they lie."""

import json

from pyspark.sql import functions as F

from lexquarry.operators import analysis

LEASE = "The deposit shall be refunded within 30 days. Either party may end this lease with one month's written notice."
OTHER = "Pets are allowed only with the written consent of the owner."


def marked(spark, results, sides=False, rules=analysis.QUOTES, depth=None):
    df = spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(results)], "id int, body string")
    sources = [(i, 1, LEASE, "a") for i in range(len(results))] + [(i, 2, OTHER, "b") for i in range(len(results))]
    held = spark.createDataFrame(sources, "id int, source_id int, text string, side string")
    rows = analysis.annotated(df, held if sides else held.drop("side"), "id", "body", rules, depth).orderBy("id").collect()
    return [(r.result and json.loads(r.result), (r.verified, r.partial, r.unverified)) for r in rows]


def test_three_shapes(spark):
    report = {"clauses": [{"title": "Deposit", "quote": "deposit shall be refunded"}, {"title": "Invented", "quote": "tenant forfeits everything"}, {"quote": " "}], "score": 1.5}
    deep = {"a": [[{"b": {"quote": "written consent of the owner"}}], [], {"quote": ["not a string", {"quote": "pets are allowed"}]}], "quote": "within 30 days", "é": None}
    pairs = {"inconsistencies": [{"quote": "one month's written notice", "conflicting_quote": "three months notice"}]}
    cut = {"quote": "The deposit shall be refunded ... one month’s written notice"}
    got = marked(spark, [report, deep, pairs, cut, [], "no json", None, '"quote"', [{"quote": "30 days"}], {"quote": 5}])
    assert [c["quote_status"] for c in got[0][0]["clauses"]] == ["verified", "unverified", "none"] and got[0][1] == (1, 0, 1) and got[0][0]["score"] == 1.5
    assert got[1][0]["a"][0][0]["b"]["quote_status"] == "verified" and got[1][0]["a"][2]["quote"][1]["quote_status"] == "verified"
    assert "quote_status" not in got[1][0]["a"][2] and got[1][0]["quote_status"] == "verified" and got[1][1] == (3, 0, 0) and got[1][0]["é"] is None
    assert got[2][0]["inconsistencies"][0] == {"quote": "one month's written notice", "conflicting_quote": "three months notice", "quote_status": "verified", "conflicting_quote_status": "unverified"}
    assert got[3][0]["quote_status"] == "verified"
    assert got[4] == ([], (0, 0, 0)) and got[5] == (None, (0, 0, 0)) and got[6] == (None, (0, 0, 0)) and got[7] == ("quote", (0, 0, 0))
    assert got[8][0][0]["quote_status"] == "verified" and got[9] == ({"quote": 5}, (0, 0, 0))


def test_compared_sides(spark):
    """Each side's quotes are held against that side's document alone."""
    result = {
        "differences": [{"quote_a": "deposit shall be refunded", "quote_b": "deposit shall be refunded"}, {"quote_a": "pets are allowed only", "quote_b": "pets are allowed only"}],
        "only_in_a": [{"quote": "within 30 days"}], "only_in_b": [{"quote": "within 30 days"}], "summary": {"quote": "within 30 days"},
    }
    [(got, counts)] = marked(spark, [result], True, analysis.COMPARED)
    assert [(d["quote_a_status"], d["quote_b_status"]) for d in got["differences"]] == [("verified", "unverified"), ("unverified", "verified")]
    assert got["only_in_a"][0]["quote_status"] == "verified" and got["only_in_b"][0]["quote_status"] == "unverified" and "quote_status" not in got["summary"]
    assert counts == (3, 0, 3)


def test_nesting(spark):
    df = spark.createDataFrame([('{"a": [[{"b": 1}], {"c": "]] [[[[[ \\" [[["}]}',), ("[1, 2]",), ("bad [[[[[[",), (None,)], "body string")
    assert analysis.nesting(df, "body") == 4 and analysis.nesting(df.where("false"), "body") == 0


def test_results_are_made_once(spark):
    """However many steps read results and quotes, a row's result is made once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def result(text):
        made.add(1)
        return '{"clauses": [{"quote": "' + text + '"}, {"quote": "of nobody at all"}]}'

    docs = spark.createDataFrame([(i, f"the rent of flat {i} is due") for i in range(20)], "id long, text string")
    rows = analysis.annotated(docs.select("id", result("text").alias("result")), docs.withColumn("source_id", F.col("id")), "id", "result").collect()
    assert {(r.verified, r.partial, r.unverified) for r in rows} == {(1, 0, 1)} and len(rows) == 20 and made.value == 20
