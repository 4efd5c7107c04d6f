"""Reports of answers: which quotes count, where a scan stops, what the verdict is; and quotes beyond ASCII."""

import random

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import text as X
from lexquarry.operators import grounding as G

LEASE = "The deposit shall be refunded within 30 days after the Tenant vacates. Either party may end this lease with one month's written notice."
RULES = "Pets are allowed only with the written consent of the owner of the house."


def reports(spark, *answers, most=12):
    rows = spark.createDataFrame(list(enumerate(answers)), "answer_id long, answer string")
    sources = spark.createDataFrame([(i, n, t) for i in range(len(answers)) for n, t in ((1, LEASE), (2, RULES))], "answer_id long, source_id int, text string")
    return {r.answer_id: r for r in G.report(rows, sources, most).collect()}


def test_quoted_spans(spark):
    """Against a plain scan: a mark opens a quote if its partner comes within 600 characters of the line, else it is passed over."""

    def plain(text):
        out, at = [], 0
        while at < len(text):
            close = {'"': '"', "“": "”"}.get(text[at])
            end = text.find(close, at + 1) if close else -1
            if end > at + 1 and end - at <= 601 and "\n" not in text[at:end]:
                out.append((text[at + 1 : end].strip(), text[end + 1 : end + 81]))
                at = end
            at += 1
        return out

    draw = random.Random(1)
    texts = ['say "a b" and “c "d" e” then "f', '"" "\n" "x y" [S1]', "none", 'He said "early exit," says "the real one" [S2]', '"' + "z" * 601 + '" "' + "y" * 600 + '"', ""]
    texts += ["".join(draw.choices(['"', "“", "”", "\n", " ", "word", "[S1]", "é", "🙂"], [4, 2, 2, 1, 4, 5, 2, 1, 1], k=draw.randrange(90))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string")
    got = {r.i: r.s and [(x.quote, x.after) for x in r.s] for r in df.select("i", X.quoted_spans(F.col("t")).alias("s")).collect()}
    assert not got.pop(-1) and got == {i: plain(t) for i, t in enumerate(texts)}


def test_reports(spark):
    got = reports(
        spark,
        'The lease says "The deposit shall be refunded within 30 days after the Tenant vacates" [S1].',
        'Clause "EARLY EXIT," says “The deposit shall be refunded within 30 days after the Tenant vacates” [S1].',
        "The penalty is 10% [S9].",
        'It says "the landlord may deduct any amount he likes from the deposit" [S1].',
        'General law: courts award "reasonable compensation not exceeding the amount so named".',
        'Found without a citation: "pets are allowed only with the written consent".' + " x" * 60 + ' and not found, cited too far: "cats are forbidden in every room"' + " y" * 60 + " [S2]",
        'Nearly: "The deposit shall be refunded within 30 days after the Tenant leaves and the keys return" [S1]',
        'Cut: "The deposit shall be refunded ... with one month’s written notice" [S1]. "Pets are allowed only ... on every second Monday" [S2]',
        None,
        "",
    )
    assert [got[i].verdict for i in range(10)] == ["grounded", "grounded", "unverified", "unverified", "general_knowledge", "grounded", "partially_grounded", "unverified", "general_knowledge", "general_knowledge"]
    assert got[0].cited == ["S1"] and (got[0].badge, got[0].tone) == ("1/1", "verified")
    assert got[1].total == 1 and got[2].invalid == ["S9"] and (got[2].badge, got[2].tone) == ("0/0", "none")
    assert got[3].unmatched == ["the landlord may deduct any amount he likes from the deposit"]
    assert got[5].total == 1 and (got[7].badge, got[7].tone, got[7].unverified) == ("1/2", "unverified", 1)


def test_scan_stops_at_the_quotes_that_count(spark):
    """Quotes that do not count take no place among the most; those after the last are not judged."""
    idle = '"words of somebody else entirely here" ' + "." * 90
    held = '"allowed only with the written consent" '
    wrong = '"never seen in any of the sources" [S1] '
    got = reports(spark, (idle + held) * 3 + wrong, (idle + held) * 2 + wrong, most=3)
    assert (got[0].verified, got[0].unverified, got[0].verdict) == (3, 0, "grounded")
    assert (got[1].verified, got[1].unverified, got[1].verdict) == (2, 1, "unverified")


def test_answers_meet_their_own_sources_only(spark):
    answers = spark.createDataFrame([(1, '"allowed only with the written consent" [S1]'), (2, '"allowed only with the written consent" [S1]')], "answer_id long, answer string")
    sources = spark.createDataFrame([(1, 1, RULES), (2, 1, LEASE)], "answer_id long, source_id int, text string")
    assert {r.answer_id: r.verdict for r in G.report(answers, sources).collect()} == {1: "grounded", 2: "unverified"}


@pytest.mark.parametrize(
    "quote,status",
    [("the ﬁrst ofﬁce clause", "verified"), ("rent of １２，０００ rupees", "verified"), ("RENT OF 12,000 RUPEES", "verified"), ("rent of 13,000 rupees a month", "unverified"), ("café au lait", "verified")],
)
def test_normalised_before_grounding(spark, quote, status):
    source = spark.createDataFrame([(1, "The first oﬀice, er, office clause: the first office clause sets rent of 12,000 rupees a ｍonth; café au lait.")], "source_id long, text string")
    got = G.check(spark.createDataFrame([(1, quote)], "quote_id long, quote string"), source).first()
    assert got.status == status


def test_one_pass_over_sources(spark, tmp_path):
    spark.createDataFrame([(1, LEASE)], "source_id long, text string").write.parquet(str(tmp_path / "s"))
    quotes = spark.createDataFrame([(1, "within 30 days")], "quote_id long, quote string")
    plan = G.check(quotes, spark.read.parquet(str(tmp_path / "s")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_places_and_repeats(spark):
    """Runs that all occur, but not in a row, are verified by share and yield to a source that holds them in a row."""
    sources = spark.createDataFrame([(1, "b c d x a b c"), (2, "a b c d"), (3, "a b a b a b a")], "source_id long, text string")
    quotes = spark.createDataFrame([(1, "a b c d"), (2, "a b a b a"), (3, "a b a b a b a b"), (4, "c"), (5, "b a"), (6, "zz"), (7, "d c")], "quote_id long, quote string")
    got = {r.quote_id: (r.status, r.source_id) for r in G.check(quotes, sources).collect()}
    assert got == {1: ("verified", 2), 2: ("verified", 3), 3: ("verified", 3), 4: ("verified", 1), 5: ("verified", 3), 6: ("unverified", None), 7: ("unverified", None)}


def test_scoped_groups_hold_numbers(spark):
    """With a scope neither ids of quotes nor texts of runs are grouped by quote and source, as a task would hold them all."""
    quotes = spark.createDataFrame([(1, "q", "a b c d")], "scope long, quote_id string, quote string")
    sources = spark.createDataFrame([(1, 1, "x a b c d")], "scope long, source_id int, text string")
    plan = G.found(quotes, sources, ["scope"])._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.splitlines() if "Aggregate [" in line and "source_id" in line]
    assert len(groups) == 2 and not any(name in line for line in groups for name in ("gram#", "quote_id#"))


def test_scoped_repeats_and_nulls(spark):
    """Quotes of one id in a scope count together, also with other texts; sources of one id too; nulls meet nothing."""
    asked = [(1, "twice", "a b c d"), (1, "twice", "a b c d"), (1, "two", "a b c"), (1, "two", "x y z"), (1, "one", "d e f g"), (1, None, "a b c d"), (None, "one", "a b c d"), (1, "null", None), (1, "blank", " "), (1, "short", "b c"), (2, "aaa", "a a a a"), (3, "none", "p q r")]
    held = [(1, 1, "a b c d"), (1, 2, "d e f g"), (1, 2, "d e f g"), (1, 3, "d e f x y z"), (2, 1, "a a a a a a"), (2, 2, None), (None, 1, "a b c d")]
    quotes, sources = spark.createDataFrame(asked, "scope long, quote_id string, quote string"), spark.createDataFrame(held, "scope long, source_id int, text string")
    got = sorted((r.scope, r.quote_id or "", r.source_id, r.exact, round(r.coverage, 3)) for r in G.found(quotes, sources, ["scope"]).collect())
    assert got == [
        (1, "", 1, True, 1.0), (1, "one", 2, False, 1.0), (1, "one", 3, False, 0.5), (1, "short", 1, True, 1.0), (1, "twice", 1, False, 1.0), (1, "two", 1, True, 1.0), (1, "two", 3, True, 1.0), (2, "aaa", 1, True, 1.0),
    ]
    rows = G.check(quotes, sources, ["scope"]).collect()
    assert len(rows) == len(asked) and {r.status for r in rows if r.quote_id == "blank"} == {"none"} and {r.status for r in rows if r.quote_id == "null"} == {"unverified"}


def test_runs_only_as_short_as_quotes(spark, tmp_path):
    """Of sources only runs of three words are made while no quote has fewer; with shorter quotes, or none, results are the same."""
    sources = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(20)] + [(20, None), (21, ""), (22, "w1x1 w1x2")], "source_id long, text string")
    sources.write.parquet(str(tmp_path / "s"))
    sources = spark.read.parquet(str(tmp_path / "s"))
    long = [(1, "w3x4 w3x5 w3x6 w3x7"), (2, "w4x1 w4x2 w9x9"), (3, None), (4, " ")]

    def rows_out(asked):
        """What is found, and how many rows the generator of the sources' runs has made."""
        met = G.found(spark.createDataFrame(asked, "quote_id long, quote string"), sources)
        found, made, nodes = {(r.quote_id, r.source_id, r.exact, r.coverage) for r in met.collect()}, [], [met._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            kind = node.getClass().getSimpleName()
            if kind == "GenerateExec":
                made.append(node.metrics().get("numOutputRows").get().value())
            children = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
            nodes += children
        return found, max(made, default=0)

    assert rows_out(long) == ({(1, 3, True, 1.0)}, 20 * 48)
    found, made = rows_out([*long, (5, "w1x1 w1x2"), (6, "w7x0"), (5, "w1x1 w1x2")])
    assert found == {(1, 3, True, 1.0), (5, 1, False, 1.0), (5, 22, False, 1.0), (6, 7, True, 1.0)} and made == 20 * (50 + 49 + 48) + 3
    assert rows_out([(3, None)])[0] == set()
