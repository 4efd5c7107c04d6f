"""Reports of the five analyses, whole."""

import json

from pyspark.sql import functions as F

from lexquarry.functions import reports
from lexquarry.operators import runs


def shown(spark, kind, result, names=None):
    df = spark.createDataFrame([(json.dumps(result), names)], "body string, names array<string>")
    return df.select(reports.report(kind, F.from_json("body", runs.SCHEMAS[kind]), F.col("names"))).first()[0]


def test_simplify(spark):
    result = {
        "document_type": "Lease", "one_line_summary": "A flat is let.", "parties": [{"name": "A", "role": "owner"}, {"name": "B", "role": "tenant"}], "plain_summary": "You rent.",
        "key_points": [{"point": "Deposit", "quote": " one month ", "location": "Page 1"}, {"point": "Pets", "quote": " ", "location": ""}], "sections": [{"heading": "Rent", "explanation": "Due."}, {"heading": "End", "explanation": "A month."}], "terms_explained": [],
    }
    assert shown(spark, "simplify", result) == (
        "## Lease\n\n**A flat is let.**\n\n**Parties:** A (owner); B (tenant)\n\n## In plain words\n\nYou rent.\n\n## Key points\n\n- Deposit (Page 1)\n> \"one month\"\n- Pets\n\n"
        "## Section by section\n\n### Rent\n\nDue.\n\n### End\n\nA month.\n\n"
    )


def test_risks(spark):
    clause = lambda title, risk, **more: {"title": title, "risk": risk, "explanation": "why", "quote": "q", "suggestion": ""} | more
    result = {
        "risk_score": 70, "overall_risk": "high", "verdict": "Careful.", "favours": "owner", "clauses": [clause("low one", "low"), clause("high one", "high", suggestion="less"), clause("mid one", "medium", quote=""), clause("high two", "high")],
        "obligations": [{"party": "you", "obligation": "pay", "deadline": "monthly"}], "red_flags": [], "inconsistencies": [{"issue": "dates", "quote": "a", "conflicting_quote": "b"}], "key_dates": [], "missing_clauses": [{"clause": "repairs", "why_it_matters": "cost"}],
    }
    text = shown(spark, "risks", result)
    assert text.startswith("## Risk score: 70/100 (high)\n\nCareful.\n\n**Favours:** owner\n\n## Clauses\n\n### [HIGH] high one\n\nwhy\n\n> \"q\"\n\n**Ask for:** less\n\n### [HIGH] high two\n\nwhy\n\n> \"q\"\n\n\n### [MEDIUM] mid one\n\nwhy\n\n\n\n### [LOW] low one")
    assert text.endswith('## Contradictions\n\n- **dates**\n> "a"\n> "b"\n\n## Obligations\n\n| Who | Must do | By when |\n|---|---|---|\n| you | pay | monthly |\n\n\n## Missing protections\n\n- **repairs**: cost\n') and "Red flags" not in text


def test_compare_plan_and_brief(spark):
    result = {"summary": "S", "better_for_user": "B", "reason": "R", "differences": [{"topic": "rent", "doc_a": "5", "doc_b": "4", "favours": "B"}], "only_in_a": [{"clause": "pets", "impact": "none"}], "only_in_b": [], "negotiation_points": ["price", "term"]}
    assert shown(spark, "compare", result, ["Old", "New"]) == (
        "## Verdict\n\n**Better for you:** New\n\nR\n\nS\n\n## Differences\n\n| Topic | A: Old | B: New | Better |\n|---|---|---|---|\n| rent | 5 | 4 | B |\n\n## Only in A\n\n- **pets**: none\n\n\n## What to negotiate\n\n- price\n- term\n"
    )
    assert "**Better for you:** Neither" in shown(spark, "compare", result | {"better_for_user": "equal"}, ["Old"])
    plan = {"situation_summary": "s", "legal_position": "p", "legal_basis": [], "options": [{"option": "Talk", "pros": ["quick", "cheap"], "cons": [], "effort": "low", "best_when": "early"}], "checklist": [{"task": "Write", "why": "proof", "deadline": "Monday", "priority": "high"}, {"task": "Call", "why": "w", "deadline": "", "priority": "low"}], "deadlines": [], "documents_to_gather": ["lease"]}
    assert shown(spark, "action_plan", plan) == (
        "## Your position\n\np\n\n_s_\n\n\n## Options\n\n### Talk\n\n- Effort: low\n- Best when: early\n- Pros: quick; cheap\n- Cons: \n\n## Checklist\n\n1. **Write** (high priority, deadline: Monday): proof\n2. **Call** (low priority, deadline: ): w\n\n\n## Documents to gather\n\n- lease\n"
    )
    brief = {"case_summary": "c", "goal": "g", "timeline": [{"date": "May", "event": "signed"}], "key_facts": [], "legal_issues": ["x"], "questions_to_ask": [{"question": "May I?", "why": "unsure"}], "documents_to_bring": [], "open_points": []}
    assert shown(spark, "lawyer_brief", brief) == "## Case summary\n\nc\n\n**Goal:** g\n\n## Timeline\n\n- **May**: signed\n\n\n## Legal issues\n\n- x\n\n## Questions to ask\n\n1. **May I?** (unsure)\n\n\n"
