"""Results of analyses as Markdown: sections told as templates, filled in by Column functions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexquarry.functions.text import strip


@dataclass(frozen=True)
class Section:
    """A heading and what follows: `text` with the fields of the result, or `item` for each element of the array `of`, `between`
    two of them and `after` the last. Without elements an optional section is empty."""

    text: str = ""
    of: str = ""
    item: str = ""
    between: str = "\n"
    after: str = ""
    optional: bool = True


def listed(heading: str, of: str, item: str = "{}") -> Section:
    return Section(f"## {heading}\n\n", of, f"- {item}", "\n", "\n")


def tabled(heading: str, of: str, names: str, item: str, optional: bool = True) -> Section:
    return Section(f"## {heading}\n\n| {names} |\n{'|---' * (names.count('|') + 1)}|\n", of, f"| {item} |", "\n", "\n", optional)


#: The sections of each analysis' report. {field} is a field, {} an element that has none, {n} its number; {field:quote},
#: {field:upper} and {field:joined} are shown as a quotation (none if blank), in capitals, and joined; [text {field}] is left out
#: where the field is blank; \\x01 and \\x02 stand for brackets that are shown.
REPORTS = {
    "simplify": [
        Section("## {document_type}\n\n**{one_line_summary}**\n"), Section("**Parties:** ", "parties", "{name} ({role})", "; ", "\n"), Section("## In plain words\n\n{plain_summary}\n"),
        Section("## Key points\n\n", "key_points", "- {point}[ ({location})]\n{quote:quote}", "", "", False), Section("## Section by section\n\n", "sections", "### {heading}\n\n{explanation}\n", "\n", "", False),
        listed("Terms explained", "terms_explained", "**{term}**: {meaning}"),
    ],
    "risks": [
        Section("## Risk score: {risk_score}/100 ({overall_risk})\n\n{verdict}\n\n**Favours:** {favours}\n"),
        Section("## Clauses\n\n", "clauses", "### \x01{risk:upper}\x02 {title}\n\n{explanation}\n\n{quote:quote}\n[**Ask for:** {suggestion}\n]", "\n", "", False),
        Section("## Red flags\n\n", "red_flags", "- **{issue}**: {why_it_matters}\n{quote:quote}", ""), Section("## Contradictions\n\n", "inconsistencies", "- **{issue}**\n{quote:quote}{conflicting_quote:quote}", ""),
        tabled("Obligations", "obligations", "Who | Must do | By when", "{party} | {obligation} | {deadline}"), listed("Key dates", "key_dates", "**{date}**: {event}"), listed("Missing protections", "missing_clauses", "**{clause}**: {why_it_matters}"),
    ],
    "compare": [
        Section("## Verdict\n\n**Better for you:** {better_name}\n\n{reason}\n\n{summary}\n"), tabled("Differences", "differences", "Topic | A: {name_a} | B: {name_b} | Better", "{topic} | {doc_a} | {doc_b} | {favours}", False),
        listed("Only in A", "only_in_a", "**{clause}**: {impact}"), listed("Only in B", "only_in_b", "**{clause}**: {impact}"), listed("What to negotiate", "negotiation_points"),
    ],
    "action_plan": [
        Section("## Your position\n\n{legal_position}\n\n_{situation_summary}_\n"), listed("Legal basis", "legal_basis", "**{law}**: {relevance}"),
        Section("## Options\n\n", "options", "### {option}\n\n- Effort: {effort}\n- Best when: {best_when}\n- Pros: {pros:joined}\n- Cons: {cons:joined}\n", "\n", "", False),
        Section("## Checklist\n\n", "checklist", "{n}. **{task}** ({priority} priority, deadline: {deadline}): {why}", "\n", "\n", False),
        tabled("Deadlines", "deadlines", "When | What | If you miss it", "{date} | {what} | {consequence}"), listed("Documents to gather", "documents_to_gather"),
    ],
    "lawyer_brief": [
        Section("## Case summary\n\n{case_summary}\n\n**Goal:** {goal}\n"), listed("Timeline", "timeline", "**{date}**: {event}"), listed("Key facts", "key_facts"), listed("Legal issues", "legal_issues"),
        Section("## Questions to ask\n\n", "questions_to_ask", "{n}. **{question}** ({why})", "\n", "\n"), listed("Documents to bring", "documents_to_bring"), listed("Still to confirm", "open_points"),
    ],
}

FIELD = re.compile(r"\{(\w*)(?::(\w+))?\}")
#: Signs that stand for the brackets which are text, while those of optional parts are taken out.
OPEN, CLOSE = "\x01", "\x02"


def filled(template: str, value: Column, n: Column | None = None, more: dict[str, Column] | None = None) -> Column:
    """A template with the fields of a struct (or the value itself) in their places; null is empty."""

    def field(name: str, shown: str | None) -> Column:
        if name == "n" and n is not None:
            return n.cast("string")
        column = value if not name else more[name] if more and name in more else value[name]
        if shown == "joined":
            return F.coalesce(F.array_join(column, "; "), F.lit(""))
        text = F.coalesce(column.cast("string"), F.lit(""))
        trimmed = strip(text)
        return {None: text, "upper": F.upper(text), "quote": F.when(trimmed == "", "").otherwise(F.concat(F.lit('> "'), trimmed, F.lit('"\n')))}[shown]

    def parts(text: str) -> Column:
        split = FIELD.split(text)  # text, name, shown, text, ...
        shown = [F.lit(split[0].replace(OPEN, "[").replace(CLOSE, "]"))]
        for name, how, rest in zip(split[1::3], split[2::3], split[3::3]):
            shown += [field(name, how), F.lit(rest.replace(OPEN, "[").replace(CLOSE, "]"))]
        return F.concat(*shown)

    out = []
    for i, piece in enumerate(re.split(r"\[([^\]]*)\]", template)):
        if i % 2:
            name = FIELD.search(piece)[1]
            out.append(F.when(strip(field(name, None)) == "", "").otherwise(parts(piece)))
        elif piece:
            out.append(parts(piece))
    return F.concat(*out) if out else F.lit("")


def by_risk(clauses: Column) -> Column:
    """Clauses by falling risk, those of one risk in their order."""
    place = lambda c: F.when(c["risk"] == "high", 0).when(c["risk"] == "medium", 1).otherwise(2)
    ordered = F.array_sort(F.transform(clauses, lambda c, i: F.struct(place(c).alias("place"), i.alias("i"), c.alias("c"))))
    return F.transform(ordered, lambda x: x["c"])


def report(kind: str, result: Column, names: Column | None = None) -> Column:
    """The Markdown of a result as a struct of runs.SCHEMAS[kind]. names: an array of its documents' names, for a comparison."""
    more = {}
    if kind == "compare":
        name = [F.coalesce(F.get(names, F.lit(i)), F.lit("")) for i in (0, 1)]
        more = {"name_a": name[0], "name_b": name[1], "better_name": F.when(result["better_for_user"] == "A", name[0]).when(result["better_for_user"] == "B", name[1]).otherwise("Neither")}
    shown = []
    for s in REPORTS[kind]:
        heading = filled(s.text, result, None, more)
        if not s.of:
            shown.append(heading)
            continue
        items = by_risk(result[s.of]) if s.of == "clauses" else result[s.of]
        items = F.transform(items, lambda x, i: filled(s.item, x, i + 1, more))  # noqa: B023 (called at once)
        whole = F.concat(heading, F.coalesce(F.array_join(items, s.between), F.lit("")), F.lit(s.after))
        shown.append(F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "").otherwise(whole) if s.optional else whole)
    return F.concat_ws("\n", *shown)
