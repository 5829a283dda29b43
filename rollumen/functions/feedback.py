"""Feedback on answers: code blocks, failing tests, and graders by source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollumen.functions import graders, latex, text
from rollumen.operators.masked import once

#: Feedback graders by source, and sources of the judge's rules.
SOURCES = {
    "code": ("code", "livecodebench", "humanevalplus"),
    "math": ("math", "math500", "dapo_math", "gsm8k"),
    "gpqa": ("gpqa",),
    "mcq": ("sciknoweval",),
    "tool_use": ("tooluse",),
}
#: Longest message, most lines of a message, longest feedback.
MESSAGE, LINES, WHOLE = 250, 8, 2000


def code_blocks(solution: Column) -> Column:
    """The bodies of fenced blocks, in order."""
    return F.regexp_extract_all(solution, F.lit(r"(?s)```[A-Za-z0-9_+-]*\n(.*?)```"), F.lit(1))


def longest_code_block(solution: Column) -> Column:
    """The longest fenced block, the first of equal ones; null without any."""
    empty = F.lit(None).cast("string")
    return F.aggregate(code_blocks(solution), empty, lambda a, b: F.when(a.isNull() | (F.length(b) > F.length(a)), b).otherwise(a))


def first_failures(tests: Column, most: int = 2) -> Column:
    """tests array<struct<input, passed, ...>>: the failing ones with the shortest inputs, in that order (ties: as they come)."""
    failing = F.filter(F.transform(tests, lambda t, i: F.struct(F.length(t["input"]).alias("n"), i.alias("i"), t.alias("t"))), lambda x: ~x["t"]["passed"])
    return F.transform(F.slice(F.array_sort(failing), 1, most), lambda x: x["t"])


def cut_message(message: Column) -> Column:
    """At most LINES lines and MESSAGE characters."""
    return F.substring(F.array_join(F.slice(F.split(message, "\n"), 1, LINES), "\n"), 1, MESSAGE)


def test_feedback(error: Column, timed_out: Column, well_formed: Column, tests: Column) -> Column:
    """What to tell of recorded test runs: an error first, then a timeout, a bad format, wrong answers; else nothing."""
    wrong = F.array_join(F.transform(first_failures(tests), lambda t: F.concat(F.lit("Wrong answer for input "), cut_message(t["input"]), F.lit("."))), "\n")
    says = (
        F.when(F.length(error) > 0, F.concat(F.lit("The code raised an error: "), cut_message(error)))
        .when(timed_out, F.lit("The code ran out of time."))
        .when(~well_formed, F.lit("The response has no complete code block."))
        .otherwise(wrong)
    )
    return F.substring(says, 1, WHOLE)


def feedback_by_source(source: Column, solution: Column, gold: Column, statuses: Column, truncated: Column, actions: Column | None = None, inputs: Column | None = None) -> Column:
    """The feedback score that a row's source calls for; code by recorded statuses, tools by their wanted actions (array<string>) and merged inputs
    (map<string,string>). Another source is an error when read, as is a source of tools where these aren't given."""
    branches = {
        "code": graders.code_score(statuses), "math": graders.feedback_math(solution, gold, truncated)["score"],
        "gpqa": graders.gpqa(solution, gold)["score"], "mcq": graders.mcq(solution, gold)["score"],
    }
    if actions is not None and inputs is not None:
        branches["tool_use"] = graders.tool_use(solution, actions, inputs)["score"]
    out = F
    for name, score in branches.items():
        out = out.when(source.isin(*SOURCES[name]), score)
    return out.otherwise(F.raise_error(F.concat(F.lit("no feedback grader for source "), source)).cast("double"))


def judged(kind: Column, answer: Column, gold: Column, asked: Column | None = None) -> Column:
    """(judge, judge_source) by the rules in turn: yes/no for kind pope, a or b for mmvp, equal answers, and the first letter
    for kind mcq; what is left has the source `llm` and the verdict `asked` (null without one)."""
    own = text.judge_answer(answer)

    def source(x: Column) -> Column:
        right, option = F.lower(text.strip(gold)), text.a_or_b(x["own"])
        rules = (
            ("pope_exact", (kind == "pope") & (text.yes_no(x["own"]) == right)),
            ("mmvp_option", (kind == "mmvp") & (option != "") & (option == right)),
            ("mathruler", x["same"]),
            ("first letter", (kind == "mcq") & text.first_letter_match(gold, x["own"])),
        )
        out = F
        for name, hit in rules:
            out = out.when(hit, name)
        return out.otherwise("llm")

    def verdict(name: Column) -> Column:
        return F.struct(F.when(name == "llm", asked if asked is not None else F.lit(None).cast("string")).otherwise("Yes").alias("judge"), name.alias("judge_source"))

    same = F.coalesce(latex.math_equal(gold, own), F.lit(False))
    return once(once(F.struct(own.alias("own"), same.alias("same")), source), verdict)
