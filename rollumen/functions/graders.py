"""Rule-based graders as column expressions: (solution, gold) -> struct<score, pred, ...>, and their dispatch by source.

Nothing is executed and nothing is evaluated: code results are aggregated from recorded runs, and mathematical equality
is that of normalised text (functions.latex)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollumen.functions import latex, text
from rollumen.operators.masked import once

Grader = Callable[[Column, Column], Column]

#: Fixed values, in the order in which they are applied to an answer.
DAPO_SUBSTITUTIONS = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
)
#: Expressions that are dropped from an answer, in order.
DAPO_REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm",
    "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
    "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
#: Sources by grader.
SOURCES = {
    "gsm8k": ("openai/gsm8k",),
    "math": ("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500"),
    "dapo": ("math_dapo", "math", "math_dapo_reasoning"),
    "zoom": ("zoom-bench", "zoom-bench-crop"),
    "qa_em": ("searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa", "searchR1_2wikimultihopqa", "searchR1_musique", "searchR1_bamboogle"),
    "geo3k": ("hiyouga/geometry3k",),
    "code": ("codecontests", "apps", "codeforces", "taco"),
    "prime": ("numina_aops_forum", "numina_synthetic_math", "numina_amc_aime", "numina_synthetic_amc", "numina_cn_k12", "numina_olympiads"),
}


def _tail(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.substring(s, -n, n)).otherwise(s)


def _last(s: Column, pattern: str) -> Column:
    """The first group of the last match; null without one."""
    return F.try_element_at(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), F.lit(-1))


def _result(score: Column, pred: Column, **more: Column) -> Column:
    return F.struct(score.cast("double").alias("score"), pred.alias("pred"), *[v.alias(k) for k, v in more.items()])


def gsm8k_answer(solution: Column, method: str = "strict") -> Column:
    s = _tail(solution, 300)
    if method == "strict":
        return F.replace(F.replace(_last(s, r"#### (-?[0-9.,]+)"), F.lit(","), F.lit("")), F.lit("$"), F.lit(""))
    found = F.regexp_extract_all(s, F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    good = F.filter(found, lambda x: ~x.isin("", "."))
    # with nothing but full stops, the first of them is left over
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.try_element_at(found, F.lit(1)))


def gsm8k(solution: Column, gold: Column, method: str = "strict", format_score: float = 0.0, score: float = 1.0) -> Column:
    a = gsm8k_answer(solution, method)
    return _result(F.when(a.isNull(), 0.0).when(a == gold, score).otherwise(format_score), a)


def qa_answer(solution: Column) -> Column:
    return text.strip(_last(solution, r"(?s)<answer>(.*?)</answer>"))


def _count(s: Column, word: str) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(word), F.lit("")))) / len(word)


def qa_em(solution: Column, gold: Column, format_score: float = 0.0, score: float = 1.0) -> Column:
    """gold: array<string>. Over ten opening or closing tags quarter the score."""
    a = qa_answer(solution)
    many = (_count(solution, "<answer>") > 10) | (_count(solution, "</answer>") > 10)
    return _result(F.when(a.isNull(), 0.0).when(text.exact_match(a, gold), F.when(many, score / 4).otherwise(score)).otherwise(format_score), a)


def qa_sub_em(solution: Column, gold: Column, format_score: float = 0.0, score: float = 1.0) -> Column:
    a = qa_answer(solution)
    return _result(F.when(a.isNull(), 0.0).when(text.contains_gold(a, gold), score).otherwise(format_score), a)


def zoom(solution: Column, gold: Column, question_type: Column) -> Column:
    """Multiple choice by letters; else numbers if both sides have one, else normalised text."""
    a = text.grader_answer(solution)
    mcq = F.lower(text.strip(F.coalesce(question_type, F.lit("")))) == "mcq"
    letter = text.first_option(a)
    p, g = text.first_number(a), text.first_number(gold)
    numeric = p.isNotNull() & g.isNotNull()
    ok = F.when(mcq, text.first_letter_match(gold, a)).when(numeric, p == g).otherwise(text.em_normalized(a) == text.em_normalized(gold))
    source = F.when(mcq, "mcq_rule").when(numeric, "numeric_rule").otherwise("normalized_em")
    return _result(ok.cast("int"), F.when(mcq & (letter != ""), letter).otherwise(a), judge_source=source)


def mcq(solution: Column, gold: Column, strict: bool = False) -> Column:
    """The text between the last <answer> and the next </answer>. incorrect_format is 1 when the format IS correct, as
    the data expect; strict gives the plain meaning."""
    a = text.strip(F.substring_index(F.substring_index(solution, "<answer>", -1), "</answer>", 1))
    right = solution.rlike(r"<answer>\s*(A|B|C|D)\s*</answer>$")
    return _result((a == gold).cast("int"), a, incorrect_format=(~right if strict else right).cast("int"))


def gpqa(solution: Column, gold: Column) -> Column:
    """The last A to D that stands alone in the upper-cased text, else the text without full stops at its ends."""
    bare = F.regexp_replace(text.strip(solution), r"^\.+|\.+$", "")
    a = F.coalesce(_last(F.upper(solution), r"\b(A|B|C|D)\b"), F.regexp_replace(F.regexp_replace(bare, r"\.+$", ""), "/+$", ""))
    return _result((a == gold).cast("int"), a, incorrect_format=(~a.isin("A", "B", "C", "D")).cast("int"))


def mmlu_pro(solution: Column, gold: Column) -> Column:
    """`answer is (X)`, else `Answer: X`, else the last A to J that stands alone."""
    a = F.coalesce(
        text.blank_to_null(F.regexp_extract(solution, r"(?i)answer is \(?([A-J])\)?", 1)),
        text.blank_to_null(F.regexp_extract(solution, r"(?i)Answer:\s*([A-J])", 1)),
        _last(solution, r"\b([A-J])\b"),
        F.lit(""),
    )
    return _result((a == gold).cast("int"), a, incorrect_format=(~a.rlike("^[A-J]$")).cast("int"))


def dapo_normalized(x: Column) -> Column:
    s = F.substring_index(x, "=", -1)
    for a, b in DAPO_SUBSTITUTIONS:
        s = F.replace(s, F.lit(a), F.lit(b))
    for a in DAPO_REMOVED:
        s = F.replace(s, F.lit(a), F.lit(""))
    s = F.regexp_replace(s, r"(.*?)\$(.*?)\$(.*)", r"\$$2\$")
    for word in ("text", "textbf", "overline"):
        s = F.regexp_replace(s, r"\\" + word + r"\{(.*?)\}", "$1")
    s = F.regexp_replace(s, r"\\boxed\{(.*)\}", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"(frac)([^{])(.)", r"frac{$2}{$3}"), r"(sqrt)([^{])", r"sqrt{$2}")
    s = F.replace(s, F.lit("$"), F.lit(""))
    plain = F.replace(s, F.lit(","), F.lit(""))
    return text.strip(F.when(plain.rlike(r"^\d+$"), plain).otherwise(s))


def dapo(solution: Column, gold: Column) -> Column:
    """1 or -1: the last `Answer:` line of the last 300 characters against the gold answer, both normalised."""
    a = F.coalesce(_last(_tail(solution, 300), r"(?i)Answer\s*:\s*([^\n]+)"), F.lit("[INVALID]"))
    p = dapo_normalized(a)
    ok = p == dapo_normalized(gold)
    return _result(F.when(ok, 1.0).otherwise(-1.0), p, acc=ok)


def strict_box(solution: Column, gold: Column) -> Column:
    p = text.unboxed(text.last_boxed(_tail(solution, 100)))
    return _result(F.when(p == gold, 1.0).otherwise(-1.0), p)


def math(solution: Column, gold: Column) -> Column:
    """The last boxed answer equals the gold answer after normalisation."""
    p = text.unboxed(text.last_boxed(solution))
    return _result(F.coalesce(latex.equivalent(p, gold), F.lit(False)).cast("int"), p)


def prime(solution: Column, gold: Column) -> Column:
    p = text.unboxed(text.last_boxed(solution))
    return _result(F.coalesce(latex.math_equal(p, gold), F.lit(False)).cast("int"), p)


def format_reward(solution: Column) -> Column:
    return solution.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$").cast("double")


def geo3k(solution: Column, gold: Column, format_score: float = 0.1) -> Column:
    p = text.unboxed(text.last_boxed(solution))
    right = F.coalesce(latex.math_equal(p, gold), F.lit(False)).cast("double")
    return _result((1 - format_score) * right + format_score * format_reward(solution), p)


def feedback_math(solution: Column, gold: Column, truncated: Column, train: bool = False, tell: bool = False) -> Column:
    """Boxed answer of the last 100 characters, with a sentence of feedback. train: half a point off for a missing box."""
    p = F.coalesce(text.unboxed(text.last_boxed(_tail(solution, 100))), F.lit(""))

    def told(x: Column) -> Column:
        ok, bad = (x["p"] == gold) | x["same"], x["p"] == ""
        says = (
            F.when(bad & ~truncated, "The answer has the wrong format: write it as \\boxed{your_answer}.")
            .when(truncated, "The response was cut off at the maximum length.")
            .when(~ok & F.lit(tell), F.concat(F.lit("The answer is not correct; it should be "), gold, F.lit(".")))
            .otherwise("")
        )
        score = ok.cast("double") - F.when(F.lit(train) & bad & ~truncated, 0.5).otherwise(0.0)
        return _result(score, x["p"], acc=ok.cast("double"), incorrect_format=bad.cast("int"), feedback=says)

    return once(F.struct(p.alias("p"), F.coalesce(latex.math_equal(p, gold), F.lit(False)).alias("same")), told)


def tool_use(solution: Column, actions: Column, inputs: Column) -> Column:
    """Equal multisets of action names, and equal merged inputs (map<string,string> of JSON texts; later keys win, broken
    blocks are skipped)."""
    found = F.regexp_extract_all(solution, F.lit(r"Action:\s*(\w+)"), F.lit(1))
    blocks = F.regexp_extract_all(solution, F.lit(r"(?s)Action Input:\s*(\{.*?\})"), F.lit(1))
    merged = merge_maps(F.filter(F.transform(blocks, lambda b: F.from_json(b, "map<string,string>", {"mode": "PERMISSIVE"})), lambda m: m.isNotNull()))
    same = (F.array_sort(found) == F.array_sort(actions)) & (F.array_sort(F.map_entries(merged)) == F.array_sort(F.map_entries(inputs)))
    return _result(same.cast("int"), F.array_join(found, ","), incorrect_format=(~solution.rlike(r"(?s)Action:.*?\nAction Input:")).cast("int"))


def merge_maps(maps: Column) -> Column:
    """One map of an array of maps; the later value of a key wins."""
    empty = F.expr("cast(map() as map<string,string>)")
    return F.aggregate(maps, empty, lambda a, m: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(m, k)), m))


GRADERS: dict[str, Grader] = {"gsm8k": gsm8k, "math": math, "dapo": dapo, "geo3k": geo3k, "prime": prime}


def score_by_source(source: Column, solution: Column, gold: Column, question_type: Column | None = None, statuses: Column | None = None, unknown: Column | None = None) -> Column:
    """The score that a row's source calls for; code sources by the recorded statuses of their tests, if given. An unknown
    source is an error when its row is read, or has the score `unknown`, if given."""
    kind = question_type if question_type is not None else F.lit(None).cast("string")
    branches = {
        "gsm8k": gsm8k(solution, gold), "math": math(solution, gold), "dapo": dapo(solution, gold), "geo3k": geo3k(solution, gold),
        "prime": prime(solution, gold), "zoom": zoom(solution, gold, kind), "qa_em": qa_em(solution, F.array(gold)),
    }
    out = F if statuses is None else F.when(source.isin(*SOURCES["code"]), code_score(statuses, continuous=True))
    for name, result in branches.items():
        hit = source.isin(*SOURCES[name])
        if name == "dapo":
            hit = hit | F.startswith(source, F.lit("aime"))
        out = out.when(hit, result["score"])
    return out.otherwise(F.raise_error(F.concat(F.lit("no grader for source "), source)).cast("double") if unknown is None else unknown)


#: Status of a recorded test run: passed, failed, service error, runtime error, timeout, compile error.
PASSED, FAILED, SERVICE, RUNTIME, TIMEOUT, COMPILE = 1, 0, -1, -2, -3, -4


def code_score(statuses: Column, continuous: bool = False) -> Column:
    """From recorded statuses in order. A compile error fails all later cases. All passed, or (continuous) the share passed
    of the first ten."""
    init = F.struct(F.lit(False).alias("broken"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(a: Column, s: Column) -> Column:
        broken = a["broken"] | (s == COMPILE)
        return F.struct(broken.alias("broken"), F.concat(a["out"], F.array(F.when(broken, COMPILE).otherwise(s).cast("int"))).alias("out"))

    final = F.aggregate(statuses, init, step, lambda a: a["out"])
    if continuous:
        ten = F.slice(final, 1, 10)
        return F.try_divide(F.size(F.filter(ten, lambda s: s == PASSED)).cast("double"), F.size(ten))
    return F.forall(final, lambda s: s == PASSED).cast("double")


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (longest - buffer)) / buffer * factor, F.lit(0.0))
