"""String functions of dataset preparation and answer extraction, as native column expressions.

strip() removes all white space at both ends (trim() only spaces). A null text gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THINK = r"(?s)<think>.*?</think>\s*"
#: ASCII punctuation, as a character class.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.when(F.length(x) > 0, x)


def clean_question(x, hint: str) -> Column:
    """Without image placeholders and without the hint, with or without a blank line before it."""
    bare = strip(F.replace(_c(x), F.lit("<image>"), F.lit("")))
    return strip(F.replace(F.replace(bare, F.lit("\n\n" + hint), F.lit("")), F.lit(hint), F.lit("")))


def with_suffix(x, suffix: str) -> Column:
    """Appended unless it is there."""
    return F.when(F.endswith(_c(x), F.lit(suffix)), _c(x)).otherwise(F.concat(_c(x), F.lit(suffix)))


def option_lines(options: Column) -> Column:
    """`(A) text` for each option that isn't blank, lettered by place, one on a line."""
    lettered = F.transform(options, lambda x, i: F.when(F.length(F.trim(x)) > 0, F.concat(F.lit("("), F.char(65 + i), F.lit(") "), x)))
    return F.array_join(F.filter(lettered, lambda x: x.isNotNull()), "\n")


def after_last_think(x) -> Column:
    return F.substring_index(_c(x), "</think>", -1)


def without_think(x) -> Column:
    return F.regexp_replace(_c(x), THINK, "")


def normalized_answer(x) -> Column:
    """After the last </think>: the last <answer>...</answer>, else from the first `Answer:` on, else all."""
    text = strip(after_last_think(x))
    tagged = F.element_at(F.filter(F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), lambda a: a.isNotNull()), -1)
    at = F.instr(text, "Answer:")
    return F.when(text.rlike(r"(?s)<answer>.*?</answer>"), strip(tagged)).when(at > 0, strip(F.substring(text, at + 7, F.length(text)))).otherwise(text)


def _tagged(x: Column, keep_prefix: bool, ordered: bool) -> Column:
    a, b = F.instr(x, "<answer>"), F.instr(x, "</answer>")
    # an end before the start gives the empty text, unless order is asked for
    inner = F.when(b >= a + 8, strip(F.substring(x, a + 8, b - a - 8))).otherwise(F.lit(""))
    at = F.instr(x, "Answer:")
    rest = strip(F.substring(x, at + (0 if keep_prefix else 7), F.length(x)))
    found = (a > 0) & (b > a if ordered else b > 0)
    return F.when(found, inner).when(at > 0, rest).otherwise(strip(x))


def judge_answer(x) -> Column:
    """From the first <answer> to the first </answer>; else from `Answer:` on, prefix kept."""
    return _tagged(_c(x), True, False)


def grader_answer(x) -> Column:
    """As judge_answer, but the prefix goes and the tags must be in order; null gives ''."""
    return F.coalesce(_tagged(_c(x), False, True), F.lit(""))


def first_option(x) -> Column:
    """A capital in parentheses, else one before . ) or white space, else the first capital; else ''."""
    s = _c(x)
    tries = [blank_to_null(F.regexp_extract(s, p, 1)) for p in (r"\(([A-Z])\)", r"([A-Z])[.)\s]", r"([A-Z])")]
    return F.coalesce(*tries, F.lit(""))


def mcq_option(x) -> Column:
    """A leading A to F, alone or closed by a mark; else ''."""
    return F.coalesce(F.regexp_extract(strip(x), r"^[ (\[]*([A-F])(?:(?=$)|[.)\]]|(?:[:\-]\s+))", 1), F.lit(""))


def first_letter_match(gold, answer) -> Column:
    g, p = mcq_option(gold), first_option(answer)
    return (g != "") & (p != "") & (g == p)


def yes_no(x) -> Column:
    """yes or no from the start of an answer, else from its last word; else the stripped text. null gives ''."""
    s = _c(x)
    t = strip(F.regexp_replace(s, r"^\*+", ""))
    # the word is cut at its lower-case form only
    cut = F.when(F.instr(t, "answer") > 0, F.substring(t, F.instr(t, "answer") + 6, F.length(t))).otherwise(t)
    t = F.when(F.startswith(F.lower(t), F.lit("answer")), strip(F.regexp_replace(F.regexp_replace(cut, "^:+", ""), r"^\*+", ""))).otherwise(t)
    last = F.lower(F.regexp_replace(F.element_at(F.split(strip(F.regexp_replace(F.regexp_replace(t, r"\.+$", ""), r"\*+$", "")), r"\s+"), -1), r"^\*+|\*+$", ""))
    low = F.lower(t)
    return F.coalesce(
        F.when(F.startswith(low, F.lit("yes")), "yes").when(F.startswith(low, F.lit("no")), "no").when(last.isin("yes", "no"), last).otherwise(strip(s)),
        F.lit(""),
    )


def a_or_b(x) -> Column:
    """(a) or (b), from parentheses or else a word of its own; else ''."""
    t = F.lower(strip(x))
    tries = [blank_to_null(F.regexp_extract(t, p, 1)) for p in (r"\(([ab])\)", r"\b([ab])\b")]
    return F.coalesce(F.concat(F.lit("("), F.coalesce(*tries), F.lit(")")), F.lit(""))


def qa_normalized(x) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces, in this order."""
    bare = F.regexp_replace(F.lower(_c(x)), PUNCTUATION, "")
    return strip(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def em_normalized(x) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(F.lower(_c(x))), PUNCTUATION, ""), r"\s+", " "))


def exact_match(prediction, gold: Column) -> Column:
    p = qa_normalized(prediction)
    return F.exists(gold, lambda g: qa_normalized(g) == p)


def contains_gold(prediction, gold: Column) -> Column:
    p = qa_normalized(prediction)
    return F.exists(gold, lambda g: F.contains(p, qa_normalized(g)))


def first_number(x) -> Column:
    """The first number, thousands separators dropped, as an exact decimal; null without one."""
    s = F.replace(_c(x), F.lit("\u2212"), F.lit("-"))
    found = F.regexp_extract(s, r"-?\d+(?:,\d{3})*(?:\.\d+)?", 0)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("decimal(38,18)")


def last_boxed(x) -> Column:
    r"""The last \boxed{...} or \fbox{...} with balanced braces, by one fold over the characters from there on; `\boxed `
    runs to the next $. null if there is none or the braces don't close."""
    s = _c(x)
    spaced = F.concat(F.lit("\\boxed "), F.substring_index(F.substring_index(s, "\\boxed ", -1), "$", 1))
    last = lambda word: F.length(s) - F.length(F.substring_index(s, word, -1)) - len(word) + 1
    start = F.when(F.contains(s, F.lit("\\boxed")), last("\\boxed")).when(F.contains(s, F.lit("\\fbox")), last("\\fbox"))
    tail = F.substring(s, start, F.length(s))
    init = F.struct(F.lit(0).alias("open"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(a: Column, ch: Column) -> Column:
        now = a["open"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        n = a["n"] + 1
        return F.struct(now.alias("open"), n.alias("n"), F.when((a["end"] == 0) & (ch == "}") & (now == 0), n).otherwise(a["end"]).alias("end"))

    # no lambda takes the text, which would be cut anew for each letter
    end = F.aggregate(F.regexp_extract_all(tail, F.lit("(?s)."), F.lit(0)), init, step, lambda a: F.when(a["end"] > 0, a["end"]))
    return F.when(F.contains(s, F.lit("\\boxed ")), spaced).otherwise(F.substring(tail, F.lit(1), end))


def unboxed(x) -> Column:
    r"""What stands in \boxed{...} or after `\boxed `; null for anything else."""
    inside = F.regexp_extract_all(_c(x), F.lit(r"(?s)(?<=\A\\boxed ).*|(?<=\A\\boxed\{).*(?=\}\z)"), F.lit(0))
    return F.try_element_at(inside, F.lit(1))


def empty_or_error(x) -> Column:
    """Records to try again: null, blank, or an error mark."""
    s = strip(x)
    return s.isNull() | (s == "") | F.startswith(s, F.lit("[API_ERROR]")) | F.startswith(s, F.lit("[FUTURE_ERROR]"))


def sample_uid(benchmark: Column, keys: dict[str, Column], fallback: Column) -> Column:
    """bench:key:value for the first key that isn't blank, else sha1 of the fallback text."""
    tries = [F.when(F.length(v.cast("string")) > 0, F.concat(benchmark, F.lit(f":{k}:"), v.cast("string"))) for k, v in keys.items()]
    return F.coalesce(*tries, F.concat(F.lit("sha1:"), F.sha1(fallback)))


def metric_key(x) -> Column:
    """A name that metric back ends take: @ as _at_, single slashes, other characters as _."""
    return F.regexp_replace(F.regexp_replace(F.replace(_c(x), F.lit("@"), F.lit("_at_")), "/+", "/"), r"[^A-Za-z0-9_./\- ]", "_")


def passages(titles_and_texts: Column) -> Column:
    """Doc i (Title: ...) for an array of strings whose first line is the title."""

    def one(x: Column, i: Column) -> Column:
        title = F.substring_index(x, "\n", 1)
        return F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), title, F.lit(")\n"), F.substring(x, F.length(title) + 2, F.length(x)), F.lit("\n"))

    return F.array_join(F.transform(titles_and_texts, one), "")


def judge_prompt(question, gold, response) -> Column:
    return F.concat(
        F.lit("Your task is to judge whether the response expresses the same meaning as the answer of a question.\nThe question is: "), _c(question),
        F.lit("\nThe answer is: "), _c(gold), F.lit("\nThe response is: "), _c(response),
        F.lit("\nPlease check and compare them and then judge. If the response is correct, your output should be Yes. Otherwise, your output should be No. Directly give me your output."),
    )


def same_stdout(actual, expected) -> Column:
    return strip(actual) == strip(expected)
