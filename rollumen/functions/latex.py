"""Equality of mathematical answers by normalised text and exact numbers. Branching string work runs in one Arrow-batched
UDF; nothing is ever evaluated."""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rollumen.functions.symbolic import symbolic_equal

#: What is dropped or replaced first, in order.
REPLACED = (
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
)
_NUMBER = re.compile(r"-?(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.\d+)?")
_FRACTION = re.compile(r"(-?)\\frac\{(-?\d+)\}\{(-?\d+)\}")


def _braced(text: str, command: str, operands: int) -> str:
    """Braces around single-character operands of a command; text that ends too early stays as it is."""
    out, rest = [], text
    while True:
        head, found, rest = rest.partition(command)
        out.append(head)
        if not found:
            return "".join(out)
        out.append(command)
        if rest.startswith("{") and operands == 2:
            continue
        for _ in range(operands):
            if not rest:
                return text
            if rest[0] == "{":
                break
            out.append("{" + rest[0] + "}")
            rest = rest[1:]


def normalized(text: str) -> str:
    for a, b in REPLACED:
        text = text.replace(a, b)
    text = text.partition("\\text{ ")[0]
    text = text.replace("\\\\%", "").replace("\\%", "")
    text = text.replace(" .", " 0.").replace("{.", "{0.")
    if not text:
        return text
    if text[0] == ".":
        text = "0" + text
    left, equals, right = text.partition("=")
    if equals and "=" not in right and len(left) <= 2:
        text = right
    text = _braced(text, "\\sqrt", 1).replace(" ", "")
    text = _braced(text, "\\frac", 2)
    if text == "0.5":
        return "\\frac{1}{2}"
    if m := re.fullmatch(r"(-?(?:0|[1-9]\d*))/(-?(?:0|[1-9]\d*))", text):
        text = f"\\frac{{{m[1]}}}{{{m[2]}}}"
    return text


def number(text: str) -> Fraction | None:
    """An integer, decimal, percentage, or fraction of integers, exactly; None for anything else."""
    text = text.strip().replace("\\%", "%").strip("$ ")
    percent = text.endswith("%")
    body = text[:-1] if percent else text
    if m := _FRACTION.fullmatch(normalized(body)):
        value = Fraction(int(m[2]), int(m[3])) if int(m[3]) else None
        value = -value if value is not None and m[1] else value
    elif body and _NUMBER.fullmatch(body) and any(c.isdigit() for c in body):
        value = Fraction(body.replace(",", ""))
    else:
        return None
    return value / 100 if percent and value is not None else value


def close(a: Fraction, b: Fraction) -> bool:
    return abs(a - b) <= Fraction(1, 10_000) * max(abs(a), abs(b))


def equal(a: str, b: str) -> bool:
    """Normalised texts are equal, whatever their case; or numbers, to a relative 1e-4, also times or by 100; or tuples, part by part; or they
    have the same canonical form."""
    a, b = a.strip(), b.strip()
    if normalized(a).lower() == normalized(b).lower():
        return True
    x, y = number(a), number(b)
    if x is not None and y is not None:
        return any(close(x, z) for z in (y, y * 100, y / 100))
    if len(a) > 2 and len(b) > 2 and a[0] in "([" and a[0] == b[0] and a[-1] == b[-1]:
        p, q = a[1:-1].split(","), b[1:-1].split(",")
        if len(p) == len(q) > 1 and all(map(equal, p, q)):
            return True
    return symbolic_equal(a, b)


def _pairwise(test):
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else test(x, y) for x, y in zip(a, b)], dtype="object")

    return run


def equivalent(a: Column, b: Column) -> Column:
    return _pairwise(lambda x, y: normalized(x) == normalized(y))(a, b)


def math_equal(a: Column, b: Column) -> Column:
    return _pairwise(equal)(a, b)


def normalized_column(x: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else normalized(v))

    return run(x)
