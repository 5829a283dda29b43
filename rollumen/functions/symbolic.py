"""Equality of mathematical answers by a canonical form: quotients of polynomials with rational coefficients. Nothing is evaluated as code.

An expression of LaTeX or plain text becomes a numerator and a denominator, each a sum of monomials over atoms: variables, pi and e, square
roots (whose squares are put in), and other functions and powers as atoms of their own, by the canonical text of what they hold. Two quotients
are equal if their cross products are the same sum. Constants are equal to a relative 1e-4 too. Matrices, intervals and lists are equal part by part,
equations if their differences are multiples of each other. What can't be read, or grows over TERMS terms, is not equal."""

from __future__ import annotations

import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS, POWER, LENGTH = 500, 40, 2000

# What is read as a function, what stands for a product, and units that are left out.
FUNCTIONS = "sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh ln log exp".split()
PRODUCTS = {"\\cdot", "\\times", "*", "\\ast"}
UNITS = "cm mm km m ft inch inches feet meters miles degrees degree units dollars cents seconds minutes hours grams kg square".split()

_TOKEN = re.compile(r"\s+|(\d+\.?\d*|\.\d+)|(\\[a-zA-Z]+|\\.)|(\*\*|[a-zA-Z]|.)", re.S)
_TEXT = re.compile(r"\\(?:text|mbox|mathrm|textbf)\s*\{([^{}]*)\}")

Sum = dict  # from a monomial, a sorted tuple of (atom, power), to its coefficient


class Unread(ValueError):
    pass


class Roots(dict):
    """From the atom of a square root to the sum under it."""

    def of(self, under: Sum) -> tuple[Sum, Sum]:
        """The root of a sum, as (numerator, denominator)."""
        if len(under) <= 1 and all(not m for m in under):
            value = under.get((), Fraction(0))
            inside, out = abs(value.numerator * value.denominator), 1
            if inside > 10**12:
                raise Unread("a root of a large number")
            result, k = {(): Fraction(1)}, 2
            while k * k <= inside:
                while inside % (k * k) == 0:
                    inside, out = inside // (k * k), out * k
                k += 1
            if inside == 0:
                return {}, {(): Fraction(1)}
            for p in _primes(inside) + ([-1] if value < 0 else []):
                result = self.times(result, self.atom(f"root({p})", {(): Fraction(p)}))
            return {m: c * out for m, c in result.items()}, {(): Fraction(value.denominator)}
        return self.atom(f"root({text_of(under)})", under), {(): Fraction(1)}

    def atom(self, name: str, under: Sum | None = None) -> Sum:
        if under is not None:
            self[name] = under
        return {((name, 1),): Fraction(1)}

    def times(self, a: Sum, b: Sum) -> Sum:
        out: Sum = {}
        if len(a) * len(b) > TERMS * TERMS:
            raise Unread("too many terms")
        for m, x in a.items():
            for n, y in b.items():
                powers = dict(m)
                for atom, k in n:
                    powers[atom] = powers.get(atom, 0) + k
                self._add(out, powers, x * y)
        if len(out) > TERMS:
            raise Unread("too many terms")
        return out

    def _add(self, out: Sum, powers: dict, c: Fraction) -> None:
        """Add c times the powers, with the squares of roots put in."""
        for atom, k in powers.items():
            if k > 1 and atom in self:
                rest = {a: p for a, p in powers.items() if a != atom}
                if k % 2:
                    rest[atom] = 1
                part: Sum = {tuple(sorted(rest.items())): c}
                for _ in range(k // 2):
                    part = self.times(part, self[atom])
                for m, x in part.items():
                    self._add(out, dict(m), x)
                return
        m = tuple(sorted(powers.items()))
        out[m] = out.get(m, Fraction(0)) + c
        if not out[m]:
            del out[m]


def _primes(n: int) -> list[int]:
    out, k = [], 2
    while k * k <= n:
        while n % k == 0:
            out.append(k)
            n //= k
        k += 1
    return out + [n] * (n > 1)


def text_of(s: Sum) -> str:
    return "+".join(f"{c}" + "".join(f"*{a}^{k}" for a, k in m) for m, c in sorted(s.items())) or "0"


def plus(a: Sum, b: Sum, sign: int = 1) -> Sum:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, Fraction(0)) + sign * c
        if not out[m]:
            del out[m]
    return out


class Reader:
    """A recursive descent over tokens; values are (numerator, denominator)."""

    def __init__(self, text: str, roots: Roots) -> None:
        if len(text) > LENGTH:
            raise Unread("a long answer")
        self.roots, self.at = roots, 0
        self.tokens = [t for t in (m.group().strip() for m in _TOKEN.finditer(text)) if t and t not in ("\\left", "\\right", "\\,", "\\!", "\\;", "\\:", "\\ ", "$", "\\$", "\\displaystyle")]

    def look(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        t = self.look()
        if not t or wanted is not None and t != wanted:
            raise Unread(f"no {wanted or 'token'}")
        self.at += 1
        return t

    def whole(self) -> tuple[Sum, Sum]:
        value = self.sum()
        if self.look():
            raise Unread(f"{self.look()} is left")
        return value

    def sum(self) -> tuple[Sum, Sum]:
        sign = 1
        while self.look() in ("+", "-"):
            sign *= -1 if self.take() == "-" else 1
        n, d = self.product()
        n = {m: sign * c for m, c in n.items()}
        while self.look() in ("+", "-"):
            sign = -1 if self.take() == "-" else 1
            p, q = self.product()
            n, d = plus(self.roots.times(n, q), self.roots.times(p, d), sign), self.roots.times(d, q)
        return n, d

    def product(self) -> tuple[Sum, Sum]:
        n, d = self.power()
        while True:
            t = self.look()
            if t in ("/", "\\div"):
                self.take()
                q, p = self.signed()
                if not q:
                    raise Unread("division by zero")
            elif t in PRODUCTS:
                self.take()
                p, q = self.signed()
            elif t and (t.isalnum() or t in ("(", "{", "[") or (t[0] == "\\" and (t[1:] in FUNCTIONS or t in ("\\frac", "\\dfrac", "\\tfrac", "\\sqrt", "\\pi")))) or (t and t[0] == "."):
                p, q = self.power()
            else:
                return n, d
            n, d = self.roots.times(n, p), self.roots.times(d, q)

    def signed(self) -> tuple[Sum, Sum]:
        if self.look() == "-":
            self.take()
            n, d = self.signed()
            return {m: -c for m, c in n.items()}, d
        return self.power()

    def power(self) -> tuple[Sum, Sum]:
        n, d = self.atom()
        while self.look() in ("^", "**"):
            self.take()
            if self.look() == "\\circ":
                self.take()
                continue
            if self.look() == "{" and self.tokens[self.at + 1 : self.at + 3] == ["\\circ", "}"]:
                self.at += 3
                continue
            p, q = self.signed()
            n, d = self.raised(n, d, p, q)
        return n, d

    def raised(self, n: Sum, d: Sum, p: Sum, q: Sum) -> tuple[Sum, Sum]:
        number = _constant(p, q)
        if number is not None and number.denominator in (1, 2) and abs(number.numerator) <= POWER:
            if number.denominator == 2:
                (a, b), (x, y) = self.roots.of(n), self.roots.of(d)
                n, d = self.roots.times(a, y), self.roots.times(b, x)
            k = abs(number.numerator)
            a, b = {(): Fraction(1)}, {(): Fraction(1)}
            for _ in range(k):
                a, b = self.roots.times(a, n), self.roots.times(b, d)
            if number < 0:
                a, b = b, a
                if not b:
                    raise Unread("division by zero")
            return a, b
        return self.roots.atom(f"power({text_of(n)};{text_of(d)};{text_of(p)};{text_of(q)})"), {(): Fraction(1)}

    def group(self) -> tuple[Sum, Sum]:
        t = self.take()
        if t in "({[":
            value = self.sum()
            self.take({"(": ")", "{": "}", "[": "]"}[t])
            return value
        if t[0].isdigit() and len(t) > 1:  # \frac12: one digit each
            self.tokens[self.at - 1 : self.at] = list(t)
            return self.named(t[0])
        self.at -= 1
        return self.atom()

    def named(self, t: str) -> tuple[Sum, Sum]:
        one = {(): Fraction(1)}
        if t[0].isdigit() or t[0] == ".":
            value = Fraction(t.rstrip(".") if t != "." else "0")
            return ({(): value} if value else {}), one
        if t == "i":
            return self.roots.atom("root(-1)", {(): Fraction(-1)}), one
        return self.roots.atom(t), one

    def atom(self) -> tuple[Sum, Sum]:
        t = self.take()
        one = {(): Fraction(1)}
        if re.match(r"[\d.]", t) or (t.isalpha() and len(t) == 1):
            return self.named(t)
        if t in ("(", "{", "["):
            self.at -= 1
            return self.group()
        if t in ("\\frac", "\\dfrac", "\\tfrac"):
            (a, b), (c, d) = self.group(), self.group()
            if not c:
                raise Unread("division by zero")
            return self.roots.times(a, d), self.roots.times(b, c)
        if t == "\\sqrt":
            if self.look() == "[":
                self.take()
                p, q = self.sum()
                self.take("]")
                n, d = self.group()
                return self.raised(n, d, q, p)
            n, d = self.group()
            (a, b), (x, y) = self.roots.of(n), self.roots.of(d)
            return self.roots.times(a, y), self.roots.times(b, x)
        if t[0] == "\\" and t[1:] in FUNCTIONS:
            power = None
            if self.look() == "^":
                self.take()
                power = self.group()
            n, d = self.group() if self.look() == "(" else self.power()
            value = self.roots.atom(f"{t[1:]}({text_of(n)};{text_of(d)})"), one
            return value if power is None else self.raised(*value, *power)
        if re.fullmatch(r"\\[a-zA-Z]+", t):
            return self.roots.atom(t[1:]), one
        raise Unread(f"{t} is not read")


def _constant(n: Sum, d: Sum) -> Fraction | None:
    if all(not m for m in n) and all(not m for m in d) and d:
        return n.get((), Fraction(0)) / d[()]
    return None


def _float(s: Sum) -> complex | None:
    total = 0j
    for m, c in s.items():
        x = complex(float(c))
        for a, k in m:
            under = re.fullmatch(r"root\((-?\d+)\)", a)
            v = math.pi if a == "pi" else math.e if a == "e" else complex(int(under[1])) ** 0.5 if under else None
            if v is None:
                return None
            x *= v**k
        total += x
    return total


def cleaned(text: str) -> str:
    """Without units, spaces of thousands, marks of inline math and sentence ends."""
    text = _TEXT.sub(lambda m: "" if m[1].strip().rstrip(".").split(" ")[0].lower() in UNITS or not re.fullmatch(r"[\s\w]{0,3}", m[1]) else m[1], text.strip())
    text = re.sub(r"(?<=\d)(?:,|\{,\})(?=\d{3}(?:\D|$))", "", text).replace("\\%", "").replace("%", "").replace("\\cdotp", "\\cdot")
    text = re.sub(rf"(?<=[\d}}\s])\s*(?:{'|'.join(UNITS)})(?:\^\{{?[23]\}}?)?\.?$", "", text.strip().strip("$").strip())
    return text.rstrip(".").strip()


def parts(text: str) -> list[str]:
    """A text at its commas outside of brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


def matrix(text: str) -> list[list[str]] | None:
    """The rows of a LaTeX matrix or of a list of lists."""
    m = re.fullmatch(r"\\begin\{([pbBv]?matrix)\}(.*)\\end\{\1\}", text, re.S)
    if m:
        return [[c.strip() for c in row.split("&")] for row in re.split(r"\\\\", m[2].strip().removesuffix("\\\\"))]
    if re.fullmatch(r"\[\s*\[.*\]\s*\]", text, re.S):
        rows = [r.strip() for r in parts(text.strip()[1:-1])]
        if all(r.startswith("[") and r.endswith("]") for r in rows):
            return [[c.strip() for c in parts(r[1:-1])] for r in rows]
    return None


def values_equal(a: str, b: str) -> bool:
    roots = Roots()
    (n, d), (p, q) = Reader(a, roots).whole(), Reader(b, roots).whole()
    if not plus(roots.times(n, q), roots.times(p, d), -1):
        return True
    x, y, u, v = _float(n), _float(d), _float(p), _float(q)
    if None in (x, y, u, v) or not y or not v:
        return False
    x, u = x / y, u / v
    return abs(x - u) <= 1e-4 * max(abs(x), abs(u))


def difference(text: str, roots: Roots) -> Sum:
    left, right = text.split("=")
    (n, d), (p, q) = Reader(left, roots).whole(), Reader(right, roots).whole()
    return plus(roots.times(n, q), roots.times(p, d), -1)


def symbolic_equal(a: str, b: str) -> bool:
    """Whether two answers say the same."""
    a, b = cleaned(a), cleaned(b)
    if not a or not b:
        return a == b
    try:
        x, y = matrix(a), matrix(b)
        if x is not None or y is not None:
            return x is not None and y is not None and [len(r) for r in x] == [len(r) for r in y] and all(symbolic_equal(c, d) for r, s in zip(x, y) for c, d in zip(r, s))
        a, b = a.replace("\\left", "").replace("\\right", ""), b.replace("\\left", "").replace("\\right", "")
        if a[0] in "([" and b[0] in "([" and a[-1] in ")]" and b[-1] in ")]" and (len(parts(a[1:-1])) > 1 or len(parts(b[1:-1])) > 1):
            p, q = parts(a[1:-1]), parts(b[1:-1])
            return (a[0], a[-1]) == (b[0], b[-1]) and len(p) == len(q) and all(map(symbolic_equal, p, q))
        if len(parts(a)) > 1 or len(parts(b)) > 1:
            p, q = parts(a.strip("\\{}")), parts(b.strip("\\{}"))
            return len(p) == len(q) and all(map(symbolic_equal, p, q))
        if a.count("=") == 1 and b.count("=") == 1:
            roots = Roots()
            s, t = difference(a, roots), difference(b, roots)
            if not s or not t or s.keys() != t.keys():
                return s == t
            k = next(iter(s))
            return all(s[m] * t[k] == t[m] * s[k] for m in s)
        if re.match(r"[a-zA-Z]\s*=", a) or re.match(r"[a-zA-Z]\s*=", b):  # "x = 3" against "3"
            a, b = (t.split("=", 1)[1] if re.match(r"[a-zA-Z]\s*=", t) else t for t in (a, b))
        return values_equal(a, b)
    except (Unread, RecursionError, OverflowError, ZeroDivisionError):
        return False


def same_answer(a: Column, b: Column) -> Column:
    """symbolic_equal() of two columns; null where either is."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else symbolic_equal(p, q) for p, q in zip(x, y)], dtype="object")

    return run(a, b)
