"""Padding, truncation and masks of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad(a: Column, length: int, value=0, left: bool = False) -> Column:
    """To the length at least; longer arrays stay."""
    more = F.array_repeat(F.lit(value).cast("bigint") if isinstance(value, int) else F.lit(value), F.greatest(F.lit(length) - F.size(a), F.lit(0)).cast("int"))
    return F.concat(more, a) if left else F.concat(a, more)


def truncate(a: Column, length: int, how: str = "right") -> Column:
    """right keeps the head, left the tail, middle the first half (rounded down) and the rest from the tail."""
    n, half = F.size(a), length // 2
    if how == "right":
        short = F.slice(a, 1, length)
    elif how == "left":
        short = F.slice(a, -length, length)
    elif how == "middle":
        short = F.concat(F.slice(a, 1, half), F.slice(a, -(length - half), length - half))
    elif how == "error":
        return F.when(n <= length, a).otherwise(F.filter(a, lambda x: F.raise_error(F.lit(f"longer than {length}")).cast("boolean")))
    else:
        raise ValueError(f"no truncation {how}")
    return F.when(n <= length, a).otherwise(short)


def unpadded(ids: Column, mask: Column) -> Column:
    """Elements whose mask is on."""
    return F.filter(ids, lambda x, i: F.get(mask, i) > 0)


def response_mask(attention: Column, response_length: int) -> Column:
    return F.slice(attention, -response_length, response_length)


def sft_mask(prompt_length: Column, length: Column) -> Column:
    """1 for tokens whose successor is to be learnt: 0 up to prompt_length - 2, and at the last valid place."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when((prompt_length > 1) & (i < prompt_length - 1), 0).when(i == length - 1, 0).otherwise(1))


def repeated(value: Column, n: Column) -> Column:
    """One value for each position of a jagged row."""
    return F.array_repeat(value, n.cast("int"))


def differing(a: Column, b: Column, mask: Column) -> Column:
    """How many valid positions differ."""
    return F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), mask, lambda d, k: (d & (k > 0)).cast("int")), F.lit(0), lambda s, x: s + x)


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b)


def rounded_up(a: Column, b: Column) -> Column:
    return F.ceil(a / b) * b


def workload(length: Column) -> Column:
    """Cost of a sequence: linear and attention parts."""
    return 24576 * length + length * length


def clamped_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """A box within the image; null if nothing is left of it or its sides differ over a hundredfold."""
    a, b = F.greatest(x1, F.lit(0.0)), F.greatest(y1, F.lit(0.0))
    c, d = F.least(x2, width.cast("double")), F.least(y2, height.cast("double"))
    ok = (c > a) & (d > b) & (F.greatest(c - a, d - b) <= 100 * F.least(c - a, d - b))
    return F.when(ok, F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))


def zoom_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, least: int = 28) -> Column:
    """A box to cut from an image: clamped_box(), and where a side is below `least`, grown about its middle until its shorter side is (no further than the
    image, whose edges it is shifted behind), in whole pixels. Null if nothing is left, the sides differ over a hundredfold, or a side stays too short."""
    from rollumen.operators.masked import once

    w, h = width.cast("double"), height.cast("double")

    def grown(b: Column) -> Column:
        wide, tall = b["x2"] - b["x1"], b["y2"] - b["y1"]
        ratio = least / F.least(wide, tall)

        def placed(s: Column) -> Column:
            left = F.least(F.greatest((b["x1"] + b["x2"]) / 2 - s["w"] / 2, F.lit(0.0)), w - s["w"])
            top = F.least(F.greatest((b["y1"] + b["y2"]) / 2 - s["h"] / 2, F.lit(0.0)), h - s["h"])
            whole = lambda f, x: f(x).cast("double")
            return F.struct(whole(F.floor, left).alias("x1"), whole(F.floor, top).alias("y1"), whole(F.ceil, left + s["w"]).alias("x2"), whole(F.ceil, top + s["h"]).alias("y2"))

        def within_width(s: Column) -> Column:
            return F.struct(F.least(s["w"], w).alias("w"), F.when(s["w"] > w, s["h"] * (w / s["w"])).otherwise(s["h"]).alias("h"))

        def within_height(s: Column) -> Column:
            return F.struct(F.when(s["h"] > h, s["w"] * (h / s["h"])).otherwise(s["w"]).alias("w"), F.least(s["h"], h).alias("h"))

        sides = once(once(F.struct((wide * ratio).alias("w"), (tall * ratio).alias("h")), within_width), within_height)
        return F.when(F.least(wide, tall) < least, once(sides, placed)).otherwise(b)

    def checked(b: Column) -> Column:
        wide, tall = b["x2"] - b["x1"], b["y2"] - b["y1"]
        spans = (F.floor(b["x2"]) - F.floor(b["x1"]) >= least) & (F.floor(b["y2"]) - F.floor(b["y1"]) >= least)
        return F.when((wide > 0) & (tall > 0) & (F.greatest(wide, tall) <= 100 * F.least(wide, tall)) & spans, b)

    return once(once(clamped_box(x1, y1, x2, y2, width, height), grown), checked)
