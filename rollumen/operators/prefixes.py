"""Responses to one prompt packed behind a single copy of it, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed_groups(rows: DataFrame, group: str, row: str, prompt: str, response: str, most: int = 64) -> DataFrame:
    """(group, lot, tokens, positions, prefix, spans): a group's rows behind their prompt, about `most` of them in a lot, in the order of row. spans: array of
    struct<row, start, length>; positions begin anew behind the prompt for each response. Rows of a group have one prompt; where they don't, each
    prompt has lots of its own. A null array counts as empty. A row's lot is by its hash, so what is collected
    stays small, whatever a group holds."""
    own = rows.select(group, row, *[F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(a) for c, a in ((prompt, "_p"), (response, "_r"))])
    sizes = own.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_lots"))
    dealt = own.join(sizes, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q"))).withColumn("lot", F.pmod(F.xxhash64(F.col(row)), F.col("_lots")))
    lots = dealt.groupBy(group, "_p", "lot").agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("row"), F.col("_r").alias("r")))).alias("x"))
    first = F.size("_p")

    def span(acc: Column, x: Column) -> Column:
        here = F.struct(x["row"].alias("row"), acc["end"].alias("start"), F.size(x["r"]).alias("length"))
        return F.struct((acc["end"] + F.size(x["r"])).alias("end"), F.concat(acc["spans"], F.array(here)).alias("spans"))

    kind = rows.schema[row].dataType.simpleString()
    start = F.struct(first.alias("end"), F.expr(f"cast(array() as array<struct<row:{kind},start:int,length:int>>)").alias("spans"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    behind = lambda x: F.transform(upto(F.size(x["r"])), lambda i: first + i)
    return lots.select(
        group, "lot", F.concat("_p", F.flatten(F.transform("x", lambda x: x["r"]))).alias("tokens"), F.concat(upto(first), F.flatten(F.transform("x", behind))).alias("positions"),
        first.alias("prefix"), F.aggregate("x", start, span, lambda a: a["spans"]).alias("spans"),
    )


def visible(prefix: Column, spans: Column) -> Column:
    """For each token of a packed row: struct<upto (of the prefix), begin, end> with the ends left out. It sees the prefix before `upto`, and what lies from
    `begin` to `end`: its own response as far as itself; never another response."""
    none = F.array().cast("array<int>")
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    see = lambda upto, begin, end: F.struct(upto.cast("int").alias("upto"), begin.cast("int").alias("begin"), end.cast("int").alias("end"))
    own = F.transform(steps(prefix), lambda i: see(i + 1, F.lit(0), F.lit(0)))
    others = F.transform(spans, lambda s: F.transform(steps(s["length"]), lambda i: see(prefix, s["start"], s["start"] + i + 1)))
    return F.concat(own, F.flatten(others))


def unpacked(lots: DataFrame, group: str) -> DataFrame:
    """(group, row, prompt, response, positions) of packed_groups()."""
    one = lots.select(group, "tokens", "positions", "prefix", F.explode("spans").alias("s"))
    cut = lambda c: F.slice(c, F.col("s.start") + 1, F.col("s.length"))
    return one.select(group, F.col("s.row").alias("row"), F.slice("tokens", F.lit(1), F.col("prefix")).alias("prompt"), cut("tokens").alias("response"), cut("positions").alias("positions"))
