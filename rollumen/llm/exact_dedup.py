"""Exact dedup by a tree of merges of digest runs, in DataFrame operations only.

Every input partition holds one run of digests. In each round FAN_IN runs of neighbouring partitions meet, hashed by
run and digest so that a round never has fewer tasks than the session deals, and each digest keeps its smallest
identifier and its count. A text is named by SHA-256, length and XXH64 together, so a match of the digest alone is
not taken for equality. A group that holds a third of all rows is one row of each run before the first exchange.

Nulls: a null text is the empty text; a null doc_id never beats another one. One row of each group is kept: of
repeated rows (same id, same text) and of null ids only one of them, the first of the input as it was read. Texts of any length
are digested whole. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollumen.llm.common import SPACES, cut, named, unused

#: Runs that meet in a round; groups of over one in CROWD of all rows (CROWD of them at most) are looked up as a broadcast.
FAN_IN, CROWD = 4, 1000

NAME = ["digest", "size", "check"]


def normalised(col):
    return F.regexp_replace(F.coalesce(col, F.lit("")), SPACES, " ")


def merge_runs(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """Rounds of multiway merges until one run is left: (digest, size, check, keep_id, group_size)."""
    merged = runs.groupBy("run", *NAME).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        merged = (
            merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", *NAME)
            .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        )
    return merged.drop("run")


def digests_of(rows: DataFrame, id_col: str, text_col: str, row_col: str) -> DataFrame:
    """doc_id (a struct that orders rows: null ids last, then by id and row), digest, size, check, run."""
    norm = normalised(named(text_col).cast("string"))
    order = F.struct(named(id_col).isNull().alias("none"), named(id_col).alias("id"), named(row_col).alias("row"))
    own = rows.select(order.alias("doc_id"), norm.alias("norm"))
    return cut(own.select("doc_id", F.sha2("norm", 256).alias("digest"), F.length("norm").alias("size"), F.xxhash64("norm").alias("check"), F.spark_partition_id().alias("run")))


def merged_runs(digests: DataFrame, fan_in: int) -> tuple[DataFrame, int]:
    """One run of all digests, and the number of rows."""
    last = digests.agg(F.max("run").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    return merge_runs(digests, 0 if last["n"] is None else last["n"] + 1, fan_in), last["rows"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    row = unused(docs, "row")
    digests = digests_of(docs.withColumn(row, F.monotonically_increasing_id()), id_col, text_col, row)
    merged, total = merged_runs(digests, fan_in)
    merged = cut(merged)
    hot = F.broadcast(merged.filter(F.col("group_size") > max(1, total // CROWD)))
    cold = merged.filter(F.col("group_size") <= max(1, total // CROWD))
    of = digests.join(hot, NAME).unionByName(digests.join(hot.select(NAME), NAME, "left_anti").join(cold, NAME))
    return of.select(
        F.col("doc_id.id").alias("doc_id"),
        F.col("keep_id.id").alias("keep_id"),
        "group_size",
        (F.col("doc_id.row") == F.col("keep_id.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of docs that stay, one for each group of equal texts. Columns of any names are kept as they are."""
    row = unused(docs, "row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    merged, _ = merged_runs(digests_of(rows, id_col, text_col, row), fan_in)
    return rows.join(merged.select(F.col("keep_id.row").alias(row)), row, "left_semi").select([named(c) for c in docs.columns])


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM n
"""
