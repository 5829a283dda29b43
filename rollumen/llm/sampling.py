"""The bounded sample of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollumen.llm.common import crc32_text


def fit_sample(docs: DataFrame, labels: DataFrame, target: str, bound: int, held_out: int | None = None) -> DataFrame:
    """(text, y) of at most `bound` labelled documents, the same ones every time: those with the lowest hash of their
    id. Rows whose crc32(doc_id) mod 5 is `held_out` are left out. A document with several labels has their largest;
    null labels and ids are left out. At most `bound` rows of two numbers are broadcast."""
    own = labels.select("doc_id", F.col(target).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    if held_out is not None:
        own = own.filter(crc32_text() % 5 != held_out)
    chosen = own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", "y")
