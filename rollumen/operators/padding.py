"""Padded sequences without their padding, and back: jagged rows lie one behind the other, and a row's values find their places again by its mask."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollumen.functions import arrays
from rollumen.operators.masked import logsumexp
from rollumen.plans.order import running_sum


def unpadded(df: DataFrame, order: str, mask: str, *columns: str) -> DataFrame:
    """df with the given array columns cut to where mask is above 0, their length, and start: where a row begins when all rows lie one behind the other in the
    order of `order` (start + length is where it ends)."""
    cut = df.withColumns({c: arrays.unpadded(F.col(c), F.col(mask)) for c in columns}).withColumn("length", F.size(F.filter(mask, lambda x: x > 0)).cast("long"))
    return running_sum(cut, [order], "length", "_end").withColumn("start", F.col("_end") - F.col("length")).drop("_end")


def repadded(df: DataFrame, values: str, mask: str) -> DataFrame:
    """df with each row's values, one for each place where mask is above 0, put back in those places of an array as long as mask, with zeros elsewhere. Another number of values is an error; null arrays count as empty."""
    at = df.columns.index(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given, marks = b.column(at), b.column(b.schema.get_field_index(mask))
            n, m = pc.fill_null(pc.list_value_length(given), 0).to_numpy(), pc.fill_null(pc.list_value_length(marks), 0).to_numpy()
            on = pc.fill_null(marks.flatten(), 0).to_numpy(zero_copy_only=False) > 0
            ends = np.concatenate([[0], np.cumsum(m)])
            wanted = np.diff(np.concatenate([[0], np.cumsum(on)])[ends])
            if (wanted != n).any():
                raise ValueError("a row has another number of values than places")
            flat = given.flatten()
            out = np.zeros(len(on), flat.to_numpy(zero_copy_only=False).dtype)
            out[on] = flat.to_numpy(zero_copy_only=False)
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, flat.type))
            yield pa.RecordBatch.from_arrays([column if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def response_part(padded: Column, width: int) -> Column:
    """What a model says of the last `width` tokens: each is told at the token before."""
    return F.slice(padded, F.size(padded) - width, F.lit(width))


def response_logprobs(logits: Column, ids: Column, width: int) -> Column:
    """Log-probabilities of the last `width` of ids, from logits (an array of arrays) at the tokens before them."""
    own = F.slice(ids, F.size(ids) - width + 1, F.lit(width))
    return F.zip_with(response_part(logits, width), own, lambda row, i: F.get(row, i.cast("int")) - logsumexp(row))


def next_logprobs(logits: Column, ids: Column) -> Column:
    """Log-probabilities of every token but the first, from the logits at the token before it."""
    return F.zip_with(F.slice(logits, F.lit(1), F.size(ids) - 1), F.slice(ids, F.lit(2), F.size(ids) - 1), lambda row, i: F.get(row, i.cast("int")) - logsumexp(row))
