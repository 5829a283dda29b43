"""Loss masks of conversations, token by token: a tokenizer's offsets against the spans of the rendered text that are learnt."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: From a text to (start, end) of its tokens, in code points and in order.
Offsets = Callable[[str], list[tuple[int, int]]]
_WORDS = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Runs of ASCII letters and digits, and every other character but white space."""
    return [m.span() for m in _WORDS.finditer(text)]


def file_offsets(path: str) -> Offsets:
    """Offsets of a tokenizer's file; it is opened once in each task."""
    held = []

    def offsets(text: str) -> list[tuple[int, int]]:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
        return held[0].encode(text, add_special_tokens=False).offsets

    return offsets


def rendered_spans(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """A conversation as text, and the spans that are learnt: what assistants say, with the mark that ends it. Null roles and contents are empty."""
    parts, spans, at = [], [], 0
    for m in messages:
        head, body = f"<|im_start|>{m['role'] or ''}\n", f"{m['content'] or ''}<|im_end|>\n"
        if m["role"] == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body)
        at += len(head) + len(body)
    return "".join(parts), spans


def aligned(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[int]:
    """1 for tokens that begin in a span. A token over a span's edge belongs to where it begins; tokens of no characters are 0."""
    starts = [a for a, _ in spans]
    out = []
    for a, b in offsets:
        k = bisect.bisect_right(starts, a) - 1
        out.append(int(b > a and k >= 0 and a < spans[k][1]))
    return out


def token_masks(conversations: DataFrame, key: str, messages: str, offsets: Offsets = word_offsets, max_length: int | None = None, truncation: str = "error") -> DataFrame:
    """(key, n_tokens, mask): mask is for the tokens that stay of at most max_length; truncation says which go: `left`, `right`, or none, which is
    an error where there are more. messages: array<struct<role, content>>, null for none. A conversation is a row and stays in one task."""
    if truncation not in ("error", "left", "right"):
        raise ValueError(f"unknown truncation: {truncation}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, masks = [], []
            for row in b.column(1):
                text, spans = rendered_spans(row.as_py() or [])
                mask = aligned(offsets(text), spans)
                counts.append(len(mask))
                if max_length is not None and len(mask) > max_length:
                    if truncation == "error":
                        raise ValueError(f"{len(mask)} tokens are more than {max_length}")
                    mask = mask[len(mask) - max_length :] if truncation == "left" else mask[:max_length]
                masks.append(mask)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(masks, pa.list_(pa.int32()))], [key, "n_tokens", "mask"])

    return conversations.select(key, messages).mapInArrow(run, f"{key} {conversations.schema[key].dataType.simpleString()}, n_tokens long, mask array<int>")
