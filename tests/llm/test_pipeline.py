"""The pipeline's stages on the smallest documents: columns, decisions, and the packed result against a plain pass."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rollumen.llm import quality
from rollumen.llm.common import documents, labels
from rollumen.llm.queries import tokenizer_file


def test_stages_keep_columns_and_decide(spark):
    docs = documents(spark, SMALL)
    seen = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SMALL)
        assert out.columns == docs.columns, name
        seen.append(spark.createDataFrame(out.collect(), out.schema))
    counts = [d.count() for d in seen]
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[2] < counts[1] and counts[4] == counts[3]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = docs.join(labels.filter("quality = 1"), "doc_id")
    assert seen[1].join(clean.select("doc_id"), "doc_id").count() >= 0.98 * clean.count()
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in seen[2].collect()]
    assert len(texts) == len(set(texts))
    assert not any(re.search(r"@mail\d", r["text"]) and r["text"] == s["text"] for r, s in zip(seen[4].orderBy("doc_id").collect(), seen[3].orderBy("doc_id").collect()))


def graded_plainly(model, text):
    """Probability of the top grade of a text, word by word."""
    words, eta = text.split(), 0.0
    for a, b in zip([None, *words], words):
        eta += sum(model.w[d] for d in quality.word_features(b)) + (model.w[quality.REPEATED] if a == b else 0.0)
    return 1 / (1 + math.exp(-(eta / max(len(words), 1) - model.theta[-1])))


def alike_plainly(rows):
    """Of (doc_id, text), those with the smallest id of each component under 0.8 of their five-word shingles."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            up[top(j)] = top(i)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[top(k)] = min(first.get(top(k), i), i)
    return set(first.values())


def test_run_against_plain_passes(spark):
    """The stages' decisions and the packed pieces by plain Python: grades, texts, pairs of shingle sets, the tokenizer library."""
    from tokenizers import Tokenizer

    spark.conf.set("spark.rollumen.pseudonyms.key", "test")
    docs = documents(spark, SMALL)
    model = quality.fit(docs, labels(spark, SMALL))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    rows = [(i, t) for i, t in rows if graded_plainly(model, t) >= 0.5]
    first = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        first[key] = min(first.get(key, i), i)
    rows = [(i, t) for i, t in rows if i in set(first.values())]
    kept = alike_plainly(rows)
    texts = {r["doc_id"]: r["text"] for r in pipeline.private_stage(spark, docs.filter(docs["doc_id"].isin(list(kept))), SMALL).collect()}
    own = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    ids = {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    got = pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in got} == kept
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]]) for r in got)
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    filled = Counter()
    for r in got:
        filled[r["sequence_id"]] += r["length"]
    assert all(n == 4096 for k, n in filled.items() if k < len(filled) - 1)


def test_stages_keep_columns_of_any_names(spark):
    docs = documents(spark, SMALL).limit(40)
    names = ("row", "at", "private", "kept", "_text", "n_private", "my col", "a.b", "component_id", "id")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert all(list(r)[-len(names) :] == list(range(len(names))) for r in out.collect()), name


def test_stages_on_odd_rows(spark):
    docs = documents(spark, SMALL)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)], docs.schema)
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd, SMALL).count() >= 1
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_the_order_of_shingles_changes_no_group(spark, monkeypatch):
    """frequent_shingles() counts some documents only; any counts give the same groups."""
    from conftest import SMALL

    from rollumen.llm import simhash
    from rollumen.llm.common import documents

    docs = documents(spark, SMALL)
    groups = lambda: sorted(map(tuple, simhash.near_duplicates(docs.select("doc_id", "text")).collect()))
    want, counted = groups(), simhash.frequent_shingles
    assert len({r[1] for r in want}) < len(want)

    def reversed_counts(docs, size):
        key, n = counted(docs, size)
        return key, -n

    for other in (reversed_counts, lambda docs, size: (np.zeros(0, np.uint64), np.zeros(0, np.int64))):
        monkeypatch.setattr(simhash, "frequent_shingles", other)
        assert groups() == want
