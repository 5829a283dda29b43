"""The divergence audit against plain loops, with tiles of all shapes."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from rollumen.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, `x.y` string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        df = Counter(t for d in here for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        v = len(kept)
        sources = sorted({d[1] for d in here})
        n = {s: Counter(t for d in here if d[1] == s for t in d[2] if df[t] >= least) for s in sources}
        every = sum(n.values(), Counter())

        def share(c):
            total = sum(c.values()) + 5 * v
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p, q = {s: share(c) for s, c in n.items()}, share(every)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if n[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked[:most])]
    return out


def texts(seed, n, sources, words):
    rng = random.Random(seed)
    vocab = [w for k in range(words) for w in (f"W{chr(97 + k % 26)}{chr(97 + k // 26)}", f"é{chr(97 + k % 26)}Ü{k}")]
    rows = []
    for k in range(n):
        mine = rng.choice(sources)
        text = " ".join(rng.choices(vocab, k=rng.randrange(40)) + ["7" if k % 2 else "_"])
        rows.append((k, text, rng.choice(["en", "fr"]), mine, "t", 1, "z"))
    return rows


ODD = [(None, None, None, None, "t", 1, "z"), (1, "", "en", "lonely", "t", 1, "z"), (1, "x" * 100_000 + " Wa", "en", "", "t", 1, "z"), (2, "only here", "xx", "s", "t", 1, "z"), (2, "only here", "xx", "s2", "t", 1, "z")]


@pytest.mark.parametrize("block,chunk,part,sources,least", [(64, 2048, 16, 3, 5), (2, 8, 2, 9, 5), (1, 4, 1, 5, 30), (3, 5, 3, 1, 5), (64, 16, 1, 7, 10_000)])
def test_audit_equals_plain_loops(spark, monkeypatch, block, chunk, part, sources, least):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("SLICE", part)):
        monkeypatch.setattr(divergence, name, value)
    rows = texts(sources, 400, [None, *(f"s{k}" for k in range(sources))], 20) + ODD
    rows += rows[:30]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(docs, least, 7).collect())
    assert got == sorted(brute(rows, least, 7))


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_terms_in_pieces(monkeypatch):
    text = "Ab cdé, " * 50 + "é" * 100 + " z"
    whole = [t for x in divergence.term_lists(text.encode()) for t in x]
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [t for x in divergence.term_lists(text.encode()) for t in x] == whole == [t.encode() for t in TERM.findall(text.translate(LOWER))]


def test_counters_are_given_out_when_full(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["a"] * 60, "source": ["b", "c"] * 30, "text": [f"{chr(97 + k % 20) * 3} x" for k in range(60)]})
    sums = []
    for entries in (300_000, 3):
        monkeypatch.setattr(divergence, "ENTRIES", entries)
        got: Counter = Counter()
        for b in divergence.counted(iter([batch])):
            for r in b.to_pylist():
                got[r["lang"], r["source"], r["term"]] += r["n"] * 1000 + r["docs"]
        sums.append(got)
    assert sums[0] == sums[1]


def test_share_is_exact():
    import numpy as np

    counts, total = np.array([0, 1, 7, 10**15 - 30, 10**15]), 10**15 + 5
    assert divergence.share(counts, total).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in counts]


def test_query_equals_duckdb(spark):
    import duckdb
    from conftest import SMALL

    from rollumen.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    ours = sorted(map(tuple, QUERIES["op11_source_divergence"](spark, SMALL).collect()))
    assert ours == sorted(con.execute(ORACLE_SQL["op11_source_divergence"]).fetchall())
