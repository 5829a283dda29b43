"""The Merkle manifest against a plain tree in Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from rollumen.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path int, `a.b` string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([sha("".join(row[i : i + 3])) for i in range(0, len(row), 3)])
    return levels


def siblings(levels, at):
    out = []
    for row in levels[:-1]:
        out.append((row[at - at % 3 : at], row[at + 1 : at - at % 3 + 3]))
        at //= 3
    return out


def brute(rows):
    def order(r):
        return r[0] is not None, r[0] or 0, leaf(r, r[4])

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[1] == s), key=order) for s in sources}
    levels = {s: climb([leaf(r, r[4]) for r in t]) for s, t in trees.items()}
    top = climb([levels[s][-1][0] for s in sources])
    root, out = top[-1][0], []
    for k, s in enumerate(sources):
        for i, r in enumerate(trees[s]):
            path = siblings(levels[s], i) + siblings(top, k)
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf(r, r[4].replace("\n", "") if hit else r[4])
            for left, right in path:
                folded = sha("".join(left) + folded + "".join(right))
            proof = sha("".join(x for left, right in path for x in left + right))
            out.append((r[0], levels[s][0][i], levels[s][-1][0], root, proof, folded, folded == root))
    return out


def rows_of(n, sources):
    texts = [None, "", "a\nb", "\n", "plain", "grüße\n\n€", "x" * 300_000 + "\n"]
    return [(k, f"s{k % sources}" if k % 3 else "hot", [None, "en"][k % 2], None if k % 5 == 0 else k, texts[k % (7 if k < 70 else 6)], "l", k, "z") for k in range(n)]


CASES = {
    "one row": [(7, "s", "en", 3, "a\nb", "l", 1, "z")],
    "one source": rows_of(1000, 1)[:0] + [(k, "s", "en", k, "a\nb" * k, "l", 1, "z") for k in range(800)],
    "many sources": rows_of(900, 290),
    "full last blocks": [(k, "s" if k < 486 else "t", "en", k, "a\nb", "l", 1, "z") for k in range(486 + 729)],
    "full last block of sources": [(k, f"s{k}", "en", k, "a\nb", "l", 1, "z") for k in range(486)],
    "nulls and repeats": rows_of(40, 4)
    + [(None, None, None, None, None, "l", 1, "z"), (None, "", "", 0, "", "l", 1, "z"), (5, None, None, None, "\n", "l", 1, "z")]
    + [(6, "hot", "en", 6, "a\nb", "l", 1, "z")] * 30
    + [(6, "hot", "en", 6, "b\n", "l", 1, "z")] * 2,
}


@pytest.mark.parametrize("case", CASES)
def test_manifest_equals_a_plain_tree(spark, case):
    rows = CASES[case]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in merkle.tampered_manifest(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.tampered_manifest(docs).count() == 0
    assert merkle.manifest(docs).count() == 0


def test_a_single_changed_row_is_found_by_its_path(spark):
    docs = spark.createDataFrame(rows_of(300, 3), SCHEMA)
    held = merkle.manifest(docs).cache()
    from pyspark.sql import functions as F

    changed = docs.withColumn("lang", F.when(F.col("doc_id") == 77, "de").otherwise(F.col("lang")))
    assert [r.doc_id for r in merkle.verified(changed, held).filter("not verified").collect()] == [77]
    assert merkle.verified(docs, held).filter("verified").count() == 300


def test_query_equals_duckdb(spark):
    import duckdb
    from conftest import SMALL

    from rollumen.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    ours = sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, SMALL).collect()))
    assert ours == sorted(con.execute(ORACLE_SQL["op13_merkle_manifest"]).fetchall())
