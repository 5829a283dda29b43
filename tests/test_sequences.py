"""Agent loops, resampling, masks, packed prefixes, bounded calls, symbolic answers and global orders: small cases by hand."""

from __future__ import annotations

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollumen.functions import token_masks as tm
from rollumen.functions.symbolic import symbolic_equal
from rollumen.operators import agents, prefixes, resampling
from rollumen.operators.inflight import bounded_map
from rollumen.plans.order import carried, numbered, running_sum

TURNS = "turns array<struct<role:string,tokens:int,calls:int,stop:boolean>>"


@pytest.mark.parametrize(
    "turns,options,states,mask,number",
    [
        ([], {}, [], [], 1),
        ([("assistant", 2, 0, None)], {}, [("generating", "terminated")], [1, 1], 2),
        ([("assistant", 2, 1, None), ("tool", 1, None, None), ("assistant", 1, None, None)], {}, [("generating", "tools"), ("tools", "generating"), ("generating", "terminated")], [1, 1, 0, 1], 4),
        ([("assistant", 3, 1, None), ("tool", 2, 0, None), ("assistant", 1, 0, None)], {"response_length": 5}, [("generating", "tools"), ("tools", "terminated"), ("terminated", "terminated")], [1, 1, 1], 2),
        ([("assistant", 9, 1, None)], {"response_length": 5}, [("generating", "terminated")], [1] * 5, 2),
        ([("assistant", 1, 0, None), ("user", 1, 0, None), ("assistant", 1, 0, None)], {"interaction": True, "assistant_turns": 2}, [("generating", "interacting"), ("interacting", "generating"), ("generating", "terminated")], [1, 0, 1], 4),
        ([("assistant", 1, 0, None), ("user", 1, 0, True), ("assistant", 1, 0, None)], {"interaction": True}, [("generating", "interacting"), ("interacting", "terminated"), ("terminated", "terminated")], [1, 0], 3),
        ([("assistant", 1, 1, None), ("user", 1, 0, None)], {}, [("generating", "tools"), ("tools", "terminated")], [1], 2),
        ([("assistant", 1, 1, None), ("tool", 1, 0, None), ("assistant", 1, 1, None)], {"user_turns": 1}, [("generating", "tools"), ("tools", "generating"), ("generating", "terminated")], [1, 0, 1], 4),
        ([(None, None, None, None)], {}, [("generating", "terminated")], [], 1),
    ],
)
def test_agent_turns(spark, turns, options, states, mask, number):
    loop = agents.agent_turns(F.col("turns"), **{"response_length": 100, **options})
    row = spark.createDataFrame([(turns,)], TURNS).select(loop.alias("x")).select("x", agents.response_mask(F.col("x")).alias("mask"), agents.num_turns(F.col("x")).alias("n")).first()
    assert [(t["state"], t["next"]) for t in row["x"]] == states
    assert row["mask"] == mask and row["n"] == number


def test_global_orders(spark):
    rows = [(k, None if k % 5 else k, k % 3, None if k % 4 == 0 else float(k)) for k in range(1, 60)]
    df = spark.createDataFrame(rows, "k long, v long, x long, d double").repartition(7)
    assert {r.k: r.n for r in numbered(df, ["k"], "n").collect()} == {k: k - 1 for k in range(1, 60)}
    assert [c for c in numbered(df, ["k"], "v").columns] == ["k", "v", "x", "d"]
    total, want = 0, {}
    for k, _, x, _ in rows:
        total += x
        want[k] = total
    assert {r.k: r.s for r in running_sum(df, ["k"], "x", "s").collect()} == want
    assert running_sum(df, ["k"], "d", "s").agg(F.max("s")).first()[0] == sum(d for *_, d in rows if d)
    assert {r.k: r.w for r in carried(df, ["k"], "v", "w").collect()} == {k: k - k % 5 or None for k in range(1, 60)}
    for f in (lambda e: numbered(e, ["k"], "n"), lambda e: running_sum(e, ["k"], "x", "s"), lambda e: carried(e, ["k"], "v", "w")):
        assert f(df.limit(0)).count() == 0


def test_resampling_in_proportion(spark):
    df = spark.createDataFrame([(k, w) for k, w in enumerate([0, 1, 3, None, 0, 6])], "k long, w long")
    got = resampling.resampled(df, "k", "w", 3, 6000).collect()
    n = Counter(r.k for r in got)
    assert set(n) == {1, 2, 5} and sorted(r.draw for r in got) == list(range(6000))
    assert abs(n[1] - 600) < 100 and abs(n[2] - 1800) < 150 and abs(n[5] - 3600) < 150
    assert resampling.resampled(df.filter("k = 0"), "k", "w", 3).count() == 0
    assert resampling.resampled(df, "k", "w", 3).count() == 6


def test_token_masks(spark, tmp_path):
    chats = [
        (1, [("user", "a b"), ("assistant", "c d."), ("user", "e"), ("assistant", None)]),
        (2, None),
        (3, []),
        (4, [(None, "x")]),
    ]
    df = spark.createDataFrame(chats, "id long, m array<struct<role:string,content:string>>")
    got = {r.id: r for r in tm.token_masks(df, "id", "m").collect()}
    assert [got[k].n_tokens for k in (2, 3)] == [0, 0] and sum(got[4]["mask"]) == 0
    end = len(tm.word_offsets("<|im_end|>\n"))
    assert sum(got[1]["mask"]) == (3 + end) + end
    text, spans = tm.rendered_spans([{"role": r, "content": c} for r, c in chats[0][1]])
    assert [text[a:b] for a, b in spans] == ["c d.<|im_end|>\n", "<|im_end|>\n"]
    want = [int(any(s <= a < e for s, e in spans)) for a, _ in tm.word_offsets(text)]
    assert got[1]["mask"] == want
    for side, cut in (("left", want[-4:]), ("right", want[:4])):
        assert tm.token_masks(df.filter("id = 1"), "id", "m", max_length=4, truncation=side).first()["mask"] == cut
    with pytest.raises(Exception, match="more than 4"):
        tm.token_masks(df, "id", "m", max_length=4).collect()
    assert tm.aligned([(0, 0), (0, 3), (2, 5), (5, 6)], [(2, 5)]) == [0, 0, 1, 0]


def test_token_masks_by_a_tokenizer_file(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, [("user", "hello there"), ("assistant", "good morning to you")])], "id long, m array<struct<role:string,content:string>>")
    row = tm.token_masks(df, "id", "m", tm.file_offsets(public_tokenizers.path("byte_bpe_50k.json"))).first()
    assert 4 <= sum(row["mask"]) < row["n_tokens"] == len(row["mask"])


def test_packed_prefixes(spark):
    rows = [("g", 1, [7, 8], [1]), ("g", 2, [7, 8], []), ("g", 3, [7, 8], [4, 5, 6]), ("g", 4, [9], [1]), (None, 5, None, [2]), ("h", 6, [], None)]
    df = spark.createDataFrame(rows, "g string, id long, p array<long>, r array<long>")
    lots = prefixes.packed_groups(df, "g", "id", "p", "r").cache()
    one = lots.filter("g = 'g' and prefix = 2").select("*", prefixes.visible(F.col("prefix"), F.col("spans")).alias("see")).first()
    assert one.tokens == [7, 8, 1, 4, 5, 6] and one.positions == [0, 1, 2, 2, 3, 4]
    assert [tuple(x) for x in one.see] == [(1, 0, 0), (2, 0, 0), (2, 2, 3), (2, 3, 4), (2, 3, 5), (2, 3, 6)]
    back = [(r.g, r["row"], r.prompt, r.response) for r in prefixes.unpacked(lots, "g").collect()]
    assert sorted(back, key=lambda r: r[1]) == [(g, k, p or [], r or []) for g, k, p, r in rows]
    many = prefixes.packed_groups(df, "g", "id", "p", "r", most=1)
    assert sorted(r["row"] for r in prefixes.unpacked(many, "g").collect()) == [1, 2, 3, 4, 5, 6]


def test_calls_are_bounded_and_in_order(spark):
    def call(row):
        time.sleep(0.02 if row["id"] % 3 else 0.05)
        if row["id"] == 7:
            raise ValueError("never")
        return row["id"] * 2

    df = spark.range(0, 40, 1, 2)
    got = bounded_map(df, call, "twice long", in_flight=5, attempts=2, wait=0.001).collect()
    assert [r.id for r in got] == list(range(40))
    assert all(r.twice == r.id * 2 and r.attempts == 1 and r.error is None for r in got if r.id != 7)
    assert (got[7].twice, got[7].attempts, got[7].error) == (None, 2, "ValueError: never")
    assert 1 < max(r.in_flight for r in got) <= 5
    with pytest.raises(Exception, match="never"):
        bounded_map(df, call, "twice long", attempts=1, raise_errors=True).collect()
    assert bounded_map(df.limit(0), call, "twice long").count() == 0
    with pytest.raises(ValueError):
        bounded_map(df, call, "twice long", in_flight=0)


SAME = [
    ("(x+1)^2", "x^2+2x+1"), ("\\frac{1}{\\sqrt{2}}", "\\frac{\\sqrt2}{2}"), ("\\sqrt{8}", "2\\sqrt{2}"), ("\\frac12", "0.5"), ("x=3", "3"), ("2x=6", "x=3"), ("(1,2]", "(1, 2]"),
    ("\\begin{pmatrix}1&2\\\\3&x\\end{pmatrix}", "[[1,2],[3,x]]"), ("5\\text{ cm}", "5"), ("1,000", "1000"), ("3.1416", "\\pi"), ("\\sin(x)^2", "\\sin(x)\\cdot\\sin(x)"), ("\\sin^2 x", "\\sin(x)\\sin(x)"),
    ("\\frac{x^2-1}{x-1}", "x+1"), ("2^{10}", "1024"), ("(a+b)(a-b)", "a^2-b^2"), ("x^{1/2}", "\\sqrt{x}"), ("i^2", "-1"), ("30^\\circ", "30"), ("\\sqrt[3]{8}", "8^{1/3}"), ("50\\%", "50"), ("x^2", "x*x"),
    ("-\\frac{1}{2}", "\\frac{-1}{2}"), ("12 cm", "12"), ("\\sqrt{x^2+1}\\sqrt{x^2+1}", "x^2+1"), ("\\frac34", "0.75"), ("\\frac{12}{34}", "6/17"), ("", ""), ("x^{-2}", "\\frac{1}{x^2}"), ("\\sqrt{-4}", "2i"), ("1,2,3", "1, 2, 3"),
]
OTHER = [
    ("x+1", "x+2"), ("(1,2)", "(1,2]"), ("(1,2)", "[1,2]"), ("\\sqrt2", "2"), ("x=3", "x=4"), ("\\begin{pmatrix}1&2\\end{pmatrix}", "\\begin{pmatrix}1\\\\2\\end{pmatrix}"), ("", "0"), ("\\foo(", "1"), ("1/0", "1"),
    ("x" * 3000, "x"), ("(x+y+z+w+v+u)^{40}", "1"), ("__import__('os')", "1"), ("(" * 3000, "("), ("9" * 400 + "^{40}", "1"), ("1,2", "2,1"), ("\\sqrt{10000000000000}", "x"),
]


@pytest.mark.parametrize("pair", SAME)
def test_the_same_answer(pair):
    assert symbolic_equal(*pair) and symbolic_equal(*pair[::-1])


@pytest.mark.parametrize("pair", OTHER)
def test_another_answer(pair):
    start = time.time()
    assert not symbolic_equal(*pair) and not symbolic_equal(*pair[::-1])
    assert time.time() - start < 10


def test_scans_by_key(spark):
    from rollumen.plans.scan import keyed_lists, keyed_scan

    rows = [(k % 3 or None, k, float(k)) for k in range(300)]
    df = spark.createDataFrame(rows, "g long, k long, x double").repartition(5)
    got = keyed_scan(df, ["g"], [F.desc("k")], ["x"], lambda: 0.0, lambda s, x: (s + x, s, s > 100), "before double, big boolean").collect()
    for r in got:
        assert r.before == sum(x for g, k, x in rows if g == r.g and k > r.k) and r.big == (r.before > 100)
    small = keyed_lists(df, ["g"], ["k"], ["x"], lambda xs: [x - xs[0] for x in xs], "d double", lot=7)
    assert {(r.g, r.k): r.d for r in small.collect()} == {(g, k): x - min(y for h, _, y in rows if h == g) for g, k, x in rows}
    for empty in (keyed_scan(df.limit(0), ["g"], ["k"], ["x"], lambda: 0, lambda s, x: (s, s), "a int"), keyed_lists(df.limit(0), ["g"], ["k"], ["x"], lambda xs: xs, "d double")):
        assert empty.count() == 0


def test_limiter_and_routing_by_hand(spark):
    from rollumen.streaming import queue

    events = spark.createDataFrame([("a", 0.0, 4.0, 0), ("a", 1.0, 4.0, 1), ("a", 2.0, 1.0, 2), ("b", 5.0, 9.0, 3)], "u string, at double, cost double, i long")
    got = {r.i: r.let_through for r in queue.let_through(events, "u", "at", "cost", 1.0, 5.0, ["i"]).collect()}
    assert got == {0: 0.0, 1: 3.0, 2: 4.0, 3: 9.0}
    asks = spark.createDataFrame([("a", 0.0, 9.0, 0), ("a", 1.0, 1.0, 1), ("a", 1.5, 9.0, 2), ("a", 2.0, 1.0, 3), ("a", 2.0, 1.0, 4)], "u string, at double, s double, i long")
    assert {r.i: r.server for r in queue.routed(asks, "u", "at", "s", 2, ["i"]).collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 1}


@pytest.mark.parametrize("method,k", [("differencing", 4), ("greedy", 4), ("differencing_equal", 2), ("greedy_equal", 2), ("grouped", 3)])
def test_batches_that_do_not_divide_are_errors(spark, method, k):
    from rollumen.operators.partition import partitioned

    df = spark.createDataFrame([(1, i, 5, "s" if i else "t") for i in range(3)], "b int, i int, n int, s string")
    with pytest.raises(Exception, match="parts"):
        partitioned(df, "b", "i", "n", method, k, key="s").collect()
    assert partitioned(df, "b", "i", "n", method, k, key="s", small="fit").count() == 3
    with pytest.raises(ValueError):
        partitioned(df, "b", "i", "n", method, k, small="drop")


def test_templates(spark):
    from rollumen.functions import chat

    assert chat.template("chatml").prompts() == ("", "<|im_start|>assistant\n")
    assert chat.template("chatml_assistant").prompts() == ("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n", "<|im_start|>assistant\n")
    assert chat.template("header").prompts()[0] == "<|begin_of_text|>"
    own = chat.Template("[{role}] ", "\n", default="be kind")
    df = spark.createDataFrame([(1, [("user", "a"), ("assistant", None)]), (2, [("system", "s"), (None, "b")]), (3, [])], "id long, m array<struct<role:string,content:string>>")
    got = {r.id: (r.w, r.c) for r in df.select("id", chat.applied(F.col("m"), own, generate=True).alias("w"), chat.applied(F.col("m"), own, continued=True).alias("c")).collect()}
    assert got == {1: ("[system] be kind\n[user] a\n[assistant] \n[assistant] ", "[user] a\n[assistant] \n"), 2: ("[system] s\n[] b\n[assistant] ", "[system] s\n[] b\n"), 3: ("[system] be kind\n[assistant] ", "")}
    for m in ([{"role": "user", "content": "a"}], [{"role": "system", "content": None}], []):
        row = spark.createDataFrame([([(x["role"], x["content"]) for x in m],)], "m array<struct<role:string,content:string>>")
        for name in chat.TEMPLATES:
            assert row.select(chat.applied(F.col("m"), name, generate=True)).first()[0] == chat.template(name).text(m, True)
    with pytest.raises(ValueError):
        chat.template("none")
