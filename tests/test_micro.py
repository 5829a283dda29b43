"""Hand-made cases: values computed by hand or by plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollumen import registry
from rollumen.functions import chat, graders, latex, text
from rollumen.operators import advantages, batch, joins, losses, metrics, partition, policy
from rollumen.operators.masked import masked_whiten
from rollumen.sources import sinks
from rollumen.streaming import queue

TOKENS = "row_id long, uid string, t int, mask int, reward double, value double, logp_old double, logp_new double, logp_rollout double, logp_ref double, sum_pi_sq double"


@pytest.fixture(scope="module")
def tokens(spark):
    r = np.random.default_rng(3)
    rows = [
        (i, f"g{i // 3}", t, int(r.random() > 0.3), *(float(x) for x in r.normal(size=2)), *(float(-x) for x in r.random(4)), float(r.random()))
        for i in range(7)
        for t in range(1 + i % 4)
    ]
    return spark.createDataFrame(rows, TOKENS)


def scored(spark, *rows):
    return spark.createDataFrame(rows, "row_id long, uid string, score double, length long")


def advantage(df):
    return {r["row_id"]: r["advantage"] for r in df.collect()}


def test_groups_of_one_and_constant_groups(spark):
    rows = scored(spark, (0, "a", 2.0, 3), (1, "b", 1.0, 1), (2, "b", 1.0, 2))
    assert advantage(advantages.grpo(rows, by_std=False)) == {0: 2.0, 1: 0.0, 2: 0.0}
    assert advantage(advantages.rloo(rows)) == {0: 2.0, 1: 0.0, 2: 0.0}
    assert advantage(advantages.rloo_vectorized(rows))[0] == 0.0
    assert advantage(advantages.opo(rows))[0] == 2.0
    got = advantage(advantages.grpo_vectorized(scored(spark, (0, "b", 1.0, 1), (1, "b", 1.0005, 1))))
    assert got[1] == pytest.approx(0.00025 / (1e-3 + 1e-6), rel=1e-6)  # the floor of the std


def test_rloo_sums_to_zero_in_a_group(spark):
    rows = scored(spark, *[(i, "a", float(i * i % 7), 1) for i in range(5)])
    assert sum(advantage(advantages.rloo(rows)).values()) == pytest.approx(0)


def test_pass_at_k_ties_and_small_groups(spark):
    rows = scored(spark, (4, "a", 1.0, 1), (2, "a", 1.0, 1), (3, "a", 0.0, 1))
    assert advantage(advantages.grpo_passk(rows, by_std=False)) == {2: 0.0, 3: 0.0, 4: 0.0}
    rows = scored(spark, (4, "a", 3.0, 1), (2, "a", 1.0, 1))
    assert advantage(advantages.grpo_passk(rows, by_std=False)) == {4: 2.0, 2: 0.0}
    with pytest.raises(Exception, match="two rows"):
        advantages.grpo_passk(scored(spark, (0, "a", 1.0, 1))).collect()


def loop_gae(rows, gamma, lam):
    out = {}
    by = {}
    for r in rows:
        by.setdefault(r["row_id"], []).append(r)
    for row, ts in by.items():
        nv = last = 0.0
        for r in sorted(ts, key=lambda r: -r["t"]):
            delta = r["reward"] + gamma * nv - r["value"]
            now = delta + gamma * lam * last
            if r["mask"]:
                nv, last = r["value"], now
            out[row, r["t"]] = last
    return out


def test_gae_against_a_loop(tokens):
    want = loop_gae(tokens.collect(), 0.9, 0.8)
    got = advantages.gae(tokens, 0.9, 0.8, whiten=False).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["advantage"] == pytest.approx(want[r["row_id"], r["t"]])
        assert r["returns"] == pytest.approx(want[r["row_id"], r["t"]] + r["value"])


def test_whitening(tokens):
    got = masked_whiten(tokens, "reward", "w").collect()
    valid = [r["reward"] for r in tokens.collect() if r["mask"]]
    mean, var = np.mean(valid), np.var(valid, ddof=1)
    for r in got:
        assert r["w"] == pytest.approx((r["reward"] - mean) / math.sqrt(var + 1e-8), abs=1e-6)
    with pytest.raises(Exception, match="two valid"):
        masked_whiten(tokens.limit(1), "reward", "w").collect()


def test_nan_outside_the_mask_is_ignored(spark):
    df = spark.createDataFrame([(0, 0, 1, 2.0), (0, 1, 0, float("nan"))], "row_id long, t int, mask int, loss double")
    for mode in losses.AGGREGATIONS[:3]:
        assert losses.agg_loss(df, mode=mode).first()["loss"] == pytest.approx(2.0)


def test_optimal_baseline_of_one_row_and_zero_tail(tokens):
    plain = advantages.optimal_token_baseline(tokens).collect()
    alone = [r for r in plain if r["uid"] == "g2"]
    assert alone and all(r["advantage"] == pytest.approx(r["returns"] * r["mask"]) for r in alone)
    tail = advantages.optimal_token_baseline(tokens, zero_tail=True).collect()
    assert len(tail) == len(plain)


def test_names_and_registries():
    assert len(advantages.names()) == 13
    with pytest.raises(ValueError):
        advantages.register("grpo")(lambda rows: rows)
    with pytest.raises(ValueError):
        losses.policy_loss("none")
    with pytest.raises(ValueError):
        registry.get_reward_manager("none")
    assert registry.load("math", "sqrt")(4) == 2


def test_kl_controller(spark):
    df = spark.sql("select array(named_struct('kl', 20d, 'n', 10), named_struct('kl', 1d, 'n', 10)) s")
    got = df.select(policy.adaptive_beta(F.col("s"), 0.2, 10.0, 100)).first()[0]
    first = 0.2 * (1 + 0.2 * 0.1)
    assert got == pytest.approx([first, first * (1 - 0.2 * 0.1)])


def test_thresholds():
    assert policy.parse_thresholds(["token_k1"], "2") == {"token_k1": (0.5, 2.0)}
    assert policy.parse_thresholds(["token_k1", "seq_mean_k3"], "0.5_2, 0.1") == {"token_k1": (0.5, 2.0), "seq_mean_k3": (None, 0.1)}
    for modes, bad in ((["token_k2"], "0.5_2"), (["token_k1"], "-1"), (["token_k1"] * 2, "1,2,3")):
        with pytest.raises(ValueError):
            policy.parse_thresholds(modes, bad)


def test_rejection_modes_meet(tokens):
    lr = policy.log_ratio(tokens)
    both = policy.rejection(lr, "token_k1,token_k1,seq_max_k2", ["0.9_1.1", "0.02"]).collect()
    for r in both:
        assert r["kept_mask"] == (r["mask"] if r["keep_token_k1"] and r["keep_seq_max_k2"] else 0)
    with pytest.raises(ValueError):
        policy.rejection(lr, "seq_max_k1", "2")


def test_clip_cov_drops_within_bounds(tokens):
    df = tokens.withColumn("advantage", F.col("reward"))
    all_kept = losses.clip_cov(df, share=1e-9, lower=1e9, upper=2e9).first()["loss"]
    assert losses.clip_cov(df, share=0.5, lower=-1e9, upper=1e9).first()["clipfrac"] > 0
    assert all_kept == pytest.approx(losses.vanilla(df, c=1e9).first()["loss"])


# graders


def value(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, want",
    [("answer: Yes", "yes"), ("**No**", "no"), ("I think it is yes.", "yes"), ("maybe", "maybe"), ("Answer: no", "no"), ("", "")],
)
def test_yes_no(spark, given, want):
    got = value(spark, text.yes_no("s"), s=given)
    assert got == (want if given != "Answer: no" else "no")


@pytest.mark.parametrize("given, want", [("(B) text", "B"), ("B. x", "B"), ("B", "B"), ("Bad", ""), (" [C] y", "C"), ("D: z", "D"), ("G", "")])
def test_mcq_option(spark, given, want):
    assert value(spark, text.mcq_option("s"), s=given) == want


@pytest.mark.parametrize(
    "given, want",
    [(r"x \boxed{\frac{1}{2}} y", r"\boxed{\frac{1}{2}}"), (r"\boxed{1} \boxed{2", None), ("none", None), (r"$\boxed 5$", r"\boxed 5"), (r"\fbox{a}", r"\fbox{a}")],
)
def test_last_boxed(spark, given, want):
    assert value(spark, text.last_boxed("s"), s=given) == want


def test_many_answer_tags_quarter_the_score(spark):
    s = "<answer>x</answer>" * 11
    assert value(spark, graders.qa_em(F.col("s"), F.array(F.lit("x")))["score"], s=s) == 0.25
    assert value(spark, graders.qa_em(F.col("s"), F.array(F.lit("x")))["score"], s=s[:18]) == 1.0


def test_mcq_flag_is_inverted_unless_strict(spark):
    s = "<answer>\nB\n</answer>"
    assert value(spark, graders.mcq(F.col("s"), F.lit("B"))["incorrect_format"], s=s) == 1
    assert value(spark, graders.mcq(F.col("s"), F.lit("B"), strict=True)["incorrect_format"], s=s) == 0


@pytest.mark.parametrize(
    "a, b, want",
    [("0.5", r"\frac{1}{2}", True), (r"\frac12", r"\frac{1}{2}", True), ("1/2", r"\dfrac{1}{2}", True), ("k=3", "3", True), (r"5\%", "5", True), ("50", "0.5", True),
     ("1,000", "1000.05", True), ("(1, 2)", "(1,2.0)", True), ("(1,2)", "(2,1)", False), ("x", "y", False), (r"\sqrt2", r"\sqrt{2}", True), ("__import__('os')", "1", False)],
)
def test_math_equal(a, b, want):
    assert latex.equal(a, b) is want


def test_code_results(spark):
    col = lambda *s: F.array(*[F.lit(x) for x in s])
    assert value(spark, graders.code_score(col(1, -4, 1), True)) == pytest.approx(1 / 3)
    assert value(spark, graders.code_score(col(1, 1))) == 1.0
    assert value(spark, graders.code_score(col(1, 0))) == 0.0


def test_unknown_source_is_an_error(spark):
    with pytest.raises(Exception, match="no grader"):
        value(spark, graders.score_by_source(F.lit("nowhere"), F.col("s"), F.lit("1")), s="x")


def test_broken_tool_calls_are_skipped(spark):
    s = 'a<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call><tool_call>{oops</tool_call>b'
    got = value(spark, chat.tool_calls(F.col("s")), s=s)
    assert got["content"] == "ab" and [(c["name"], c["arguments"]) for c in got["calls"]] == [("f", '{"x":1}')]
    s = '<|start|>assistant<|channel|>commentary to=functions.g <|constrain|>json<|message|>{"y":2}<|call|>'
    assert value(spark, chat.channel_tool_calls(F.col("s")), s=s)["calls"][0]["name"] == "g"


def test_placement(spark):
    got = [value(spark, registry.placed(F.lit(2.0), F.lit(n), 3)) for n in (0, 1, 3)]
    assert got == [[0, 0, 0], [2, 0, 0], [0, 0, 2]]


# partitions


def test_partitions_cover_and_balance():
    r = np.random.default_rng(0)
    sizes = [int(x) for x in r.integers(1, 1000, 60)]
    for k in (1, 3, 7):
        parts = partition.balanced(sizes, k)
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert sorted(i for p in parts for i in p) == list(range(60)) and max(sums) - min(sums) < 60
    assert {len(p) for p in partition.differencing(sizes, 6, equal=True)} == {10}
    assert {len(p) for p in partition.greedy(sizes, 6, equal=True)} == {10}
    with pytest.raises(ValueError):
        partition.differencing(sizes, 7, equal=True)
    with pytest.raises(ValueError):
        partition.balanced([1, 2], 3)


def test_known_differencing():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in partition.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_micro_batches_and_groups():
    lengths = [500, 400, 300, 200, 100, 50]
    parts = partition.micro_batches(lengths, 600, multiple=2)
    assert len(parts) % 2 == 0 and sorted(i for p in parts for i in p) == list(range(6))
    with pytest.raises(ValueError):
        partition.micro_batch_count(lengths, 450)
    for p in partition.grouped(list("aabbba"), [1] * 6, 2):
        assert not ({0, 1} & set(p)) or {0, 1} <= set(p)


# batches, logs, streams


def test_slices_as_python(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), F.col("id").alias("v"))
    for s in (slice(2, 8), slice(-3, None), slice(None, None, -2), slice(8, 1, -3), slice(3, 3)):
        got = [r["v"] for r in batch.sliced(df, s.start, s.stop, s.step or 1, 10).orderBy("row_id").collect()]
        assert got == list(range(10))[s]


def test_pad_then_unpad_is_the_identity(spark):
    df = spark.range(3).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("v"))
    pad = batch.padded(df, 8, 3)
    assert [r["v"] for r in pad.orderBy("row_id").collect()] == [0, 2, 4, 0, 2, 4, 0, 2]
    assert batch.differences(batch.unpadded(pad), df).count() == 0
    with pytest.raises(ValueError):
        batch.chunks(df, 2, 3)
    with pytest.raises(Exception, match="differs"):
        batch.zipped(df, df.withColumn("v", F.col("v") + 1)).collect()


def test_permutation_and_its_inverse(spark):
    index = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "pos long, row_id long")
    df = spark.range(3).select(F.col("id").alias("row_id"), F.col("id").alias("v"))
    back = batch.gathered(batch.gathered(df, index), batch.inverse(index))
    assert batch.differences(back, df).count() == 0


def test_resume_log(spark):
    log = spark.createDataFrame([("a", 1, "[API_ERROR] x"), ("a", 2, "ok"), ("a", 3, "later"), ("b", 4, "ok"), ("b", 5, " ")], "sample_uid string, seq long, model_answer string")
    got = {r["sample_uid"]: r["seq"] for r in joins.compacted(log).collect()}
    assert got == {"a": 3, "b": 4}
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_uid string")
    assert [r[0] for r in joins.remaining(items, log).collect()] == ["c"]


def test_islands_come_back(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate("aabaa")], "row_id long, k string")
    assert [r["island"] for r in joins.islands(df, "k", "row_id").orderBy("row_id").collect()] == [0, 0, 1, 2, 2]


def test_majority_ties_go_to_the_first():
    assert metrics.majority(["b", "a", "a", "b"], [1.0, 2.0, 3.0, 4.0]) == 1.0
    assert metrics.subset_sizes(6) == [2, 4, 6] and metrics.subset_sizes(1) == []


def test_bootstrap_repeats():
    x = np.array([1.0, 2.0, 3.0])
    a, b = (metrics.resampled(x, 2, {"best": np.max}, 200) for _ in range(2))
    assert a == b and 2.0 < a["best"][0] < 3.0


def test_binary_catch_all(spark):
    rows = spark.createDataFrame([("yes", True), ("maybe", False), ("no", True)], "gold string, correct boolean")
    assert metrics.binary_metrics(rows).first()["tn"] == 2 and metrics.binary_metrics(rows, strict=True).first()["tn"] == 1


def test_max_is_looked_for_before_min(spark):
    rows = spark.createDataFrame([("minmax", 1.0), ("minmax", 3.0), ("min", 1.0), ("min", 3.0)], "name string, value double")
    assert {r["name"]: r["value"] for r in metrics.reduce_by_name(rows).collect()} == {"minmax": 3.0, "min": 1.0}


def test_routing_against_a_loop(spark):
    ev = [(0.0, 5.0), (1.0, 1.0), (1.5, 9.0), (3.0, 1.0), (3.5, 1.0)]
    df = spark.createDataFrame([([{"at": a, "seconds": s} for a, s in ev],)], "s array<struct<at: double, seconds: double>>")
    got = df.select(queue.least_loaded(F.col("s"), 2)).first()[0]
    open_, want = [], []
    for at, s in ev:
        open_ = [(j, d) for j, d in open_ if d > at]
        j = min(range(2), key=lambda j: (sum(1 for x, _ in open_ if x == j), j))
        open_.append((j, at + s))
        want.append(j)
    assert got == want


def test_flat_settings_and_samples(spark):
    assert sinks.flattened({"a": {"b": 1}, "c": [2, {"d": 3}]}) == {"a/b": 1, "c/list_len": 2, "c/0": 2, "c/1/d": 3}
    rows = spark.range(50).select(F.col("id").cast("string").alias("input"))
    a, b = (sorted(r[0] for r in sinks.sample_table(x, 5).collect()) for x in (rows, rows.repartition(7)))
    assert a == b


def test_presets_and_dispatch_of_unknown_sources(spark):
    from rollumen import registry
    from rollumen.functions import feedback

    assert len(registry.PRESETS) == 17 and registry.PRESETS["bypass_pg_is"] == registry.Correction("sequence", bypass=True, loss="reinforce")
    row = spark.range(1)
    with pytest.raises(Exception, match="no feedback grader"):
        row.select(feedback.feedback_by_source(F.lit("other"), F.lit("x"), F.lit("y"), F.array(F.lit(1)), F.lit(False))).collect()


def test_forbidden_tokens_are_an_error(spark):
    from rollumen.operators import policy

    rows = spark.createDataFrame([(1, 0, 1, 5), (1, 1, 1, 7), (2, 0, 0, 7)], "row_id long, t int, mask int, token int")
    assert [tuple(r) for r in policy.forbidden_positions(rows, "token", [7]).collect()] == [(1, [1])]
    with pytest.raises(Exception, match="forbidden token in row 1 at 1"):
        policy.without_forbidden(rows, "token", [7]).collect()
    assert policy.without_forbidden(rows.filter("t = 0"), "token", [7]).count() == 2


def test_answers_with_percent_signs_and_case():
    from rollumen.functions import latex

    assert latex.normalized("50%") == "50%" and latex.normalized("50\\%") == "50"
    assert latex.equal("A", "a") and not latex.equal("A", "b")


def test_seeded_mini_batches_hold_every_row_once(spark):
    from rollumen.operators import batch as b

    got = b.mini_batches(spark.range(12).select(F.col("id").alias("row_id")), 4, 12, 2, seed=3).collect()
    assert sorted((r["epoch"], r["row_id"]) for r in got) == [(e, k) for e in range(2) for k in range(12)]
    assert sorted((r["epoch"], r["batch"], r["position"]) for r in got) == [(e, k // 4, k % 4) for e in range(2) for k in range(12)]


def test_keys_are_dealt_anew_after_a_join_by_them(spark):
    """The join can become a broadcast as it runs, and then its tasks hold parts of a key (at 9 million orders they did)."""
    from rollumen.plans.scan import keyed_lists, keyed_scan

    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "-1")
        rows = spark.range(4800).select((F.col("id") % 100).alias("batch"), F.col("id").alias("k"))
        whole = rows.join(rows.groupBy("batch").count().filter("count = 48").select("batch"), "batch", "left_semi")
        lists = keyed_lists(whole, ["batch"], ["k"], ["k"], lambda x: [len(x)] * len(x), "n int")
        scan = keyed_scan(whole, ["batch"], ["k"], ["k"], lambda: 0, lambda s, k: (s + 1, s + 1), "n int")
        for df in (lists, scan):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.index("Exchange") < plan.index("Join")
        assert [tuple(r) for r in lists.groupBy("n").count().collect()] == [(48, 4800)]
        assert scan.filter("n = 48").count() == 100
    finally:
        spark.conf.set(name, before)


def test_chunks_with_a_rest(spark, tmp_path):
    import duckdb

    from rollumen.queries import basics

    for n in (23, 0):
        spark.range(n).select(F.col("id").alias("vec_id")).write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        got = sorted(map(tuple, basics.QUERIES["batch_chunks"](spark, f"{tmp_path}/{n}").collect()))
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from '{tmp_path}/{n}/embeddings.parquet/*.parquet'")
        assert got == sorted(con.execute(basics.ORACLE_SQL["batch_chunks"]).fetchall())
    for n, uneven in ((23, "error"), (3, "rest")):
        with pytest.raises(ValueError, match=f"{n} rows"):
            batch.chunks(spark.range(n).withColumnRenamed("id", "row_id"), 5, n, uneven)


def test_prompts_resampled_together_equal_a_loop(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for uid in range(40):
        n = int(rng.integers(1, 9)) if uid else 40
        x = [float(v) for v in rng.integers(0, 5, n)]
        votes = [str(v) for v in rng.integers(0, 3, n)]
        if uid % 7 == 3:
            votes[0] = None
        rows += [(f"s{uid % 2}", uid, k, x[k], votes[k]) for k in range(n)]
        own = {f"mean@{n}": np.mean(x)} | ({f"std@{n}": np.std(x)} if n > 1 else {})
        for k in metrics.subset_sizes(n):
            got = metrics.resampled(np.array(x), k, {"best": np.max, "worst": np.min})
            if None not in votes:
                got |= metrics.resampled(np.arange(n), k, {"maj": lambda d, v=votes, x=x: metrics.majority([v[i] for i in d], [x[i] for i in d])})
            for name, (mean, std) in got.items():
                own |= {f"{name}@{k}/mean": mean, f"{name}@{k}/std": std}
        for metric, value in own.items():
            want.setdefault((f"s{uid % 2}", metric), []).append(value)
    df = spark.createDataFrame(rows, "data_source string, uid long, pos int, value double, pred string")
    got = {(r["data_source"], r["metric"]): r["value"] for r in metrics.validation_metrics(df).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], np.mean(v), abs_tol=1e-12) for k, v in want.items())
    # draws in pieces, as for prompts of very many responses
    x, v = np.array([[r[3] for r in rows[:40]]]), [[r[4] for r in rows[:40]]]
    whole = [(m, y.tolist()) for m, y, _ in metrics.prompt_metrics(x, v)]
    monkeypatch.setattr(metrics, "CELLS", 4000)
    assert [(m, y.tolist()) for m, y, _ in metrics.prompt_metrics(x, v)] == whole


def test_counted_batches_take_work_in_proportion_to_the_items(spark):
    import time

    import pandas as pd

    class Stream:
        schema = spark.range(1).selectExpr("'a' AS key", "id").schema

        def groupBy(self, key):
            return self

        def applyInPandasWithState(self, step, *rest):
            return step

    class State:
        exists, held = False, None

        def update(self, value):
            self.held = value

    step, state = queue.counted_batches(Stream(), "key", "id", 5), State()
    start = time.perf_counter()
    out = next(step(("a",), iter([pd.DataFrame({"id": range(1_000_003)})]), state))
    assert time.perf_counter() - start < 20  # copying what is left after each batch takes minutes
    assert len(out) == 200_000 and out["batch"].tolist() == list(range(200_000)) and state.held == (200_000, "1000000,1000001,1000002")


def test_a_long_box_takes_work_in_proportion_to_its_length(spark):
    import time

    body = "{a}€😀" * 20_000
    df = spark.createDataFrame([(f"so \\boxed{{{body}}} and so on",), ("\\boxed{{1}",), ("\\fbox{é😀}.",), (None,), ("plain",)], "s string")
    start = time.perf_counter()
    got = [r[0] for r in df.select(text.unboxed(text.last_boxed("s"))).collect()]
    assert time.perf_counter() - start < 15  # the text was cut anew for each of its characters
    assert got == [body, None, None, None, None]
    assert [r[0] for r in df.select(text.last_boxed("s")).collect()][1:] == [None, "\\fbox{é😀}", None, None]
    few = df.filter("length(s) < 100")  # with a function in Python that reads the box
    assert [r[0] for r in few.select(graders.feedback_math(F.col("s"), F.lit("1"), F.lit(False))["score"]).collect()] == [0.0] * 3
    for given, want in (("\\boxed a{b}", "a{b}"), ("\\boxed ", ""), ("\\boxed{}", ""), ("\\boxed{a}b}", "a}b"), ("\\boxed{a\n}", "a\n"), ("\\boxed{a", None), ("x\\boxed{a}", None), ("\\boxed", None)):
        assert value(spark, text.unboxed("s"), s=given) == want
