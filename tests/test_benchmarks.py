"""Benchmark records, losses in bypass mode, steps, padding and boxes: small cases by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rollumen.functions import arrays
from rollumen.functions import benchmarks as bm
from rollumen.operators import losses, padding, partition, policy


def test_records_by_hand(spark):
    raw = spark.createDataFrame([(None, " q? ", None, " ", None, 7), ((b"x",), "q\n" + bm.OPTION_SUFFIX.strip(), " b", "k", "c", 8)], "image struct<bytes:binary>, text string, label string, question_id string, category string, row long")
    good = bm.vstar(raw.filter("row = 8")).first()
    assert (good.images, good["query"], good.response, good.question_id, good.category) == (["VStar_images/k.jpg"], "q\n" + bm.OPTION_SUFFIX.strip(), "B", "k", "c")
    with pytest.raises(Exception, match="no image for 7"):
        bm.vstar(raw).collect()
    hr = spark.createDataFrame([(123456, "q", "A", None, "", None, None, None, None)], "index long, question string, answer string, A string, B string, C string, D string, category string, image string")
    assert bm.hrbench(hr).first()[:4] == (["HRBench_images/123456.jpg"], b"", "q", "A")
    mmvp = spark.createDataFrame([("3", "q", "o", "a")], "Index string, Question string, Options string, `Correct Answer` string")
    with pytest.raises(Exception, match="no image at MMVP Images/3.jpg"):
        bm.mmvp(mmvp, images=spark.createDataFrame([("MMVP Images/4.jpg",)], "path string")).collect()
    assert bm.file_of("mme-realworld-cn") == "MME_RealWorld_CN.json"
    for f in (lambda: bm.file_of("other"), lambda: bm.records(raw, "other")):
        with pytest.raises(ValueError):
            f()


TOKENS = "row_id long, t int, mask int, logp_old double, logp_new double, advantage double, value double"


def test_bypass_and_steps(spark):
    rows = [(1, 0, 1, -1.0, -0.9, 1.0, 0.2), (1, 1, 1, -1.0, -4.0, 1.0, 0.3), (2, 0, 1, -1.0, -1.1, -1.0, 0.4), (2, 1, 0, -1.0, -9.0, 5.0, 9.0)]
    df = spark.createDataFrame(rows, TOKENS)
    plain = losses.policy_loss("bypass_mode")(df).first().loss
    assert plain == pytest.approx(losses.vanilla(df).first().loss)
    kept = losses.bypass_mode(df, modes="token_k1", spec="0.5_2.0").first().loss
    assert kept == pytest.approx(losses.vanilla(df.filter("not (row_id = 1 and t = 1)")).first().loss)
    weighted = losses.bypass_mode(df, "reinforce", "token", threshold=1.05).first().loss
    assert weighted == pytest.approx((0.9 * min(math.exp(0.1), 1.05) + 4.0 * math.exp(-3.0) - 1.1 * math.exp(-0.1)) / 3)
    with pytest.raises(ValueError):
        losses.bypass_mode(df, "other")
    step = losses.actor_step(df, entropy="value", entropy_coef=0.5, ref="logp_old", kl_mode="k1", kl_coef=2.0, ranks=3).first()
    assert step.entropy_loss == pytest.approx(0.9) and step.kl_loss == pytest.approx(3 * (0.1 - 3.0 - 0.1) / 3)
    assert step.loss == pytest.approx(step.pg_loss - 0.5 * step.entropy_loss + 2.0 * step.kl_loss) and step.pg_loss == pytest.approx(3 * losses.vanilla(df).first().loss)
    assert losses.actor_step(df).select("entropy_loss", "kl_loss").first() == (None, None)
    assert [c for c in policy.rejection_statistics(df.withColumn("log_ratio", F.lit(0.1)), "token_k2", "0.1").columns if "low" in c] == ["fraction_low", "seq_fraction_low"]


def test_padding_by_hand(spark):
    df = spark.createDataFrame([(2, [5, 6, 7], [0, 1, 1]), (1, [1, 2], [1, 0]), (3, [9], [0]), (4, [], [])], "k long, ids array<long>, m array<int>")
    got = padding.unpadded(df, "k", "m", "ids")
    assert sorted((r.k, r.ids, r.length, r.start) for r in got.collect()) == [(1, [1], 1, 0), (2, [6, 7], 2, 1), (3, [], 0, 3), (4, [], 0, 3)]
    assert {r.k: r.ids for r in padding.repadded(got, "ids", "m").collect()} == {1: [1, 0], 2: [0, 6, 7], 3: [0], 4: []}
    with pytest.raises(Exception, match="another number"):
        padding.repadded(df, "ids", "m").collect()
    assert padding.repadded(df.limit(0), "ids", "m").count() == 0


@pytest.mark.parametrize(
    "box,image,want",
    [
        ((10, 10, 60, 60), (100, 100), (10, 10, 60, 60)), ((-5, 10, 300, 60), (100, 100), (0, 10, 100, 60)), ((10, 10, 20, 20), (100, 100), (1, 1, 29, 29)), ((0, 0, 10, 10), (100, 100), (0, 0, 28, 28)),
        ((95, 95, 100, 100), (100, 100), (72, 72, 100, 100)), ((10, 10, 30, 20), (40, 100), None), ((5, 5, 5, 9), (100, 100), None), ((0, 0, 99, 0.5), (100, 100), None), ((0, 0, 9, 9), (20, 20), None),
    ],
)
def test_zoom_boxes(spark, box, image, want):
    cell = lambda x: F.lit(float(x))
    got = spark.range(1).select(arrays.zoom_box(*map(cell, box), *map(F.lit, image)).alias("b")).first()["b"]
    assert (None if got is None else tuple(got)) == want


def test_balanced_places():
    lengths = [9, 1, 8, 2, 7, 3, 6, 4]
    for options in ({}, {"minibatch": 4}):
        places = partition.balanced_places(lengths, 2, **options)
        assert sorted(places) == list(range(8))
        work = [sum(partition.cost(n) for n, p in zip(lengths, places) if p // 4 == r) for r in (0, 1)]
        assert abs(work[0] - work[1]) < partition.cost(3)
    keyed = partition.balanced_places([5, 5, 1, 1, 3, 3, 4, 4], 2, keys=list("aabbccdd"))
    assert sorted(keyed) == list(range(8)) and all({p // 4 for p, k in zip(keyed, "aabbccdd") if k == key} in ({0}, {1}) for key in "abcd")
    for bad in ({"ranks": 3}, {"ranks": 2, "minibatch": 3}, {"ranks": 3, "keys": list("aabbccdd")}):
        with pytest.raises(ValueError):
            partition.balanced_places(lengths, **bad)
