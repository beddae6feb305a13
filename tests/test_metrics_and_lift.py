import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from armlight.operators import lift as L
from armlight.operators import metrics as M
from armlight.operators import training as T


@pytest.mark.parametrize("block", [100, 137, 1000])
def test_moving_average_is_101_rows_across_blocks(spark, block):
    values = np.random.default_rng(2).normal(size=250)
    rows = [("p", i + 1, float(v)) for i, v in enumerate(values)] + [("q", 1, 3.0)]
    log = spark.createDataFrame(rows, "policy string, iteration bigint, reward double")
    got = M.moving_average(log, ["reward"], "iteration", block=block).collect()
    assert len(got) == 251
    want = [values[max(0, i - 100) : i + 1].mean() for i in range(250)]
    one = {r.iteration: r.avg_reward for r in got if r.policy == "p"}
    assert [one[i + 1] for i in range(250)] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("rows,bins", [(23, 10), (5, 10), (400, 20), (20, 20)])
def test_lift_bins_equal_ntile(spark, rows, bins):
    rng = np.random.default_rng(rows)
    # a third of the rows share one probability
    prob = np.where(rng.random(rows) < 0.34, 0.5, rng.random(rows).round(2))
    target = (rng.random(rows) < 0.4).astype(int)
    target[0] = 1
    data = [(i, float(p), int(t)) for i, (p, t) in enumerate(zip(prob, target))]
    df = spark.createDataFrame(data, "id bigint, prob double, target int")
    got = L.lift_bins(df, bins, "id").orderBy("bin").toPandas()
    pdf = pd.DataFrame(data, columns=["id", "prob", "target"]).sort_values(["prob", "id"], ascending=[False, True])
    sizes = [rows // bins + (1 if b < rows % bins else 0) for b in range(bins)]
    pdf["bin"] = np.repeat(np.arange(1, bins + 1), sizes)
    want = pdf.groupby("bin").agg(n=("id", "size"), positives=("target", "sum")).reset_index()
    assert got[["bin", "n", "positives"]].to_numpy().tolist() == want.to_numpy().tolist()
    assert got["lift"].to_numpy() == pytest.approx(((want.positives / want.n) / target.mean()).to_numpy())
    total = L.cumulative_lift(L.lift_bins(df, bins, "id")).orderBy("bin").toPandas()
    assert total["gain"].iloc[-1] == pytest.approx(1.0) and total["cum_lift"].iloc[-1] == pytest.approx(1.0)


def test_lift_without_positives_is_null(spark):
    df = spark.range(12).select("id", F.lit(0.3).alias("prob"), F.lit(0).alias("target"))
    assert {r.lift for r in L.lift_bins(df, 4, "id").collect()} == {None}


def test_shuffled_batches_are_permutations(spark):
    got = T.shuffled_batches(spark.range(300), "id", epochs=2, size=126).toPandas()
    for _, part in got.groupby("epoch"):
        assert sorted(part["id"]) == list(range(300))
        assert sorted(part["batch"].value_counts()) == [48, 126, 126]
    first, second = (set(got[(got.epoch == e) & (got.batch == 0)]["id"]) for e in (0, 1))
    assert first != second


def test_holdout_share_is_stable(spark):
    rows = spark.range(20000).withColumn("h", T.holdout_flag("id"))
    share = rows.where("h").count() / 20000
    assert 0.09 < share < 0.11
    again = rows.repartition(3).where("h").count() / 20000
    assert share == again


def test_first_adam_step_on_numbers_and_columns(spark):
    number = T.first_adam_step(0.5, 2.0)
    column = spark.range(1).select(T.first_adam_step(F.lit(0.5), F.lit(2.0))).first()[0]
    assert number == column == pytest.approx(0.4999, abs=1e-9)


def test_compare_policies(spark):
    a = spark.createDataFrame([(1.0,), (3.0,)], "reward double")
    b = spark.createDataFrame([(5.0,)], "reward double")
    got = M.compare_policies({"a": a, "b": b}, ["reward"]).first()
    assert (got.a_total, got.a_mean, got.b_total, got.b_mean) == (4.0, 2.0, 5.0, 5.0)
