import pytest
from pyspark.sql import functions as F

from armlight.plans import replay as R
from armlight.plans.rounds import linear_round
from armlight.operators import metrics as M
from armlight.session import fresh_path
from armlight.sources import files as S
from armlight.sources import interactions as I
from armlight.sources.stores import load_model, save_model
from armlight.streaming import replay_stream as RS


def test_csv_round_trip_keeps_values(spark, skewed_facts):
    path = fresh_path(spark, "csv")
    S.write_csv(skewed_facts, path)
    back = S.read_csv(spark, path, skewed_facts.schema)
    assert back.exceptAll(skewed_facts).count() == 0 and back.count() == 600


def test_files_below_a_prefix(spark):
    path = fresh_path(spark, "prefix")
    spark.range(100).repartition(3).write.parquet(path + "/a")
    spark.range(50).repartition(2).write.parquet(path + "/b")
    names = [r.path for r in S.list_files(spark, path).where(F.col("path").endswith(".parquet")).collect()]
    assert len(names) == 5
    assert sum(r.n_rows for r in S.rows_by_file(spark.read.parquet(path + "/a")).collect()) == 100


def test_samples(spark):
    rows = spark.range(50000)
    picked = S.sample_by_hash(rows, "id", 0.1, 5)
    assert 4600 < picked.count() < 5400
    assert picked.exceptAll(S.sample_by_hash(rows.repartition(7), "id", 0.1, 5)).count() == 0
    assert 300 < S.sample_rows(rows, 0.01, 5).count() < 700


def test_profile(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (2, "y")], "a int, b string")
    got = {r.column_name: r for r in S.profile(rows).collect()}
    assert (got["a"].n_rows, got["a"].n_null, got["a"].n_distinct, got["a"].min_value, got["a"].max_value) == (3, 0, 2, 1.0, 2.0)
    assert (got["b"].n_rows, got["b"].n_null, got["b"].n_distinct, got["b"].min_value) == (3, 1, 2, None)


def test_metric_log_prunes_policies(spark):
    path = fresh_path(spark, "log")
    S.write_metric_log(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "policy string, loss double"), path)
    assert [r.loss for r in S.read_metric_log(spark, path, ["b"]).collect()] == [2.0]
    assert S.read_metric_log(spark, path).count() == 2


def test_model_versions(spark):
    path = fresh_path(spark, "model")
    model = I.policy_model()
    save_model(spark, model, path, 0)
    save_model(spark, model.with_values(model.weights, 9.0), path, 1)
    save_model(spark, model.with_values(model.weights, 9.0), path, 1)
    assert load_model(spark, path, model).intercept == 9.0
    assert load_model(spark, path, model, 0) == model


@pytest.mark.parametrize("epsilon", [0.0, 0.3])
def test_stream_metrics_equal_batch_metrics(spark, replay, epsilon):
    policy = R.Policy("logit", epsilon)
    events = RS.read_events(spark, RS.write_event_files(replay, chunks=4), files_per_trigger=3)
    got = {r.batch: r for r in RS.stream_batch_metrics(events, replay, policy).collect()}
    want = {r.batch: r for r in R.policy_metrics(replay, policy).collect()}
    assert got.keys() == want.keys()
    for b in want:
        assert (got[b].reward, got[b].loss, got[b].regret) == pytest.approx((want[b].reward, want[b].loss, want[b].regret))


def test_stream_updates_equal_rounds(spark, replay):
    model = I.policy_model()
    events = RS.read_events(spark, RS.write_event_files(replay, chunks=3), files_per_trigger=2)
    path = RS.stream_policy_update(events, replay, model)
    for k in range(3):
        rows = replay.replay.where((F.col("seq") > k * 200) & (F.col("seq") <= (k + 1) * 200))
        pulled = rows.select("user_key", F.lit(k).alias("batch"), F.lit(None).cast("bigint").alias("explored"))
        model = linear_round(M.exposures(pulled), replay, model).model
        stored = load_model(spark, path, model, k + 1)
        assert stored.intercept == pytest.approx(model.intercept, abs=1e-15)
        assert list(stored.weights.values()) == pytest.approx(list(model.weights.values()), abs=1e-15)


@pytest.mark.parametrize("epsilon", [0.0, 0.3])
def test_stream_metrics_go_on_after_a_stop(spark, replay, epsilon):
    """Two runs over one location: the batch that is open at the stop is closed by the second run."""
    policy, location, path = R.Policy("logit", epsilon), fresh_path(spark, "resume"), fresh_path(spark, "events")
    part = [F.col("seq") % 3 == 0, F.col("seq") % 3 != 0]
    events = replay.replay.select("seq", "user_key")
    events.where(part[0]).write.mode("append").parquet(path)
    first = RS.stream_batch_metrics(RS.read_events(spark, path, 2), replay, policy, location=location)
    assert first.count() == 0
    events.where(part[1]).repartition(3).write.mode("append").parquet(path)
    RS.stream_batch_metrics(RS.read_events(spark, path, 2), replay, policy, location=location)
    again = RS.stream_batch_metrics(RS.read_events(spark, path, 2), replay, policy, location=location)
    got = {r.batch: tuple(r) for r in again.collect()}
    want = {r.batch: r for r in R.policy_metrics(replay, policy).collect()}
    assert got.keys() == want.keys() and again.count() == len(want)
    for b, r in want.items():
        assert got[b] == pytest.approx((b, r.n_events, r.n_unscored, r.reward, r.loss, r.regret))


def test_streams_without_events(spark, replay):
    path, location = fresh_path(spark, "events"), fresh_path(spark, "resume")
    replay.replay.where("false").select("seq", "user_key").write.parquet(path)
    assert RS.stream_batch_metrics(RS.read_events(spark, path, 2), replay, R.Policy("logit")).count() == 0
    model = I.policy_model()
    versions = RS.stream_policy_update(RS.read_events(spark, path, 2), replay, model, location=location)
    assert load_model(spark, versions, model) == model


def test_stream_updates_go_on_after_a_stop(spark, replay):
    model = I.policy_model()
    path, location = fresh_path(spark, "events"), fresh_path(spark, "resume")
    events = replay.replay.select("seq", "user_key").coalesce(1)
    want = model
    for k in range(3):
        events.where((F.col("seq") > k * 200) & (F.col("seq") <= (k + 1) * 200)).write.mode("append").parquet(path)
        versions = RS.stream_policy_update(RS.read_events(spark, path, 1), replay, model, location=location)
        rows = replay.replay.where((F.col("seq") > k * 200) & (F.col("seq") <= (k + 1) * 200))
        pulled = rows.select("user_key", F.lit(k).alias("batch"), F.lit(None).cast("bigint").alias("explored"))
        want = linear_round(M.exposures(pulled), replay, want).model
    stored = load_model(spark, versions, model)
    assert list(stored.weights.values()) == pytest.approx(list(want.weights.values()), abs=1e-15)
