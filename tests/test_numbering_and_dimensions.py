import math

import pytest
from pyspark.sql import functions as F

from armlight.operators.dimensions import attach_dimension, distinct_dimension, right_join_fill, with_surrogate_key
from armlight.operators.numbering import in_batches, number_rows
from armlight.session import fits_broadcast, sized
from armlight.sources.files import stage


def test_number_rows_is_dense_and_ordered(spark):
    # one value holds almost all rows, so the second sort column has to split it
    rows = spark.range(5000).select(F.expr("if(id % 10 = 0, id, 7)").alias("v"), "id")
    got = number_rows(rows, [F.desc("v"), F.asc("id")], "rn", total="n").collect()
    want = sorted(((r.v, r.id) for r in got), key=lambda t: (-t[0], t[1]))
    assert [(r.v, r.id) for r in sorted(got, key=lambda r: r.rn)] == want
    assert sorted(r.rn for r in got) == list(range(1, 5001))
    assert {r.n for r in got} == {5000}


def test_number_rows_of_nothing(spark):
    assert number_rows(spark.range(0), ["id"], "rn").count() == 0


def test_distinct_joins_null_nan_and_signed_zero(spark):
    nan = float("nan")
    rows = [(1, None, 1.0), (2, None, 1.0), (3, nan, 1.0), (4, nan, 1.0), (5, 0.0, 1.0), (6, -0.0, 1.0)]
    facts = spark.createDataFrame(rows, "event_id bigint, a double, b double")
    dim = with_surrogate_key(distinct_dimension(facts, ["a", "b"], "event_id"), "k")
    assert dim.count() == 3
    joined = attach_dimension(facts, dim, ["a", "b"], "event_id", null_safe=True)
    got = {r.event_id: r.k for r in joined.collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2}


def test_one_id_with_two_feature_vectors_gives_two_rows(spark):
    facts = spark.createDataFrame([(1, 9, 0.5), (2, 9, 0.7), (3, 9, 0.5)], "event_id bigint, user_id bigint, f double")
    dim = with_surrogate_key(distinct_dimension(facts, ["user_id", "f"], "event_id"), "k")
    assert sorted((r.user_id, r.f, r.k) for r in dim.collect()) == [(9, 0.5, 0), (9, 0.7, 1)]


@pytest.mark.parametrize("null_safe", [False, True])
def test_hot_keys_are_spread_and_no_row_is_lost(spark, no_broadcast, null_safe):
    facts = spark.range(3000).select("id", F.expr("if(id % 3 = 0, 0, id % 100)").alias("k"))
    dim = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = attach_dimension(facts, dim, "k", "id", null_safe=null_safe, hot_rows=50)
    rows = joined.collect()
    assert len(rows) == 3000 and all(r.v == 2 * r.k for r in rows)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_small_dimension_is_broadcast(spark):
    dim = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    facts = spark.range(100).select("id", F.expr("id % 10").alias("k"))
    plan = attach_dimension(facts, dim, "k", "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_right_join_keeps_every_base_row_and_fills_zero(spark):
    side = spark.createDataFrame([(1, 1, 5.0), (7, 7, 9.0)], "a int, b int, s double")
    base = spark.createDataFrame([(1, 1, 2.0), (2, 2, None)], "a int, b int, t double")
    got = right_join_fill(side, base, ["a", "b"])
    assert got.columns == ["a", "b", "s", "t"]
    assert sorted(map(tuple, got.collect())) == [(1, 1, 5.0, 2.0), (2, 2, 0.0, 0.0)]


def test_batches_of_positions(spark):
    got = spark.range(1, 301).select(F.col("id").alias("seq")).select(in_batches("seq", 128).alias("b")).groupBy("b").count()
    assert {r.b: r["count"] for r in got.collect()} == {0: 128, 1: 128, 2: 44}


def test_surrogate_keys_follow_first_seen(spark, skewed_facts):
    dim = with_surrogate_key(distinct_dimension(skewed_facts, ["user_id"], "event_id"), "k")
    got = [r.user_id for r in dim.orderBy("k").collect()]
    pdf = skewed_facts.toPandas().sort_values("event_id")
    assert got == list(pdf["user_id"].drop_duplicates())
    assert not math.isnan(got[0])


def small_file_of_many_rows(spark):
    return stage(spark.range(100_000).select(F.col("id").alias("k"), F.lit(1.0).alias("v"), F.lit(2.0).alias("w")), "constant")


def test_dimension_is_not_broadcast_by_the_size_of_its_file(spark):
    """A file far below the broadcast limit whose rows are not."""
    dim = small_file_of_many_rows(spark)
    facts = spark.range(300_000).select("id", F.expr("id % 100000").alias("k"))
    joined = attach_dimension(facts, dim, "k", "id")
    assert joined.agg(F.count(F.lit(1)), F.sum("v")).first() == (300_000, 300_000.0)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert fits_broadcast(dim.limit(1000)) and not fits_broadcast(dim)
    assert not fits_broadcast(spark.range(300).select(F.expr("array_repeat(1D, 2000)").alias("x")))


def test_join_of_choices_is_sized_by_rows(spark):
    dim = small_file_of_many_rows(spark)
    plan = sized(dim).join(spark.range(10).toDF("k"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_hot_keys_may_be_counted_in_other_rows(spark, no_broadcast):
    events = spark.range(3000).select("id", F.expr("if(id % 3 = 0, 0, id % 100)").alias("k"))
    dim = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = attach_dimension(events.where("id % 2 = 0"), dim, "k", "id", hot_rows=50, counted=events)
    rows = joined.collect()
    assert sorted(r.id for r in rows) == list(range(0, 3000, 2)) and all(r.v == 2 * r.k for r in rows)
