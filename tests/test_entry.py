"""A part of the catalog against its SQL on the smallest given data; check.py runs all of it."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from armlight.plans import catalog
from check import rows_of

FOLDER = Path("/root/testdata/sf0.001")
QUICK = (
    "scan_parquet", "sample_scan", "table_profile", "surrogate_key", "join_multikey_nullsafe", "right_join_fill_zero",
    "context_cross_join", "optimal_reward", "policy_metrics", "policy_metrics_logit_egreedy", "policy_gradient_step",
    "posterior_precision", "lift_bins", "policy_thompson", "policy_proto_arm", "score_mlp_wide", "shuffled_batches",
)

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="given data not present")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return connection


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == ["batch", "n_events", "n_unscored", "reward", "loss", "regret"]
    assert entry.entry(spark).count() == 7


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(FOLDER))
    answer = duck.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in answer.description], answer.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_reward_model_learns(spark):
    rows = entry.queries()["reward_model_fit"](spark, str(FOLDER)).collect()
    assert {r.split for r in rows} == {"train", "holdout"} and {r.epoch for r in rows} == set(range(1, 31))
    train = {r.epoch: r.mse for r in rows if r.split == "train"}
    assert train[30] < train[1] and 0 < train[30] <= 0.25
