import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from armlight.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]", shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def no_broadcast(spark):
    """Every join is planned as if its smaller side were too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="session")
def skewed_facts(spark):
    """600 events of 40 users and 12 offers; user 0 and offer 0 hold more than a third."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = []
    for event in range(600):
        user = 0 if rng.random() < 0.4 else rng.randrange(1, 40)
        offer = 0 if rng.random() < 0.4 else rng.randrange(1, 12)
        rows.append((event * 3, user, offer, rng.randrange(2)))
    base = spark.createDataFrame(rows, "event_id bigint, user_id bigint, offer_id bigint, target int")

    def feature(key, k):
        return F.expr(f"((`{key}` * {k} + 3) % 17) / 17D")

    return base.select(
        "*",
        feature("user_id", 5).alias("u_bal"),
        feature("user_id", 7).alias("u_bld"),
        feature("user_id", 11).alias("u_nat"),
        feature("offer_id", 5).alias("o_size"),
        feature("offer_id", 3).alias("o_price"),
        feature("offer_id", 13).alias("o_promo"),
    )


@pytest.fixture(scope="session")
def replay(spark, skewed_facts):
    from armlight.plans.replay import build_tables

    return build_tables(skewed_facts)
