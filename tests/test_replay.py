import pytest
from pyspark.sql import functions as F

from armlight.operators import metrics as M
from armlight.operators import backprop as B
from armlight.operators import pairing as PR
from armlight.operators import policies as P
from armlight.plans import replay as R
from armlight.plans import rounds as O
from armlight.sources import interactions as I
from tests import brute


@pytest.fixture(scope="module")
def frames(skewed_facts):
    return brute.tables(skewed_facts.toPandas())


def linear(link):
    return brute.Linear([I.POLICY_WEIGHTS[f] for f in I.FEATURES], I.POLICY_INTERCEPT, link)


def by_batch(df):
    return {(r.epoch, r.batch): (r.n_events, r.reward, r.loss, r.regret) for r in df.collect()}


def check(got, want):
    assert len(got) == len(want)
    for epoch, batch, *values in want:
        assert got[(epoch, batch)] == pytest.approx(tuple(values), abs=1e-9)


def test_dimensions_and_order(replay, frames):
    users, offers, events = frames
    got = replay.replay.orderBy("seq").toPandas()
    assert list(got["seq"]) == list(range(1, 601))
    assert list(got["event_id"]) == list(events["event_id"])
    assert list(got["user_key"]) == list(events["user_key"])
    assert list(got["offer_key"]) == list(events["offer_key"])


@pytest.mark.parametrize("link", ["logit", "linear"])
@pytest.mark.parametrize("epsilon", [0.0, 0.3, 1.0])
def test_metrics_equal_event_by_event_replay(replay, frames, link, epsilon):
    got = by_batch(R.policy_metrics(replay, R.Policy(link, epsilon), size=64, epochs=2))
    check(got, brute.replay(*frames, linear(link), 64, epochs=2, epsilon=epsilon))


def test_deep_metrics(replay, frames):
    got = by_batch(R.policy_metrics(replay, R.Policy("deep"), size=64))
    check(got, brute.replay(*frames, lambda x: brute.net(I.DEEP_POLICY_LAYERS, x)[0], 64))


def test_metrics_without_broadcast_and_with_hot_keys(spark, replay, frames, no_broadcast):
    policy = R.Policy("logit", 0.3)
    exposed = M.exposures(R.pulls(replay, policy, 64), ("epoch", "batch"))
    rows = M.with_rewards(exposed, R.decide(replay, policy), replay.offers, I.reward_net(), "batch", hot_rows=5)
    got = by_batch(M.complete(M.batch_sums(rows, keys=("epoch", "batch")), 64))
    check(got, brute.replay(*frames, linear("logit"), 64, epsilon=0.3))


def test_zero_epsilon_equals_greedy(replay):
    events = replay.replay.select("seq", "user_key", F.lit(0).alias("epoch"))
    assert P.explore(events, replay.offers, 0.0, 7, ("epoch", "seq")).where("explored is not null").count() <= 1


def test_incomplete_tail_is_dropped(replay):
    got = R.policy_metrics(replay, R.Policy("logit")).collect()
    assert sorted(r.batch for r in got) == [0, 1, 2, 3] and all(r.n_events == 128 for r in got)


def test_metric_ranges(replay):
    rows = R.policy_metrics(replay, R.Policy("logit", 0.2), metrics=("r", "loss", "regret", "regret_abs", "regret_binary"))
    for r in rows.collect():
        assert 0 <= r.reward <= 128 and 0 <= r.loss <= 128 and r.regret >= 0 and r.regret_binary >= 0
        assert r.regret_abs == pytest.approx(r.regret, abs=1e-9)


def test_single_offer(spark, skewed_facts):
    tables = R.build_tables(skewed_facts.where("offer_id = 0"))
    rows = R.policy_metrics(tables, R.Policy("deep", 0.5), size=16).collect()
    assert rows and all(r.regret == pytest.approx(0.0, abs=1e-12) for r in rows)


def test_empty_log(skewed_facts):
    tables = R.build_tables(skewed_facts.where("false"))
    assert R.policy_metrics(tables, R.Policy("logit")).count() == 0
    assert R.policy_metrics(tables, R.Policy("deep")).count() == 0


@pytest.mark.parametrize("link,epsilon,compat", [("logit", 0.0, False), ("linear", 0.0, False), ("logit", 0.4, True), ("logit", 0.4, False)])
def test_rounds_equal_sequential_training(replay, frames, link, epsilon, compat):
    log, model = O.policy_rounds(replay, R.Policy(link, epsilon), rounds=3, epochs=2, compat=compat)
    trained = linear(link)
    greedy = epsilon == 0.0
    want = brute.replay(
        *frames, trained, 200, epochs=2, epsilon=epsilon, train=True,
        best_in_training=compat or greedy, pulled_loss=not (compat or greedy),
    )
    for (epoch, batch, sums, _), row in zip(log, want, strict=True):
        assert (epoch, batch) == row[:2]
        assert (sums["n_events"], sums["reward"], sums["loss"], sums["regret"]) == pytest.approx(row[2:], abs=1e-9)
    assert [model.weights[f] for f in I.FEATURES] == pytest.approx(list(trained.w), abs=1e-12)
    assert model.intercept == pytest.approx(trained.b, abs=1e-12)


def test_net_gradient_by_differences(spark, replay):
    import numpy as np

    net = I.deep_policy_net()
    pairs = PR.pair_all(replay.users.limit(6), replay.offers.limit(3), "user_key")
    rows = pairs.select(
        *I.FEATURES, F.expr("double(user_key % 2)").alias("r"), F.expr("1 + offer_key").alias("n")
    ).persist()
    pdf = rows.toPandas()
    x, r, n = pdf[I.FEATURES].to_numpy(), pdf["r"].to_numpy(), pdf["n"].to_numpy()
    flat = B.flatten(net)

    def loss(values):
        layers = B.with_weights(net, values).layers
        return sum(w * (brute.net(layers, a)[0] - b) ** 2 for a, b, w in zip(x, r, n))

    got, count, error = B.summed_gradient(rows.select(F.array(*I.FEATURES).alias("x"), F.col("r").alias("y"), "n"), net)
    assert (count, error) == (n.sum(), pytest.approx(loss(flat)))
    for k in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert got[k] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-5)
    rows.unpersist()


def test_deep_rounds_take_sign_steps(replay):
    import numpy as np

    log, model = O.policy_rounds(replay, R.Policy("deep"), rounds=2, epochs=1)
    assert sum(s["n_events"] for _, _, s, _ in log) == 600
    moved = np.abs(B.flatten(model) - B.flatten(I.deep_policy_net()))
    assert moved.max() <= 2e-4 + 1e-9 and (moved > 0).any()


def test_thompson_rounds_gain_precision(replay):
    log = O.thompson_rounds(replay, rounds=3, steps=5)
    assert sum(s["n_events"] for _, s, _, _ in log) == 600
    for (_, _, _, before), (_, _, _, after) in zip(log, log[1:]):
        assert all(after[f] >= before[f] for f in before)
    assert log[-1][3]["intercept"] > 1.0


def test_other_columns_and_a_wide_reward_net(spark, skewed_facts):
    import numpy as np

    from armlight.functions.models import LinearModel
    from tests.test_models_and_pairing import random_net

    names = {f: f"col {f}[0]" for f in I.FEATURES}
    facts = skewed_facts.withColumnsRenamed(names).withColumnsRenamed({"user_id": "uid", "event_id": "at"})
    features = [names[f] for f in I.FEATURES]
    net = random_net(features, [6, 40, 8, 1])
    spec = R.ReplaySpec(
        user_id="uid", position="at",
        user_features=tuple(names[f] for f in I.USER_FEATURES),
        offer_features=tuple(names[f] for f in I.OFFER_FEATURES),
        reward=net,
        linear=LinearModel({names[f]: w for f, w in I.POLICY_WEIGHTS.items()}, I.POLICY_INTERCEPT),
    )
    tables = R.build_tables(facts, spec)
    rows = {r.batch: r for r in R.policy_metrics(tables, R.Policy("logit"), size=100).collect()}
    users, offers, events = brute.tables(skewed_facts.toPandas())
    o, u = offers[I.OFFER_FEATURES].to_numpy(), users[I.USER_FEATURES].to_numpy()
    best = int((o @ np.array([I.POLICY_WEIGHTS[f] for f in I.OFFER_FEATURES])).argmax())
    values = np.array([[brute.net(net.layers, np.r_[a, b])[0] for a in o] for b in u])
    per_event = (values.max(axis=1) - values[:, best])[events["user_key"].to_numpy()]
    for k in range(6):
        assert rows[k].regret == pytest.approx(per_event[k * 100 : (k + 1) * 100].sum(), abs=1e-9)


def test_facts_are_read_once(spark, skewed_facts):
    """The dimensions and the keys come from one pass over the facts, however dear their joins are."""
    from armlight.plans.replay import build_tables

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    facts = skewed_facts.mapInPandas(count, skewed_facts.schema)
    tables = build_tables(facts)
    assert tables.replay.count() == 600 and seen.value == 600
