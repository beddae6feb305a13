"""Permutations, distributed back-propagation, the net store, and everything at the full width of 2,278 features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from armlight.functions.models import LinearModel, layer_widths, rule_net, weights_table
from armlight.functions.vectors import assemble
from armlight.operators import backprop as B
from armlight.operators import permutation as P
from armlight.operators import policies
from armlight.operators import training as T
from armlight.plans import evaluation as E
from armlight.plans import replay as R
from armlight.plans import rounds as O
from armlight.session import fresh_path
from armlight.sources import interactions as I
from armlight.sources import stores

WIDE = 2278


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 1000, 4097, 70_000])
def test_permutation_is_one(n):
    for epoch in (0, 1, 29):
        assert sorted(P.permute(np.arange(n), n, epoch, 100)) == list(range(n))


def test_permutations_differ_by_epoch_and_seed():
    orders = {tuple(P.permute(np.arange(1000), 1000, e, s)) for e in range(5) for s in (1, 2)}
    assert len(orders) == 10
    mixed = P.permute(np.r_[np.arange(1000), np.arange(1000)], 1000, np.repeat([0, 1], 1000), 1)
    assert tuple(mixed[:1000]) in orders and tuple(mixed[1000:]) in orders


def plain_fit(net, x, y, epochs, batches, seed, rate):
    """The fit row by row: the order of an epoch, a step per batch, kept moments."""
    weights, n = B.flatten(net), len(x)
    size = -(-n // batches)
    m, v, t, out = np.zeros_like(weights), np.zeros_like(weights), 0, []
    for epoch in range(epochs):
        place = P.permute(np.arange(n), n, epoch, seed)
        for batch in range(batches):
            rows = np.flatnonzero(place // size == batch)
            layers = B.unflatten(weights, B.shapes(net))
            g = sum(B.gradient(layers, x[[k]], y[[k]], np.ones(1))[0] for k in rows) / len(rows) + 1e-5 * weights
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            weights = weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        out.append(weights)
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    """300 rows of 20 features whose label a net can learn, some of them damaged."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 20))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    rows = [(k, a.tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(rows, "id bigint, x array<double>, y double").repartition(5)
    columns = [F.col("x")[i].alias(f"f{i}") for i in range(20)]
    return x, y, frame.select(F.col("id").alias("event_id"), *columns, F.col("y").alias("target"), F.when(F.col("id") % 10 == 0, "holdout").otherwise("train").alias("split"))


def features():
    return [f"f{i}" for i in range(20)]


def test_fit_equals_plain_steps(spark, labelled):
    x, y, rows = labelled
    net = rule_net([20, 10, 5, 2, 1, 1], features())
    path = fresh_path(spark, "fit-test")
    curve = E.fit_reward_net(rows, net, path, epochs=4, batches=3, rate=0.05, save_every=2)
    kept = np.arange(300) % 10 != 0
    want = plain_fit(net, x[kept], y[kept], 4, 3, 100, 0.05)
    assert B.flatten(stores.load_net(spark, path, 2)[0]) == pytest.approx(want[1], abs=1e-9)
    assert B.flatten(stores.load_net(spark, path)[0]) == pytest.approx(want[3], abs=1e-9)
    got = {(r.epoch, r.split): (r.n, r.mse) for r in curve.collect()}
    assert set(got) == {(e, s) for e in range(1, 5) for s in ("train", "holdout")}
    for (epoch, split), (n, mse) in got.items():
        here = kept if split == "train" else ~kept
        p = B.forward(B.unflatten(want[epoch - 1], B.shapes(net)), x[here])[-1][:, 0]
        assert n == here.sum() and mse == pytest.approx(((p - y[here]) ** 2).mean(), abs=1e-9)


def test_fit_goes_on_after_a_stop(spark, labelled):
    _, _, rows = labelled
    net = rule_net([20, 5, 2, 1], features())
    whole, parted = fresh_path(spark, "fit-test"), fresh_path(spark, "fit-test")
    E.fit_reward_net(rows, net, whole, epochs=6, batches=2, rate=0.05, save_every=3)
    E.fit_reward_net(rows, net, parted, epochs=3, batches=2, rate=0.05, save_every=3)
    curve = E.fit_reward_net(rows, net, parted, epochs=6, batches=2, rate=0.05, save_every=3)
    assert {r.epoch for r in curve.collect()} == {4, 5, 6}
    assert B.flatten(stores.load_net(spark, parted)[0]) == pytest.approx(B.flatten(stores.load_net(spark, whole)[0]), abs=1e-12)


def test_fit_learns(spark, labelled):
    _, _, rows = labelled
    curve = E.fit_reward_net(rows, rule_net([20, 10, 1], features()), fresh_path(spark, "fit-test"), epochs=40, rate=0.05, save_every=40)
    train = {r.epoch: r.mse for r in curve.collect() if r.split == "train"}
    assert train[40] < 0.7 * train[1]


def test_rows_without_a_value_do_not_train(spark):
    rows = [([1.0, 2.0], 1.0), ([None, 2.0], 1.0), ([1.0, float("nan")], 0.0), (None, 1.0), ([3.0, 1.0], None), ([float("inf"), 0.0], 1.0), ([0.5, 0.5], 0.0)]
    frame = spark.createDataFrame(rows, "x array<double>, y double").repartition(3)
    net = rule_net([2, 3, 1])
    got = B.summed_gradient(frame, net)
    good = np.array([[1.0, 2.0], [0.5, 0.5]])
    want = B.gradient(net.to_arrays().layers, good, np.array([1.0, 0.0]), np.ones(2))
    assert got[1] == 2 and got[0] == pytest.approx(want[0]) and got[2] == pytest.approx(want[2])
    empty = B.summed_gradient(frame.where("false"), net)
    assert empty[1] == 0 and not empty[0].any()


def test_gradient_in_blocks(spark, monkeypatch):
    """Blocks of seven weights and row blocks of two rows give the same sums."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(50, 6)), rng.integers(0, 2, 50).astype(float)
    frame = spark.createDataFrame([(a.tolist(), b) for a, b in zip(x, y.tolist())], "x array<double>, y double").repartition(4)
    net = rule_net([6, 4, 3, 1])
    want = B.gradient(net.to_arrays().layers, x, y, np.ones(50))[0]
    monkeypatch.setattr(B, "BLOCK", 7)
    monkeypatch.setattr(B, "CELLS", 12)
    assert B.summed_gradient(frame, net)[0] == pytest.approx(want)


def test_store_shows_committed_versions_only(spark, monkeypatch):
    path = fresh_path(spark, "store-test")
    net = rule_net([6, 4, 1], ["a", "b", "c", "d", "e", "f"])
    assert not stores.has_commits(spark, path)
    optimizer = B.Adam(0.01)
    moved = B.with_weights(net, optimizer.step(B.flatten(net), np.ones(33)))
    monkeypatch.setattr(stores, "BLOCK", 5)
    stores.save_net(spark, net, path, 3)
    stores.save_net(spark, moved, path, 4, optimizer)
    # a writer that died before its commit
    spark.createDataFrame([(0, "matrix", 0, [1.0])], stores._BLOCKS).write.parquet(f"{path}/blocks/lost")
    other = spark.newSession()
    loaded, state = stores.load_net(other, path)
    assert loaded.features == net.features and B.flatten(loaded).tolist() == B.flatten(moved).tolist()
    assert (state.steps, state.rate) == (1, 0.01) and state.first.tolist() == optimizer.first.tolist()
    assert state.second.tolist() == optimizer.second.tolist()
    assert B.flatten(stores.load_net(other, path, 3)[0]).tolist() == B.flatten(net).tolist()
    stores.save_net(spark, moved, path, 3)
    assert B.flatten(stores.load_net(other, path, 3)[0]).tolist() == B.flatten(moved).tolist()
    assert sorted(r.version for r in stores.net_versions(other, path).collect()) == [3, 4]
    with pytest.raises(ValueError):
        stores.load_net(other, path, 9)


@pytest.fixture(scope="module")
def wide(spark):
    """40 events of 12 users and 5 offers whose features are 1,089 and 1,189 columns, written once."""
    rng = np.random.default_rng(5)
    users, offers = [f"u{i}" for i in range(1089)], [f"o{i}" for i in range(1189)]
    u, o = rng.normal(size=(12, 1089)) / 20, rng.normal(size=(5, 1189)) / 20

    def table(key, names, values):
        rows = [(k, v.tolist()) for k, v in enumerate(values)]
        frame = spark.createDataFrame(rows, f"{key} bigint, v array<double>")
        path = fresh_path(spark, "wide")
        frame.select(key, *[F.col("v")[i].alias(n) for i, n in enumerate(names)]).coalesce(1).write.parquet(path)
        return spark.read.parquet(path)

    weights = rng.normal(size=WIDE) / 3
    model = LinearModel(dict(zip(offers + users, weights.tolist())), 0.2, "logit")
    pairs = [(k % 12, k % 5, float(k % 3 == 0), 1 + k % 2) for k in range(40)]
    return table("user_key", users, u), table("offer_key", offers, o), model, u, o, pairs


def test_training_sums_at_full_width(spark, wide):
    users, offers, model, u, o, pairs = wide
    facts = spark.createDataFrame(pairs, "user_key bigint, offer_key bigint, r double, n bigint")
    rows = facts.join(F.broadcast(users), "user_key").join(F.broadcast(offers), "offer_key")
    x = np.array([np.r_[o[b], u[a]] for a, b, _, _ in pairs])
    r, n = (np.array([p[k] for p in pairs], float) for k in (2, 3))
    w = np.array(list(model.weights.values()))
    p = 1 / (1 + np.exp(-(x @ w + 0.2)))
    scored = rows.select("user_key", "offer_key", model.score().alias("p")).collect()
    want = {(a, b): v for (a, b, _, _), v in zip(pairs, p)}
    assert all(s.p == pytest.approx(want[s.user_key, s.offer_key], abs=1e-12) for s in scored)
    sums = B.linear_sums(T.with_features(rows, model), model)
    ones = np.c_[np.ones(len(x)), x]
    assert sums["gradient"] == pytest.approx((2 * n * (p - r) * p * (1 - p)) @ ones, abs=1e-9)
    assert sums["log_gradient"] == pytest.approx((n * (p - r)) @ ones, abs=1e-9)
    assert sums["precision"] == pytest.approx((n * p * (1 - p)) @ (ones * ones), abs=1e-9)
    assert sums["log_loss"] == pytest.approx(-(n * (r * np.log(p) + (1 - r) * np.log(1 - p))).sum(), abs=1e-9)
    best = policies.greedy_linear(users, offers, model, list(model.features[:1189])).select("user_key", "best_offer", "best_score").collect()
    top = int(np.argmax(o @ w[:1189]))
    assert {b.best_offer for b in best} == {top}
    for b in best:
        assert b.best_score == pytest.approx(1 / (1 + np.exp(-(o[top] @ w[:1189] + u[b.user_key] @ w[1189:] + 0.2))), abs=1e-12)
    table = weights_table(spark, [(f, v, v, 4.0) for f, v in [("intercept", 0.2), *model.weights.items()]], ("w", "m", "q"))
    step = {s.feature: s.gradient for s in T.gradient_step(rows, model, table).collect()}
    assert step["u7"] == pytest.approx(sums["gradient"][1 + 1189 + 7] / n.sum(), abs=1e-12)


def test_reward_net_trains_at_full_width(spark, wide):
    _, _, _, u, o, pairs = wide
    net = rule_net(layer_widths(WIDE))
    x = np.array([np.r_[o[b], u[a]] for a, b, _, _ in pairs])
    y = np.array([p[2] for p in pairs])
    frame = spark.createDataFrame([(a.tolist(), b) for a, b in zip(x, y.tolist())], "x array<double>, y double").repartition(3)
    got, n, _ = B.summed_gradient(frame, net)
    want, _, _ = B.gradient(net.to_arrays().layers, x, y, np.ones(len(y)))
    assert len(got) == 1_462_051 and n == 40
    assert got == pytest.approx(want, abs=1e-10)


def test_rounds_at_full_width(spark, wide):
    users, offers, model, _, _, pairs = wide
    reward = rule_net([WIDE, 2, 1], model.features)
    spec = R.ReplaySpec(user_features=tuple(model.features[1189:]), offer_features=tuple(model.features[:1189]), linear=model, reward=reward)
    replay = spark.createDataFrame([(k + 1, k, a, b) for k, (a, b, _, _) in enumerate(pairs)], "seq bigint, event_id bigint, user_key bigint, offer_key bigint")
    tables = R.ReplayTables(users.withColumn("optimum", F.lit(1.0)), offers, replay, spec)
    log, last = O.policy_rounds(tables, R.Policy("logit"), rounds=1, epochs=1)
    assert log[0][2]["n_events"] == 40 and len(last.weights) == WIDE
    draws = O.thompson_rounds(tables, rounds=1, steps=2)
    assert draws[0][1]["n_events"] == 40 and len(draws[0][2]) == WIDE + 1


def test_packed_rows_train_as_plain_ones(spark, monkeypatch):
    """Blocks of several sizes; rows with a null, NaN or infinite value take a number but no part."""
    rng = np.random.default_rng(21)
    x = rng.random((700, 3))
    x[5, 1], x[77, 0] = np.nan, np.inf
    rows = [(k, [None, 0.5, 0.5] if k == 9 else v, float(k % 2)) for k, v in enumerate(x.tolist())]
    plain = spark.createDataFrame(rows, "number bigint, x array<double>, y double").repartition(3)
    net = rule_net([3, 2, 1], ["a", "b", "c"])
    monkeypatch.setattr(B, "PACK_ROWS", 100)
    blocks = B.packed(plain, 3).cache()
    assert blocks.select(F.expr("sum(length(y)) / 8")).first()[0] == 697 and blocks.count() < 12
    wanted = [B.flatten(n) for _, n, _ in B.train(plain, net, 700, 2, 2, optimizer=B.Adam(0.01))]
    got = [B.flatten(n) for _, n, _ in B.train(blocks, net, 700, 2, 2, optimizer=B.Adam(0.01))]
    assert np.allclose(wanted, got, atol=1e-12, rtol=0)


def test_places_hold_for_one_epoch_and_for_many(spark):
    numbers = np.arange(5000)
    epochs = np.repeat([0, 4], 2500)
    places = P.permute(numbers, 5000, epochs, 100)
    assert (places[:2500] == P.permute(numbers[:2500], 5000, 0, 100)).all()
    assert (places[2500:] == P.permute(numbers[2500:], 5000, 4, 100)).all()
    assert P.permute([0, 1, 2, 4999], 1 << 40, 3, 100).max() > 1 << 32


def test_fit_steps_read_packed_rows(spark, skewed_facts, monkeypatch):
    """Every step of a fit reads blocks in binary and not a row per event."""
    given, train = [], B.train
    monkeypatch.setattr(B, "train", lambda rows, *rest: given.append(rows) or train(rows, *rest))
    rows = E.split_rows(skewed_facts, "event_id")
    E.fit_reward_net(rows, rule_net([6, 2, 1], I.FEATURES), fresh_path(spark, "fit"), epochs=2, batches=2)
    (blocks,) = given
    assert blocks.columns == ["numbers", "x", "y"] and blocks.count() < 100
    assert blocks.select(F.expr("sum(length(y)) / 8")).first()[0] == rows.where("split = 'train'").count()
