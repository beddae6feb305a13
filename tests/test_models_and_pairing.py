import numpy as np
import pytest
from pyspark.sql import functions as F

from armlight.functions.models import DenseNet, LinearModel, layer_widths, reward
from armlight.functions.vectors import assemble, context, dot, insert_front, relu, sigmoid, with_intercept
from armlight.operators import pairing as PR
from armlight.sources import interactions as I
from tests import brute


def random_net(features, widths, seed=3):
    rng = np.random.default_rng(seed)
    layers = []
    for n_in, n_out in zip(widths, widths[1:]):
        layers.append((rng.normal(size=(n_out, n_in)).tolist(), rng.normal(size=n_out).tolist()))
    return DenseNet(tuple(features), tuple(layers))


def test_reward_boundary_counts_as_one(spark):
    rows = spark.createDataFrame([(0.5,), (0.4999999,), (0.51,)], "p double")
    assert [r[0] for r in rows.select(reward("p")).collect()] == [1.0, 0.0, 1.0]


def test_layer_widths_round_half_to_even():
    assert layer_widths(2278) == [2278, 570, 285, 1]
    assert layer_widths(6) == [6, 2, 1, 1]
    assert layer_widths(2278, "halving") == [2278, 1139, 569, 284, 142, 1]
    assert layer_widths(2278, "critic") == [2278, 570, 1]


def test_vectors(spark):
    row = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double").select(
        assemble(["a", "b"]).alias("o"), assemble(["c"]).alias("u")
    )
    got = row.select(
        context("o", "u").alias("x"), with_intercept(F.col("o")).alias("i"), insert_front("o", F.lit(9.0)).alias("f"), dot("o", "o").alias("d")
    ).first()
    assert got.x == [1.0, 2.0, 3.0] and got.i == [1.0, 1.0, 2.0] and got.f == [9.0, 1.0, 2.0] and got.d == 5.0


def test_column_net_equals_batched_net(spark, skewed_facts):
    net = I.reward_net()
    rows = skewed_facts.select(net.score().alias("a"), net.batch_score().alias("b"), *I.FEATURES).collect()
    for r in rows[:50]:
        want = brute.net(I.REWARD_LAYERS, np.array([r[f] for f in I.FEATURES]))[0]
        assert r.a == pytest.approx(want, abs=1e-12) and r.b == pytest.approx(want, abs=1e-12)


def pairs_in_numpy(replay, score):
    users = replay.users.toPandas().sort_values("user_key")
    offers = replay.offers.toPandas().sort_values("offer_key")
    table = np.array(
        [[score(np.r_[o, u]) for o in offers[I.OFFER_FEATURES].to_numpy()] for u in users[I.USER_FEATURES].to_numpy()]
    )
    return table


@pytest.mark.parametrize("broadcast", [True, False])
def test_optimum_and_best_offer_equal_all_pairs(spark, replay, broadcast, request):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    table = pairs_in_numpy(replay, lambda x: brute.net(I.REWARD_LAYERS, x)[0])
    best = PR.best_pair_value(replay.users, replay.offers, ["user_key"], I.reward_net(), I.OFFER_FEATURES, "v")
    got = {r.user_key: r.v for r in best.collect()}
    assert len(got) == len(table)
    assert all(got[k] == pytest.approx(table[k].max(), abs=1e-12) for k in got)
    # tiles smaller than either side, so several tiles have to be merged
    chosen = PR.best_offer_by_net(replay.users, replay.offers, I.reward_net(), I.OFFER_FEATURES, tile_rows=5)
    picked = {r.user_key: (r.offer_key, r.score) for r in chosen.collect()}
    assert {k: v[0] for k, v in picked.items()} == {k: int(row.argmax()) for k, row in enumerate(table)}


def test_wide_net_uses_tiles_and_equals_all_pairs(spark, replay):
    net = random_net(I.FEATURES, [6, 40, 8, 1])
    assert not net.small
    table = pairs_in_numpy(replay, lambda x: brute.net(net.layers, x)[0])
    best = PR.best_pair_value(replay.users, replay.offers, ["user_key"], net, I.OFFER_FEATURES, "v")
    got = {r.user_key: r.v for r in best.collect()}
    assert all(got[k] == pytest.approx(table[k].max(), abs=1e-12) for k in range(len(table)))
    pair = PR.pair_all(replay.users.limit(1), replay.offers.limit(1), "user_key")
    scored = pair.select(net.score().alias("s"), *I.FEATURES).first()
    assert scored.s == pytest.approx(brute.net(net.layers, np.array([scored[f] for f in I.FEATURES]))[0], abs=1e-12)


@pytest.mark.parametrize("broadcast", [True, False])
def test_pair_all_gives_each_pair_once(spark, broadcast, request):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    left, right = spark.range(37).toDF("a"), spark.range(11).toDF("b")
    pairs = PR.pair_all(left, right, "a").collect()
    assert sorted(map(tuple, pairs)) == [(a, b) for a in range(37) for b in range(11)]
    assert "CartesianProduct" not in PR.pair_all(left, right, "a")._jdf.queryExecution().executedPlan().toString()


def test_nearest_by_dot_product_with_ties_and_nan(spark):
    rng = np.random.default_rng(1)
    arms = rng.normal(size=(60, 4))
    arms[10] *= 10
    arms[20] = arms[10]
    arms[30] = np.nan
    queries = rng.normal(size=(25, 4))
    queries[3] = arms[10] * 100
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "q bigint, x array<double>")
    right = spark.createDataFrame([(i * 10, v.tolist()) for i, v in enumerate(arms)], "k bigint, y array<double>")
    got = {r.q: r.k for r in PR.best_partner(left, right, "q", "k", "x", "y", tile_rows=16).collect()}
    scores = np.where(np.isnan(queries @ arms.T), -np.inf, queries @ arms.T)
    assert got == {i: int(scores[i].argmax()) * 10 for i in range(25)}
    assert got[3] == 100


def test_rank_prefers_lowest_key_and_ignores_nan(spark):
    rows = [(1, 5, 0.7), (1, 2, 0.7), (1, 9, float("nan")), (2, 4, 0.1)]
    scored = spark.createDataFrame(rows, "g bigint, k bigint, s double")
    got = PR.best_by_rank(scored, "g", "s", "k")
    assert {r.g: r.k for r in got.collect()} == {1: 2, 2: 4}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_activations(spark):
    row = spark.createDataFrame([(-2.0,), (0.0,), (3.0,)], "z double").select(relu(F.col("z")).alias("r"), sigmoid(F.col("z")).alias("s"))
    got = row.collect()
    assert [r.r for r in got] == [0.0, 0.0, 3.0]
    assert [r.s for r in got] == pytest.approx([1 / (1 + np.exp(-z)) for z in (-2.0, 0.0, 3.0)])


def test_linear_model_parts_add_up(spark):
    model = LinearModel({"a": 2.0, "b": -1.0}, 0.5, "linear")
    row = spark.createDataFrame([(3.0, 4.0)], "a double, b double")
    got = row.select(model.score().alias("s"), (model.part(["a"]) + model.part(["b"], 0.5)).alias("p")).first()
    assert got.s == got.p == 2.5


@pytest.mark.parametrize("widths", [[6, 3, 2, 1], [6, 40, 8, 1]])
def test_best_offers_by_bounds_equal_all_pairs(spark, widths):
    """Users and offers in the plane of few features; with ties, equal offers, and rows that miss a feature."""
    rng = np.random.default_rng(12)
    users, offers = rng.random((150, 3)), rng.random((2500, 3))
    offers[100:200] = offers[0:100]
    users[7, 1], offers[11, 2] = np.nan, np.nan
    net = random_net(I.FEATURES, widths)
    u = spark.createDataFrame([(k, *v) for k, v in enumerate(users.tolist())], "user_key bigint, u_bal double, u_bld double, u_nat double")
    o = spark.createDataFrame([(k, *v) for k, v in enumerate(offers.tolist())], "offer_key bigint, o_size double, o_price double, o_promo double")
    got = {r.user_key: (r.offer_key, r.score) for r in PR.best_offer_by_net(u, o, net, I.OFFER_FEATURES).collect()}
    layers = net.to_arrays()
    for k, user in enumerate(users):
        values = layers.forward(np.hstack([offers, np.tile(user, (len(offers), 1))]))[:, 0]
        if np.isnan(user).any():
            assert got[k] == (0, None)
            continue
        assert got[k][1] == pytest.approx(np.nanmax(values), abs=1e-12)
        assert values[got[k][0]] == pytest.approx(np.nanmax(values), abs=1e-12)
        assert not 100 <= got[k][0] < 200
    left = u.select("user_key", net.first_layer(I.USER_FEATURES, True).alias("_uv"))
    right = o.select("offer_key", net.first_layer(I.OFFER_FEATURES, False).alias("_ov"))
    scored = PR.pairs_scored(left, right, "user_key", "offer_key", "_uv", "_ov", PR._net_block(net.to_arrays()))
    # bounds over many units are loose, so a wide net may have to score every pair
    assert scored < (0.5 if widths[1] == 3 else 1.0) * len(users) * len(offers)


def test_dot_products_by_bounds(spark):
    rng = np.random.default_rng(13)
    left, right = rng.normal(size=(200, 3)), rng.normal(size=(3000, 3))
    a = spark.createDataFrame([(k, v) for k, v in enumerate(left.tolist())], "a bigint, x array<double>")
    b = spark.createDataFrame([(k, v) for k, v in enumerate(right.tolist())], "b bigint, y array<double>")
    got = {r.a: (r.b, r.score) for r in PR.best_partner(a, b, "a", "b", "x", "y").collect()}
    values = left @ right.T
    for k in range(200):
        assert got[k] == (values[k].argmax(), pytest.approx(values[k].max(), abs=1e-12))
    assert PR.pairs_scored(a, b, "a", "b", "x", "y") < 0.25 * values.size


def test_best_partners_over_many_cells_with_null_vectors(spark):
    rng = np.random.default_rng(14)
    left, right = rng.normal(size=(90, 3)).tolist(), rng.normal(size=(110, 3)).tolist()
    right[70] = right[20]
    left[5], right[8], right[9] = None, None, [1e9, None, 1e9]
    a = spark.createDataFrame(list(enumerate(left)), "a bigint, x array<double>")
    b = spark.createDataFrame(list(enumerate(right)), "b bigint, y array<double>")
    got = {r.a: (r.b, r.score) for r in PR.best_partner(a, b, "a", "b", "x", "y", tile_rows=8).collect()}
    assert got.pop(5) == (0, None)
    whole = np.array([[np.nan] * 3 if v is None or None in v else v for v in right])
    for k, (best, score) in got.items():
        values = np.nan_to_num(whole @ left[k], nan=-np.inf)
        assert (best, score) == (values.argmax(), pytest.approx(values.max(), abs=1e-12))
    assert len(got) == 89


def test_cells_send_few_copies_whatever_the_size():
    # few left rows: every right row is sent once
    assert PR._grid(10, 16_000, 64, 1024, 12)[0] == PR._grid(10, 960_000, 64, 1024, 12)[0] == 1
    # as many on both sides: the copies do not grow from 16,000 to 960,000 rows
    for n in (16_000, 160_000, 960_000):
        of_left, of_right = PR._grid(n, n, 64, 1024, 12)
        assert of_left + of_right <= 15 and of_left * of_right >= 48
    # no cell holds more than its share of a side
    of_left, of_right = PR._grid(20_000_000, 50, 64, 1024, 12)
    assert 20_000_000 * 64 / of_left <= PR.CELL_NUMBERS and of_right == 1


def test_vectors_are_sent_once_per_group_of_the_other_side(spark):
    rows = spark.range(100).select(F.col("id").alias("key"), F.expr("array(id * 1D, 2D)").alias("vector"))
    lefts = PR._dealt(rows, 5, 3, lambda mine, other: mine * 3 + other)
    rights = PR._dealt(rows, 3, 5, lambda mine, other: other * 3 + mine)
    assert lefts.count() == 300 and rights.count() == 500
    met = lefts.alias("l").join(rights.alias("r"), "cell").groupBy("l.key", "r.key").count()
    assert met.count() == 10_000 and met.where("count > 1").isEmpty()
