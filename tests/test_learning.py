"""Learning policies against an event-by-event replay, and one rule for missing features everywhere."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from armlight.functions.models import DenseNet
from armlight.operators import training as T
from armlight.plans import learning as LE
from armlight.plans import replay as R
from armlight.plans import rounds as O
from armlight.sources import interactions as I
from armlight.sources.files import stage
from tests import brute

POLICIES = {
    "greedy": R.Policy("logit"), "some": R.Policy("logit", 0.2), "more": R.Policy("linear", 0.5, loss_on="pulled"), "linear": R.Policy("linear"),
}


@pytest.fixture(scope="module")
def frames(skewed_facts):
    return brute.tables(skewed_facts.toPandas())


def test_every_policy_learns_as_if_alone(replay, frames):
    """With a round per batch the log is that of the sequential replay, policy by policy."""
    log, models = LE.learn(replay, POLICIES, rounds=12, epochs=2, size=50)
    got = {(r.policy, r.epoch, r.batch): r for r in log.collect()}
    assert len(got) == 4 * 24
    for name, policy in POLICIES.items():
        model = brute.Linear([I.POLICY_WEIGHTS[f] for f in I.FEATURES], I.POLICY_INTERCEPT, policy.model)
        want = brute.replay(
            *frames, model, 50, epochs=2, epsilon=policy.epsilon, train=True, best_in_training=False, pulled_loss=policy.loss_on == "pulled"
        )
        for epoch, batch, n, reward, loss, regret in want:
            r = got[name, epoch, batch]
            assert (r.n_events, r.n_unscored, r.iteration) == (n, 0, epoch * 12 + batch + 1)
            assert (r.reward, r.loss, r.regret) == pytest.approx((reward, loss, regret), abs=1e-9)
        assert list(models[name].weights.values()) == pytest.approx(list(model.w), abs=1e-12)


def test_few_rounds_log_every_batch(replay):
    log, models = LE.learn(replay, POLICIES, rounds=3, epochs=2, size=50)
    rows = log.collect()
    assert sorted((r.policy, r.iteration) for r in rows) == sorted((p, i) for p in POLICIES for i in range(1, 25))
    _, alone = O.policy_rounds(replay, POLICIES["some"], rounds=3, epochs=2)
    assert models["some"].weights == pytest.approx(alone.weights, abs=1e-12)


def test_no_events(skewed_facts):
    log, models = LE.learn(R.build_tables(skewed_facts.where("false")), {"a": R.Policy("logit")}, rounds=2, epochs=1)
    assert log.count() == 0 and models["a"].weights == I.POLICY_WEIGHTS


def test_other_models_are_refused(replay):
    with pytest.raises(ValueError):
        LE.learn(replay, {"a": R.Policy("proto")})
    with pytest.raises(ValueError):
        O.policy_rounds(replay, R.Policy("proto"))


@pytest.fixture(scope="module")
def holed(skewed_facts):
    """Facts in which two users and two offers miss a feature: null or NaN."""
    def hole(column, key, null, nan):
        return F.when(F.col(key) == null, None).when(F.col(key) == nan, F.lit(float("nan"))).otherwise(F.col(column))

    facts = skewed_facts.withColumns({"u_bal": hole("u_bal", "user_id", 3, 0), "o_size": hole("o_size", "offer_id", 2, 0)})
    return R.build_tables(facts)


@pytest.fixture(scope="module")
def holed_arrays(holed):
    users, offers = holed.users.toPandas().sort_values("user_key"), holed.offers.toPandas().sort_values("offer_key")
    return users[I.USER_FEATURES].to_numpy(float), offers[I.OFFER_FEATURES].to_numpy(float), holed.replay.toPandas().sort_values("seq")


def holed_replay(arrays, score, epsilon, size=60):
    u, o, events = arrays
    with np.errstate(invalid="ignore"):
        values = np.array([[brute.net(I.REWARD_LAYERS, np.r_[b, a])[0] for b in o] for a in u])
        scores = np.array([[score(np.r_[b, a]) for b in o] for a in u])
    optimum = np.array([np.nanmax(v) if np.isfinite(v).any() else np.nan for v in values])
    whole = np.isfinite(o).all(axis=1)
    out = []
    for start in range(0, len(events) - size + 1, size):
        sums = np.zeros(4)
        for row in events.iloc[start : start + size].itertuples():
            best = int(np.argmax(np.where(whole, np.nan_to_num(scores[row.user_key], nan=-1e9), -np.inf)))
            arm = best
            if epsilon and not brute.uniform("7explore", 0, row.seq) > epsilon:
                arm = int(np.floor(brute.uniform("7arm", 0, row.seq) * len(o)))
            prob, pred, top = values[row.user_key, arm], scores[row.user_key, best], optimum[row.user_key]
            if not np.isfinite(prob + pred + top):
                sums[0] += 1
                continue
            r = float(prob >= 0.5)
            sums[1:] += [r, abs(r - pred), max(top - prob, 0.0)]
        out.append((size, *sums))
    return out


@pytest.mark.parametrize("model", ["logit", "linear", "deep"])
@pytest.mark.parametrize("epsilon", [0.0, 0.6])
def test_missing_features_are_unscored(holed, holed_arrays, model, epsilon):
    if model == "deep":
        def score(x):
            return brute.net(I.DEEP_POLICY_LAYERS, x)[0]
    else:
        score = brute.Linear([I.POLICY_WEIGHTS[f] for f in I.FEATURES], I.POLICY_INTERCEPT, model)
    rows = R.policy_metrics(holed, R.Policy(model, epsilon), size=60).orderBy("batch").collect()
    want = holed_replay(holed_arrays, score, epsilon)
    assert sum(w[1] for w in want) > 100
    got = [(r.n_events, r.n_unscored, r.reward, r.loss, r.regret) for r in rows]
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-9)


def test_missing_features_in_learning(holed, holed_arrays):
    policies = {"a": R.Policy("logit", 0.6), "b": R.Policy("linear")}
    log, models = LE.learn(holed, policies, rounds=1, epochs=1, size=60)
    model = brute.Linear([I.POLICY_WEIGHTS[f] for f in I.FEATURES], I.POLICY_INTERCEPT, "logit")
    want = holed_replay(holed_arrays, model, 0.6)
    got = [(r.n_events, r.n_unscored, r.reward, r.loss, r.regret) for r in log.where("policy = 'a'").orderBy("batch").collect()]
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-9)
    assert np.isfinite(list(models["a"].weights.values())).all()


def test_a_net_scores_null_for_a_missing_feature(spark, skewed_facts):
    net = I.reward_net()
    rows = skewed_facts.limit(3).withColumn("o_size", F.lit(None).cast("double")).select(net.score().alias("a"), net.batch_score().alias("b"))
    assert all(r.a is None and (r.b is None or np.isnan(r.b)) for r in rows.collect())


def test_optimum_of_a_user_without_features_is_null(holed):
    rows = holed.users.where("user_id in (0, 3)").collect()
    assert len(rows) == 2 and all(r.optimum is None for r in rows)
    assert holed.users.where("user_id not in (0, 3) and (optimum is null or optimum <= 0)").count() == 0


def test_an_empty_round_keeps_the_model(replay):
    exposed = O.staged_exposures(replay, R.Policy("deep"), 600, 1).where("false")
    net = I.deep_policy_net()
    assert O.net_round(exposed, replay, net).model is net
    model = I.policy_model()
    assert O.linear_round(exposed, replay, model).model is model
    assert T.gradient_step(R.reward_rows(replay, R.Policy("logit")).where("false"), model, I.policy_table(replay.users.sparkSession)).count() == 7


def test_users_of_a_round_are_not_broadcast_by_the_size_of_their_file(spark, replay):
    values = [F.lit(0.5).alias(c) for c in (*I.USER_FEATURES, "optimum")]
    users = stage(spark.range(100_000).select(F.col("id").alias("user_key"), *values), "many-users")
    exposed = spark.range(100_000).selectExpr("0 as policy", "id as batch", "id as user_key", "cast(null as bigint) as explored", "1L as n")
    rows = LE.round_rows(exposed, replace(replay, users=users), [I.policy_model()], [(0, 0.1)])
    assert rows.count() == 100_000
    assert "SortMergeJoin" in rows._jdf.queryExecution().executedPlan().toString()
