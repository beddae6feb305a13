"""Online rounds: a model is constant inside a batch and stepped between batches.

The dependence between rounds cannot be removed, so rounds are few and batches
large. A round reads its own partition of the exposures and returns one row of
sums; the driver holds nothing but the model.
"""

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlight.functions.models import DenseNet, weights_table
from armlight.operators import backprop as B
from armlight.operators import metrics as M
from armlight.operators import policies as P
from armlight.operators import training as T
from armlight.plans.replay import SEED, Policy, ReplayTables, pulls
from armlight.session import shuffle_width
from armlight.sources.files import stage


def round_size(tables: ReplayTables, rounds: int) -> int:
    """Batch size that cuts the whole replay into ``rounds`` batches."""
    return max(1, -(-tables.replay.count() // rounds))


def staged_exposures(tables: ReplayTables, policy: Policy, size: int, epochs: int, seed=SEED) -> DataFrame:
    """Exposures in one folder per epoch and batch, so a round reads only its own."""
    exposed = M.exposures(pulls(tables, policy, size, epochs, seed), ("epoch", "batch"))
    width = shuffle_width(exposed.sparkSession)
    exposed = exposed.repartition("epoch", "batch", F.pmod(F.xxhash64("user_key"), F.lit(width)))
    return stage(exposed, "exposures", partition_by=("epoch", "batch"))


@dataclass
class RoundResult:
    model: object
    sums: dict


def _as_sums(found: dict) -> dict:
    return {"n_events": int(found["given"]), "reward": found["r"], "loss": found["loss"], "regret": found["regret"]}


def _metric_sums():
    sums = "sum(n) as n_events", "sum(n * r) as reward", "sum(n * loss) as loss", "sum(n * regret) as regret"
    return [F.expr(s) for s in sums]


def linear_round(exposed: DataFrame, tables: ReplayTables, model, compat: bool = False, rate=T.LEARNING_RATE):
    """One round of a linear or logistic policy.

    Loss and gradient use the pulled offer. With ``compat`` the loss uses the
    best score and the gradient the features of the best offer, also where
    another offer was pulled and rewarded.
    """
    users = P.greedy_linear(tables.users, tables.offers, model, tables.spec.offer_features)
    pred = None if compat else model.score()
    rows = M.with_rewards(exposed, users, tables.offers, tables.spec.reward, "user_key", pred)
    if compat:
        best = P.best_linear_offer(tables.offers, model, tables.spec.offer_features, tables.spec.offer_features)
        features = best.select(F.struct(*tables.spec.offer_features).alias("best"))
        rows = rows.withColumn("_best", features.scalar())
        rows = rows.withColumns({f: F.col(f"_best.{f}") for f in tables.spec.offer_features})
    found = B.linear_sums(T.with_features(rows, model, ("r", "n", "loss", "regret")), model, ("r", "loss", "regret"))
    sums = _as_sums(found)
    if not found["n"]:
        return RoundResult(model, sums)
    flat = np.array([model.intercept, *model.weights.values()])
    flat = T.first_adam_step(flat, found["gradient"] / found["n"], rate).tolist()
    return RoundResult(model.with_values(dict(zip(model.features, flat[1:])), flat[0]), sums)


def net_round(exposed: DataFrame, tables: ReplayTables, net: DenseNet, rate=T.LEARNING_RATE):
    """One round of a net policy; the model has as many weights as the net."""
    users = stage(P.greedy_net(tables.users, tables.offers, net, tables.spec.offer_features), "choices")
    rows = M.with_rewards(exposed, users, tables.offers, tables.spec.reward, "user_key", net.score())
    rows = stage(rows.select(*net.features, "r", "n", "loss", "regret"), "round")
    found = rows.agg(*_metric_sums()).first().asDict()
    sums = {k: v or 0 for k, v in found.items()}
    x = rows.select(F.array(*net.features).alias("x"), F.col("r").alias("y"), "n")
    gradient, n, _ = B.summed_gradient(x, net)
    if not n:
        return RoundResult(net, sums)
    return RoundResult(B.with_weights(net, T.first_adam_step(B.flatten(net), gradient / n, rate)), sums)


def policy_rounds(
    tables: ReplayTables,
    policy: Policy,
    rounds: int = 4,
    epochs: int = 4,
    compat: bool = False,
    seed=SEED,
    rate=T.LEARNING_RATE,
):
    """All rounds over the whole replay; metrics per round and the last model.

    A proto policy has no model of its own that a round could train.
    """
    if policy.model not in ("linear", "logit", "deep"):
        raise ValueError(f"rounds do not train a {policy.model!r} policy")
    size = round_size(tables, rounds)
    exploring = policy.epsilon > 0
    exposed = staged_exposures(tables, policy, size, epochs if exploring else 1, seed)
    deep = policy.model == "deep"
    model = tables.spec.deep if deep else policy.linear_model(tables.spec)
    log = []
    for epoch in range(epochs):
        for batch in range(rounds):
            part = exposed.where((F.col("epoch") == (epoch if exploring else 0)) & (F.col("batch") == batch))
            if deep:
                result = net_round(part, tables, model, rate)
            else:
                result = linear_round(part, tables, model, compat, rate)
            model = result.model
            log.append((epoch, batch, result.sums, model))
    return log, model


def rounds_table(spark, log) -> DataFrame:
    """Metrics per round; for linear models also the weights after the round."""
    rows = []
    for epoch, batch, sums, model in log:
        row = {"epoch": epoch, "batch": batch}
        row |= {k: sums[k] for k in ("n_events", "reward", "loss", "regret")}
        if hasattr(model, "weights"):
            row["w_intercept"] = model.intercept
            row |= {f"w_{f}": w for f, w in model.weights.items()}
        rows.append(row)
    schema = "epoch bigint, batch bigint, n_events bigint, reward double, loss double, regret double"
    for name in list(rows[0])[6:]:
        schema += f", {name} double"
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def thompson_rounds(
    tables: ReplayTables, rounds: int = 4, steps: int = 5, seed=SEED, std: str = "1/sqrt(q)", start_precision: float = 1.0
):
    """Thompson sampling with a diagonal Gaussian posterior of logistic weights.

    Per round: draw weights, pull the best offer for every event of the batch,
    fit ``sum 0.5 q (w-m)^2 + log loss`` by damped diagonal Newton steps, take the
    fit as the new mean and add ``sum x^2 p (1-p)`` to the precision.
    """
    size = round_size(tables, rounds)
    exposed = staged_exposures(tables, Policy("logit"), size, 1, seed)
    spark = exposed.sparkSession
    base = replace(tables.spec.linear, link="logit")
    names = ["intercept"] + base.features
    m = dict.fromkeys(names, 0.0)
    q = dict.fromkeys(names, float(start_precision))

    def as_model(values):
        return base.with_values({f: values[f] for f in base.weights}, values["intercept"])

    log = []
    for batch in range(rounds):
        prior = weights_table(spark, [(f, m[f], m[f], q[f]) for f in names], ("w", "m", "q"))
        drawn = P.model_from_table(P.thompson_weights(prior, f"{seed}r{batch}", std), base)
        users = P.greedy_linear(tables.users, tables.offers, drawn, tables.spec.offer_features)
        part = exposed.where((F.col("epoch") == 0) & (F.col("batch") == batch))
        rows = M.with_rewards(part, users, tables.offers, tables.spec.reward, "user_key")
        rows = stage(T.with_features(rows, base, ("r", "n", "loss", "regret")), "thompson")
        prior_q, prior_m = (np.array([v[f] for f in names]) for v in (q, m))
        flat = prior_m
        for _ in range(steps):
            s = B.linear_sums(rows, as_model(dict(zip(names, flat.tolist()))))
            flat = flat - (prior_q * (flat - prior_m) + s["log_gradient"]) / (len(names) * (prior_q + s["precision"]))
        w = dict(zip(names, flat.tolist()))
        s = B.linear_sums(rows, as_model(w), ("r", "loss", "regret"))
        m = w
        q = dict(zip(names, (prior_q + s["precision"]).tolist()))
        log.append((batch, _as_sums(s), dict(m), dict(q)))
    return log


def thompson_table(spark, log) -> DataFrame:
    """Posterior per round and feature, beside the metrics of the round."""
    rows = [
        (batch, f, m[f], q[f], sums["n_events"], sums["reward"], sums["loss"], sums["regret"])
        for batch, sums, m, q in log
        for f in m
    ]
    return spark.createDataFrame(
        rows,
        "batch bigint, feature string, m double, q double, n_events bigint, reward double, loss double, regret double",
    )
