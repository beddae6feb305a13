"""Learning logs: many policies replayed together, each learning from its own pulls.

The models of all policies are the rows of one matrix. A round reads its events once for all of them, scores every event
under the policy of its row, and returns the sums per policy and batch of 128 events together with one gradient per
policy. The sums are written where they arise; only the gradients, policies x features numbers, reach the driver.
Batches are whole inside a round, so a round's log has a row per batch as if the model had been replayed alone.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlight.functions.hashing import uniform
from armlight.operators import backprop as B
from armlight.operators import metrics as M
from armlight.operators import policies as P
from armlight.operators import training as T
from armlight.operators.dimensions import attach_dimension
from armlight.operators.numbering import in_batches
from armlight.plans.replay import SEED, Policy, ReplayTables, batches_per_epoch
from armlight.session import fresh_path, shuffle_width

SUMS = ("n_events", "n_unscored", "reward", "loss", "regret")
_GRADIENT = -1
_EXPOSED = "policy int, batch bigint, user_key bigint, explored bigint, n bigint, epoch bigint, round int"


def policy_exposures(tables: ReplayTables, policies: dict, rounds: int, epochs: int, size: int, seed=SEED) -> str:
    """Folder of events per (epoch, round, policy, batch, user, explored offer), from one scan of the replay.

    Policies share the random numbers of an event, so those with equal epsilon explore alike.
    """
    replay, offers = tables.replay, tables.offers
    spark = replay.sparkSession
    events = replay.select("seq", "user_key", in_batches("seq", size).alias("batch"))
    events = T.replicate_epochs(events, epochs)
    widest = max(p.epsilon for p in policies.values())
    if widest > 0:
        events = P.explore(events, offers, widest, seed, ("epoch", "seq")).withColumn("_u", uniform(f"{seed}explore", "epoch", "seq"))
    else:
        events = events.withColumns({"explored": F.lit(None).cast("bigint"), "_u": F.lit(1.0)})
    pulls = [
        F.struct(F.lit(k).alias("policy"), F.when(F.col("_u") <= F.lit(float(p.epsilon)), F.col("explored")).alias("explored"))
        if p.epsilon > 0
        else F.struct(F.lit(k).alias("policy"), F.lit(None).cast("bigint").alias("explored"))
        for k, p in enumerate(policies.values())
    ]
    count = replay.agg(F.ceil(F.count(F.lit(1)) / F.lit(size * rounds)).alias("k"))
    events = events.withColumn("per_round", count.scalar()).select(
        "epoch", F.floor(F.col("batch") / F.greatest("per_round", F.lit(1))).cast("int").alias("round"), "batch", "user_key", F.explode(F.array(*pulls)).alias("p")
    )
    exposed = M.exposures(events.select("epoch", "round", "batch", "user_key", "p.*"), ("epoch", "round", "policy", "batch"))
    path = fresh_path(spark, "policy-exposures")
    spread = F.pmod(F.xxhash64("user_key", "batch"), F.lit(shuffle_width(spark)))
    exposed.repartition("epoch", "round", spread).write.partitionBy("epoch", "round").parquet(path)
    return path


def best_linear_offers(offers: DataFrame, models: list, offer_features):
    """(offer key, share of the score) of the best offer under each model, from one aggregation over the offers."""
    parts = []
    for k, model in enumerate(models):
        score = F.nanvl(model.part(offer_features), F.lit(float("-inf")))
        parts.append(F.max(F.struct(F.coalesce(score, F.lit(float("-inf"))).alias("score"), (-F.col("offer_key")).alias("key"))).alias(f"m{k}"))
    best = offers.agg(*parts).first()
    return [(-b.key, b.score) if b is not None else (None, float("-inf")) for b in best]


def round_rows(exposed: DataFrame, tables: ReplayTables, models: list, best: list) -> DataFrame:
    """Exposures with x (features of the user and the pulled offer), the shared columns and the simulated probability."""
    spec = tables.spec
    features = models[0].features
    keys = F.array(*[F.lit(k).cast("bigint") for k, _ in best])
    rows = exposed.withColumn("offer_key", F.coalesce("explored", F.get(keys, F.col("policy"))))
    rows = attach_dimension(rows, tables.users.select("user_key", *spec.user_features, "optimum"), "user_key", "batch")
    rows = attach_dimension(rows, tables.offers.select("offer_key", *spec.offer_features), "offer_key", "batch")
    return rows.select("policy", "batch", "n", "optimum", spec.reward.score().alias("r_prob"), F.array(*features).alias("x"))


def policy_round(rows: DataFrame, models: list, best: list, policies: list, offer_features) -> DataFrame:
    """(policy, batch, sums): the ``SUMS`` of a batch, and as batch -1 the row count and the gradient of the policy."""
    features = models[0].features
    width = len(features)
    matrix = np.array([[m.intercept, *m.weights.values()] for m in models], float)
    of_user = np.array([f not in set(offer_features) for f in features])
    links = np.array([m.link == "logit" for m in models])
    best_part = np.array([part for _, part in best])
    on_pulled = np.array([p.loss_on == "pulled" for p in policies])

    def scores(z, policy):
        return np.where(links[policy], 1.0 / (1.0 + np.exp(-z)), z)

    def run(batches):
        sums, grads, counts = {}, np.zeros_like(matrix), np.zeros(len(matrix))
        for given in batches:
            step = max(1, B.CELLS // max(width, 1))
            for start in range(0, len(given), step):
                part = given.slice(start, step)
                x = B.matrix_of(part["x"], width)
                policy, batch = part["policy"].to_numpy(), part["batch"].to_numpy()
                n, optimum, prob = (part[c].to_numpy(zero_copy_only=False).astype(float) for c in ("n", "optimum", "r_prob"))
                w = matrix[policy]
                pulled = scores(np.einsum("ij,ij->i", x, w[:, 1:]) + w[:, 0], policy)
                top = scores(np.einsum("ij,ij->i", x[:, of_user], w[:, 1:][:, of_user]) + best_part[policy] + w[:, 0], policy)
                pred = np.where(on_pulled[policy], pulled, top)
                good = B.usable(x, prob + optimum + pred)
                r = (prob >= 0.5).astype(float)
                cells = np.stack([n, n * ~good, *(np.where(good, n * v, 0.0) for v in (r, np.abs(r - pred), np.maximum(optimum - prob, 0.0)))], axis=1)
                key = policy.astype(np.int64) << 48 | batch
                found, at = np.unique(key, return_inverse=True)
                added = np.zeros((len(found), len(SUMS)))
                np.add.at(added, at, cells)
                for k, row in zip(found.tolist(), added):
                    sums[k] = sums[k] + row if k in sums else row
                p = pulled[good]
                factor = 2 * n[good] * (p - r[good]) * np.where(links[policy[good]], p * (1 - p), 1.0)
                for k in range(len(matrix)):
                    mine = policy[good] == k
                    grads[k, 0] += factor[mine].sum()
                    grads[k, 1:] += factor[mine] @ x[good][mine]
                    counts[k] += n[good][mine].sum()
        keys = list(sums)
        out = [(k >> 48, k & (1 << 48) - 1, sums[k]) for k in keys]
        out += [(k, _GRADIENT, np.r_[counts[k], grads[k]]) for k in range(len(matrix)) if counts[k]]
        if out:
            who, what, values = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(who, pa.int32()), pa.array(what, pa.int64()), pa.array([v.tolist() for v in values], pa.list_(pa.float64()))],
                ["policy", "batch", "sums"],
            )

    return rows.mapInArrow(run, "policy int, batch bigint, sums array<double>")


def learn(tables: ReplayTables, policies: dict, rounds: int = 4, epochs: int = 4, size: int = M.BATCH_ROWS, seed=SEED, rate=T.LEARNING_RATE):
    """(log, models): the log of all policies and their models after the last round.

    ``policies`` maps names to linear or logistic policies. The log has policy, epoch, batch, iteration, n_events,
    n_unscored, reward, loss and regret of every complete batch. Loss is taken on the offer that ``loss_on`` names,
    gradients on the pulled one. Events without a finite feature or score are counted in n_unscored and add nothing else.
    A policy whose round has no scored event keeps its model.
    """
    if not all(p.model in ("linear", "logit") for p in policies.values()):
        raise ValueError("the learning log takes linear and logistic policies")
    spark, spec = tables.replay.sparkSession, tables.spec
    exposed = spark.read.schema(_EXPOSED).parquet(policy_exposures(tables, policies, rounds, epochs, size, seed))
    chosen, path = list(policies.values()), fresh_path(spark, "learning-log")
    models = [p.linear_model(spec) for p in chosen]
    for epoch in range(epochs):
        for number in range(rounds):
            best = best_linear_offers(tables.offers, models, spec.offer_features)
            part = exposed.where((F.col("epoch") == epoch) & (F.col("round") == number)).drop("epoch", "round")
            rows = round_rows(part, tables, models, best)
            here = f"{path}/epoch={epoch}/round={number}"
            policy_round(rows, models, best, chosen, spec.offer_features).write.parquet(here)
            models = _stepped(spark.read.schema("policy int, batch bigint, sums array<double>").parquet(here), models, rate)
    return learning_log(spark, path, list(policies), batches_per_epoch(tables, size), size), dict(zip(policies, models))


def _stepped(sums: DataFrame, models: list, rate: float) -> list:
    """The models after a step each; the gradients of the tasks are added per policy and place before they are collected."""
    places = sums.where(F.col("batch") == _GRADIENT).select("policy", F.posexplode("sums").alias("place", "v"))
    totals = [{} for _ in models]
    for policy, place, v in places.groupBy("policy", "place").agg(F.sum("v")).collect():
        totals[policy][place] = v
    out = []
    for model, found in zip(models, totals):
        if found:
            flat = np.array([model.intercept, *model.weights.values()])
            gradient = np.array([found[k + 1] for k in range(len(flat))]) / found[0]
            flat = T.first_adam_step(flat, gradient, rate).tolist()
            model = model.with_values(dict(zip(model.features, flat[1:])), flat[0])
        out.append(model)
    return out


def learning_log(spark, path: str, names: list, per_epoch, size: int) -> DataFrame:
    """The complete batches of all rounds, summed over tasks, with their iteration number."""
    schema = "policy int, batch bigint, sums array<double>, epoch bigint, round int"
    rows = spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("batch") >= 0)
    sums = [F.sum(F.col("sums")[k]).alias(c) for k, c in enumerate(SUMS)]
    log = rows.groupBy("policy", "epoch", "batch").agg(*sums)
    log = log.withColumns({c: F.col(c).cast("bigint") for c in SUMS[:2]})
    name = F.get(F.array(*map(F.lit, names)), F.col("policy"))
    return M.iteration_number(M.complete(log, size), per_epoch).select(name.alias("policy"), "epoch", "batch", "iteration", *SUMS)
