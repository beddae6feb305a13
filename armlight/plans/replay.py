"""Policy replay: dimensions, ordered events, policy choices, batch metrics."""

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armlight.functions.models import DenseNet, LinearModel
from armlight.operators import metrics as M
from armlight.operators import policies as P
from armlight.operators.dimensions import attach_dimension, distinct_dimension, with_surrogate_key
from armlight.operators.numbering import in_batches, number_rows
from armlight.operators.pairing import best_pair_value
from armlight.operators.training import replicate_epochs
from armlight.sources import interactions as I
from armlight.sources.files import stage

EPSILON = 0.1
SEED = 7


@dataclass(frozen=True)
class ReplaySpec:
    """Columns of an interaction table and the models of a replay.

    Any table with an id per user and offer, their feature columns and a position
    can be replayed; the defaults describe the tables at hand.
    """

    user_id: str = "user_id"
    offer_id: str = "offer_id"
    user_features: tuple = tuple(I.USER_FEATURES)
    offer_features: tuple = tuple(I.OFFER_FEATURES)
    position: str = "event_id"
    reward: DenseNet = field(default_factory=I.reward_net)
    linear: LinearModel = field(default_factory=I.policy_model)
    deep: DenseNet = field(default_factory=I.deep_policy_net)
    actor: DenseNet = field(default_factory=I.actor_net)
    critic: DenseNet = field(default_factory=I.critic_net)

    @property
    def user_columns(self):
        return [self.user_id, *self.user_features]

    @property
    def offer_columns(self):
        return [self.offer_id, *self.offer_features]


@dataclass(frozen=True)
class ReplayTables:
    """Tables a replay reads, written once to the shared folder.

    ``users`` holds, beside the features, ``optimum``: the best simulated
    probability over all offers, which no policy changes. ``replay`` holds the
    events in replay order (first-seen user, then log order) with dense ``seq``.
    """

    users: DataFrame
    offers: DataFrame
    replay: DataFrame
    spec: ReplaySpec


def user_dimension(facts: DataFrame, spec: ReplaySpec = ReplaySpec()) -> DataFrame:
    return with_surrogate_key(distinct_dimension(facts, spec.user_columns, spec.position), "user_key")


def offer_dimension(facts: DataFrame, spec: ReplaySpec = ReplaySpec()) -> DataFrame:
    return with_surrogate_key(distinct_dimension(facts, spec.offer_columns, spec.position), "offer_key")


def with_keys(facts: DataFrame, users: DataFrame, offers: DataFrame, spec: ReplaySpec = ReplaySpec()) -> DataFrame:
    """The fact with both surrogate keys, joined on the whole feature vectors."""
    users = users.select("user_key", *spec.user_columns)
    offers = offers.select("offer_key", *spec.offer_columns)
    keyed = attach_dimension(facts, users, spec.user_columns, spec.position, null_safe=True)
    return attach_dimension(keyed, offers, spec.offer_columns, spec.position, null_safe=True)


def in_replay_order(keyed: DataFrame, position: str = "event_id") -> DataFrame:
    """Dense 1-based ``seq``: events of the first-seen user first, each in log order."""
    return number_rows(keyed, ["user_key", position], "seq")


def build_tables(facts: DataFrame, spec: ReplaySpec = ReplaySpec()) -> ReplayTables:
    # both dimensions and the keys read the facts, so their joins are run once
    facts = stage(facts.select(*dict.fromkeys([spec.position, *spec.user_columns, *spec.offer_columns])), "facts")
    offers = offer_dimension(facts, spec)
    users = best_pair_value(
        user_dimension(facts, spec), offers, ["user_key", *spec.user_columns], spec.reward, spec.offer_features, "optimum"
    )
    users = stage(users, "users")
    # the range sort reads its input twice, so it gets the narrow keys and not the wide facts
    keyed = stage(with_keys(facts, users, offers, spec).select(spec.position, "user_key", "offer_key"), "keyed")
    return ReplayTables(users, offers, in_replay_order(keyed, spec.position), spec)


_TABLES: dict = {}


def replay_tables(spark: SparkSession, sf_dir: str) -> ReplayTables:
    """The replay tables of a data folder, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = build_tables(I.interactions(spark, sf_dir))
    return _TABLES[key]


@dataclass(frozen=True)
class Policy:
    """A scoring model and a way to choose.

    ``model``: "linear", "logit", "deep" or "proto". ``epsilon`` > 0 explores.
    ``weights`` replaces the weights of a linear or logistic model. ``loss_on``
    tells which prediction the loss takes: that of the best offer, also where
    another one was pulled, or that of the "pulled" one.
    """

    model: str = "logit"
    epsilon: float = 0.0
    weights: object = None
    loss_on: str = "best"

    def linear_model(self, spec: ReplaySpec) -> LinearModel:
        return self.weights or replace(spec.linear, link="linear" if self.model == "linear" else "logit")


def decide(tables: ReplayTables, policy: Policy) -> DataFrame:
    """Users with ``best_offer`` and the prediction of the policy for it.

    Net policies differ by user; their choices are written once, as the metrics
    and the offer lookup both read them.
    """
    spec, users, offers = tables.spec, tables.users, tables.offers
    if policy.model in ("linear", "logit"):
        return P.greedy_linear(users, offers, policy.linear_model(spec), spec.offer_features)
    if policy.model == "deep":
        return stage(P.greedy_net(users, offers, spec.deep, spec.offer_features), "choices")
    if policy.model == "proto":
        chosen = P.greedy_proto(users, offers, spec.actor, spec.offer_features)
        return stage(chosen.withColumn("best_score", F.lit(None).cast("double")), "choices")
    raise ValueError(f"unknown policy model {policy.model!r}")


def prediction(tables: ReplayTables, policy: Policy) -> Column:
    """What the loss compares with the reward: a score of the policy, or the critic's value."""
    if policy.model == "proto":
        return tables.spec.critic.score()
    if policy.loss_on == "pulled":
        return tables.spec.deep.score() if policy.model == "deep" else policy.linear_model(tables.spec).score()
    return F.col("best_score")


def pulls(tables: ReplayTables, policy: Policy, size: int = M.BATCH_ROWS, epochs: int = 1, seed=SEED) -> DataFrame:
    """Events with epoch, batch and the explored offer (null: the best one)."""
    events = tables.replay.select("seq", "user_key", in_batches("seq", size).alias("batch"))
    events = replicate_epochs(events, epochs)
    if policy.epsilon > 0:
        return P.explore(events, tables.offers, policy.epsilon, seed, ("epoch", "seq"))
    return events.withColumn("explored", F.lit(None).cast("bigint"))


def reward_rows(
    tables: ReplayTables, policy: Policy, size: int = M.BATCH_ROWS, epochs: int = 1, seed=SEED
) -> DataFrame:
    """One row per epoch, batch, user and explored offer, with all its metrics."""
    exposed = M.exposures(pulls(tables, policy, size, epochs, seed), ("epoch", "batch"))
    return M.with_rewards(
        exposed, decide(tables, policy), tables.offers, tables.spec.reward, "batch", prediction(tables, policy)
    )


def policy_metrics(
    tables: ReplayTables,
    policy: Policy,
    size: int = M.BATCH_ROWS,
    epochs: int = 1,
    metrics=("r", "loss", "regret"),
    seed=SEED,
) -> DataFrame:
    """Reward, loss and regret per complete batch.

    A policy that does not explore repeats itself in every epoch, so only its
    finished batches are replicated.
    """
    own = epochs if policy.epsilon > 0 else 1
    sums = M.batch_sums(reward_rows(tables, policy, size, own, seed), metrics, ("epoch", "batch"))
    batches = M.complete(sums, size)
    if own == epochs:
        return batches
    columns = batches.columns
    return replicate_epochs(batches.drop("epoch"), epochs).select(*columns)


def batches_per_epoch(tables: ReplayTables, size: int = M.BATCH_ROWS) -> Column:
    """Number of complete batches, as a scalar subquery."""
    count = tables.replay.agg(F.floor(F.count(F.lit(1)) / F.lit(size)).cast("bigint").alias("k"))
    return count.scalar()


def metric_log(tables: ReplayTables, name: str, policy: Policy, epochs: int = 4) -> DataFrame:
    """The log of a policy over several epochs with its iteration number."""
    log = policy_metrics(tables, policy, epochs=epochs)
    return M.iteration_number(log, batches_per_epoch(tables)).select(
        F.lit(name).alias("policy"), "epoch", "batch", "iteration", "reward", "loss", "regret"
    )
