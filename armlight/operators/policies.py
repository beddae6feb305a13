"""Choice of an offer per user or event.

Linear and logistic scores have no user-offer terms: ``w.[o, u] + b`` is
``w_o.o + (w_u.u + b)``. The best offer is therefore the same for every user and
is found by one top-1 over the offers; no pairs are formed.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlight.functions.hashing import normal, uniform
from armlight.operators.pairing import best_offer_by_net, best_partner
from armlight.session import sized


def best_linear_offer(offers: DataFrame, model, offer_features, keep=()) -> DataFrame:
    """One row: the best offer and its share of the score; ties to the lowest key."""
    scored = offers.select("offer_key", model.part(offer_features).alias("offer_part"), *keep)
    return scored.orderBy(F.desc(F.nanvl("offer_part", F.lit(float("-inf")))), F.asc("offer_key")).limit(1)


def greedy_linear(users: DataFrame, offers: DataFrame, model, offer_features) -> DataFrame:
    """Adds ``best_offer`` and its score ``best_score`` to the users."""
    best = best_linear_offer(offers, model, offer_features).select(
        F.struct("offer_key", "offer_part").alias("best")
    )
    user_features = [f for f in model.features if f not in offer_features]
    z = F.col("_best.offer_part") + model.part(user_features, model.intercept)
    return users.withColumn("_best", best.scalar()).select(
        *users.columns, F.col("_best.offer_key").alias("best_offer"), model.activate(z).alias("best_score")
    )


def greedy_net(users: DataFrame, offers: DataFrame, net, offer_features) -> DataFrame:
    """As ``greedy_linear`` for a net, whose best offer differs by user."""
    best = best_offer_by_net(users, offers, net, offer_features, score_name="best_score")
    return sized(users).join(best.withColumnRenamed("offer_key", "best_offer"), "user_key")


def thompson_weights(policy: DataFrame, seed, std: str = "1/sqrt(q)") -> DataFrame:
    """One normal draw per row of a weights table; ``q`` is a precision.

    ``std="1/q"`` takes the inverse precision itself as the deviation.
    """
    spread = F.lit(1.0) / (F.col("q") if std == "1/q" else F.sqrt("q"))
    return policy.withColumn("w", F.col("m") + spread * normal(seed, "feature"))


def model_from_table(weights: DataFrame, model):
    """A model with the weights of a table; as many rows as there are features."""
    values = {r["feature"]: r["w"] for r in weights.select("feature", "w").collect()}
    intercept = values.pop("intercept", 0.0)
    return model.with_values({f: values[f] for f in model.weights}, intercept)


def greedy_proto(users: DataFrame, offers: DataFrame, actor, offer_features) -> DataFrame:
    """The actor turns user features into a proto-offer; the best offer is the
    one with the largest dot product."""
    protos = users.select("user_key", actor.output_vector().alias("_proto"))
    vectors = offers.select("offer_key", F.array(*offer_features).alias("_vector"))
    best = best_partner(protos, vectors, "user_key", "offer_key", "_proto", "_vector", score_name="proto_score")
    return sized(users).join(best.withColumnRenamed("offer_key", "best_offer"), "user_key")


def explore(events: DataFrame, offers, epsilon: float, seed, key=("seq",)) -> DataFrame:
    """Adds ``explored``: null keeps the best offer, else a uniform random offer key.

    The best offer is kept if the first uniform is above epsilon; the random
    offer may be the best one again. ``offers`` is the table or, on a stream, its
    row count.
    """
    count = F.lit(offers) if isinstance(offers, int) else offers.agg(F.count(F.lit(1)).alias("n")).scalar()
    arm = F.floor(uniform(f"{seed}arm", *key) * F.col("_offers")).cast("bigint")
    return (
        events.withColumn("_offers", count)
        .withColumn("explored", F.when(uniform(f"{seed}explore", *key) > F.lit(float(epsilon)), None).otherwise(arm))
        .drop("_offers")
    )
