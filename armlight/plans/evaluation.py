"""Reward model: fit, save, score, error, lift; with and without side features."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlight.functions.models import DenseNet, LinearModel
from armlight.functions.vectors import assemble
from armlight.operators import backprop as B
from armlight.operators.dimensions import right_join_fill
from armlight.operators.lift import compare_lift, lift_bins
from armlight.operators.numbering import number_rows
from armlight.operators.training import holdout_flag
from armlight.sources.files import stage
from armlight.sources.stores import has_commits, load_net, net_versions, save_net

KEYS = ["user_id", "offer_id", "redeem_date"]


def split_rows(rows: DataFrame, key: str, share: float = 0.10, seed=100) -> DataFrame:
    """Adds ``split``: "holdout" for a fixed hashed share, else "train"."""
    return rows.withColumn("split", F.when(holdout_flag(key, share, seed), "holdout").otherwise("train"))


def training_rows(rows: DataFrame, features, key: str = "event_id", target: str = "target"):
    """(rows with split, x and y, the same of the training split with a dense number, their count); both are written once."""
    data = rows.select(key, "split", assemble(features).alias("x"), F.col(target).cast("double").alias("y"))
    data = stage(data, "reward-rows")
    train = number_rows(data.where(F.col("split") == "train").drop("split"), [key], "number", start=0)
    return data, train, train.count()


def fit_reward_net(
    rows: DataFrame,
    net: DenseNet,
    path: str,
    epochs: int = 30,
    batches: int = 1,
    rate: float = B.LEARNING_RATE,
    seed: int = 100,
    save_every: int = 10,
    key: str = "event_id",
) -> DataFrame:
    """Trains ``net`` on the training split and returns the error per epoch and split.

    Adam keeps its moments over all steps; batches are shuffled anew in every epoch. The net and the moments are saved in
    ``path`` every ``save_every`` epochs and at the end, with the epoch as version; a fit that finds a version there goes
    on from it. Rows with a null, NaN or infinite value neither train nor count.
    """
    spark = rows.sparkSession
    data, train, n = training_rows(rows, net.features, key)
    train = stage(B.packed(train, len(net.features)), "packed-rows")
    optimizer, done = B.Adam(rate), 0
    if has_commits(spark, path):
        done = net_versions(spark, path).agg(F.max("version")).first()[0]
        net, optimizer = load_net(spark, path, done)
    curve, waiting = None, {}
    for epoch, net, optimizer in B.train(train, net, n, epochs, batches, seed, optimizer, done):
        if epoch % save_every == 0 or epoch == epochs:
            save_net(spark, net, path, epoch, optimizer)
        waiting[epoch] = net
        # all nets of a pass are scored together, so the rows are read once for many epochs
        if epoch == epochs or len(waiting) * B.flatten(net).nbytes >= B.MODEL_BYTES:
            part = stage(B.errors(data, waiting).withColumnRenamed("name", "epoch"), "reward-errors")
            curve, waiting = part if curve is None else curve.unionByName(part), {}
    return curve


def score_net(net: DenseNet, rows: DataFrame, keep) -> DataFrame:
    """Probabilities of a net beside the columns to keep."""
    return rows.select(*keep, net.score().alias("prob"))


def feature_set_eval(side: DataFrame, base: DataFrame, base_model, side_model: LinearModel, bins: int = 20) -> DataFrame:
    """Lift with the side features against lift without them.

    Rows without side features get zeros. Both scores are computed in one pass
    and written once, as each lift table reads them.
    """
    joined = right_join_fill(side, base, KEYS)
    scored = joined.select(
        "event_id", "target", base_model.score().alias("prob_base"), side_model.score().alias("prob_side")
    )
    scored = stage(scored, "feature-set")
    return compare_lift(
        lift_bins(scored, bins, "event_id", "prob_side"), lift_bins(scored, bins, "event_id", "prob_base")
    )
