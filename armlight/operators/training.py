"""Training as aggregations: one row of sums per step, whatever the data size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlight.functions.hashing import uniform
from armlight.functions.models import weights_table
from armlight.functions.vectors import assemble
from armlight.operators.backprop import linear_sums
from armlight.operators.numbering import number_rows
from armlight.operators.permutation import permuted

LEARNING_RATE = 1e-4
WEIGHT_DECAY = 1e-5
ADAM_EPSILON = 1e-8


def first_adam_step(weight, gradient, rate=LEARNING_RATE, decay=WEIGHT_DECAY):
    """First step of Adam from zero moments: bias correction leaves g / |g|.

    Works on numbers and on Columns.
    """
    g = gradient + decay * weight
    size = F.abs(g) if hasattr(g, "alias") else abs(g)
    return weight - rate * g / (size + ADAM_EPSILON)


def with_features(rows: DataFrame, model, keep=("r", "n")) -> DataFrame:
    """The features of a linear model as one array ``x`` beside the columns to keep."""
    return rows.select(assemble(model.features).alias("x"), *keep)


def _per_feature(spark, model, **columns) -> DataFrame:
    """Arrays with the intercept first as rows (feature, ...); as many as the model has features."""
    names = ["intercept", *model.features]
    return weights_table(spark, list(zip(names, *columns.values())), list(columns))


def gradient_step(rows: DataFrame, model, weights: DataFrame, rate=LEARNING_RATE) -> DataFrame:
    """Mean gradient per feature and the weight after one step."""
    sums = linear_sums(with_features(rows, model), model)
    grads = _per_feature(rows.sparkSession, model, gradient=sums["gradient"] / max(sums["n"], 1.0))
    return weights.join(grads, "feature").select(
        "feature", "gradient", first_adam_step(F.col("w"), F.col("gradient"), rate).alias("w_new")
    )


def posterior_precision(rows: DataFrame, model, weights: DataFrame) -> DataFrame:
    """Precision per feature after seeing the rows: ``q + sum(x^2 p (1-p))``."""
    sums = linear_sums(with_features(rows, model), model)
    added = _per_feature(rows.sparkSession, model, q_added=sums["precision"])
    return weights.join(added, "feature").select("feature", (F.col("q") + F.col("q_added")).alias("q_new"))


def posterior_objective(rows: DataFrame, model, weights: DataFrame) -> DataFrame:
    """Prior term ``0.5 sum(q (w-m)^2)`` and log loss of the rows, in one row."""
    gap = F.col("w") - F.col("m")
    prior = weights.agg(F.sum(F.lit(0.5) * F.col("q") * gap * gap).alias("prior_term"))
    loss = linear_sums(with_features(rows, model), model)["log_loss"]
    return prior.withColumn("data_term", F.lit(loss)).withColumn("objective", F.col("prior_term") + F.col("data_term"))


def holdout_flag(key, share: float = 0.10, seed=100):
    """True for a fixed share of the rows, chosen by a hash of the key."""
    return uniform(seed, key) < F.lit(share)


def shuffled_batches(rows: DataFrame, key: str, epochs: int, size: int = 126, seed=100) -> DataFrame:
    """Minibatch number of every row in every epoch, in a new order each epoch.

    Rows are numbered once; the place of a row in an epoch's order is computed from its number, so nothing is sorted or
    stored per epoch.
    """
    numbered = number_rows(rows.select(key), [key], "_row", start=0)
    n = numbered.count()
    places = replicate_epochs(numbered, epochs).withColumn("_place", permuted("_row", n, "epoch", seed))
    return places.select("epoch", key, F.expr(f"_place div {size}").alias("batch"))


def replicate_epochs(rows: DataFrame, epochs: int) -> DataFrame:
    """Every row once per epoch, numbered from 0."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(epochs - 1).cast("bigint"))))


