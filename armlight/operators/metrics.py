"""Reward, loss and regret per batch of a replay, and curves over the batches."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armlight.functions.models import reward
from armlight.operators.dimensions import HOT_ROWS, attach_dimension

BATCH_ROWS = 128
CURVE_BLOCK = 100_000


def exposures(pulls: DataFrame, keys=("batch",)) -> DataFrame:
    """Events per batch, user and explored offer.

    All metrics of an event depend on these alone. Combining first leaves one row
    where a user fills a whole batch, so the joins that follow see far fewer rows.
    """
    return pulls.groupBy(*keys, "user_key", "explored").agg(F.count(F.lit(1)).alias("n"))


def with_rewards(
    exposed: DataFrame,
    users: DataFrame,
    offers: DataFrame,
    net,
    row_id,
    pred: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds the pulled offer, its simulated probability, reward, loss and regrets.

    ``users`` brings features, ``best_offer``, ``best_score`` and ``optimum``.
    ``pred`` is the prediction that the loss compares with the reward; default is
    the score of the best offer. An event without a finite probability, prediction
    or optimum is unscored: its reward, loss and regrets are null.
    """
    rows = attach_dimension(exposed, users, "user_key", row_id, hot_rows=hot_rows)
    rows = rows.withColumn("offer_key", F.coalesce("explored", "best_offer"))
    return with_outcomes(attach_dimension(rows, offers, "offer_key", row_id, hot_rows=hot_rows), net, pred)


def with_outcomes(rows: DataFrame, net, pred: Column | None = None) -> DataFrame:
    """The last part of ``with_rewards``, for rows that have the features of their user and pulled offer."""
    rows = rows.select("*", net.score().alias("r_prob"), (F.col("best_score") if pred is None else pred).alias("pred"))
    # null, NaN and infinity all fail the comparison
    scored = "abs(r_prob) + abs(pred) + abs(optimum) < double('infinity')"
    rows = rows.withColumn("r", F.when(F.expr(scored), reward("r_prob")))
    return rows.withColumns(
        {
            "loss": F.expr("if(r is null, null, abs(r - pred))"),
            "regret": F.expr("if(r is null, null, greatest(optimum - r_prob, 0D))"),
            "regret_abs": F.expr("if(r is null, null, abs(optimum - r_prob))"),
            "regret_binary": F.expr("if(r is null, null, greatest(if(optimum >= 0.5D, 1D, 0D) - r, 0D))"),
        }
    )


def batch_sums(rows: DataFrame, metrics=("r", "loss", "regret"), keys=("batch",)) -> DataFrame:
    """Events, unscored events and metric sums per batch of exposure rows with weight ``n``; unscored ones add nothing."""
    names = {"r": "reward"}
    sums = [F.coalesce(F.sum(F.col("n") * F.col(m)), F.lit(0.0)).alias(names.get(m, m)) for m in metrics]
    unscored = F.sum(F.when(F.col("r").isNull(), F.col("n")).otherwise(0)).alias("n_unscored")
    return rows.groupBy(*keys).agg(F.sum("n").alias("n_events"), unscored, *sums)


def complete(batches: DataFrame, size: int = BATCH_ROWS) -> DataFrame:
    """Full batches only: the tail of an epoch is never logged."""
    return batches.where(F.col("n_events") == size)


def iteration_number(log: DataFrame, batches_per_epoch: Column) -> DataFrame:
    """1-based number over all epochs; batches are dense inside an epoch."""
    return log.withColumn(
        "iteration", (F.col("epoch") * batches_per_epoch + F.col("batch") + F.lit(1)).cast("bigint")
    )


def moving_average(
    log: DataFrame,
    metrics,
    order: str,
    partition: str = "policy",
    before: int = 100,
    block: int = CURVE_BLOCK,
) -> DataFrame:
    """Mean of a row and the ``before`` rows ahead of it (101 rows by default).

    ``order`` is a dense integer, so it is cut into blocks; the last ``before``
    rows of a block are copied to the next one. A long log is thus not sorted in
    one task.
    """
    if block < before:
        raise ValueError("a block must hold the whole frame")
    number = F.floor(F.col(order) / F.lit(block)).cast("bigint")
    last = (F.col(order) + F.lit(before)) / F.lit(block)
    spread = log.withColumn("_home", number).withColumn(
        "_block", F.explode(F.sequence(F.col("_home"), F.floor(last).cast("bigint")))
    )
    frame = Window.partitionBy(partition, "_block").orderBy(order).rowsBetween(-before, 0)
    averaged = spread.select(
        partition, order, "_home", "_block", *[F.avg(m).over(frame).alias(f"avg_{m}") for m in metrics]
    )
    return averaged.where(F.col("_home") == F.col("_block")).drop("_home", "_block")


def compare_policies(logs: dict, metrics) -> DataFrame:
    """Logs side by side: total and mean of each metric, one column per policy."""
    both = None
    for name, log in logs.items():
        named = log.select(F.lit(name).alias("policy"), *metrics)
        both = named if both is None else both.unionByName(named)
    long = both.select(
        "policy", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("c")
    ).select("policy", "c.metric", "c.v")
    return (
        long.groupBy("metric")
        .pivot("policy", list(logs))
        .agg(F.sum("v").alias("total"), F.avg("v").alias("mean"))
    )
