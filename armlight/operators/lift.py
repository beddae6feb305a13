"""Lift tables of scored rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armlight.operators.numbering import number_rows


def lift_bins(scored: DataFrame, bins: int, id_column: str, prob: str = "prob", target: str = "target") -> DataFrame:
    """``ntile(bins)`` over falling probability, and counts and lift per bin.

    Rows are ranked by a range sort, so neither the table nor a group of equal
    probabilities has to fit into one task. The first bins take the remainder.
    """
    ranked = number_rows(
        scored.select(id_column, prob, target), [F.desc(prob), F.asc(id_column)], "rank", total="_total"
    )
    size = F.floor(F.col("_total") / F.lit(bins))
    extra = F.col("_total") % F.lit(bins)
    large = extra * (size + 1)
    number = F.when(F.col("rank") <= large, F.ceil(F.col("rank") / (size + 1))).otherwise(
        extra + F.ceil((F.col("rank") - large) / size)
    )
    per_bin = ranked.groupBy(number.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(target).cast("bigint")).alias("positives"),
        F.min(prob).alias("min_prob"),
        F.max(prob).alias("max_prob"),
    )
    # from here on there are as many rows as bins
    every = Window.partitionBy()
    rate = F.col("positives") / F.col("n")
    overall = F.sum("positives").over(every) / F.sum("n").over(every)
    return per_bin.withColumn("rate", rate).withColumn("lift", F.try_divide(F.col("rate"), overall))


def cumulative_lift(bins: DataFrame) -> DataFrame:
    """Running counts, share of all positives (gain) and lift up to each bin."""
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    running = bins.select(
        "bin",
        F.sum("n").over(upto).alias("cum_n"),
        F.sum("positives").over(upto).alias("cum_positives"),
        F.sum("n").over(every).alias("_n"),
        F.sum("positives").over(every).alias("_positives"),
    )
    rate = F.col("cum_positives") / F.col("cum_n")
    return running.select(
        "bin",
        "cum_n",
        "cum_positives",
        F.try_divide(F.col("cum_positives"), F.col("_positives")).alias("gain"),
        F.try_divide(rate, F.col("_positives") / F.col("_n")).alias("cum_lift"),
    )


def compare_lift(with_side: DataFrame, without_side: DataFrame) -> DataFrame:
    """Two lift tables joined by bin."""

    def named(bins, suffix):
        return bins.select("bin", *[F.col(c).alias(f"{c}_{suffix}") for c in ("n", "positives", "rate", "lift")])

    return named(with_side, "with_side").join(named(without_side, "base"), "bin")


def squared_error(scored: DataFrame, group: str, prob: str = "prob", target: str = "target") -> DataFrame:
    """Mean squared error of the probability per group."""
    error = F.col(prob) - F.col(target)
    return scored.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(error * error).alias("mse"))
