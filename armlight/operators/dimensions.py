"""Dimension tables out of the fact, and the joins back to it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlight.operators.numbering import number_rows
from armlight.session import fits_broadcast

# rows of one key that a single join task may still receive
HOT_ROWS = 4_000_000


def distinct_dimension(fact: DataFrame, columns, position: str | None = None) -> DataFrame:
    """One row per distinct feature vector, with its first position in the fact.

    Grouping treats null as equal to null, NaN to NaN and -0.0 to 0.0. The
    aggregation is combined map-side, so a user with many events is one row per
    map task.
    """
    if position is None:
        return fact.select(*columns).distinct()
    return fact.groupBy(*columns).agg(F.min(position).alias("first_seen"))


def with_surrogate_key(dim: DataFrame, key: str, first_seen: str = "first_seen") -> DataFrame:
    """Dense zero-based key in first-seen order."""
    return number_rows(dim, [first_seen], key, start=0, drop=[first_seen])


def attach_dimension(
    fact: DataFrame,
    dim: DataFrame,
    on,
    row_id: str,
    null_safe: bool = False,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Inner join of a fact with a dimension that is unique on its keys.

    With ``null_safe`` the (many) key columns are compared by ``<=>``; the join
    itself runs on one hash of them. A dimension within the broadcast limit is
    broadcast. Beyond it the join is shuffled, and the rows of hot keys (more
    than ``hot_rows`` rows) are spread over several tasks by a hash of
    ``row_id``, against as many copies of the one dimension row. Hot keys are
    counted in ``counted`` where it is given: rows with the same key columns,
    each of the fact's among them, that cost less to read than the fact.
    """
    keys = [on] if isinstance(on, str) else list(on)
    payload = [c for c in dim.columns if c not in keys]
    hashed = null_safe or len(keys) > 1
    key = F.xxhash64(*keys) if hashed else F.col(keys[0])
    left = fact.withColumn("_key", key)
    right = dim.select(key.alias("_key"), *[F.col(k).alias(f"_dim_{k}") for k in keys if hashed], *payload)
    if fits_broadcast(right):
        joined = left.join(F.broadcast(right), "_key")
    else:
        # a key is hot only if it has more than hot_rows rows, so there are at
        # most (rows of the fact / hot_rows) of them: small enough to broadcast
        hot = (
            (left if counted is None else counted.withColumn("_key", key))
            .groupBy("_key")
            .agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > hot_rows)
            .select("_key", F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts"))
        )
        salts = F.coalesce("_salts", F.lit(1))
        spread = left.join(F.broadcast(hot), "_key", "left").withColumn(
            "_salt", F.pmod(F.xxhash64(row_id), salts).cast("int")
        )
        copies = right.join(F.broadcast(hot), "_key", "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
        )
        # without the hint Spark broadcasts by the size of files, or of a shuffle that is just below its limit
        joined = spread.drop("_salts").join(copies.drop("_salts").hint("merge"), ["_key", "_salt"])
    for k in keys if hashed else []:
        mine, theirs = F.col(k), F.col(f"_dim_{k}")
        joined = joined.where(mine.eqNullSafe(theirs) if null_safe else mine == theirs)
    return joined.select(*fact.columns, *payload)


def right_join_fill(side: DataFrame, base: DataFrame, keys) -> DataFrame:
    """Every row of ``base`` with the columns of ``side``; missing numbers are 0.

    Columns come as keys, side, base.
    """
    return side.join(base, list(keys), "right").na.fill(0)


def profile_counts(users: DataFrame, offers: DataFrame) -> DataFrame:
    """Row counts of both dimensions in one row."""
    return users.agg(F.count(F.lit(1)).alias("num_users")).withColumn(
        "num_offers", offers.agg(F.count(F.lit(1))).scalar()
    )
