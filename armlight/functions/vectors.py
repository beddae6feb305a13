"""Array columns as feature vectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def assemble(columns) -> Column:
    """Feature columns as one array<double>."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def context(offer_vector: str, user_vector: str) -> Column:
    """Offer features followed by user features."""
    return F.concat(F.col(offer_vector), F.col(user_vector))


def with_intercept(vector) -> Column:
    """The vector with a leading 1."""
    return F.concat(F.array(F.lit(1.0)), vector)


def insert_front(vector, value) -> Column:
    return F.array_insert(vector, 1, value)


def dot(left, right) -> Column:
    """Dot product of two arrays of one length."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def relu(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))
