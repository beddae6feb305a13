"""Column expressions shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed: the white space that the contracts delete or split on
WHITE = r"[ \t-\r]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it, lambdas included."""
    return F.transform(F.array(value), body)[0]


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def indexes(size: Column) -> Column:
    """0 to size - 1, also for size 0."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def at(array: Column, index: Column) -> Column:
    return F.get(array, index)
