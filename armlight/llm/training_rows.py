"""Bounded samples of labelled documents, for fitting classifiers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def sample(ids: DataFrame, bound: int, seed: str, key: str = "doc_id") -> DataFrame:
    """At most ``bound`` rows, those with the smallest hashes; the same rows however the input is partitioned."""
    return ids.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(bound)
