"""Cutting tables down before they are shuffled or kept."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 23


def keep_repeated(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` another row has too: one shuffle, one sorted pass, a row held back."""

    def run(batches):
        held, same = None, False  # the row held back, and whether the one before it has its key
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            values = batch[key].to_numpy()
            equal = values[1:] == values[:-1]
            before = np.append(same, equal)
            yield batch.slice(0, len(batch) - 1).filter(pa.array(before[:-1] | equal))
            held, same = batch.slice(len(batch) - 1), bool(before[-1])
        if held is not None and same:
            yield held

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, rows.schema)


def rows_with(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``docs`` joined to ``ids`` on ``key``, most rows without a match dropped before the shuffle.

    The filter is a Bloom filter of ``FILTER_BITS`` (1 MB), whatever the data: with very many ids it lets more rows
    through to the join, which decides.
    """
    bits = [F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(FILTER_BITS)) for seed in (1, 2)]
    words = (
        ids.select(F.explode(F.array(*bits)).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))).alias("mask"))
    )
    table = np.zeros(FILTER_BITS >> 6, np.int64)
    for word, mask in words.collect():
        table[word] = mask
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = docs.columns

    def run(batches):
        for batch in batches:
            held = np.ones(len(batch), bool)
            for name in ("_bit1", "_bit2"):
                bit = batch[name].to_numpy()
                held &= (shared.value[bit >> 6] >> (bit & 63) & 1).astype(bool)
            yield batch.select(names).filter(pa.array(held))

    marked = docs.withColumns({"_bit1": bits[0], "_bit2": bits[1]})
    return marked.mapInArrow(run, docs.schema).join(ids, key)
