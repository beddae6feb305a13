"""Helpers of operators that run numpy over Arrow batches inside tasks."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 8 << 20
# what Spark hands to a Python worker at once; by default it is 10,000 rows, however long their texts are
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over batches of about ``BATCH_BYTES``, unless the session has a limit of its own.

    The limit is a setting of the session, since Spark reads it when the frame is run; no result depends on it.
    """
    if df.sparkSession.conf.get(_LIMIT, None) is None:
        df.sparkSession.conf.set(_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(batches, column: str, limit: int = SLICE_BYTES, rows: int | None = None):
    """Record batches cut so that ``column`` holds about ``limit`` bytes in each; a longer row is alone in its slice.

    ``rows`` also bounds the rows of a slice, for work that needs memory for each row, however short.
    """
    for batch in batches:
        sizes = np.zeros(len(batch), np.int64)
        if len(batch):
            sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and (held + size > limit or row - start == rows):
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < len(batch):
            yield batch.slice(start)


def list_array(values: np.ndarray, lengths) -> pa.Array:
    """An Arrow list column from all values in a row and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and the offset of each text in them; null counts as empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if not len(filled):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = filled.buffers()[2]
    content = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return content[offsets[0] : offsets[-1]], offsets - offsets[0]
