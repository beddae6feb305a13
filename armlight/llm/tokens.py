"""Token columns: encode and decode texts with the automaton of ``bpe``.

The compiled automaton has the size of the vocabulary, whatever the data, and is sent to each executor once. Its
caches live as long as the Python worker and are bounded.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from armlight.llm.batches import list_array, slices
from armlight.llm.bpe import Encoder


def shared_encoder(spark, vocabulary: str, **options):
    """A broadcast :class:`Encoder`; ``vocabulary`` is the path of a tokenizer file, read on the driver only."""
    return spark.sparkContext.broadcast(Encoder(vocabulary, **options))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", keep=("doc_id",)) -> DataFrame:
    """The ``keep`` columns and an array of token ids for each whole text of ``df``.

    Null and empty texts give an empty array; repeated rows give repeated results; an empty table gives an empty one.
    Columns of ``df`` that are not kept don't matter, whatever their names.
    """
    encoder = shared_encoder(df.sparkSession, vocabulary)

    def run(batches):
        for part in slices(batches, text):
            found = [encoder.value.encode(t) for t in part[text].to_pylist()]
            values = np.frombuffer(b"".join(found), "<u2").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part[k] for k in keep] + [list_array(values, [len(f) // 2 for f in found])], [*keep, ids]
            )

    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text that its arrays of ids spell; a null array spells the empty text."""
    encoder = shared_encoder(df.sparkSession, vocabulary)
    names = df.columns

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                texts = [encoder.value.decode(i.values.to_numpy()) if i.is_valid else "" for i in part[ids]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, decoded])

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField(decoded, T.StringType())]))
