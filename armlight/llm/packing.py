"""Packing along a space-filling curve.

Each document's token counts are projected to ``DIMENSIONS`` numbers by hashed signs, squeezed into a grid and numbered
by the Hilbert curve. Documents are range-sorted by (curve position, id), so copies at one position are split like any
others, and each range is packed in that order: neighbours on the curve share sequences. A range is cut every ``SIZE``
tokens; what is left at its end is cut into powers of two, largest first, so nothing is padded.

The tokenised rows are written once, as ids of two bytes, since range-sorting reads its input twice.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armlight.llm.batches import map_batches, slices
from armlight.llm.id_files import LibraryEncoder
from armlight.sources.files import stage

SIZE = 2048
DIMENSIONS, BITS = 3, 12
SLICE = 2 << 20
END_ID = 1


def hilbert_positions(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of grid coordinates in [0, 2**bits).

    Skilling's transform: undo the rotations of each level from the top, then read the Gray code off the bits.
    """
    x = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for d, axis in enumerate(x):
            high = (axis & level) != 0
            swap = np.where(high, 0, (x[0] ^ axis) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            if d:
                x[d] = axis ^ swap
        level >>= 1
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where((x[-1] & level) != 0, turn ^ (level - 1), turn)
        level >>= 1
    position = np.zeros_like(turn)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            position = position << 1 | ((axis ^ turn) >> bit & 1)
    return position


def hashed_signs(size: int) -> np.ndarray:
    """A sign per dimension and token id."""
    mixed = np.arange(1, size * DIMENSIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(mixed >> np.uint64(63), 1.0, -1.0).astype(np.float32).reshape(DIMENSIONS, size)


def curve_keys(ids: np.ndarray, starts: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Curve position of each document, given all ids in a row and where each document, never empty, starts."""
    lengths = np.diff(np.append(starts, len(ids)))
    grid = []
    for row in signs:
        total = np.add.reduceat(row[ids], starts, dtype=np.float64) / np.sqrt(lengths)
        grid.append(np.minimum((1 << BITS) - 1, ((1 << BITS) / (1 + np.exp(-total / 2))).astype(np.int64)))
    return hilbert_positions(np.stack(grid, axis=1))


def tokenised(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, curve, doc_tokens and ids (binary, two bytes each, the end id last) of each document."""
    # the word vocabularies drop white space and match letters, digits and marks apart, so they may be cut into pieces
    encoder = docs.sparkSession.sparkContext.broadcast(LibraryEncoder(vocabulary, by_pieces=True, fold=True))

    def run(batches):
        signs = hashed_signs(1 << 16)
        for part in slices(batches, "text", SLICE):
            ids, sizes = encoder.value.encode(part["text"])
            ids = ids.astype("<u2")
            ids = np.insert(ids, np.cumsum(sizes), END_ID)
            lengths = sizes + 1
            ends = np.cumsum(lengths)
            keys = curve_keys(ids, ends - lengths, signs)
            offsets = np.append(0, 2 * ends)
            held = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(keys), pa.array(lengths), held], ["doc_id", "curve", "doc_tokens", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [T.StructField("curve", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    return map_batches(rows, run, T.StructType([rows.schema["doc_id"], *fields]))


def _pieces(rows, first_sequence: int):
    """(row, start, length, ids, sequence, offset) of the documents of one range, in order."""
    sequence, waiting, held = first_sequence, [], 0
    for row, ids in rows:
        start = 0
        while start < len(ids):
            length = min(len(ids) - start, SIZE - held)
            waiting.append((row, start, ids[start : start + length]))
            start, held = start + length, held + length
            if held == SIZE:
                offset = 0
                for r, s, piece in waiting:
                    yield r, s, piece, sequence, offset
                    offset += len(piece)
                sequence, waiting, held = sequence + 1, [], 0
    # the rest of fewer than SIZE ids, cut into powers of two
    room, offset = 0, 0
    for row, start, ids in waiting:
        while len(ids):
            if not room:
                room, offset = 1 << (held.bit_length() - 1), 0
                sequence += 1
            piece, ids = ids[:room], ids[room:]
            yield row, start, piece, sequence - 1, offset
            start, offset, room, held = start + len(piece), offset + len(piece), room - len(piece), held - len(piece)


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (array), ids_crc32, curve.

    Every id of every row of ``docs`` is in exactly one piece; pieces of a sequence are gapless from offset 0; each
    sequence holds ``SIZE`` ids or a power of two. Null and empty texts are the end id alone. Rows that repeat an id
    are packed each; a null id sorts first. An empty table has no pieces.
    """
    rows = stage(tokenised(docs, vocabulary, doc_id, text), "tokenised")
    ordered = rows.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "curve", "ids"]

    def run(batches):
        carried = {}  # row number -> (doc_id, tokens, curve) of rows whose pieces are not out yet

        def read():
            n = 0
            for batch in batches:
                for i, t, c, ids in zip(*(batch[k].to_pylist() for k in ("doc_id", "doc_tokens", "curve", "ids")), strict=True):
                    carried[n] = (i, t, c)
                    yield n, np.frombuffer(ids, "<u2").astype("<u4")
                    n += 1

        def batch_of(out):
            columns = list(zip(*out, strict=True))
            types = [id_type, *[pa.int64()] * 7]
            arrays = [pa.array(c, t) for c, t in zip(columns[:-1], types, strict=True)]
            sizes = np.cumsum([0, *map(len, columns[-1])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(columns[-1]).astype(np.int32)))
            return pa.RecordBatch.from_arrays([*arrays, ids], names)

        out, held = [], 0
        for row, start, piece, sequence, offset in _pieces(read(), TaskContext.get().partitionId() << 33):
            i, tokens, curve = carried[row]
            if start + len(piece) == tokens:
                del carried[row]
            out.append((i, start, len(piece), tokens, sequence, offset, zlib.crc32(piece.tobytes()), curve, piece))
            held += len(piece)
            if held > 1 << 20:
                yield batch_of(out)
                out, held = [], 0
        if out:
            yield batch_of(out)

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[dict(rows.dtypes)["doc_id"]]
    long = T.LongType()
    schema = T.StructType(
        [rows.schema["doc_id"], *(T.StructField(n, long) for n in names[1:-1]), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    return map_batches(ordered, run, schema)
