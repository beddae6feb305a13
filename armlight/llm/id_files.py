"""Token-id files with fixed-width bit packing.

An id takes as many bits as the largest id of the vocabulary needs. Documents are range-partitioned by id and each range
becomes one shard of blocks; a block holds whole documents, about ``BLOCK_IDS`` ids, or one longer document. Its row has
the packed payload, the number of ids before it in its shard, and the end of each document in it. Since all ids have one
width, the place of any id in a payload is a product: ``unpack`` starts at any id, and ``read_range`` reads only the
blocks that the offsets name. Shards are Parquet files written by Spark's committer, so a lost executor leaves no half
shard and any store that Spark writes to will do.
"""

import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armlight.llm.batches import list_array, map_batches, slices
from armlight.llm.pieces import PieceCache, encode_column

BLOCK_IDS = 1 << 16
END_ID = 2
SLICE = 4 << 20
CACHED_PIECES = 300_000  # of each of two generations
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
JOINED = 100  # words that are encoded as one text
_STEP = 1 << 15  # ids whose bits are spread at once, a multiple of eight


def id_bits(size: int) -> int:
    """Bits of an id of a vocabulary of ``size`` ids."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, lowest bit first."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    out = []
    for at in range(0, len(ids), _STEP):
        wide = np.ascontiguousarray(ids[at : at + _STEP], "<u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from number ``start`` on; only their bytes are touched."""
    data = np.frombuffer(payload, np.uint8)
    out = np.empty(count, "<u4")
    for at in range(0, count, _STEP):
        n = min(_STEP, count - at)
        first = (start + at) * bits
        spread = np.unpackbits(data[first >> 3 : (first + n * bits + 7) >> 3], bitorder="little")[first & 7 :][: n * bits]
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :bits] = spread.reshape(n, bits)
        out[at : at + n] = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    return out


class LibraryEncoder:
    """The tokenizers library over columns of texts, each distinct piece encoded once while it is cached.

    The usual byte-level pattern matches white space only at the start of a match, letters and digits apart, and a mark
    before a letter only as a contraction, so texts may be cut into ``pieces`` without changing their ids; tokenizers
    with another pattern get whole texts, unless ``by_pieces`` says that theirs splits alike. ``fold`` says that theirs
    drops white space and lowers letters. The file is read on the driver; workers get its content.
    """

    def __init__(self, vocabulary: str, by_pieces: bool | None = None, fold: bool = False):
        with open(vocabulary, encoding="utf-8") as file:
            self.content = file.read()
        given = json.loads(self.content)
        split = given.get("pre_tokenizer") or {}
        added = given.get("added_tokens") or []
        self.special = [t["content"].encode() for t in added]
        plain = self.by_pieces = (
            given.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space")
            and split.get("use_regex", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
        )
        if by_pieces is not None:
            self.by_pieces = by_pieces
        # the pieces that may be encoded together: no added token may match in them, and the ids must show their edges
        model = given["model"]
        self.suffix, self.fold = model.get("end_of_word_suffix"), fold
        apart = model["type"] == "BPE" and not any(re.fullmatch(f"[ {LETTERS}]+", t["content"]) for t in added)
        self.word = None
        if apart and (self.suffix if fold else plain and not self.suffix):
            self.word = re.compile(f"[{LETTERS}]+" if fold else f" [{LETTERS}]+")
        self.tokenizer, self.edges, self.cache = None, None, PieceCache(CACHED_PIECES)
        self.size = self._library().get_vocab_size()

    def __getstate__(self):
        return {**self.__dict__, "tokenizer": None, "edges": None, "cache": PieceCache(CACHED_PIECES)}

    def _library(self):
        if self.tokenizer is None:
            # a task has one core
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(self.content)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        return self.tokenizer

    def _one_by_one(self, pieces):
        found = self._library().encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _new(self, pieces):
        """Words of letters are encoded many as one text and told apart by the ids that begin or end a word."""
        words = [p for p in pieces if self.word.fullmatch(p)] if self.word else []
        if not words:
            return self._one_by_one(pieces)
        if self.edges is None:
            known = self._library().get_vocab()
            self.edges = np.zeros(1 + max(known.values()), bool)
            self.edges[[k for t, k in known.items() if (t.endswith(self.suffix) if self.fold else t.startswith("\u0120"))]] = True
        between = " " if self.fold else ""
        texts = [between.join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)]
        coded = self._library().encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), "<u4")
        cuts = np.flatnonzero(self.edges[ids])
        cuts = np.append(0, cuts + 1) if self.fold else np.append(cuts, len(ids))
        if len(cuts) != len(words) + 1 or cuts[0] or cuts[-1] != len(ids):
            return self._one_by_one(pieces)
        held, cuts = ids.tobytes(), (4 * cuts).tolist()
        found = {w: held[start:end] for w, start, end in zip(words, cuts, cuts[1:])}
        others = [p for p in pieces if p not in found]
        found.update(zip(others, self._one_by_one(others), strict=True))
        return [found[p] for p in pieces]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text."""
        return encode_column(column, self.cache, self._new, "<u4", self.special, whole=not self.by_pieces, fold=self.fold)


def _blocks(encoder, batches):
    """Blocks of one shard as record batches; the last columns index its documents."""
    bits = id_bits(max(encoder.size, END_ID + 1))
    shard, number, before = TaskContext.get().partitionId(), 0, 0
    for part in slices(batches, "text", SLICE):
        ids, sizes = encoder.encode(part["text"])
        ids = np.insert(ids, np.cumsum(sizes), END_ID)
        sizes = sizes + 1
        ends = np.cumsum(sizes)
        first = 0
        while first < len(part):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + BLOCK_IDS, side="right")))
            count = int(ends[last - 1] - done)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()),
                    pa.array([count], pa.int64()), pa.array([bits], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), part["doc_id"].slice(first, last - first)),
                    list_array(ends[first:last] - done, [last - first]),
                    pa.array([pack(ids[done : done + count], bits)], pa.binary()),
                ],
                ["shard", "block", "start", "n_ids", "bits", "doc_ids", "doc_ends", "payload"],
            )
            number, before, first = number + 1, before + count, last


def write_ids(docs: DataFrame, vocabulary: str, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes each whole text and writes the id files of ``docs`` to the folder ``path``.

    Documents stand in ascending order of ``doc_id``, a null id first and rows of one id by their text, null as empty:
    such rows are dealt over shards like any others. A null or empty text is the end id alone; an empty table gives an
    empty folder of the same schema. Other columns of ``docs`` don't matter, whatever their names.
    """
    encoder = docs.sparkSession.sparkContext.broadcast(LibraryEncoder(vocabulary))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.left("text", F.lit(32))).sortWithinPartitions("doc_id", "text")
    long = T.LongType()
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()), T.StructField("block", long), T.StructField("start", long),
            T.StructField("n_ids", long), T.StructField("bits", T.IntegerType()),
            T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)), T.StructField("doc_ends", T.ArrayType(long)),
            T.StructField("payload", T.BinaryType()),
        ]
    )
    map_batches(ordered, lambda batches: _blocks(encoder.value, batches), schema).write.parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, shard_start): ids of all shards before; one row per shard, read from two columns of the files."""
    sizes = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, start, n_tokens, ids) of every document; ``start`` counts within its shard.

    ``ids`` holds unsigned 32-bit little-endian numbers, the end id last.
    """
    blocks = spark.read.parquet(path).select("shard", "start", "bits", "doc_ids", "doc_ends", "payload")

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                shard, start, bits = (batch[c][row].as_py() for c in ("shard", "start", "bits"))
                ids, ends = batch["doc_ids"][row].values, batch["doc_ends"][row].values.to_numpy()
                flat = unpack(batch["payload"][row].as_buffer(), bits, 0, int(ends[-1])).view(np.uint8)
                offsets = np.append(0, ends)
                held = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets * 4), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.full(len(ends), shard, np.int32)), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), held.cast(pa.binary())],
                    ["doc_id", "shard", "start", "n_tokens", "ids"],
                )

    kind = blocks.schema["doc_ids"].dataType.elementType
    long = T.LongType()
    schema = T.StructType(
        [
            T.StructField("doc_id", kind), T.StructField("shard", T.IntegerType()), T.StructField("start", long),
            T.StructField("n_tokens", long), T.StructField("ids", T.BinaryType()),
        ]
    )
    return map_batches(blocks, run, schema)


def read_range(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """(position, ids) of ``count`` ids from position ``first`` of the whole sequence on, a row per block met.

    The offsets choose the blocks, and of a block only the bytes wanted are unpacked.
    """
    blocks = spark.read.parquet(path).join(shard_starts(spark, path), "shard")
    at = F.col("shard_start") + F.col("start")
    met = blocks.where((at < first + count) & (at + F.col("n_ids") > first)).select(
        F.greatest(at, F.lit(first)).alias("position"),
        F.greatest(F.lit(first) - at, F.lit(0)).alias("skip"),
        (F.least(at + F.col("n_ids"), F.lit(first + count)) - F.greatest(at, F.lit(first))).alias("n"),
        "bits", "payload",
    )

    def run(batches):
        for batch in batches:
            names = ("skip", "n", "bits")
            for row in range(len(batch)):
                skip, n, bits = (batch[c][row].as_py() for c in names)
                ids = unpack(batch["payload"][row].as_buffer(), bits, skip, n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["position"].slice(row, 1), list_array(ids, [n])], ["position", "ids"])

    return met.mapInArrow(run, "position bigint, ids array<int>")
