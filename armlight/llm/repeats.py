"""Removal of repeated byte strings of at least ``LENGTH`` bytes, by induced sorting of what may repeat.

1. Every window of ``LENGTH`` bytes is assigned the ``SAMPLE``-byte string in it with the smallest hash, the leftmost of
   equal ones. Equal windows have equal samples at equal places. Neighbouring windows with one sample form a run.
2. The runs, 32 bytes each whatever their length, are sorted by sample and bytes (Spark's external sort). Runs whose
   sample occurs once hold no repeat. Of runs with equal bytes, all but the first are covered whole.
3. Where a sample has runs of different bytes, the first run of each kind is read as a fragment. A window's first
   occurrence is always in such a run, so nothing is lost. The fragments are sorted externally by sample, and the order
   of the strings that start left of the sample is induced from that at the sample, with common-prefix values
   (``induction.py``). Neighbours with ``LENGTH`` common bytes are equal windows.

A sample with more than ``GROUP`` different runs is not held in one task: its windows are compared one by one by two
64-bit hashes, counted map-side. Whole runs are compared by two 64-bit hashes too, windows in fragments byte by byte.
Suffixes outside fragments are never sorted, so no tuple per byte of the corpus is written.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armlight.llm.batches import slices, utf8
from armlight.llm.columns import whole_text
from armlight.llm.induction import LENGTH, SAMPLE, covered_windows
from armlight.llm.narrowing import rows_with
from armlight.llm.scratch import Scratch
from armlight.llm.terms import _BASE, _BYTE_VALUES, _INVERSE, _powers, mix
from armlight.operators.numbering import number_rows
from armlight.sources.files import stage

SLICE = 2 << 20
# a place is (start * PLACES + number of windows of the run) * PLACES + bytes before its sample
PLACES = 128
GROUP = 4_096
# fragments sorted at a time
BLOCK = 1 << 15
_NO_ID = -(1 << 63)


class _Hashes:
    """Hashes of any substring of a byte array."""

    def __init__(self, content):
        self.running = np.zeros(len(content) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[content] * _powers(_BASE, len(content)), out=self.running[1:])
        self.back = _powers(_INVERSE, len(content) + 1)

    def of(self, start, length):
        return mix((self.running[start + length] - self.running[start]) * self.back[start] + np.uint64(31))


def sampled_runs(content: np.ndarray, offsets: np.ndarray):
    """(sample, bytes, text number, start in all bytes, windows, bytes before the sample) of each run."""
    windows = len(content) - LENGTH + 1
    if windows < 1:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    hashes = _Hashes(content)
    low = np.uint64(0xFFFFFFFF)
    least = hashes.of(np.arange(len(content) - SAMPLE + 1), SAMPLE) & ~low | np.arange(len(content) - SAMPLE + 1, dtype=np.uint64)
    width, wanted = 1, LENGTH - SAMPLE + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(owner[:windows] == owner[LENGTH - 1 :])
    if not len(at):
        return sampled_runs(content[:0], offsets[:1])
    place = (least[at] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    return hashes.of(place[first], SAMPLE), hashes.of(start, count + LENGTH - 1), owner[start], start, count, place[first] - start


def _runs(docs: DataFrame) -> DataFrame:
    def run(batches):
        for part in slices(batches, "text", SLICE):
            content, offsets = utf8(part["text"])
            sample, whole, owner, start, count, lead = sampled_runs(content, offsets)
            place = ((start - offsets[owner]) * PLACES + count) * PLACES + lead
            ids = part["id"].to_numpy()[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sample.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids), pa.array(place)],
                ["sample", "whole", "id", "place"],
            )

    return docs.mapInArrow(run, "sample bigint, whole bigint, id bigint, place bigint")


def _sorted_runs(runs: DataFrame) -> DataFrame:
    """The runs whose sample another run has too; ``first`` marks the first run of each kind of bytes, of which
    repeated rows give one only."""

    def run(batches):
        # the row held back; whether the one before has its sample, whether it is a first, whether it repeats one
        held, same, new, double = None, False, True, False
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            sample, whole = batch["sample"].to_numpy(), batch["whole"].to_numpy()
            equal = sample[1:] == sample[:-1]
            before = np.append(same, equal)
            ids, place = batch["id"].to_numpy(), batch["place"].to_numpy()
            fresh = ~equal | (whole[1:] != whole[:-1])
            moved = fresh | (ids[1:] != ids[:-1]) | (place[1:] != place[:-1])
            # a row at the place of the one before is as much a first as that one
            changes = np.maximum.accumulate(np.where(np.append(True, moved), np.arange(len(batch)), 0))
            first = np.append(new, fresh)[changes]
            doubles = np.append(double, ~moved & first[1:])
            kept = pa.array((before[:-1] | equal) & ~doubles[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], [*batch.schema.names, "first"]).slice(0, len(batch) - 1).filter(kept)
            held, same, new, double = batch.slice(len(batch) - 1), bool(before[-1]), bool(first[-1]), bool(doubles[-1])
        if held is not None and same and not double:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([new])], [*held.schema.names, "first"])

    ordered = runs.repartition("sample").sortWithinPartitions("sample", "whole", "id", "place")
    return ordered.mapInArrow(run, T.StructType([*runs.schema, T.StructField("first", T.BooleanType())]))


def _fragments(runs_of: DataFrame) -> DataFrame:
    """(sample, hot, id, start, lead, piece) of the listed runs of each text."""

    def run(batches):
        for part in slices(batches, "text", SLICE):
            for i, text, runs in zip(part["id"].to_pylist(), part["text"].to_pylist(), part["runs"], strict=True):
                body = text.encode()
                place = runs.values.field("place").to_numpy()
                start, count = place // (PLACES * PLACES), place // PLACES % PLACES
                pieces = [body[a:b] for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [runs.values.field("sample"), runs.values.field("hot"), pa.array(np.full(len(place), i, np.int64)),
                     pa.array(start), pa.array(place % PLACES), pa.array(pieces, pa.binary())],
                    ["sample", "hot", "id", "start", "lead", "piece"],
                )

    return runs_of.mapInArrow(run, "sample bigint, hot boolean, id bigint, start bigint, lead bigint, piece binary")


def _pieces(column: pa.Array):
    data = column.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _induced(fragments: DataFrame) -> DataFrame:
    """(id, start, end) of the covered windows of fragments, neighbouring ones joined."""

    def spans(block):
        sample = block["sample"].to_numpy()
        group = np.cumsum(np.append(False, sample[1:] != sample[:-1]))
        ids, start, lead = (block[k].to_numpy() for k in ("id", "start", "lead"))
        which, window = covered_windows(group, ids, start, lead, *_pieces(block["piece"]))
        order = np.lexsort((window, which))
        which, window = which[order], window[order]
        new = np.append(True, (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1))[: len(which)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(which))[: len(first)] - 1
        at = start[which[first]]
        columns = ids[which[first]], at + window[first], at + window[last] + LENGTH
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "start", "end"])

    def run(batches):
        held = []
        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= BLOCK:
                block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                sample = block["sample"].to_numpy()
                cut = int(np.searchsorted(sample, sample[-1]))  # the last sample's fragments may go on
                if cut:
                    yield spans(block.slice(0, cut))
                held = [block.slice(cut)]
        if held:
            yield spans(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    ordered = fragments.repartition("sample").sortWithinPartitions("sample")
    return ordered.mapInArrow(run, "id bigint, start bigint, end bigint")


def _compared(fragments: DataFrame) -> DataFrame:
    """(id, start, end) of the covered windows of fragments, each window by itself."""

    def run(batches):
        for part in slices(batches, "piece", SLICE >> 3):
            content, offsets = _pieces(part["piece"])
            count = np.diff(offsets) - LENGTH + 1
            ends = np.cumsum(count)
            within = np.arange(ends[-1]) - np.repeat(ends - count, count)
            window = _Hashes(content).of(np.repeat(offsets[:-1], count) + within, LENGTH)
            sample, ids, start = (np.repeat(part[k].to_numpy(), count) for k in ("sample", "id", "start"))
            columns = sample, window.view(np.int64), ids, start + within
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sample", "window", "id", "start"])

    windows = fragments.mapInArrow(run, "sample bigint, window bigint, id bigint, start bigint")
    again = windows.groupBy("sample", "window").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    single = windows.join(again.where("n > 1"), ["sample", "window"]).where(F.struct("id", "start") != F.col("first"))
    return single.select("id", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(id, spans) of the texts with covered bytes, for ``docs`` of id and text; the (start, end) may overlap."""
    scratch = Scratch(docs.sparkSession)
    runs = scratch.keep(_sorted_runs(_runs(docs)), "repeat-runs")
    start, count = F.floor(F.col("place") / (PLACES * PLACES)), F.floor(F.col("place") / PLACES) % PLACES
    whole = runs.where(~F.col("first")).select("id", start.alias("start"), (start + count + (LENGTH - 1)).alias("end"))
    firsts = runs.where("first")
    mixed = scratch.keep(firsts.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeat-mixed")
    listed = scratch.keep(
        firsts.join(mixed, "sample").groupBy("id")
        .agg(F.collect_list(F.struct("sample", "place", (F.col("n") > group).alias("hot"))).alias("runs")),
        "repeat-listed",
    )
    fragments = scratch.keep(_fragments(rows_with(docs, listed, "id").select("id", "text", "runs")), "repeat-fragments")
    scratch.drop(mixed, listed)
    single = _induced(fragments.where("not hot")).union(_compared(fragments.where("hot")))
    spans = whole.union(single).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    spans = scratch.keep(spans, "repeat-spans")
    scratch.drop(runs, fragments)
    return spans


def _row_keys(narrow: DataFrame) -> DataFrame:
    """(doc_id, id, text): whole ids as they are, as long as no id has several texts; else numbers in the order of ids
    and, within one id, of the texts' hashes."""
    kind = narrow.schema["doc_id"].dataType.typeName()
    marked = narrow.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.octet_length("text").alias("size"))
    if kind in ("byte", "short", "integer", "long"):
        several = marked.groupBy("doc_id").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low <> high")
        if several.isEmpty():
            return narrow.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("id"), "text")
    order = ["doc_id", "mark", "size"]
    numbers = number_rows(marked.select(*order).distinct(), order, "id", start=0).select("id", *[F.col(c).alias(f"_{c}") for c in order])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("mark") == F.col("_mark")) & (F.col("size") == F.col("_size"))
    return stage(marked.join(numbers, same).select("doc_id", "id", "text"), "repeat-rows")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary).

    A byte goes if a string of ``LENGTH`` bytes around it also starts earlier: in a smaller doc_id, or further up in the
    same document. Null and empty texts have no bytes; a null id comes before all others, an id may be of
    any type that sorts, and several texts of one id come in the order of their hashes; rows that repeat an id and a text
    stand at the same places, so none of them is a repeat of the other. Other columns don't matter.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    keyed = _row_keys(narrow)
    spans = repeated_spans(keyed.select("id", "text"))

    def run(batches):
        for part in slices(batches, "text", SLICE):
            sizes, removed, runs, kept = [], [], [], []
            for body, spans_of in zip(part["text"].to_pylist(), part["spans"], strict=True):
                body = body.encode()
                begins, stops = [], []
                if spans_of.is_valid:
                    start, end = (spans_of.values.field(k).to_numpy() for k in ("start", "end"))
                    reach = np.maximum.accumulate(end)
                    new = np.append(True, start[1:] > reach[:-1])
                    begins, stops = start[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)].tolist()
                kept.append(b"".join(body[a:b] for a, b in zip([0, *stops], [*begins, len(body)], strict=True)))
                sizes.append(len(body))
                removed.append(len(body) - len(kept[-1]))
                runs.append(len(begins))
            numbers = [pa.array(c, pa.int64()) for c in (sizes, removed, runs)]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], *numbers, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    numbers = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([keyed.schema["doc_id"], *numbers, T.StructField("kept", T.BinaryType())])
    return keyed.join(spans, "id", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
