"""N-gram Jaccard join: documents whose sets of word shingles have a similarity of at least 0.8.

Shingles are hashed into ``GROUPS`` groups; the counts of a document per group are its point. Two documents share at
most the sum of the smaller counts, and a node of an R-tree over points shares at most that with the node's upper
corner, so whole subtrees are skipped. Surviving pairs are verified on the sets of their whole texts.

So that a tree never covers the corpus, documents are first brought together by prefix: of the sets, in one order for
all documents, two documents this similar share one of the first ``n - ceil(0.8 n) + 1`` shingles. The order is rarest
first, by a count sketch of all shingles of all documents (``CELLS`` counters whatever the data), then by hash. What the
sketch mixes up costs time only: the result is the same in any order. Documents of equal sets stand for one another.
Only shingles in more than one prefix form blocks, and two members of a block meet only if what follows the shingle in
both sets leaves room for enough shared ones. Then, exactly:

1. Each member of a block is paired with the block's smallest or largest id (by the shingle's parity): linear in the
   block, and enough to connect copies. Pairs that the points allow are verified, each document's best pair first and
   the others only where labels still differ. Links give labels.
2. Blocks that still hold different labels get R-trees, in cells of at most ``2 * CELL`` members: a larger block is dealt
   into parts, and each two parts meet in one cell. Cells that fit one leaf are compared together. Pairs of one label
   are skipped, since no link between them changes a component; all others are tested, so no link between components
   is lost.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armlight.llm.batches import list_array, map_batches, slices, utf8
from armlight.llm.components import smallest_labels
from armlight.llm.narrowing import keep_repeated, rows_with
from armlight.llm.scratch import Scratch
from armlight.llm.terms import mix, word_hashes

WORDS = 5
# fixed: two documents link when 100 * shared >= 80 * union
SHARE, WHOLE = 80, 100
GROUPS = 256
CELL, LEAF = 1_500, 64
# pairs of leaves whose points are compared at once
PAIRS = 4_096
SLICE = 2 << 20
# texts whose points are counted at once: each takes some 4 kB on the way, however short
ROWS = 4_096
CELLS, SKETCH_PARTS = 1 << 20, 64
# a cell of the sketch is hot above this count and four times the mean: its shingles are not looked up by one task
HOT = 100_000
# members that are verified against one copy of their center's text
FAN = 500


def _occurrences(content: np.ndarray, offsets: np.ndarray):
    """(shingle hash, text number) of the shingles of each text, repeated ones too, in order."""
    n = len(offsets) - 1
    words, text = word_hashes(content, offsets)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    place = np.arange(len(words)) - first[text]
    # a short text is hashed with all its words, a long one from each word that four more follow
    begins = np.flatnonzero((place == 0) | (place <= count[text] - WORDS))
    length = np.minimum(count[text[begins]], WORDS)
    padded = np.append(words, np.zeros(WORDS, np.uint64))
    found = length.astype(np.uint64)
    for k in range(WORDS):
        found = mix(found * np.uint64(0x9E3779B97F4A7C15) + np.where(k < length, padded[begins + k], np.uint64(0)))
    return found, text[begins]


def shingle_sets(content: np.ndarray, offsets: np.ndarray):
    """(shingle hash, text number) of the distinct shingles, sorted by text and hash.

    A text of fewer than five words is one shingle, one without words has none.
    """
    found, owner = _occurrences(content, offsets)
    if not len(found):
        return found, owner
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], owner[new]


def least_shared(total):
    """Smallest number of shared shingles of two linked sets whose sizes add up to ``total``."""
    return -(-SHARE * total // (SHARE + WHOLE))


def sketch(rows: DataFrame) -> np.ndarray:
    """Counts of all shingles of all texts in ``CELLS`` cells, summed per task and then per part of the table."""

    def count(batches):
        table = np.zeros(CELLS, np.int64)
        for part in slices(batches, "text", SLICE):
            found, _ = _occurrences(*utf8(part["text"]))
            table += np.bincount((found >> np.uint64(44)).astype(np.int64), minlength=CELLS)
        pieces = [p.astype("<u4").tobytes() for p in np.split(np.minimum(table, 0xFFFFFFFF), SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH_PARTS)), pa.array(pieces, pa.binary())], ["part", "counts"])

    def add(batches):
        sums = {}
        for batch in batches:
            for part, counts in zip(batch["part"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "counts"]
        )

    schema = "part bigint, counts binary"
    table = np.zeros((SKETCH_PARTS, CELLS // SKETCH_PARTS), np.int64)
    counted = map_batches(rows.select("text"), count, schema)
    for part, counts in map_batches(counted.repartition("part"), add, schema).collect():
        table[part] = np.frombuffer(counts, np.int64)
    return table.ravel()


def _signatures(rows: DataFrame) -> DataFrame:
    """(id, size, one, two, point, prefix, cold) of every row: set size, two hashes of the set, counts per group as bytes
    with 255 standing for any more, the prefix rarest first, and how many of it are not in hot cells."""
    counts = sketch(rows)
    classes = np.floor(2 * np.log2(counts + 1)).astype(np.uint8)
    hot = counts > max(HOT, 4 * counts.mean())
    shared = rows.sparkSession.sparkContext.broadcast((classes, hot))

    def run(batches):
        classes, hot = shared.value
        for part in slices(batches, "text", SLICE, ROWS):
            found, owner = shingle_sets(*utf8(part["text"]))
            n = len(part)
            size = np.bincount(owner, minlength=n)
            first = np.cumsum(size) - size
            cell = owner * GROUPS + (found % np.uint64(GROUPS)).astype(np.int64)
            point = np.minimum(np.bincount(cell, minlength=n * GROUPS), 255).astype(np.uint8).reshape(n, GROUPS)
            sums = []
            for seed in (1, 2):
                running = np.append(np.uint64(0), np.cumsum(mix(found + np.uint64(seed)), dtype=np.uint64))
                sums.append((running[first + size] - running[first]).view(np.int64))
            at = (found >> np.uint64(44)).astype(np.int64)
            # found is sorted by text and hash, so a stable sort by text and class is rarest first, then by hash
            order = np.argsort(owner * 256 + classes[at], kind="stable")
            place = np.arange(len(found)) - first[owner]
            order = order[place <= size[owner] - -(-SHARE * size[owner] // WHOLE)]
            cold = np.bincount(owner[order], ~hot[at[order]], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"], pa.array(size), pa.array(sums[0]), pa.array(sums[1]),
                    pa.array([p.tobytes() for p in point], pa.binary()),
                    list_array(found[order].view(np.int64), np.bincount(owner[order], minlength=n)), pa.array(cold),
                ],
                ["id", "size", "one", "two", "point", "prefix", "cold"],
            )

    return map_batches(
        rows, run, "id bigint, size bigint, one bigint, two bigint, point binary, prefix array<bigint>, cold bigint"
    )


def _meets(size_a, place_a, size_b, place_b):
    """Whether sets that have their first common shingle at these places may link."""
    room = F.least(size_a - place_a, size_b - place_b)
    return (SHARE + WHOLE) * room >= SHARE * (size_a + size_b)


def _points(cells) -> np.ndarray:
    points = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, GROUPS)
    # a count that was cut off bounds nothing
    return np.where(points == 255, np.uint16(65535), points) if len(points) and points.max() == 255 else points


def bounded(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b, n) that may link by the bound of their points."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            total = batch["size_a"].to_numpy() + batch["size_b"].to_numpy()
            a, b = (_points(batch[c].to_pylist()) for c in ("point_a", "point_b"))
            yield batch.select(["a", "b", "n"]).filter(pa.array(np.minimum(a, b).sum(1, dtype=np.int64) >= least_shared(total)))

    a = signatures.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("point").alias("point_a"))
    b = signatures.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("point").alias("point_b"))
    return map_batches(pairs.join(a, "a").join(b, "b"), run, "a bigint, b bigint, n bigint")


def verified(pairs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The (a, b) of ``pairs`` that link, by the sets of their texts.

    Each b's text meets its a's in a task that holds one a at a time; of an a with more than ``FAN`` pairs there are
    several copies.
    """
    fan = F.ceil(F.col("n") / FAN).cast("int")
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    centers = counts.withColumn("part", F.explode(F.sequence(F.lit(0), fan - 1)))
    placed = pairs.select("a", "b").join(counts, "a").withColumn("part", F.pmod(F.xxhash64("b"), fan).cast("int"))
    asked = centers.select("a", "part", F.col("a").alias("doc_id"), F.lit(0).alias("role")).union(
        placed.select("a", "part", F.col("b").alias("doc_id"), F.lit(1).alias("role"))
    )
    asked = scratch.keep(asked, "jaccard-asked")

    def run(batches):
        own, center, center_part = [], None, None
        for part in slices(batches, "text", SLICE):
            found, owner = shingle_sets(*utf8(part["text"]))
            ends = np.searchsorted(owner, np.arange(len(part) + 1))
            a_of, part_of, role, ids = (part[c].to_pylist() for c in ("a", "part", "role", "doc_id"))
            links = []
            for k in range(len(part)):
                mine = found[ends[k] : ends[k + 1]]
                if (a_of[k], part_of[k]) != (center, center_part):
                    center, center_part, own = a_of[k], part_of[k], []
                if role[k] == 0:
                    own.append(mine.copy())
                    continue
                for other in own:
                    if WHOLE * min(len(mine), len(other)) >= SHARE * max(len(mine), len(other)):
                        at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                        if (other[at] == mine).sum() >= least_shared(len(mine) + len(other)):
                            links.append((center, ids[k]))
                            break
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"]
            )

    met = rows_with(rows, asked, "doc_id").select("a", "part", "role", "doc_id", "text").repartition("a", "part")
    found = map_batches(met.sortWithinPartitions("a", "part", "role"), run, "a bigint, b bigint")
    links = scratch.keep(found, "jaccard-links")
    scratch.drop(asked)
    return links


def _folded(points: np.ndarray) -> np.ndarray:
    """Points of four groups summed to one: their minima bound more loosely, in a quarter of the time."""
    sums = points.reshape(len(points), GROUPS // 4, 4).sum(2, dtype=np.int64)
    return sums.astype(np.uint16) if points.dtype == np.uint8 else sums


class CountTree:
    """An R-tree over count vectors, packed by halving along the widest coordinate."""

    def __init__(self, points, sizes, labels):
        self.points, self.sizes, self.labels = points, sizes, labels
        self.folded = _folded(points)
        # uncut counts are at most 254 in each of 256 groups, so their sums fit 16 bits
        self.wide = np.uint16 if points.dtype == np.uint8 else np.int64
        self.nodes = []  # (upper corner, smallest size, largest size, label if it has one only, children or entries)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows):
        points = self.points[rows]
        if len(rows) <= LEAF:
            below, entries = None, rows
        else:
            axis = np.argmax(points.max(0) - points.min(0))
            order = rows[np.argsort(points[:, axis], kind="stable")]
            below, entries = (self._build(order[: len(rows) // 2]), self._build(order[len(rows) // 2 :])), None
        kinds = self.labels[rows]
        one = kinds[0] if (kinds == kinds[0]).all() else None
        self.nodes.append((points.max(0), self.sizes[rows].min(), self.sizes[rows].max(), one, below, entries))
        return len(self.nodes) - 1

    def search(self, points, sizes, labels):
        """(query, entry) of the pairs of other labels that may link; queries go down the tree together."""
        queries, entries_met, open_nodes = [], [], [(self.root, np.arange(len(points)))]
        folded = _folded(points)
        while open_nodes:
            node, q = open_nodes.pop()
            corner, least, most, one, below, entries = self.nodes[node]
            fits = (WHOLE * most >= SHARE * sizes[q]) & (SHARE * least <= WHOLE * sizes[q])
            if one is not None:
                fits &= labels[q] != one
            q = q[fits]
            q = q[np.minimum(corner, points[q]).sum(1, dtype=self.wide) >= least_shared(sizes[q] + least)]
            if below:
                open_nodes.extend((child, q) for child in below if len(q))
                continue
            for some in np.array_split(q, -(-len(q) // 256)) if len(q) else ():
                least_of = least_shared(sizes[some][:, None] + self.sizes[entries][None])
                loose = np.minimum(self.folded[entries][None], folded[some][:, None]).sum(2, dtype=self.wide)
                at_q, at_e = np.nonzero((loose >= least_of) & (labels[some][:, None] != self.labels[entries][None]))
                shared = np.minimum(self.points[entries[at_e]], points[some[at_q]]).sum(1, dtype=np.int64)
                close = shared >= least_of[at_q, at_e]
                queries.append(some[at_q[close]])
                entries_met.append(entries[at_e[close]])
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (queries, entries_met))


def _leaf_pairs(points, sizes, labels, part, crossing, after):
    """Row numbers of the pairs that may link, each row met with the ``after`` next ones, the rest of its cell.

    The tests are those of a leaf of ``CountTree``. Rows of a cell of two parts (``crossing``) meet only the other part.
    """
    one = np.repeat(np.arange(len(points)), after)
    other = np.arange(len(one)) - np.repeat(np.cumsum(after) - after, after) + one + 1
    least, most = np.minimum(sizes[one], sizes[other]), np.maximum(sizes[one], sizes[other])
    meet = (WHOLE * least >= SHARE * most) & (labels[one] != labels[other]) & (~crossing[one] | (part[one] != part[other]))
    one, other = one[meet], other[meet]
    wide = np.uint16 if points.dtype == np.uint8 else np.int64
    for counts in (_folded(points), points):
        close = [np.zeros(0, bool)]
        for at in range(0, len(one), PAIRS):
            x, y = one[at : at + PAIRS], other[at : at + PAIRS]
            close.append(np.minimum(counts[x], counts[y]).sum(1, dtype=wide) >= least_shared(sizes[x] + sizes[y]))
        close = np.concatenate(close)
        one, other = one[close], other[close]
    return one, other


def _pairs_of_cells(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Candidate pairs (a, b) of whole cells: of a cell's two parts, or within its one part."""
    points = _points(rows["point"].to_pylist())
    sizes, labels, ids, part, i, j = (rows[c].to_numpy() for c in ("size", "label", "id", "part", "i", "j"))
    starts = _cell_starts(rows)
    ends = np.append(starts[1:], len(rows))
    # a cell that fits one leaf is a tree of that leaf only
    small = ends - starts <= LEAF
    after = np.repeat(np.where(small, ends, 0), ends - starts) - np.arange(len(rows)) - 1
    found = [_leaf_pairs(points, sizes, labels, part, i != j, np.maximum(after, 0))]
    for start, end in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
        inside = start + np.flatnonzero(part[start:end] == i[start])
        asking = inside if i[start] == j[start] else start + np.flatnonzero(part[start:end] == j[start])
        if len(inside) and len(asking):
            tree = CountTree(points[inside], sizes[inside], labels[inside])
            query, entry = tree.search(points[asking], sizes[asking], labels[asking])
            found.append((asking[query], inside[entry]))
    one, other = (ids[np.concatenate(x)] for x in zip(*found, strict=True))
    pairs = pd.DataFrame({"a": np.minimum(one, other), "b": np.maximum(one, other)}).drop_duplicates()
    return pa.RecordBatch.from_pandas(pairs, preserve_index=False)


def _cell_starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where each cell begins, in rows that are sorted by cell."""
    new = np.ones(len(rows), bool)
    shingle, i, j = (rows[c].to_numpy() for c in ("shingle", "i", "j"))
    new[1:] = (shingle[1:] != shingle[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return np.flatnonzero(new)


def _cell_pairs(batches):
    """Candidate pairs of the cells in ``batches``, sorted by cell; the last cell of a batch waits for its other rows.

    Most cells have a few members, so many are taken at once.
    """
    held = None
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        last = int(_cell_starts(batch)[-1])
        if last:
            yield _pairs_of_cells(batch.slice(0, last))
        held = batch.slice(last)
    if held is not None:
        yield _pairs_of_cells(held)


def _blocks(signatures: DataFrame, scratch: Scratch) -> DataFrame:
    """(shingle, id, size, place) of the shingles that are in the prefix of more than one representative."""
    rows = signatures.select("id", "size", "cold", F.posexplode("prefix").alias("place", "shingle"))
    spot = (F.col("size") * (1 << 31) + F.col("place")).alias("spot")
    cold = keep_repeated(rows.where("place < cold").select("shingle", "id", spot), "shingle")
    # hot cells hold a frequent shingle; a single one among them forms a block of one, which pairs nothing
    met = scratch.keep(cold.union(rows.where("place >= cold").select("shingle", "id", spot)), "jaccard-blocks")
    size = F.shiftright("spot", 31)
    return met.select("shingle", "id", size.alias("size"), (F.col("spot") - size * (1 << 31)).alias("place"))


def _star(met: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, n): each member with its block's center, and in how many blocks."""
    member = F.struct("id", "size", "place")
    ends = met.groupBy("shingle").agg(F.min(member).alias("low"), F.max(member).alias("high")).where("low.id <> high.id")
    even = F.pmod("shingle", F.lit(2)) == 0
    centers = scratch.keep(ends.select("shingle", F.when(even, F.col("low")).otherwise(F.col("high")).alias("center")), "jaccard-centers")
    star = met.join(centers, "shingle").where(
        (F.col("id") != F.col("center.id")) & _meets(F.col("size"), F.col("place"), F.col("center.size"), F.col("center.place"))
    )
    star = star.groupBy(F.col("center.id").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    star = scratch.keep(star, "jaccard-star")
    scratch.drop(centers)
    return star


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose labels differ."""
    a = labels.select(F.col("id").alias("a"), F.col("label").alias("label_a"))
    b = labels.select(F.col("id").alias("b"), F.col("label").alias("label_b"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(
        F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
    ).select(*pairs.columns)


def _cells(met: DataFrame, labels: DataFrame, signatures: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate pairs (a, b, n) of the blocks that still hold several labels."""
    marked = met.join(labels, "id", "left")
    marked = scratch.keep(marked.select("shingle", "id", F.coalesce("label", "id").alias("label")), "jaccard-marked")
    # of blocks with the same members one is enough
    open_blocks = marked.groupBy("shingle").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members"),
    ).where("low <> high").groupBy("n", "members").agg(F.min("shingle").alias("shingle"))
    open_blocks = scratch.keep(open_blocks.select("shingle", "n"), "jaccard-open")
    parts = F.ceil(F.col("n") / CELL).cast("int")
    dealt = marked.join(open_blocks, "shingle").select(
        "shingle", "id", "label", F.pmod(F.xxhash64("id", "shingle"), parts).cast("int").alias("part"), parts.alias("parts")
    )
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "shingle", "id", "label", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")
    )
    cells = cells.join(signatures.select("id", "size", "point"), "id")
    cell = ["shingle", "i", "j"]
    pairs = map_batches(cells.repartition(*cell).sortWithinPartitions(*cell), _cell_pairs, "a bigint, b bigint")
    pairs = scratch.keep(pairs.distinct(), "jaccard-pairs")
    scratch.drop(marked, open_blocks)
    return pairs


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, label) of every row with an id; the label is the smallest id that links reach, itself included.

    Words are case-folded for A to Z only and split at ASCII white space. Null and empty texts link with nothing; rows
    that repeat an id count as one document with all their texts.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    every = scratch.keep(_signatures(rows), "jaccard-signatures")
    # the smallest id of a set stands for all rows of that set
    same = ["size", "one", "two"]
    heads = scratch.keep(every.where("size > 0").groupBy(*same).agg(F.min("id").alias("head")), "jaccard-heads")
    named = scratch.keep(every.select("id", *same).join(heads, same, "left").select("id", "size", "head"), "jaccard-named")
    chosen = every.join(heads.withColumnRenamed("head", "id"), [*same, "id"], "left_semi").dropDuplicates([*same, "id"])
    signatures = scratch.keep(chosen, "jaccard-chosen")
    scratch.drop(every, heads)
    met = _blocks(signatures, scratch)
    star = _star(met, scratch)
    near = scratch.keep(bounded(star, signatures), "jaccard-near")
    best = near.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    links = verified(scratch.keep(best, "jaccard-best"), rows, scratch)
    labels = smallest_labels(links)
    others = scratch.keep(_apart(near, labels).select("a", "b"), "jaccard-others")
    if not others.isEmpty():
        links = links.union(verified(others, rows, scratch))
        labels = smallest_labels(links)
    scratch.drop(star, near, others)
    pairs = _cells(met, labels, signatures, scratch)
    if not pairs.isEmpty():
        links = links.union(verified(pairs, rows, scratch))
    # an id with several texts may have several heads, which its rows tie together
    ties = named.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    several = named.groupBy("id").agg(F.min("head").alias("low"), F.max("head").alias("high")).where("low <> high")
    ties = ties.join(several, F.col("a") == F.col("id"), "left_semi")
    labels = smallest_labels(links.union(ties))
    scratch.drop(met, signatures, pairs)
    found = named.join(labels.withColumnRenamed("id", "head"), "head", "left")
    label = F.min(F.coalesce("label", "head", "id")).over(Window.partitionBy("id"))
    return found.select("id", F.col("size").alias("n_shingles"), label.alias("label"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, label) of every id; see ``grouped``."""
    return grouped(docs, doc_id, text).select("id", "label").dropDuplicates(["id"])


def with_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with component_id, the smallest id reachable by links, itself included; null without an id."""
    found = components(docs, doc_id, text)
    rows = docs.drop("component_id")
    return rows.alias("row").join(found.alias("found"), F.col(f"row.{doc_id}") == F.col("found.id"), "left").select(
        "row.*", F.coalesce("found.label", f"row.{doc_id}").alias("component_id")
    )


def shingle_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles) of every row."""

    def run(batches):
        for part in slices(batches, text, SLICE):
            _, owner = shingle_sets(*utf8(part[text]))
            yield pa.RecordBatch.from_arrays([part[doc_id], pa.array(np.bincount(owner, minlength=len(part)))], [doc_id, "n_shingles"])

    return map_batches(docs.select(doc_id, text), run, T.StructType([docs.schema[doc_id], T.StructField("n_shingles", T.LongType())]))
