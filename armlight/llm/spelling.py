"""Spelling variant grouping by blocked Gram matrices.

Words are rows of letter counts. One product of a block of rows with itself gives all squared distances in it at once:
a letter put in or left out is a distance of one, a letter replaced is two. Pairs of at most two in blocks of equal or
adjacent length are verified as edits of one code point.

Blocks of a whole length would grow with the square of the vocabulary, so each is cut further without losing a pair: of
a word of ``m`` letters and one of ``m`` or ``m + 1`` that differ by one edit, either the first ``m // 2`` letters are
equal or the rest is. A word is hence in four blocks: as the shorter and as the longer one, by its front and its back.
Blocks of more than ``CELL`` words are dealt into parts, and each two parts meet in one cell, so no task gets more than
``2 * CELL`` words at once; only verified pairs leave a task.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armlight.sources.files import stage

# fixed: letters of a run, the rows that lose a letter, the smallest words and the share of a variant
LETTERS = "A-Za-zÀ-ÿ"
DAMAGED = 199
LEAST_LETTERS, LEAST_ROWS, TIMES = 6, 5, 5
CELL, TILE = 1024, 512
_WIDTH = 26 + 64  # a to z, U+00C0 to U+00FF


def lower_ascii(run: Column) -> Column:
    """A to Z as a to z and nothing else; the slow way only where ``lower`` would change another letter."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(run.rlike("[À-Þ]"), F.translate(run, upper, upper.lower())).otherwise(F.lower(run))


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of enough letters and occurrences, counted map-side before the shuffle.

    Null texts have no words; a null id counts as empty in the hash that picks the runs losing a letter.
    """
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"),
    ).where(F.length("run") >= LEAST_LETTERS)
    runs = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGED == 0, shorter).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= LEAST_ROWS)


def _blocks(words: DataFrame) -> DataFrame:
    """(block, m, word, n): the blocks of every word; ``m`` is the smaller length of the pairs a block is for."""
    size = F.length("word")

    def sides(m: Column):
        front, back = F.floor(m / 2).cast("int"), (m - F.floor(m / 2)).cast("int")
        return [
            F.struct(F.concat(F.lit("f"), m.cast("string"), F.lit(":"), F.left(F.col("word"), front)).alias("block"), m.alias("m")),
            F.struct(F.concat(F.lit("b"), m.cast("string"), F.lit(":"), F.right(F.col("word"), back)).alias("block"), m.alias("m")),
        ]

    found = F.filter(F.array(*sides(size), *sides(size - 1)), lambda b: b["m"] >= LEAST_LETTERS)
    return words.select(F.explode(found).alias("b"), "word", "n").select("b.block", "b.m", "word", "n")


def cells(words: DataFrame) -> DataFrame:
    """(block, m, i, j, part, word, n): blocks of more than ``CELL`` words as cells of two parts each."""
    rows = _blocks(words)
    large = rows.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CELL)
    large = stage(large.select("block", F.ceil(F.col("size") / CELL).cast("int").alias("parts")), "spelling-large")
    dealt = rows.join(large, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("block", "m", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "word", "n")


def letter_counts(words) -> np.ndarray:
    """A row of letter counts per word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    at = np.where(letters >= 0xC0, letters - 0xC0 + 26, letters - ord("a"))
    cell = np.repeat(np.arange(len(words)) * _WIDTH, sizes) + at
    return np.bincount(cell, minlength=len(words) * _WIDTH).reshape(-1, _WIDTH).astype(np.float32)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced between ``a`` and ``b``."""
    if len(a) > len(b):
        a, b = b, a
    for k, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return a[k + (len(a) == len(b)) :] == b[k + 1 :]
    return len(b) - len(a) == 1


def _tile_pairs(words, m, cell, part, crossed, back):
    """Index pairs of near words of one tile, the cells of which stand together."""
    counts = letter_counts(words)
    length = counts.sum(1)
    squares = np.einsum("ij,ij->i", counts, counts)
    gap = squares[:, None] + squares[None, :] - 2 * (counts @ counts.T)
    close = (gap <= 2) & (cell[:, None] == cell[None, :])
    close &= np.minimum(length[:, None], length[None, :]) == m[:, None]
    close &= ~crossed[:, None] | (part[:, None] != part[None, :])
    for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(close, 1)))):
        one, other = words[a], words[b]
        half = int(m[a]) // 2
        # a pair with equal fronts is reported by its front block only
        if one_edit(one, other) and not (back[a] and one[:half] == other[:half]):
            yield a, b


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all words one edit apart, both ways round."""
    keys = ["block", "i", "j"]
    rows = cells(words).repartition(*keys).sortWithinPartitions(*keys)

    def found(table):
        block, word, n = (table[c].to_pylist() for c in ("block", "word", "n"))
        m, i, j, part = (table[c].to_numpy() for c in ("m", "i", "j", "part"))
        new = np.ones(len(word), bool)
        coded = table["block"].combine_chunks().dictionary_encode().indices.to_numpy()
        new[1:] = (coded[1:] != coded[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cell = np.cumsum(new)
        back = np.fromiter((b[0] == "b" for b in block), bool, len(block))
        edges = [*np.flatnonzero(new).tolist(), len(word)]
        left, right, near_n = [], [], []
        start = 0
        for k in range(1, len(edges)):
            # cells of one word pair nothing; small cells share a tile
            if k + 1 < len(edges) and edges[k + 1] - start <= TILE:
                continue
            s = slice(start, edges[k])
            for a, b in _tile_pairs(word[s], m[s], cell[s], part[s], (i != j)[s], back[s]):
                left += [word[start + a], word[start + b]]
                right += [word[start + b], word[start + a]]
                near_n += [n[start + b], n[start + a]]
            start = edges[k]
        return pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(near_n, pa.int64())], ["word", "near", "near_n"])

    def run(batches):
        held = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held)
            # the last cell may go on in the next batch
            last = [whole[k][len(whole) - 1].as_py() for k in keys]
            end = len(whole)
            while end and [whole[k][end - 1].as_py() for k in keys] == last:
                end -= 1
            if end:
                yield found(whole.slice(0, end))
            held = whole.slice(end).to_batches()
        if held:
            yield found(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form reached, by doubling the steps in each round.

    A form has ``TIMES`` the occurrences of its word, so chains are short and have no cycle; the driver sees one count
    per round.
    """
    found = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        above = found.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = found.join(above, F.col("root") == F.col("at"), "left")
        step = stage(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        found = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return found


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    The form of a word is its near word of most occurrences, if it has ``TIMES`` as many; of equal ones the first in
    code-point order. Repeated rows count each; null and empty texts have no words, an empty table gives an empty one;
    columns of ``docs`` other than the two named don't matter, whatever their names. A text may be of any length.
    """
    words = stage(word_counts(docs, doc_id, text), "spelling-words")
    best = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best")
    )
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "best.near", (-F.col("best.order")).alias("near_n"))
    follows = F.col("near_n") >= TIMES * F.col("n")
    rows = stage(rows.select("word", "n", "n_near", F.when(follows, F.col("near")).alias("form"), F.when(follows, F.col("near_n")).alias("form_n")), "spelling-forms")
    found = roots(rows.where("form is not null"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
