"""Document fingerprints by Order MinHash, from DataFrame functions only.

Tokens are runs of at most ``TOKEN`` characters between white space. Every k-mer of tokens gets the number of its
occurrence in the text, so repeats count, and both are hashed to one 64-bit value. The values fall into ``2**BIN_BITS``
bins by their highest bits; the two smallest of a bin, in the order in which they stand in the text, are hashed to
one entry. Two texts agree on an entry only if they share both k-mers in the same order, so the share of common
entries follows the edit distance. All sketches of a text come from one sort of its values (one permutation, not one
per entry).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from armlight.llm.columns import at, indexes, let, whole_text
from armlight.session import shuffle_width

TOKEN, K, BIN_BITS = 12, 3, 6
# the low 24 bits of a packed value hold a position, the others a hash
_PLACE, _HASH = (1 << 24) - 1, -(1 << 24)


def _pack(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(_HASH)).bitwiseOR(place.bitwiseAND(F.lit(_PLACE)))


def _hash_of(packed: Column) -> Column:
    return F.shiftright(packed, 24)


def _bin(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 64 - BIN_BITS)


def _numbered(sorted_kmers: Column) -> Column:
    """Packed (hash of k-mer and occurrence number, position) from sorted packed (hash of k-mer, position)."""

    def runs(begins):
        def run(begin, k):
            end = F.coalesce(at(begins, k + 1), F.size(sorted_kmers)) - 1

            def item(i):
                value = at(sorted_kmers, i)
                return _pack(F.xxhash64(_hash_of(value), i - begin), value)

            return F.transform(F.sequence(begin, end), item)

        return F.flatten(F.transform(begins, run))

    new = F.filter(
        indexes(F.size(sorted_kmers)),
        lambda i: (i == 0) | (_hash_of(at(sorted_kmers, i)) != _hash_of(at(sorted_kmers, i - 1))),
    )
    return let(new, runs)


def _entries(values: Column) -> Column:
    """One entry per non-empty bin of the sorted packed values."""

    def entry(i):
        one, two = at(values, i), at(values, i + 1)
        paired = two.isNotNull() & (_bin(two) == _bin(one))
        in_order = F.when(
            paired & (two.bitwiseAND(F.lit(_PLACE)) < one.bitwiseAND(F.lit(_PLACE))), F.xxhash64(_hash_of(two), _hash_of(one))
        ).otherwise(F.xxhash64(_hash_of(one), F.when(paired, _hash_of(two))))
        return F.shiftleft(_bin(one), 64 - BIN_BITS).bitwiseOR(F.shiftrightunsigned(in_order, BIN_BITS))

    first = F.filter(indexes(F.size(values)), lambda i: (i == 0) | (_bin(at(values, i)) != _bin(at(values, i - 1))))
    return F.transform(first, entry)


def signature(text: Column) -> Column:
    """Array of at most ``2**BIN_BITS`` entries. A text of fewer than K tokens is one k-mer, one without tokens has no entries."""

    def kmers(tokens):
        count = F.greatest(F.size(tokens) - (K - 1), F.least(F.size(tokens), F.lit(1)))
        return F.transform(
            indexes(count), lambda i: _pack(F.xxhash64(*(at(tokens, i + k) for k in range(K))), i.cast("bigint"))
        )

    packed = let(F.regexp_extract_all(text, F.lit(r"[^ \t-\r]{1,%d}" % TOKEN), F.lit(0)), kmers)
    return let(F.sort_array(let(F.sort_array(packed), _numbered)), _entries)


def likeness(a: Column, b: Column) -> Column:
    """Common entries over the entries of the fuller signature; two signatures without entries are alike."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def as_text(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.lower(F.lpad(F.hex(e), 16, "0"))), "")


def with_next(docs: DataFrame, order: str, values) -> DataFrame:
    """Each row of ``docs`` with ``next_<v>`` for each of ``values``: of the next row by descending ``order``, the
    first row after the last.

    Rows are dealt to ranges of ``order``; the first row of a range is copied to the end of the one before. The driver
    sees the bounds and the largest id of each range.
    """
    buckets = max(8, 2 * shuffle_width(docs.sparkSession))
    found = docs.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0]
    bounds = sorted(set(found or []))
    group = max(1, int(len(bounds) ** 0.5))
    id_type = docs.schema[order].dataType

    def below(list_):
        return F.size(F.filter(F.array(*map(F.lit, list_)).cast(f"array<{id_type.simpleString()}>"), lambda b: b < F.col(order)))

    if bounds:
        # of the groups of bounds, those that end below the id count whole, and one more is looked into
        whole = below(bounds[group - 1 :: group])
        part = F.slice(F.array(*map(F.lit, bounds)), whole * group + 1, group)
        bucket = whole * group + F.size(F.filter(part, lambda b: b < F.col(order)))
    else:
        bucket = F.lit(0)
    placed = docs.withColumn("_bucket", bucket)
    largest = dict(placed.groupBy("_bucket").agg(F.max(order)).collect())
    used = sorted(largest)
    goes_to = {b: used[(i + 1) % len(used)] for i, b in enumerate(used)}
    size = max(used, default=0) + 1
    tops = F.array(*(F.lit(largest.get(b)).cast(id_type) for b in range(size)))
    targets = F.array(*(F.lit(goes_to.get(b)).cast("int") for b in range(size)))
    own = F.struct(F.col("_bucket").alias("at"), F.lit(0).alias("copy"))
    moved = F.struct(at(targets, F.col("_bucket")).alias("at"), F.lit(1).alias("copy"))
    is_top = F.col(order).eqNullSafe(at(tops, F.col("_bucket")))
    dealt = placed.withColumn("_place", F.explode(F.when(is_top, F.array(own, moved)).otherwise(F.array(own)))).drop("_bucket")
    window = W.partitionBy("_place.at").orderBy("_place.copy", F.col(order).desc(), *(F.col(v) for v in values))
    ahead = dealt.withColumns({f"next_{v}": F.lead(v).over(window) for v in values})
    return ahead.where("_place.copy = 0").drop("_place")


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, and the signatures ``own``, ``edited_own`` and ``next_own``.

    The edited text is the text with its last third (rounded down) replaced by the beginning of the next document's.
    Null texts count as empty; the next document of a table of one row is that row; rows that repeat an id follow one
    another by text; a null id comes last.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    ahead = with_next(rows.withColumn("own", signature(F.col("text"))), "doc_id", ["text", "own"])
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    return ahead.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"), "own", "next_own").withColumn(
        "edited_own", signature(F.col("edited"))
    )
