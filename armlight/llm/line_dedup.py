"""Line dedup by overlapping windows of three consecutive lines.

Every window is hashed (128 bits). A window that also occurs earlier (smaller doc_id, or the same document, further up)
covers its three lines; covered positions are merged into spans and removed. The windows are narrow rows; the first
occurrence of each repeated window is found by a combined aggregation and written, so that the join back is a plain
one whose hot keys Spark splits.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlight.llm.columns import at, indexes, let, whole_text
from armlight.sources.files import stage

WINDOW = 3


def _lines(text):
    return F.split(whole_text(text), "\n", -1)


def line_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos, key of each window of three lines, but those of white space only."""

    def window(lines):
        def key(pos):
            joined = F.concat_ws("\n", *(at(lines, pos + k) for k in range(WINDOW)))
            return F.when(F.trim(F.translate(joined, "\n\t\r", "   ")) != "", F.unhex(F.md5(joined)))

        return F.transform(indexes(F.size(lines) - (WINDOW - 1)), key)

    keys = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(let(_lines(text), window)).alias("pos", "key"))
    return keys.where(F.col("key").isNotNull())


def covered_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and an array of (start, end) line spans to remove, for documents that have any."""
    windows = stage(line_windows(docs, doc_id, text), "line-windows")
    repeated = (
        windows.groupBy("key")
        .agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("key", "first")
    )
    repeated = stage(repeated, "line-repeats")
    later = windows.join(repeated, "key").where(F.struct("doc_id", "pos") != F.col("first"))
    positions = later.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("positions"))

    def spans(p):
        def merge(begins):
            def span(begin, k):
                last = F.coalesce(at(begins, k + 1), F.size(p)) - 1
                return F.struct(at(p, begin).alias("start"), (at(p, last) + WINDOW).alias("end"))

            return F.transform(begins, span)

        begins = F.filter(indexes(F.size(p)), lambda i: (i == 0) | (at(p, i) - at(p, i - 1) > WINDOW))
        return let(begins, merge)

    return positions.select("doc_id", let(F.col("positions"), spans).alias("spans"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated windows of lines cut out of ``text``, and n_lines, n_removed, n_spans.

    Lines end at a line feed and are compared as they are. Documents of fewer than three lines have no window and stay
    as they are, as do windows without a visible character. A null text stays null and has no lines; an empty text is
    one empty line. Rows that repeat an id are one document as far as the order of occurrences goes: the same window at
    the same place is no later occurrence. A null id comes before all others.
    """
    # columns are named through the two sides, so those of ``docs`` may have any names
    spans = covered_spans(docs, doc_id, text).alias("found")
    joined = docs.alias("row").join(spans, F.col(f"row.`{doc_id}`").eqNullSafe(F.col("found.doc_id")), "left")
    given = f"row.`{text}`"

    def kept(lines):
        def gap(span, k):
            begin = F.when(k > 0, at(F.col("found.spans"), k - 1)["end"]).otherwise(F.lit(0))
            return F.slice(lines, begin + 1, span["start"] - begin)

        gaps = F.transform("found.spans", gap)
        end = F.element_at("found.spans", -1)["end"]
        return F.concat(F.flatten(gaps), F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0))))

    removed = F.aggregate("found.spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    columns = [c for c in docs.columns if c not in (text, "n_lines", "n_removed", "n_spans")]
    return joined.select(
        *[F.col(f"row.`{c}`") for c in columns],
        F.when(F.col("found.spans").isNull(), F.col(given))
        .otherwise(F.array_join(let(_lines(given), kept), "\n")).alias(text),
        F.when(F.col(given).isNull(), 0).otherwise(F.size(_lines(given))).cast("bigint").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.when(F.col("found.spans").isNotNull(), F.size("found.spans")), F.lit(0)).cast("bigint").alias("n_spans"),
    )
