"""Exact dedup by merging runs of digests in a tree.

Each input partition is a leaf run: one row per digest, with the best document and the number of documents. In each
round the runs of ``FAN`` neighbours are sent to one another by digest and merged, until one run is left; then the
result goes down the same tree. A group of copies is one row per run from the first round on, so no task gets it whole.

Digests are 256 bits and merged only where the length and a second hash of the text agree as well, at every level.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlight.llm.columns import WHITE, whole_text
from armlight.sources.files import stage

FAN = 16
_SAME = ["digest", "length", "hash"]


def leaf_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document, with the run that it lies in."""
    plain = F.regexp_replace(whole_text(text), WHITE, "")
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.sha2(plain, 256)).alias("digest"),
        F.length(plain).alias("length"),
        F.xxhash64(plain).alias("hash"),
        F.struct((-F.length(whole_text(text))).alias("rank"), F.col(doc_id).alias("keep_id")).alias("best"),
        F.spark_partition_id().alias("run"),
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when they are so without white space. The row with the most code points stays, of these the one
    with the smallest id; a null id counts as smaller than any other. Null and empty texts, and texts of white space
    only, are one group. Rows that repeat an id and a text count each and share one decision. An empty table gives an
    empty result.
    """
    leaves = stage(leaf_rows(docs, doc_id, text), "digests")
    runs = (leaves.agg(F.max("run")).first()[0] or 0) + 1
    merged = leaves.groupBy("run", *_SAME).agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("size"))
    levels = [merged]
    while runs > 1:
        runs = -(-runs // FAN)
        up = F.floor(F.col("run") / FAN).cast("int").alias("run")
        merged = (
            levels[-1].select(up, *_SAME, "best", "size")
            .groupBy("run", *_SAME).agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        )
        levels.append(merged)
    found = levels.pop()
    while levels:
        below = levels.pop().select("run", *_SAME, F.floor(F.col("run") / FAN).cast("int").alias("above"))
        found = below.join(found.withColumnRenamed("run", "above"), ["above", *_SAME]).select("run", *_SAME, "best", "size")
    return leaves.select("doc_id", "run", *_SAME).join(found, ["run", *_SAME]).select(
        "doc_id",
        F.col("best.keep_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("best.keep_id")).alias("kept"),
        "digest",
    )
