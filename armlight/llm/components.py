"""Connected components of links by smallest label, round by round."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlight.sources.files import stage


def smallest_labels(links: DataFrame) -> DataFrame:
    """(id, label) for each id of ``links`` (a, b): the smallest id reachable.

    Each round takes the smallest label of the neighbours, combined map-side, and then the label of the label, so long
    chains shorten; rounds are written, so the plan does not grow. The driver sees one count per round.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("id").alias("root"), F.col("label").alias("above"))
        jumped = stage(
            lower.join(roots, F.col("label") == F.col("root"), "left").select(
                "id", "old", F.least("label", F.coalesce("above", "label")).alias("label")
            ),
            "labels",
        )
        changed = jumped.where("old <> label").count()
        labels = jumped.select("id", "label")
        if not changed:
            return labels
