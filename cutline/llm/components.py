"""Connected components by contraction, in Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import stored


def _through(pairs: DataFrame, column: str, up: DataFrame) -> DataFrame:
    """``pairs`` with ``column`` replaced by its label, where it has one."""
    return (
        pairs.join(up.select(F.col("node").alias(column), F.col("label").alias("_label")), column, "left")
        .withColumn(column, F.coalesce("_label", column))
        .drop("_label")
    )


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``links`` (a, b): the label is one node of the component.

    Each round hooks every node to its smallest neighbour, follows the hooks twice, and contracts the
    links to the labels; links inside a label vanish.  A component shrinks at least by half in a round, and
    only keys are moved.  Every round is written to the shared folder, which cuts the lineage.
    """
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels: DataFrame | None = None
    while labels is None or not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), "hooks")
        for _ in range(2):
            up = _through(up, "label", up)
        up = stored(up, "hooks")
        labels = up if labels is None else stored(_through(labels, "label", up), "labels")
        links = stored(_through(_through(links, "a", up), "b", up).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels.select("node", "label")
