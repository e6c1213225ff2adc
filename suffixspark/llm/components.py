"""Connected components of a graph that is given by edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suffixspark.session import cut


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, label (the smallest node it is connected with) from edges (a, b), of which there are at most `rows` if that is known. Each round takes the least label beside a node,
    then the label of that label, so that long paths halve; labels are cut after each."""
    rows = edges.count() if rows is None else rows
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), 2 * rows)
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), 2 * rows)
    while True:
        beside = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = cut(labels.join(beside.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), 2 * rows)
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = cut(nearer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), 2 * rows)
        labels = moved.select("node", "label")
        if moved.filter("old <> label").isEmpty():
            return labels
