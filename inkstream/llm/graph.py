"""Connected components of an edge list, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import drop_scratch, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label``: for each node with an edge, the smallest node it is connected to.

    Each round takes the smallest label among neighbours, then follows labels one
    step, so chains shrink by halves. Labels are written to the shared folder every
    round; only the count of changes reaches the driver. Null ends are ignored.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x != y")
    both = materialize(pairs.union(pairs.select("y", "x")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = materialize(lower.join(target, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = moved.where("label != old").limit(1).count()
        drop_scratch(spark, labels)
        labels = moved.drop("old")
        if not changed:
            drop_scratch(spark, both)
            return labels
