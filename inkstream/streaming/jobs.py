"""Job states from a stream of events, and progress by chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.operators.jobs import latest


def latest_states(events: DataFrame) -> DataFrame:
    """Running view of each job's last event; write it in update or complete mode. State is one row for each job."""
    return latest(events)


def upsert(path: str):
    """A ``foreachBatch`` sink that folds changes into a table of jobs, writing beside it and swapping by version."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = latest(batch)
        target = f"{path}/v={epoch}"
        if epoch:
            new = latest(new.unionByName(spark.read.parquet(f"{path}/v={epoch - 1}")))
        new.write.mode("overwrite").parquet(target)

    return write


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The table of jobs after the last batch folded into it."""
    versions = spark.read.parquet(path)  # the version is a partition column
    return versions.where(F.col("v") == versions.agg(F.max("v")).first()[0]).drop("v")


def progress(done: DataFrame, totals: DataFrame) -> DataFrame:
    """Percent of chunks done by document, from a stream of finished chunks and a static table of totals."""
    counted = done.groupBy("doc_id").agg(F.count("*").alias("done"))
    return counted.join(totals, "doc_id").select("doc_id", "done", F.round(F.col("done") / F.greatest(F.lit(1), F.col("total")) * 100, 1).alias("percent"))
