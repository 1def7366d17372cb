"""Jobs as an append-only log of events: latest state, active jobs, progress, recovery. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("INITIALIZING", "SYNTHESIZING")
INTERRUPTED = "Synthesis interrupted by restart."


def latest(events: DataFrame) -> DataFrame:
    """The last event of each job."""
    rest = [c for c in events.columns if c not in ("job_id", "ts", "event_id")]
    last = F.max(F.struct("ts", "event_id", *rest)).alias("e")
    return events.groupBy("job_id").agg(last).select("job_id", "e.*")


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("state").isin(*ACTIVE))


def latest_active(jobs: DataFrame, created: str = "ts") -> DataFrame:
    """The active job that came last; one row at most."""
    return active(jobs).orderBy(F.desc(created), F.desc("event_id")).limit(1)


def recover(jobs: DataFrame) -> DataFrame:
    """Jobs as found after a restart: what was under way has failed."""
    hit = F.col("state").isin(*ACTIVE)
    return jobs.withColumns({"error": F.when(hit, INTERRUPTED), "state": F.when(hit, "ERROR").otherwise(F.col("state"))})


def progress_percent(done: Column, total: Column) -> Column:
    return F.round(done / F.greatest(F.lit(1), total) * 100, 1)


def progress(events: DataFrame) -> DataFrame:
    """``job_id, done, total, percent``: completed events among all of a job."""
    counted = events.groupBy("job_id").agg(F.count(F.when(F.col("state") == "COMPLETE", 1)).alias("done"), F.count("*").alias("total"))
    return counted.withColumn("percent", progress_percent(F.col("done"), F.col("total")))


def find(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The jobs with the ids in ``wanted`` (``job_id``); an id without a job gets state ``NOT_FOUND``."""
    rest = [c for c in jobs.columns if c not in ("job_id", "state")]
    return wanted.select("job_id").distinct().join(jobs, "job_id", "left").select("job_id", *rest, F.coalesce("state", F.lit("NOT_FOUND")).alias("state"))


def status_json(jobs: DataFrame, *fields: str) -> DataFrame:
    """``job_id, response``: the answer to a request for a job's status."""
    return jobs.select("job_id", F.to_json(F.struct("job_id", *fields)).alias("response"))


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def load_jobs(spark, path: str, schema: str = "job_id long, ts timestamp, event_id long, state string, value double") -> DataFrame:
    """Jobs from a log, recovered."""
    return recover(latest(spark.read.schema(schema).json(path)))


def clear(spark, path: str, schema: str = "job_id long, ts timestamp, event_id long, state string, value double") -> None:
    """Empty the log."""
    spark.createDataFrame([], schema).write.mode("overwrite").json(path)
