"""Input views over the driver's tables, with the SQL that builds the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = {"user": "Alice", "assistant": "Marcus", "system": "the clerk"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL_SPLIT = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cores, where the input holds less than 4 MB for each of them and is read by fewer tasks.

    Such a file is often one row group, so one task, however costly its rows are. Larger inputs are read as they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_SPLIT and df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share: under the session's checkpoint folder, or on this machine for local masters."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="inkstream-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: documents as manuscripts, every seventh line opened by a heading."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 7 == 0, F.concat(F.lit("# Section "), (i / 7).cast("int").cast("string"), F.lit("\n\n"), x)).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n\n").alias("raw_text"))


PROSE = r"""
prose AS (
    SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)),
        lambda x, i: CASE WHEN (i - 1) % 7 = 0 THEN '# Section ' || ((i - 1) // 7) || chr(10) || chr(10) || x ELSE x END), chr(10) || chr(10)) AS raw_text
    FROM documents)"""


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: documents with carriage returns, section breaks, curly and mixed quotes, some without headings, some without a text."""
    plain = lambda x: F.replace(x, F.lit('"'), F.lit(""))
    line = lambda x, i: (
        F.when(i % 5 == 1, F.concat(x, F.lit("\r\n\r\n***")))
        .when(i % 5 == 2, F.concat(F.lit("“"), plain(x), F.lit('" he went on, "Yes” and “no“ more')))
        .when(i % 5 == 3, F.concat(F.lit("* * *\r\r"), x))
        .when((i % 5 == 4) & (F.col("doc_id") % 3 != 0), F.concat(F.lit("## Part "), i.cast("string"), F.lit("\r\n\n"), x))
        .otherwise(x)
    )
    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\r\n\r\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 13 != 0, body).alias("raw_text"))


MIXED = r"""
mixed AS (
    SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i:
        CASE WHEN (i - 1) % 5 = 1 THEN x || chr(13) || chr(10) || chr(13) || chr(10) || '***'
             WHEN (i - 1) % 5 = 2 THEN '“' || replace(x, '"', '') || '" he went on, "Yes” and “no“ more'
             WHEN (i - 1) % 5 = 3 THEN '* * *' || chr(13) || chr(13) || x
             WHEN (i - 1) % 5 = 4 AND doc_id % 3 <> 0 THEN '## Part ' || (i - 1) || chr(13) || chr(10) || chr(10) || x
             ELSE x END), chr(13) || chr(10) || chr(13) || chr(10)) END AS raw_text
    FROM documents)"""


def turn_text() -> F.Column:
    """A turn as a quotation, tagged with its speaker unless turn % 4 is 1 or 2."""
    said = F.concat(F.lit('"'), F.replace(F.replace(F.col("text"), F.lit('"'), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit('"'))
    name = F.when(F.col("role") == "user", "Alice").when(F.col("role") == "assistant", "Marcus").otherwise("the clerk")
    return F.when((F.col("turn") % 4).isin(1, 2), said).otherwise(F.concat(said, F.lit(" "), name, F.lit(" said.")))


def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: conversations as manuscripts, one paragraph a turn."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", F.struct("turn", turn_text().alias("p")).alias("t"))
    # what follows is costly for each row, so small partitions must not be merged by their size in bytes
    turns = turns.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "conv_id")
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["p"])
    body = F.array_join(ordered, "\n\n")
    return turns.groupBy("conv_id").agg(F.concat(F.lit("# Conversation "), F.first("conv_id").cast("string"), F.lit("\n\n"), body).alias("raw_text")).select(F.col("conv_id").alias("doc_id"), "raw_text")


SCRIPT = r"""
script AS (
    SELECT conv_id AS doc_id, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg(p, chr(10) || chr(10) ORDER BY turn, p) AS raw_text
    FROM (SELECT conv_id, turn, '"' || replace(replace(text, '"', ''), chr(10), ' ') || '"' || CASE WHEN turn % 4 IN (1, 2) THEN ''
                 ELSE ' ' || CASE role WHEN 'user' THEN 'Alice' WHEN 'assistant' THEN 'Marcus' ELSE 'the clerk' END || ' said.' END AS p
          FROM conversations WHERE text IS NOT NULL)
    GROUP BY conv_id)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: embeddings as short signals of 16-bit samples at 24 kHz."""
    samples = F.transform("embedding", lambda x: (x.cast("double") * 20000).cast("int").cast("smallint"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit(24000).alias("sample_rate"), samples.alias("samples"))


SIGNAL = """
signal AS (SELECT vec_id, 24000 AS sample_rate, list_transform(embedding, lambda x: trunc(x::DOUBLE * 20000)::INT) AS samples FROM embeddings)"""


def job_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """V5: events as changes of job states; of the table, or of a stream of its rows."""
    state = F.create_map(*[F.lit(x) for x in ("signup", "INITIALIZING", "view", "SYNTHESIZING", "click", "SYNTHESIZING", "purchase", "COMPLETE", "error", "ERROR")])
    return (table(spark, sf_dir, "events") if events is None else events).select(F.col("user_id").alias("job_id"), "ts", "event_id", F.element_at(state, F.col("event_type")).alias("state"), "value")


JOB_EVENTS = """
job_events AS (SELECT user_id AS job_id, ts, event_id, value, CASE event_type WHEN 'signup' THEN 'INITIALIZING' WHEN 'view' THEN 'SYNTHESIZING'
                      WHEN 'click' THEN 'SYNTHESIZING' WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'ERROR' END AS state FROM events)"""


def window_by(key: str, *order: str) -> Window:
    return Window.partitionBy(key).orderBy(*order)
