"""Synthesis with a content-addressed cache: speak what is new, once, and join it back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.fixed import MOCK_WORDS_PER_SECOND, SAMPLE_RATE
from inkstream.functions import text as T
from inkstream.functions.dsp import ms_to_samples, trim
from inkstream.operators.engines import Engine

AUDIO = "key string, pcm binary, n_samples int, error string"
LENGTHS = "key string, n_spoken int, n_samples int, error string"
HELD_BYTES = 16 << 20  # of sound that a worker holds before handing it on


def content_key(engine_name: str) -> Column:
    """Digest of voice, text, rate, pitch and engine, as a printable key of 16 digits."""
    spoken = F.concat_ws(":", F.coalesce(F.nullif("voice", F.lit("")), "character", F.lit("None")), "text", "ssml_rate", "ssml_pitch", F.lit(engine_name))
    return F.left(F.sha2(spoken, 256), F.lit(16))


def cache_key(engine_name: str) -> Column:
    """The key of the audio table: everything the sound depends on, in full."""
    parts = [F.coalesce(c, F.lit("")) for c in ("voice", "character", "chunk_type", "text", "ssml_rate", "ssml_pitch")]
    return F.sha2(F.concat_ws("\x1f", *parts, F.lit(engine_name)), 256)


def is_silent() -> Column:
    return (F.col("chunk_type") == "section_break") | (T.strip(F.col("text")) == "")


def mock_samples(words: Column) -> Column:
    """Length of the synthetic engine's audio."""
    return F.greatest(F.lit(240), (F.greatest(F.lit(1), words) / F.lit(MOCK_WORDS_PER_SECOND) * SAMPLE_RATE).cast("int"))


def missing(work: DataFrame, cache: DataFrame) -> DataFrame:
    """The rows whose key has no sound in the cache; an empty sound is none."""
    return work.join(cache.where(F.length("pcm") > 0).select("key"), "key", "left_anti")


def distinct_sounds(chunks: DataFrame, engine: Engine, cache: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """What is to be spoken: one row for each sound that the cache lacks."""
    work = chunks.where(~is_silent()).withColumn("key", cache_key(engine.name)).select("key", "text", "chunk_type", "character", "voice", "ssml_rate", "ssml_pitch", "pause_after_ms")
    work = work.groupBy("key").agg(*[F.first(c).alias(c) for c in work.columns if c not in ("key", "pause_after_ms")], F.max("pause_after_ms").alias("pause_after_ms"))
    if cache is not None:
        work = missing(work, cache)
    # rows are few and each is costly, so they must not be merged into a few tasks by their size in bytes
    spark = chunks.sparkSession
    return work.repartition(partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "key")


def spoken(engine: Engine, row: dict) -> tuple[np.ndarray, str | None]:
    """The sound of a row, or silence and what went wrong: a chunk that can't be spoken must not stop the rest."""
    try:
        return np.asarray(engine.speak(row), "<i2"), None
    except Exception as e:
        return np.zeros(int(max(500, row["pause_after_ms"]) / 1000.0 * SAMPLE_RATE), "<i2"), str(e)


def speak(chunks: DataFrame, engine: Engine, cache: DataFrame | None = None, partitions: int | None = None, done: Accumulator | None = None) -> DataFrame:
    """New rows for the cache: ``key, pcm, n_samples`` (after trimming), ``error``; each distinct sound is made once. Failures become silence with the error told. ``done`` counts the sounds of finished tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made, held = [], 0
            for row in pdf.to_dict("records"):
                sound, error = spoken(engine, row)
                made.append((row["key"], sound.tobytes(), len(trim(sound)), error))
                if done is not None:
                    done.add(1)
                held += sound.nbytes
                if held >= HELD_BYTES:  # a batch of texts can be gigabytes of sound
                    yield pd.DataFrame(made, columns=["key", "pcm", "n_samples", "error"])
                    made, held = [], 0
            yield pd.DataFrame(made, columns=["key", "pcm", "n_samples", "error"])

    return distinct_sounds(chunks, engine, cache, partitions).mapInPandas(run, AUDIO)


def measure(chunks: DataFrame, engine: Engine, partitions: int | None = None) -> DataFrame:
    """As ``speak``, for those who need no audio: ``key, n_spoken`` (samples made), ``n_samples`` (after trimming), ``error``. Every sound is made in full and measured by the worker, and no audio leaves it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for row in pdf.to_dict("records"):
                sound, error = spoken(engine, row)
                made.append((row["key"], len(sound), len(trim(sound)), error))
            yield pd.DataFrame(made, columns=["key", "n_spoken", "n_samples", "error"])

    return distinct_sounds(chunks, engine, None, partitions).mapInPandas(run, LENGTHS)


def held(cache: DataFrame) -> DataFrame:
    """``key, n_samples``, once for each key: runs at the same time may append the same sound twice."""
    return cache.groupBy("key").agg(F.max("n_samples").alias("n_samples"))


def with_lengths(chunks: DataFrame, engine: Engine, cache: DataFrame) -> DataFrame:
    """Adds ``n_samples`` after trimming (null if the sound is missing, 0 for silence); no audio moves."""
    keyed = chunks.withColumn("key", F.when(~is_silent(), cache_key(engine.name)))
    joined = keyed.join(held(cache), "key", "left")
    return joined.withColumn("n_samples", F.when(is_silent(), 0).otherwise(F.col("n_samples"))).drop("key")


def with_audio(chunks: DataFrame, engine: Engine, cache: DataFrame) -> DataFrame:
    """Adds ``pcm`` (null if missing) and ``error``; silent chunks get silence of their pause."""
    keyed = chunks.withColumn("key", F.when(~is_silent(), cache_key(engine.name)))
    zeros = F.unhex(F.repeat(F.lit("0000"), ms_to_samples(F.col("pause_after_ms"))))
    return keyed.join(cache.groupBy("key").agg(F.max_by("pcm", F.length("pcm")).alias("pcm"), F.max_by("error", F.length("pcm")).alias("error")), "key", "left").withColumn("pcm", F.when(is_silent(), zeros).otherwise(F.col("pcm"))).drop("key")
