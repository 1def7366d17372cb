"""Sound files as rows of samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from inkstream.fixed import SAMPLE_RATE
from inkstream.functions.dsp import analyze_pcm, decode_wav
from inkstream.operators.engines import EngineError, decoded


def from_wav_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, rate, pcm``: the left channel as 16-bit little-endian samples; empty for what is no 16-bit WAV."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_wav("content").alias("w")).select("path", "w.rate", "w.pcm")


@F.pandas_udf(BinaryType())
def decode_container(data: pd.Series) -> pd.Series:
    """Samples at 24 kHz as bytes, of any container that ffmpeg reads; null for what can't be decoded."""

    def one(raw: bytes) -> bytes | None:
        try:
            return decoded(bytes(raw)).astype("<i2").tobytes()
        except EngineError:
            return None

    return data.map(one)


def from_audio_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, rate, pcm`` of MP3, M4B and other containers; a null ``pcm`` where decoding failed."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.lit(SAMPLE_RATE).alias("rate"), decode_container("content").alias("pcm"))


def verify_files(spark: SparkSession, path: str) -> DataFrame:
    """Speech report on each file."""
    return from_wav_files(spark, path).select("path", analyze_pcm("pcm", "rate").alias("r")).select("path", "r.*")


def durations(audio: DataFrame) -> DataFrame:
    """Adds ``seconds``."""
    return audio.withColumn("seconds", F.when(F.col("rate") > 0, F.length("pcm") / 2 / F.col("rate")).otherwise(0.0))
