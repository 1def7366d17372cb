"""Delivery: spoken text, voice, rate and pitch as columns. All native."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream import fixed
from inkstream.functions.text import normalize_text


@dataclass(frozen=True)
class Profile:
    """A voice profile."""

    primary: str = "en-US-ChristopherNeural"
    secondary: dict[str, str] = field(default_factory=dict)
    rate_offset: str = "+0%"
    pitch_offset: str = "+0Hz"
    volume_offset: str = "+0%"

    @classmethod
    def named(cls, name: str) -> Profile:
        primary, secondary, _, rate = fixed.PROFILES.get(name, fixed.PROFILES["default"])
        return cls(primary, dict(secondary), rate)


def present(x: Column) -> Column:
    """Empty strings count as missing."""
    return F.nullif(x, F.lit(""))


def signed_percent(n: Column) -> Column:
    return F.concat(F.when(n >= 0, "+").otherwise(""), n.cast("string"), F.lit("%"))


def rate(kind: Column, profile: Profile, speed: float = 1.0) -> Column:
    """Rate offset by kind of chunk, plus the speed's, rounded half to even."""
    faster = F.bround((F.lit(speed) - 1.0) * 100).cast("int")
    own = int(profile.rate_offset.replace("%", "").replace("+", "") or 0)
    return signed_percent(F.when(kind == "heading", -4).when(kind == "dialogue", 2).otherwise(own) + faster)


def signed_rate(kind: str, speed: float = 1.0) -> str:
    """As ``rate``, of one chunk on the driver."""
    own = {"heading": -4, "dialogue": 2}.get(kind, 0) + round((speed - 1.0) * 100)
    return f"{own:+d}%"


def pitch(kind: Column, gender: Column, profile: Profile) -> Column:
    return F.when(kind == "heading", "-1Hz").when(kind == "dialogue", F.when(gender == "female", "+1Hz").otherwise("+0Hz")).otherwise(profile.pitch_offset)


def voice(kind: Column, gender: Column, character: Column, override: Column, profile: Profile) -> Column:
    """For dialogue the override, the gender's secondary voice, the character, the primary voice; else without the first two."""
    by_gender = F.lit(None).cast("string")
    for g, v in profile.secondary.items():
        by_gender = F.when(gender == g, v).otherwise(by_gender)
    rest = F.coalesce(present(character), F.lit(profile.primary))
    return F.when(kind == "dialogue", F.coalesce(present(override), by_gender, rest)).otherwise(rest)


def apply(chunks: DataFrame, profile: Profile, speed: float = 1.0, override: Column | None = None) -> DataFrame:
    """Adds ``voice, ssml_rate, ssml_pitch, ssml_volume`` and replaces ``text`` by what is spoken."""
    over = F.lit(None).cast("string") if override is None else override
    return chunks.withColumns({
        "voice": voice(F.col("chunk_type"), F.col("gender"), F.col("character"), over, profile),
        "ssml_rate": rate(F.col("chunk_type"), profile, speed),
        "ssml_pitch": pitch(F.col("chunk_type"), F.col("gender"), profile),
        "ssml_volume": F.lit(profile.volume_offset),
        "text": normalize_text(F.col("text")),
    })


def pacing_table(spark: SparkSession) -> DataFrame:
    kinds = ", ".join(f"{f} {'double' if f == 'speed_multiplier' else 'int'}" for f in fixed.PACING_FIELDS)
    return spark.createDataFrame([(mode, *values.values()) for mode, values in fixed.PACING.items()], f"mode string, {kinds}")


def with_pacing(rows: DataFrame, mode_col: str) -> DataFrame:
    """Joins the preset of each row's mode; unknown modes get the normal one."""
    own = F.when(F.col(mode_col).isin(*fixed.PACING), F.col(mode_col)).otherwise("normal")
    return rows.withColumn("mode", own).join(F.broadcast(pacing_table(rows.sparkSession)), "mode")


def resolve_engine_voice(backend: str, wanted: Column, default: str, character: Column | None = None) -> Column:
    """The voice name a backend understands."""
    if backend == "openai":
        speaker = wanted if character is None else character
        return F.when(speaker.isin(*fixed.OPENAI_VOICES), speaker).otherwise(default)
    table = {"edge": fixed.TO_EDGE, "gemini": fixed.TO_GEMINI}.get(backend, {})
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), wanted) if table else F.lit(None).cast("string")
    return F.coalesce(mapped, present(wanted), F.lit(default))
