"""Voices for characters: greedy colouring of the interaction graph, one document at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream import fixed

RESERVED = ("Narrator", "heading", "section_break")


def pools(backend: str) -> dict[str, list[str]]:
    return fixed.VOICE_POOLS["gemini" if backend.lower() == "gemini" else "edge"]


def pool_table(spark: SparkSession) -> DataFrame:
    """``engine, pool, pos, voice``: all voices in order of preference."""
    rows = [(e, p, k, v) for e, by in fixed.VOICE_POOLS.items() for p, voices in by.items() for k, v in enumerate(voices)]
    return spark.createDataFrame(rows, "engine string, pool string, pos int, voice string")


def colour(names: list[str], genders: list[str], lines: list[int], locked: list[str | None], peers: list[list[str]], backend: str, narrator: str | None = None) -> dict[str, str]:
    """Role to voice. Most lines choose first; unused slots of the gender's pool before used ones, never a partner's voice unless the pool is exhausted."""
    own = pools(backend)
    voices = dict.fromkeys(RESERVED, narrator or own["narrator"][0])
    held = {n: v for n, v in zip(names, locked, strict=True) if v}
    voices |= held
    taken: dict[str, set[str]] = {"male": set(), "female": set(), "neutral": set()}
    for k in sorted((k for k, n in enumerate(names) if n not in voices), key=lambda k: (-lines[k], names[k])):
        kind = genders[k] if genders[k] in ("male", "female") else "neutral"
        near = {held[p] for p in peers[k] if p in held}
        free = [v for v in own[kind] if v not in near]
        fresh = [v for v in free if v not in taken[kind]]
        choice = (fresh or free or own[kind])[0]
        if fresh:
            taken[kind].add(choice)
        voices[names[k]] = held[names[k]] = choice
    return voices


def cast_voices(characters: DataFrame, backend: str = "gemini", narrator: str | None = None, id_col: str = "doc_id", documents: DataFrame | None = None) -> DataFrame:
    """``doc_id, role, voice`` for every document with a character; with ``documents``, for all of those: without characters they get the reserved roles."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        doc_id = pdf[id_col].iloc[0]
        pdf = pdf[pdf.name.notna()].sort_values("name")
        locked = [v if isinstance(v, str) and v else None for v in pdf.assigned_voice]
        found = colour(pdf.name.tolist(), pdf.gender.tolist(), pdf.line_count.tolist(), locked, [list(p) for p in pdf.interacts_with], backend, narrator)
        return pd.DataFrame({id_col: doc_id, "role": list(found), "voice": list(found.values())})

    rows = characters.select(id_col, "name", "gender", "line_count", "assigned_voice", "interacts_with")
    if documents is not None:
        rows = documents.select(id_col).distinct().join(rows, id_col, "left")
    return rows.groupBy(id_col).applyInPandas(one, f"{id_col} long, role string, voice string")


def partners(edges: DataFrame, voices: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Partners with the voice of each."""
    a = voices.select(id_col, F.col("role").alias("a"), F.col("voice").alias("voice_a"))
    b = voices.select(id_col, F.col("role").alias("b"), F.col("voice").alias("voice_b"))
    return edges.join(a, [id_col, "a"]).join(b, [id_col, "b"])


def conflicts(edges: DataFrame, voices: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Partners that share a voice."""
    return partners(edges, voices, id_col).where("voice_a = voice_b")
