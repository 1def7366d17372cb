"""Offsets of chunks, chapter marks and the whole signal of a document. Native; audio is assembled only at a sink."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstream.fixed import SAMPLE_RATE
from inkstream.functions.dsp import FADE_MS, from_wav, join_faded, ms_to_samples, samples_to_ms, trim

MISSING_MS = 300


def offsets(n: Column, pause: Column, missing: Column, fade: int, total: Column, keep_pauses: bool = False) -> Column:
    """Length of the signal after one more chunk: crossfaded, then its pause; silence for a missing one, nothing for an empty one (or its pause, if asked)."""
    overlap = F.least(F.lit(fade).cast("long"), total, n)
    quiet = ms_to_samples(F.greatest(F.lit(MISSING_MS), pause)).cast("long")
    gap = F.when(pause > 0, ms_to_samples(pause)).otherwise(0).cast("long")
    return F.when(missing, total + quiet).when(n == 0, total + gap if keep_pauses else total).otherwise(total + n - overlap + gap)


def place(chunks: DataFrame, fade_ms: int = FADE_MS, keep_pauses: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Adds ``start`` and ``end``, in samples; chunks need ``seq, n_samples`` (null if missing), ``pause_after_ms``.

    Once the signal is as long as a fade, every overlap is known from the chunk alone and
    offsets are running sums; the chunks before that are few, and only those are folded.
    ``keep_pauses`` lets silent chunks, such as section breaks, keep their pause.
    """
    fade = int(fade_ms / 1000.0 * SAMPLE_RATE)
    order = Window.partitionBy(id_col).orderBy("seq")
    n, missing = F.coalesce(F.col("n_samples").cast("long"), F.lit(0).cast("long")), F.col("n_samples").isNull()
    alone = offsets(n, F.col("pause_after_ms"), missing, 0, F.lit(0).cast("long"), keep_pauses)
    # a lower bound of the signal so far: every chunk overlaps in full
    least = F.sum(alone - F.when(missing | (n == 0), 0).otherwise(F.least(F.lit(fade).cast("long"), n))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = chunks.withColumns({"_n": n, "_settled": F.coalesce(least, F.lit(0)) >= fade, "_alone": alone, "_missing": missing})
    opening = F.collect_list(F.when(~F.col("_settled"), F.struct("_n", "pause_after_ms", "_missing"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    folded = F.aggregate(opening, F.lit(0).cast("long"), lambda total, c: offsets(c["_n"], c["pause_after_ms"], c["_missing"], fade, total, keep_pauses))
    own = F.col("_alone") - F.when(F.col("_missing") | (F.col("_n") == 0), 0).otherwise(F.least(F.lit(fade).cast("long"), F.col("_n")))
    settled = F.coalesce(F.sum(F.when(F.col("_settled"), own)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    placed = rows.withColumn("end", folded + settled)
    return placed.withColumn("start", F.coalesce(F.lag("end").over(order), F.lit(0).cast("long"))).drop("_n", "_settled", "_alone", "_missing")


def chapter_marks(placed: DataFrame, titles: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, ord, chapter_index, title, start_ms, end_ms``: a mark opens at every heading and change of chapter, and lasts to the next."""
    order = Window.partitionBy(id_col).orderBy("seq")
    opens = (F.col("chunk_type") == "heading") | F.col("_before").isNull() | (F.col("_before") != F.col("chapter_index"))
    ends = F.max("end").over(Window.partitionBy(id_col))
    marks = placed.withColumns({"_before": F.lag("chapter_index").over(order), "_total": ends}).where(opens)
    if titles is not None:
        marks = marks.join(titles.select(id_col, "chapter_index", F.col("title").alias("_title")), [id_col, "chapter_index"], "left")
    else:
        marks = marks.withColumn("_title", F.lit(None).cast("string"))
    title = F.when(F.col("chunk_type") == "heading", F.col("text")).otherwise(F.coalesce("_title", F.concat(F.lit("Chapter "), (F.col("chapter_index") + 1).cast("string"))))
    to_ms = lambda c: samples_to_ms(c).cast("long")
    return marks.select(id_col, (F.row_number().over(order) - 1).alias("ord"), "chapter_index", title.alias("title"), to_ms(F.col("start")).alias("start_ms"), to_ms(F.coalesce(F.lead("start").over(order), "_total")).alias("end_ms"))


def chapter_at(marks: DataFrame, times: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The marks that hold each time: ``start_ms <= t_ms < end_ms``, an end of zero meaning open."""
    end = F.when(F.col("end_ms") == 0, F.lit(float("inf"))).otherwise(F.col("end_ms").cast("double"))
    return times.join(marks, id_col).where((F.col("t_ms") >= F.col("start_ms")) & (F.col("t_ms") < end))


def assemble(sounds: list[bytes | None], pauses: list[int], fade_ms: int = FADE_MS, wav: bool = False, keep_pauses: bool = False) -> np.ndarray:
    """The signal of one document, for a sink."""
    parts: list[np.ndarray] = []
    tail = np.zeros(0, np.int16)  # kept apart, so that joining costs what is joined
    fade = int(fade_ms / 1000.0 * SAMPLE_RATE)
    for sound, pause in zip(sounds, pauses, strict=True):
        if sound is None:
            tail = np.concatenate((tail, np.zeros(int(max(MISSING_MS, pause) / 1000.0 * SAMPLE_RATE), np.int16)))
        else:
            own = trim(from_wav(sound)[1] if wav else np.frombuffer(sound, "<i2"))
            if not len(own) and not keep_pauses:
                continue
            tail = join_faded(tail, own, fade) if len(tail) else own
            if pause > 0:
                tail = np.concatenate((tail, np.zeros(int(pause / 1000.0 * SAMPLE_RATE), np.int16)))
        if len(tail) > 4 * fade:
            parts.append(tail[:-fade] if fade else tail)
            tail = tail[len(tail) - fade :] if fade else tail[:0]
    return np.concatenate((*parts, tail))
