"""Chapters to chunks: headings, breaks, narration and dialogue of speakable length, with pauses. All native, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstream import fixed
from inkstream.functions import text as T
from inkstream.operators.chapters import compose

BREAKS = ("*", "* * *", "---", "***")
HEADING, BREAK, DIALOGUE, NARRATION = "heading", "section_break", "dialogue", "narration"


@dataclass(frozen=True)
class Pauses:
    """Milliseconds of silence that chunks ask for."""

    heading_before: int = fixed.HEADING_BEFORE_MS
    heading_after: int = fixed.HEADING_AFTER_MS
    section: int = fixed.BREAK_AFTER_MS
    mid: int = fixed.MID_MS
    dialogue: int = fixed.DIALOGUE_MS
    narration_last: int = fixed.NARRATION_LAST_MS
    paragraph: int = fixed.PARAGRAPH_MS

    @classmethod
    def of_pacing(cls, mode: str) -> Pauses:
        """Pauses as a pacing preset has them."""
        own = fixed.PACING.get(mode, fixed.PACING["normal"])
        return cls(section=own["chapter_pause_ms"], mid=own["sentence_pause_ms"], dialogue=own["dialogue_turnaround_ms"], narration_last=own["sentence_pause_ms"], paragraph=own["paragraph_pause_ms"])


def segments(paragraph: Column) -> Column:
    """Narration and dialogue in turn, as array of (text, chunk_type); blank pieces are dropped.

    A quotation may open and close with straight or curly quotes in any mix; an
    unmatched opening quote stays narration.
    """
    gaps, quotes = F.split(paragraph, fixed.QUOTED, -1), F.regexp_extract_all(paragraph, F.lit(fixed.QUOTED), F.lit(0))
    pair = F.zip_with(
        gaps, quotes, lambda g, q: F.array(F.struct(T.strip(g).alias("text"), F.lit(NARRATION).alias("chunk_type")), F.struct(T.strip(F.substring(q, F.lit(2), F.length(q) - 2)).alias("text"), F.lit(DIALOGUE).alias("chunk_type")))
    )
    return F.filter(F.flatten(pair), lambda s: F.coalesce(s["text"], F.lit("")) != "")


def pack_starts(counts: Column, target: int) -> Column:
    """1-based numbers of the sentences that open a pack, filling packs greedily up to ``target`` words."""
    state = lambda n, starts: F.struct(n.cast("int").alias("n"), starts.alias("starts"))
    step = lambda acc, x: F.when(
        (F.size(acc["starts"]) > 0) & (acc["n"] + x["count"] <= target), state(acc["n"] + x["count"], acc["starts"])
    ).otherwise(state(x["count"], F.concat(acc["starts"], F.array(x["pos"]))))
    numbered = F.transform(counts, lambda c, i: F.struct(c.cast("int").alias("count"), (i + 1).cast("int").alias("pos")))
    return F.aggregate(numbered, state(F.lit(0), F.array().cast("array<int>")), step, lambda acc: acc["starts"])


def pack(text: Column, target: int) -> Column:
    """Sentences of a long segment, joined into packs; one long sentence is never split."""
    return T.let(T.sentences(text), lambda parts: _pack(parts, target))


def _pack(parts: Column, target: int) -> Column:
    starts = pack_starts(F.transform(parts, T.word_count), target)
    bounds = T.let(starts, lambda s: F.arrays_zip(s.alias("s"), F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.size(parts) + 1)).alias("e")))
    return F.transform(bounds, lambda b: T.strip(F.array_join(F.slice(parts, b["s"], b["e"] - b["s"]), " ")))


def _chunk(text: Column, kind: Column, before: Column, after: Column) -> Column:
    return F.struct(text.alias("text"), kind.alias("chunk_type"), before.cast("int").alias("pause_before_ms"), after.cast("int").alias("pause_after_ms"))


def segment_chunks(segment: Column, target: int, most: int, pauses: Pauses) -> Column:
    """Chunks of one segment."""
    text, kind = segment["text"], segment["chunk_type"]
    spoken = kind == DIALOGUE
    whole = F.array(_chunk(text, kind, F.lit(0), F.when(spoken, pauses.dialogue).otherwise(pauses.mid)))
    last = F.when(spoken, pauses.dialogue).otherwise(pauses.narration_last)
    many = T.let(pack(text, target), lambda packs: F.transform(packs, lambda p, i: _chunk(p, kind, F.lit(0), F.when(i == F.size(packs) - 1, last).otherwise(pauses.mid))))
    return F.when(T.longer_than(text, most), many).otherwise(whole)


def paragraph_chunks(paragraph: Column, target: int = fixed.TARGET_WORDS, most: int = fixed.MAX_WORDS, pauses: Pauses = Pauses()) -> Column:
    """Chunks of one paragraph; the last of prose pauses for a paragraph at least."""
    heading = F.array(_chunk(T.heading_text(paragraph), F.lit(HEADING), F.lit(pauses.heading_before), F.lit(pauses.heading_after)))
    pause = F.array(_chunk(F.lit(""), F.lit(BREAK), F.lit(0), F.lit(pauses.section)))
    prose = F.flatten(F.transform(segments(paragraph), lambda s: segment_chunks(s, target, most, pauses)))
    longer = lambda c: F.greatest(c["pause_after_ms"], F.lit(pauses.paragraph))
    bumped = T.let(prose, lambda all_: F.transform(all_, lambda c, i: _chunk(c["text"], c["chunk_type"], c["pause_before_ms"], F.when(i == F.size(all_) - 1, longer(c)).otherwise(c["pause_after_ms"]))))
    return F.when(paragraph.startswith("#"), heading).when(paragraph.isin(*BREAKS), pause).otherwise(bumped)


def chunk_chapters(chapters: DataFrame, target: int = fixed.TARGET_WORDS, most: int = fixed.MAX_WORDS, pauses: Pauses = Pauses(), id_col: str = "doc_id") -> DataFrame:
    """``doc_id, chapter_index, chunk_index, chunk_type, text, pause_before_ms, pause_after_ms``."""
    paras = T.paragraphs(compose(F.col("title"), F.col("content")))
    per_chapter = chapters.select(id_col, "chapter_index", F.flatten(F.transform(paras, lambda p: paragraph_chunks(p, target, most, pauses))).alias("chunks"))
    out = per_chapter.select(id_col, "chapter_index", F.posexplode("chunks").alias("chunk_index", "c"))
    return out.select(id_col, "chapter_index", "chunk_index", "c.chunk_type", "c.text", "c.pause_before_ms", "c.pause_after_ms")


def with_sequence(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``seq``, the place in the document from 0."""
    return chunks.withColumn("seq", (F.row_number().over(Window.partitionBy(id_col).orderBy("chapter_index", "chunk_index")) - 1).cast("long"))


def with_neighbours(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``previous`` and ``following``: the narration right before and after, null where something else stands."""
    order = Window.partitionBy(id_col).orderBy("seq")
    told = F.when(F.col("chunk_type") == NARRATION, F.col("text"))
    return chunks.withColumns({"previous": F.lag(told).over(order), "following": F.lead(told).over(order)})


def totals(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pauses and number of chunks of each chapter."""
    return chunks.groupBy(id_col, "chapter_index").agg(F.sum("pause_before_ms").alias("before_ms"), F.sum("pause_after_ms").alias("after_ms"), F.count("*").alias("chunks"))
