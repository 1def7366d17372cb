"""Manuscripts to chapters: cleaning, splitting at headings, totals, excerpts. All native, no shuffle to split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import text as T

PROLOGUE, ONLY_HEADINGS = "Prologue", "Chapter 1"


def chapter_array(cleaned: Column) -> Column:
    """Chapters of a cleaned text as array of (title, content).

    Without headings there is one untitled chapter; text before the first heading is
    the prologue; a heading without a body is dropped; headings alone give one chapter.
    """
    return T.let(cleaned, lambda text: T.let(T.paragraphs(text), lambda paras: _split(text, paras)))


def _split(text: Column, paras: Column) -> Column:
    is_heading = lambda p: p.startswith("#")
    heads = F.filter(F.transform(paras, lambda p, i: F.when(is_heading(p), i + 1)), lambda i: i.isNotNull())
    title = lambda s: F.when(s == 0, PROLOGUE).otherwise(T.heading_text(F.element_at(paras, F.greatest(s, F.lit(1)))))
    body = lambda s, e: F.array_join(F.slice(paras, s + 1, e - s - 1), "\n\n")
    bounds = T.let(heads, lambda h: F.arrays_zip(F.concat(F.array(F.lit(0)), h).alias("s"), F.concat(h, F.array(F.size(paras) + 1)).alias("e")))
    filled = F.filter(bounds, lambda b: b["e"] - b["s"] > 1)
    split = F.transform(filled, lambda b: F.struct(title(b["s"]).alias("title"), body(b["s"], b["e"]).alias("content")))
    whole = lambda name: F.array(F.struct(F.lit(name).alias("title"), text.alias("content")))
    chosen = T.let(split, lambda found: F.when(F.size(found) == 0, whole(ONLY_HEADINGS)).otherwise(found))
    return (
        F.when(F.size(paras) == 0, F.array(F.struct(F.lit("").alias("title"), F.lit("").alias("content"))))
        .when(~F.exists(paras, is_heading), whole(""))
        .otherwise(chosen)
    )


def clean(manuscripts: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Adds ``cleaned``."""
    return manuscripts.withColumn("cleaned", T.clean_prose(F.col(text_col)))


def split_chapters(manuscripts: DataFrame, text_col: str = "raw_text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, chapter_index, title, content, word_count``."""
    cleaned = clean(manuscripts, text_col).select(id_col, "cleaned")
    found = cleaned.select(id_col, F.posexplode(chapter_array(F.col("cleaned"))).alias("chapter_index", "c"))
    return found.select(id_col, "chapter_index", F.col("c.title").alias("title"), F.col("c.content").alias("content"), T.word_count(F.col("c.content")).alias("word_count"))


def totals(chapters: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Words and chapters of each document."""
    return chapters.groupBy(id_col).agg(F.sum("word_count").alias("total_words"), F.count("*").alias("total_chapters"))


def audition_excerpt(chapters: DataFrame, max_words: int = 1200) -> DataFrame:
    """The first chapter, at most ``max_words`` words of it."""
    all_words = T.words(F.col("content"))
    long = F.size(all_words) > max_words
    cut = F.when(long, F.concat(F.array_join(F.slice(all_words, 1, max_words), " "), F.lit("..."))).otherwise(F.col("content"))
    return chapters.where("chapter_index = 0").withColumn("content", cut).withColumn("title", F.concat("title", F.lit(" (Audition Excerpt)"))).withColumn("word_count", T.word_count(F.col("content")))


def compose(title: Column, content: Column) -> Column:
    """A chapter as text again, its title as a heading."""
    return F.when(title != "", F.concat(F.lit("# "), title, F.lit("\n\n"), content)).otherwise(content)
