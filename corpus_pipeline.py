"""A corpus pipeline of five stages; each reads what the one before it wrote.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame. All but the last return the columns of ``documents`` and no
others: columns that ``docs`` has besides are dropped. Every stage takes nulls in any column, texts of
any length (read whole), repeated rows and empty tables (which give none).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm import decontaminate, jaccard_join, lang_id, mixing, suffix_dedup
from inkstream.llm.common import materialize, table
from inkstream.llm.queries import remainder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay, under the language predicted; rejected ones go.

    Null texts and texts without a letter go (their language is undetermined), as do ties between languages; repeated
    rows are judged alike; a null id or label is no reason to go.
    """
    dicts = lang_id.learn(docs.where(remainder(4) != 2))
    return lang_id.keep_identified(docs.select(COLUMNS), dicts)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays, as one row even if that row is repeated.

    Rows are judged, not ids: an id's other, different text keeps its place. Rows with a null id or
    without words (null and empty texts) can't be linked and stay.
    """
    return jaccard_join.keep_one(docs.select(COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds are cut out; documents of which nothing is left go.

    A null id counts as larger than all others; rows that share an id never cut each other; null, empty and
    blank texts, of which nothing was cut, stay as they are.
    """
    cut = suffix_dedup.remove_repeats(docs.select(COLUMNS), keep_text=True, carry=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    left = cut.where(~changed | F.col("kept").rlike(r"\S"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; repeated rows are judged alike.
    """
    return decontaminate.keep_clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes.

    Every row gets its own number, null and empty texts 0; a null source is a source of its own, last in order; rows
    of equal hash at the threshold share what is left in proportion to their sizes.
    """
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: No SQL states compression, LSH and suffix stages; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
