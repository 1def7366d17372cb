"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash. The mix of a source is: ``copies`` whole passes
over it plus all documents whose hash lies below the source's threshold. The
threshold is found without sorting: sum words by source and hash bucket, walk the
buckets to the one in which the budget is used up, refine only that bucket, and
so on. Thresholds are nested: a larger budget keeps all that a smaller one took.
The document on the threshold gives only as many words as are left, so a source
meets its budget to the word; documents that share that very hash (repeated ids)
share the rest in proportion to their sizes.

Targets: sources in code-point order (null last) get the weights in turn; a
target above ``max_repeat`` times its source's size is cut there and the excess
goes to the others by weight, until none is above.

Scale: one pass reads the texts; all later passes read (source, hash, size) rows
from a scratch table. Sums are partial before each shuffle, a window holds at most
one row for each bucket of one source, and the driver gets scalars only.

Edge cases: null text has size 0; a source without words has target 0; null
source is a source of its own; a null id hashes like the text ``null``; repeated
rows are taken alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstream.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS = 12
HASH_BITS = 60


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """Per row: doc_id, source, skey (never null), size in words, h in [0, 2**60): the first digits of the MD5 of seed and id, as any engine computes it."""
    source = F.col(source_col).cast("string")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return docs.select(
        F.col(id_col).alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), F.lit(HASH_BITS // 4)), 16, 10).cast("long").alias("h"),
    )


def _ranked(per_source: DataFrame) -> DataFrame:
    """Adds ``rank``, the place in code-point order with null last, without one task for all rows."""
    ordered = materialize(per_source.orderBy(F.col("source").isNull(), "source").withColumn("mid", F.monotonically_increasing_id()), "sources")
    counts = {r.p: r.n for r in ordered.groupBy(F.shiftright("mid", 33).alias("p")).agg(F.count("*").alias("n")).toLocalIterator()}
    offsets, seen = [], 0
    for p in sorted(counts):
        offsets += [F.lit(p), F.lit(seen)]
        seen += counts[p]
    if not offsets:
        return ordered.withColumn("rank", F.lit(0).cast("long"))
    start = F.element_at(F.create_map(*offsets), F.shiftright("mid", 33))
    return ordered.withColumn("rank", start.cast("long") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)))


def targets(per_source: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3, share: float = 1.0) -> DataFrame:
    """Adds the word target of every source to rows of (skey, source, source_size)."""
    ranked = _ranked(per_source)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = ranked.select("skey", "source", "source_size", weight.alias("w"), (F.col("source_size") * max_repeat).alias("cap"))
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while total:
        above = F.col("cap") <= F.lit(level) * F.col("w")
        fixed, free = rows.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("w")))).first()
        if not free:
            break
        raised = (total - (fixed or 0)) / free
        if raised <= level:
            break
        level = raised
    return rows.select("skey", "source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w")).alias("target"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3, share: float = 1.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Per row: ``doc_id, source, size, source_size, target, taken`` (words, repeats counted)."""
    base = materialize(sizes(docs, id_col, text_col, source_col, seed), "mix-sizes")
    per_source = base.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    want = targets(per_source, weights, max_repeat, share)
    copies = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    # lo: hashes below are taken whole; [lo, lo + width) still holds the threshold; left: words still to take there
    state = materialize(want.withColumn("copies", copies).withColumn("left", (F.round("target") - F.col("copies") * F.col("source_size")).cast("long")).withColumn("lo", F.lit(0).cast("long")).withColumn("held", F.col("source_size")).withColumn("open", F.col("left") > 0), "mix-state")
    for k in range(1, HASH_BITS // LEVEL_BITS + 1):
        if not state.where("open").limit(1).count():
            break
        width, below = 1 << (HASH_BITS - LEVEL_BITS * (k - 1)), 1 << (HASH_BITS - LEVEL_BITS * k)
        live = state.where("open").select("skey", "left", "lo")
        inside = base.where("size > 0").join(live, "skey").where((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + F.lit(width)))
        buckets = inside.groupBy("skey", "left", F.shiftright("h", HASH_BITS - LEVEL_BITS * k).alias("b")).agg(F.sum("size").alias("words"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        walked = buckets.withColumn("cum", F.sum("words").over(Window.partitionBy("skey").orderBy("b")))
        edge = walked.where((F.col("cum") > F.col("left")) & (F.col("cum") - F.col("words") <= F.col("left"))).select(
            "skey", (F.col("left") - F.col("cum") + F.col("words")).alias("left2"), F.when(F.col("h0") == F.col("h1"), F.col("h0")).otherwise(F.col("b") * F.lit(below)).alias("lo2"), F.col("words").alias("held2"), (F.col("h0") != F.col("h1")).alias("open2")
        )
        state = materialize(
            state.join(edge, "skey", "left").select(
                "skey", "source", "source_size", "target", "copies", F.coalesce("left2", "left").alias("left"), F.coalesce("lo2", "lo").alias("lo"), F.coalesce("held2", "held").alias("held"),
                F.when(F.col("open"), F.coalesce("open2", F.lit(False)) & (F.coalesce("left2", F.lit(0)) > 0)).otherwise(False).alias("open"),
            ), "mix-state",
        )
    chosen = base.join(state.select("skey", "source_size", "target", "copies", "left", "lo", "held"), "skey")
    part = F.when(F.col("h") < F.col("lo"), F.col("size")).when((F.col("h") == F.col("lo")) & (F.col("held") > 0), F.expr("size * left div held")).otherwise(F.lit(0).cast("long"))
    return chosen.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + part).cast("long").alias("taken"))
