"""Benchmark decontamination: one Aho-Corasick automaton over normalised windows.

Benchmark items (test questions and answers) are lower-cased in A-Z and cut into
words, maximal runs of ``[0-9a-z]`` and of characters beyond ASCII. Every window
of ``window`` consecutive words (a shorter item is one window) becomes a pattern
of a single automaton. A document is normalised by one byte translation, scanned
once, and hits are mapped back to word numbers and to byte offsets of the
original text.

Scale: an automaton takes about 45 times the bytes of its patterns, in every Python worker, so
patterns are bounded by ``max_pattern_bytes`` (8 MB, about 350 MB a worker). More are split by hash into blocks,
taken one after the other: an automaton is built, broadcast, used and dropped before the next one, and what a scan
finds is written to the shared folder, keyed by the document's id and the hash of its text. Such keys are the same
in every scan, wherever rows come from. One block needs no shuffle; several need one of the hits.

Edge cases: null or word-free texts have no words and no hits; null or word-free
items give no window; items with equal text share their windows and are all
reported; repeated document rows are judged row by row; rows of one id with other texts keep their own hits; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.llm.common import materialize, text_batches, tidy

WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))

MAX_PATTERN_BYTES = 8_000_000

HITS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("row_hash", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.LongType())),
    T.StructField("byte_spans", T.ArrayType(T.LongType())),
    T.StructField("item_ids", T.ArrayType(T.LongType())),
])


def words_of(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(WORD_BYTES).split()


def windows_of(words: list[bytes], window: int) -> set[bytes]:
    """All windows of an item, each as its words joined by single blanks."""
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def original_offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the words in the original UTF-8 text."""
    inside = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edges[0::2], edges[1::2]


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """Distinct windows with the sorted ids of the items that hold them: ``pattern``, ``item_ids``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, patterns = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for p in windows_of(words_of(text or b""), window):
                    ids.append(item)
                    patterns.append(p)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(patterns, pa.binary())], ["item_id", "pattern"])

    cut_up = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(tidy(cut), "item_id long, pattern binary")
    return cut_up.groupBy("pattern").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def build_automaton(patterns: list[tuple[bytes, list[int]]]):
    """The automaton; each value is (number of words, ids of items)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for pattern, ids in patterns:
        automaton.add_word(" " + pattern.decode("latin-1") + " ", (pattern.count(b" ") + 1, tuple(ids)))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def scan_text(automaton, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, merged hit word spans [from, to), and ids of items found, in one pass."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), [], set()
    found = list(automaton.iter(" " + b" ".join(words).decode("latin-1") + " "))
    if not found:
        return len(words), [], set()
    ends = np.cumsum([len(w) + 1 for w in words])  # offset of the blank after each word
    spans, items = [], set()
    last = np.searchsorted(ends, [end for end, _ in found])
    for to, (_, (n, ids)) in zip(last + 1, found, strict=True):
        items.update(ids)
        spans.append((int(to) - n, int(to)))
    merged: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(z, merged[-1][1]))
        else:
            merged.append((a, z))
    return len(words), merged, items


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row_hash, text``; rows of equal id and hash have equal hits."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).cast("binary").alias("text"))


def scan(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text", only_hits: bool = False) -> DataFrame:
    """Scan every whole text once with the automaton of a broadcast list of patterns."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton(shared.value)
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for text in b.column(2):
                raw = text.as_py() or b""
                n, spans, items = scan_text(automaton, raw)
                out[0].append(n)
                out[1].append([x for s in spans for x in s])
                if spans:
                    starts, ends = original_offsets(raw)
                    out[2].append([int(x) for a, z in spans for x in (starts[a], ends[z - 1])])
                else:
                    out[2].append([])
                out[3].append(sorted(items))
            found = pa.record_batch([b.column(0), b.column(1), pa.array(out[0], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in out[1:])], HITS.names)
            yield found.filter(pa.array([bool(x) for x in out[1]], pa.bool_())) if only_hits else found

    return _keyed(docs, id_col, text_col).mapInArrow(tidy(run), HITS)


def pattern_blocks(items: DataFrame, window: int = 10, max_pattern_bytes: int = MAX_PATTERN_BYTES, item_col: str = "item_id", item_text_col: str = "text") -> tuple[int, Callable[[int], list[tuple[bytes, list[int]]]]]:
    """Number of blocks of about ``max_pattern_bytes`` (one at least), and a function that reads the windows of a block with their items."""
    windows = materialize(item_windows(items, item_col, item_text_col, window), "windows")
    total = windows.agg(F.sum(F.length("pattern") + 8 * F.size("item_ids"))).first()[0] or 0
    blocks = max(1, -(-int(total) // max_pattern_bytes))

    def read(k: int) -> list[tuple[bytes, list[int]]]:
        block = windows.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k) if blocks > 1 else windows
        return [(bytes(r.pattern), list(r.item_ids)) for r in block.toLocalIterator()]

    return blocks, read


def block_hits(docs: DataFrame, blocks: int, read: Callable[[int], list], id_col: str, text_col: str) -> DataFrame:
    """Hits of all blocks of patterns, one automaton at a time: a row for each block and document row with a hit."""
    found = None
    for k in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(read(k))
        part = materialize(scan(docs, shared, id_col, text_col, True), f"hits-{k}")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10, max_pattern_bytes: int = MAX_PATTERN_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows without any hit, with all their columns."""
    text_batches(docs.sparkSession)
    blocks, read = pattern_blocks(items, window, max_pattern_bytes, item_col, item_text_col)
    if blocks > 1:
        hits = block_hits(docs, blocks, read, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")).distinct()
        keyed = docs.withColumns({"_id0": F.col(id_col).cast("long"), "_hash0": F.xxhash64(text_col)})
        return keyed.join(hits, F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_hash0") == F.col("_hash")), "left_anti").select(docs.columns)
    shared, at = docs.sparkSession.sparkContext.broadcast(read(0)), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton(shared.value)
        for b in batches:
            yield b.filter(pa.array([not scan_text(automaton, (x.as_py() or "").encode("utf-8", "replace"))[1] for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def _count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([len(words_of(x.as_py() or b"")) for x in b.column(2)], pa.int64())], ["doc_id", "row_hash", "n_words"])

    return _keyed(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, row_hash long, n_words long")


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, max_pattern_bytes: int = MAX_PATTERN_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Per document row: ``doc_id, n_words, hit_spans, byte_spans, item_ids``.

    ``hit_spans`` and ``byte_spans`` hold flattened [from, to) pairs in words and
    in bytes of the original text; ``item_ids`` are the sorted ids of the items
    with a window in the text.
    """
    blocks, read = pattern_blocks(items, window, max_pattern_bytes, item_col, item_text_col)
    if blocks == 1:
        return scan(docs, docs.sparkSession.sparkContext.broadcast(read(0)), id_col, text_col).drop("row_hash")
    hits = block_hits(docs, blocks, read, id_col, text_col).distinct()  # repeated rows have equal hits
    merged = hits.groupBy("doc_id", "row_hash").agg(
        F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.flatten(F.collect_list("byte_spans")).alias("byte_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    ).select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), _merge("hit_spans").alias("hit_spans"), _merge("byte_spans").alias("byte_spans"), "item_ids")
    rows = _count_words(docs, id_col, text_col).join(merged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash")), "left")
    none = F.array().cast("array<long>")
    return rows.select("doc_id", "n_words", *[F.coalesce(c, none).alias(c) for c in ("hit_spans", "byte_spans", "item_ids")])


def _merge(col: str) -> F.Column:
    """Merge overlapping flattened [from, to) pairs; gaps between words are kept."""

    @F.pandas_udf("array<long>")
    def merge(series):
        def one(flat):
            out: list[int] = []
            for a, z in sorted(zip(flat[0::2], flat[1::2], strict=True)):
                if out and a <= out[-1]:
                    out[-1] = max(out[-1], z)
                else:
                    out += [a, z]
            return out

        return series.map(one)

    return merge(F.col(col))


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns: counts, digest of item ids, verdict."""
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("hit_spans") - 1), F.lit(0).cast("long"), lambda a, i: a + F.when(i % 2 == 1, 1).otherwise(-1) * F.element_at("hit_spans", (i + 1).cast("int")))
    ids = F.concat_ws(",", F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))))
    hit = F.when(F.size("hit_spans") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return hits.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def sha256_of(ids: list[int]) -> str:
    """Digest of item ids as the contract states it."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
