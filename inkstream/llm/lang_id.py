"""Language identification by compression with per-language Zstandard dictionaries.

Texts are reduced to lower-case letters and blanks. Each language has a raw-content
dictionary cut from labelled texts. A text is encoded block by block with every dictionary; the language with the smallest sum
wins. The gap to the runner-up, in bytes per block, gives the score; a narrow gap
makes the operator reject the text (``accepted`` is false).

Learning: at most ``docs_per_lang`` labelled rows of each language, those with the
smallest hashes. Their whole texts are cut into pieces of ``excerpt_chars``; each row in turn
gives one piece, in the order of the pieces' hashes, until ``dict_bytes`` are full or all texts are used up.
Equal pieces count once, so that no single passage (a site's header) weighs much. These bounds are
parameters; everything else covers whole texts: a text of any length is encoded in
blocks of ``block_bytes``, so time is linear and memory constant.

Edge cases: a null text or one without a letter is ``und`` with score 0 and not
accepted; equal sums go to the language with more labelled rows, then to the
smaller name, and are not accepted; without labelled rows everything is ``und``; repeated
rows are judged row by row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkstream.llm.common import drop_scratch, materialize, text_batches, tidy

NOT_LETTERS = re.compile(r"[\W\d_]+")
PREDICTED = "doc_id long, lang_pred string, score double, margin_bytes long, accepted boolean"


def letters(text: str) -> bytes:
    """Lower-cased letters, other runs as one blank, in UTF-8."""
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def sample_by_class(rows: DataFrame, class_col: str, key: str, per_class: int, counts: dict) -> DataFrame:
    """At most ``per_class`` rows of each class in ``counts`` (class to number of rows), those of smallest hash.

    The share of hashes that can be among them is known from the counts, so all but
    about ``1.5 * per_class`` rows of a class are filtered out before any exchange.
    """
    if not counts:
        return rows.where(F.lit(False))
    share = F.element_at(F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, 3.0 * per_class / n)]), F.col(class_col))
    near = rows.withColumn("_h", F.xxhash64(F.lit(29), F.col(key).cast("string"))).where(F.col("_h").cast("double") / F.lit(2.0**63) < F.lit(-1.0) + share)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(class_col).orderBy("_h"))).where(F.col("_r") <= per_class).drop("_h", "_r")


def pieces(text: str, key: int, excerpt_chars: int) -> list[str]:
    """The letters of a whole text in pieces of ``excerpt_chars``, in an order set by hashes of the key and the place."""
    plain = letters(text).decode("utf-8")
    found = [plain[i : i + excerpt_chars] for i in range(0, len(plain), excerpt_chars)]
    order = sorted(range(len(found)), key=lambda k: hashlib.blake2b(b"%d %d" % (key, k), digest_size=8).digest())
    return [found[k] for k in order]


def learn(docs: DataFrame, docs_per_lang: int = 1200, dict_bytes: int = 131072, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int = 1000, excerpt_chars: int = 128) -> list[tuple[str, bytes]]:
    """(language, dictionary) pairs, most frequent language first; more than ``max_languages`` is an error, as each text is encoded once for each."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return []
    chosen = sample_by_class(rows.select("id", "lang"), "lang", "id", docs_per_lang, counts)
    texts = F.broadcast(chosen.distinct()) if len(counts) * docs_per_lang <= 1_000_000 else chosen.distinct()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, key, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                cuts = pieces(text, key, excerpt_chars)
                yield pa.record_batch([pa.array([lang] * len(cuts), pa.string()), pa.array(range(len(cuts)), pa.int32()), pa.array([key] * len(cuts), pa.int64()), pa.array(cuts, pa.string())], ["lang", "turn", "h", "cut"])

    cuts = rows.join(texts, ["id", "lang"]).select("lang", F.xxhash64("id").alias("h"), "text").mapInArrow(tidy(spell), "lang string, turn int, h long, cut string")
    cuts = materialize(cuts.groupBy("lang", "cut").agg(F.min(F.struct("turn", "h")).alias("at")).select("lang", "at.*", "cut"), "excerpts")
    # the turn in which each dictionary is full
    last: dict[str, int] = {}
    size: dict[str, int] = {}
    for r in cuts.groupBy("lang", "turn").agg(F.sum(F.octet_length("cut") + 1).alias("n")).orderBy("lang", "turn").toLocalIterator():
        if size.get(r.lang, 0) < dict_bytes:
            last[r.lang], size[r.lang] = r.turn, size.get(r.lang, 0) + r.n
    found: dict[str, list[tuple[int, int, bytes]]] = {}
    if last:
        needed = F.col("turn") <= F.element_at(F.create_map(*[F.lit(x) for pair in last.items() for x in pair]), F.col("lang"))
        for r in cuts.where(needed).toLocalIterator():
            found.setdefault(r.lang, []).append((r.turn, r.h, r.cut.encode()))
    drop_scratch(docs.sparkSession, cuts)
    return [(lang, b"\n".join(cut for _, _, cut in sorted(found[lang]))[:dict_bytes]) for lang in counts if lang in found]


class Classifier:
    """Encodes blocks with every language's dictionary."""

    def __init__(self, dicts: list[tuple[str, bytes]], block_bytes: int = 4096) -> None:
        import zstandard as zstd

        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        params = zstd.ZstdCompressionParameters(window_log=19, chain_log=17, hash_log=17, search_log=3, min_match=4, strategy=zstd.STRATEGY_GREEDY, target_length=32, **plain)
        self.block, self.langs = block_bytes, [lang for lang, _ in dicts]
        self.coders = []
        for _, raw in dicts:
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.coders.append(zstd.ZstdCompressor(compression_params=params, dict_data=d))

    def sizes(self, raw: bytes) -> list[int]:
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)] if len(raw) > self.block else [raw]
        return [sum(map(len, map(c.compress, blocks))) for c in self.coders]

    def predict(self, text: str | None, min_margin: float) -> tuple[str, float, int, bool]:
        """Language, score, gap in bytes, accepted."""
        raw = letters(text) if text else b""
        if not raw or not self.coders or not any(map(str.isalpha, text)):
            return "und", 0.0, 0, False
        got = self.sizes(raw)
        order = sorted(range(len(got)), key=lambda k: (got[k], k))
        best = got[order[0]]
        gap = got[order[1]] - best if len(got) > 1 else best
        per_block = gap / (1 + len(raw) // self.block)
        score = 1.0 / sum(math.exp(max(-60.0, -(got[k] - best) / (1 + len(raw) // self.block) / 4.0)) for k in order)
        return self.langs[order[0]], score, gap, per_block >= min_margin


def identify(docs: DataFrame, dicts: list[tuple[str, bytes]], min_margin: float = 1.0, block_bytes: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, lang_pred, score, margin_bytes, accepted``.

    ``min_margin`` is the least gap to the runner-up in bytes per block.
    """
    text_batches(docs.sparkSession)
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return held.mapInArrow(tidy(_runner(docs, dicts, min_margin, block_bytes)), PREDICTED)


def keep_identified(docs: DataFrame, dicts: list[tuple[str, bytes]], min_margin: float = 1.0, block_bytes: int = 4096, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The accepted rows with all their columns, ``lang`` set to the language predicted; one pass, no shuffle."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dicts)
    at = docs.columns.index(text_col)
    schema = StructType([StructField(f.name, StringType()) if f.name == lang_col else f for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(shared.value, block_bytes)
        for b in batches:
            got = [c.predict(x.as_py(), min_margin) for x in b.column(at)]
            cols = [pa.array([g[0] for g in got], pa.string()) if name == lang_col else b.column(k) for k, name in enumerate(b.schema.names)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array([g[3] for g in got], pa.bool_()))

    return docs.mapInArrow(tidy(run), schema)


def _runner(docs: DataFrame, dicts: list[tuple[str, bytes]], min_margin: float, block_bytes: int):
    shared = docs.sparkSession.sparkContext.broadcast(dicts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(shared.value, block_bytes)
        for b in batches:
            got = [c.predict(x.as_py(), min_margin) for x in b.column(b.num_columns - 1)]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.bool_()))]
            yield pa.record_batch([b.column(0), *cols], ["doc_id", "lang_pred", "score", "margin_bytes", "accepted"])

    return run
