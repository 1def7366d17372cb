"""Suffix-array dedup: distributed merge sort of front-coded suffix runs with loser trees.

A byte is removed if it lies in a string of ``length`` bytes that also starts in a
document with a smaller id. The suffix array is sparse: of all positions only
anchors are sorted, so this is not a full suffix array: a string's anchor is the position of its least ``k``-byte hash
(leftmost on ties), equal strings have equal anchors at equal offsets, and one
sorted suffix stands for all strings anchored there. Hashes only choose anchors, partitions and what can't match;
that two strings are equal is decided by their bytes.

1. Texts are packed into blocks. Every block sends the hashes at its anchors, once
   each; an anchor whose ``k`` bytes occur in one document only can't match and stops
   here (a shared hash never does, so nothing is lost).
2. Every block sorts its remaining suffixes, joins equal contexts under their smallest
   document, and sends front-coded runs: for each suffix the length of the prefix it
   shares with the one before it and the bytes after that. Runs are dealt by the hash
   of the first ``k`` bytes, so what can match meets.
3. Runs are merged by a loser tree that keeps, for each loser, the prefix known to be
   shared with the last winner: a longer known prefix wins without a look at the bytes,
   and on a tie bytes are compared from the end of the known prefix on. The merge
   yields the common prefixes of neighbours as well, and from these and the bytes left of
   the anchors, for each offset, the smallest document of every string.
4. Blocks get their answers and remove the bytes.

Scale: no document is compared with another; a passage in a third of all documents is
one suffix for each block. Bytes moved and work are linear in the text besides the sort. Blocks are
materialised in the shared folder and bounded by ``block_bytes`` (or one text); merge
parts hold about ``part_suffixes``. Blocks travel twice, compressed. What blocks and buckets (and blocks and parts) tell each other is
one row for each pair of them: their number grows with the square of the input, and each shrinks alike, until every
row holds one anchor; on very large inputs raise ``block_bytes``, ``bucket_anchors`` and ``part_suffixes`` together, as memory allows. Suffixes
that share their first ``k`` bytes meet in one part: a common string of ``k`` bytes with many different contexts is one task.

Edge cases: null text is empty; texts under ``length`` bytes keep all; documents that
share an id never remove from each other; a null id counts as larger than all others;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from inkstream.llm.common import materialize, text_batches, tidy

K = 24
CHUNK = 1 << 16
NO_ID = np.iinfo(np.int64).max
BASE = 0x9E3779B97F4A7C15
BLOCK = "block long, ids binary, sizes binary, nulls binary, data binary, n_bytes long, carried binary"
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept string"


def _zip(a: np.ndarray | bytes) -> bytes:
    import zstandard as zstd

    return zstd.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def _unzip(b: bytes, kind: type | None = None) -> np.ndarray | bytes:
    import zstandard as zstd

    raw = zstd.ZstdDecompressor().decompress(b)
    return raw if kind is None else np.frombuffer(raw, kind)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(raw: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k bytes at each position, by doubling."""
    step, n = _mix((raw.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)), 1
    out, have = None, 0
    while True:
        if k & n:
            if out is None:
                out, have = step, n
            else:
                m = min(len(out), len(step) - have)
                out = _mix(out[:m] * np.uint64(0xBF58476D1CE4E5B9) + step[have : have + m])
                have += n
        if have == k:
            return out
        step = _mix(step[:-n] * np.uint64(0x94D049BB133111EB) + step[n:])
        n *= 2


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = 1
    while n * 2 <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if n < w else x


def anchors(data: bytes, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor position, first and last start of the strings it stands for, document number, hash; texts lie end to end."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw = np.frombuffer(data, np.uint8)
    parts: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(raw) - length + 1), CHUNK):
        piece = raw[at : at + CHUNK + length - 1]
        h = rolling(piece, K)
        keyed = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(h), dtype=np.uint64)  # position breaks ties: CHUNK + length < 2**20
        best = (window_min(keyed, length - K + 1) & np.uint64(0xFFFFF)).astype(np.int64)
        p = np.arange(at, at + len(best))
        doc = np.searchsorted(ends, p, side="right")
        ok = p + length <= ends[np.minimum(doc, len(ends) - 1)]
        p, doc, best = p[ok], doc[ok], best[ok]
        if not len(p):
            continue
        first = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]))))
        last = np.append(first[1:], len(p)) - 1
        parts.append((best[first] + at, p[first], p[last], doc[first], h[best[first]]))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _carry(pieces: list[pa.RecordBatch]) -> bytes:
    """Rows of other columns, as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pieces[0].schema) as w:
        for p in pieces:
            w.write_batch(p)
    return _zip(sink.getvalue().to_pybytes())


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Texts end to end in compressed blocks, other columns beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []
        others: list[pa.RecordBatch] = []
        size = n = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, n
            row = (
                base + n, _zip(np.array([0 if i is None else i for i in ids], np.int64)), _zip(np.array([len(t) for t in texts], np.int64)), np.array([i is None for i in ids], np.uint8).tobytes(), _zip(b"".join(texts)), size, _carry(others) if carry else b"",
            )
            for held in (ids, texts, others):
                held.clear()
            size, n = 0, n + 1
            types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["block", "ids", "sizes", "nulls", "data", "n_bytes", "carried"])

        for b in batches:
            rest, done = b.select(list(range(2, b.num_columns))), 0
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                text = t.as_py() or b""
                if ids and size + len(text) > block_bytes:
                    if carry and k > done:
                        others.append(rest.slice(done, k - done))
                        done = k
                    yield flush()
                ids.append(i)
                texts.append(text)
                size += len(text)
            if carry and b.num_rows > done:
                others.append(rest.slice(done))
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]).mapInArrow(tidy(run), BLOCK)


class Block:
    """A block's texts and anchors."""

    def __init__(self, row: dict, length: int) -> None:
        self.ids = _unzip(row["ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], np.uint8).astype(bool)
        self.rank = np.where(self.nulls, NO_ID, self.ids)
        self.sizes = _unzip(row["sizes"], np.int64)
        self.data = _unzip(row["data"])
        self.length = length
        self.at, self.first, self.last, self.doc, self.hash = anchors(self.data, self.sizes, length)

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and 32-bit value of each anchor's hash."""
        return (self.hash % np.uint64(n)).astype(np.int64), (self.hash >> np.uint64(32)).astype(np.uint32)

    def listed(self, n: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, sorted distinct values, whether two documents of the block hold it)."""
        bucket, value = self.buckets(n)
        order = np.lexsort((self.rank[self.doc], value, bucket))
        b, v, d = bucket[order], value[order], self.rank[self.doc][order]
        first = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (v[1:] != v[:-1])))) if len(b) else np.zeros(0, np.int64)
        if not len(first):
            return []
        two = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        ub, uv = b[first], v[first]
        cut = np.flatnonzero(np.concatenate(([True], ub[1:] != ub[:-1])))
        return [(int(ub[a]), uv[a:z], two[a:z]) for a, z in zip(cut, np.append(cut[1:], len(ub)), strict=True)]

    def shared(self, n: int, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Numbers of the anchors whose hash occurs in two documents at least."""
        bits = {r: np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for r, x in answers}
        bucket, value = self.buckets(n)
        keep = np.zeros(len(bucket), bool)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(n + 1))
        for r, listed, _ in self.listed(n):
            own = order[cut[r] : cut[r + 1]]
            if r in bits:
                keep[own] = bits[r][np.searchsorted(listed, value[own])]
        return np.flatnonzero(keep)

    def contexts(self, chosen: np.ndarray) -> Contexts:
        return Contexts(self, chosen)


class Contexts:
    """Distinct contexts of a block's chosen anchors, in suffix order, and the anchors of each."""

    def __init__(self, block: Block, chosen: np.ndarray) -> None:
        length, reach = block.length, block.length - K
        at, first, last = block.at[chosen], block.first[chosen], block.last[chosen]
        view = np.lib.stride_tricks.sliding_window_view
        raw = np.frombuffer(bytes(reach) + block.data + bytes(length), np.uint8)
        # right: bytes from the anchor to the end of its last string; left: bytes before it, from its first string on
        right_size, left_size = last + length - at, at - first
        sizes = np.stack([right_size, left_size], 1).astype(np.uint8)
        right = view(raw[reach:], length)[at] * (np.arange(length, dtype=np.uint8) < sizes[:, :1])
        left = view(raw, reach)[at] * (np.arange(reach, 0, -1, dtype=np.uint8) <= sizes[:, 1:])
        rank = block.rank[block.doc[chosen]]
        rows = np.concatenate([right, left, sizes], 1)
        keyed = rows.view(f"V{rows.shape[1]}").ravel() if len(rows) else np.zeros(0, "V1")
        order = np.lexsort((rank, *(_big_endian(rows, c) for c in range((rows.shape[1] + 7) // 8 - 1, -1, -1)))) if len(rows) else np.zeros(0, np.int64)
        keyed, rank = keyed[order], rank[order]
        new = np.concatenate(([True], keyed[1:] != keyed[:-1])) if len(keyed) else np.zeros(0, bool)
        self.anchor = chosen[order]  # anchors in the order of their contexts
        self.context = np.cumsum(new) - 1  # context number of each
        self.doc_rank = rank
        heads = order[new]
        self.right, self.left, self.sizes = rows[heads, :length], rows[heads, length : length + reach], rows[heads, length + reach :]
        self.rank = rank[new]  # smallest document of each context
        self.part_hash = block.hash[chosen[heads]] >> np.uint64(16)


def _big_endian(rows: np.ndarray, c: int) -> np.ndarray:
    """Bytes 8c to 8c + 7 of each row as one number that sorts like them."""
    piece = rows[:, 8 * c : 8 * c + 8]
    if piece.shape[1] < 8:
        piece = np.concatenate([piece, np.zeros((len(piece), 8 - piece.shape[1]), np.uint8)], 1)
    return np.ascontiguousarray(piece).view(">u8").ravel().astype(np.uint64)


def prefix_lengths(right: np.ndarray) -> np.ndarray:
    """Length of the prefix each row shares with the one before; 0 for the first."""
    if len(right) < 2:
        return np.zeros(len(right), np.int64)
    same = right[1:] == right[:-1]
    return np.concatenate(([0], np.where(same.all(1), right.shape[1], same.argmin(1))))


def encode_run(right: np.ndarray, left: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> bytes:
    """A front-coded run: shared prefix lengths, the bytes after them, then the rest of the fields."""
    shared = prefix_lengths(right).astype(np.uint8)
    rest = right[np.arange(right.shape[1]) >= shared[:, None]]
    keep = np.arange(left.shape[1]) >= left.shape[1] - sizes[:, 1:2]
    return _zip(np.int64(len(right)).tobytes() + shared.tobytes() + sizes.tobytes() + rank.tobytes() + np.int64(keep.sum()).tobytes() + left[keep].tobytes() + rest.tobytes())


def decode_run(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """shared, sizes, rank, left, right."""
    raw = _unzip(data)
    n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
    shared = np.frombuffer(raw, np.uint8, n, at)
    at += n
    sizes = np.frombuffer(raw, np.uint8, 2 * n, at).reshape(n, 2)
    at += 2 * n
    rank = np.frombuffer(raw, np.int64, n, at)
    at += 8 * n
    m = int(np.frombuffer(raw, np.int64, 1, at)[0])
    at += 8
    reach = length - K
    left = np.zeros((n, reach), np.uint8)
    left[np.arange(reach) >= reach - sizes[:, 1:2]] = np.frombuffer(raw, np.uint8, m, at)
    right = np.zeros((n, length), np.uint8)
    right[np.arange(length) >= shared[:, None]] = np.frombuffer(raw, np.uint8, -1, at + m)
    for c in range(length):  # a shared byte is that of the last row that spelled it out
        right[:, c] = right[np.maximum.accumulate(np.where(shared <= c, np.arange(n), 0)), c]
    return shared.astype(np.int64), sizes, rank, left, right


class LoserTree:
    """Merges sorted runs of suffixes; never compares bytes of a prefix that is known to be shared.

    ``words``: columns of 8 suffix bytes each, as whole numbers, over all suffixes;
    ``shared``: prefix shared with the run's predecessor; ``bounds``: slices of the runs.
    """

    def __init__(self, words: list[list[int]], shared: list[int], bounds: list[tuple[int, int]], length: int) -> None:
        self.words, self.shared, self.length = words, shared, length
        self.next = [a for a, _ in bounds]
        self.ends = [z for _, z in bounds]
        self.size = 1 << max(0, len(bounds) - 1).bit_length()
        self.loser = [-1] * self.size
        self.known = [0] * self.size  # prefix the loser shares with the winner that passed it

    def _play(self, a: int, ka: int, b: int, kb: int) -> tuple[int, int, int, int]:
        """Of two runs' heads with prefixes known to be shared with the last output: winner, its prefix, loser, its prefix."""
        if b < 0:
            return a, ka, b, kb
        if a < 0:
            return b, kb, a, ka
        if ka != kb:
            return (a, ka, b, kb) if ka > kb else (b, kb, a, ka)
        i, j = self.next[a], self.next[b]
        for c in range(ka >> 3, len(self.words)):
            x, y = self.words[c][i], self.words[c][j]
            if x != y:
                k = 8 * c + (64 - (x ^ y).bit_length() >> 3)
                return (a, ka, b, k) if x < y else (b, kb, a, k)
        return (a, ka, b, self.length) if a < b else (b, kb, a, self.length)

    def merge(self) -> Iterator[tuple[int, int]]:
        """(suffix number, prefix shared with the output before it) in order."""
        runs, size = len(self.next), self.size
        level = [(r, 0) if r < runs and self.next[r] < self.ends[r] else (-1, 0) for r in range(size)]
        node = size
        while len(level) > 1:
            above = []
            for k in range(0, len(level), 2):
                w, kw, lo, kl = self._play(*level[k], *level[k + 1])
                self.loser[(node + k) >> 1], self.known[(node + k) >> 1] = lo, kl
                above.append((w, kw))
            node >>= 1
            level = above
        winner, prefix = level[0]
        nexts, ends, shared, loser, known, words = self.next, self.ends, self.shared, self.loser, self.known, self.words
        n_words, full = len(words), self.length
        while winner >= 0:
            i = nexts[winner]
            yield i, prefix
            i += 1
            nexts[winner] = i
            run, prefix = (winner, shared[i]) if i < ends[winner] else (-1, 0)
            node = (winner + size) >> 1
            while node:
                other = loser[node]
                if other >= 0:
                    theirs = known[node]
                    if run < 0 or theirs > prefix:
                        loser[node], known[node], run, prefix = run, prefix, other, theirs
                    elif theirs == prefix:
                        a, b = nexts[run], nexts[other]
                        for c in range(prefix >> 3, n_words):
                            x, y = words[c][a], words[c][b]
                            if x != y:
                                k = 8 * c + (64 - (x ^ y).bit_length() >> 3)
                                if x < y:
                                    known[node] = k
                                else:
                                    loser[node], known[node], run = run, k, other
                                break
                        else:
                            if run < other:
                                known[node] = full
                            else:
                                loser[node], known[node], run = run, full, other
                node >>= 1
            winner = run


def resolve(runs: list[tuple[np.ndarray, ...]], length: int) -> list[np.ndarray]:
    """For each run, a bit mask for each suffix: bit o says that the string starting o bytes before the anchor occurs in a smaller document."""
    bounds, n = [], 0
    for r in runs:
        bounds.append((n, n + len(r[0])))
        n += len(r[0])
    if not n:
        return [np.zeros(0, np.uint32) for _ in runs]
    shared, sizes, rank, left, right = (np.concatenate([r[k] for r in runs]) for k in range(5))
    words = [_big_endian(right, c).tolist() for c in range((length + 7) // 8)]
    merged = np.fromiter((x for pair in LoserTree(words, shared.tolist(), bounds, length).merge() for x in pair), np.int64, 2 * n).reshape(n, 2)
    order, common = merged[:, 0], merged[:, 1].copy()
    common[0] = 0
    near = common >= K
    touched = near | np.append(near[1:], False)
    mask = np.zeros(n, np.uint32)
    order_t, group = order[touched], np.cumsum(common < K)[touched]
    chain = common[touched]
    # strings that start o before the anchor: right part of length - o bytes, left part of o bytes
    least, most = length - sizes[order_t, 0].astype(np.int64), sizes[order_t, 1].astype(np.int64)
    back, owner, lefts = np.zeros(len(order_t), np.uint64), rank[order_t], left[order_t]
    reach = length - K
    for o in range(reach + 1):
        if o:
            back = _mix(back * np.uint64(BASE) + lefts[:, reach - o].astype(np.uint64) + np.uint64(1))
        block = np.cumsum(chain < length - o).astype(np.uint64) if len(chain) else np.zeros(0, np.uint64)
        live = np.flatnonzero((least <= o) & (o <= most))
        if len(live) < 2:
            continue
        key = _mix(block[live] * np.uint64(0xC2B2AE3D27D4EB4F) ^ _mix(group[live].astype(np.uint64)) ^ back[live])
        by = np.argsort(key, kind="stable")
        new = np.concatenate(([True], key[by][1:] != key[by][:-1]))
        # equal keys must mean equal strings: the right part is equal by the merge's prefixes, the left part and the group are compared here
        at = live[by]
        alike = (block[at][1:] == block[at][:-1]) & (lefts[at[1:], reach - o :] == lefts[at[:-1], reach - o :]).all(1)
        if not (alike | new[1:]).all():  # two strings under one key: sort by the bytes instead
            by = np.lexsort((*lefts[live][:, reach - o :].T, block[live]))
            at = live[by]
            new = np.concatenate(([True], (block[at][1:] != block[at][:-1]) | (lefts[at[1:], reach - o :] != lefts[at[:-1], reach - o :]).any(1)))
        cut = np.flatnonzero(new)
        low = np.minimum.reduceat(owner[at], cut)
        hit = at[np.repeat(low, np.diff(np.append(cut, len(by)))) < owner[at]]
        mask[order_t[hit]] |= np.uint32(1 << o)
    return [mask[a:z] for a, z in bounds]


def _parse(ddl: str) -> list[StructField]:
    return list(StructType.fromDDL(ddl))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def remove_repeats(
    docs: DataFrame, length: int = 50, keep_text: bool = False, block_bytes: int = 6_000_000, bucket_anchors: int = 4_000_000, part_suffixes: int = 150_000, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (flattened [from, to) pairs in bytes) and, with ``keep_text``, ``kept``:
    the text left, without parts of characters that a removed span cut. Columns named in ``carry`` follow unchanged."""
    if not K < length < 256 or length - K > 31:
        raise ValueError(f"length must be from {K + 1} to {K + 31}")
    spark = docs.sparkSession
    text_batches(spark)
    blocks = materialize(pack_blocks(docs, id_col, text_col, block_bytes, carry), "blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(1, -(-int(total * 2 / (length - K + 2)) // bucket_anchors))

    def list_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("bucket", pa.int64()), ("block", pa.int64()), ("listed", pa.binary()), ("two", pa.binary())]
        with np.errstate(over="ignore"):
            for row in _rows(batches):
                found = [(r, row["block"], _zip(v), np.packbits(two).tobytes()) for r, v, two in Block(row, length).listed(n_buckets)]
                if found:
                    yield _batch(found, fields)

    def find_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("block", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary()), ("n", pa.int64())]

        def close(held: list[tuple]) -> pa.RecordBatch:
            values = np.concatenate([v for _, _, v, _ in held])
            twice = np.concatenate([t for _, _, _, t in held])
            order = np.argsort(values, kind="stable")
            v = values[order]
            cut = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            n = np.diff(np.append(cut, len(v)))
            common = (n > 1) | np.logical_or.reduceat(twice[order], cut)
            flags = np.zeros(len(v), bool)
            flags[order] = np.repeat(common, n)
            out, at = [], 0
            for r, block, own, _ in held:
                bits = flags[at : at + len(own)]
                at += len(own)
                if bits.any():
                    out.append((block, r, np.packbits(bits).tobytes(), int(bits.sum())))
            return _batch(out, fields)

        held: list[tuple] = []
        for row in _rows(batches):
            if held and held[0][0] != row["bucket"]:
                yield close(held)
                held = []
            v = _unzip(row["listed"], np.uint32)
            held.append((row["bucket"], row["block"], v, np.unpackbits(np.frombuffer(row["two"], np.uint8), count=len(v)).astype(bool)))
        if held:
            yield close(held)

    deal = blocks.select("block", "ids", "sizes", "nulls", "data")
    listed = deal.mapInArrow(tidy(list_hashes), "bucket long, block long, listed binary, two binary")
    shared = materialize(listed.repartition(max(1, min(n_buckets, max(shuffles, n_buckets // 4))), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(find_shared), "block long, bucket long, bits binary, n long"), "shared")
    answers = shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    n_shared = shared.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-int(n_shared) // part_suffixes))

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("part", pa.int64()), ("block", pa.int64()), ("run", pa.binary())]
        with np.errstate(over="ignore"):
            for row in _rows(batches):
                block = Block(row, length)
                c = block.contexts(block.shared(n_buckets, [(a["bucket"], a["bits"]) for a in row["answers"]]))
                part = (c.part_hash % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cut = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1]))) if len(part) else np.zeros(0, np.int64)
                out = []
                for a, z in zip(cut, np.append(cut[1:], len(part)), strict=False):
                    own = order[a:z]
                    out.append((int(part[own[0]]), row["block"], encode_run(c.right[own], c.left[own], c.sizes[own], c.rank[own])))
                if out:
                    yield _batch(out, fields)

    def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("block", pa.int64()), ("part", pa.int64()), ("masks", pa.binary())]

        def close(held: list[tuple]) -> pa.RecordBatch:
            masks = resolve([decode_run(r, length) for _, _, r in held], length)
            return _batch([(block, part, _zip(m)) for (part, block, _), m in zip(held, masks, strict=True) if m.any()], fields)

        held: list[tuple] = []
        with np.errstate(over="ignore"):
            for row in _rows(batches):
                if held and held[0][0] != row["part"]:
                    yield close(held)
                    held = []
                held.append((row["part"], row["block"], row["run"]))
            if held:
                yield close(held)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("kept", pa.string())]

        def emit(out: list[tuple], others: pa.Table | None, to: int) -> pa.RecordBatch:
            own = _batch(out, fields)
            if others is None:
                return own
            beside = others.slice(to - len(out), len(out)).combine_chunks()
            return pa.RecordBatch.from_arrays([*own.columns, *[c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in beside.columns]], names=[*own.schema.names, *carry])

        with np.errstate(over="ignore"):
            for row in _rows(batches):
                block = Block(row, length)
                hit = np.zeros(len(block.data), bool)  # starts of strings that a smaller document holds
                if row["answers"]:
                    c = block.contexts(block.shared(n_buckets, [(a["bucket"], a["bits"]) for a in row["answers"]]))
                    mask = np.zeros(len(c.rank), np.uint32)
                    part = (c.part_hash % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    cut = np.searchsorted(part[order], np.arange(parts + 1))
                    for m in row["found"] or []:
                        mask[order[cut[m["part"]] : cut[m["part"] + 1]]] = _unzip(m["masks"], np.uint32)
                    at, first, last = block.at[c.anchor], block.first[c.anchor], block.last[c.anchor]
                    own = mask[c.context]
                    own[c.doc_rank > c.rank[c.context]] = 0xFFFFFFFF  # the block itself holds the context in a smaller document
                    for o in range(length - K + 1):
                        p = at - o
                        hit[p[((own >> np.uint32(o)) & np.uint32(1) == 1) & (p >= first) & (p <= last)]] = True
                starts = np.flatnonzero(hit)
                cover = np.zeros(len(block.data) + 1, np.int8)
                cover[starts] = 1
                cover[starts + length] -= 1
                gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
                ends = np.cumsum(block.sizes)
                raw = np.frombuffer(block.data, np.uint8)
                others = pa.ipc.open_stream(_unzip(row["carried"])).read_all() if carry else None
                out, size = [], 0
                for d, (z, n) in enumerate(zip(ends.tolist(), block.sizes.tolist(), strict=True)):
                    a, doc_id = z - n, None if block.nulls[d] else int(block.ids[d])
                    own = gone[a:z]
                    if own.any():
                        edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
                        kept = raw[a:z][~own].tobytes()
                    else:
                        edges, kept = np.zeros(0, np.int64), block.data[a:z]
                    out.append((doc_id, n, n - len(kept), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges.tolist(), kept.decode("utf-8", "ignore") if keep_text else None))
                    size += len(kept) if keep_text else 200
                    if size > 4_000_000:
                        yield emit(out, others, d + 1)
                        out, size = [], 0
                if out:
                    yield emit(out, others, len(block.ids))

    runs = deal.join(answers, "block").mapInArrow(tidy(send_runs), "part long, block long, run binary")
    masks = materialize(runs.repartition(max(1, min(parts, max(shuffles, parts // 4))), "part").sortWithinPartitions("part", "block").mapInArrow(tidy(merge_runs), "block long, part long, masks binary"), "masks")
    found = masks.groupBy("block").agg(F.collect_list(F.struct("part", "masks")).alias("found"))
    schema = StructType([*_parse(REMOVED), *[StructField(c, docs.schema[c].dataType) for c in carry]])
    whole = blocks.drop("n_bytes") if carry else deal
    final = whole.join(answers, "block", "left").join(found, "block", "left")
    return final.mapInArrow(tidy(apply), schema)
