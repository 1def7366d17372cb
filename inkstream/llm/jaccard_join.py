"""Near-duplicate self-join on word shingles: MinHash LSH forest, then exact verification.

Every text becomes a set of hashed shingles of ``shingle`` words, and a signature of
``trees`` labels of ``depth`` MinHash values. A tree is the prefix trie of its labels: labels
are bytes that sort by value, so a prefix of a label is a node of the trie and the texts below it
are those whose labels start with it.

A text starts with the full label in every tree and shortens one prefix at a time until a
pair at the threshold would be missed in all trees with a probability of at most
``1 - recall``. Which prefix is shortened next depends on the trie: those whose next group is
small come first, evenly; a group of over ``hot`` texts (a template, a boilerplate page) is opened
last, so such trees stay deep and others make up for them. A group opened by one of its texts is
open to all of them, so the promise holds for both ends of a pair.

Scale: texts with equal shingle sets are one node (a very common text costs one row).
Trie rows without company at the shortest prefix go at once; sizes of groups come from
partial aggregations and joins that adaptive execution can split. Texts travel only for nodes
with a candidate (a semi-join first, broadcast up to ``max_broadcast`` ids). Small connected groups of nodes are verified
at once; a larger one is verified either as a whole or bucket by bucket, whichever sends fewer
texts (``routes``): chains of loosely related texts cost their buckets, never all pairs, and a pair
that meets in several buckets is counted in the first. A group is compared in blocks of
bounded size: task (i, j) compares block i with block j and returns, for each node, its number
of links and the smallest node linked to it, never pairs. No cap on group sizes or partners.

Words are maximal runs of ``[0-9a-z]`` (A-Z lower-cased) and characters beyond ASCII.

Edge cases: a text of fewer words than a shingle is one shingle of all its words; null
or word-free texts are classes of their own without links; a null id gets a null class
and no links and links to nothing; rows that repeat an id count as copies or as texts
of their own, each with its own links; ties for the smallest id change nothing, as a class is named
by that id; texts of any length are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import drop_scratch, materialize, text_batches, tidy
from inkstream.llm.graph import components

WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 500_000
SIGNED = "doc_id long, row_hash long, h1 long, h2 long, n_shingles int, labels binary"
VALUE_BYTES = 2  # of a MinHash value in a label


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the hash base and of its inverse."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingle_sets(texts: list[bytes | None], shingle: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; equal words give equal hashes in any process."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    at, size = [], 0
    lines: list[bytes] = []

    def flush() -> None:
        if not lines:
            return
        raw = np.frombuffer(b" ".join(lines) + b" ", np.uint8)
        up, down = powers(len(raw) + 1)
        ends = np.flatnonzero(raw == 32)
        starts = np.concatenate(([0], ends[:-1] + 1))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw.astype(np.uint64) * up[: len(raw)], dtype=np.uint64)))
        words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        rolled = np.zeros(max(0, len(words) - shingle + 1), np.uint64)
        for k in range(shingle):
            rolled += words[k : k + len(rolled)] * np.uint64((0xD1342543DE82EF95 * (2 * k + 1)) & MASK)
        rolled = mix(rolled)
        first = 0
        for i, line in zip(at, lines, strict=True):
            count = line.count(b" ") + 1
            if count >= shingle:
                out[i] = np.unique(rolled[first : first + count - shingle + 1])
            else:
                value = np.uint64(count)
                for w in words[first : first + count]:
                    value = mix(np.array([value ^ w]))[0]
                out[i] = np.array([value])
            first += count

    for i, text in enumerate(texts):
        line = b" ".join(text.translate(WORD_BYTES).split()) if text else b""
        if not line:
            continue
        if size and size + len(line) > CHUNK_BYTES:
            flush()
            at, lines, size = [], [], 0
        at.append(i)
        lines.append(line)
        size += len(line) + 1
    flush()
    return out


class MinHash:
    """Values of many hash functions over a shingle set, 32 bits each."""

    def __init__(self, count: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.flip = rng.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]
        self.factor = (rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.flip), 0xFFFFFFFF, np.uint32)
        for a in range(0, len(low), 1024):
            np.minimum(best, ((low[None, a : a + 1024] ^ self.flip) * self.factor).min(1), out=best)
        return best


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, trees: int, depth: int) -> DataFrame:
    """Per row: id, hash of the text, 128-bit hash of the shingle set (null without words), its size, and the labels of all trees end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = MinHash(trees * depth)
        for b in batches:
            sets = shingle_sets([x.as_py() for x in b.column(2)], shingle)
            h1, h2, n, labels = [], [], [], []
            with np.errstate(over="ignore"):
                for s in sets:
                    n.append(len(s))
                    h1.append(int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else None)
                    h2.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None)
                    labels.append(hashes(s).astype(np.uint16).astype(">u2").tobytes() if len(s) else None)  # low bits: those of a minimum are even
            yield pa.record_batch([b.column(0), b.column(1), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int32()), pa.array(labels, pa.binary())], ["doc_id", "row_hash", "h1", "h2", "n_shingles", "labels"])

    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(text_col).cast("binary")).mapInArrow(tidy(run), SIGNED)


def trie_rows(nodes: DataFrame, trees: int, depth: int) -> DataFrame:
    """``node, tree, label``: a node's leaf in every trie."""
    size = depth * VALUE_BYTES
    return nodes.select("node", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("node", F.col("tree").cast("int").alias("tree"), F.substring("labels", F.col("tree") * size + 1, F.lit(size)).alias("label"))


def prefix(depth: int) -> Column:
    return F.substring("label", 1, depth * VALUE_BYTES)


def log_misses(depth: int, threshold: Fraction) -> list[float]:
    """Entry d: logarithm of the chance that a pair at the threshold differs within the first d values of a tree."""
    return [-math.inf, *(math.log1p(-(float(threshold) ** d)) for d in range(1, depth + 1))]


def size_class(n: int, hot: int) -> int:
    """0 up to ``hot`` texts, then one more for each factor of 4: a single text more or less must not steer the choice."""
    return 0 if n <= hot else 1 + int(math.log(n / hot, 4))


def chosen_depths(sizes: dict[int, list[int]], trees: int, shortest: int, depth: int, misses: list[float], recall: float, hot: int) -> list[int]:
    """Prefix lengths of one text in all trees. ``sizes``: by tree, the texts below its prefix of each length from ``shortest`` to ``depth``; a tree that isn't listed holds the text alone."""
    at, total, goal = [depth] * trees, trees * misses[depth], math.log(1 - recall)
    while total > goal:
        open_ = [t for t in range(trees) if at[t] > shortest]
        if not open_:
            break
        t = min(open_, key=lambda t: (size_class(sizes[t][at[t] - 1 - shortest], hot) if t in sizes else 0, -at[t], t))
        total += misses[at[t] - 1] - misses[at[t]]
        at[t] -= 1
    return at


def shortest_prefix(trees: int, depth: int, threshold: Fraction, recall: float) -> int:
    """One value less than all trees would need if every prefix had the same length: the play that shifts work between trees."""
    misses = log_misses(depth, threshold)
    d = depth
    while d > 1 and trees * misses[d] > math.log(1 - recall):
        d -= 1
    return max(1, d - 1)


def buckets(nodes: DataFrame, trees: int, depth: int, threshold: Fraction, recall: float, hot: int) -> DataFrame:
    """``node, bucket``: groups of texts with a common prefix, of the length that their texts chose; each of two texts at least."""
    shortest, misses = shortest_prefix(trees, depth, threshold, recall), log_misses(depth, threshold)
    rows = trie_rows(nodes, trees, depth)
    lengths = range(shortest, depth + 1)

    def beside(df: DataFrame, d: int, what: Column, least: int = 0) -> DataFrame:
        """The rows with an aggregate over their prefix group of length d."""
        keyed = df.withColumn("_p", prefix(d))
        found = keyed.groupBy("tree", "_p").agg(what, F.count("*").alias("_n")).where(F.col("_n") > least).drop("_n")
        return keyed.join(found, ["tree", "_p"]).drop("_p")

    live = materialize(beside(rows, shortest, F.count("*").alias(f"s{shortest}"), 1), "tries")
    sized = live
    for d in lengths[1:]:
        sized = beside(sized, d, F.count("*").alias(f"s{d}"))
    sized = materialize(sized, "sizes")
    drop_scratch(nodes.sparkSession, live)
    plain = chosen_depths({}, trees, shortest, depth, misses, recall, hot)
    usual = F.element_at(F.array(*map(F.lit, plain)), F.col("tree") + 1)
    # texts with a hot group choose for themselves; to all others the usual lengths apply
    touched = sized.groupBy("node").agg(F.max(f"s{shortest}").alias("most"), F.collect_list(F.struct("tree", *[f"s{d}" for d in lengths])).alias("t")).where(F.col("most") > hot)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for node, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = chosen_depths({r["tree"]: [r[f"s{d}"] for d in lengths] for r in found}, trees, shortest, depth, misses, recall, hot)
                out += [(node, r["tree"], at[r["tree"]]) for r in found]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["node", "tree", "own"])

    own = touched.select("node", "t").mapInArrow(tidy(choose), "node long, tree int, own int")
    placed = sized.join(own, ["node", "tree"], "left").withColumn("at", F.coalesce("own", usual)).drop("own")
    for d in lengths[:-1]:
        placed = beside(placed, d, F.min("at").alias(f"m{d}"))
    # the shortest prefix that any text below it has opened
    opened = F.coalesce(*[F.when(F.col(f"m{d}") <= d, F.lit(d)) for d in lengths[:-1]], F.lit(depth))
    placed = placed.withColumn("at", opened)
    size = F.element_at(F.array(*[F.col(f"s{d}") for d in lengths]), F.col("at") - shortest + 1)
    found = materialize(placed.where(size > 1).select("node", F.xxhash64("tree", "at", F.substring("label", F.lit(1), F.col("at") * VALUE_BYTES)).alias("bucket")), "buckets")
    drop_scratch(nodes.sparkSession, sized)
    return found


def stars(held: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect the nodes of each bucket, two for a node and bucket at most: each node to its smallest leader, and that one to its others.

    ``held``: node, leader (the smallest node of the bucket).
    """
    found = held.where("node != leader").groupBy("node").agg(F.min("leader").alias("least"), F.collect_set("leader").alias("all"))
    found = materialize(found, "stars")
    others = found.where(F.size("all") > 1).select(F.explode(F.array_remove("all", F.col("least"))).alias("a"), F.col("least").alias("b"))
    return found.select(F.col("node").alias("a"), F.col("least").alias("b")).union(others.distinct())


def routes(nodes: DataFrame, held: DataFrame, block_nodes: int, block_shingles: int) -> DataFrame:
    """``node, grp, blocks, earlier``: where each node is compared.

    A connected group of nodes is one ``grp`` if that sends its texts less often than its buckets
    would, and ``earlier`` is null; else its buckets are, without those of equal members, and
    ``earlier`` lists a node's buckets, as a pair belongs to the smallest it shares.
    ``nodes``: node, n_shingles; ``held``: node, bucket.
    """
    per = held.join(nodes.select("node", "n_shingles"), "node")
    blocks = lambda m, w: F.greatest(F.ceil(m / block_nodes), F.ceil(w / block_shingles)).cast("int")
    stats = per.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(3), "node"), 32)).alias("y"), F.min("node").alias("leader"))
    kept = materialize(stats.groupBy("m", "w", "x", "y").agg(F.min("bucket").alias("bucket"), F.min("leader").alias("leader")), "kept")
    held = materialize(held.join(kept.select("bucket", "m", "w", "leader"), "bucket"), "held")
    groups = materialize(components(stars(held.select("node", "leader"))), "groups")
    member = held.select("node").distinct().join(groups.select("node", F.col("label").alias("comp")), "node").join(nodes.select("node", "n_shingles"), "node")
    whole = member.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w"))
    split = kept.join(groups.select(F.col("node").alias("leader"), F.col("label").alias("comp")), "leader").groupBy("comp").agg(F.sum(F.col("m") * blocks(F.col("m"), F.col("w"))).alias("sent"))
    routed = whole.join(split, "comp").withColumn("blocks", blocks(F.col("m"), F.col("w")))
    routed = materialize(routed.select("comp", "blocks", ((F.col("blocks") > 1) & (F.col("sent") < F.col("m") * F.col("blocks"))).alias("apart")), "routed")
    together = member.join(routed.where(~F.col("apart")), "comp").select("node", F.col("comp").alias("grp"), "blocks", F.lit(None).cast("array<long>").alias("earlier"))
    loose = member.join(routed.where("apart"), "comp").select("node")
    lists = held.join(loose, "node").groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("earlier"))
    apart = held.join(lists, "node").select("node", F.col("bucket").alias("grp"), blocks(F.col("m"), F.col("w")).alias("blocks"), "earlier")
    return together.unionByName(apart)


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every set on the right (or of one list with itself)."""
    sets = left if right is None else [*left, *right]
    m, k = len(left), len(left) if right is None else len(right)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    held = np.diff(np.append(starts, len(values)))
    counts = np.zeros((m, k), np.float32)
    # rare shingles: pairs of owners, counted
    for d in range(2, 9):
        own = owner[starts[held == d][:, None] + np.arange(d)]
        if len(own):
            pairs = np.concatenate([np.stack([own[:, i], own[:, j]], 1) for i in range(d) for j in range(d) if i != j])
            if right is not None:
                pairs = pairs[(pairs[:, 0] < m) & (pairs[:, 1] >= m)] - (0, m)
            flat, n = np.unique(pairs[:, 0].astype(np.int64) * k + pairs[:, 1], return_counts=True)
            counts.ravel()[flat] += n
    # common shingles: products of blocks of the incidence matrix
    common = np.flatnonzero(held > 8)
    for a in range(0, len(common), 2048):
        cols = common[a : a + 2048]
        n = held[cols]
        at = np.repeat(starts[cols] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        x = np.zeros((len(sets), len(cols)), np.float32)
        x[owner[at], np.repeat(np.arange(len(cols)), n)] = 1
        counts += x[:m] @ (x if right is None else x[m:]).T
    return counts


def met_before(left: list[list[int]], right: list[list[int]], bucket: int) -> np.ndarray:
    """Whether two nodes, given by their sorted buckets, share one smaller than this."""
    number: dict[int, int] = {}
    sides = []
    for side in (left, right):
        own = [(k, number.setdefault(x, len(number))) for k, xs in enumerate(side) for x in xs if x < bucket]
        sides.append((np.array([k for k, _ in own], np.int64), np.array([c for _, c in own], np.int64), len(side)))
    seen = [np.zeros((n, len(number)), np.float32) for _, _, n in sides]
    for x, (rows, cols, _) in zip(seen, sides, strict=True):
        x[rows, cols] = 1
    both = np.flatnonzero(seen[0].any(0) & seen[1].any(0))
    return seen[0][:, both] @ seen[1][:, both].T > 0


def verify(ids: tuple[np.ndarray, np.ndarray | None], sets: tuple[list[np.ndarray], list[np.ndarray] | None], copies: tuple[np.ndarray, np.ndarray | None], threshold: Fraction, skip: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(node, links, smallest node linked to it within these blocks) for nodes with a link; pairs to ``skip`` are counted elsewhere."""
    alone = ids[1] is None
    c = intersections(sets[0], None if alone else sets[1]).astype(np.int64)
    left = np.array([len(s) for s in sets[0]])
    right = left if alone else np.array([len(s) for s in sets[1]])
    # c / (left + right - c) >= num / den, in whole numbers
    linked = c * (threshold.denominator + threshold.numerator) >= threshold.numerator * (left[:, None] + right[None, :])
    if alone:
        np.fill_diagonal(linked, False)
    if skip is not None:
        linked &= ~skip
    nodes = ids[0] if alone else np.concatenate(ids)
    links = linked @ (copies[0] if alone else copies[1])
    if not alone:
        links = np.concatenate((links, linked.T @ copies[0]))
    label = nodes.copy()
    far = np.iinfo(np.int64).max
    m = len(ids[0])
    while True:
        if alone:
            near = np.where(linked, label[None, :], far).min(1, initial=far)
        else:
            near = np.concatenate((np.where(linked, label[None, m:], far).min(1, initial=far), np.where(linked, label[:m, None], far).min(0, initial=far)))
        lower = np.minimum(label, near)
        if (lower == label).all():
            break
        label = lower
    return [(int(v), int(n), int(r)) for v, n, r in zip(nodes, links, label, strict=True) if n]


LINKS = ["node", "links", "root"]


def verified_links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, shingle: int, threshold: Fraction, max_broadcast: int) -> DataFrame:
    """``node, links, root`` from comparing the members of each group, block against block.

    ``members``: node, first_id, h1, h2, copies, grp, blocks, earlier.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("first_id"), F.col(text_col).cast("binary").alias("text"))
    if members.count() <= max_broadcast:  # most texts have no candidate and stay where they are
        texts = texts.join(F.broadcast(members.select("first_id").distinct()), "first_id", "left_semi")
    dealt = members.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int"))
    rows = dealt.hint("merge").join(texts, "first_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "h1", "h2", "copies", "earlier", "text")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # a group's pairs of blocks are dealt in turn: by hash, several would meet in one task
    turn = F.expr("j * (j + 1L) div 2") + F.col("i")
    ordered = rows.repartitionById(n, F.pmod(F.pmod(F.xxhash64("grp"), F.lit(n)) + turn, F.lit(n)).cast("int")).sortWithinPartitions("grp", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: dict[int, tuple] = {}
        out: list[tuple[int, int, int]] = []

        def close() -> None:
            sides = [[r for r in held.values() if r[0] == side] for side in ((key[1], key[2]) if key[1] != key[2] else (key[1],))]
            if len(held) < 2 or not all(sides):
                return
            ids, sets, copies = ([f(r) for r in sides] for f in (lambda r: np.array([x[1] for x in r], np.int64), lambda r: [x[2] for x in r], lambda r: np.array([x[3] for x in r], np.int64)))
            skip = met_before([x[4] for x in sides[0]], [x[4] for x in sides[-1]], key[0]) if sides[0][0][4] is not None else None
            rest = [None] if len(sides) == 1 else []
            out.extend(verify((*ids, *rest), (*sets, *rest), (*copies, *rest), threshold, skip))

        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(9)]
            with np.errstate(over="ignore"):
                sets = shingle_sets([x.as_py() for x in b.column(9)], shingle)
                for k, s in enumerate(sets):
                    here = (cols[0][k], cols[1][k], cols[2][k])
                    if here != key:
                        if key is not None:
                            close()
                        key, held = here, {}
                    # an id may have several texts; the node's is that of its hash
                    if int(s.sum(dtype=np.uint64).astype(np.int64)) == cols[5][k] and int(mix(s).sum(dtype=np.uint64).astype(np.int64)) == cols[6][k]:
                        held[cols[4][k]] = (cols[3][k], cols[4][k], s, cols[7][k], cols[8][k])
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], LINKS)
                out.clear()
        if key is not None:
            close()
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], LINKS)

    return ordered.mapInArrow(tidy(run), "node long, links long, root long")


def classes(
    docs: DataFrame, threshold: Fraction = Fraction(4, 5), shingle: int = 5, trees: int = 24, depth: int = 6, recall: float = 0.9999, hot: int = 64, block_nodes: int = 250, block_shingles: int = 1_500_000, max_broadcast: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``doc_id, row_hash, class_key, class_id, n_links``; ``class_key`` is null where nothing can be linked."""
    spark = docs.sparkSession
    text_batches(spark)
    signed = materialize(signatures(docs, id_col, text_col, shingle, trees, depth), "signatures")
    known = signed.where("doc_id is not null and h1 is not null")
    # one node for each distinct shingle set, with a number of its own: ids may repeat
    nodes = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    held = buckets(nodes, trees, depth, threshold, recall, hot)
    routed = routes(nodes.select("node", "n_shingles"), held, block_nodes, block_shingles)
    members = materialize(nodes.drop("labels", "n_shingles").join(routed, "node"), "members")
    links = materialize(verified_links(docs, members, id_col, text_col, shingle, threshold, max_broadcast), "links")
    grouped = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("label", "class_key")
    named = grouped.join(nodes.select("node", "first_id"), "node")
    named = named.join(named.groupBy("class_key").agg(F.min("first_id").alias("class_id")), "class_key").select("node", "class_key", "class_id")
    per_node = links.groupBy("node").agg(F.sum("links").alias("links")).join(named, "node")
    resolved = nodes.select("node", "h1", "h2", "first_id", "copies").join(per_node, "node", "left")
    resolved = materialize(resolved.select("h1", "h2", F.coalesce("class_key", "node").alias("class_key"), F.coalesce("class_id", "first_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    joined = signed.select("doc_id", "row_hash", "h1", "h2").join(resolved, ["h1", "h2"], "left")
    alone = F.col("doc_id").isNull() | F.col("h1").isNull()
    drop_scratch(spark, nodes, held, members, links)
    return joined.select("doc_id", "row_hash", F.when(~alone, F.col("class_key")).alias("class_key"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row: ``doc_id, class_id, n_links``; the options are those of ``classes``.

    ``class_id`` is the smallest id of the texts connected by links; ``n_links`` the
    number of other rows whose similarity is at least the threshold, copies included.
    """
    return classes(docs, **options).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, with all its columns: that of the smallest id (of one id's texts, that of the smallest hash). Rows that can't be linked stay."""
    found = materialize(classes(docs, id_col=id_col, text_col=text_col, **options).where("class_key is not null").groupBy("class_key", "doc_id", "row_hash").agg(F.count("*").alias("n")), "found")
    first = found.groupBy("class_key").agg(F.min(F.struct("doc_id", "row_hash")).alias("first"))
    judged = materialize(found.join(first, "class_key").select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), (F.struct("doc_id", "row_hash") == F.col("first")).alias("chosen"), "n"), "judged")
    keyed = docs.withColumns({"_id": F.col(id_col).cast("long"), "_hash": F.xxhash64(text_col)})
    kept = keyed.join(judged.where("not chosen").select("_id", "_hash"), ["_id", "_hash"], "left_anti")
    again = judged.where("chosen and n > 1").select("_id", "_hash")
    if again.limit(1).count():  # the chosen row itself is repeated
        kept = kept.join(again, ["_id", "_hash"], "left_anti").unionByName(kept.join(again, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]))
    return kept.select(docs.columns)
