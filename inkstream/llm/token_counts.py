"""Token counts by prefix dynamic programming over a word-end BPE vocabulary.

The encoding of a prefix ends in one token, and what stands before that token is
the encoding of a shorter prefix; so walking once over a word gives the last token
and the exact count at every prefix. A token may follow another only if no merge
across or inside the two would have come first; that test needs the merges of the
pair alone. Words are independent, so counts add up along the text, and questions
on truncation or budgets read the stored counts instead of encoding again.

``n_tokens`` is the count at the last prefix; ``prefix_counts`` gives the count at
every prefix of a text, as a library would give it for the text cut there. Stored as
``prefix_tokens`` they answer ``tokens_within`` (tokens of any prefix) and ``truncated`` (the longest
prefix within a budget) by look-ups in the JVM; nothing is encoded again.

One walk covers all prefixes, whatever the script: a complete piece counts the same in every longer
prefix, and the open piece is counted by the prefix walk. Characters that combine with
the ones before them (accents written apart, Hangul letters) are counted by carrying the walk on from where the
last finished character left it.

Scale: no shuffle; one pass in Arrow batches. Each worker keeps counts of words it
has met, at most ``CACHE_WORDS`` before it starts anew. Words repeat, so most of a
text is looked up.

Edge cases: null text is empty and has 0 tokens; special strings in a text are one
special token, as is the library's default; texts beyond Latin-1 are normalised and
cut into words by the library's own rules, and counted the same way; repeated rows are counted row by
row; an empty table gives no rows; extra columns are ignored. A vocabulary with other rules of normalisation,
cutting or merging than those counted here is refused.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import text_batches, tidy

CACHE_WORDS = 1_000_000
CACHE_BYTES = 256  # longer pieces hardly come again
COUNTED = "doc_id long, n_bytes long, n_tokens long"
END = "</w>"

# The rules of normalisation, cutting and merging that the counts follow.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MERGING = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "byte_fallback": False, "ignore_merges": False}

#: Pieces of a lower-cased Latin-1 text: contractions, runs of letters, single digits, runs of the rest.
LATIN_1 = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\t-\\r \x85\xa0a-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")

#: Runs without blanks, and separators that only the library's rules tell from blanks.
RUN = re.compile("[^\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> dict[str, int]:
    """Visible stand-ins of the 256 bytes in byte-level vocabularies, to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class PrefixCounter:
    """Counts of all prefixes of a word or a text under one vocabulary."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = byte_alphabet(), spec["model"]
        plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if {k: model.get(k) for k in MERGING} != MERGING or spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != CUTTER or spec.get("truncation") or spec.get("padding") or not plain:
            raise ValueError("a vocabulary with word ends and other rules than those counted here")
        self.library = Tokenizer.from_file(path)
        self.alphabet = alphabet
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        raw = lambda s: "".join(chr(alphabet[c]) for c in s)
        vocab, merges = model["vocab"], model["merges"]
        # Rank of a token: order of the merge that makes it; single symbols come before all merges.
        rank: dict[str, int] = {}
        self.left: list[int] = []
        self.right: list[int] = []
        self.pair: dict[tuple[int, int], int] = {}
        for token in vocab:
            bare = token.removesuffix(END)
            if len(bare) == 1:
                rank[token] = len(self.left)
                self.left.append(-1)
                self.right.append(-1)
        for a, b in merges:
            whole = a + b
            if whole not in rank:
                rank[whole] = len(self.left)
                self.left.append(rank[a])
                self.right.append(rank[b])
            self.pair.setdefault((rank[a], rank[b]), rank[whole])
        self.inner = {raw(t): r for t, r in rank.items() if not t.endswith(END)}
        self.final = {raw(t.removesuffix(END)): r for t, r in rank.items() if t.endswith(END)}
        self.allowed: dict[tuple[int, int], bool] = {}
        self.reach: dict[str, int] = {}
        for t in [*self.inner, *self.final]:
            self.reach[t[-2:]] = max(self.reach.get(t[-2:], 0), len(t))
        self.cache: dict[str, int] = {}
        self.normal: dict[str, str] = {}

    def follows(self, a: int, b: int) -> bool:
        """Whether token b can stand right after token a in an encoding."""
        known = self.allowed.get((a, b))
        if known is None:
            known = self.allowed[a, b] = self._follows(a, b)
            if len(self.allowed) > 4 * CACHE_WORDS:
                self.allowed.clear()
        return known

    def _follows(self, a: int, b: int) -> bool:
        limit = len(self.left)
        while True:
            merged = self.pair.get((a, b))
            if merged is not None and merged < limit:
                return False
            # undo the later of the two merges that touch the border; before it, the border pair was another
            open_a, open_b = self.left[a] >= 0, self.left[b] >= 0
            if not open_a and not open_b:
                return True
            if open_a and (not open_b or a > b):
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def _last(self, word: str, last: list[int] | None = None, count: list[int] | None = None) -> tuple[list[int], list[int]]:
        """Last token and count at each prefix of a word whose end is still open; given lists are carried on."""
        last, count = last or [-1], count or [0]
        inner, reach, follows = self.inner, self.reach, self.follows
        for j in range(len(last), len(word) + 1):
            for start in range(max(0, j - reach.get(word[max(0, j - 2) : j], 1)), j):
                t = inner.get(word[start:j])
                if t is not None and (not start or follows(last[start], t)):
                    break
            last.append(t)
            count.append(count[start] + 1)
        return last, count

    def _closed(self, word: str, j: int, last: list[int], count: list[int]) -> int:
        """Count of the first j symbols as a whole word."""
        if not j:
            return 0
        final, follows = self.final, self.follows
        for start in range(max(0, j - self.reach.get(word[max(0, j - 2) : j], 1)), j):
            t = final.get(word[start:j])
            if t is not None and (not start or follows(last[start], t)):
                return count[start] + 1
        raise ValueError(f"no encoding of {word[:j]!r}")

    def word(self, piece: str) -> int:
        """Tokens of a piece, given as Latin-1 characters that stand for its UTF-8 bytes."""
        last, count = self._last(piece[:-1])
        return self._closed(piece, len(piece), last, count)

    def _beyond_latin(self, segment: str) -> list[str]:
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(segment))
        return ["".join(chr(self.alphabet[c]) for c in piece) for piece, _ in cut]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.special_split is not None and "<|" in text:
            parts = self.special_split.split(text)
            return sum(self._count(p) for p in parts[0::2]) + len(parts) // 2
        return self._count(text)

    def _count(self, text: str) -> int:
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            total = 0
            for piece in self._beyond_latin(text):
                n = cache.get("\0" + piece)
                if n is None:
                    n = self.word(piece)
                    if len(piece) <= CACHE_BYTES:
                        cache["\0" + piece] = n
                total += n
            return total
        total = 0
        get = cache.get
        for piece in LATIN_1.findall(text.lower()):
            n = get(piece)
            if n is None:
                n = self.word(piece if piece.isascii() else piece.encode().decode("latin-1"))
                if len(piece) <= CACHE_BYTES:
                    cache[piece] = n
            total += n
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """Entry i: tokens of text[:i] as a text of its own, for i from 0 to len(text)."""
        out = np.zeros(len(text) + 1, np.int64)
        done = at = 0
        for m in self.special_split.finditer(text) if self.special_split is not None else ():
            # until its last character, a special string is text like any other
            out[at : m.end()] = done + self._prefixes(text[at : m.end() - 1])
            done = int(out[m.start()]) + 1
            at = m.end()
        out[at:] = done + self._prefixes(text[at:])
        return out

    def _prefixes(self, text: str) -> np.ndarray:
        """As ``prefix_counts``, of a text without special strings."""
        out = np.zeros(len(text) + 1, np.int64)
        done = at = 0
        for chunk in RUN.finditer(text):
            a, z = chunk.span()
            out[at:a] = done
            out[a : z + 1] = done + self._run_prefixes(chunk.group())
            done, at = int(out[z]), z
        out[at:] = done
        return out

    def _normal(self, part: str) -> str:
        known = self.normal.get(part)
        if known is None:
            if len(self.normal) > CACHE_WORDS:
                self.normal.clear()
            known = self.normal[part] = self.library.normalizer.normalize_str(part)
        return known

    def _run_prefixes(self, run: str) -> np.ndarray:
        """Counts of all prefixes of a run without blanks."""
        if run.isascii() and not SEPARATORS.search(run):
            n, parts = run.lower(), list(run)
            pieces = [(m.group(), m.start()) for m in LATIN_1.finditer(n)]
        else:
            n = self.library.normalizer.normalize_str(run)
            parts = list(run)
            if "".join(map(self._normal, parts)) != n:
                parts = clusters(run)
                if "".join(map(self._normal, parts)) != n:  # rules of another Unicode version: count every prefix
                    return np.array([self._count(run[:i]) for i in range(len(run) + 1)], np.int64)
            pieces = [(n[a:z], a) for _, (a, z) in self.library.pre_tokenizer.pre_tokenize_str(n)]
        ends = np.zeros(len(n) + 1, np.int64)  # of every prefix of the normalised run
        walks: list[tuple[int, str, list[int], list[int]]] = []  # of every piece: start, bytes, last tokens, counts
        base = done = 0
        for piece, a in pieces:
            ends[done : a + 1] = base
            raw = piece.encode().decode("latin-1")
            last, count = self._last(raw)
            if len(piece) > 1 and piece[0] == "'" and piece[1].isalpha():  # a contraction cut short is something else
                got = [self._count(piece[:k]) for k in range(1, len(piece) + 1)]
            else:
                stops = np.cumsum([len(c.encode()) for c in piece]).tolist() if len(raw) != len(piece) else range(1, len(raw) + 1)
                got = [self._closed(raw, j, last, count) for j in stops]
            ends[a + 1 : a + len(piece) + 1] = base + np.array(got, np.int64)
            walks.append((a, raw, last, count))
            done = a + len(piece)
            base = int(ends[done])
        ends[done:] = base
        if len(parts) == len(run):
            return ends[np.cumsum([0, *(len(self._normal(c)) for c in parts)])] if len(n) != len(run) else ends
        starts = [a for a, _, _, _ in walks]
        out, off = [0], 0
        for part in parts:
            for k in range(1, len(part)):
                out.append(self._inside(n, off, self._normal(part[:k]), ends, walks, starts))
            off += len(self._normal(part))
            out.append(int(ends[off]))
        return np.array(out, np.int64)

    def _inside(self, n: str, off: int, tail: str, ends: np.ndarray, walks: list, starts: list[int]) -> int:
        """Count of the first ``off`` normalised characters with an unfinished one after them."""
        quote = n.find("'", max(0, off - 3), off)
        if quote >= 0:  # may become a contraction
            a = walks[bisect.bisect_right(starts, quote) - 1][0]
            return int(ends[a]) + self._count(n[a:off] + tail)
        k = bisect.bisect_left(starts, off) - 1  # the piece that is open there, if any
        if k < 0:
            return self._count(tail)
        a, raw, last, count = walks[k]
        cut = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(n[off - 1 : off] + tail)]
        first = "".join(chr(self.alphabet[c]) for c in cut[0])
        own = len(n[off - 1].encode())
        rest = sum(self.word("".join(chr(self.alphabet[c]) for c in p)) for p in cut[1:])
        if len(first) == own:  # the piece is complete
            return int(ends[off]) + rest
        size = len(n[a:off].encode())
        word = raw[:size] + first[own:]
        return int(ends[a]) + self._closed(word, len(word), *self._last(word, last[: size + 1], count[: size + 1])) + rest


def clusters(run: str) -> list[str]:
    """A run cut where characters don't combine with those before them."""
    nfc = lambda x: unicodedata.normalize("NFC", x)
    out: list[str] = []
    for c in run:
        if out and (unicodedata.combining(c) or nfc(out[-1] + c) != nfc(out[-1]) + nfc(c)):
            out[-1] += c
        else:
            out.append(c)
    return out


def longest_prefix(prefix_tokens: np.ndarray, budget: int) -> int:
    """Length of the longest prefix of at most ``budget`` tokens, from its stored counts."""
    return int(np.flatnonzero(np.asarray(prefix_tokens) <= budget)[-1])


def tokens_within(stored: DataFrame, n_chars: Column | int) -> DataFrame:
    """Adds ``tokens``: those of the first ``n_chars`` characters (of the whole text if it is shorter), from ``prefix_tokens``."""
    at = F.least(F.greatest(n_chars if isinstance(n_chars, Column) else F.lit(n_chars), F.lit(0)), F.size("prefix_tokens") - 1)
    return stored.withColumn("tokens", F.element_at("prefix_tokens", (at + 1).cast("int")))


def truncated(stored: DataFrame, budget: Column | int) -> DataFrame:
    """Adds ``chars_kept``: the length of the longest prefix of at most ``budget`` tokens (null for a negative budget), from ``prefix_tokens``."""
    most = budget if isinstance(budget, Column) else F.lit(budget)
    return stored.withColumn("chars_kept", F.array_max(F.transform("prefix_tokens", lambda n, i: F.when(n <= most, i))))


_LOADED: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, one for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = PrefixCounter(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, store_prefixes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_tokens`` and, if asked for, ``prefix_tokens`` (array, entry i for the first i characters).

    ``path`` is the vocabulary file, at the same place on every executor.
    """
    text_batches(docs.sparkSession)
    schema = COUNTED + (", prefix_tokens array<int>" if store_prefixes else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(1)]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            if store_prefixes:
                stored = [c.prefix_counts(t) for t in texts]
                cols = [pa.array([int(s[-1]) for s in stored], pa.int64()), pa.array(stored, pa.list_(pa.int32()))]
                yield pa.record_batch([b.column(0), sizes, *cols], ["doc_id", "n_bytes", "n_tokens", "prefix_tokens"])
            else:
                yield pa.record_batch([b.column(0), sizes, pa.array([c.count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)
