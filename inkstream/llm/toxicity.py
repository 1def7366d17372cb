"""Toxicity by a weighted finite-state pattern grammar.

Small machines (weighted sequential transducers, tables of state and symbol) are composed into one. The lexical
transducer maps words to symbols: insult, slight (an insult on weaker evidence), threat, target, negation, reported speech, other. The target machine marks an
insult or a threat within ``TARGET_REACH`` words of a target; it runs over each clause from right to left and, composed with the others,
from left to right. The negation machine marks one within ``NEGATION_REACH`` words after a negation, the report machine one after
a verb of saying in its clause. The scoring machine reads the marked symbol and puts a weight on the arc: one for each kind and each
set of marks, less for the second and third match of a text, none from the fourth on. A text's score is the logistic
of the weight of its path, so what is weighed are matched clauses: an insult that is denied or quoted counts less than one that is aimed at
somebody, unless the labels say otherwise (arc weights have priors and are fitted).

Learning: words and word beginnings whose documents are marked toxic far more often
than chance allows form the lexicon of insults and, on weaker evidence, slights. At most ``per_class`` labelled rows of
each class are used, those with the smallest hashes; this bound is a parameter. Of near
copies among them one is counted, since a text copied often would lend its label to all its words. The lexicons of threats, targets, negations
and verbs of saying are fixed; what labels teach beyond them counts as insult.

Scale: the lexicon is counted by a partial aggregation on the cluster; only entries
that pass the test reach the driver, at most ``max_lexicon`` (a parameter). Texts
are cut into clauses of words once, and scanned whole by an automaton of the lexicon; only
those with a match pass the grammar.

Edge cases: null and empty texts match nothing and get the base score; without
labels of both classes the seed lexicon and the priors are used; labels of one
document that disagree count as toxic; repeated rows are scored row by row; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import materialize, text_batches, tidy
from inkstream.llm.jaccard_join import signatures, trie_rows
from inkstream.llm.lang_id import sample_by_class

# Seed words of the lexical transducer, for English, French, German and Spanish.
TARGETS = frozenset("you your yours u he she they him her them this that is are was were tu vous toi es êtes il elle du dich dir ihr sie bist ist tú vos usted eres él ella".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't nobody without ne pas jamais sans nicht nie kein keine ohne nunca sin jamás".split())
REPORTED = frozenset("said says say told called wrote claimed quoted according dit disait selon sagte sagt laut dijo dice según".split())
THREATS = frozenset("kill murder hurt stab shoot destroy strangle tuer frapper töten schlagen matar golpear".split())
INSULTS = frozenset("idiot moron scum worthless pathetic loser stupid".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SLIGHT, END = 6, 7  # an insult on weaker evidence; the end of a clause
TARGETED, NEGATED, REPORTED_MARK = 8, 16, 32  # marks beside a kind
CODES = 64
MATCHED = [kind | t | n | r for kind in (INSULT, THREAT, SLIGHT) for t in (0, TARGETED) for n in (0, NEGATED) for r in (0, REPORTED_MARK)]
LABEL = {code: k for k, code in enumerate(MATCHED)}
BAD = (INSULT, THREAT, SLIGHT)
TARGET_REACH, NEGATION_REACH = 5, 3
DECAY = (1.0, 0.5, 0.25, 0.0)  # of the first matches of a text and all further ones


def prior_weight(code: int) -> float:
    return max(0.5, {INSULT: 4.0, THREAT: 5.0, SLIGHT: 2.0}[code & 7] + (2.0 if code & TARGETED else 0.0) - (3.0 if code & NEGATED else 0.0) - (2.5 if code & REPORTED_MARK else 0.0))


PRIOR = np.array([-4.0, *map(prior_weight, MATCHED)])  # base, then the labels of MATCHED
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD_BYTES = bytes((c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 39 else 32) for c in range(256))
STEMS = (4, 5, 6)
SCORED = "doc_id long, score double"


def words_of(text: str) -> list[str]:
    """Lower-cased words; apostrophes stay inside."""
    return [w.strip("'") for w in text.lower().encode("utf-8", "replace").translate(WORD_BYTES).decode("utf-8", "replace").split()]


def clauses_of(text: str) -> list[list[str]]:
    """The words of each clause; what the automaton and the grammar both read."""
    return [words_of(clause) for clause in CLAUSE.split(text)]


class Machine:
    """A weighted sequential transducer: for each state and input code the output code, the arc's weight and the next state."""

    def __init__(self, states: int) -> None:
        self.out = np.tile(np.arange(CODES), (states, 1))
        self.weight = np.zeros((states, CODES))
        self.next = np.zeros((states, CODES), np.int64)

    def then(self, other: Machine) -> Machine:
        """The composition: this machine's output is the other's input; only states that can be reached."""
        number = {(0, 0): 0}
        todo, arcs = [(0, 0)], []
        for a, b in todo:
            row = []
            for x in range(CODES):
                y = int(self.out[a, x])
                to = (int(self.next[a, x]), int(other.next[b, y]))
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append((int(other.out[b, y]), self.weight[a, x] + other.weight[b, y], number[to]))
            arcs.append(row)
        made = Machine(len(arcs))
        for s, row in enumerate(arcs):
            for x, (y, w, to) in enumerate(row):
                made.out[s, x], made.weight[s, x], made.next[s, x] = y, w, to
        return made


def within(kind: int, reach: int, mark: int) -> Machine:
    """Marks insults and threats up to ``reach`` words after a word of a kind."""
    m = Machine(reach + 1)
    for left in range(reach + 1):
        for x in range(CODES):
            k = x & 7
            m.next[left, x] = 0 if k == END else reach if k == kind else max(0, left - 1)
            if k in BAD and left:
                m.out[left, x] = x | mark
    return m


def once(kind: int, mark: int) -> Machine:
    """Marks insults and threats anywhere in the clause after a word of a kind."""
    m = Machine(2)
    for seen in range(2):
        for x in range(CODES):
            k = x & 7
            m.next[seen, x] = 0 if k == END else 1 if k == kind else seen
            if k in BAD and seen:
                m.out[seen, x] = x | mark
    return m


def scoring(weights: np.ndarray) -> Machine:
    """Weighs matched symbols by label, less with each match before; its state outlives the clause."""
    m = Machine(len(DECAY))
    for n, share in enumerate(DECAY):
        for x in range(CODES):
            m.next[n, x] = n
            if x in LABEL:
                m.weight[n, x] = share * weights[LABEL[x]]
                m.next[n, x] = min(n + 1, len(DECAY) - 1)
    return m


@dataclass
class Grammar:
    """The lexical transducer, and the weights of the arcs of the composed grammar."""

    words: dict[str, int] = field(default_factory=dict)
    stems: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=PRIOR.copy)

    def machines(self) -> tuple[list, list, list, list, list]:
        """Tables: marks and next states from right to left; output, weight and next states of the composition from left to right."""
        key = self.weights.tobytes()
        if self.__dict__.get("_built", (None,))[0] != key:
            back = within(TARGET, TARGET_REACH, TARGETED)
            whole = within(TARGET, TARGET_REACH, TARGETED).then(within(NEGATION, NEGATION_REACH, NEGATED)).then(once(REPORT, REPORTED_MARK)).then(scoring(self.weights[1:]))
            self.__dict__["_built"] = (key, tuple(x.tolist() for x in (back.out, back.next, whole.out, whole.weight, whole.next)))
        return self.__dict__["_built"][1]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_built"}

    def symbol(self, word: str) -> int:
        s = self.words.get(word)
        if s is not None:
            return s
        return SLIGHT if any(word[:n] in self.stems for n in STEMS) else OTHER

    def automaton(self):
        """An automaton that finds texts with an insult or a threat."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for w, s in self.words.items():
            if s in BAD:
                a.add_word(f" {w} ".encode().decode("latin-1"), 1)
        for stem in self.stems:
            a.add_word(f" {stem}".encode().decode("latin-1"), 1)
        if len(a):
            a.make_automaton()
        return a

    @staticmethod
    def line(clauses: list[list[str]]) -> str:
        """The words as the automaton reads them."""
        return f" {' '.join(w for words in clauses for w in words)} ".encode("utf-8", "replace").decode("latin-1")

    def path(self, clauses: list[list[str]]) -> tuple[float, list[int]]:
        """Weight of a text's path through the composed machine, and the marked symbols matched on it."""
        back_out, back_next, out, weight, following = self.machines()
        state, total, matched = 0, 0.0, []
        for words in clauses:
            symbols = [self.symbol(w) for w in words]
            if not any(x in symbols for x in BAD):
                continue  # passes without weight, and the clause's end forgets the rest
            ahead = 0
            for i in range(len(symbols) - 1, -1, -1):
                x = symbols[i]
                symbols[i], ahead = back_out[ahead][x], back_next[ahead][x]
            for x in symbols:
                if out[state][x] in LABEL:
                    matched.append(out[state][x])
                    total += weight[state][x]
                state = following[state][x]
            state = following[state][END]
        return total, matched

    def patterns(self, text: str) -> list[int]:
        """The marked insults and threats of a text."""
        return self.path(clauses_of(text))[1]

    def features(self, text: str) -> np.ndarray:
        """What the weights of the labels are multiplied with on a text's path."""
        x = np.zeros(len(MATCHED))
        for n, code in enumerate(self.patterns(text)):
            x[LABEL[code]] += DECAY[min(n, len(DECAY) - 1)]
        return x

    def score(self, clauses: list[list[str]]) -> float:
        z = float(self.weights[0]) + self.path(clauses)[0]
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))

    def score_text(self, text: str) -> float:
        return self.score(clauses_of(text))


def seeds() -> dict[str, int]:
    return {w: s for group, s in ((TARGETS, TARGET), (REPORTED, REPORT), (NEGATIONS, NEGATION), (THREATS, THREAT), (INSULTS, INSULT)) for w in group}


def _gain(t: int, c: int, toxic: int, clean: int) -> float:
    """Log-likelihood ratio of the share of toxic documents among those with the word; 0 if not above the base rate."""
    base, share = toxic / (toxic + clean), t / (t + c)
    if share <= base:
        return 0.0
    return 2.0 * (t * math.log(share / base) + (c * math.log((1 - share) / (1 - base)) if c else 0.0))


def fit_weights(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, strength: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Logistic weights with a Gaussian prior, by Newton's method."""
    a, w = np.hstack([np.ones((len(x), 1)), x]), prior.copy()
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + strength * (w - prior)
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + strength * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    w[1:] = np.maximum(w[1:], 0.0)
    return w


def _unlike(rows: DataFrame, trees: int = 6, depth: int = 3) -> DataFrame:
    """Without rows whose near copy has a smaller id: copies of one text would vouch for each of its words."""
    signed = signatures(rows, "id", "text", 5, trees, depth).where("doc_id is not null and labels is not null")
    keyed = trie_rows(signed.withColumnRenamed("doc_id", "node"), trees, depth).select(F.col("node").alias("id"), "tree", F.col("label").alias("key"))
    first = keyed.groupBy("tree", "key").agg(F.min("id").alias("first"))
    copies = keyed.join(first, ["tree", "key"]).where("first < id").select("id").distinct()
    return rows.join(copies, "id", "left_anti")


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2500, min_gain: float = 18.0, strong_gain: float = 60.0, min_share: float = 0.9, max_lexicon: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """Lexicon and weights from labelled rows; both inputs must already leave out what is held out."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    picked = sample_by_class(marks, "y", "id", per_class, {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()})
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id").where(F.length("text") > 0)
    rows = materialize(_unlike(materialize(rows, "labelled")), "unlike")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    grammar = Grammar(words=seeds())
    if not toxic or not clean:
        return grammar

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list[str] = []
            ys: list[int] = []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = set(words_of(text))
                own |= {f"{w[:n]}*" for w in list(own) for n in STEMS if len(w) > n}
                keys += own
                ys += [y] * len(own)
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(ys, pa.int32())], ["key", "y"])

    base = toxic / (toxic + clean)
    counted = rows.select("text", "y").mapInArrow(tidy(spell), "key string, y int").groupBy("key").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    kept = counted.where((F.col("t") >= 3) & (F.col("t") / (F.col("t") + F.col("c")) >= max(min_share, base))).orderBy(F.desc("t"), "key").limit(max_lexicon)
    strong = [r for r in kept.collect() if _gain(r.t, r.c, toxic, clean) >= min_gain]
    grammar.words |= {r.key: INSULT if _gain(r.t, r.c, toxic, clean) >= strong_gain else SLIGHT for r in strong if not r.key.endswith("*") and grammar.words.get(r.key) not in BAD}
    shared = Counter(r.key[:n] for r in strong if not r.key.endswith("*") for n in STEMS)  # a beginning of one word only says no more than the word
    stems = {r.key[:-1] for r in strong if r.key.endswith("*") and r.t / (r.t + r.c) >= 0.97 and shared[r.key[:-1]] > 1}
    grammar.stems = frozenset(s for s in stems if not any(s[:n] in stems for n in STEMS if n < len(s)))

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [grammar.features(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array(seen, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    seen = rows.select("text", "y").mapInArrow(tidy(observe), "x array<double>, y int").groupBy("x", "y").agg(F.count("*").alias("n")).collect()
    x = np.repeat(np.array([r.x for r in seen]), [r.n for r in seen], axis=0)
    y = np.repeat(np.array([r.y for r in seen], float), [r.n for r in seen])
    grammar.weights = fit_weights(x, y)
    return grammar


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, score`` in 0 to 1."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        automaton = g.automaton()
        base = g.score([])
        for b in batches:
            out = []
            for x in b.column(1):
                text = x.as_py() or ""
                clauses = clauses_of(text)
                if len(automaton) and next(automaton.iter(g.line(clauses)), None) is not None:
                    out.append(g.score(clauses))
                else:
                    out.append(base)
            yield pa.record_batch([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), SCORED)
