"""Who speaks: a fold over a document's chunks, and what follows from it natively.

Attribution feeds its own state (known characters, who spoke last, which man and
woman were last in focus, recent names), so it is the one sequential step; it runs
document by document through Arrow. Line counts, genders and the graph of who
talks to whom are plain aggregations and windows over its result.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream import fixed
from inkstream.operators.cast_spec import Member

UNKNOWN_SPEAKER, UNKNOWN = "Unknown Speaker", "unknown"
VERBS, STOPS = frozenset(fixed.SPEECH_VERBS), frozenset(fixed.STOP_WORDS)
MALE, FEMALE = frozenset(fixed.MALE_TITLES), frozenset(fixed.FEMALE_TITLES)
SHE, HE = frozenset(("she", "her", "hers")), frozenset(("he", "him", "his"))
RUN = re.compile(r"\w+")
LEAD_IN = re.compile(fixed.LEAD_IN, re.I)
PRONOUNS = {"she": "female", "her": "female", "herself": "female", "he": "male", "him": "male", "himself": "male"}


def guess_gender(name: str, context: str) -> str:
    """Gender from titles in the name, then known names inside it (female before male), then pronouns nearby."""
    low = name.lower()
    tokens = set(low.split())
    for gender, titles, names in (("female", FEMALE, fixed.FEMALE_NAMES), ("male", MALE, fixed.MALE_NAMES)):
        if tokens & titles or any(n in low for n in names):
            return gender
    near = {m.lower() for m in RUN.findall(context.lower())}
    return "female" if near & SHE else "male" if near & HE else UNKNOWN


def spoken_names(tokens: list[str]) -> Iterator[str]:
    """Capitalised names of one or two tokens, from each token on."""
    bare = [re.sub(r"[^\w]", "", t) for t in tokens]
    named = [b.istitle() and b.lower() not in STOPS for b in bare]
    for i, word in enumerate(bare):
        if named[i]:
            yield f"{word} {bare[i + 1]}" if i + 1 < len(bare) and named[i + 1] else word


@dataclass
class Scene:
    """What has been read so far of one document."""

    genders: dict[str, str] = field(default_factory=dict)  # of characters, in the order they appeared
    keys: dict[str, str] = field(default_factory=dict)  # lower-cased ways to name a character
    focus: dict[str, str] = field(default_factory=dict)  # character last in focus, by gender
    recent: deque = field(default_factory=lambda: deque(maxlen=10))
    last: str | None = None
    before: str | None = None

    @classmethod
    def opened_by(cls, cast: list[Member]) -> Scene:
        scene = cls()
        for m in cast:
            scene.introduce(m.name, m.gender, m.aliases)
        for gender in ("female", "male"):
            first = next((n for n, g in scene.genders.items() if g == gender), None)
            if first:
                scene.focus[gender] = first
        return scene

    def introduce(self, name: str, gender: str, aliases: tuple[str, ...] = ()) -> None:
        self.genders[name] = gender
        first = (name.split()[:1] if " " in name else [])[:1]
        for key in (name, *aliases, *first):
            self.keys.setdefault(key.lower(), name)

    def known(self, candidate: str) -> str | None:
        return self.keys.get(candidate.lower().strip())

    def gender_of(self, name: str, context: str) -> str:
        held = self.genders.get(name, UNKNOWN)
        return held if held != UNKNOWN else guess_gender(name, context)

    def overhear(self, text: str) -> None:
        """Names in narration become recent subjects; the oldest of ten gives way."""
        for name in spoken_names(re.sub("['’\"]", "", text).split()):
            name = self.known(name) or name
            if name not in self.recent:
                self.recent.append(name)

    def subject(self, gender: str) -> str:
        """The man or woman meant by a pronoun."""
        other = "male" if gender == "female" else "female"
        newest = next((n for n in reversed(self.recent) if self.genders.get(n) != other), None)
        name = self.focus.get(gender) or newest or f"{gender.title()} Speaker"
        self.focus[gender] = name
        return name

    def resolve(self, candidate: str, sentence: str) -> tuple[str, str]:
        first = candidate.lower().split()[0]
        if first in PRONOUNS:
            return self.subject(PRONOUNS[first]), PRONOUNS[first]
        if first in ("they", "someone"):
            return "Speaker", "neutral"
        plain = re.sub(r"[^\w\s]", "", candidate).strip()
        name = self.known(plain)
        gender = self.gender_of(name or plain.title(), sentence)
        if name:
            self.genders[name] = gender
        else:
            name = plain.title()
        if gender in ("male", "female"):
            self.focus[gender] = name
        return name, gender

    def tagged(self, narration: str, after: bool) -> tuple[str, str] | None:
        """The speaker named beside a quotation: by a speech verb, else by the first name there."""
        parts = [s for s in map(str.strip, re.split("[.!?]", narration)) if s]
        if not parts:
            return None
        sentence = parts[0 if after else -1]
        verb = next((m for m in RUN.finditer(sentence) if m.group().lower() in VERBS), None)
        if verb:
            who = sentence[: verb.start()].strip() or sentence[verb.end() :].strip()
            who = LEAD_IN.sub("", who).strip().split(",")[0].strip()
            if who:
                return self.resolve(who, sentence)
        name = next(spoken_names(sentence.split()), None)
        if name is None:
            return None
        name = self.known(name) or name
        return name, self.gender_of(name, sentence)

    def speaker(self, previous: str | None, following: str | None) -> tuple[str, str]:
        """The tag after the quotation, the beat before it, the other partner, the last speaker, the only character."""
        for narration, after in ((following, True), (previous, False)):
            found = self.tagged(narration, after) if narration else None
            if found and found[0]:
                return found
        name = self.before or self.last or (next(iter(self.genders)) if len(self.genders) == 1 else None)
        return (name, self.genders.get(name, UNKNOWN)) if name else (UNKNOWN_SPEAKER, UNKNOWN)

    def hear(self, name: str, gender: str) -> None:
        """Account for a line just attributed."""
        if not name or name == UNKNOWN_SPEAKER:
            return
        if name not in self.genders:
            self.introduce(name, gender)
        elif self.genders[name] == UNKNOWN:
            self.genders[name] = gender
        if gender in ("male", "female"):
            self.focus[gender] = name
        if name != self.last:
            self.before, self.last = self.last, name


def attribute_document(kinds: list[str], texts: list[str], cast: list[Member]) -> list[tuple[str | None, str | None]]:
    """Speaker and gender of each chunk in order; none for what is not dialogue."""
    scene, out = Scene.opened_by(cast), []
    for i, (kind, text) in enumerate(zip(kinds, texts, strict=True)):
        found: tuple[str | None, str | None] = (None, None)
        if kind in ("narration", "heading"):
            scene.overhear(text)
        elif kind == "dialogue":
            beside = [texts[k] if 0 <= k < len(texts) and kinds[k] == "narration" else None for k in (i - 1, i + 1)]
            found = scene.speaker(*beside)
            scene.hear(*found)
        out.append(found)
    return out


def attribute(chunks: DataFrame, cast: list[Member] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Adds ``character`` and ``gender``; chunks need ``seq``."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("character", T.StringType()), T.StructField("gender", T.StringType())])
    members = cast or []

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        found = attribute_document(pdf.chunk_type.tolist(), pdf.text.tolist(), members)
        return pdf.assign(character=[f[0] for f in found], gender=[f[1] for f in found])

    return chunks.groupBy(id_col).applyInPandas(fold, schema)


def spoken_lines(attributed: DataFrame) -> DataFrame:
    return attributed.where((F.col("chunk_type") == "dialogue") & F.col("character").isNotNull() & ~F.col("character").isin("", UNKNOWN_SPEAKER))


def interactions(lines: DataFrame, id_col: str = "doc_id", speaker_col: str = "character") -> DataFrame:
    """Edges between speakers of consecutive lines, ``a < b``."""
    before = lines.withColumn("prev", F.lag(speaker_col).over(Window.partitionBy(id_col).orderBy("seq"))).where(F.col("prev") != F.col(speaker_col))
    return before.select(id_col, F.least(speaker_col, "prev").alias("a"), F.greatest(speaker_col, "prev").alias("b")).distinct()


def neighbours(edges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sorted partners of each character."""
    both = edges.select(id_col, F.col("a").alias("name"), F.col("b").alias("peer")).union(edges.select(id_col, "b", "a"))
    return both.groupBy(id_col, "name").agg(F.sort_array(F.collect_set("peer")).alias("interacts_with"))


def heard(lines: DataFrame, id_col: str = "doc_id", speaker_col: str = "character") -> DataFrame:
    """``doc_id, name, line_count, heard_gender`` (the first known), ``interacts_with``, from one pass over the lines."""
    other = F.nullif(F.lag(speaker_col).over(Window.partitionBy(id_col).orderBy("seq")), F.col(speaker_col))
    known = F.when(F.col("gender") != UNKNOWN, F.col("seq"))
    told = F.struct(F.col(speaker_col).alias("name"), F.lit(1).alias("said"), F.col("gender").alias("gender"), known.alias("known"), F.col("other").alias("peer"))
    answered = F.struct(F.col("other").alias("name"), F.lit(0).alias("said"), F.lit(None).cast("string").alias("gender"), F.lit(None).cast(lines.schema["seq"].dataType).alias("known"), F.col(speaker_col).alias("peer"))
    parts = lines.withColumn("other", other).select(id_col, F.inline(F.array(told, answered))).where("name is not null")
    return parts.groupBy(id_col, "name").agg(F.sum("said").alias("line_count"), F.min_by("gender", "known").alias("heard_gender"), F.sort_array(F.collect_set("peer")).alias("interacts_with"))


def characters(attributed: DataFrame, cast: list[Member] | None = None, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, name, gender, line_count, assigned_voice, aliases, interacts_with``: cast members first, then whoever spoke."""
    merged = heard(spoken_lines(attributed), id_col)
    if cast:
        member = lambda m: F.struct(F.lit(m.name).alias("name"), F.lit(m.gender).alias("own_gender"), F.lit(m.voice).cast("string").alias("assigned_voice"), F.array(*map(F.lit, m.aliases)).cast("array<string>").alias("aliases"))
        given = attributed.select(id_col).distinct().select(id_col, F.inline(F.array(*map(member, cast))))
        merged = merged.join(given, [id_col, "name"], "full_outer")
    else:
        merged = merged.withColumns({"own_gender": F.lit(None).cast("string"), "assigned_voice": F.lit(None).cast("string"), "aliases": F.lit(None).cast("array<string>")})
    gender = F.coalesce(F.nullif(F.col("own_gender"), F.lit(UNKNOWN)), F.col("heard_gender"), F.lit(UNKNOWN))
    return merged.select(
        id_col, "name", gender.alias("gender"), F.coalesce("line_count", F.lit(0).cast("long")).alias("line_count"), "assigned_voice",
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("interacts_with", F.array().cast("array<string>")).alias("interacts_with"),
    )
