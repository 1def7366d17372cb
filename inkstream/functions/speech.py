"""Native forms of the text rules that attribution uses: speech verbs, tag candidates, genders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream import fixed
from inkstream.functions.text import W, WS, is_title, let, strip, sub, words

VERB = rf"(?i)(?<!{W})({'|'.join(fixed.SPEECH_VERBS)})(?!{W})"


def tag_sentence(narration: Column, after: Column | bool) -> Column:
    """The sentence next to the quotation: the first after it, the last before it."""
    parts = F.filter(F.transform(F.split(narration, "[.!?]"), strip), lambda s: s != "")
    side = F.lit(after) if isinstance(after, bool) else after
    return F.when(F.size(parts) > 0, F.when(side, F.element_at(parts, 1)).otherwise(F.element_at(parts, -1)))


def speech_verb(sentence: Column) -> Column:
    """The leftmost speech verb; null without one."""
    return F.nullif(F.regexp_extract(sentence, VERB, 1), F.lit(""))


def tag_candidate(sentence: Column) -> Column:
    """Who is said to speak: the words before the verb, else those after it, up to a comma; null without a verb."""
    halves = F.split(sentence, VERB, 2)
    before, rest = strip(F.element_at(halves, 1)), strip(F.element_at(halves, -1))
    who = F.when(before != "", before).otherwise(rest)
    who = strip(sub(who, rf"(?i)\A(and|as|then|while|with){WS}+", ""))
    return F.when(speech_verb(sentence).isNotNull(), strip(F.element_at(F.split(who, ","), 1)))


def names(text: Column) -> Column:
    """Capitalised names of one or two tokens, from each token on; stop words are none."""
    bare = F.transform(words(text), lambda w: sub(w, rf"[^{W[1:-1]}]", ""))
    marked = F.transform(bare, lambda b: F.struct(b.alias("b"), (is_title(b) & ~F.lower(b).isin(*fixed.STOP_WORDS)).alias("named")))
    pair = lambda all_, x, i: F.when(F.coalesce(F.get(all_, i + 1)["named"], F.lit(False)), F.concat(x["b"], F.lit(" "), F.get(all_, i + 1)["b"])).otherwise(x["b"])
    found = let(marked, lambda all_: F.transform(all_, lambda x, i: F.when(x["named"], pair(all_, x, i))))
    return F.filter(found, lambda n: n.isNotNull())


def gender(name: Column, context: Column) -> Column:
    """As attribution guesses it for a character not known yet."""
    tokens, low = F.split(F.lower(name), f"{WS}+"), F.lower(name)
    titled = lambda titles: F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in titles]))
    named = lambda names: low.rlike("|".join(names))
    near = lambda words: F.lower(context).rlike(rf"(?<!{W})({'|'.join(words)})(?!{W})")
    return (
        F.when(titled(fixed.FEMALE_TITLES) | named(fixed.FEMALE_NAMES), "female")
        .when(titled(fixed.MALE_TITLES) | named(fixed.MALE_NAMES), "male")
        .when(near(("she", "her", "hers")), "female")
        .when(near(("he", "him", "his")), "male")
        .otherwise("unknown")
    )
