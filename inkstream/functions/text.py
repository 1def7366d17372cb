"""Text functions as Column expressions; blanks and words follow Unicode, not ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream import fixed

#: One blank, one word character.
WS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
W = r"[\p{L}\p{N}_]"
#: All blanks of WS, as characters.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; inside lambdas a repeated expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Words between blanks."""
    return F.array_remove(F.split(text, f"{WS}+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def longer_than(text: Column, n: int) -> Column:
    """Whether a text has over ``n`` words; words are counted only where the text is long enough for that many."""
    return F.when(F.length(text) <= 2 * n, False).otherwise(word_count(text) > n)


def canonical_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def join_hyphens(text: Column) -> Column:
    """A word broken by a hyphen at the end of a line becomes one word."""
    return F.when(F.contains(text, F.lit("-\n")), sub(text, rf"(?<!{W})({W}++)-\n({W}++)", "$1$2")).otherwise(text)


def join_soft_wraps(text: Column) -> Column:
    """A single newline between word characters becomes a blank."""
    return sub(text, rf"(?<={W})\n(?={W})", " ")


def squeeze_blanks(text: Column) -> Column:
    return sub(text, "[ \\t]{2,}|\\t", " ")  # single blanks stay as they are


def squeeze_blank_lines(text: Column) -> Column:
    return sub(text, "\\n{3,}", "\n\n")


def clean_prose(text: Column) -> Column:
    """All cleaning steps in order; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for step in (canonical_newlines, join_hyphens, join_soft_wraps, squeeze_blanks, squeeze_blank_lines, strip):
        out = step(out)
    return out


def expand_honorifics(text: Column) -> Column:
    def spelled(short: str, long: str):
        # a pass over a text only where the abbreviation occurs
        return lambda t: F.when(F.contains(t, F.lit(f"{short}.")), sub(t, rf"{short}\.(?<!{W}{short}\.){WS}+", f"{long} ")).otherwise(t)

    for short, long in fixed.HONORIFICS:
        text = let(text, spelled(short, long))
    return text


def drop_thousands_commas(text: Column) -> Column:
    return sub(text, rf",(?<=\p{{Nd}},)(?=\p{{Nd}}{{3}}(?!{W}))", "")


def space_dashes(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("—"), F.lit(" -- ")), F.lit("–"), F.lit(" - "))


def squeeze_ellipses(text: Column) -> Column:
    return sub(text, r"\.{3,}", "...")


def collapse_blanks(text: Column) -> Column:
    return strip(sub(text, rf"{WS}{{2,}}|(?! ){WS}", " "))  # single blanks stay as they are


def normalize_text(text: Column) -> Column:
    """Text as it is spoken."""
    for step in (expand_honorifics, drop_thousands_commas, space_dashes, squeeze_ellipses, collapse_blanks):
        text = step(text)
    return text


def sentences(text: Column) -> Column:
    """Split after .!?… and blanks, before A-Z, a quote or a digit."""
    return F.split(text, rf'(?<=[.!?…]){WS}+(?=[A-Z"“0-9])')


def heading_text(paragraph: Column) -> Column:
    return strip(sub(paragraph, rf"\A#+{WS}*", ""))


def paragraphs(text: Column) -> Column:
    """Paragraphs between empty lines, stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(text, "\\n\\n"), strip), lambda p: p != "")


def is_title(word: Column) -> Column:
    """Upper case only where a run of letters starts, with at least one such letter."""
    return word.rlike(r"\p{Lu}|\p{Lt}") & ~word.rlike(r"[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]|(?<![\p{Lu}\p{Ll}\p{Lt}])\p{Ll}")


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first and small letters after."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def file_title(path: Column) -> Column:
    """A title from a file's name: no folder, no extension, blanks for underscores, title case."""
    name = F.element_at(F.split(path, "/"), -1)
    return title_case(F.replace(sub(name, r"(?<=[^.])\.[^.]*\z", ""), F.lit("_"), F.lit(" ")))


def slug(title: Column) -> Column:
    """Lower case, everything but letters and digits as underscores, none at the ends."""
    return sub(sub(F.lower(title), r"[^\p{L}\p{N}]", "_"), r"\A_+|_+\z", "")


def mmss(seconds: Column) -> Column:
    """Minutes and seconds; 00:00 for negative, missing or undefined times."""
    ok = seconds.isNotNull() & ~F.isnan(seconds.cast("double")) & (seconds >= 0)
    whole = F.floor(F.when(ok, seconds).otherwise(0))
    return F.concat(_two(F.floor(whole / 60)), F.lit(":"), _two(whole % 60))


def _two(n: Column) -> Column:
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def mime_type(path: Column) -> Column:
    return F.when(path.endswith(".mp3"), "audio/mpeg").when(path.endswith(".m4b"), "audio/mp4").otherwise("audio/wav")
