"""HTML: native expressions over the raw text, and a structured reading with the standard parser in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkstream import fixed
from inkstream.functions.text import strip, sub, word_count

TITLE, AUTHOR = "Web Article", "Unknown Author"
#: What a byline can't lack; found in one pass, while the whole pattern starts anew at every word.
BY = r"\s--\s+(?:a\s+novelette\s+)?by\s"
#: Entities that text in practice holds.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_tags(html: Column) -> Column:
    """Every tag as a blank."""
    return sub(html, "<[^>]+>", " ")


def drop_boilerplate(html: Column) -> Column:
    """Without scripts, styles, navigation and the like, and without comments."""
    return sub(sub(html, rf"(?is)<({'|'.join(fixed.DROPPED_TAGS)})\b[^>]*>.*?</\1\s*>", ""), "(?s)<!--.*?-->", "")


def page_title(html: Column) -> Column:
    found = strip(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(TITLE))


def page_author(html: Column) -> Column:
    tag = F.regexp_extract(html, r"(?is)<meta\b(?=[^>]*\bname\s*=\s*[\"'][^\"']*author)[^>]*>", 0)
    found = strip(unescape(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)", 1)))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(AUTHOR))


def byline(html: Column, title: Column, author: Column) -> tuple[Column, Column]:
    """Title and author, overridden by a line ``Title -- by Author``."""
    likely = html.rlike(f"(?i){BY}")
    t, a = (F.when(likely, strip(F.regexp_extract(html, f"(?i){fixed.BYLINE}", k))).otherwise("") for k in (1, 2))
    return F.when((t != "") & ~F.lower(title).startswith("infinity"), t).otherwise(title), F.when(a != "", a).otherwise(author)


def blocks(html: Column) -> Column:
    """Headings, paragraphs and quotations in order, as array of struct(tag, text, bold); blocks must be closed."""
    body = drop_boilerplate(html)
    found = F.regexp_extract_all(body, F.lit(r"(?is)<(h[1-4]|p|blockquote)\b[^>]*>.*?</\1\s*>"), F.lit(0))
    as_block = lambda b: F.struct(
        F.lower(F.regexp_extract(b, r"(?is)\A<(h[1-4]|p|blockquote)", 1)).alias("tag"), strip(unescape(sub(b, "<[^>]+>", ""))).alias("text"), b.rlike(r"(?i)<b\b").alias("bold")
    )
    return F.filter(F.transform(found, as_block), lambda b: b["text"] != "")


def paragraph_words(blocks: Column) -> tuple[Column, Column]:
    """Words and number of the paragraphs among blocks."""
    paragraphs = F.filter(blocks, lambda b: b["tag"] == "p")
    return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda n, b: n + word_count(b["text"])), F.size(paragraphs).cast("long")


def block_line(block: Column) -> Column:
    """A block as a line of a manuscript; headings and short bold paragraphs open a chapter."""
    heading = block["tag"].rlike(r"^h[1-4]$") | ((block["tag"] == "p") & block["bold"] & (word_count(block["text"]) <= 10))
    return F.when(heading, F.concat(F.lit("# "), block["text"])).otherwise(block["text"])


class _Tree(HTMLParser):
    """Text blocks with the containers they stand in, as a lenient parser sees them."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.nodes: list[dict] = []
        self.title: list[str] = []
        self.author = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag == "meta" and not self.author and re.search("author", given.get("name") or "", re.I):
            self.author = (given.get("content") or "").strip()
        if tag in self.VOID:
            return
        node = {"tag": tag, "text": [], "bold": False, "within": list(self.open), "dropped": tag in fixed.DROPPED_TAGS or any(n["dropped"] for n in self.open)}
        if tag == "b":
            for n in self.open:
                n["bold"] = True
        self.open.append(node)
        self.nodes.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in self.VOID:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if any(n["dropped"] for n in self.open):
            return
        for n in self.open:
            n["text"].append(data)


def read_page(html: str) -> tuple[str, str, str]:
    """Title, author and prose of a page: the lines of the container with the most words in paragraphs (the first of equals)."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    live = [n for n in tree.nodes if not n["dropped"]]
    text = lambda n: "".join(n["text"]).strip()
    title = next((text(n) for n in live if n["tag"] == "title"), "") or TITLE
    author = tree.author or AUTHOR
    line = re.search(fixed.BYLINE, html, re.I) if re.search(BY, html or "", re.I) else None
    if line:
        if line.group(1).strip() and not title.lower().startswith("infinity"):
            title = line.group(1).strip()
        author = line.group(2).strip() or author
    score = {id(n): 0 for n in live if n["tag"] in fixed.CONTAINER_TAGS}
    for p in (n for n in live if n["tag"] == "p"):
        words = len("".join(p["text"]).split())
        for n in p["within"]:
            if id(n) in score:
                score[id(n)] += words
    best, most = next((n for n in live if n["tag"] == "body"), None), 0
    for n in live:
        if score.get(id(n), 0) > most:
            best, most = n, score[id(n)]
    lines = []
    for n in live:
        if n["tag"] in fixed.TEXT_TAGS and text(n) and (best is None or any(w is best for w in n["within"])):
            heading = n["tag"] in ("h1", "h2", "h3", "h4") or (n["tag"] == "p" and n["bold"] and len(text(n).split()) <= 10)
            lines.append(f"# {text(n)}" if heading else text(n))
    return title, author, "\n\n".join(lines)


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("title", "author", "prose")]))
def parse_html(html: pd.Series) -> pd.DataFrame:
    """Structured reading of whole pages."""
    return pd.DataFrame([read_page(h) for h in html], columns=["title", "author", "prose"])


__all__ = ["block_line", "blocks", "paragraph_words", "byline", "drop_boilerplate", "page_author", "page_title", "parse_html", "read_page", "strip_tags", "unescape"]
