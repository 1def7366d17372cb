"""URL filters: host-suffix and path-prefix expressions, hash-prefix equi-join, full-digest check.

Each URL is expanded into expressions ``host suffix + path prefix``. A rule fits
its host and all subdomains when the path starts with the rule's path, so the
path prefixes needed are exactly those with the length of some rule's path. The
expressions are equi-joined with the rules on the first ``prefix_hex`` digits of
their SHA-256, then confirmed on the full digest; the longest rule wins.

The rules are broadcast only while there are at most ``max_broadcast_rules``;
a larger list is joined by shuffle on the hash prefix.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no
rule and gets the default verdict; an empty path does not start with ``/``; rules
of equal length rank by longer host, then ``block`` before ``allow``; repeated rows
are judged row by row; rules with null fields are ignored; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AUTHORITY = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for null or for a url without ``://``."""
    host = F.translate(F.regexp_extract(url, AUTHORITY, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, AUTHORITY, 2), F.lit(""))


def prepare_rules(rules: DataFrame, prefix_hex: int = 8) -> DataFrame:
    """Rules with columns host, path, action to digests; duplicates collapse."""
    kept = rules.select("host", "path", "action").where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isNotNull()).distinct()
    rule = F.concat("host", "path")
    return kept.select(
        rule.alias("rule"), F.col("action").alias("rule_action"), F.char_length(rule).alias("rule_len"), F.char_length("host").alias("host_len"), F.char_length("path").alias("path_len"),
        F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("rule_digest"), F.substring(F.sha2(F.concat_ws("\n", "host", "path"), 256), 1, prefix_hex).alias("hash_prefix"),
    )


def filter_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_hex: int = 8, max_broadcast_rules: int = 100_000) -> DataFrame:
    """Per row: ``page_id, host, path, rule, verdict``."""
    ready = prepare_rules(rules, prefix_hex)
    lengths = sorted(r.path_len for r in ready.select("path_len").distinct().toLocalIterator())
    small = ready.limit(max_broadcast_rules + 1).count() <= max_broadcast_rules
    host, path = split_url(F.col(url_col))
    base = urls.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.when(F.char_length("path") >= n, F.substring(F.col("path"), F.lit(1), n))), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\n", s, p), 256))))
    expanded = base.select("row_id", "page_id", "host", "path", F.explode_outer(F.when(F.col("host") != "", pairs)).alias("digest")).withColumn("hash_prefix", F.substring("digest", 1, prefix_hex))
    joined = expanded.join(F.broadcast(ready) if small else ready, "hash_prefix", "left")
    fits = F.col("digest") == F.col("rule_digest")
    rank = F.when(fits, F.struct("rule_len", "host_len", F.when(F.col("rule_action") == "block", 1).otherwise(0).alias("b"), F.col("rule"), F.col("rule_action")))
    best = joined.groupBy("row_id", "page_id", "host", "path").agg(F.max(rank).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.rule_action"), F.lit(default)).alias("verdict"))
