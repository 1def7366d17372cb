"""The contract's queries: each applies its operator to the whole table and derives digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm.common import scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]


def remainder(modulus: int) -> F.Column:
    """crc32 of doc_id as text, modulo."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstream.llm import warc

    manifest = warc.write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    import public_tokenizers

    from inkstream.llm import token_counts

    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstream.llm import suffix_dedup

    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstream.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstream.llm import lang_id

    docs = table(spark, sf_dir, "documents")
    dicts = lang_id.learn(docs.where(remainder(4) != 2))
    return lang_id.identify(docs, dicts).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstream.llm import url_filter

    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstream.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grammar = toxicity.learn(docs.where(remainder(5) != 0), labels.where(remainder(5) != 0))
    scored = toxicity.score(docs, grammar)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstream.llm import decontaminate

    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstream.llm import ann

    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstream.llm import jaccard_join

    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mixing": op4_mixing,
    "op5_lang_id": op5_lang_id,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_ann": op9_ann,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLES: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, hex,
             list_reduce(list_prepend('', list_transform(range(0, 8), lambda g:
                 list_reduce(list_prepend('', list_transform(range(0, 4), lambda k:
                     substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, g * 5 + 1, 5))::BIGINT >> (15 - 5 * k)) & 31)::INT + 1, 1))), lambda x, y: x || y))), lambda x, y: x || y) AS payload_digest,
             min(page_id) OVER (PARTITION BY hex) AS first_id
      FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM b""",
    "op3_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, b, substr(x, 2 * b + 1, 1098) AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 + 1, 500)) AS b FROM d)),
v AS (SELECT doc_id, b + q AS p, substr(y, 2 * q + 1, 100) AS s FROM (SELECT doc_id, b, y, unnest(range(0, least(500, length(y) // 2 - 49))) AS q FROM c)),
e AS (SELECT doc_id, p, hash(s) AS k FROM v),
f AS (SELECT k FROM e GROUP BY k HAVING min(doc_id) < max(doc_id)),
w AS (SELECT doc_id, p, s FROM v WHERE hash(s) IN (SELECT k FROM f)),
m AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT w.doc_id, w.p FROM w JOIN m USING (s) WHERE w.doc_id > m.first_id),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS opens FROM h),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g) GROUP BY doc_id, k),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
t AS (SELECT k.doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op4_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || left(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[r % 3 + 1]::DOUBLE AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, cap / w AS ratio, (sum(source_size) OVER ())::DOUBLE AS total, coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below, sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT (total - below) / rest AS level FROM o WHERE (total - below) / rest <= ratio ORDER BY ratio, r LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * w) AS target FROM w, l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS copies FROM t),
b AS (SELECT *, (round(target) - copies * source_size)::BIGINT AS budget FROM c),
q AS (SELECT d.doc_id, d.size, d.h, b.*, (sum(size) OVER (PARTITION BY d.source, h))::BIGINT AS held, (sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, copies * size + CASE WHEN upto <= budget THEN size WHEN upto - held < budget THEN size * (budget - upto + held) // held ELSE 0 END AS taken FROM q""",
    "op10_jaccard_join": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
r AS (SELECT a AS doc_id, b AS near FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.near)
SELECT t.doc_id, least(t.doc_id, coalesce((SELECT min(near) FROM r WHERE r.doc_id = t.doc_id), t.doc_id)) AS class_id, (SELECT count(*) FROM l WHERE l.a = t.doc_id) AS n_links FROM t""",
    "op6_url_filter": """
WITH u AS (SELECT page_id, url, strpos(url, '://') AS p FROM pages),
r AS (SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, rhost || rpath AS rule, action,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, action DESC) AS n
      FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.n = 1""",
    "op8_decontaminate": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(CASE WHEN len(w) < 10 THEN w ELSE w[1:10] END) AS n, array_to_string(w[i:i + 9], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM iw WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
found AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, array_to_string(w[i:i + k.n - 1], ' ') AS g, k.n FROM pos, (SELECT DISTINCT n FROM win) k WHERE i + k.n - 1 <= len(w)) JOIN win USING (g, n)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
