"""The contract's queries and the pipeline, on whole small tables."""

import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from inkstream.llm import queries
from tests.llm.test_operators import EDGE, brute_classes, brute_hits, brute_suffix, documents

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, data, con, name):
    got, want = queries.QUERIES[name](spark, data).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda df: sorted(str([None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v for v in r]) for r in df[cols].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_row_a_document(spark, data, name):
    got = queries.QUERIES[name](spark, data)
    source = "pages" if name in ("op1_warc", "op6_url_filter") else "embeddings" if name == "op9_ann" else "documents"
    if source != "embeddings":
        assert got.count() == spark.read.parquet(f"{data}/{source}.parquet").count()


def test_suffix_query(spark, data):
    docs = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.op3_suffix_dedup(spark, data).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute_suffix(docs)


def test_jaccard_query(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op10_jaccard_join(spark, data).collect()), key=str) == brute_classes(docs)


def test_token_query(spark, data):
    """Every whole text, against the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False)) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op2_token_counts(spark, data).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_held_out_split(spark, data):
    for r in queries.op5_lang_id(spark, data).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_pipeline(spark, data):
    """Stage by stage against plain versions of each decision."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    source = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = stage(spark, docs, data)
        after = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame(after, docs.schema)
        stages[name] = (before, after)
    ids = lambda rows: {r["doc_id"] for r in rows}
    before, after = stages["language_id"]
    assert len(before) * 0.95 <= len(after) <= len(before)
    before, after = stages["near_duplicates"]
    assert ids(after) == {c for _, c, _ in brute_classes([(r["doc_id"], r["text"]) for r in before])}
    before, after = stages["repeated_passages"]
    kept = {i: n - gone for i, n, gone, _, _ in brute_suffix([(r["doc_id"], r["text"].encode()) for r in before])}
    for r in after:
        assert 0 <= kept[r["doc_id"]] - len(r["text"].encode()) <= 6 * 40 and r["n_chars"] == len(r["text"])
    before, after = stages["decontamination"]
    assert ids(after) == {r["doc_id"] for r in before if not brute_hits(r["text"], source)[4]}
    before, after = stages["source_mix"]
    assert ids(after) == ids(before)
    taken, target = defaultdict(int), {}
    for r in after:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert corpus_pipeline.run(spark, data).count() == len(after)


def test_stages_on_edges(spark, data):
    """Nulls, empty and long texts, repeated rows, clashing extra columns, empty tables: every stage runs and keeps what it may not judge."""
    edge = documents(spark, EDGE)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, edge, data)
        assert stage(spark, documents(spark, []), data).count() == 0, name
        kept = [(r.doc_id, getattr(r, "text", None)) for r in got.collect()]
        if name != "source_mix":
            assert got.columns == corpus_pipeline.COLUMNS
        if name == "near_duplicates":
            assert {i for i, _ in kept} == {1, 3, 4, 5, 6, 7, 8, 10, None} and len(kept) == 10
        if name == "repeated_passages":
            assert {i for i, _ in kept} == {1, 5, 6, 7, 8, 10, None, 3, 4}
        if name in ("decontamination", "source_mix"):
            assert len(kept) == len(EDGE)
        if name == "language_id":
            assert not {3, 4, 7, 8} & {i for i, _ in kept} and {1, 2, 9} <= {i for i, _ in kept}
