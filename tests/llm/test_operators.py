"""Training-data operators against brute force, round trips and edge cases."""

import hashlib
import os
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from inkstream.llm import ann, decontaminate, graph, jaccard_join, lang_id, mixing, suffix_dedup, token_counts, toxicity, url_filter, warc
from inkstream.llm.common import scratch_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PASSAGE = "the quiet harbour kept its lamps burning through the long grey night while boats came home "
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score string, n_tokens string, target string, size string, class_id string, kept string, row_id string, key string"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source) with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, la, s, None, "x", "x", "x", "x", "x", "x", "x", "x") for i, t, la, s in rows], CLASHING)


EDGE = [
    (1, PASSAGE * 3, "en", "a"), (2, PASSAGE * 3, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, LONG, "en", "b"), (6, "É" + PASSAGE + "ünï 中文", "fr", None),
    (7, " \n\t ", "en", "a"), (7, " \n\t ", "en", "a"), (None, "no id here", "en", "a"), (8, "123 !!! ###", None, "c"), (9, PASSAGE * 3, "en", "a"), (9, PASSAGE * 3, "en", "a"), (10, "x", "en", "c"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return documents(spark, EDGE)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


# --- 1: WARC -----------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/", "<p>same</p>", "x"), (2, None, "<p>same</p>", "x"), (3, "http://c/\r\nX: y", None, "x"), (4, "u", "", "x"), (4, "u", "", "x"), (None, "u", "<p>same</p>", "x"), (5, "u", "é" * 200_000, "x"), (-6, "u", "<p>same</p>", "x")],
        "page_id long, url string, html string, digest string",
    )
    out = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/warc", archive_bytes=2000)).collect()
    assert len(out) == 8
    by = defaultdict(list)
    for r in out:
        by[r.page_id].append(r)
    assert by[-6][0].record_type == "response" and bytes(by[-6][0].payload) == b"<p>same</p>"
    assert [(r.record_type, r.refers_to) for r in (by[1][0], by[2][0])] == [("revisit", -6)] * 2
    assert by[None][0].record_type == "response"
    assert [(r.record_type, r.refers_to, r.payload_bytes) for r in by[4]] == [("revisit", 3, 0)] * 2
    assert by[5][0].payload_bytes == 400_000 and by[5][0].payload_digest == warc.base32_sha1("é".encode() * 200_000)
    assert by[3][0].url == "http://c/%0D%0AX: y" and by[2][0].url is None


def test_warc_minimum_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    out = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/a", min_revisit_bytes=3)).collect()
    assert {r.record_type for r in out} == {"response"}
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/b")).count() == 0


def test_a_second_attempt_touches_no_archive(spark, tmp_path):
    """Writing into the same folder again, as a lost task's next attempt does, leaves all archives as they are; each manifest reads its own."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    first = warc.write_archives(pages, folder, archive_bytes=4000)
    before = {f.name: f.read_bytes() for f in (tmp_path / "w").iterdir()}
    second = warc.write_archives(pages.where("page_id < 9"), folder, archive_bytes=4000)
    assert all((tmp_path / "w" / n).read_bytes() == b for n, b in before.items()) and len(list((tmp_path / "w").iterdir())) > len(before)
    assert warc.read_archives(first).count() == 40 and sorted(r.page_id for r in warc.read_archives(second).collect()) == list(range(9))


def test_warc_archive_layout():
    import io
    import struct

    records = [warc.record(i, f"http://h/{i}", b"<html>common words in all pages</html>" * 20, "D", None, "2024-01-01T00:00:00Z") for i in range(200)]
    data = warc.pack(records)
    assert struct.unpack("<I", data[:4])[0] == warc.SKIPPABLE
    assert list(warc.unpack(io.BytesIO(data))) == records
    assert len(data) < sum(map(len, records)) / 4
    with pytest.raises(ValueError):
        list(warc.unpack(io.BytesIO(data[:-5])))


# --- 2: token counts ---------------------------------------------------------------------------

tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_tokens_equal_the_library(spark, edge, library):
    got = {r.doc_id: r for r in token_counts.count_tokens(edge, VOCABULARY).collect()}
    for i, text, _, _ in EDGE:
        assert got[i].n_tokens == len(library.encode(text or "", add_special_tokens=False)), i
        assert got[i].n_bytes == len((text or "").encode())


@pytest.mark.parametrize("text", ["", " a\n", "Don't they're 'll 'S", "<|endoftext|> a <|startoftext|><|x", "ΑΣΣ İıǅ ﬁ ŉ", "e\u0301\u0300 中文한각", "a\x1cb\x85c\xa0d", "12½²x9", "😀‍é" * 5, "thaninble " * 3, "x'x's'rest''s!'ll'LL" * 3, "cafe\u0301s e\u0323\u0301t\u00e9 'e\u0301 s\u0301'", "\u1112\u1161\u11ab\u1100\u1173\u11af abc\u1161", "か\u3099き\u3099x\u3099'\u0301s", "हिन्दी में ক\u09be\u09c7\u09be", "a<|endoftext|><|endoftext|", "١٢٣a½Ⅷ", "\u0301\u0301a", "ﬃ\u0345Å\u0301\u212b"])
def test_prefixes_equal_the_library(text, library):
    c = token_counts.counter(VOCABULARY)
    want = [len(library.encode(text[:i], add_special_tokens=False)) for i in range(len(text) + 1)]
    assert c.prefix_counts(text).tolist() == want and c.count(text) == want[-1]
    n = token_counts.longest_prefix(c.prefix_counts(text), 3)
    assert want[n] <= 3 and all(w > 3 for w in want[n + 1 :])


@pytest.mark.parametrize("seed", range(6))
def test_prefixes_of_random_strings(library, seed):
    rng = np.random.default_rng(seed)
    letters = list("abS'!9 ") + ["\u0301", "\u0323", "é", "中", "か", "\u3099", "\u1100", "\u1161", "\u11a8", "İ", "<|endoftext|>", "\u09c7", "\u09be", "Σ", "\u2003", "😀", "'ll", "\u0345"]
    c = token_counts.counter(VOCABULARY)
    for _ in range(25):
        text = "".join(rng.choice(letters, rng.integers(1, 24)))
        assert c.prefix_counts(text).tolist() == [len(library.encode(text[:i], add_special_tokens=False)) for i in range(len(text) + 1)], ascii(text)


@pytest.mark.parametrize("unit", ["漢字仮名交文章翻訳機械学習東京大阪", "x'x'", "がぎぐげご".replace("が", "か\u3099"), "word", "абвгдежз"])
def test_long_runs_are_counted_once(library, unit):
    """Runs of 20,000 characters without a blank take one walk."""
    import time

    rng = np.random.default_rng(3)
    text = "".join(rng.permutation(list(unit))) + (unit * 20_000)[: 20_000 - len(unit)]
    c = token_counts.counter(VOCABULARY)
    began = time.process_time()
    got = c.prefix_counts(text)
    assert time.process_time() - began < 4
    for i in [0, 1, 2, 3, 17, 999, 5_003, 12_345, 19_999, len(text)]:
        assert got[i] == len(library.encode(text[:i], add_special_tokens=False)), i


def test_stored_prefixes_answer_budgets(spark, library):
    texts = ["The harbour's lamps", "", None, "中文 か\u3099 text"]
    stored = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), VOCABULARY, store_prefixes=True)
    tokens = lambda t: len(library.encode(t, add_special_tokens=False))
    by = {r.doc_id: r for r in token_counts.truncated(token_counts.tokens_within(stored, 7), 2).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        assert by[k].prefix_tokens == [tokens(t[:i]) for i in range(len(t) + 1)] and by[k].n_tokens == tokens(t)
        assert by[k].tokens == tokens(t[:7]) and by[k].chars_kept == max(i for i in range(len(t) + 1) if tokens(t[:i]) <= 2)


def test_other_vocabularies_are_refused():
    for name in ("byte_bpe_50k.json",):
        with pytest.raises(ValueError):
            token_counts.PrefixCounter(tokenizers.path(name))


def test_token_edges(spark, empty):
    assert token_counts.count_tokens(empty, VOCABULARY).count() == 0 and token_counts.count_tokens(empty, VOCABULARY, store_prefixes=True).count() == 0


# --- 3: suffix dedup ---------------------------------------------------------------------------


def brute_suffix(docs, length=50):
    least = {}
    rank = lambda i: (i is None, i or 0)
    for i, t in docs:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            least[s] = min(least.get(s, (True, 1 << 62)), rank(i))
    out = []
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < rank(i):
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup_edges(spark, edge, empty):
    small = [(i, (t or "")[:2000].encode()) for i, t, _, _ in EDGE]
    df = documents(spark, [(i, (t or "")[:2000] if t is not None else None, la, s) for i, t, la, s in EDGE])
    assert rows(suffix_dedup.remove_repeats(df), *COLUMNS) == brute_suffix(small)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suffix_dedup_random(spark, seed):
    """Low-entropy texts with NUL bytes, periods, overlaps and shared passages over many blocks and parts."""
    rng = np.random.default_rng(seed)
    passages = ["".join(rng.choice(list("ab\0é "), rng.integers(40, 140))) for _ in range(8)]
    docs = []
    for i in rng.permutation(60).tolist():
        parts = [passages[rng.integers(8)][rng.integers(0, 30) :] if rng.random() < 0.6 else "".join(rng.choice(list("abcdefgh"), rng.integers(0, 60))) for _ in range(rng.integers(1, 6))]
        docs.append((i, "".join(parts) + ("xyzw" * 40 if i % 9 == 0 else "") + ("a" * 120 if i % 7 == 0 else "")))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df, block_bytes=1500, bucket_anchors=300, part_suffixes=200)
    assert rows(got, *COLUMNS) == brute_suffix([(i, t.encode()) for i, t in docs])


def test_equal_hashes_are_no_equal_strings(monkeypatch):
    """Left contexts whose hashes all collide: only bytes decide."""
    rng = np.random.default_rng(9)
    middle = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQR"
    docs = [(i, "".join(rng.choice(list("xyz"), 30)) + middle + "".join(rng.choice(list("uvw"), 30))) for i in range(30)]
    raw = [(i, t.encode()) for i, t in docs]
    block = suffix_dedup.Block({"ids": suffix_dedup._zip(np.array([i for i, _ in raw])), "nulls": bytes(len(raw)), "sizes": suffix_dedup._zip(np.array([len(t) for _, t in raw])), "data": suffix_dedup._zip(b"".join(t for _, t in raw))}, 50)
    c = block.contexts(np.arange(len(block.at)))
    run = suffix_dedup.decode_run(suffix_dedup.encode_run(c.right, c.left, c.sizes, c.rank), 50)
    want = suffix_dedup.resolve([run], 50)[0]
    monkeypatch.setattr(suffix_dedup, "_mix", lambda x: x * np.uint64(0))
    assert want.any() and (suffix_dedup.resolve([run], 50)[0] == want).all()


def test_loser_tree_merges_like_a_sort():
    rng = np.random.default_rng(3)
    for k in (1, 2, 5, 9):
        runs = []
        for _ in range(k):
            m = rng.integers(0, 3, (rng.integers(0, 30), 50), dtype=np.uint8)
            m[:, :20] = 1
            m = m[np.lexsort(m.T[::-1])]
            n = len(m)
            runs.append((suffix_dedup.prefix_lengths(m), np.full((n, 2), 50, np.uint8), np.arange(n), np.zeros((n, 26), np.uint8), m))
        data = [r[4] for r in runs]
        bounds = np.cumsum([0, *map(len, data)])
        rows_ = np.concatenate(data)
        words = [suffix_dedup._big_endian(rows_, c).tolist() for c in range(7)]
        shared = np.concatenate([r[0] for r in runs]).tolist()
        got = list(suffix_dedup.LoserTree(words, shared, list(zip(bounds[:-1], bounds[1:], strict=True)), 50).merge())
        merged = rows_[[i for i, _ in got]] if got else rows_
        assert [bytes(r) for r in merged] == sorted(bytes(r) for r in rows_)
        assert [p for _, p in got][1:] == suffix_dedup.prefix_lengths(merged).tolist()[1:]


def test_front_coding_round_trip():
    rng = np.random.default_rng(1)
    right = rng.integers(0, 2, (40, 50), dtype=np.uint8)
    right = right[np.lexsort(right.T[::-1])]
    sizes = np.stack([np.full(40, 50), rng.integers(0, 27, 40)], 1).astype(np.uint8)
    left = (rng.integers(1, 9, (40, 26)) * (np.arange(26) >= 26 - sizes[:, 1:])).astype(np.uint8)
    shared, got_sizes, rank, got_left, got_right = suffix_dedup.decode_run(suffix_dedup.encode_run(right, left, sizes, np.arange(40)), 50)
    assert (got_right == right).all() and (got_left == left).all() and (got_sizes == sizes).all() and rank.tolist() == list(range(40))


# --- 4: mixing ---------------------------------------------------------------------------------


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(["w"] * int(rng.integers(1, 80))), None, str(rng.choice(["a", "b", "c", "d", "e"], p=[0.4, 0.05, 0.25, 0.2, 0.1]))) for i in range(800)]
    df = documents(spark, docs)
    got = mixing.mix(df).toPandas()
    again = mixing.mix(df.repartition(5)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert (got.taken <= 3 * got["size"]).all() and abs(got.taken.sum() - got["size"].sum()) <= 5
    sizes = got.groupby("source")["size"].sum().sort_index()
    want, weights, free = {}, dict(zip(sizes.index, (5, 2, 1, 5, 2), strict=True)), set(sizes.index)
    while True:
        left = sizes.sum() - sum(want.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 3 * sizes[s] for s in over}
        free -= over
    for s, g in got.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(want[s]) and abs(g.taken.sum() - want[s]) <= 1


def test_mix_nested_and_edges(spark, edge, empty):
    small, large = (mixing.mix(edge, share=s).toPandas().sort_values(["doc_id", "size"]) for s in (0.3, 0.8))
    assert (small.taken.values <= large.taken.values).all()
    assert len(small) == len(EDGE) and small[small.source.isna()]["size"].sum() > 0
    assert mixing.mix(empty).count() == 0


# --- 5: language -------------------------------------------------------------------------------


def test_language_held_out(spark, data):
    from inkstream.llm.queries import op5_lang_id

    got = op5_lang_id(spark, data).where("held_out").join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9 and got.score.between(0, 1).all()


def plain_language(text, dicts, block=4096, least=1.0):
    """Classification read off the definition: every block of letters with every language's dictionary, a fresh encoder each."""
    import math

    import zstandard as zstd

    kept = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    raw = " ".join(re.sub(r"[\W\d_]+", " ", kept).split(" ")).strip().encode()
    if not any(c.isalpha() for c in text or "") or not raw:
        return "und", 0.0, False
    cuts = [raw[i : i + block] for i in range(0, len(raw), block)]
    params = zstd.ZstdCompressionParameters(window_log=19, chain_log=17, hash_log=17, search_log=3, min_match=4, strategy=zstd.STRATEGY_GREEDY, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False)
    total = {}
    for lang, d in dicts:
        held = zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=params)
        total[lang] = sum(len(zstd.ZstdCompressor(compression_params=params, dict_data=held).compress(c)) for c in cuts)
    order = [lang for _, lang in sorted((n, k) for k, n in enumerate(total.values()))]
    langs = list(total)
    best, blocks = langs[order[0]], 1 + len(raw) // block
    gaps = [(total[langs[k]] - total[best]) / blocks for k in order]
    return best, 1 / sum(math.exp(max(-60.0, -g / 4)) for g in gaps), gaps[1] >= least


def test_languages_equal_the_plain_reading(spark, data):
    """Every text of the table: language, score and acceptance; the rows that stay; ties go to the language with more rows."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    dicts = lang_id.learn(docs, dict_bytes=16384)
    want = {r.doc_id: plain_language(r.text, dicts) for r in docs.collect()}
    got = {r.doc_id: (r.lang_pred, r.score, r.accepted) for r in lang_id.identify(docs, dicts).collect()}
    for i, (lang, score, accepted) in want.items():
        assert got[i][0] == lang and got[i][2] == accepted and got[i][1] == pytest.approx(score, abs=1e-9), i
    assert {(r.doc_id, r.lang) for r in lang_id.keep_identified(docs, dicts).collect()} == {(i, w[0]) for i, w in want.items() if w[2]}
    same = [("zz", b"abc def " * 99), ("aa", b"abc def " * 99)]
    r = lang_id.identify(docs.limit(5), same).collect()
    assert all(x.lang_pred == "zz" and not x.accepted and x.score == 0.5 for x in r)


def test_language_edges(spark, edge, empty):
    got = {r.doc_id: r for r in lang_id.identify(edge, [("en", PASSAGE.encode() * 20), ("fr", "le chat noir dort sur la table ".encode() * 20)]).collect()}
    assert [got[i].lang_pred for i in (3, 4, 7, 8)] == ["und"] * 4 and got[1].lang_pred == "en" and got[5].lang_pred in ("en", "fr")
    assert lang_id.learn(empty) == [] and lang_id.identify(edge, []).where("lang_pred = 'und'").count() == len(EDGE)
    assert lang_id.identify(empty, []).count() == 0
    kept = lang_id.keep_identified(edge, [("en", PASSAGE.encode() * 20), ("fr", b"chat noir " * 50)])
    assert kept.columns == edge.columns and kept.where("doc_id in (3, 4, 7, 8)").count() == 0


def test_dictionaries_come_from_whole_texts(spark, data):
    """A header before every text must not be all that the dictionaries hold."""
    from inkstream.llm.queries import remainder

    header = " ".join(f"{a}{b}" for a in ("home", "news", "shop", "help", "about") for b in ("page", "link", "list", "item", "menu"))
    docs = spark.read.parquet(f"{data}/documents.parquet").where("text is not null").selectExpr("doc_id", f"concat('{header} ', text) as text", "lang")
    dicts = lang_id.learn(docs.where(remainder(4) != 2), dict_bytes=16384)
    assert all(8192 < len(d) <= 16384 for _, d in dicts)
    got = lang_id.identify(docs.where(remainder(4) == 2), dicts).join(docs, "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9 and got.accepted.mean() > 0.9
    parts = lang_id.pieces("One two, three. " * 50, 7, 100)
    assert sorted(parts) == sorted(lang_id.letters("One two, three. " * 50).decode()[i : i + 100] for i in range(0, 699, 100)) and parts != lang_id.pieces("One two, three. " * 50, 8, 100)


# --- 6: urls -----------------------------------------------------------------------------------

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block")]
URLS = [
    ("http://A.Example.NET/en/1?x#y", "example.net/en/", "allow"), ("http://example.net/de/", "net/", "block"), ("http://example.net", None, "allow"), ("https://x.example.com/de/a/b", "example.com/de/", "block"),
    ("https://xexample.com/de/", None, "allow"), ("http://q.org/fr/#z", "org/fr/", "allow"), ("no scheme", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("a://b://c.net/", None, "allow"), ("x\n://net/a", "net/", "block"), ("://", None, "allow"),
    ("http://" + "s." * 500 + "net/" + "p" * 50_000, "net/", "block"),
]


@pytest.mark.parametrize("bound", [100, 0])
def test_url_rules(spark, bound):
    urls = spark.createDataFrame([(i, u, "x", "x", "x") for i, (u, _, _) in enumerate(URLS)] * 2, "page_id long, url string, host string, rule string, hash_prefix string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = url_filter.filter_urls(urls, rules, max_broadcast_rules=bound).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.rule, r.verdict) == URLS[r.page_id][1:], r.page_id
    assert url_filter.filter_urls(urls.limit(0), rules).count() == 0
    assert url_filter.filter_urls(urls, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == len(got)


# --- 7: toxicity -------------------------------------------------------------------------------


def plain_score(g, text):
    """The grammar read off the definition: for each insult or threat, what stands around it in its clause."""
    t, n, z = toxicity, 0, float(g.weights[0])
    for clause in t.clauses_of(text):
        kinds = [g.symbol(w) for w in clause]
        for i, kind in enumerate(kinds):
            if kind not in (t.INSULT, t.THREAT, t.SLIGHT):
                continue
            aimed = t.TARGET in kinds[max(0, i - t.TARGET_REACH) : i] + kinds[i + 1 : i + 1 + t.TARGET_REACH]
            denied = t.NEGATION in kinds[max(0, i - t.NEGATION_REACH) : i]
            quoted = t.REPORT in kinds[:i]
            code = kind + t.TARGETED * aimed + t.NEGATED * denied + t.REPORTED_MARK * quoted
            z += t.DECAY[min(n, 3)] * g.weights[1 + t.MATCHED.index(code)]
            n += 1
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def test_grammar_patterns():
    g = toxicity.Grammar(words=toxicity.seeds())
    t = toxicity
    assert g.patterns("An idiot.") == [t.INSULT] and g.patterns("You idiot!") == [t.INSULT | t.TARGETED] == g.patterns("what an idiot you are")
    assert g.patterns("Never an idiot.") == [t.INSULT | t.NEGATED] and g.patterns("Critics said idiot.") == [t.INSULT | t.REPORTED_MARK] and g.patterns("They will kill again") == [t.THREAT | t.TARGETED]
    assert g.patterns("Not here. An idiot") == [t.INSULT]  # a negation ends with its clause
    assert g.patterns("you walk along a very long and winding road, idiot") == [t.INSULT]  # a target out of reach
    assert g.patterns("he said you are not an idiot") == [t.INSULT | t.TARGETED | t.NEGATED | t.REPORTED_MARK]
    assert g.score_text("never an idiot") < g.score_text("an idiot") < g.score_text("you idiot")
    assert g.score([]) < 0.5 < g.score_text("you idiot")
    for quoted in ("you are an 'idiot'", "'idiot,' you", "you 'moron'"):
        assert g.score_text(quoted) == g.score_text("you are an idiot")


def test_composition_is_the_chain_of_its_parts():
    """The product machine writes, weighs and moves as its parts do one after the other."""
    rng = np.random.default_rng(2)
    t = toxicity
    parts = [t.within(t.TARGET, 5, t.TARGETED), t.within(t.NEGATION, 3, t.NEGATED), t.once(t.REPORT, t.REPORTED_MARK), t.scoring(rng.random(len(t.MATCHED)))]
    whole = parts[0].then(parts[1]).then(parts[2]).then(parts[3])
    at, state = [0] * len(parts), 0
    for x in rng.integers(0, 8, 3000):
        y, w = int(x), 0.0
        for k, m in enumerate(parts):
            y, w, at[k] = int(m.out[at[k], y]), w + m.weight[at[k], y], int(m.next[at[k], y])
        assert whole.out[state, x] == y and whole.weight[state, x] == pytest.approx(w)
        state = int(whole.next[state, x])


def test_scores_equal_the_plain_reading(spark, data):
    """Every text of the table, under a grammar learned from it, and made-up clauses."""
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    g = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, g).collect()}
    want = {r.doc_id: plain_score(g, r.text or "") for r in docs.collect()}
    assert got == pytest.approx(want, abs=1e-12) and len(set(got.values())) > 1
    rng, vocabulary = np.random.default_rng(1), [*toxicity.seeds(), "word", "other", ".", ";", "road"]
    seeds = toxicity.Grammar(words=toxicity.seeds())
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary, rng.integers(0, 30)))
        assert seeds.score_text(text) == pytest.approx(plain_score(seeds, text), abs=1e-12)


def test_toxicity_held_out(spark, data):
    from inkstream.llm.queries import op7_toxicity

    folder = os.path.join(os.path.dirname(data), "sf0.01")  # the smallest has too few toxic rows
    got = op7_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.93 and got.score.between(0, 1).all()


def test_copies_do_not_make_insults(spark):
    """A toxic text copied often must not lend its label to its other words; insults in many texts must be learned."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("bcdfglmnprst"), 2)) + "".join(rng.choice(list("aeiou"), 2)) + "".join(rng.choice(list("bcdfglmnprst"), 2))
    text = lambda bad: " ".join(word() if rng.random() > 0.08 or not bad else str(rng.choice(["grelk", "snovit"])) for _ in range(60)) + "."
    copied = text(True) + " harbour"
    docs = [(i, text(i % 4 == 0)) for i in range(400)] + [(1000 + i, copied) for i in range(150)] + [(2000 + i, text(False) + " harbour") for i in range(3)]
    labels = [(i, int(i % 4 == 0 if i < 1000 else i < 2000)) for i, _ in docs]
    g = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert g.words.get("grelk") == g.words.get("snovit") == toxicity.INSULT and "harbour" not in g.words
    assert g.score_text(text(False) + " harbour") < 0.5 < g.score_text("you grelk")


def test_prefilter_changes_no_score(spark):
    """Quoted insults, apostrophes, clause ends and stems: scored as the grammar scores them."""
    g = toxicity.Grammar(words={**toxicity.seeds(), "bête": toxicity.INSULT}, stems=frozenset({"grel"}))
    texts = ["'idiot'", "He called them 'you moron'.", "'kill", "idiots' idiot'", "'''loser'''!", "l' 'grelk'", "'bête'", "an idiot.moron", "fine' words'", "o'idiot", "'", "", None, "Not 'an idiot'; you 'scum'", "ΟΣ.Α 'stupid'"]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), g).collect()}
    assert got == pytest.approx({i: g.score_text(t or "") for i, t in enumerate(texts)}) and got[0] > g.score([])


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    g = toxicity.learn(edge, labels)
    got = toxicity.score(edge, g)
    assert got.count() == len(EDGE) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, toxicity.learn(empty, labels)).count() == 0


# --- 8: decontamination ------------------------------------------------------------------------


def brute_hits(text, items, window=10):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORD.findall(low(text))
    hit, found = set(), set()
    for i, item in items:
        v = WORD.findall(low(item))
        for win in {tuple(v[k : k + window]) for k in range(max(1, len(v) - window + 1))} if v else ():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found.add(i)
    return len(w), len(hit), len(found), decontaminate.sha256_of(list(found)), bool(hit)


ITEMS = [(1, PASSAGE), (2, "Grey; NIGHT, while"), (3, None), (4, "..."), (5, PASSAGE), (11, "中文"), (12, "no id")]


@pytest.mark.parametrize("bound", [10**6, 60])
@pytest.mark.parametrize("shuffled", [False, True])
def test_decontamination(spark, edge, bound, shuffled):
    """One block of patterns or many, over rows that lie still or come out of a shuffle; an id with two texts."""
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, pattern string")
    docs = [*EDGE, (6, "nothing of the kind", "en", "a")]
    df = documents(spark, docs)
    df = df.repartition(7) if shuffled else df
    found = decontaminate.find_contamination(df, items, max_pattern_bytes=bound)
    assert (decontaminate.pattern_blocks(items, 10, bound)[0] > 3) == (bound == 60)
    got = rows(decontaminate.digest(found), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(((i, *brute_hits(t, ITEMS)) for i, t, _, _ in docs), key=str)
    first = found.where("doc_id = 6 and size(hit_spans) > 0").first()
    text = EDGE[5][1].encode()
    spans = list(zip(first.byte_spans[0::2], first.byte_spans[1::2], strict=True))
    # a word that the text runs into "É" is no word of the item, so the passage is hit from its second word on
    assert [text[a:z].decode() for a, z in spans] == [PASSAGE.strip().split(" ", 1)[1], "中文"]
    clean = decontaminate.keep_clean(df, items, max_pattern_bytes=bound)
    assert clean.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in clean.where("doc_id is not null").collect() if r.text) == sorted((i, t) for i, t, _, _ in docs if t and i is not None and not brute_hits(t, ITEMS)[4])
    assert clean.count() == sum(not g[5] for g in got)


def test_decontamination_empty(spark, edge, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.find_contamination(edge, none)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(empty, none).count() == 0


# --- 9: nearest neighbours ---------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[200:500] = x[0]  # a very common vector
    data = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(5000, None, "x"), (5001, [0.0] * 16, "x"), (5002, [float("nan")] + [1.0] * 15, "x"), (5003, [1.0, None] + [1.0] * 14, "x"), (None, [1.0] * 16, "x"), (5004, [1.0, 2.0], "x"), (7, x[7].tolist(), "x"), (5100, [], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score string")
    got = ann.search(df, df.where("vec_id % 100 = 0"), search_mass=1.2, fit_rows=300, bundle_rows=100, shard_rows=60).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        g = g.sort_values("rank")
        hit += len(set(best) & set(g.vec_id))
        assert g["rank"].tolist() == list(range(1, 11)) and g.score.tolist() == pytest.approx(d[g.vec_id].tolist(), abs=1e-12)
        if q in (0, 200, 300, 400):
            assert g.vec_id.tolist() == best.tolist()
    assert set(got.query_id) == set(range(0, 1200, 100)) and hit / (12 * 10) >= 0.9


def _recall(got, x, queries):
    hit = 0
    for q in queries:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argpartition(d, 10)[:10]) & set(got[got.query_id == q].vec_id))
    return hit / 10 / len(queries)


@pytest.mark.parametrize("n", [500, 20_000])
def test_recall_of_the_registered_query(spark, tmp_path, n):
    """At its own parameters, on vectors without structure, fewer and as many as the sample holds; part of the vectors is seen only."""
    from inkstream.llm.queries import op9_ann

    x = np.random.default_rng(6).normal(size=(n, 64))
    x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = op9_ann(spark, f"file://{tmp_path}").toPandas()
    assert sorted(set(got.query_id)) == list(range(0, n, 100)) and len(got) == n // 10
    x = x.astype(float)
    assert 0.9 <= _recall(got, x, range(0, n, 100)) < 1.0
    scores = np.sqrt(((x[got.query_id] - x[got.vec_id]) ** 2).sum(1))
    assert got.score.tolist() == pytest.approx(scores.tolist(), abs=1e-12)
    router = ann.Router(x[:20_000], n, 4, 12, 8, 2048, 16_384, 64)
    leaves = [t.leaves_of(x) for t in router.trees]
    seen = np.mean([np.any([np.isin(at, own) for at, own in zip(leaves, router.visits(x[q], 1.1), strict=True)], axis=0).mean() for q in range(0, n, 500)])
    assert seen < 0.8


def test_clusters_need_few_leaves(spark):
    """With structure, a twentieth of the vectors is enough; a sample smaller than the table, a very common vector dealt to several shards."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(80, 32))
    x = centres[rng.integers(0, 80, 6000)] + 0.3 * rng.normal(size=(6000, 32))
    x[1000:3000] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 100 = 7"), search_mass=0.2, fit_rows=1500, bundle_rows=300, shard_rows=250).toPandas()
    assert _recall(got, x, [q for q in range(7, 6000, 100) if not 1000 <= q < 3000]) >= 0.9
    assert sorted(got[got.query_id == 1007].vec_id) == [0, *range(1000, 1007), 1008, 1009] and (got[got.query_id == 1007].score == 0).all()
    routers = ann.fit(ann.usable(df, "vec_id", "embedding"), 1500, {"trees": 2, "leaf_rows": 32, "least_leaf": 16, "bundle_rows": 300, "shard_rows": 250})
    assert max(int(s.max()) for s in routers[32].salts) >= 6


def test_neighbours_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (100, [1.0])], "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 100 = 0"))
    assert rows(got, "query_id", "rank", "vec_id") == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


# --- 10: Jaccard join --------------------------------------------------------------------------


def brute_classes(docs, threshold=0.8):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for i, t in docs:
        w = WORD.findall(low(t))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    n, up = [0] * len(docs), list(range(len(docs)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and i is not None and j is not None and len(s & t) >= threshold * len(s | t) - 1e-12:
                n[a] += 1
                n[b] += 1
                up[root(a)] = root(b)
    label = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        label[root(k)].append(i)
    return sorted(((i, min(x for x in label[root(k)]) if i is not None else None, n[k]) for k, (i, _) in enumerate(sets)), key=str)


def test_jaccard_edges(spark, edge, empty):
    assert rows(jaccard_join.near_duplicates(edge), "doc_id", "class_id", "n_links") == brute_classes([(i, t) for i, t, _, _ in EDGE])
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_blocks(spark):
    """One large group of near copies, compared in many blocks, beside exact copies and strangers."""
    rng = np.random.default_rng(2)
    base = [f"v{k}" for k in rng.integers(0, 5000, 160)]
    docs = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(160)] = f"e{rng.integers(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, " ".join(f"s{k}" for k in rng.integers(0, 10**6, 50))) for i in range(20)] + [(300 + i, docs[5][1].upper()) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = jaccard_join.near_duplicates(df, block_nodes=25, block_shingles=4000)
    assert rows(got, "doc_id", "class_id", "n_links") == brute_classes(docs)


def test_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in rng.integers(1, 50, 40)]
    want = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets])
    got = jaccard_join.intersections(sets, None)
    np.fill_diagonal(got, 0)
    np.fill_diagonal(want, 0)
    assert (got == want).all()
    assert (jaccard_join.intersections(sets[:15], sets[15:]) == np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets[15:]] for a in sets[:15]])).all()


def test_prefixes_shorten_until_the_recall():
    """All alone: evenly. Hot groups stay deep while others can make up for them; if nothing else helps, they are opened."""
    f, misses = Fraction(4, 5), jaccard_join.log_misses(6, Fraction(4, 5))
    chance = lambda at: sum(misses[d] for d in at)
    shortest = jaccard_join.shortest_prefix(24, 6, f, 0.9999)
    assert shortest == 4
    plain = jaccard_join.chosen_depths({}, 24, shortest, 6, misses, 0.9999, 64)
    assert set(plain) == {5, 6} and chance(plain) <= np.log(1e-4)
    some = jaccard_join.chosen_depths({t: [5000, 900, 70] for t in range(8)}, 24, shortest, 6, misses, 0.9999, 64)
    assert set(some[:8]) == {6} and min(some[8:]) == 4 and chance(some) <= np.log(1e-4)
    every = jaccard_join.chosen_depths({t: [10**6, 10**5, 10**4] for t in range(24)}, 24, shortest, 6, misses, 0.9999, 64)
    assert chance(every) <= np.log(1e-4) and min(every) >= 4


def boilerplate(rng, groups=60, shared=30, own=45):
    """Each page shares a template with the page before and another with the page after: a chain of candidates, no links."""
    block = lambda n: [f"q{k}" for k in rng.integers(0, 10**9, n)]
    templates = [block(shared) for _ in range(groups + 1)]
    docs, i = [], 0
    for g in range(groups):
        for _ in range(4):
            docs.append((i, " ".join(templates[g] + block(own) + templates[g + 1])))
            i += 1
    return docs


def test_chains_cost_their_candidates(spark):
    """A connected chain of boilerplate is compared bucket by bucket: near the number of candidates, far from all pairs."""
    rng = np.random.default_rng(7)
    docs = boilerplate(rng)
    docs += [(1000, docs[17][1] + " more"), (1001, docs[17][1] + " less"), (1002, docs[200][1].upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    signed = jaccard_join.signatures(df, "doc_id", "text", 5, 24, 6).withColumnRenamed("doc_id", "node")
    held = jaccard_join.buckets(signed, 24, 6, Fraction(1, 20), 0.9999, 64)  # a threshold at which the templates make candidates
    members = defaultdict(set)
    for r in held.collect():
        members[r.bucket].add(r.node)
    candidates = {(a, b) for m in members.values() for a in m for b in m if a < b}
    routed = jaccard_join.routes(signed.select("node", "n_shingles"), held, 20, 10**9).collect()
    by = defaultdict(list)
    for r in routed:
        by[r.grp].append(r)
    compared = sum(len(g) * (len(g) - 1) // 2 for g in by.values())
    largest = max(len(c) for c in _connected(candidates))
    assert largest > 100 and any(r.earlier is not None for r in routed)
    assert len(candidates) <= compared * 1.01 and compared < len(candidates) * 12 and compared < largest * (largest - 1) / 2 / 2
    # every candidate at the threshold is counted once, though pairs meet in several buckets
    text = dict(docs)
    near = lambda a, b: brute_classes([(a, text[a]), (b, text[b])], 0.05)[0][2]
    links = defaultdict(int)
    for a, b in candidates:
        links[a] += near(a, b)
        links[b] += near(a, b)
    got = jaccard_join.near_duplicates(df, threshold=Fraction(1, 20), block_nodes=20)
    assert {r.doc_id: r.n_links for r in got.collect()} == {i: links[i] for i, _ in docs}
    assert rows(jaccard_join.near_duplicates(df, block_nodes=20), "doc_id", "class_id", "n_links") == brute_classes(docs)


def _connected(pairs):
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    out = defaultdict(set)
    for x in up:
        out[root(x)].add(x)
    return list(out.values())


def test_pairs_of_several_buckets_count_once():
    left, right = [[1, 5, 9], [5], [2, 9]], [[5, 9], [9], [1, 2]]
    want = [[bool({x for x in a if x < 9} & set(b)) for b in right] for a in left]
    assert jaccard_join.met_before(left, right, 9).tolist() == want


def test_ids_with_several_texts(spark):
    """Classes belong to rows: of a repeated smallest id one row stays, and an id's other text keeps its own class."""
    docs = [(1, PASSAGE * 2), (1, PASSAGE * 2), (1, "quite another text that nothing else is like at all"), (2, PASSAGE * 2 + "x"), (3, "a third"), (3, PASSAGE * 2), (None, PASSAGE * 2)]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, _x string")
    assert rows(jaccard_join.near_duplicates(df), "doc_id", "class_id", "n_links") == brute_classes(docs)
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.select("doc_id", "text").collect()), key=str) == sorted([(1, PASSAGE * 2), (1, docs[2][1]), (3, "a third"), (None, PASSAGE * 2)], key=str)


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 90), (5, 5), (None, 3), (200, 201)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[k] for k in range(31)} == {0} and got[100] == 90 and got[201] == 200 and len(got) == 35
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- scratch tables ----------------------------------------------------------------------------


def test_scratch_follows_the_session(spark):
    from inkstream.llm import common

    before = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    df = common.materialize(spark.range(3), "n")
    assert df.count() == 3 and (before is None or before in df.inputFiles()[0])
    common.drop_scratch(spark, df)
