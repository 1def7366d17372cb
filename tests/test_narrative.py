"""From manuscripts to timelines: expectations worked out by hand."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstream import fixed
from inkstream.functions import dsp, html
from inkstream.operators import attribution, casting, chapters, chunks, engines, jobs, prosody, sinks, synthesis, timeline
from inkstream.operators.cast_spec import Member, from_spec, parse_spec, read_cast
from inkstream.plans.pipeline import Config, Pipeline, preview
from inkstream.sources import manuscripts

STORY = """# The Bar

Linda looked at him through the haze.

"You owe me," she said.

"Later," Marcus muttered.

"Now."

"Never."

* * *

"Closing," the clerk rasped.

# Outside

"He knows," she whispered. Rain fell.
"""


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, raw_text string")


def chaptered(spark, text):
    return [(r.title, r.content, r.word_count) for r in chapters.split_chapters(docs(spark, text)).orderBy("chapter_index").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("one two\n\nthree", [("", "one two\n\nthree", 3)]),
        (None, [("", "", 0)]),
        (" \n\n ", [("", "", 0)]),
        ("lead\n\n# A\n\nx y\n\n## B\nmore\n\nz", [("Prologue", "lead", 1), ("A", "x y", 2), ("B more", "z", 1)]),
        ("# A\n\n# B\n\nx", [("B", "x", 1)]),
        ("# A\n\n# B", [("Chapter 1", "# A\n\n# B", 4)]),
    ],
)
def test_chapters(spark, text, want):
    assert chaptered(spark, text) == want


def test_excerpt(spark):
    long = chapters.split_chapters(docs(spark, "word " * 2000))
    r = chapters.audition_excerpt(long, 500).first()
    assert r.word_count == 500 and r.content.endswith("word...") and r.title == " (Audition Excerpt)"
    assert chapters.audition_excerpt(long, 5000).first().content.count("word") == 2000


def cut(spark, text):
    rows = chunks.chunk_chapters(chapters.split_chapters(docs(spark, text))).orderBy("chapter_index", "chunk_index").collect()
    return [(r.chunk_type, r.text, r.pause_before_ms, r.pause_after_ms) for r in rows]


def test_chunks(spark):
    got = cut(spark, "# T\n\nHe sat. \"Who?\" he asked.")
    assert got == [("heading", "T", 600, 800), ("narration", "He sat.", 0, 220), ("dialogue", "Who?", 0, 450), ("narration", "he asked.", 0, 650)]
    got = cut(spark, "He sat. \"Who?\" he asked.\n\n***\n\nan \"open quote")
    assert got == [("narration", "He sat.", 0, 220), ("dialogue", "Who?", 0, 450), ("narration", "he asked.", 0, 650), ("section_break", "", 0, 1200), ("narration", 'an "open quote', 0, 650)]


def test_long_dialogue_is_packed(spark):
    got = cut(spark, '"' + " ".join("This is a sentence of seven words." for _ in range(9)) + '"')
    assert [g[0] for g in got] == ["dialogue"] * 3 and [g[3] for g in got] == [220, 220, 650] and all(len(g[1].split()) <= 28 for g in got)


def test_only_quotes_and_blanks_are_lost(spark):
    text = "A b. \"C d,\" e “f g” h."
    bare = lambda s: "".join(c for c in s if c not in '"“”' and not c.isspace())
    assert bare("".join(g[1] for g in cut(spark, text))) == bare(text)


# --- attribution and casting -------------------------------------------------------------------


def attributed(spark, text, cast=None):
    c = chunks.with_sequence(chunks.chunk_chapters(chapters.split_chapters(docs(spark, text))))
    return attribution.attribute(c, cast)


def speakers(spark, text, cast=None):
    return [(r.character, r.gender) for r in attributed(spark, text, cast).where("chunk_type = 'dialogue'").orderBy("seq").collect()]


def test_attribution(spark):
    # a pronoun led back to the newest name, a tag, the beat before a bare line, alternation, a described speaker, a pronoun across chapters
    assert speakers(spark, STORY) == [("Linda", "female"), ("Marcus", "male"), ("Marcus", "male"), ("Linda", "female"), ("The Clerk", "male"), ("Linda", "female")]


def test_attribution_edges(spark):
    assert speakers(spark, '"Hello."') == [("Unknown Speaker", "unknown")]
    assert speakers(spark, '"Hello."', [Member("Ann", "female")]) == [("Ann", "female")]
    assert speakers(spark, '"Hi," she said. "Well," they said.') == [("Female Speaker", "female"), ("Speaker", "neutral")]
    assert speakers(spark, '"Hi," Lin said.', [Member("Linda Lee", "female", None, ("Lin",))]) == [("Linda Lee", "female")]
    assert speakers(spark, '"Hi," Linda said.', [Member("Linda Lee", "male")]) == [("Linda Lee", "male")]


def test_characters_and_edges(spark):
    rows = attributed(spark, STORY, [Member("Ghost", "neutral", "Kore")])
    got = {r.name: (r.gender, r.line_count, r.assigned_voice, r.interacts_with) for r in attribution.characters(rows, [Member("Ghost", "neutral", "Kore")]).collect()}
    assert got["Linda"] == ("female", 3, None, ["Marcus", "The Clerk"]) and got["Ghost"] == ("neutral", 0, "Kore", [])


def test_partners_get_different_voices(spark):
    rows = attributed(spark, STORY)
    voices = casting.cast_voices(attribution.characters(rows), "gemini")
    by = {r.role: r.voice for r in voices.collect()}
    assert by["Narrator"] == "Fenrir" and by["Linda"] == "Aoede" and {by["Marcus"], by["The Clerk"]} == {"Puck", "Charon"}
    assert casting.conflicts(attribution.interactions(attribution.spoken_lines(rows)), voices).count() == 0


def test_colouring_phases():
    names, pairs = list("abcdef"), {"a": "bcdef", "b": "a", "c": "a", "d": "a", "e": "a", "f": "a"}
    got = casting.colour(names, ["female"] * 6, [6, 5, 4, 3, 2, 1], [None] * 6, [list(pairs[n]) for n in names], "gemini")
    assert got["a"] == "Aoede" and [got[n] for n in "bc"] == ["Kore", "Leda"] and got["d"] == got["e"] == got["f"] == "Kore"
    locked = casting.colour(["a", "b"], ["male", "male"], [1, 1], ["Puck", None], [["b"], ["a"]], "gemini")
    assert locked["a"] == "Puck" and locked["b"] == "Charon"
    full = casting.colour(list("wxyz"), ["female"] * 4, [0, 0, 0, 9], ["Aoede", "Kore", "Leda", None], [[], [], [], ["w", "x", "y"]], "gemini")
    assert full["z"] == "Aoede"  # the pool is exhausted


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ({"A": {"gender": "Male", "voice": "V", "aliases": ["x"]}}, [Member("A", "male", "V", ("x",))]),
        ({"A": "f", "B": "Puck", "C": 3}, [Member("A", "female"), Member("B", voice="Puck"), Member("C")]),
        (["A:male:V", "B:V", "C:m", {"name": "D"}, {"x": 1}], [Member("A", "male", "V"), Member("B", voice="V"), Member("C", "male"), Member("D")]),
        ('{"A": "male"}', [Member("A", "male")]),
        ("{bad", [Member("{bad")]),
        ("A:n, B", [Member("A", "neutral"), Member("B")]),
        (None, []),
        ("", []),
    ],
)
def test_cast_forms(given, want):
    assert read_cast(given) == want


def test_cast_files(tmp_path, spark):
    path = tmp_path / "cast.json"
    path.write_text(json.dumps({"A": "female"}))
    assert read_cast(str(path)) == [Member("A", "female")]
    assert [m.name for m in read_cast([str(path)], open_listed_files=True)] == ["A"]
    specs = ["A", "A:", "A:m", "A:Puck", "A:male:V", "A:x:V", " A : f : V "]
    for r in spark.createDataFrame([(s,) for s in specs], "s string").select("s", parse_spec(F.col("s")).alias("m")).collect():
        want = from_spec(r.s)
        assert (r.m.name, r.m.gender, r.m.voice) == (want.name, want.gender, want.voice), r.s


# --- delivery ----------------------------------------------------------------------------------


def test_prosody(spark):
    rows = spark.createDataFrame([("dialogue", "Dr. X", "male", "A"), ("dialogue", "y", "female", "A"), ("narration", "z", None, None), ("heading", "h", None, None), ("dialogue", "w", "unknown", "B")], "chunk_type string, text string, gender string, character string")
    p = prosody.Profile.named("space_opera")
    got = [tuple(r) for r in prosody.apply(rows, p, 1.025).select("text", "voice", "ssml_rate", "ssml_pitch").collect()]
    assert got == [("Doctor X", "en-US-ChristopherNeural", "+4%", "+0Hz"), ("y", "en-GB-SoniaNeural", "+4%", "+1Hz"), ("z", "en-GB-RyanNeural", "+0%", "+0Hz"), ("h", "en-GB-RyanNeural", "-2%", "-1Hz"), ("w", "B", "+4%", "+0Hz")]
    assert prosody.apply(rows, p, override=F.lit("V")).first().voice == "V"
    assert prosody.with_pacing(rows, "text").first().mode == "normal"


# --- signals -----------------------------------------------------------------------------------


def tone(hz, seconds=1.0, level=10_000):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(24000 * seconds)) / 24000)).astype(np.int16)


def test_wav_round_trip():
    rate, x = dsp.from_wav(dsp.to_wav(tone(440, 0.1)))
    assert rate == 24000 and (x == tone(440, 0.1)).all()
    assert len(dsp.from_wav(b"RIFF")[1]) == 0 and len(dsp.from_wav(b"x" * 100)[1]) == 0 and len(dsp.from_wav(None)[1]) == 0


def test_speech_reports():
    assert dsp.speech_report(tone(300))["is_speech"] and dsp.speech_report(tone(300))["speech_band_ratio"] >= 0.8
    assert dsp.speech_report(np.zeros(24000, np.int16))["reason"] == "silence_or_below_noise_floor"
    noise = np.random.default_rng(42).uniform(-8000, 8000, 24000).astype(np.int16)
    assert not dsp.speech_report(noise)["is_speech"] and dsp.speech_report(noise)["speech_band_ratio"] < 0.45
    assert dsp.speech_report(np.zeros(0, np.int16))["reason"] == "empty_buffer"


def test_crossfade_and_trim():
    a = np.full(2400, 1000, np.int16)
    assert len(dsp.join_faded(a, a, 840)) == 2 * 2400 - 840
    assert len(dsp.trim(np.zeros(5000, np.int16))) == 0
    padded = np.concatenate((np.zeros(3000, np.int16), tone(300, 0.2), np.zeros(3000, np.int16)))
    assert 4800 <= len(dsp.trim(padded)) <= 4800 + 2 * 360 + 480
    loudest = np.array([0] * 400 + [-32768] * 9 + [0] * 400, np.int16)
    assert len(dsp.trim(loudest)) > 0


def test_native_signals_equal_numpy(spark):
    rng = np.random.default_rng(1)
    signals = [rng.integers(-500, 500, n).astype(np.int16) for n in (1, 2, 7, 64, 300)] + [np.array([5, 4, 3, 2, -2, -3, -4, -5], np.int16), np.full(20, 9, np.int16)]
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(signals)], "i int, s array<smallint>")
    got = df.select("i", dsp.nearest_crossing(F.col("s"), F.lit(2), 5).alias("z"), dsp.rms(F.col("s")).alias("r"), dsp.crossfade(F.col("s"), F.col("s"), 4).alias("x"), dsp.zero_crossing_rate(F.col("s")).alias("c"), F.size(dsp.frames(F.col("s"), 16, 8, 3)).alias("f")).collect()
    for r in got:
        s = signals[r.i]
        assert r.z == dsp.snap(s, 2, 5) and r.r == pytest.approx(float(np.sqrt((s.astype(float) ** 2).mean())))
        assert r.x == dsp.join_faded(s, s, 4).tolist()
        assert r.f == (1 if len(s) < 16 else min(3, (len(s) - 16) // 8 + 1))
    assert got[5].z in (3, 4)


def test_mock_engine():
    x = engines.engine("test").speak({"text": "one two three four", "chunk_type": "narration", "character": None})
    assert len(x) == 30_000 and x[0] == 0 and abs(x).max() <= 8000
    assert len(engines.MockEngine().speak({"text": "", "chunk_type": "heading"})) == 7500
    with pytest.raises(ValueError):
        engines.engine("nope")
    with pytest.raises(engines.EngineError):
        engines.engine("edge").speak({"text": "x", "chunk_type": "narration"})


def test_retries():
    calls = []

    def flaky(chunk):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return np.zeros(3, np.int16)

    assert len(engines.engine("gemini", client=flaky, base_seconds=0.0).speak({})) == 3 and len(calls) == 3


# --- synthesis and timelines -------------------------------------------------------------------


def test_cache_and_failures(spark, tmp_path):
    r = Pipeline(Config(backend="mock")).analyse(docs(spark, STORY).withColumns({"title": F.lit("T"), "author": F.lit("A")}))
    first = synthesis.speak(r.delivered, engines.engine("mock"))
    first.write.parquet(str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert cache.where("error is not null").count() == 0 and synthesis.speak(r.delivered, engines.engine("mock"), cache).count() == 0
    failed = synthesis.speak(r.delivered, engines.engine("openai")).collect()
    assert all(x.error and len(x.pcm) >= 2 * 12_000 and not any(x.pcm) for x in failed)
    sounding = synthesis.with_audio(r.delivered, engines.engine("mock"), cache)
    assert sounding.count() == r.delivered.count() and sounding.where("pcm is null").count() == 0


def test_offsets_equal_the_fold(spark):
    rng = np.random.default_rng(7)
    rows, want = [], []
    for d in range(6):
        total = 0
        for s in range(25):
            n = [None, 0, 1, 300, 500, 2000, 30_000][rng.integers(7)]
            pause = int([0, 5, 20, 220, 650][rng.integers(5)])
            rows.append((d, s, 0, "narration", "t", n, pause))
            start = total
            if n is None:
                total += int(max(300, pause) / 1000 * 24000)
            elif n:
                total += n - min(840, total, n) + int(pause / 1000 * 24000)
            want.append((d, s, start, total))
    df = spark.createDataFrame(rows, "doc_id long, seq long, chapter_index int, chunk_type string, text string, n_samples int, pause_after_ms int")
    assert sorted(map(tuple, timeline.place(df).select("doc_id", "seq", "start", "end").collect())) == want


def test_rendered_document(spark):
    documents = manuscripts.from_string(spark, STORY, "My Story")
    p = Pipeline(Config(backend="mock"))
    r = p.render(documents)
    rows = r.placed.orderBy("seq").collect()
    assert len(p.assemble(r)[0]) == rows[-1].end
    marks = r.marks.orderBy("ord").collect()
    assert [m.title for m in marks] == ["The Bar", "Outside"] and marks[0].start_ms == 0
    assert all(a.end_ms == b.start_ms for a, b in zip(marks, marks[1:], strict=False)) and marks[-1].end_ms == int(rows[-1].end / 24000 * 1000)
    at = timeline.chapter_at(r.marks, spark.createDataFrame([(0, 0), (0, marks[0].end_ms)], "doc_id long, t_ms long")).orderBy("t_ms").collect()
    assert [x.ord for x in at] == [0, 1]


def test_pacing_and_breaks_can_count(spark):
    documents = manuscripts.from_string(spark, "One.\n\n***\n\n\"Two,\" he said.")
    plain, own = (Pipeline(Config(backend="mock", pacing_mode="brisk", pacing_pauses=x, pacing_speed=x, break_pauses=x)) for x in (False, True))
    a, b = plain.render(documents), own.render(documents)
    pauses = lambda r: [x.pause_after_ms for x in r.chunks.orderBy("seq").collect()]
    assert pauses(a) == [650, 1200, 450, 650] and pauses(b) == [450, 800, 280, 450]
    assert a.delivered.first().ssml_rate == "+0%" and b.delivered.where("chunk_type = 'narration'").first().ssml_rate == "+10%"
    for p, r in ((plain, a), (own, b)):
        assert len(p.assemble(r)[0]) == r.placed.agg(F.max("end")).first()[0]
    assert b.placed.where("chunk_type = 'section_break'").select(F.col("end") - F.col("start")).first()[0] == 19_200
    assert casting.pool_table(spark).where("engine = 'gemini' and pool = 'female' and pos = 0").first().voice == "Aoede"


def test_wav_files(spark, tmp_path):
    from inkstream.sources import audio

    sinks.write_wav(tone(300), str(tmp_path / "a.wav"))
    (tmp_path / "b.wav").write_bytes(b"no wav")
    got = {r.path.rsplit("/", 1)[1]: r for r in audio.durations(audio.from_wav_files(spark, str(tmp_path / "*.wav"))).collect()}
    assert got["a.wav"].seconds == 1.0 and bytes(got["a.wav"].pcm) == tone(300).tobytes() and got["b.wav"].seconds == 0.0
    assert {r.path.rsplit("/", 1)[1]: r.is_speech for r in audio.verify_files(spark, str(tmp_path / "*.wav")).collect()} == {"a.wav": True, "b.wav": False}


def test_run_writes_files(spark, tmp_path):
    source = tmp_path / "a_story.md"
    source.write_text('---\ntitle: "The <Bar>"\nauthor: Me\n---\n' + STORY)
    config = Config(backend="mock", audio_format="wav")
    heard = []
    done = Pipeline(config).run(spark, str(source), str(tmp_path / "out" / "a.wav"), str(tmp_path / "cache"), lambda *x: heard.append(x))
    assert heard[-1][:2] == (done["total_chunks"],) * 2 and heard[0][2] == "The Bar"
    assert sinks.verify_file(done["audio_path"])["rms"] > 150
    assert [m["title"] for m in done["marks"]] == ["The Bar", "Outside"] and done["duration_seconds"] > 5
    page = open(done["player_path"]).read()
    assert "The &lt;Bar&gt;" in page and "Outside" in page and "a.wav" in page
    again = Pipeline(config).run(spark, str(source), str(tmp_path / "out" / "b.wav"), str(tmp_path / "cache"))
    assert again["duration_seconds"] == done["duration_seconds"]


def test_preview(spark):
    got = preview(spark, {"text": '"Hi," Zoe said. Zoe left. "Bye," Max replied.', "characters": {"Zoe": {"gender": "female", "voice": "Kore"}}})
    assert got["audio"].startswith("data:audio/wav;base64,") and got["voice_map"]["Zoe"] == "Kore" and {c["name"] for c in got["characters"]} == {"Zoe", "Max"}


def test_metadata_and_json(spark):
    marks = spark.createDataFrame([(0, 1, 1, "B", 500, 1000), (0, 0, 0, "A", 0, 500)], "doc_id long, ord int, chapter_index int, title string, start_ms long, end_ms long")
    documents = spark.createDataFrame([(0, "T", "W"), (1, "U", "V")], "doc_id long, title string, author string")
    got = {r.doc_id: r.metadata for r in sinks.ffmetadata(marks, documents).collect()}
    assert got[0].split("\n")[:6] == [";FFMETADATA1", "title=T", "artist=W", "album_artist=W", "album=T", "genre=Audiobook"] and got[0].count("[CHAPTER]") == 2 and "START=500\nEND=1000\ntitle=B" in got[0] and "CHAPTER" not in got[1]
    assert json.loads(sinks.player_chapters(marks).first().chapters) == [{"title": "A", "start_sec": 0.0, "end_sec": 0.5, "chapter_index": 0}, {"title": "B", "start_sec": 0.5, "end_sec": 1.0, "chapter_index": 1}]
    assert sinks.verify_file("/no/such")["is_speech"] is False


# --- sources -----------------------------------------------------------------------------------

PAGE = """<html><head><title>Day &amp; Night</title><meta name="Author" content=" Ann "><style>p{}</style></head><body><nav><p>menu menu</p></nav>
<h1>One</h1><p>First words here.</p><!-- <p>no</p> --><h1>Two</h1><p>Second words here, too.</p><p><b>Short bold</b></p><p>Last.</p><script>"<p>x</p>"</script></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(1, "http://x", PAGE), (2, None, None), (3, "u", "plain <b>text</b>")], "page_id long, url string, html string")
    got = {r.doc_id: r for r in manuscripts.from_pages(df).collect()}
    assert (got[1].title, got[1].author, got[1].source_type, got[1].metadata) == ("Day & Night", "Ann", "WEB_URL", {"url": "http://x"})
    assert got[1].raw_text == "# One\n\nFirst words here.\n\n# Two\n\nSecond words here, too.\n\n# Short bold\n\nLast."
    assert got[2].title == "Web Article" and got[2].raw_text == ""
    one = df.where("page_id = 1")
    assert [r.title for r in chapters.split_chapters(manuscripts.from_pages(one)).orderBy("chapter_index").collect()] == ["One", "Two", "Short bold"]
    native = one.select(html.page_title(F.col("html")).alias("t"), html.page_author(F.col("html")).alias("a"), F.transform(html.blocks(F.col("html")), html.block_line).alias("b")).first()
    assert (native.t, native.a) == ("Day & Night", "Ann") and native.b == ["# One", "First words here.", "# Two", "Second words here, too.", "# Short bold", "Last."]
    assert html.read_page("<p>Neon Rain -- a novelette by J. Doe</p>")[:2] == ("Neon Rain", "J. Doe")
    assert df.where("page_id = 3").select(html.strip_tags(F.col("html"))).first()[0] == "plain  text "


def test_files(spark, tmp_path):
    (tmp_path / "my_text.txt").write_bytes(b"caf\xc3\xa9 \xff end")
    (tmp_path / "n.markdown").write_text("---\nTitle: 'Named'\nempty\nk: a: b\n---\n\n# H\n\nbody")
    (tmp_path / "p.HTM").write_text(PAGE)
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("b.xhtml", "<p>second</p>")
        z.writestr("a.html", "<h1>First</h1><p>one</p>")
        z.writestr("c.html", "<p> </p>")
    (tmp_path / "x.pdf").write_bytes(b"not a pdf")
    first = lambda name: manuscripts.route(spark, str(tmp_path / name)).first()
    text = first("my_text.txt")
    assert (text.title, text.raw_text, text.source_type) == ("My Text", "café � end", "TEXT")
    mark = first("n.markdown")
    assert (mark.title, mark.author, mark.metadata, mark.source_type) == ("Named", "Unknown Author", {"title": "Named", "k": "a: b"}, "MARKDOWN") and mark.raw_text.strip() == "# H\n\nbody"
    assert first("p.HTM").title == "Day & Night" and first("b.epub").raw_text == "# First\n\none\n\n# Section 2\n\nsecond" and "failed" in first("x.pdf").raw_text
    assert manuscripts.route(spark, "just words").first().raw_text == "just words"
    assert manuscripts.from_payload(spark, {"file_base64": "aGk=", "filename": "x.txt"}).first().raw_text == "hi"
    with pytest.raises(FileNotFoundError):
        manuscripts.from_payload(spark, {"file_path": str(tmp_path / "none")})


# --- jobs --------------------------------------------------------------------------------------


def test_jobs(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, 1, "INITIALIZING", 0.0), (1, 2, 2, "COMPLETE", 1.0), (2, 3, 3, "SYNTHESIZING", 0.5), (3, 3, 4, "INITIALIZING", 0.0)], "job_id long, t long, event_id long, state string, value double")
    events = events.select("job_id", F.timestamp_seconds("t").alias("ts"), "event_id", "state", "value")
    jobs.append_events(events, str(tmp_path / "log"))
    assert {r.job_id: r.state for r in jobs.load_jobs(spark, str(tmp_path / "log")).collect()} == {1: "COMPLETE", 2: "ERROR", 3: "ERROR"}
    assert jobs.latest_active(jobs.latest(events)).first().job_id == 3
    jobs.clear(spark, str(tmp_path / "log"))
    assert jobs.load_jobs(spark, str(tmp_path / "log")).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    from inkstream.streaming.attribution import attribute_stream
    from inkstream.streaming.jobs import latest_states

    batch = attributed(spark, STORY)
    total = batch.count()
    batch.select("doc_id", "seq", "chunk_type", "text", F.lit(total).cast("long").alias("n_chunks")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, seq long, chunk_type string, text string, n_chunks long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = attribute_stream(stream).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = [(r.seq, r.character, r.gender) for r in batch.orderBy("seq").collect()]
    assert [(r.seq, r.character, r.gender) for r in spark.table("told").orderBy("seq").collect()] == want
    events = spark.range(40).select((F.col("id") % 5).alias("job_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("event_id"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("state"))
    events.repartition(4).write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    q = latest_states(live).writeStream.format("memory").queryName("states").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(map(tuple, jobs.latest(events).collect()))


# --- network engines, containers, progress ------------------------------------------------------


class Answer(Exception):
    def __init__(self, code):
        super().__init__(f"HTTP {code}")
        self.code = code


def _gemini_answer(samples, kind="audio/L16;rate=24000"):
    import base64

    parts = [{"text": "thinking"}, {"inlineData": {"mimeType": kind, "data": base64.b64encode(samples.astype("<i2").tobytes()).decode()}}, {"inlineData": {"mimeType": kind, "data": ""}}]
    return json.dumps({"candidates": [{"content": {"parts": parts}}]}).encode()


def test_gemini_takes_the_first_sound_and_the_second_model():
    asked = []

    def post(url, payload, headers=None, timeout=20.0):
        asked.append((url.split("models/")[1].split(":")[0], payload["generationConfig"]["speechConfig"]["voiceConfig"]["prebuiltVoiceConfig"]["voiceName"]))
        if len(asked) == 1:
            raise Answer(404)
        if len(asked) == 2:
            raise Answer(429)
        return _gemini_answer(np.arange(5))

    e = engines.engine("gemini", api_key="k", post=post, base_seconds=0.0)
    assert e.speak({"text": " hello ", "voice": "en-US-AriaNeural"}).tolist() == [0, 1, 2, 3, 4]
    assert asked == [(fixed.GEMINI_MODEL, "Kore"), (fixed.GEMINI_SECOND_MODEL, "Kore"), (fixed.GEMINI_SECOND_MODEL, "Kore")]
    with pytest.raises(engines.EngineError):
        engines.first_audio({"candidates": [{"content": {"parts": [{"text": "no"}]}}]})
    with pytest.raises(engines.EngineError):
        engines.first_audio({})


def test_gemini_is_never_silent():
    heard = []
    stand_in = engines.EdgeEngine(client=lambda c: heard.append(c["voice"]) or np.ones(3, np.int16))

    def post(*_, **__):
        raise Answer(500)

    assert engines.engine("gemini", api_key="k", post=post, base_seconds=0.0, stand_in=stand_in).speak({"text": "x", "voice": "Kore"}).tolist() == [1, 1, 1]
    assert engines.GeminiEngine(stand_in=stand_in).speak({"text": "x", "character": "Sulafat"}).tolist() == [1, 1, 1]  # without a key
    assert heard == ["en-US-AriaNeural", "en-US-JennyNeural"]


def test_openai_reads_raw_samples():
    def post(url, payload, headers=None, timeout=20.0):
        assert headers["Authorization"] == "Bearer k" and payload["response_format"] == "pcm"
        return np.array([7 if payload["voice"] == "nova" else 9, payload["model"] == "m"], "<i2").tobytes()

    e = engines.engine("openai", api_key="k", post=post, model="m")
    assert e.speak({"text": "x", "character": "nova"}).tolist() == [7, 1] and e.speak({"text": "x", "character": "Zoe"}).tolist() == [9, 1]


def test_containers(spark, tmp_path):
    """WAV needs no decoder; what can't be decoded is told, not invented."""
    from inkstream.sources import audio as sound

    x = (8000 * np.sin(np.arange(24000) / 20)).astype(np.int16)
    wav = dsp.to_wav(x)
    assert engines.decoded(wav).tolist() == x.tolist() and engines.decoded(x.tobytes(), "audio/pcm").tolist() == x.tolist()
    (tmp_path / "a.mp3").write_bytes(b"no sound at all")
    (tmp_path / "b.m4b").write_bytes(wav)
    assert sinks.verify_file(str(tmp_path / "a.mp3"))["reason"].startswith("decode_error") and sinks.verify_file(str(tmp_path / "b.m4b"))["rms"] > 1000
    got = {r.path[-5:]: r.pcm for r in sound.from_audio_files(spark, f"file://{tmp_path}").collect()}
    assert got["a.mp3"] is None and bytes(got["b.m4b"]) == x.tobytes()


def test_progress_while_it_happens(spark, tmp_path):
    from inkstream.plans import pipeline

    heard = []
    done = Pipeline(Config(backend="mock", generate_player=False)).run(spark, "# One\n\nA first line. And more of it.\n\nA second line here.", str(tmp_path / "o.wav"), f"file://{tmp_path}/cache", lambda *x: heard.append(x))
    assert heard[-1][0] == heard[-1][1] == 3 and done["total_chunks"] == 3
    again = Pipeline(Config(backend="mock", generate_player=False)).run(spark, "# One\n\nA first line. And more of it.\n\nA second line here.", str(tmp_path / "p.wav"), f"file://{tmp_path}/cache", lambda *x: heard.append(x))
    assert heard[-1][:2] == (3, 3) and again["duration_seconds"] == done["duration_seconds"] and spark.read.parquet(f"file://{tmp_path}/cache").count() == 3
    with pytest.raises(ZeroDivisionError):
        pipeline.watched(lambda: 1 / 0, lambda: None)


def test_preview_of_one_chunk_casts_nobody(spark):
    got = preview(spark, {"text": "Just a short line.", "backend": "mock"})
    assert got["total_chunks"] == 1 and got["characters"] == [] and got["audio"].startswith("data:audio/wav;base64,")


def test_documents_without_characters_get_the_reserved_roles(spark):
    r = Pipeline(Config(backend="gemini", voice="Fenrir")).analyse(manuscripts.from_string(spark, "# A\n\nNobody speaks here."))
    assert sorted((v.role, v.voice) for v in r.voice_map.collect()) == [("Narrator", "Fenrir"), ("heading", "Fenrir"), ("section_break", "Fenrir")]


def test_a_sound_appended_twice_counts_once(spark):
    rows = spark.createDataFrame([("k", b"\0\0" * 10, 10, None), ("k", b"\0\0" * 10, 10, None)], synthesis.AUDIO)
    assert synthesis.held(rows).collect()[0].n_samples == 10 and synthesis.held(rows).count() == 1


def test_native_and_numpy_snapping_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(-5, 60)), rng.integers(-9, 9, rng.integers(0, 50)).tolist()) for _ in range(200)]
    got = spark.createDataFrame(rows, "t int, s array<smallint>").select("t", "s", dsp.nearest_crossing(F.col("s"), F.col("t"), 7).alias("at")).collect()
    assert all(r["at"] == dsp.snap(np.array(r.s, np.int16), r.t, 7) for r in got)


def plain_sound(n, hz, rate=24_000, attack=480, decay=720):
    """The synthetic engine's sound as its definition has it, sample by sample."""
    i = np.arange(n)
    wave = sum(share * np.sin(2 * np.pi * k * hz * (i / rate)) for k, share in ((1, 0.60), (2, 0.25), (3, 0.15)))
    gain = np.where(i < attack, i / attack, np.where(i > n - decay, (n - i) / decay, 1.0))
    return np.clip(np.trunc(wave * gain * 8000), -32767, 32767).astype(np.int16)


def test_sounds_share_what_they_have_in_common(monkeypatch):
    """Sounds of a voice differ in length and decay only; the tone before that is made once, however many there are."""
    made, sin = [], np.sin
    monkeypatch.setattr(np, "sin", lambda x: made.append(x.size) or sin(x))
    sounds = [engines.MockEngine().speak({"text": "word " * k, "chunk_type": "dialogue", "character": "Puck"}) for k in range(1, 301)]
    assert sum(made) < 0.1 * 3 * sum(map(len, sounds))
    monkeypatch.undo()
    assert all(np.array_equal(x, plain_sound(len(x), 160.0 * 1.15)) for x in sounds)


def test_sounds_of_a_length_share_their_decay(monkeypatch):
    e, row = engines.MockEngine(), {"text": "word " * 17, "chunk_type": "narration", "character": "Aoede"}
    first, made, sin = e.speak(row), [], np.sin
    monkeypatch.setattr(np, "sin", lambda x: made.append(x.size) or sin(x))
    first[:] = 0  # a sound is its caller's own
    assert np.array_equal(e.speak(row), e.speak(row)) and e.speak(row).any() and not made
    monkeypatch.undo()
    assert np.array_equal(e.speak(row), plain_sound(len(first), 230.0))


@pytest.mark.parametrize("n", [240, 479, 480, 481, 719, 720, 721, 1199, 1200, 1201, 4095, 4096, 4097, 4816, 9000, 12_288, 30_000])
def test_sounds_of_any_length(n, monkeypatch):
    """Shorter than their fades, within and beyond what is kept of a tone."""
    monkeypatch.setattr(engines.Tone, "BLOCK", 1024)
    monkeypatch.setattr(engines.Tone, "MOST", 4096)
    engines.tone.cache_clear()
    e = engines.MockEngine(words_per_second=24_000 / n)
    for _ in range(2):
        assert np.array_equal(e.speak({"text": "one", "chunk_type": "narration"}), plain_sound(n, 150.0))
    engines.tone.cache_clear()


def test_trimming_reads_the_ends():
    """The bounds are those of all loud samples, wherever they are."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, amplitude = int(rng.integers(0, 9000)), int(rng.choice([2, 150, 200, 32_768]))
        x = rng.integers(-amplitude, amplitude, n).astype(np.int16)
        x[: rng.integers(0, n + 1)] //= 300
        x[rng.integers(0, n + 1) :] //= 300
        loud = np.flatnonzero(np.abs(x.astype(int)) > 150)
        want = x[dsp.snap(x, max(0, loud[0] - 360)) : dsp.snap(x, min(n, loud[-1] + 361))] if len(loud) else x[:0]
        assert np.array_equal(dsp.trim(x), want)


def test_measured_sounds_are_those_spoken(spark):
    p = Pipeline(Config(backend="mock"))
    documents = docs(spark, STORY).withColumns({"title": F.lit("T"), "author": F.lit("A")})
    r = p.analyse(documents)
    for e in (engines.engine("mock"), engines.engine("openai")):  # the second one fails
        spoken = synthesis.speak(r.delivered, e).select("key", (F.length("pcm") / 2).cast("int"), "n_samples", "error").collect()
        assert sorted(map(tuple, synthesis.measure(r.delivered, e).collect()), key=lambda x: x[0]) == sorted(map(tuple, spoken), key=lambda x: x[0])
    assert sorted(p.time(documents).marks.collect()) == sorted(p.render(documents).marks.collect())
