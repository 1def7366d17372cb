"""Queries over the driver's tables, one for each operator, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstream import fixed
from inkstream.functions import dsp, html, speech
from inkstream.functions import text as T
from inkstream.operators import attribution, cast_spec, casting, chapters, chunks, engines, jobs, prosody, sinks, synthesis, timeline
from inkstream.plans import sql, views
from inkstream.plans.pipeline import Config, Pipeline
from inkstream.plans.views import JOB_EVENTS, SIGNAL, table
from inkstream.sources import audio, manuscripts
from inkstream.streaming import attribution as stream_attribution
from inkstream.streaming import jobs as job_streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Texts with the patterns that the tables lack, made the same way on both sides.
KNOTS = [("e, ", "e-\n"), (". ", ".\n\n\n\n"), (" of ", "\nof\n"), (" the ", " Dr.  Mr. the "), (" and ", " 1,234,567,890 and 12,34 "), (" in ", " — "), (" to ", " – to.... ")]


def knotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    for a, b in KNOTS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def _knotted_sql() -> str:
    text = "coalesce(text, '')"
    for a, b in KNOTS:
        text = f"replace({text}, {sql.q(a)}, {sql.q(b)})"
    return f"WITH knotted AS (SELECT doc_id, {text} AS text FROM documents)"


K = _knotted_sql()


# --- cleaning and normalisation ----------------------------------------------------------------


@query(f"SELECT doc_id, {sql.clean('text')} AS cleaned FROM documents")
def clean_prose(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_prose(F.col("text")).alias("cleaned"))


@query(f"{K} SELECT doc_id, {sql.clean('text')} AS cleaned FROM knotted")
def clean_prose_knots(spark, sf_dir):
    return knotted(spark, sf_dir).select("doc_id", T.clean_prose(F.col("text")).alias("cleaned"))


@query(f"{K} SELECT doc_id, {sql.hyphens('text')} AS joined FROM knotted")
def hyphen_join(spark, sf_dir):
    return knotted(spark, sf_dir).select("doc_id", T.join_hyphens(F.col("text")).alias("joined"))


@query(f"{K} SELECT doc_id, {sql.wraps('text')} AS joined FROM knotted")
def soft_wrap_join(spark, sf_dir):
    return knotted(spark, sf_dir).select("doc_id", T.join_soft_wraps(F.col("text")).alias("joined"))


@query(rf"{K} SELECT doc_id, regexp_replace(text, '\n{{3,}}', {sql.NN}, 'g') AS squeezed FROM knotted")
def blank_squeeze(spark, sf_dir):
    return knotted(spark, sf_dir).select("doc_id", T.squeeze_blank_lines(F.col("text")).alias("squeezed"))


@query(f"{K} SELECT doc_id, {sql.normalize('text')} AS spoken FROM knotted")
def normalize_text(spark, sf_dir):
    return views.spread(knotted(spark, sf_dir)).select("doc_id", T.normalize_text(F.col("text")).alias("spoken"))


@query(f"{K} SELECT doc_id, {sql.honorifics('text')} AS expanded FROM knotted")
def honorifics(spark, sf_dir):
    return knotted(spark, sf_dir).select("doc_id", T.expand_honorifics(F.col("text")).alias("expanded"))


@query(f"{K} SELECT doc_id, {sql.thousands('text')} AS plain FROM knotted")
def thousands(spark, sf_dir):
    return knotted(spark, sf_dir).select("doc_id", T.drop_thousands_commas(F.col("text")).alias("plain"))


@query(f"{K} SELECT doc_id, {sql.dashes('text')} AS spaced FROM knotted")
def dashes(spark, sf_dir):
    return knotted(spark, sf_dir).select("doc_id", T.space_dashes(F.col("text")).alias("spaced"))


@query(f"{K} SELECT doc_id, {sql.ellipses('text')} AS squeezed FROM knotted")
def ellipsis(spark, sf_dir):
    return knotted(spark, sf_dir).select("doc_id", T.squeeze_ellipses(F.col("text")).alias("squeezed"))


@query(f"{K} SELECT doc_id, {sql.collapse('text')} AS collapsed FROM knotted")
def collapse_ws(spark, sf_dir):
    return knotted(spark, sf_dir).select("doc_id", T.collapse_blanks(F.col("text")).alias("collapsed"))


# --- chapters ----------------------------------------------------------------------------------


def _prose_chapters(spark, sf_dir):
    return chapters.split_chapters(views.prose(spark, sf_dir))


@query(f"{sql.prose_chapters()} SELECT * FROM chapters")
def split_chapters(spark, sf_dir):
    return _prose_chapters(spark, sf_dir)


@query(f"{sql.prose_chapters()} SELECT doc_id, sum(word_count)::BIGINT AS total_words, count(*) AS total_chapters FROM chapters GROUP BY doc_id")
def doc_totals(spark, sf_dir):
    return chapters.totals(_prose_chapters(spark, sf_dir))


@query(f"{sql.prose_chapters()} SELECT doc_id, chapter_index, title, word_count FROM chapters")
def chapter_words(spark, sf_dir):
    return _prose_chapters(spark, sf_dir).select("doc_id", "chapter_index", "title", "word_count")


@query(
    f"""{sql.prose_chapters()}, cut AS (SELECT doc_id, chapter_index, title || ' (Audition Excerpt)' AS title,
    CASE WHEN word_count > 40 THEN array_to_string(({sql.word_list('content')})[1:40], ' ') || '...' ELSE content END AS content FROM chapters WHERE chapter_index = 0)
SELECT *, {sql.word_count('content')}::INT AS word_count FROM cut"""
)
def audition_excerpt(spark, sf_dir):
    return chapters.audition_excerpt(_prose_chapters(spark, sf_dir), 40)


# --- chunks ------------------------------------------------------------------------------------


def script_chunks(spark, sf_dir):
    return chunks.chunk_chapters(chapters.split_chapters(views.script(spark, sf_dir)))


def prose_chunks(spark, sf_dir):
    return chunks.chunk_chapters(_prose_chapters(spark, sf_dir))


@query(f"{sql.chunked('script')} SELECT * FROM chunks")
def chunk_script(spark, sf_dir):
    return script_chunks(spark, sf_dir)


@query(f"{sql.chunked('prose')} SELECT * FROM chunks")
def chunk_prose(spark, sf_dir):
    return prose_chunks(spark, sf_dir)


@query(f"{sql.prose_chapters()} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, p FROM paras")
def paragraphs(spark, sf_dir):
    return chapters.clean(views.prose(spark, sf_dir)).select("doc_id", F.posexplode(T.paragraphs(F.col("cleaned"))).alias("pos", "p"))


@query(f"{sql.chunked('script')} SELECT chunk_type, pause_before_ms, pause_after_ms, count(*) AS n FROM chunks GROUP BY ALL")
def chunk_types(spark, sf_dir):
    return script_chunks(spark, sf_dir).groupBy("chunk_type", "pause_before_ms", "pause_after_ms").agg(F.count("*").alias("n"))


@query(f"{sql.chunked('script')} SELECT doc_id, chapter_index, sum(pause_before_ms)::BIGINT AS before_ms, sum(pause_after_ms)::BIGINT AS after_ms, count(*) AS chunks FROM chunks GROUP BY ALL")
def chunk_pauses(spark, sf_dir):
    return chunks.totals(script_chunks(spark, sf_dir))


@query(f"{sql.chunked('mixed')} SELECT * FROM chunks")
def chunk_mixed(spark, sf_dir):
    return chunks.chunk_chapters(chapters.split_chapters(views.mixed(spark, sf_dir)))


@query(f"{sql.chunked('mixed')} SELECT doc_id, chapter_index, title, word_count FROM chapters")
def mixed_chapters(spark, sf_dir):
    return chapters.split_chapters(manuscripts.from_table(views.mixed(spark, sf_dir), "doc_id", "raw_text")).select("doc_id", "chapter_index", "title", "word_count")


@query(
    f"""WITH p AS (SELECT doc_id, coalesce(text, '') AS p FROM documents), s AS (
    SELECT doc_id, 2 * generate_subscripts(g, 1) AS k, 'narration' AS chunk_type, {sql.strip('unnest(g)')} AS text FROM (SELECT doc_id, string_split_regex(p, '{sql.QUOTED}') AS g FROM p)
    UNION ALL SELECT doc_id, 2 * generate_subscripts(g, 1) + 1, 'dialogue', {sql.strip('unnest(g)')}
    FROM (SELECT doc_id, list_transform(regexp_extract_all(p, '{sql.QUOTED}'), lambda x: substr(x, 2, length(x) - 2)) AS g FROM p))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS pos, chunk_type, text FROM s WHERE text <> ''"""
)
def dialogue_segments(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks.segments(F.coalesce("text", F.lit("")))).alias("pos", "s"))
    return found.select("doc_id", "pos", "s.chunk_type", "s.text")


@query(f"SELECT doc_id, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::INT AS pos FROM (SELECT doc_id, {sql.sentence_array('text')} AS s FROM documents WHERE text IS NOT NULL)")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"{sql.chunked('prose')} SELECT doc_id, chapter_index, pp::INT AS paragraph, count(DISTINCT pack) AS packs, max(wc)::BIGINT AS most_words FROM (SELECT *, {sql.word_count('text')} AS wc FROM packs) GROUP BY ALL")
def sentence_pack(spark, sf_dir):
    found = chapters.split_chapters(views.spread(views.prose(spark, sf_dir)))
    paras = found.select("doc_id", "chapter_index", F.posexplode(T.paragraphs(chapters.compose(F.col("title"), F.col("content")))).alias("at", "p"))
    paras = paras.where(~F.col("p").startswith("#") & T.longer_than(F.col("p"), fixed.MAX_WORDS))
    long = paras.select("doc_id", "chapter_index", "at", F.explode(chunks.segments(F.col("p"))).alias("s")).where(T.longer_than(F.col("s.text"), fixed.MAX_WORDS))
    packs = long.select("doc_id", "chapter_index", (F.col("at") + 1).alias("paragraph"), F.posexplode(chunks.pack(F.col("s.text"), fixed.TARGET_WORDS)).alias("k", "text"))
    return packs.groupBy("doc_id", "chapter_index", "paragraph").agg(F.countDistinct("k").alias("packs"), F.max(T.word_count(F.col("text"))).cast("long").alias("most_words"))


@query(f"{sql.chunked('mixed')} SELECT chunk_type, pause_after_ms, count(*) AS n FROM chunks GROUP BY ALL".replace(f"greatest(after, {fixed.PARAGRAPH_MS})", "greatest(after, 300)"))
def paragraph_pause_bump(spark, sf_dir):
    """With a paragraph's pause between those of narration and dialogue: the last chunk of a paragraph is raised to it or already above."""
    cut = chunks.chunk_chapters(chapters.split_chapters(views.mixed(spark, sf_dir)), pauses=chunks.Pauses(paragraph=300))
    return cut.groupBy("chunk_type", "pause_after_ms").agg(F.count("*").alias("n"))


# --- delivery ----------------------------------------------------------------------------------

PROFILE = prosody.Profile.named("space_opera")
GENDER_SQL = "CASE WHEN chunk_index % 3 = 0 THEN 'female' WHEN chunk_index % 3 = 1 THEN 'male' ELSE 'unknown' END"


def gendered(spark, sf_dir):
    """Chunks with made-up genders and characters, to reach every branch."""
    g = F.when(F.col("chunk_index") % 3 == 0, "female").when(F.col("chunk_index") % 3 == 1, "male").otherwise("unknown")
    return script_chunks(spark, sf_dir).withColumns({"gender": g, "character": F.when(F.col("chunk_index") % 2 == 0, "Alice"), "wanted": F.when(F.col("chunk_index") % 5 == 0, "Puck").otherwise("")})


@query(
    f"""{sql.chunked('script')}, g AS (SELECT *, {GENDER_SQL} AS gender, CASE chunk_type WHEN 'heading' THEN -4 WHEN 'dialogue' THEN 2 ELSE -2 END + 12 AS r FROM chunks)
SELECT doc_id, chapter_index, chunk_index, CASE WHEN r >= 0 THEN '+' ELSE '' END || r || '%' AS ssml_rate,
       CASE WHEN chunk_type = 'heading' THEN '-1Hz' WHEN chunk_type = 'dialogue' AND gender = 'female' THEN '+1Hz' ELSE '+0Hz' END AS ssml_pitch FROM g"""
)
def prosody_rate_pitch(spark, sf_dir):
    rows = gendered(spark, sf_dir)
    return rows.select("doc_id", "chapter_index", "chunk_index", prosody.rate(F.col("chunk_type"), PROFILE, 1.125).alias("ssml_rate"), prosody.pitch(F.col("chunk_type"), F.col("gender"), PROFILE).alias("ssml_pitch"))


@query(
    f"""{sql.chunked('script')}, g AS (SELECT *, {GENDER_SQL} AS gender, CASE WHEN chunk_index % 2 = 0 THEN 'Alice' END AS character, CASE WHEN chunk_index % 5 = 0 THEN 'Puck' END AS wanted FROM chunks)
SELECT doc_id, chapter_index, chunk_index, CASE WHEN chunk_type = 'dialogue' THEN coalesce(wanted, CASE gender WHEN 'male' THEN 'en-US-ChristopherNeural' WHEN 'female' THEN 'en-GB-SoniaNeural' END, character, 'en-GB-RyanNeural')
       ELSE coalesce(character, 'en-GB-RyanNeural') END AS voice FROM g"""
)
def voice_cascade(spark, sf_dir):
    rows = gendered(spark, sf_dir)
    return rows.select("doc_id", "chapter_index", "chunk_index", prosody.voice(F.col("chunk_type"), F.col("gender"), F.col("character"), F.col("wanted"), PROFILE).alias("voice"))


_PACING = ", ".join(f"('{m}', {v['sentence_pause_ms']}, {v['paragraph_pause_ms']}, {v['chapter_pause_ms']}, {v['speed_multiplier']}::DOUBLE)" for m, v in fixed.PACING.items())


@query(
    f"""WITH presets(mode, sentence_pause_ms, paragraph_pause_ms, chapter_pause_ms, speed_multiplier) AS (VALUES {_PACING}),
d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'brisk' WHEN 2 THEN 'cinematic' ELSE 'hasty' END AS asked FROM documents)
SELECT doc_id, mode, sentence_pause_ms, paragraph_pause_ms, chapter_pause_ms, speed_multiplier FROM d JOIN presets ON mode = CASE WHEN asked IN (SELECT mode FROM presets) THEN asked ELSE 'normal' END"""
)
def pacing_lookup(spark, sf_dir):
    asked = F.element_at(F.array(*map(F.lit, ("normal", "brisk", "cinematic", "hasty"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", asked.alias("asked"))
    return prosody.with_pacing(rows, "asked").select("doc_id", "mode", "sentence_pause_ms", "paragraph_pause_ms", "chapter_pause_ms", "speed_multiplier")


@query(
    f"""WITH v(voice) AS (VALUES {', '.join(f"('{v}')" for v in [*fixed.TO_GEMINI, 'Puck'])}), d AS (SELECT doc_id, (doc_id % {len(fixed.TO_GEMINI) + 1})::INT AS k FROM documents),
n AS (SELECT voice, (row_number() OVER () - 1)::INT AS k FROM v), m(src, dst) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in fixed.TO_GEMINI.items())})
SELECT doc_id, voice, coalesce(dst, voice) AS resolved FROM d JOIN n USING (k) LEFT JOIN m ON src = voice"""
)
def engine_voice(spark, sf_dir):
    names = F.array(*[F.lit(v) for v in [*fixed.TO_GEMINI, "Puck"]])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % (len(fixed.TO_GEMINI) + 1) + 1).cast("int")).alias("voice"))
    return rows.withColumn("resolved", prosody.resolve_engine_voice("gemini", F.col("voice"), "Fenrir"))


# --- speakers ----------------------------------------------------------------------------------

_VERBS = "|".join(fixed.SPEECH_VERBS)
_NARRATION = f"{sql.chunked('script')}, n AS (SELECT doc_id, chapter_index, chunk_index, list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda s: {sql.strip('s')}), lambda s: s <> '') AS parts FROM chunks WHERE chunk_type = 'narration')"


@query(
    rf"""{_NARRATION}, s AS (SELECT *, parts[1] AS sentence FROM n WHERE len(parts) > 0),
v AS (SELECT *, nullif(regexp_extract(sentence, '(?i)(?:^|[^\p{{L}}\p{{N}}_])({_VERBS})(?:$|[^\p{{L}}\p{{N}}_])', 1), '') AS verb FROM s)
SELECT doc_id, chapter_index, chunk_index, verb, CASE WHEN verb IS NOT NULL THEN {sql.strip("string_split(sentence, verb)[1]")} END AS candidate FROM v"""
)
def speech_tags(spark, sf_dir):
    s = speech.tag_sentence(F.col("text"), True)
    rows = script_chunks(spark, sf_dir).where("chunk_type = 'narration'").withColumn("s", s).where("s is not null")
    return rows.select("doc_id", "chapter_index", "chunk_index", speech.speech_verb(F.col("s")).alias("verb"), speech.tag_candidate(F.col("s")).alias("candidate"))


@query(rf"SELECT doc_id, list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^([\p{{N}}_]*\p{{Lu}}\p{{Ll}}*)+[\p{{N}}_]*$') AND NOT regexp_matches(w, '\p{{Lu}}\p{{Lu}}|\p{{Ll}}\p{{Lu}}|[\p{{N}}_]\p{{Ll}}')) AS names FROM documents WHERE text IS NOT NULL")
def name_scan(spark, sf_dir):
    tokens = F.regexp_extract_all("text", F.lit(f"{T.W}+"), F.lit(0))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.filter(tokens, T.is_title).alias("names"))


@query(
    rf"""{_NARRATION}, s AS (SELECT *, parts[1] AS sentence, lower({sql.strip("string_split(parts[1], ' said')[1]")}) AS who FROM n WHERE len(parts) > 0)
SELECT doc_id, chapter_index, chunk_index, CASE
    WHEN list_has_any(string_split_regex(who, '{sql.WS}+'), {fixed.FEMALE_TITLES!r}) OR regexp_matches(who, '{"|".join(fixed.FEMALE_NAMES)}') THEN 'female'
    WHEN list_has_any(string_split_regex(who, '{sql.WS}+'), {fixed.MALE_TITLES!r}) OR regexp_matches(who, '{"|".join(fixed.MALE_NAMES)}') THEN 'male'
    WHEN regexp_matches(lower(sentence), '(^|[^\p{{L}}\p{{N}}_])(she|her|hers)($|[^\p{{L}}\p{{N}}_])') THEN 'female'
    WHEN regexp_matches(lower(sentence), '(^|[^\p{{L}}\p{{N}}_])(he|him|his)($|[^\p{{L}}\p{{N}}_])') THEN 'male' ELSE 'unknown' END AS gender FROM s"""
)
def gender_infer(spark, sf_dir):
    rows = script_chunks(spark, sf_dir).where("chunk_type = 'narration'").withColumn("s", speech.tag_sentence(F.col("text"), True)).where("s is not null")
    who = T.strip(F.element_at(F.split("s", " said"), 1))
    return rows.select("doc_id", "chapter_index", "chunk_index", speech.gender(who, F.col("s")).alias("gender"))


def attributed(spark, sf_dir):
    return attribution.attribute(chunks.with_sequence(script_chunks(spark, sf_dir)))


@query(f"{sql.chunked('script')},{sql.SPEAKERS} SELECT doc_id, seq, character, gender, text FROM spoken_by")
def attributed_dialogue(spark, sf_dir):
    return attributed(spark, sf_dir).where("chunk_type = 'dialogue'").select("doc_id", "seq", "character", "gender", "text")


@query(f"{sql.chunked('script')},{sql.SPEAKERS} SELECT doc_id, seq, character, gender, text FROM spoken_by")
def attributed_stream(spark, sf_dir):
    """As ``attributed_dialogue``, from a stream of chunks in any order."""
    folder = views.scratch(spark, "chunks")
    rows = chunks.with_sequence(script_chunks(spark, sf_dir)).select("doc_id", "seq", "chunk_type", "text")
    rows = rows.withColumn("n_chunks", F.count("*").over(Window.partitionBy("doc_id")))
    rows.repartition(2, F.col("seq") % 2).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    _drain(stream_attribution.attribute_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/offsets"))
    return spark.read.parquet(f"{folder}/out").where("chunk_type = 'dialogue'").select("doc_id", "seq", "character", "gender", "text")


@query(f"{sql.chunked('script')},{sql.SPEAKERS} SELECT * FROM profiles")
def character_profiles(spark, sf_dir):
    return attribution.characters(attributed(spark, sf_dir)).select("doc_id", "name", "gender", "line_count", F.array_join("interacts_with", ",").alias("interacts_with"))


def _cast_sql(engine: str, locked: str = "NULL") -> str:
    reserved = " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{r}' AS role, '{fixed.VOICE_POOLS[engine]['narrator'][0]}' AS voice FROM profiles" for r in casting.RESERVED)
    return f"{reserved} UNION ALL SELECT doc_id, name, coalesce({locked}, {sql.pool(engine)}) FROM ranked"


@query(f"{sql.chunked('script')},{sql.SPEAKERS} {_cast_sql('gemini')}")
def cast_voices(spark, sf_dir):
    return casting.cast_voices(attribution.characters(attributed(spark, sf_dir)), "gemini")


@query(
    f"""{sql.chunked('script')},{sql.SPEAKERS}, docs AS (SELECT DISTINCT doc_id FROM chunks)
SELECT doc_id, unnest(['Narrator', 'heading', 'section_break']) AS role, '{fixed.VOICE_POOLS['edge']['narrator'][0]}' AS voice FROM docs
UNION ALL SELECT doc_id, 'Alice', 'Leda' FROM docs UNION ALL SELECT doc_id, 'The Narrator', '{fixed.VOICE_POOLS['edge']['neutral'][0]}' FROM docs
UNION ALL SELECT doc_id, name, {sql.pool('edge')} FROM ranked WHERE name <> 'Alice'"""
)
def locked_cast(spark, sf_dir):
    members = cast_spec.read_cast(["Alice:female:Leda", "The Narrator:neutral"])
    people = attribution.characters(attribution.attribute(chunks.with_sequence(script_chunks(spark, sf_dir)), members), members)
    return casting.cast_voices(people, "edge")


@query("SELECT 0::BIGINT AS doc_id, '' AS a, '' AS b, '' AS voice WHERE false")
def cast_conflicts(spark, sf_dir):
    """Partners with one voice: none, since no pool is exhausted here."""
    rows = attributed(spark, sf_dir)
    found = casting.conflicts(attribution.interactions(attribution.spoken_lines(rows)), casting.cast_voices(attribution.characters(rows), "gemini"))
    return found.select("doc_id", "a", "b", F.col("voice_a").alias("voice"))


@query(
    f"""{sql.chunked('script')},{sql.SPEAKERS}, v AS (SELECT doc_id, name, {sql.pool('gemini')} AS voice FROM ranked)
SELECT p.doc_id, p.name AS a, p.peer AS b, x.voice AS voice_a, y.voice AS voice_b FROM partners p JOIN v x ON x.doc_id = p.doc_id AND x.name = p.name JOIN v y ON y.doc_id = p.doc_id AND y.name = p.peer WHERE p.name < p.peer"""
)
def partner_voices(spark, sf_dir):
    """Everyone who answers each other, with their voices."""
    rows = attributed(spark, sf_dir)
    voices = casting.cast_voices(attribution.characters(rows), "gemini")
    return casting.partners(attribution.interactions(attribution.spoken_lines(rows)), voices).select("doc_id", "a", "b", "voice_a", "voice_b")


@query(f"SELECT * FROM (VALUES {', '.join(f'({sql.q(e)}, {sql.q(k)}, {i}, {sql.q(v)})' for e, by in fixed.VOICE_POOLS.items() for k, vs in by.items() for i, v in enumerate(vs))}) t(engine, pool, pos, voice)")
def voice_pools(spark, sf_dir):
    return casting.pool_table(spark)


def role_lines(spark, sf_dir):
    """Turns as lines, the role as speaker."""
    g = F.when(F.col("turn") % 3 == 0, "unknown").when(F.length("text") % 2 == 0, "female").otherwise("male")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("role").alias("character"), F.lit("dialogue").alias("chunk_type"), g.alias("gender"), "text")


@query("SELECT conv_id AS doc_id, role AS character, count(*) AS line_count FROM conversations GROUP BY ALL")
def speaker_lines(spark, sf_dir):
    return attribution.characters(role_lines(spark, sf_dir)).select("doc_id", F.col("name").alias("character"), "line_count")


_GENDERED = "SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN 'unknown' WHEN length(text) % 2 = 0 THEN 'female' ELSE 'male' END AS gender FROM conversations"


@query(f"SELECT conv_id AS doc_id, role AS character, coalesce(arg_min(gender, turn) FILTER (gender <> 'unknown'), 'unknown') AS gender FROM ({_GENDERED}) GROUP BY ALL")
def speaker_gender(spark, sf_dir):
    return attribution.characters(role_lines(spark, sf_dir)).select("doc_id", F.col("name").alias("character"), "gender")


_EDGES = """WITH l AS (SELECT conv_id AS doc_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
edges AS (SELECT DISTINCT doc_id, least(role, prev) AS a, greatest(role, prev) AS b FROM l WHERE prev <> role)"""


@query(f"{_EDGES} SELECT * FROM edges")
def interaction_edges(spark, sf_dir):
    return attribution.interactions(role_lines(spark, sf_dir))


@query(f"{_EDGES} SELECT doc_id, name, string_agg(DISTINCT peer, ',' ORDER BY peer) AS peers FROM (SELECT doc_id, a AS name, b AS peer FROM edges UNION ALL SELECT doc_id, b, a FROM edges) GROUP BY ALL")
def neighbours(spark, sf_dir):
    return attribution.neighbours(attribution.interactions(role_lines(spark, sf_dir))).select("doc_id", "name", F.array_join("interacts_with", ",").alias("peers"))


@query(
    f"""{sql.chunked('script')}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chapter_index, chunk_index) - 1 AS seq FROM chunks), l AS (SELECT doc_id, seq, chunk_type,
    lag(CASE WHEN chunk_type = 'narration' THEN text END) OVER w AS previous, lead(CASE WHEN chunk_type = 'narration' THEN text END) OVER w AS following FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
SELECT doc_id, seq, previous, following FROM l WHERE chunk_type = 'dialogue'"""
)
def prev_next_context(spark, sf_dir):
    return chunks.with_neighbours(chunks.with_sequence(script_chunks(spark, sf_dir))).where("chunk_type = 'dialogue'").select("doc_id", "seq", "previous", "following")


@query(
    r"""WITH s AS (SELECT doc_id, 'Name' || doc_id || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' : M' WHEN 2 THEN ':female:Kore' WHEN 3 THEN ':Puck' ELSE ':n: Leda ' END AS spec FROM documents),
p AS (SELECT doc_id, list_transform(string_split(spec, ':'), lambda x: trim(x)) AS p FROM s),
g AS (SELECT *, map {'male': 'male', 'female': 'female', 'neutral': 'neutral', 'unknown': 'unknown', 'm': 'male', 'f': 'female', 'n': 'neutral'}[lower(p[2])] AS g FROM p)
SELECT doc_id, p[1] AS name, coalesce(g, 'unknown') AS gender, coalesce(p[3], CASE WHEN g IS NULL THEN p[2] END) AS voice FROM g"""
)
def cast_spec_parse(spark, sf_dir):
    forms = F.array(*map(F.lit, ("", " : M", ":female:Kore", ":Puck", ":n: Leda ")))
    spec = F.concat(F.lit("Name"), F.col("doc_id").cast("string"), F.element_at(forms, (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", cast_spec.parse_spec(spec).alias("m")).select("doc_id", "m.name", "m.gender", "m.voice")


_BARE = r"list_transform(tokens, lambda w: regexp_replace(w, '[^\p{L}\p{N}_]', '', 'g'))"
_IS_TITLE = r"regexp_matches(w, '^([\p{N}_]*\p{Lu}\p{Ll}*)+[\p{N}_]*$') AND NOT regexp_matches(w, '\p{Lu}\p{Lu}|\p{Ll}\p{Lu}|[\p{N}_]\p{Ll}')"


@query(
    f"""WITH t AS (SELECT doc_id, {sql.word_list('text')} AS tokens FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, {_BARE} AS bare FROM t),
e AS (SELECT doc_id, unnest(bare) AS w, generate_subscripts(bare, 1) AS i FROM b), n AS (SELECT *, {_IS_TITLE} AND lower(w) NOT IN ({', '.join(sql.q(x) for x in fixed.STOP_WORDS)}) AS named FROM e),
p AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS next, lead(named) OVER (PARTITION BY doc_id ORDER BY i) AS next_named FROM n)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, CASE WHEN next_named THEN w || ' ' || next ELSE w END AS name FROM p WHERE named"""
)
def spoken_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(speech.names(F.col("text"))).alias("pos", "name"))


# --- signals -----------------------------------------------------------------------------------


@query(f"WITH {SIGNAL} SELECT vec_id, round(sqrt(list_sum(list_transform(samples, lambda x: x::DOUBLE * x)) / len(samples)), 6) AS rms FROM signal")
def rms(spark, sf_dir):
    return views.signal(spark, sf_dir).select("vec_id", F.round(dsp.rms(F.col("samples")), 6).alias("rms"))


_CROSS = "list_filter(range(1, len(samples)), lambda i: (samples[i] < 0) <> (samples[i + 1] < 0))"


@query(f"WITH {SIGNAL} SELECT vec_id, round(len({_CROSS}) / (len(samples) / 24000.0::DOUBLE) / 2.0, 6) AS zcr_hz FROM signal")
def zcr(spark, sf_dir):
    return views.signal(spark, sf_dir).select("vec_id", F.round(dsp.zero_crossing_rate(F.col("samples")), 6).alias("zcr_hz"))


@query(f"WITH {SIGNAL}, a AS (SELECT vec_id, len(samples) AS n, list_filter(range(0, len(samples)), lambda i: abs(samples[i + 1]) > 4000) AS loud FROM signal) SELECT vec_id, greatest(0, loud[1] - 3)::INT AS first, least(n, loud[-1] + 4)::INT AS last FROM a WHERE len(loud) > 0")
def silence_bounds(spark, sf_dir):
    b = views.signal(spark, sf_dir).select("vec_id", dsp.active_bounds(F.col("samples"), 4000, 3).alias("b")).where("b is not null")
    return b.select("vec_id", F.col("b.start").alias("first"), F.col("b.end").alias("last"))


@query(
    f"""WITH {SIGNAL}, t AS (SELECT vec_id, samples, (vec_id % 64)::INT AS tgt, len(samples) AS n FROM signal),
c AS (SELECT *, list_filter(range(greatest(0, tgt - 6), least(n - 1, tgt + 6)), lambda i: (samples[i + 1] < 0) <> (samples[i + 2] < 0)) AS cs FROM t),
b AS (SELECT *, list_sort(list_transform(cs, lambda i: [abs(i - tgt), i]))[1][2] AS best, list_sort(list_transform(range(greatest(0, tgt - 6), least(n - 1, tgt + 6) + 1), lambda i: [abs(samples[i + 1]), i]))[1][2] AS quiet FROM c)
SELECT vec_id, CASE WHEN len(cs) = 0 THEN quiet WHEN abs(samples[best + 1]) <= abs(samples[least(n - 1, best + 1) + 1]) THEN best ELSE least(n - 1, best + 1) END::INT AS snapped FROM b"""
)
def zero_crossing(spark, sf_dir):
    return views.signal(spark, sf_dir).select("vec_id", dsp.nearest_crossing(F.col("samples"), (F.col("vec_id") % 64).cast("int"), 6).alias("snapped"))


@query(
    f"""WITH {SIGNAL}, p AS (SELECT a.vec_id, a.samples AS x, b.samples AS y FROM signal a JOIN signal b ON b.vec_id = a.vec_id + 1), j AS (SELECT vec_id,
    list_concat(list_concat(x[1:48], list_transform(range(0, 16), lambda i: trunc(greatest(-32768, least(32767, x[49 + i] * cos(pi() / 2 * i / 16) + y[1 + i] * sin(pi() / 2 * i / 16))))::INT)), y[17:64]) AS z FROM p)
SELECT vec_id, len(z)::INT AS n, list_sum(z)::BIGINT AS total, list_sum(list_transform(range(0, 16), lambda i: z[49 + i] * (i + 1)))::BIGINT AS weighted FROM j"""
)
def crossfade_pair(spark, sf_dir):
    s = views.signal(spark, sf_dir)
    pairs = s.select("vec_id", F.col("samples").alias("x")).join(s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("samples").alias("y")), "vec_id")
    z = pairs.select("vec_id", dsp.crossfade(F.col("x"), F.col("y"), 16).alias("z"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, v: t + v)
    return z.select("vec_id", F.size("z").alias("n"), total(F.col("z")).alias("total"), total(F.transform(F.slice("z", 49, 16), lambda v, i: v.cast("long") * (i + 1))).alias("weighted"))


@query("WITH n AS (SELECT DISTINCT (doc_id % 40 + 1)::INT AS n FROM documents) SELECT n, round(list_sum(list_transform(range(0, n), lambda i: sin(pi() / 2 * i / n))), 6) AS rising, round(list_sum(list_transform(range(0, n), lambda i: cos(pi() / 2 * i / n))), 6) AS falling FROM n")
def gain_ramp(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40 + 1).cast("int").alias("n")).distinct()
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda t, v: t + v), 6)
    return n.select("n", total(dsp.ramp(F.col("n"), True)).alias("rising"), total(dsp.ramp(F.col("n"), False)).alias("falling"))


@query(f"WITH {SIGNAL} SELECT vec_id, i::INT AS frame, list_sum(samples[i * 8 + 1:i * 8 + 16])::BIGINT AS total FROM (SELECT vec_id, samples, unnest(range(0, least(5, (len(samples) - 16) // 8 + 1))) AS i FROM signal)")
def frames(spark, sf_dir):
    rows = views.signal(spark, sf_dir).select("vec_id", F.posexplode(dsp.frames(F.col("samples"), 16, 8, 5)).alias("frame", "f"))
    return rows.select("vec_id", "frame", F.aggregate("f", F.lit(0).cast("long"), lambda t, v: t + v).alias("total"))


@query(
    f"""WITH {SIGNAL}, s AS (SELECT vec_id, unnest(samples)::DOUBLE AS x, generate_subscripts(samples, 1) - 1 AS i FROM signal),
k AS (SELECT range AS k FROM range(1, 1025)), w AS (SELECT i, k, (0.5 - 0.5 * cos(2 * pi() * i / 2047)) * cos(2 * pi() * k * i / 2048) AS c, (0.5 - 0.5 * cos(2 * pi() * i / 2047)) * sin(2 * pi() * k * i / 2048) AS z FROM (SELECT DISTINCT i FROM s), k),
p AS (SELECT vec_id, k, sum(x * c) ** 2 + sum(x * z) ** 2 AS p FROM s JOIN w USING (i) GROUP BY vec_id, k),
f AS (SELECT vec_id, sum(p) FILTER (k BETWEEN 6 AND 341) AS band, sum(p) AS whole, max(p) FILTER (k BETWEEN 6 AND 341) AS peak FROM p GROUP BY vec_id),
m AS (SELECT vec_id, sqrt(list_sum(list_transform(samples, lambda x: x::DOUBLE * x)) / len(samples)) AS level, len({_CROSS}) / (len(samples) / 24000.0::DOUBLE) / 2.0 AS zcr, band / whole AS ratio, peak / (band / 336) AS crest FROM signal JOIN f USING (vec_id))
SELECT vec_id, level > 150 AND ratio >= 0.5 AND zcr BETWEEN 30 AND 4500 AND crest > 1.8 AS is_speech, round(level, 2) AS rms, CASE WHEN level >= 150 THEN round(zcr, 1) END AS zcr_hz,
       CASE WHEN level >= 150 THEN round(ratio, 4) END AS speech_band_ratio, CASE WHEN level >= 150 THEN round(crest, 2) END AS spectral_crest_factor, CASE WHEN level < 150 THEN 'silence_or_below_noise_floor' END AS reason FROM m"""
)
def speech_spectrum(spark, sf_dir):
    return views.signal(spark, sf_dir).select("vec_id", dsp.analyze_samples("samples", "sample_rate").alias("r")).select("vec_id", "r.*")


_LE = lambda n: f"printf('%02x%02x%02x%02x', ({n}) & 255, (({n}) >> 8) & 255, (({n}) >> 16) & 255, (({n}) >> 24) & 255)"
_PCM = "array_to_string(list_transform(samples, lambda x: printf('%02x%02x', x & 255, (x >> 8) & 255)), '')"


@query(
    f"""WITH {SIGNAL} SELECT vec_id, sha256(unhex('52494646' || {_LE('36 + 2 * len(samples)')} || '57415645666d7420' || {_LE('16')} || '01000100' || {_LE('24000')} || {_LE('48000')} || '02001000' || '64617461' || {_LE('2 * len(samples)')} || {_PCM})) AS wav,
    24000 AS rate, sha256(unhex({_PCM})) AS pcm, len(samples) / 24000.0::DOUBLE AS seconds FROM signal"""
)
def wav_round_trip(spark, sf_dir):
    """Signals as WAV files, read back."""
    files = views.signal(spark, sf_dir).select("vec_id", dsp.encode_wav(dsp.pcm_of(F.col("samples")), F.col("sample_rate")).alias("wav"))
    read = files.select("vec_id", F.sha2("wav", 256).alias("wav"), dsp.decode_wav("wav").alias("w")).select("vec_id", "wav", "w.rate", "w.pcm")
    return audio.durations(read).withColumn("pcm", F.sha2("pcm", 256))


@query("SELECT doc_id, trunc(doc_id % 90 / 1000.0::DOUBLE * 24000)::INT AS n, 0::BIGINT AS total FROM documents")
def silence(spark, sf_dir):
    quiet = dsp.silence(F.col("doc_id") % 90)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(quiet).alias("n"), F.aggregate(quiet, F.lit(0).cast("long"), lambda t, x: t + x).alias("total"))


@query("SELECT page_id, 'data:' || CASE page_id % 3 WHEN 0 THEN 'audio/mpeg' WHEN 1 THEN 'audio/mp4' ELSE 'audio/wav' END || ';base64,' || base64(encode(coalesce(html, ''))) AS uri FROM pages")
def data_uri(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("a.mp3", "b/c.m4b", "d"))), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", sinks.data_uri(F.coalesce("html", F.lit("")).cast("binary"), name).alias("uri"))


# --- synthesis ---------------------------------------------------------------------------------


def delivered(spark, sf_dir):
    """Chunks of the script with delivery, without attribution."""
    rows = script_chunks(spark, sf_dir).withColumns({"character": F.lit(None).cast("string"), "gender": F.lit("unknown")})
    return prosody.apply(rows, prosody.Profile())


@query(f"{sql.chunked('script')}, n AS (SELECT *, {sql.normalize('text')} AS t FROM chunks) SELECT doc_id, chapter_index, chunk_index, greatest(240, trunc(greatest(1, {sql.word_count('t')})::DOUBLE / 3.2::DOUBLE * 24000)::BIGINT)::INT AS n_samples FROM n")
def mock_duration(spark, sf_dir):
    return delivered(spark, sf_dir).select("doc_id", "chapter_index", "chunk_index", synthesis.mock_samples(T.word_count(F.col("text"))).alias("n_samples"))


_DELIVERED = f"""{sql.chunked('script')}, d AS (SELECT doc_id, chapter_index, chunk_index, chunk_type, {sql.normalize('text')} AS text, 'en-US-ChristopherNeural' AS voice,
    CASE chunk_type WHEN 'heading' THEN '-4%' WHEN 'dialogue' THEN '+2%' ELSE '+0%' END AS rate, CASE chunk_type WHEN 'heading' THEN '-1Hz' ELSE '+0Hz' END AS pitch FROM chunks),
keyed AS (SELECT *, sha256(voice || chr(31) || chr(31) || chunk_type || chr(31) || text || chr(31) || rate || chr(31) || pitch || chr(31) || 'MockEngine') AS key FROM d)"""


@query(f"{_DELIVERED} SELECT doc_id, chapter_index, chunk_index, left(sha256(voice || ':' || text || ':' || rate || ':' || pitch || ':MockEngine'), 16) AS content_key, key FROM keyed")
def synth_keys(spark, sf_dir):
    return delivered(spark, sf_dir).select("doc_id", "chapter_index", "chunk_index", synthesis.content_key("MockEngine").alias("content_key"), synthesis.cache_key("MockEngine").alias("key"))


@query(f"{_DELIVERED} SELECT key, count(*) AS uses FROM keyed WHERE text <> '' GROUP BY key")
def synth_dedupe(spark, sf_dir):
    return delivered(spark, sf_dir).where(~synthesis.is_silent()).withColumn("key", synthesis.cache_key("MockEngine")).groupBy("key").agg(F.count("*").alias("uses"))


@query(f"{_DELIVERED} SELECT DISTINCT key FROM keyed WHERE text <> '' AND key NOT IN (SELECT key FROM keyed WHERE doc_id % 2 = 0)")
def cache_anti(spark, sf_dir):
    work = delivered(spark, sf_dir).where(~synthesis.is_silent()).select("doc_id", synthesis.cache_key("MockEngine").alias("key"))
    cache = work.select("key", F.when(F.col("doc_id") % 2 == 0, F.lit(b"\0\0")).otherwise(F.lit(b"")).alias("pcm"))  # an empty sound is no sound
    return synthesis.missing(work, cache).select("key").distinct()


@query(f"{_DELIVERED} SELECT DISTINCT key, greatest(240, trunc(greatest(1, {sql.word_count('text')})::DOUBLE / 3.2::DOUBLE * 24000)::BIGINT) AS n_samples, NULL::VARCHAR AS error FROM keyed WHERE text <> ''")
def synthesized_audio(spark, sf_dir):
    sounds = synthesis.measure(delivered(spark, sf_dir), engines.engine("mock"))
    return sounds.select("key", F.col("n_spoken").cast("long").alias("n_samples"), "error")


# --- timelines ---------------------------------------------------------------------------------


def placed(spark, sf_dir):
    """The script on a timeline, with the synthetic engine's lengths before trimming."""
    rows = chunks.with_sequence(delivered(spark, sf_dir))
    return timeline.place(rows.withColumn("n_samples", F.when(synthesis.is_silent(), 0).otherwise(synthesis.mock_samples(T.word_count(F.col("text"))))))


def marks(spark, sf_dir):
    return timeline.chapter_marks(placed(spark, sf_dir), chapters.split_chapters(views.script(spark, sf_dir)))


@query(f"{sql.chunked('script')},{sql.PLACED} SELECT doc_id, seq, start AS start_sample, fin AS end_sample FROM placed")
def timeline_offsets(spark, sf_dir):
    return placed(spark, sf_dir).select("doc_id", "seq", F.col("start").alias("start_sample"), F.col("end").alias("end_sample"))


@query(f"{sql.chunked('script')},{sql.PLACED} SELECT * FROM marks")
def chapter_marks(spark, sf_dir):
    return marks(spark, sf_dir)


@query(f"{sql.chunked('script')},{sql.PLACED}, t AS (SELECT conv_id AS doc_id, turn * 20000 AS t_ms FROM conversations) SELECT t.doc_id, t_ms, ord, title FROM t JOIN marks m ON m.doc_id = t.doc_id AND t_ms >= start_ms AND (t_ms < end_ms OR end_ms = 0)")
def chapter_at_time(spark, sf_dir):
    times = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 20000).alias("t_ms"))
    return timeline.chapter_at(marks(spark, sf_dir), times).select("doc_id", "t_ms", "ord", "title")


_HEAD = "';FFMETADATA1' || chr(10) || 'title=T' || doc_id || chr(10) || 'artist=A' || chr(10) || 'album_artist=A' || chr(10) || 'album=T' || doc_id || chr(10) || 'genre=Audiobook' || chr(10)"


@query(
    f"""{sql.chunked('script')},{sql.PLACED} SELECT doc_id, {_HEAD} || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || start_ms || chr(10) || 'END=' || end_ms || chr(10) || 'title=' || title || chr(10), '' ORDER BY ord) AS metadata
FROM marks GROUP BY doc_id"""
)
def ffmetadata(spark, sf_dir):
    documents = views.script(spark, sf_dir).select("doc_id", F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.lit("A").alias("author"))
    return sinks.ffmetadata(marks(spark, sf_dir), documents)


@query(
    f"""{sql.chunked('script')},{sql.PLACED} SELECT doc_id, '[' || string_agg('{{"title":"' || title || '","start_sec":' || (start_ms / 1000.0::DOUBLE) || ',"end_sec":' || (end_ms / 1000.0::DOUBLE) || ',"chapter_index":' || chapter_index || '}}', ',' ORDER BY ord) || ']' AS chapters
FROM marks GROUP BY doc_id"""
)
def player_chapters_json(spark, sf_dir):
    return sinks.player_chapters(marks(spark, sf_dir))


_SOME_MISSING = sql.PLACED.replace("trunc(greatest(1,", "CASE WHEN seq % 5 = 3 THEN NULL ELSE 1 END * trunc(greatest(1,").replace(
    "sized AS (SELECT *, CASE WHEN chunk_type", "sized AS (SELECT *, CASE WHEN seq % 5 = 3 THEN NULL WHEN seq % 7 = 2 THEN 0 WHEN chunk_type"
).replace("measured AS (SELECT *, CASE WHEN n = 0 THEN 0", "measured AS (SELECT *, CASE WHEN n IS NULL THEN trunc(greatest(300, pause_after_ms) / 1000.0::DOUBLE * 24000)::BIGINT WHEN n = 0 THEN 0").replace("sum(n) OVER", "sum(coalesce(n, 1)) OVER")


@query(f"{sql.chunked('script')},{_SOME_MISSING} SELECT doc_id, seq, start AS start_sample, fin AS end_sample FROM placed")
def timeline_missing(spark, sf_dir):
    """Offsets where some sounds are missing and some are empty after trimming."""
    rows = chunks.with_sequence(delivered(spark, sf_dir))
    n = F.when(F.col("seq") % 5 == 3, None).when((F.col("seq") % 7 == 2) | synthesis.is_silent(), 0).otherwise(synthesis.mock_samples(T.word_count(F.col("text"))))
    return timeline.place(rows.withColumn("n_samples", n)).select("doc_id", "seq", F.col("start").alias("start_sample"), F.col("end").alias("end_sample"))


# --- pages -------------------------------------------------------------------------------------


def _entities(x: str) -> str:
    for name, char in html.ENTITIES:
        x = f"replace({x}, '{name}', {sql.q(char)})"
    return x


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_PLAIN = "regexp_replace(html, '<[^>]+>', ' ', 'g')"


@query(f"SELECT page_id, coalesce(nullif({sql.strip(_entities(_TITLE))}, ''), 'Web Article') AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, {_PLAIN} AS text, {sql.word_count(_PLAIN)}::INT AS words FROM pages")
def html_strip(spark, sf_dir):
    text = html.strip_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"), T.word_count(text).alias("words"))


_DROP = "html"
for _tag in fixed.DROPPED_TAGS:
    _DROP = rf"regexp_replace({_DROP}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', '', 'g')"
_DROP = f"regexp_replace({_DROP}, '(?s)<!--.*?-->', '', 'g')"
_ANY = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in fixed.TEXT_TAGS)
_BLOCKS = rf"""WITH b AS (SELECT page_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS k FROM (SELECT page_id, regexp_extract_all({_DROP}, '(?is){_ANY}') AS bs FROM pages)),
t AS (SELECT page_id, k, lower(regexp_extract(b, '(?is)^<(h[1-4]|p|blockquote)', 1)) AS tag, {sql.strip(_entities("regexp_replace(b, '<[^>]+>', '', 'g')"))} AS text, regexp_matches(b, '(?i)<b\b') AS bold FROM b),
blocks AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INT AS pos, tag, text, bold FROM t WHERE text <> '')"""


@query(f"{_BLOCKS} SELECT * FROM blocks")
def html_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.blocks(F.col("html"))).alias("pos", "b"))
    return rows.select("page_id", "pos", "b.tag", "b.text", "b.bold")


@query(f"{_BLOCKS} SELECT page_id, pos, CASE WHEN regexp_matches(tag, '^h[1-4]$') OR (tag = 'p' AND bold AND {sql.word_count('text')} <= 10) THEN '# ' || text ELSE text END AS line FROM blocks")
def html_bold_headings(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.blocks(F.col("html"))).alias("pos", "b"))
    return rows.select("page_id", "pos", html.block_line(F.col("b")).alias("line"))


@query(f"{_BLOCKS} SELECT page_id, sum({sql.word_count('text')})::BIGINT AS words, count(*) AS blocks FROM blocks WHERE tag = 'p' GROUP BY page_id")
def page_words(spark, sf_dir):
    words, n = html.paragraph_words(F.col("b"))
    return table(spark, sf_dir, "pages").select("page_id", html.blocks(F.col("html")).alias("b")).select("page_id", words.alias("words"), n.alias("blocks")).where("blocks > 0")


@query()
def html_prose(spark, sf_dir):
    return manuscripts.from_pages(views.spread(table(spark, sf_dir, "pages"))).select("doc_id", "title", "author", "source_type", "raw_text")


_META = "CASE WHEN page_id % 2 = 0 THEN '<META content=\"  A' || page_id || ' &amp; Co \" NAME=\"the-Author\"/>' ELSE '<meta name=\"viewport\" content=\"x\">' END"


@query(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'A' || page_id || ' & Co' ELSE 'Unknown Author' END AS author FROM pages")
def page_author(spark, sf_dir):
    meta = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<META content="  A'), F.col("page_id").cast("string"), F.lit(' &amp; Co " NAME="the-Author"/>'))).otherwise('<meta name="viewport" content="x">')
    return table(spark, sf_dir, "pages").select("page_id", html.page_author(F.concat(meta, F.coalesce("html", F.lit("")))).alias("author"))


_BY = f"regexp_extract('<p>' || CASE WHEN page_id % 3 = 0 THEN 'Story ' || page_id || ' -- a novelette by J. Doe-' || page_id || '</p>' ELSE '' END || coalesce(html, ''), '(?i){fixed.BYLINE.replace(chr(39), chr(39) * 2)}', GROUP)"


@query(f"WITH b AS (SELECT page_id, {sql.strip(_BY.replace('GROUP', '1'))} AS t, {sql.strip(_BY.replace('GROUP', '2'))} AS a FROM pages) SELECT page_id, CASE WHEN t <> '' AND page_id % 2 <> 0 THEN t ELSE CASE WHEN page_id % 2 = 0 THEN 'Infinity plus' ELSE 'Web Article' END END AS title, CASE WHEN a <> '' THEN a ELSE 'Unknown Author' END AS author FROM b")
def byline(spark, sf_dir):
    line = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Story "), F.col("page_id").cast("string"), F.lit(" -- a novelette by J. Doe-"), F.col("page_id").cast("string"), F.lit("</p>"))).otherwise("")
    title, author = html.byline(F.concat(F.lit("<p>"), line, F.coalesce("html", F.lit(""))), F.when(F.col("page_id") % 2 == 0, "Infinity plus").otherwise(html.TITLE), F.lit(html.AUTHOR))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), author.alias("author"))


# --- small functions ---------------------------------------------------------------------------


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}]', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM documents WHERE text IS NOT NULL")
def slug_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("SELECT doc_id, 'Some Book ' || doc_id || '.Final' AS title FROM documents")
def file_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.file_title(F.concat(F.lit("/in.d/some_BOOK_"), F.col("doc_id").cast("string"), F.lit(".final.TXT"))).alias("title"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'My: Tale ' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN 'Jo' END AS author, CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END || coalesce(text, '') AS body FROM documents")
def front_matter(spark, sf_dir):
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('---\nTitle: "My: Tale '), F.col("doc_id").cast("string"), F.lit("\"\r\nauthor : 'No'\nskipped\nAuthor:  'Jo'\n---\n"))).otherwise("")
    meta, body = manuscripts.front_matter(F.col("t"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", meta["title"].alias("title"), meta["author"].alias("author"), body.alias("body"))


@query(
    "WITH s AS (SELECT event_id, floor(CASE WHEN value * 40 - 100 >= 0 THEN value * 40 - 100 ELSE 0 END)::BIGINT AS s FROM events) SELECT event_id, CASE WHEN s // 60 < 10 THEN '0' ELSE '' END || (s // 60) || ':' || CASE WHEN s % 60 < 10 THEN '0' ELSE '' END || (s % 60) AS clock FROM s"
)
def mmss(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.mmss(F.col("value") * 40 - 100).alias("clock"))


@query("WITH p AS (SELECT doc_id, 'out/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.m4b' WHEN 2 THEN '.wav' ELSE '' END AS path FROM documents) SELECT doc_id, CASE WHEN path LIKE '%.mp3' THEN 'audio/mpeg' WHEN path LIKE '%.m4b' THEN 'audio/mp4' ELSE 'audio/wav' END AS mime FROM p")
def mime(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, (".mp3", ".m4b", ".wav", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.mime_type(F.concat(F.lit("out/"), F.col("doc_id").cast("string"), ext)).alias("mime"))


# --- jobs --------------------------------------------------------------------------------------

_LATEST = f"WITH {JOB_EVENTS}, latest AS (SELECT * FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1)"


@query(f"{_LATEST} SELECT job_id, ts, event_id, state, value FROM latest")
def job_latest(spark, sf_dir):
    return jobs.latest(views.job_events(spark, sf_dir)).select("job_id", "ts", "event_id", "state", "value")


def _drain(stream) -> None:
    """Runs a stream over what is there."""
    stream.trigger(availableNow=True).start().awaitTermination()


@query(f"{_LATEST} SELECT job_id, ts, event_id, state, value FROM latest")
def job_stream(spark, sf_dir):
    """The latest states, folded from a stream of the events."""
    folder = views.scratch(spark, "jobs")
    events = table(spark, sf_dir, "events")
    events.repartition(2).write.parquet(f"{folder}/in")
    changes = views.job_events(spark, sf_dir, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    _drain(changes.writeStream.foreachBatch(job_streams.upsert(f"{folder}/jobs")).option("checkpointLocation", f"{folder}/offsets"))
    return job_streams.newest(spark, f"{folder}/jobs").select("job_id", "ts", "event_id", "state", "value")


@query(f"{_LATEST} SELECT job_id, event_id, state FROM latest WHERE state IN ('INITIALIZING', 'SYNTHESIZING') ORDER BY ts DESC, event_id DESC LIMIT 1")
def job_active(spark, sf_dir):
    return jobs.latest_active(jobs.latest(views.job_events(spark, sf_dir))).select("job_id", "event_id", "state")


@query(f"{_LATEST} SELECT job_id, CASE WHEN state IN ('INITIALIZING', 'SYNTHESIZING') THEN 'ERROR' ELSE state END AS state, CASE WHEN state IN ('INITIALIZING', 'SYNTHESIZING') THEN '{jobs.INTERRUPTED}' END AS error FROM latest")
def job_recover(spark, sf_dir):
    return jobs.recover(jobs.latest(views.job_events(spark, sf_dir))).select("job_id", "state", "error")


@query(f"WITH {JOB_EVENTS} SELECT job_id, count(*) FILTER (state = 'COMPLETE') AS done, count(*) AS total, round(count(*) FILTER (state = 'COMPLETE') / greatest(1, count(*))::DOUBLE * 100, 1) AS percent FROM job_events GROUP BY job_id")
def job_progress(spark, sf_dir):
    return jobs.progress(views.job_events(spark, sf_dir))


@query(f"""{_LATEST}, w AS (SELECT DISTINCT user_id + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 100000000 END AS job_id FROM events)
SELECT w.job_id, event_id, coalesce(state, 'NOT_FOUND') AS state FROM w LEFT JOIN latest USING (job_id)""")
def job_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "events").select((F.col("user_id") + F.when(F.col("event_id") % 2 == 0, 0).otherwise(100_000_000)).alias("job_id"))
    return jobs.find(jobs.latest(views.job_events(spark, sf_dir)), wanted).select("job_id", "event_id", "state")


@query(f"""{_LATEST} SELECT job_id, '{{"job_id":' || job_id || ',"event_id":' || event_id || ',"state":"' || state || '"}}' AS response FROM latest""")
def job_status(spark, sf_dir):
    return jobs.status_json(jobs.latest(views.job_events(spark, sf_dir)), "event_id", "state")


# --- the whole ---------------------------------------------------------------------------------


@query()
def rendered_marks(spark, sf_dir):
    """Scripts attributed, cast, spoken by the synthetic engine, trimmed, crossfaded and marked."""
    documents = manuscripts.from_table(views.script(spark, sf_dir), "doc_id", "raw_text")
    return Pipeline(Config(backend="mock")).time(documents).marks


_ANALYSED = f"{sql.chunked('script')},{sql.PLACED},{sql.SPEAKERS}"


@query(
    f"""{sql.chunked('script')},{sql.SPEAKERS}, v AS (SELECT doc_id, name, {sql.pool('gemini')} AS voice FROM ranked)
SELECT n.doc_id, n.seq, n.chunk_type, s.character, coalesce(v.voice, 'Fenrir') AS voice, CASE n.chunk_type WHEN 'heading' THEN '-4%' WHEN 'dialogue' THEN '+2%' ELSE '+0%' END AS ssml_rate,
       CASE WHEN n.chunk_type = 'heading' THEN '-1Hz' WHEN n.chunk_type = 'dialogue' AND s.gender = 'female' THEN '+1Hz' ELSE '+0Hz' END AS ssml_pitch
FROM numbered n LEFT JOIN spoken_by s ON s.doc_id = n.doc_id AND s.seq = n.seq LEFT JOIN v ON v.doc_id = n.doc_id AND v.name = s.character"""
)
def delivered_voices(spark, sf_dir):
    """Every chunk as it is delivered: its speaker, the voice of the cast, rate and pitch."""
    documents = manuscripts.from_table(views.script(spark, sf_dir), "doc_id", "raw_text")
    return Pipeline(Config(backend="gemini", voice="Fenrir")).analyse(documents).delivered.select("doc_id", "seq", "chunk_type", "character", "voice", "ssml_rate", "ssml_pitch")


@query(
    f"""{_ANALYSED}, c AS (SELECT doc_id, count(*) AS characters, sum(line_count)::BIGINT AS lines FROM profiles GROUP BY doc_id)
SELECT m.doc_id, ord, chapter_index, title, start_ms, end_ms, characters, lines, 3 + coalesce(characters, 0) AS roles FROM marks m LEFT JOIN c ON c.doc_id = m.doc_id"""
)
def flagship(spark, sf_dir):
    """Scripts attributed and cast, with the chapter timeline of synthetic durations."""
    documents = manuscripts.from_table(views.script(spark, sf_dir), "doc_id", "raw_text")
    r = Pipeline(Config(backend="gemini", voice="Fenrir")).analyse(documents)
    sized = r.delivered.withColumn("n_samples", F.when(synthesis.is_silent(), 0).otherwise(synthesis.mock_samples(T.word_count(F.col("text")))))
    timed = timeline.chapter_marks(timeline.place(sized), r.chapters)
    voices = r.voice_map.groupBy("doc_id").agg(F.count("*").alias("roles"))
    lines = r.characters.groupBy("doc_id").agg(F.count("*").alias("characters"), F.sum("line_count").alias("lines"))
    return timed.join(lines, "doc_id", "left").join(voices, "doc_id", "left")
