"""From manuscripts to timelines: the stages composed. Attribution is run when planned and kept; all else waits for an action."""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream import fixed
from inkstream.functions import text as T
from inkstream.functions.dsp import to_wav
from inkstream.operators import attribution, casting, chapters, chunks, prosody, sinks, synthesis, timeline
from inkstream.operators.cast_spec import Member, read_cast
from inkstream.operators.engines import engine
from inkstream.sources import manuscripts


@dataclass(frozen=True)
class Config:
    """Options of a run.

    ``pacing_speed`` and ``pacing_pauses`` let the pacing preset's speed and pauses count (it has
    no effect otherwise); ``break_pauses`` lets section breaks keep their pause on the timeline.
    """

    backend: str = "edge"
    voice: str = "en-US-ChristopherNeural"
    dialogue_voice: str | None = None
    characters: Any = None
    cast: Any = None
    pacing_mode: str = "normal"
    pacing_speed: bool = False
    pacing_pauses: bool = False
    break_pauses: bool = False
    speed: float = 1.0
    audio_format: str = "m4b"
    crossfade_ms: int = 35
    audition: bool = False
    audition_words: int = 1200
    synthesis_partitions: int | None = None
    engine_options: dict = field(default_factory=dict)
    generate_player: bool = True
    normalize_loudness: bool = True
    open_listed_casts: bool = False

    def members(self) -> list[Member]:
        return read_cast(self.characters or self.cast, self.open_listed_casts)

    def effective_speed(self) -> float:
        preset = fixed.PACING.get(self.pacing_mode, fixed.PACING["normal"])["speed_multiplier"]
        return preset if self.pacing_speed and self.speed == 1.0 else self.speed


@dataclass
class Result:
    """Relations of a run."""

    documents: DataFrame
    chapters: DataFrame
    chunks: DataFrame
    attributed: DataFrame
    characters: DataFrame
    edges: DataFrame
    voice_map: DataFrame
    delivered: DataFrame
    audio: DataFrame | None = None
    placed: DataFrame | None = None
    marks: DataFrame | None = None


def settle(df: DataFrame) -> DataFrame:
    """The rows written to the cluster's checkpoint folder, where one is set: later branches read them instead of folding again."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


class Pipeline:
    """Plans the stages over any number of manuscripts."""

    def __init__(self, config: Config | None = None) -> None:
        self.config = config or Config()

    def analyse(self, documents: DataFrame) -> Result:
        """Everything before synthesis."""
        c = self.config
        parts = chapters.split_chapters(documents)
        if c.audition:
            parts = chapters.audition_excerpt(parts, c.audition_words)
        cut = chunks.with_sequence(chunks.chunk_chapters(parts, pauses=chunks.Pauses.of_pacing(c.pacing_mode) if c.pacing_pauses else chunks.Pauses()))
        attributed = settle(attribution.attribute(cut, c.members()))
        people = attribution.characters(attributed, c.members())
        voices = casting.cast_voices(people, c.backend, c.voice, documents=documents)
        roles = voices.select("doc_id", F.col("role").alias("character"), F.col("voice").alias("cast_voice"))
        joined = attributed.join(roles, ["doc_id", "character"], "left")
        wanted = F.coalesce(F.nullif(F.lit(c.dialogue_voice), F.lit("")), prosody.present(F.col("cast_voice")), F.lit(c.voice))
        delivered = prosody.apply(joined, prosody.Profile(primary=c.voice), c.effective_speed(), wanted).drop("cast_voice")
        edges = attribution.interactions(attribution.spoken_lines(attributed))
        return Result(documents, parts, cut, attributed, people, edges, voices, delivered)

    def speak(self, r: Result, cache: DataFrame | None = None, done: Accumulator | None = None) -> DataFrame:
        """What the cache lacks."""
        return synthesis.speak(r.delivered, engine(self.config.backend, **self.config.engine_options), cache, self.config.synthesis_partitions, done)

    def place(self, r: Result, audio: DataFrame) -> Result:
        """With timeline and marks. Offsets need lengths only, so audio stays where it is."""
        c = self.config
        r.audio = audio
        r.placed = timeline.place(synthesis.with_lengths(r.delivered, engine(c.backend, **c.engine_options), audio), c.crossfade_ms, c.break_pauses)
        r.marks = timeline.chapter_marks(r.placed, r.chapters)
        return r

    def render(self, documents: DataFrame, cache: DataFrame | None = None) -> Result:
        """With audio: what the cache lacks is spoken and placed on the timeline."""
        r = self.analyse(documents)
        fresh = self.speak(r, cache)
        return self.place(r, fresh if cache is None else cache.unionByName(fresh))

    def time(self, documents: DataFrame) -> Result:
        """As ``render`` where only times are wanted: all is spoken and placed, but workers hand on the lengths of sounds, not the audio."""
        c, r = self.config, self.analyse(documents)
        r = self.place(r, synthesis.measure(r.delivered, engine(c.backend, **c.engine_options), c.synthesis_partitions))
        r.audio = None
        return r

    def assemble(self, r: Result) -> tuple[np.ndarray, int]:
        """The signal of a rendered document, on the driver, and its number of chunks."""
        sounding = synthesis.with_audio(r.delivered, engine(self.config.backend, **self.config.engine_options), r.audio)
        rows = sounding.orderBy("seq").select("pcm", "pause_after_ms").collect()
        return timeline.assemble([None if x.pcm is None else bytes(x.pcm) for x in rows], [x.pause_after_ms for x in rows], self.config.crossfade_ms, keep_pauses=self.config.break_pauses), len(rows)

    def run(self, spark: SparkSession, target: str, output_path: str | None = None, cache_path: str | None = None, progress: Callable[[int, int, str], None] | None = None) -> dict:
        """One manuscript to files: audio, player, and a report. Only this document's audio reaches the driver.

        Sounds are made once: into the cache, or a table in the checkpoint folder, or the executors' memory and disk. ``progress`` hears (done, total, first words of the last one done) of the chunks, as tasks of the synthesis finish.
        """
        documents = manuscripts.route(spark, target)
        r = self.analyse(documents)
        cache = spark.read.schema(synthesis.AUDIO).parquet(cache_path) if cache_path and manuscripts.exists(spark, cache_path) else None
        done = spark.sparkContext.accumulator(0)
        fresh = self.speak(r, cache, done)
        folder = spark.sparkContext.getCheckpointDir()
        path = cache_path or (f"{folder}/audio-{uuid.uuid4().hex}" if folder else None)
        sounds = fresh if path else fresh.persist()  # without a folder that all share, executors keep what they made
        work = (lambda: fresh.write.mode("append").parquet(path)) if path else sounds.count
        if progress:
            keys = r.delivered.where(~synthesis.is_silent()).select(synthesis.cache_key(engine(self.config.backend, **self.config.engine_options).name).alias("key")).distinct()
            told = [x.t for x in r.delivered.orderBy("seq").select(F.left("text", F.lit(40)).alias("t")).collect()]
            pending = (keys if cache is None else synthesis.missing(keys, cache)).count()

            def look() -> None:
                k = len(told) - pending + min(done.value, pending) if done.value or not pending else 0
                progress(k, len(told), told[max(0, k - 1)] if told else "")

            watched(work, look)
        else:
            work()
        return self._finish(spark, documents, self.place(r, spark.read.schema(synthesis.AUDIO).parquet(path) if path else sounds), output_path)

    def _finish(self, spark: SparkSession, documents: DataFrame, r: Result, output_path: str | None) -> dict:
        doc = documents.select("doc_id", "title", "author", T.slug(F.col("title")).alias("slug")).first()
        signal, n_chunks = self.assemble(r)
        marks = [m.asDict() for m in r.marks.orderBy("ord").collect()]
        path = output_path or f"{doc.slug}.{self.config.audio_format}"
        meta = sinks.ffmetadata(r.marks, documents).first()
        audio = sinks.export(signal, path, doc.title, doc.author, meta.metadata if meta else None, None if output_path else self.config.audio_format, self.config.normalize_loudness)
        player = None
        if self.config.generate_player:
            player = sinks.write_player(f"{os.path.splitext(path)[0]}_player.html", doc.title, doc.author, os.path.basename(audio), marks)
        return {"audio_path": audio, "player_path": player, "duration_seconds": len(signal) / fixed.SAMPLE_RATE, "total_chunks": n_chunks, "marks": marks, "result": r}


def watched(work: Callable[[], None], look: Callable[[], None], seconds: float = 0.2) -> None:
    """Runs work on another thread and looks at it before, until it is done, and then; its errors are raised here."""
    look()
    with ThreadPoolExecutor(1) as pool:
        running = pool.submit(work)
        while not wait([running], timeout=seconds).done:
            look()
        running.result()
    look()


def inspect(chapter_rows: DataFrame) -> DataFrame:
    """Titles and words by chapter."""
    return chapter_rows.select("doc_id", "chapter_index", "title", "word_count")


def preview(spark: SparkSession, payload: dict, words: int = 150) -> dict:
    """A short excerpt of a request's text, spoken, as a data URI with its characters and voices."""
    documents = manuscripts.from_payload(spark, payload)
    config = Config(backend=payload.get("backend", "mock"), voice=payload.get("voice") or "en-US-ChristopherNeural", dialogue_voice=payload.get("dialogue_voice"), characters=payload.get("characters") or payload.get("cast"), speed=float(payload.get("speed", 1.0)), audition=True, audition_words=words)
    p = Pipeline(config)
    first = chunks.chunk_chapters(chapters.split_chapters(documents)).limit(2).collect()
    text = documents.first().raw_text or ""
    if len(first) == 1 and first[0].chunk_type == chunks.NARRATION and not text.startswith("#"):  # one chunk needs no cast
        rate = prosody.signed_rate("narration", config.speed)
        sound = engine(config.backend, **config.engine_options).speak({**first[0].asDict(), "character": config.voice, "voice": config.voice, "ssml_rate": rate, "ssml_pitch": "+0Hz"})
        return {"audio": "data:audio/wav;base64," + base64.b64encode(to_wav(sound)).decode(), "characters": [], "voice_map": {}, "total_chunks": 1}
    r = p.render(documents)
    signal, n_chunks = p.assemble(r)
    people = [c.asDict() for c in r.characters.orderBy("name").collect()]
    return {"audio": "data:audio/wav;base64," + base64.b64encode(to_wav(signal)).decode(), "characters": people, "voice_map": {v.role: v.voice for v in r.voice_map.collect()}, "total_chunks": n_chunks}
