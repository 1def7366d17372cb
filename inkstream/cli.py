"""Command line over the pipeline."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkstream import fixed
from inkstream.operators import chapters
from inkstream.plans.pipeline import Config, Pipeline
from inkstream.sources import manuscripts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkstream", description="Manuscripts to spoken, cast and timed audio on Spark.")
    p.add_argument("input", help="a file, a web address or the text itself")
    p.add_argument("-o", "--output")
    p.add_argument("--backend", default="edge")
    p.add_argument("--voice", default="en-US-ChristopherNeural")
    p.add_argument("--dialogue-voice")
    p.add_argument("--model", help="model of a network backend")
    p.add_argument("--character", action="append", default=[], help="Name:gender:voice, repeatable")
    p.add_argument("--cast", help="JSON, a JSON file or specs between commas")
    p.add_argument("--pacing", default="normal", choices=sorted(fixed.PACING))
    p.add_argument("--speed", type=float, default=1.0)
    p.add_argument("--format", default="m4b", choices=["m4b", "mp3", "wav", "aac"])
    p.add_argument("--crossfade", type=int, default=35)
    p.add_argument("--workers", type=int, default=4)
    p.add_argument("--cache")
    p.add_argument("--audition", action="store_true")
    p.add_argument("--no-player", action="store_true")
    p.add_argument("--no-normalize", action="store_true")
    p.add_argument("--dry-run", action="store_true", help="report chapters, characters and voices only")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    cast = [*a.character, *([a.cast] if a.cast else [])] or None
    config = Config(
        backend=a.backend, voice=a.voice, dialogue_voice=a.dialogue_voice, characters=cast, pacing_mode=a.pacing, speed=a.speed, audio_format=a.format, crossfade_ms=a.crossfade, audition=a.audition,
        engine_options={"model": a.model} if a.model else {}, synthesis_partitions=a.workers, generate_player=not a.no_player, normalize_loudness=not a.no_normalize,
    )
    spark = SparkSession.builder.appName("inkstream").getOrCreate()
    try:
        if a.dry_run:
            documents = manuscripts.route(spark, a.input)
            r = Pipeline(config).analyse(documents)
            documents.select("title", "author", "source_type").show(truncate=False)
            chapters.totals(r.chapters).show()
            r.chapters.select("chapter_index", "title", "word_count").orderBy("chapter_index").show(1000, truncate=False)
            r.characters.join(r.voice_map.withColumnRenamed("role", "name"), ["doc_id", "name"], "left").select("name", "gender", "line_count", "voice").orderBy(F.desc("line_count"), "name").show(1000, truncate=False)
            return 0
        done = Pipeline(config).run(spark, a.input, a.output, a.cache)
        print(f"{done['audio_path']}: {done['duration_seconds']:.1f} s, {done['total_chunks']} chunks, {len(done['marks'])} chapters")
        return 0
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
