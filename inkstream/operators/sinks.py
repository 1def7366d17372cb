"""Sinks: WAV files, chapter metadata, the HTML player, data URIs, and a router over formats."""

from __future__ import annotations

import html
import json
import os
import shutil
import subprocess
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.fixed import SAMPLE_RATE
from inkstream.functions.dsp import from_wav, speech_report, to_wav
from inkstream.functions.text import mime_type
from inkstream.operators.engines import EngineError, decoded

FORMATS = {".m4b": "m4b", ".mp3": "mp3", ".wav": "wav"}
LOUDNESS = "loudnorm=I=-16:TP=-1.5:LRA=11"


def write_wav(samples: np.ndarray, path: str, rate: int = SAMPLE_RATE) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "wb") as f:
        f.write(to_wav(samples, rate))
    return path


def ffmetadata(marks: DataFrame, documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, metadata``: the chapter track of each document as text; values are written as they are."""
    line = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), F.col("title"), F.lit("\n"))
    tracks = marks.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "").alias("chapters"))
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), F.col("title"), F.lit("\nartist="), F.col("author"), F.lit("\nalbum_artist="), F.col("author"), F.lit("\nalbum="), F.col("title"), F.lit("\ngenre=Audiobook\n"))
    return documents.select(id_col, "title", "author").join(tracks, id_col, "left").select(id_col, F.concat(head, F.coalesce("chapters", F.lit(""))).alias("metadata"))


def player_chapters(marks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, chapters``: JSON of title, start and end in seconds, and index."""
    item = F.struct("ord", "title", (F.col("start_ms") / 1000.0).alias("start_sec"), (F.col("end_ms") / 1000.0).alias("end_sec"), "chapter_index")
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["title"].alias("title"), x["start_sec"].alias("start_sec"), x["end_sec"].alias("end_sec"), x["chapter_index"].alias("chapter_index")))
    return marks.groupBy(id_col).agg(F.to_json(ordered).alias("chapters"))


def data_uri(data: Column, path: Column) -> Column:
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), F.replace(F.base64(data), F.lit("\r\n"), F.lit("")))


PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font-family:sans-serif;max-width:40rem;margin:2rem auto}}li{{cursor:pointer}}li.now{{font-weight:bold}}</style></head>
<body><h1>{title}</h1><p>{author}</p><audio id="a" controls src="{audio}"></audio><ol id="c"></ol>
<script>
const marks = {chapters};
const audio = document.getElementById("a"), list = document.getElementById("c");
const clock = s => (s >= 0 ? [s / 60, s % 60] : [0, 0]).map(x => String(Math.floor(x)).padStart(2, "0")).join(":");
for (const m of marks) {{
  const li = list.appendChild(document.createElement("li"));
  li.textContent = m.title + " " + clock(m.start_sec);
  li.onclick = () => {{ audio.currentTime = m.start_sec; audio.play(); }};
}}
audio.ontimeupdate = () => marks.forEach((m, i) =>
  list.children[i].classList.toggle("now", audio.currentTime >= m.start_sec && audio.currentTime < (m.end_sec || Infinity)));
</script></body></html>
"""


def player_html(title: str, author: str, audio: str, marks: list[dict]) -> str:
    """A page that plays a file and shows its chapters; all values are escaped."""
    chapters = [{"title": m["title"], "start_sec": m["start_ms"] / 1000.0, "end_sec": m["end_ms"] / 1000.0, "chapter_index": m["chapter_index"]} for m in marks]
    return PAGE.format(title=html.escape(title), author=html.escape(author), audio=html.escape(audio), chapters=json.dumps(chapters).replace("<", "\\u003c"))


def write_player(path: str, title: str, author: str, audio: str, marks: list[dict]) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(player_html(title, author, audio, marks))
    return path


def export(samples: np.ndarray, path: str, title: str = "Audiobook", author: str = "Unknown Author", metadata: str | None = None, audio_format: str | None = None, normalize: bool = True) -> str:
    """Write a document's signal: the format asked for, else by extension, else M4B. Without ffmpeg, or if it fails, WAV bytes under the name."""
    kind = audio_format or FORMATS.get(os.path.splitext(path)[1].lower(), "m4b")
    if kind not in ("m4b", "mp3") or not shutil.which("ffmpeg"):
        return write_wav(samples, path)
    with tempfile.TemporaryDirectory() as folder:
        source, meta = write_wav(samples, os.path.join(folder, "in.wav")), os.path.join(folder, "meta.txt")
        with open(meta, "w", encoding="utf-8") as f:
            f.write(metadata or f";FFMETADATA1\ntitle={title}\nartist={author}\n")
        if kind == "m4b":
            coding = ["-i", meta, "-map_metadata", "1", "-c:a", "aac", "-b:a", "96k"]
        else:
            coding = ["-c:a", "libmp3lame", "-b:a", "128k", "-metadata", f"title={title}", "-metadata", f"artist={author}", "-metadata", f"album={title}", "-metadata", "genre=Audiobook"]
        loud = ["-af", LOUDNESS] if normalize else []
        done = subprocess.run(["ffmpeg", "-y", "-i", source, *coding, "-ar", str(SAMPLE_RATE), *loud, path], capture_output=True, check=False)
        return path if done.returncode == 0 else write_wav(samples, path)


def verify_file(path: str) -> dict:
    """Speech report on a file: WAV as it is, other containers decoded by ffmpeg."""
    if not os.path.exists(path):
        return {"is_speech": False, "reason": "file_not_found"}
    with open(path, "rb") as f:
        data = f.read()
    if os.path.splitext(path)[1].lower() == ".wav":
        rate, samples = from_wav(data)
        return speech_report(samples, rate)
    try:
        return speech_report(decoded(data))
    except EngineError as e:
        return {"is_speech": False, "reason": f"decode_error: {e}"}
