"""User-given casts in all accepted forms: JSON, files, maps, lists and ``Name:gender:voice`` specs."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

GENDERS = {"male": "male", "female": "female", "neutral": "neutral", "unknown": "unknown", "m": "male", "f": "female", "n": "neutral"}


@dataclass(frozen=True)
class Member:
    """A character known in advance."""

    name: str
    gender: str = "unknown"
    voice: str | None = None
    aliases: tuple[str, ...] = ()


def from_spec(spec: str) -> Member:
    """``Name``, ``Name:gender``, ``Name:voice`` or ``Name:gender:voice``; letters m, f, n count as genders."""
    name, *rest = (p.strip() for p in spec.split(":"))
    gender, voice = "unknown", None
    if rest:
        gender = GENDERS.get(rest[0].lower(), "unknown")
        voice = None if rest[0].lower() in GENDERS else rest[0]
    if len(rest) > 1:
        voice = rest[1]
    return Member(name, gender, voice)


def from_fields(name: str, fields: dict[str, Any]) -> Member:
    return Member(name, fields.get("gender", "unknown").lower(), fields.get("voice") or fields.get("assigned_voice"), tuple(sorted(set(fields.get("aliases", [])))))


def _entry(name: str, value: Any) -> Member:
    if isinstance(value, Member):
        return value
    if isinstance(value, dict):
        return from_fields(name, value)
    if isinstance(value, str):
        gender = GENDERS.get(value.lower().strip())
        return Member(name, gender) if gender else Member(name, voice=value)
    return Member(name)


def read_cast(given: Any, open_listed_files: bool = False) -> list[Member]:
    """Members in order, later entries of a name replacing earlier ones.

    A string is a file, else JSON if it looks like it and parses, else a list of
    specs between commas. ``open_listed_files`` also reads files named inside a list.
    """
    if not given:
        return []
    if isinstance(given, str):
        if os.path.isfile(given):
            with open(given, encoding="utf-8") as f:
                return read_cast(json.load(f), open_listed_files)
        if given.strip()[:1] in ("{", "["):
            try:
                return read_cast(json.loads(given), open_listed_files)
            except (ValueError, AttributeError):
                pass
        given = [x.strip() for x in given.split(",") if x.strip()]
    found: dict[str, Member] = {}
    if isinstance(given, dict):
        for name, value in given.items():
            found[name] = _entry(name, value)
    else:
        for item in given:
            if isinstance(item, Member):
                found[item.name] = item
            elif isinstance(item, dict):
                if item.get("name"):
                    found[item["name"]] = from_fields(item["name"], item)
            elif isinstance(item, str):
                if open_listed_files and os.path.isfile(item):
                    found |= {m.name: m for m in read_cast(item)}
                else:
                    member = from_spec(item)
                    found[member.name] = member
    return list(found.values())


def parse_spec(spec: Column) -> Column:
    """``Name:gender:voice`` as struct(name, gender, voice), natively."""
    from inkstream.functions.text import strip

    parts = F.transform(F.split(spec, ":", -1), strip)
    second = F.try_element_at(parts, F.lit(2))
    abbreviations = F.create_map(*[F.lit(x) for pair in GENDERS.items() for x in pair])
    gender = F.when(second.isNotNull(), F.try_element_at(abbreviations, F.lower(second)))
    voice = F.coalesce(F.try_element_at(parts, F.lit(3)), F.when(gender.isNull(), second))
    return F.struct(F.element_at(parts, 1).alias("name"), F.coalesce(gender, F.lit("unknown")).alias("gender"), voice.alias("voice"))
