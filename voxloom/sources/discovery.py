"""Finding audio files, on the driver."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that are tried, in any case.
EXTENSIONS = ("wav", "mp3", "flac", "ogg", "oga", "m4a", "mp4", "m4b")
FILES = "file_id long, path string, ext string, size long, mtime timestamp"


def is_audio(path: str) -> bool:
    return os.path.splitext(path)[1][1:].lower() in EXTENSIONS


def is_audio_column(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)).isin(*EXTENSIONS)


def discover(inputs: Iterable[str], recursive: bool = False) -> list[str]:
    """Audio files among the inputs and in the folders among them, sorted, each path once. Other files are passed
    over, folders that can't be read are, too; links are followed, each real folder once."""
    found: set[str] = set()
    for path in inputs:
        if os.path.isdir(path):
            found.update(_scan(path, recursive, set()))
        elif is_audio(path):
            found.add(path)
    return sorted(found)


def _scan(folder: str, recursive: bool, seen: set[str]) -> Iterable[str]:
    real = os.path.realpath(folder)
    if real in seen:
        return
    seen.add(real)
    try:
        names = sorted(os.listdir(folder))
    except OSError:
        return
    for name in names:
        path = os.path.join(folder, name)
        if os.path.isdir(path):
            if recursive:
                yield from _scan(path, recursive, seen)
        elif is_audio(path):
            yield path


def files_table(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """``file_id, path, ext, size, mtime``; the last two null where the file can't be seen."""
    from datetime import datetime, timezone

    rows = []
    for k, path in enumerate(paths):
        try:
            s = os.stat(path)
            size, mtime = s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc)
        except OSError:
            size = mtime = None
        rows.append((k, path, os.path.splitext(path)[1][1:].lower(), size, mtime))
    return spark.createDataFrame(rows, FILES)
