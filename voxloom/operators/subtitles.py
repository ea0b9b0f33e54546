"""Timestamps that never run backwards, and transcripts as text, subtitles, tables and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import csv_field, milliseconds, speaker_label, speaker_name, timestamp, vtt_escape

SCHEMA_VERSION = 1


def sanitized(segments: DataFrame, *, by: str = "file_id", order: str = "seg_no") -> DataFrame:
    """Starts are at least 0 and the end before, ends at least their start.

    Each adjusted end is the largest of all ends and starts so far, so a running maximum does it."""
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.greatest(F.lit(0).cast(segments.schema["start"].dataType), F.col("start"), F.col("end"))
    rows = segments.withColumn("__before", F.coalesce(F.max(top).over(so_far), F.lit(0)))
    start = F.greatest(F.col("start"), F.lit(0), F.col("__before"))
    return rows.withColumns({"start": start, "end": F.greatest(F.col("end"), start)}).drop("__before")


def _joined(rows: DataFrame, by: str, order: str, line: Column, head: str, name: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(by).agg(F.concat(F.lit(head), F.array_join(lines, "")).alias(name))


def _numbered(segments: DataFrame, by: str, order: str) -> DataFrame:
    return sanitized(segments, by=by, order=order).withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def txt_line() -> Column:
    return F.concat(F.coalesce(F.concat(speaker_name(F.col("speaker")), F.lit(": ")), F.lit("")), F.col("text"), F.lit("\n"))


def srt_cue() -> Column:
    named = F.concat(F.coalesce(F.concat(speaker_name(F.col("speaker")), F.lit(": ")), F.lit("")), F.col("text"))
    return F.concat(F.col("__n").cast("string"), F.lit("\n"), timestamp(F.col("start"), ","), F.lit(" --> "), timestamp(F.col("end"), ","), F.lit("\n"), named, F.lit("\n\n"))


def vtt_cue() -> Column:
    voice = F.coalesce(F.concat(F.lit("<v "), speaker_name(F.col("speaker")), F.lit(">")), F.lit(""))
    return F.concat(timestamp(F.col("start"), "."), F.lit(" --> "), timestamp(F.col("end"), "."), F.lit("\n"), voice, vtt_escape(F.col("text")), F.lit("\n\n"))


def table_row(mark: str, diarized: bool, text: Column) -> Column:
    cells = [milliseconds(F.col("start")).cast("string"), F.lit(mark), milliseconds(F.col("end")).cast("string"), F.lit(mark), text]
    if diarized:
        cells += [F.lit(mark), F.coalesce(speaker_label(F.col("speaker")), F.lit(""))]
    return F.concat(*cells, F.lit("\n"))


def render(segments: DataFrame, fmt: str, *, by: str = "file_id", order: str = "seg_no", diarized: bool = False, name: str = "content", model: str | Column = "stub") -> DataFrame:
    """One row for each file with its transcript as ``fmt``. Segments have ``start, end`` (seconds), ``text``,
    ``speaker``; for JSON also ``language, duration`` and, if any, ``words``."""
    if fmt == "txt":
        return _joined(segments, by, order, txt_line(), "", name)
    rows = _numbered(segments, by, order)
    if fmt == "srt":
        return _joined(rows, by, order, srt_cue(), "", name)
    if fmt == "vtt":
        return _joined(rows, by, order, vtt_cue(), "WEBVTT\n\n", name)
    if fmt in ("tsv", "csv"):
        mark, text = ("\t", F.col("text")) if fmt == "tsv" else (",", csv_field(F.col("text")))
        head = mark.join(["start", "end", "text"] + ["speaker"] * diarized) + "\n"
        return _joined(rows, by, order, table_row(mark, diarized, text), head, name)
    if fmt != "json":
        raise ValueError(f"unknown format {fmt}")
    fields = [F.col("start"), F.col("end"), F.col("text"), speaker_label(F.col("speaker")).alias("speaker")]
    if "words" in segments.columns:
        word = lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["text"].alias("text"), speaker_label(w["speaker"]).alias("speaker"))
        fields.append(F.when(F.size("words") > 0, F.transform("words", word)).alias("words"))  # none: left out
    docs = rows.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("s")))).alias("all"), F.first("language").alias("language"), F.first("duration").alias("duration")
    )
    model = model if isinstance(model, Column) else F.lit(model)
    doc = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), model.alias("model"), "language", "duration", F.transform("all", lambda x: x["s"]).alias("segments"))
    return docs.select(by, F.to_json(doc, {"pretty": "true"}).alias(name))
