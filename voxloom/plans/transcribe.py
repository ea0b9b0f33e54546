"""The whole job: find, skip what is fresh, decode, transcribe, attribute speakers, render, write, report."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.text import output_path
from ..operators.intervals import dominant_speaker
from ..operators.outputs import first_collision, stale_inputs, write_files
from ..operators.subtitles import render
from ..operators.words import filter_segments, group_words
from ..options import JobOptions
from ..session import ship_package
from ..sources.decode import decode_files
from ..sources.discovery import discover, files_table
from ..sources.models import DIARIZATION_RESIDENT, check_capabilities
from .diarize import diarize
from .resources import detected_parallelism, guard_memory, resolve_jobs, resolve_model, total_memory

RAW = "file_id long, language string, wall double, error string, segments array<struct<no_speech:float,text:string,start_cs:long,end_cs:long,tokens:array<struct<text:string,t0_cs:long,t1_cs:long>>>>"


def transcribe(audio: DataFrame, model, options: JobOptions) -> DataFrame:
    """Raw segments of each decoded file; a failure is that file's. Word times only where JSON is wanted."""
    words, language, task = "json" in options.effective_formats, options.language, options.task

    def run(batches):
        import time

        import numpy as np
        import pyarrow as pa

        token = pa.struct([("text", pa.string()), ("t0_cs", pa.int64()), ("t1_cs", pa.int64())])
        segment = pa.struct([("no_speech", pa.float32()), ("text", pa.string()), ("start_cs", pa.int64()), ("end_cs", pa.int64()), ("tokens", pa.list_(token))])
        for b in batches:
            for i, x in zip(b["file_id"].to_pylist(), b["samples"], strict=True):
                began, spoken, rows, error = time.perf_counter(), None, None, None
                try:
                    spoken, rows = model.transcribe(np.asarray(x.values), language, task, words)
                except Exception as e:  # whatever the model raises
                    error = str(e)
                wall = time.perf_counter() - began
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([spoken], pa.string()), pa.array([wall]), pa.array([error], pa.string()), pa.array([rows], pa.list_(segment))], ["file_id", "language", "wall", "error", "segments"])

    return audio.filter("status = 'pcm'").select("file_id", "samples").mapInArrow(run, RAW)


def segments_of(raw: DataFrame, *, words: bool = False) -> DataFrame:
    """``file_id, seg_no, text, start, end`` and, if asked for, ``words``."""
    rows = raw.select("file_id", F.posexplode("segments").alias("seg_no", "s")).select("file_id", "seg_no", "s.*")
    kept = filter_segments(rows.drop("tokens"))
    if not words:
        return kept
    tokens = rows.select("file_id", "seg_no", F.posexplode("tokens").alias("tok_no", "t")).select("file_id", "seg_no", "tok_no", "t.*")
    return kept, group_words(tokens)


def plan(options: JobOptions, *, ram: int | None = None, cores: int | None = None, backend: str = "cpu") -> dict:
    """Checks before any work: inputs, memory, capabilities, collisions aside."""
    if not options.inputs:
        raise EngineError("usage", detail="no input paths")
    for path in options.inputs:
        if not os.path.exists(path):
            raise EngineError("file_not_found", path=path)
    ram, extra = ram if ram is not None else total_memory(), DIARIZATION_RESIDENT if options.diarize else 0
    jobs, note = resolve_jobs(options.jobs, backend, ram, cores or detected_parallelism(), extra)
    model = resolve_model(options.model, ram, jobs, extra)
    guard_memory(model, jobs, ram, extra)
    check_capabilities(model, options.task, options.language)
    if options.out_dir:
        os.makedirs(options.out_dir, exist_ok=True)
    return {"jobs": jobs, "note": note, "model": model, "paths": discover(options.inputs, options.recursive), "formats": options.effective_formats}


def run(spark: SparkSession, options: JobOptions, transcriber, speakers=None, *, checkpoint=None, **machine) -> DataFrame:
    """Results by file: ``file_id, path, outcome, reason, language, duration, wall, outputs``."""
    steps = plan(options, **machine)
    ship_package(spark)
    formats, keep = steps["formats"], checkpoint or (lambda df: df.cache())
    files = files_table(spark, steps["paths"])
    if clash := first_collision(files, formats, options.out_dir):
        raise EngineError("usage", detail=clash)
    lit_dir = None if options.out_dir is None else F.lit(options.out_dir)
    wanted = files.select("file_id", "path", F.explode(F.array(*map(F.lit, formats))).alias("format")).withColumn("output", output_path(F.col("path"), F.col("format"), lit_dir))
    if options.explain_only:
        return wanted
    there = []
    for r in wanted.select("path", "format", "output").collect():  # the driver's own list of inputs by formats
        if os.path.exists(r["output"]):
            from datetime import datetime, timezone

            there.append((r["path"], r["format"], datetime.fromtimestamp(os.stat(r["output"]).st_mtime, timezone.utc)))
    outputs = spark.createDataFrame(there, "path string, format string, mtime timestamp")
    stale = keep(stale_inputs(files, outputs, wanted.select("format"), force=options.force))
    audio = keep(decode_files(stale.repartition(max(1, steps["jobs"]), "file_id"), decoder=options.decoder))
    raw = keep(transcribe(audio, transcriber, options))
    words = "json" in formats
    segments, word_rows = segments_of(raw, words=True) if words else (segments_of(raw), None)
    failed = spark.createDataFrame([], "file_id long, error string")
    if options.diarize:
        turns, failed = diarize(audio, speakers, num_speakers=options.num_speakers, checkpoint=checkpoint)
        turns, failed = keep(turns), keep(failed)
        segments = dominant_speaker(segments, turns)
        if words:
            word_rows = dominant_speaker(word_rows.withColumn("w", F.struct("seg_no", "word_no")), turns, segment="w").drop("w")
    else:
        segments = segments.withColumn("speaker", F.lit(None).cast("int"))
        word_rows = word_rows.withColumn("speaker", F.lit(None).cast("int")) if words else None
    if words:
        lists = word_rows.groupBy("file_id", "seg_no").agg(F.array_sort(F.collect_list(F.struct("word_no", "start", "end", "text", "speaker"))).alias("words"))
        segments = segments.join(lists, ["file_id", "seg_no"], "left")
    about = raw.filter("error is null").select("file_id", "language").join(audio.select("file_id", "duration"), "file_id")
    segments = keep(segments.join(about, "file_id"))
    contents = None
    for f in formats:
        body = render(segments, f, diarized=options.diarize, model=transcriber.name)
        every = about.join(body, "file_id", "left").withColumn("format", F.lit(f)).withColumn("content", F.coalesce("content", _blank(f, options.diarize, transcriber.name)))
        contents = every if contents is None else contents.unionByName(every)
    written = keep(write_files(contents.join(wanted, ["file_id", "format"])))
    status = written.join(wanted, "output").groupBy("file_id").agg(F.sort_array(F.collect_list(F.when(F.col("error").isNull(), F.col("output")))).alias("outputs"), F.min("error").alias("write_error"))
    rows = files.join(audio.select("file_id", "duration", F.col("error.message").alias("decode_error")), "file_id", "left")
    rows = rows.join(raw.select("file_id", "language", "wall", F.col("error").alias("run_error")), "file_id", "left").join(status, "file_id", "left")
    rows = rows.join(failed.withColumnRenamed("error", "diarize_error"), "file_id", "left").join(stale.select("file_id", F.lit(True).alias("stale")), "file_id", "left")
    saved = F.concat(F.lit("diarization failed: "), F.col("diarize_error"), F.lit("; transcript saved without speakers"))
    reason = F.coalesce("decode_error", "run_error", "write_error", saved)
    outcome = F.when(F.col("stale").isNull(), "skipped").when(reason.isNotNull(), "failed").otherwise("done")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return rows.select("file_id", "path", F.col("path").alias("name"), outcome.alias("outcome"), reason.alias("reason"), "language", zero("duration"), zero("wall"), "outputs")


def _blank(fmt: str, diarized: bool, model: str):
    """A transcript of no segments."""
    if fmt in ("tsv", "csv"):
        return F.lit(("\t" if fmt == "tsv" else ",").join(["start", "end", "text"] + ["speaker"] * diarized) + "\n")
    if fmt == "json":
        none = F.expr("cast(array() as array<struct<start:double,end:double,text:string>>)")
        return F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(model).alias("model"), "language", "duration", none.alias("segments")), {"pretty": "true"})
    return F.lit("WEBVTT\n\n" if fmt == "vtt" else "")
