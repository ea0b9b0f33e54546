"""Results of a batch: counts, speed, exit code. One row for each file: ``name, duration, wall, outcome`` (done,
skipped, failed), ``reason, language, outputs``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CODES
from ..functions.text import one_decimal_of_double, realtime_factor


def summary(results: DataFrame) -> DataFrame:
    """One row: counts, and the speed over files that were done."""
    is_ = lambda x: F.col("outcome") == x
    total = lambda c: F.coalesce(F.sum(F.when(is_("done"), F.col(c))), F.lit(0.0))
    counts = results.agg(*[F.count_if(is_(x)).alias(x) for x in ("done", "skipped", "failed")], total("duration").alias("audio"), total("wall").alias("wall"))
    return counts.withColumn("speed", realtime_factor(F.col("audio"), F.col("wall")))


def exit_code(failed: Column, processed: Column, total: Column, interrupted: Column) -> Column:
    """20 where a file failed, or where a run was stopped before its last file; else 0."""
    return F.when(failed > 0, CODES["partial_batch_failure"]).when(interrupted & (processed < total), CODES["interrupted"]).otherwise(0)


def batch_exit_code(results: DataFrame, *, total: int | None = None, interrupted: bool = False) -> DataFrame:
    counts = results.agg(F.count_if(F.col("outcome") == "failed").alias("failed"), F.count("*").alias("processed"))
    return counts.withColumn("exit_code", exit_code(F.col("failed"), F.col("processed"), F.col("processed") if total is None else F.lit(total), F.lit(interrupted)))


def outcome(decode_status: Column, transcript_error: Column, diarize_error: Column, write_error: Column) -> tuple[Column, Column]:
    """A file's outcome and reason. Failed diarization keeps the transcript, but the file counts as failed."""
    what = (
        F.when(decode_status == "skip", "skipped").when(decode_status == "failed", "failed")
        .when(transcript_error.isNotNull() | write_error.isNotNull() | diarize_error.isNotNull(), "failed").otherwise("done")
    )
    why = F.coalesce(transcript_error, write_error, F.concat(F.lit("diarization failed: "), diarize_error, F.lit("; transcript saved without speakers")))
    return what, why


def report_lines(results: DataFrame) -> DataFrame:
    """``name, line`` of each file for people."""
    speed = F.coalesce(realtime_factor(F.col("duration"), F.col("wall")), F.lit("—"))
    seconds = lambda c: one_decimal_of_double(F.col(c))
    done = F.concat(F.lit("["), F.coalesce("language", F.lit("")), F.lit("] "), seconds("duration"), F.lit("s in "), seconds("wall"), F.lit("s ("), speed, F.lit(") → "), F.array_join("outputs", ", "))
    line = F.when(F.col("outcome") == "done", F.concat(F.lit("ok  "), done)).when(F.col("outcome") == "skipped", F.lit("skip  up to date")).otherwise(F.concat(F.lit("fail  "), F.coalesce("reason", F.lit(""))))
    return results.select("name", line.alias("line"))
