"""Raw segments to segments, tokens to words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_special_token, speech_filter, unicode_trim


def filter_segments(raw: DataFrame) -> DataFrame:
    """``no_speech, text, start_cs, end_cs`` to ``text, start, end`` in seconds, without silence and blanks."""
    kept = raw.filter(speech_filter(F.col("no_speech"), F.col("text")))
    return kept.withColumns({"text": unicode_trim(F.col("text")), "start": F.col("start_cs") / 100, "end": F.col("end_cs") / 100}).drop("no_speech", "start_cs", "end_cs")


def group_words(tokens: DataFrame, *, by: tuple[str, ...] = ("file_id", "seg_no"), order: str = "tok_no") -> DataFrame:
    """Tokens (``text, t0_cs, t1_cs``) to words: a token with a space in front opens one, and so does the first;
    special tokens and blanks are dropped before."""
    kept = tokens.filter(~is_special_token(F.col("text")))
    line = Window.partitionBy(*by).orderBy(order)
    opens = F.when(F.col("text").startswith(" ") | (F.row_number().over(line) == 1), 1).otherwise(0)
    kept = kept.withColumn("__opens", opens).withColumn("word_no", F.sum("__opens").over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("x")))), lambda x: x["x"])
    words = kept.groupBy(*by, "word_no").agg(F.array_join(ordered("text"), "").alias("text"), F.min_by("t0_cs", order).alias("t0"), F.max_by("t1_cs", order).alias("t1"))
    return words.select(*by, F.col("word_no").cast("int").alias("word_no"), (F.col("t0") / 100).alias("start"), (F.col("t1") / 100).alias("end"), F.regexp_replace("text", r"(?U)^\s+", "").alias("text"))
