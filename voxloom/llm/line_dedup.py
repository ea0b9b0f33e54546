"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

Documents come in batches of ascending id. A batch's line keys are joined (merge join) with the sorted runs
of all earlier batches: keys found there, and repeats within the batch, lose their lines; keys not found
become a run of their own. When a level holds ``fanout`` runs they are compacted into one of the next.
Because ids ascend over batches, the first document with a key is the one of the smallest id.

A key is 128 bits (two XXH64 of the text under different prefixes). Hot keys: counts are combined before the
shuffle, and the join back to the lines is a plain sort-merge join whose hot partitions Spark splits (AQE).

Defined results: a null or empty text is one empty line; a null id counts as one document below all others;
repeated rows of one id count as one document and each keeps its lines; an empty table gives no rows; columns
other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, ascii_lower, doc_id, null_id

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def repeated_lines(docs: DataFrame, work: Workspace, *, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``id, th, at``: the line numbers (from 0) that a document, known by id and text hash, loses."""
    cuts = docs.select(F.percentile_approx(doc_id(), [i / batches for i in range(1, batches)]).alias("p")).first()["p"] or []
    batch = reduce(lambda a, b: a + b, [(F.col("id") > c).cast("int") for c in cuts], F.lit(0))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = (
        docs.select(doc_id().alias("id"), text.alias("t"), F.xxhash64(text).alias("th"))
        .select("id", "th", F.posexplode(F.split("t", "\n")).alias("at", "line"))
        .select("id", "th", "at", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("id", "th", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), batch.alias("batch"))
    )
    lines = work.keep(lines, "lines", ["batch"])
    levels: list[list[DataFrame]] = [[]]
    lost = []
    for b in range(batches):
        own = lines.filter(F.col("batch") == b).drop("batch")
        keys = own.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("last"))
        runs = [r for level in levels for r in level]
        if runs:
            seen = reduce(DataFrame.unionByName, runs).withColumn("seen", F.lit(True))
            keys = keys.join(seen.hint("merge"), ["h1", "h2"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
        else:
            keys = keys.withColumn("seen", F.lit(False))
        keys = work.keep(keys.sortWithinPartitions("h1", "h2"), f"keys-{b}")
        drop = keys.filter(F.col("seen") | (F.col("last") > F.col("owner"))).select("h1", "h2", "owner", "seen")
        lost.append(own.join(drop.hint("merge"), ["h1", "h2"]).filter(F.col("seen") | (F.col("id") > F.col("owner"))).select("id", "th", "at"))
        levels[0].append(keys.filter(~F.col("seen")).select("h1", "h2"))
        for k in range(len(levels)):
            if len(levels[k]) >= fanout and b + 1 < batches:
                both = reduce(DataFrame.unionByName, levels[k])
                if k + 1 == len(levels):
                    levels.append([])
                levels[k + 1].append(work.keep(both.repartition("h1", "h2").sortWithinPartitions("h1", "h2"), f"level-{k + 1}"))
                levels[k] = []
    return reduce(DataFrame.unionByName, lost)


def drop_repeated_lines(docs: DataFrame, *, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Per document: ``doc_id, text`` (what is left), ``n_lines, n_dropped``."""
    docs = docs.select("doc_id", "text")
    work = Workspace(docs.sparkSession, "lines")
    lost = repeated_lines(docs, work, min_chars=min_chars, batches=batches, fanout=fanout)
    lost = lost.groupBy("id", "th").agg(F.collect_set("at").alias("gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(doc_id().alias("id"), text.alias("t"), F.xxhash64(text).alias("th")).join(lost, ["id", "th"], "left")
    lines = F.split("t", "\n")
    left = rows.select("id", "t", "gone", lines.alias("lines")).select(
        "id", "t", "gone", "lines", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")).alias("stay")
    )
    kept = F.when(F.col("stay").isNull(), F.col("t")).otherwise(F.array_join(F.transform("stay", lambda i: F.col("lines")[i]), "\n"))
    return left.select(
        null_id(F.col("id")).alias("doc_id"),
        kept.alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )
