"""From windows' frame activity to speaker turns.

Activity is in long form, a row for each frame on which a window's local speaker is on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import FRAMES, chunk_start_frame, frame_middle, num_chunks, num_global_frames


def chunk_plan(files: DataFrame, *, samples: str = "n_samples", hop: int = 16_000) -> DataFrame:
    """``files`` by window: ``chunk_no, start_sample``."""
    chunk = F.explode(F.sequence(F.lit(0), num_chunks(F.col(samples)) - 1))
    return files.withColumn("chunk_no", chunk).withColumn("start_sample", F.col("chunk_no").cast("long") * hop)


def _windows_over(frame: Column, chunks: Column) -> Column:
    """How many of a file's windows cover a frame, from its number alone: a dozen windows come into question."""
    about = F.floor(frame / (FRAMES / 10)).cast("int")
    last = F.least(about + 1, chunks - 1)
    near = F.sequence(F.greatest(about - 11, F.lit(0)), F.greatest(last, F.lit(0)))
    return F.size(F.filter(near, lambda c: (c <= last) & frame.between(chunk_start_frame(c), chunk_start_frame(c) + FRAMES - 1)))


def speaker_count(active: DataFrame, files: DataFrame, *, by: str = "file_id", cap: int | None = None) -> DataFrame:
    """``by, frame, n`` for every global frame: mean number of speakers over the windows that cover it, ties to
    even. ``active``: ``by, chunk_no, frame_no, local_spk``; ``files``: ``by, n_chunks``.

    Only frames on which someone is on, and one row a file, are shuffled and sorted; each then brings along the
    silent frames up to the next, so no table of all frames is held, joined or aggregated.
    """
    on = active.select(by, (chunk_start_frame(F.col("chunk_no")) + F.col("frame_no")).cast("int").alias("frame")).filter(F.col(by).isNotNull() & (F.col("frame") >= 0))
    on = on.groupBy(by, "frame").agg(F.count("*").alias("on")).withColumn("chunks", F.lit(None).cast("int"))
    marks = on.unionByName(files.select(by, F.lit(-1).alias("frame"), F.lit(0).cast("long").alias("on"), F.col("n_chunks").cast("int").alias("chunks")))
    line = Window.partitionBy(by).orderBy("frame")
    chunks = F.max("chunks").over(line.rowsBetween(Window.unboundedPreceding, 0))  # that of the file's own row, frame -1, the first
    rows = marks.withColumns({"chunks": chunks, "next": F.lead("frame").over(line)}).withColumn("total", num_global_frames(F.col("chunks"))).filter("frame < total")
    windows = _windows_over(F.col("frame"), F.col("chunks"))
    n = F.when((F.col("frame") >= 0) & (windows > 0), F.rint(F.col("on") / F.nullif(windows, F.lit(0))).cast("int")).otherwise(0)
    n = n if cap is None else F.least(n, F.lit(cap))
    until = F.least(F.coalesce("next", "total"), F.col("total")) - 1
    rows = rows.select(by, F.col("frame").alias("__first"), n.alias("__n"), F.explode(F.sequence("frame", until)).alias("__at")).filter("__at >= 0")
    return rows.select(by, F.col("__at").alias("frame"), F.when(F.col("__at") == F.col("__first"), F.col("__n")).otherwise(0).alias("n"))


def cluster_support(active: DataFrame, labels: DataFrame, *, by: str = "file_id") -> DataFrame:
    """``by, frame, cluster, support``: windows in which any speaker of the cluster is on; two of one cluster count once."""
    named = active.join(labels, [by, "chunk_no", "local_spk"]).filter("cluster is not null")
    once = named.select(by, "chunk_no", "frame_no", "cluster").distinct()
    return once.select(by, (chunk_start_frame(F.col("chunk_no")) + F.col("frame_no")).alias("frame"), "cluster").groupBy(by, "frame", "cluster").agg(F.count("*").alias("support"))


def top_clusters(support: DataFrame, counts: DataFrame, clusters: DataFrame, *, by: str = "file_id") -> DataFrame:
    """``by, frame, cluster`` of the ``n`` best supported clusters of each frame, the lower id on ties; where more
    are asked for than have support, those without any fill up. ``clusters``: ``by, n_clusters``.

    A frame is one row with its few supported clusters as an array, not one row for each cluster there is."""
    spoken = counts.filter("n > 0").withColumn("m", F.max("n").over(Window.partitionBy(by)))
    spoken = spoken.join(clusters.select(by, "n_clusters"), by).select(by, "frame", "n", F.greatest("n_clusters", "m").alias("width"))
    kind = dict(spoken.dtypes)["width"]
    named = support.filter("support > 0").select(by, "frame", F.struct((-F.col("support")).alias("s"), F.col("cluster").cast(kind).alias("k")).alias("c"))
    named = named.groupBy(by, "frame").agg(F.array_sort(F.collect_list("c")).alias("c"))
    every = F.sequence(F.lit(0).cast(kind), F.col("width") - 1)
    known = F.filter(F.transform(F.coalesce("c", F.expr("array()").cast(f"array<struct<s:bigint,k:{kind}>>")), lambda c: c["k"]), lambda k: (k >= 0) & (k < F.col("width")))
    rows = spoken.join(named, [by, "frame"], "left").select(by, "frame", "n", known.alias("known"), every.alias("every"))
    best = F.slice(F.concat("known", F.array_except("every", "known")), F.lit(1), F.col("n"))
    return rows.select(by, "frame", F.explode(best).alias("cluster"))


def to_turns(on: DataFrame, files: DataFrame, *, by: str = "file_id", frames: str = "n_frames") -> DataFrame:
    """Runs of frames to turns between middles of frames; a run that reaches the last frame ends at its middle."""
    line = Window.partitionBy(by, "cluster").orderBy("frame")
    runs = on.withColumn("run", F.col("frame") - F.row_number().over(line)).groupBy(by, "cluster", "run").agg(F.min("frame").alias("a"), F.max("frame").alias("z"))
    rows = runs.join(files.select(by, frames), by)
    return rows.select(by, "cluster", frame_middle(F.col("a")).alias("start"), frame_middle(F.least(F.col("z") + 1, F.col(frames) - 1)).alias("end"))


def renumber(turns: DataFrame, *, by: str = "file_id") -> DataFrame:
    """Turns with ``speaker`` from 0 in the order in which clusters first appear."""
    first = F.min(F.struct("start", "end", "cluster")).over(Window.partitionBy(by, "cluster"))
    return turns.withColumn("__first", first).withColumn("speaker", (F.dense_rank().over(Window.partitionBy(by).orderBy("__first")) - 1).cast("int")).drop("__first", "cluster")
